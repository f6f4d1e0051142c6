"""Work on the rows of a fold one by one, where the failure of a row is a row of its own and stops nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewright.session import materialize, share_package
from slicewright.sources.sinks import quarantine


def run_fold(rows: DataFrame, key: list[str], work: Callable[[pd.Series], dict], schema: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, failures, statistics) of ``work(row) -> values of schema`` on each row.

    results: key and the columns of ``schema``; failures: key and ``reason``, the error of the row; statistics: one row of
    n_rows, n_done, n_failed. The work is done once: its outcome is written before it is read for any of them. ``key``
    tells rows apart and must not be among the columns of ``schema``.
    """
    share_package(rows.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                told, error = dict.fromkeys(names), None
                try:
                    told |= {n: v for n, v in work(row).items() if n in told}
                except Exception as e:  # any failure of a row is its own
                    error = f"{type(e).__name__}: {e}"
                out.append([*(row[k] for k in key), *told.values(), error])
            yield pd.DataFrame(out, columns=[*key, *names, "_error"])

    done = materialize(rows.mapInPandas(run, f"{kinds}, {schema}, _error string"), "fold")
    good, bad = quarantine(done, F.col("_error").isNotNull(), F.col("_error"))
    counts = done.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_error").isNull()).alias("n_done"), F.count_if(F.col("_error").isNotNull()).alias("n_failed"))
    return good.drop("_error"), bad.select(*key, "reason"), counts
