"""Writers: tables, fixed and growing CSV, logs, dashboards, stage times, quarantine."""

from __future__ import annotations

import contextlib
import html
import socket
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document a line. What was there stays until all of the new is written; then the folders are exchanged.

    A reader that comes between the two moves finds nothing; who needs more writes a table of ``versions``.
    """
    spark, fresh = df.sparkSession, f"{path}.new"
    df.write.mode("overwrite").json(fresh)
    place = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(place(path), True)
    if not fs.rename(place(fresh), place(path)):
        raise OSError(f"{fresh} can't be moved to {path}")


def write_keyed(df: DataFrame, path: str, key: str = "slice_name", per_file: int = 10_000) -> None:
    """JSON objects of records by key, about ``per_file`` records in each file, none twice; rows with a null key are left out.

    Of rows with the same key one is written, the first by its JSON text. A single document can't grow without bound, so
    there are as many files as the rows ask for; ``documents.read_keyed`` reads them all.
    """
    record = F.to_json(F.struct(*(c for c in df.columns if c != key)))
    rows = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("k")).agg(F.min(record).alias("r"))
    files = max(1, -(-rows.count() // per_file))
    name = F.substring(F.to_json(F.create_map(F.col("k"), F.lit(0))), 2, 1 << 30)  # the key as a JSON text, and ":0}"
    entry = F.concat(F.regexp_replace(name, ":0[}]$", ":"), "r")
    docs = rows.groupBy(F.pmod(F.xxhash64("k"), F.lit(files)).alias("f")).agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(entry)), ","), F.lit("}")).alias("value"))
    docs.write.mode("overwrite").partitionBy("f").text(path)


def write_prompts(df: DataFrame, root: str, split: str, alias: bool = False, remove_stale: bool = True) -> dict[str, str]:
    """Prompts of a split under ``prompts/``; with ``alias`` also at the root, else one left there from before is removed. Returns what was done."""
    name = f"prompts_{split}.json"
    done = {"canonical": f"{root}/prompts/{name}"}
    write_keyed(df, done["canonical"])
    place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    fs = place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    if alias:
        write_keyed(df, f"{root}/{name}")
        done["alias"] = f"{root}/{name}"
    elif remove_stale and fs.exists(place):
        fs.delete(place, True)
        done["removed"] = f"{root}/{name}"
    return done


def write_metadata(root: str, **tables: DataFrame) -> list[str]:
    """The metadata bundle of a fold: each table as JSON lines below ``meta/``, in the order of their names. Returns the paths."""
    paths = []
    for name, df in sorted(tables.items()):
        paths.append(f"{root}/meta/{name}.json")
        write_json(df, paths[-1])
    return paths


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """Exactly ``fields``, in order; missing ones and nulls are empty, others are left out."""
    cols = [(F.col(f).cast("string") if f in df.columns else F.lit(None).cast("string")).alias(f) for f in fields]
    df.select(*cols).na.fill("").write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def union_sorted(frames: list[DataFrame]) -> DataFrame:
    """All rows with the sorted union of the columns."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return whole.select(*sorted(whole.columns))


def write_samples(df: DataFrame, path: str, by: tuple[str, ...] = ("dataset_name", "fold", "split"), rows_a_file: int = 1_000_000) -> None:
    """Samples as Parquet, partitioned for pruning: a partition has a file for about each ``rows_a_file`` rows, each written by a task of its own."""
    sizes = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / rows_a_file).cast("int").alias("_files"))
    same = reduce(lambda a, b: a & b, (F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by))
    # by content, so a task that runs again deals its rows the same way; maps can't be hashed
    told = [F.col(f"d.{c}") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    cut = df.alias("d").join(sizes.alias("s"), same).select("d.*", F.pmod(F.xxhash64(*told), F.col("_files")).alias("_file"))
    cut.repartition(*by, "_file").drop("_file").write.mode("overwrite").partitionBy(*by).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def assemble_supervision(train: DataFrame, full: DataFrame, pseudo: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """key, label_path, origin: full samples from the truth, all others from pseudo labels; a sample without its label is an error at run time."""
    full_rows = train.join(full.select(key), key, "left_semi").join(truth.select(key, F.col("path").alias("label_path")), key, "left").withColumn("origin", F.lit("full"))
    box_rows = train.join(full.select(key), key, "left_anti").join(pseudo.select(key, F.col("path").alias("label_path")), key, "left").withColumn("origin", F.lit("box"))
    out = full_rows.unionByName(box_rows).select(key, "label_path", "origin")
    return out.withColumn("label_path", F.coalesce("label_path", F.raise_error(F.concat(F.lit("no label for "), F.col(key)))))


def publish_view(df: DataFrame, name: str) -> None:
    """A canonical name for a chosen label set."""
    df.createOrReplaceTempView(name)


def quarantine(df: DataFrame, bad, reason) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with their reason): a condition that is null counts as bad."""
    flag = F.coalesce(bad, F.lit(True))
    return df.where(~flag), df.where(flag).withColumn("reason", reason)


def dashboard(states: DataFrame, refresh_seconds: int = 5, most: int = 1000) -> str:
    """A self-refreshing page over the latest states, in the order of their columns: the first ``most``, and how many there are."""
    total = states.count()
    rows = states.orderBy(*states.columns).limit(most).collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in states.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f'<!doctype html><meta charset="utf-8"><meta http-equiv="refresh" content="{refresh_seconds}"><title>Progress</title><p>{len(rows)} of {total}</p><table><tr>{head}</tr>{body}</table>'


@contextlib.contextmanager
def stage_timer(spark: SparkSession, path: str, stage: str, **labels: str):
    """Appends one row about the stage when it ends, also when it fails; the error is raised on."""
    start, note, status = time.time(), "", "success"
    try:
        yield
    except BaseException as e:
        status, note = "failed", repr(e)
        raise
    finally:
        end = time.time()
        row = {"stage_name": stage, "status": status, "start_ts": start, "end_ts": end, "duration_sec": max(0.0, end - start), "host": socket.gethostname(), "notes": note} | labels
        spark.createDataFrame([row]).write.mode("append").json(path)
