"""A reproducible sample that keeps what it selected as data grow.

Consistent weighted Poisson sampling: an identifier is selected when its hash, a fixed number in [0, 1), is
below weight x rate. The hash depends on seed and identifier only, so reruns and partitionings agree; and as
the weight that counts at a round is the maximum of all weights up to it, the inclusion probability never
falls and what was selected stays.

The maxima are a stored state (``update_state``): a table that only grows, to which each delivery adds the weights
that rise above what is stored. So nothing is lost when the rows of an old delivery are gone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slicewright.session import materialize, new_table_path
from slicewright.sources import versions

#: Parts of the members of a series, by hash: runs and members meet within one.
BUCKETS = 256


def unit_hash(seed: Column, ident: Column) -> Column:
    """A number in [0, 1) fixed by seed and identifier: the first 52 bits of an MD5 sum, the same in any engine."""
    hexed = F.substring(F.md5(F.concat_ws(":", seed.cast("string"), ident)), 1, 13)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(float(1 << 52))


def weight_rises(rows: DataFrame, series: list[str], ident: str, round_col: str, weight: str) -> DataFrame:
    """series, ident, round and ``max_weight`` where the running maximum of the weight rises: the stored state.

    Repeated observations of a round are folded to their greatest weight first, so a window holds as many rows
    as an identifier has rounds. Null identifiers and null rounds are left out; a null weight counts as 0.
    """
    folded = rows.where(F.col(ident).isNotNull() & F.col(round_col).isNotNull()).groupBy(*series, ident, round_col).agg(F.max(F.coalesce(weight, F.lit(0.0))).alias("_weight"))
    order = Window.partitionBy(*series, ident).orderBy(round_col)
    before = F.max("_weight").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rises = folded.withColumn("_before", before).where("_before is null or _weight > _before")
    return rises.select(*series, ident, round_col, F.col("_weight").alias("max_weight"))


def update_state(spark: SparkSession, path: str, rows: DataFrame, series: list[str], ident: str, round_col: str, weight: str) -> DataFrame:
    """Add a delivery to the state stored at ``path`` (made if there is none), and return the state.

    Only weights that rise above the stored ones are added, by one commit; of two writers at once one gets a
    ``VersionConflict``. A late row of an earlier round may add a rise before stored ones, which then add nothing
    but stay. Nulls as in ``weight_rises``.
    """
    names = [*series, ident, round_col]
    if versions.latest(spark, path).number >= 0:
        stored = versions.read(spark, path)
        seen = stored.select(*names, F.col("max_weight").alias(weight))
        fresh = weight_rises(rows.select(*names, weight).unionByName(seen), series, ident, round_col, weight)
        # the identifier and round of a rise are never null; series may be, so all are compared null-safe
        same = F.lit(True)
        a, b = fresh.alias("a"), stored.alias("b")
        for n in [*names, "max_weight"]:
            same = same & F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}"))
        fresh = a.join(b, same, "left_anti")
    else:
        fresh = weight_rises(rows, series, ident, round_col, weight)
    versions.append(spark, path, fresh.select(*names, "max_weight"), F.lit("0"))
    return versions.read(spark, path)


def selected_from(state: DataFrame, series: list[str], ident: str, round_col: str, seed: Column, rate: float) -> DataFrame:
    """series, ident and ``from_round``, the first round at which the identifier is in the sample, with its hash."""
    hashed = state.withColumn("hash", unit_hash(seed, F.col(ident)))
    inside = hashed.where(F.col("hash") < F.col("max_weight") * rate)
    return inside.groupBy(*series, ident, "hash").agg(F.min(round_col).alias("from_round"))


def _runs(selection: DataFrame, default_seed: int) -> DataFrame:
    series = selection.select("run_id", "dataset_name", "fold", F.coalesce("seed", F.lit(default_seed)).alias("seed"), "round", "cumulative_full_case_ids")
    return series.where("cumulative_full_case_ids is not null and round is not null")


def lost_members(selection: DataFrame, default_seed: int) -> DataFrame:
    """run_id, case_id, distinct: cases a run should hold, as some run of its series held them in the same or a lower round, but doesn't.

    The lists are deliveries to the sampler's state: a listed case has weight 1 in its round, and a run should hold
    all that the sampler selects up to its round at rate 1. At that weight every hash is below weight x rate, as what
    was annotated once stays for certain; what decides is the stored maximum. Null lists, rounds and elements take no
    part; rows of one run are taken together. Series compare null dataset_name and fold as equal.

    A run lists nothing that its sample lacks, so a run is complete when it lists as many cases as its sample
    has; the others are compared by buckets of cases, and only buckets that lack some are met with the members.
    """
    spark = selection.sparkSession
    key = ["run_id", "series", "round"]
    runs = _runs(selection, default_seed).withColumn("series", F.struct("dataset_name", "fold", "seed")).select(*key, "cumulative_full_case_ids")
    held = runs.select(*key, F.explode("cumulative_full_case_ids").alias("case_id")).where("case_id is not null").distinct()
    held = materialize(held.withColumn("bucket", F.pmod(F.xxhash64("case_id"), F.lit(BUCKETS)).cast("int")), "held")
    state = update_state(spark, new_table_path(spark, "sampler-state"), held.withColumn("weight", F.lit(1.0)), ["series", "bucket"], "case_id", "round", "weight")
    members = materialize(selected_from(state, ["series", "bucket"], "case_id", "round", F.col("series.seed"), 1.0), "members")
    starts = members.groupBy("series", "bucket", "from_round").agg(F.count(F.lit(1)).alias("new"))
    every = runs.select(*key).distinct()
    ticks = starts.select("series", F.col("from_round").alias("round"), "new").unionByName(every.select("series", "round", F.lit(0).cast("bigint").alias("new")))
    upto = Window.partitionBy("series").orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    due = ticks.groupBy("series", "round").agg(F.sum("new").alias("new")).select("series", "round", F.sum("new").over(upto).alias("due"))
    sizes = held.groupBy(*key, "bucket").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy(*key).agg(F.sum("n").alias("n"))
    short = materialize(every.join(whole, key, "left").join(due, ["series", "round"]).where(F.coalesce("n", F.lit(0)) < F.col("due")).select(*key), "short")
    wanted = short.join(starts, "series").where("from_round <= round").groupBy(*key, "bucket").agg(F.sum("new").alias("due"))
    lacking = wanted.join(sizes, [*key, "bucket"], "left").where(F.coalesce("n", F.lit(0)) < F.col("due")).select(*key, "bucket")
    missing = lacking.join(members, ["series", "bucket"]).where("from_round <= round")
    return missing.join(held, [*key, "bucket", "case_id"], "left_anti").select("run_id", "case_id").distinct()


def case_weights(manifest: DataFrame, full_weight: int = 50) -> DataFrame:
    """dataset_name, case_id, month, weight: the slices of a case at the end of a month over ``full_weight``, at most 1.

    A slice counts from the month of ingested_at until that of deleted_at; so weights rise and fall. case_id is compared
    as stored. Rows with a null case_id or ingested_at are left out; a case without slices at a month has weight 0.
    """
    good = manifest.where("case_id is not null and ingested_at is not null")
    came = good.select("dataset_name", "case_id", F.date_format("ingested_at", "yyyy-MM").alias("month"), F.lit(1).alias("d"))
    went = good.where("deleted_at is not null").select("dataset_name", "case_id", F.date_format(F.greatest("deleted_at", "ingested_at"), "yyyy-MM").alias("month"), F.lit(-1).alias("d"))
    per = came.unionByName(went).groupBy("dataset_name", "case_id", "month").agg(F.sum("d").alias("n"))
    sofar = F.sum("n").over(Window.partitionBy("dataset_name", "case_id").orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return per.select("dataset_name", "case_id", "month", F.least(F.lit(1.0), sofar / F.lit(float(full_weight))).alias("weight"))


def growing_case_sample(manifest: DataFrame, seed: int, rate: float, full_weight: int = 50, path: str | None = None) -> DataFrame:
    """Cases sampled with a weight that follows their number of slices (``case_weights``), as deliveries come in by month.

    With ``path`` the state is kept there from one delivery to the next; else it begins anew. Returns dataset_name,
    case_id, from_month, hash.
    """
    spark = manifest.sparkSession
    state = update_state(spark, path or new_table_path(spark, "sampler-state"), case_weights(manifest, full_weight), ["dataset_name"], "case_id", "month", "weight")
    chosen = selected_from(state, ["dataset_name"], "case_id", "month", F.lit(seed), rate)
    return chosen.select("dataset_name", "case_id", F.col("from_round").alias("from_month"), "hash")
