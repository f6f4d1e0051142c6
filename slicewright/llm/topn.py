"""Top N items within every group, for tiny and huge groups alike.

A histogram of the scores of each large group gives a threshold below which at least N items lie; rows above
it are filtered out before anything is ranked, and the survivors are ranked exactly with their tie keys. The
window that ranks keeps N rows a group on each side of its shuffle (Spark's window group limit), so neither a
huge group nor a huge tie reaches one task whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 256
#: Groups of at most so many rows need no threshold.
SMALL_GROUP = 64


def score_bin(score: Column, lo: float, hi: float) -> Column:
    """The bin of a score, never falling with it; scores outside of [lo, hi] go to the outer bins."""
    at = F.floor((score - lo) / (hi - lo) * BINS)
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), at)).cast("int")


def latest(rows: DataFrame, keys: list[str], time: str, rest: list[str]) -> DataFrame:
    """Of the rows with the same keys the one with the latest time (null: earliest); of equals the greatest by ``rest``. As keys and struct ``_r``."""
    return rows.groupBy(*keys).agg(F.max(F.struct(time, *rest)).alias("_r"))


def top_n(items: DataFrame, group: str, score: str, ties: list[str], n: int, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """The first ``n`` rows of each group by score ascending, then by ``ties`` ascending, with ``rank``.

    Rows with a null group or a null or NaN score are left out; null tie keys come first; rows equal in all
    of these are ranked in any order among themselves; a column ``rank`` of the items is replaced. A group with fewer than n rows gives all of them.
    """
    kept = items.where(F.col(group).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)).withColumn("_top_bin", score_bin(F.col(score), lo, hi))
    counts = kept.groupBy(F.col(group).alias("_top_group"), "_top_bin").agg(F.count(F.lit(1)).alias("k"))
    upto = Window.partitionBy("_top_group").orderBy("_top_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = counts.withColumn("upto", F.sum("k").over(upto)).groupBy("_top_group").agg(F.sum("k").alias("all"), F.min(F.when(F.col("upto") >= n, F.col("_top_bin"))).alias("_top_cut"))
    cuts = sized.where((F.col("all") > SMALL_GROUP) & F.col("_top_cut").isNotNull()).select("_top_group", "_top_cut")
    near = kept.join(cuts, kept[group] == cuts["_top_group"], "left").where(F.col("_top_cut").isNull() | (F.col("_top_bin") <= F.col("_top_cut")))
    order = Window.partitionBy(group).orderBy(score, *ties)
    ranked = near.drop("_top_group", "_top_cut", "_top_bin").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n)


def hardest_images(pool: DataFrame, n: int = 3) -> DataFrame:
    """case_id, round, slice_name, image_min_iou, rank: the ``n`` lowest scores of each case.

    Of rows with the same slice_name and round only the latest by scored_at counts.
    """
    once = latest(pool, ["slice_name", "round"], "scored_at", ["case_id", "image_min_iou"])
    flat = once.select(F.col("_r.case_id").alias("case_id"), "round", "slice_name", F.col("_r.image_min_iou").alias("image_min_iou"))
    return top_n(flat, "case_id", "image_min_iou", ["slice_name", "round"], n)
