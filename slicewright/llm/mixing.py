"""Mixing sources to target weights.

Weighted fair queueing: the documents of each source are shuffled by a hash and served one after the other,
a source's documents again after all were served, up to its ``max_repeats``; each gets a virtual finish time,
the tokens of its source up to and with it over the target weight. Sorted by finish time over all sources and
cut where the budget of tokens is reached, every prefix has the target shares.

Without a budget the mix ends with the first source that runs out, as the shares can't be kept beyond it; then each
source gives what its share asks for, less one document at most. With a budget beyond that the other sources go on.
Sources of the targets without documents get nothing (and the others keep their proportions); documents of
other sources, of none, or without a token take no part. Targets of one source in several rows are added
up; null or non-positive shares are left out, a null max_repeats counts as 1, one below 1 as none.
Repeated rows are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slicewright.operators.prefix import hash_running_sum, slot_bits
from slicewright.session import materialize

#: Bins of virtual time for finding the place of the cut; their totals are all that is looked at.
BINS = 4_096
#: The bin of the cut is cut into bins again until it has at most so many rows, which are then ordered one by one.
EDGE_ROWS = 1_000_000


def targets_of(targets: DataFrame) -> DataFrame:
    good = targets.where("source is not null and target_share > 0").groupBy("source")
    return good.agg(F.sum("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("repeats"))


def mix(sized: DataFrame, targets: DataFrame, seed: int = 0, budget: int | None = None) -> DataFrame:
    """doc_id, source, copy_no (from 0), n_tokens, finish: the mix in its order.

    ``sized``: doc_id, source, n_tokens; ``targets``: source, target_share, max_repeats.
    """
    goal = targets_of(targets).where("repeats >= 1")
    docs = materialize(sized.where("n_tokens > 0").select("doc_id", "source", "n_tokens").join(goal, "source"), "sized")
    totals = docs.groupBy("source", "share", "repeats").agg(F.sum("n_tokens").alias("total"), F.count(F.lit(1)).alias("rows"))
    ends, most = totals.agg(F.min(F.col("repeats") * F.col("total") / F.col("share")), F.max("rows")).collect()[0]
    shuffled = hash_running_sum(docs, ["source"], F.xxhash64(F.lit(seed), "doc_id"), ["doc_id", "n_tokens"], "n_tokens", "run", slot_bits(most or 0)).join(totals.select("source", "total"), "source")
    copies = shuffled.select("doc_id", "source", "n_tokens", "share", "run", "total", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)).alias("copy_no"))
    served = copies.select("doc_id", "source", "copy_no", "n_tokens", ((F.col("copy_no") * F.col("total") + F.col("run")) / F.col("share")).alias("finish"))
    if ends is None:
        return served.limit(0)
    if budget is None:
        return served.where(F.col("finish") <= F.lit(ends)).orderBy("finish", "source", "copy_no", "doc_id")
    return truncate(served, budget).orderBy("finish", "source", "copy_no", "doc_id")


def truncate(served: DataFrame, budget: int, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """The first rows by (finish, source, copy_no, doc_id) whose tokens together stay within ``budget``.

    Totals of a fixed number of bins of finish time show the bin of the cut, which is cut into bins in turn until few
    rows are left in it; only these are ordered one by one.
    """
    served = materialize(served, "served")
    low, high, rows, total = served.agg(F.min("finish"), F.max("finish"), F.count(F.lit(1)), F.sum("n_tokens")).collect()[0]
    if not rows or total <= budget:
        return served
    spent = 0
    # of the rows in [low, high] the first ones up to the budget are wanted; all before are taken, none behind
    while rows > edge_rows and high > low:
        at = F.least(F.lit(BINS - 1), F.floor((F.col("finish") - low) / (high - low) * BINS)).cast("int")
        inside = served.where((F.col("finish") >= low) & (F.col("finish") <= high)).groupBy(at.alias("bin"))
        bins = inside.agg(F.min("finish").alias("lo"), F.max("finish").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).orderBy("bin").collect()  # BINS rows
        for b in bins:
            if spent + b["t"] > budget:
                break
            spent += b["t"]
        if (b["lo"], b["hi"]) == (low, high):
            break
        low, high, rows = b["lo"], b["hi"], b["n"]
    order = Window.partitionBy(F.lit(1)).orderBy("finish", "source", "copy_no", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = served.where((F.col("finish") >= low) & (F.col("finish") <= high)).withColumn("run", F.sum("n_tokens").over(order)).where(F.col("run") <= budget - spent).drop("run")
    return served.where(F.col("finish") < low).unionByName(edge)


def shares_reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, n_docs, n_rows, n_tokens, share, gap, most_copies: also for sources that gave nothing.

    ``gap`` is the share less what the target asks for, of the sources that gave something.
    """
    got = mixed.groupBy("source").agg(F.count_distinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").alias("n_tokens"), (F.max("copy_no") + 1).alias("most_copies"))
    # one row per target source, and the total over them
    rows = targets_of(targets).select("source", F.col("share").alias("target_share")).join(got, "source", "left")
    rows = rows.na.fill(0, ["n_docs", "n_rows", "n_tokens", "most_copies"])
    every = Window.partitionBy(F.lit(1))
    rows = rows.withColumn("share", F.try_divide(F.col("n_tokens"), F.sum("n_tokens").over(every)))
    asked = F.try_divide(F.col("target_share"), F.sum(F.when(F.col("n_tokens") > 0, F.col("target_share"))).over(every))
    return rows.withColumn("gap", F.when(F.col("n_tokens") > 0, F.col("share") - asked))


def rules_kept(mixed: DataFrame, sized: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """source, has_documents, copies_within_cap, share_within_a_document, total_within_budget of each source with a share.

    Without a budget a source gives what its share asks for at the finish time of the last row, less one document at
    most; with one the same holds as long as no source has run out.
    """
    goal = targets_of(targets)
    docs = sized.where("n_tokens > 0").groupBy("source").agg(F.max("n_tokens").alias("largest"), F.sum("n_tokens").alias("has"))
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.max("copy_no").alias("copy"), F.max("finish").alias("finish"))
    rows = goal.join(docs, "source", "left").join(got, "source", "left")
    every = Window.partitionBy(F.lit(1))  # one row a source
    asked = F.least(F.max("finish").over(every) * F.col("share"), F.col("has") * F.col("repeats"))
    given = F.coalesce("n_tokens", F.lit(0))
    near = (given <= asked + 1e-6) & (given > asked - F.col("largest") - 1e-6)
    total = F.sum(given).over(every)
    return rows.select(
        "source", F.col("has").isNotNull().alias("has_documents"), (F.coalesce("copy", F.lit(-1)) < F.col("repeats")).alias("copies_within_cap"),
        F.coalesce(near, F.lit(True)).alias("share_within_a_document"), (total <= F.lit(budget) if budget is not None else F.lit(True)).alias("total_within_budget"),
    )
