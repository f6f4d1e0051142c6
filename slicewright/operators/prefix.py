"""Running sums in hash order without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows in one slot of the hash range at most, on average; and the fewest and most bits of a slot's number.
SLOT_ROWS = 1_000_000
LEAST_BITS, MOST_BITS = 8, 22


def slot_bits(rows: int) -> int:
    """So many leading bits of a hash that the largest of groups, of ``rows`` rows, has about SLOT_ROWS a slot."""
    return max(LEAST_BITS, min(MOST_BITS, (max(0, rows - 1) // SLOT_ROWS).bit_length()))


def hash_running_sum(df: DataFrame, by: list[str], hashed: Column, ties: list[str], value: str, name: str = "running", bits: int = LEAST_BITS) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of its group up to and with this one, in the order of ``hashed`` then ``ties``.

    As hashes are uniform, the range of the hash is cut into 2 ** bits equal slots: totals per (group, slot) are added
    up in a small window (one row a slot), and rows only within their slot. ``hashed`` is a bigint; ``bits`` (see
    ``slot_bits``) changes no result.
    """
    slotted = df.withColumn("_h", hashed).withColumn("_slot", F.shiftright("_h", 64 - bits).cast("int"))
    group = [*by, "_slot"]
    totals = slotted.groupBy(*group).agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*by).orderBy("_slot") if by else Window.partitionBy(F.lit(1)).orderBy("_slot")
    carry = totals.select(*group, F.coalesce(F.sum("_t").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy(*group).orderBy("_h", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = slotted.withColumn("_in", F.sum(value).over(inside)).join(carry, group)
    return out.withColumn(name, F.col("_carry") + F.col("_in")).drop("_slot", "_carry", "_in", "_h")
