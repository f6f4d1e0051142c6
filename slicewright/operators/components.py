"""Connected components of masks, on their runs.

A mask never leaves its row: its run lengths are cut into vertical segments (a column and a range of rows),
segments that touch are joined, and each component is told by its area, box and centroid. That is linear in
the number of runs, whatever the size of the image, and needs no shuffle; Python sees Arrow batches of run
lengths. Everything behind it (filters, ranks, summaries) is relational.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewright.session import share_package

FIELDS = "component int, area bigint, x1 int, y1 int, x2 int, y2 int, cx double, cy double, border_pixels bigint, has_origin boolean, mask_h int, mask_w int"


def segments(counts: np.ndarray, size: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Mask, column, first and last row of the vertical foreground segments of many masks, in this order.

    ``counts``: the run lengths of all masks one after the other, ``size``: how many each has.
    """
    mask = np.repeat(np.arange(len(size)), size)
    run = np.concatenate([[0], np.cumsum(counts)])
    first = np.cumsum(size) - size
    end = run[1:] - run[first][mask]
    total = h.astype(np.int64) * w
    # pixels that the runs leave out are zero, so the end of a last run of zeros is no flip
    place = np.arange(len(end)) - first[mask]
    flips = (place % 2 == 1) | (place < size[mask] - 1)
    mask, end = mask[flips], end[flips]
    # where the value flips: ends inside the image that an odd number of runs share
    new = np.ones(len(end), bool)
    new[1:] = (mask[1:] != mask[:-1]) | (end[1:] != end[:-1])
    at = np.flatnonzero(new)
    odd = np.diff(np.append(at, len(end))) % 2 == 1
    at = at[odd]
    at = at[end[at] < total[mask[at]]]
    who, flip = mask[at], end[at]
    open_end = np.flatnonzero(np.bincount(who, minlength=len(size)) % 2 == 1)  # the last run reaches the end
    who, flip = np.concatenate([who, open_end]), np.concatenate([flip, total[open_end]])
    order = np.lexsort((flip, who))
    who, flip = who[order], flip[order]
    who, start, last = who[0::2], flip[0::2], flip[1::2] - 1
    hh = h[who].astype(np.int64)
    first_col, last_col = start // hh, last // hh
    n = last_col - first_col + 1
    k = np.repeat(np.arange(len(start)), n)
    col = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first_col[k]
    top = np.where(col == first_col[k], start[k] % hh[k], 0)
    low = np.where(col == last_col[k], last[k] % hh[k], hh[k] - 1)
    return who[k], col, top, low


def join_segments(who: np.ndarray, col: np.ndarray, top: np.ndarray, low: np.ndarray, connectivity: int) -> np.ndarray:
    """The least segment number of each segment's component.

    The segments of the column before that touch one are consecutive, so binary searches give all pairs; the least
    numbers then spread along them, doubling their reach in each step.
    """
    n = len(col)
    label = np.arange(n)
    if n == 0:
        return label
    reach = 1 if connectivity == 8 else 0
    span, wide = int(low.max()) + 3, int(col.max()) + 2
    base = (who.astype(np.int64) * wide + col) * span
    before = base - span
    a = np.searchsorted(base + low, before + np.maximum(top - reach, 0))
    b = np.searchsorted(base + top, before + np.minimum(low + reach, span - 1), "right")
    a, b = np.where(col > 0, a, 0), np.where(col > 0, b, 0)
    k = np.maximum(b - a, 0)
    i = np.repeat(np.arange(n), k)
    j = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + a[i]
    while len(i):
        least = np.minimum(label[i], label[j])
        old = label.copy()
        for x in (i, j, old[i], old[j]):  # also the roots they had, so that whole trees are hooked
            np.minimum.at(label, x, least)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        if (label == old).all():
            break
    return label


def batch_components(counts: np.ndarray, size: np.ndarray, h: np.ndarray, w: np.ndarray, connectivity: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(mask of each component, the columns of FIELDS): components in raster order of their first pixel."""
    who, col, top, low = segments(counts, size, h, w)
    label = join_segments(who, col, top, low, connectivity)
    roots, k = np.unique(label, return_inverse=True)
    m = len(roots)
    owner = who[roots]
    hh, ww = h[owner].astype(np.int64), w[owner].astype(np.int64)
    length = low - top + 1
    on_side = (col == 0) | (col == w[who] - 1)
    border = np.where(on_side, length, (top == 0).astype(np.int64) + ((low == h[who] - 1) & ((h[who] > 1) | (top > 0))))

    def least(v: np.ndarray) -> np.ndarray:
        out = np.full(m, np.iinfo(np.int64).max)
        np.minimum.at(out, k, v)
        return out

    total = lambda v: np.bincount(k, v, m)
    area = total(length)
    x1, y1, x2, y2 = least(col), least(top), -least(-col), -least(-low)
    first = least(top * w[who].astype(np.int64) + col)
    order = np.lexsort((first, owner))
    owner = owner[order]
    at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if m else np.zeros(0, np.int64)
    number = np.arange(m) - np.repeat(at, np.diff(np.append(at, m))) + 1
    cx, cy = total(col * length) / np.maximum(area, 1), total((top + low) * length) / 2 / np.maximum(area, 1)
    origin = total(((col == 0) & (top == 0)).astype(float)) > 0
    rest = [area.astype(np.int64), x1, y1, x2, y2, cx, cy, total(border).astype(np.int64), origin, hh, ww]
    return owner, [number, *(v[order] for v in rest)]


def component_rows(counts: np.ndarray, h: int, w: int, connectivity: int) -> list[tuple]:
    """The components of one mask as tuples in the order of FIELDS."""
    _, columns = batch_components(np.asarray(counts), np.array([len(counts)]), np.array([h]), np.array([w]), connectivity)
    return list(zip(*(c.tolist() for c in columns)))


def mask_components(masks: DataFrame, key: str, hw: str = "mask_hw", counts: str = "counts", connectivity: int = 8) -> DataFrame:
    """One row per component: key, component (1.. in raster order), area, box, centroid, pixels on the border, whether it holds pixel (0, 0).

    Masks without foreground, or with null size or counts, have none. Repeated rows repeat.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    share_package(masks.sparkSession)
    names = [key, *(x.split()[0] for x in FIELDS.split(", "))]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, lists = batch.column(1).to_pylist(), batch.column(2)
            good = [i for i, hw in enumerate(sizes) if hw is not None and len(hw) == 2 and None not in hw and lists[i].is_valid]
            picked = lists.take(pa.array(good, pa.int64()))
            flat = picked.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.diff(picked.offsets.to_numpy())
            h, w = (np.array([sizes[i][k] for i in good], np.int64) for k in (0, 1))
            owner, columns = batch_components(flat, size, h, w, connectivity)
            rows = np.asarray(good, np.int64)[owner] if len(owner) else owner
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(v, t) for v, t in zip(columns, types))], names=names)

    kind = masks.schema[key].dataType.simpleString()
    return masks.select(key, F.col(hw).alias("_hw"), F.col(counts).alias("_counts")).mapInArrow(run, f"`{key}` {kind}, {FIELDS}")


def largest(components: DataFrame, key: str) -> DataFrame:
    """The largest component of each mask; of equals the first."""
    order = Window.partitionBy(key).orderBy(F.desc("area"), "component")
    return components.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def top_components(components: DataFrame, key: str, n: int = 8) -> DataFrame:
    """The n largest components by area descending, then top, then left, with their place."""
    order = Window.partitionBy(key).orderBy(F.desc("area"), "y1", "x1", "component")
    return components.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def area_filter(components: DataFrame, min_area: int) -> tuple[DataFrame, DataFrame]:
    """(components of at least min_area, one row with the number and pixels of those dropped)."""
    small = F.col("area") < min_area
    dropped = components.agg(F.count_if(small).alias("removed_components"), F.coalesce(F.sum(F.when(small, F.col("area"))), F.lit(0)).alias("removed_pixels"))
    return components.where(~small), dropped


def tiny_verdicts(components: DataFrame, key: str, min_area: int, max_side: int) -> DataFrame:
    """``components`` with ``tiny``, ``removed`` and ``reason``: tiny ones go where a larger one stays; never all, never the only one.

    A limit of 0 or below is off.
    """
    by_area = (F.lit(min_area) > 0) & (F.col("area") <= min_area)
    by_side = (F.lit(max_side) > 0) & (F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) + 1 <= max_side)
    whole = Window.partitionBy(key)
    df = components.withColumn("tiny", by_area | by_side)
    df = df.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_k", F.count_if(F.col("tiny")).over(whole))
    reason = F.when(F.col("_n") <= 1, "single_component").when(F.col("_k") == 0, "none_tiny").when(F.col("_k") == F.col("_n"), "all_tiny").otherwise("removed")
    return df.withColumn("reason", reason).withColumn("removed", F.col("tiny") & (F.col("reason") == "removed")).drop("_n", "_k")


#: The artefact rules by data set. ``corner``: from pixel (0, 0) to at most ``reach`` and ``max_area``;
#: ``edge``: on the top edge (or, with ``left``, also the left one); ``satellite``: beside a larger component.
ARTEFACT_RULES = {
    "tg3k": {"corner": (15, 128), "edge": {"max_h": 2, "max_area": 4, "left": False}},
    "kvasirseg": {"corner": (7, 16), "edge": {"max_side": 8, "max_area": 8, "left": True}},
    "cvc_clinicdb": {"satellite": (128, 0.01)},
    "ddti": {"satellite": (128, 0.01)},
}


def artefact_reason(rule: dict, largest_area: Column) -> Column:
    """corner, edge or satellite where a component is an artefact by ``rule``, else null."""
    x1, y1, x2, y2, area = (F.col(n) for n in ("x1", "y1", "x2", "y2", "area"))
    h, w = y2 - y1 + 1, x2 - x1 + 1
    out = F.lit(None).cast("string")
    if "satellite" in rule:
        most, ratio = rule["satellite"]
        cap = F.greatest(F.lit(1), F.ceil(largest_area * ratio))
        out = F.when((area < largest_area) & (area <= most) & (area <= cap), "satellite").otherwise(out)
    if "edge" in rule:
        e = rule["edge"]
        at = (y1 == 0) | (x1 == 0) if e["left"] else y1 == 0
        small = (F.greatest(w, h) <= e["max_side"]) if "max_side" in e else (h <= e["max_h"])
        out = F.when(at & small & (area <= e["max_area"]), "edge").otherwise(out)
    if "corner" in rule:
        reach, most = rule["corner"]
        out = F.when((x1 == 0) & (y1 == 0) & (x2 <= reach) & (y2 <= reach) & (area <= most), "corner").otherwise(out)
    return out


def artefacts(components: DataFrame, key: str, rule: dict) -> DataFrame:
    """``components`` with ``artefact``: why a component is one by ``rule``, or null."""
    return components.withColumn("artefact", artefact_reason(rule, F.max("area").over(Window.partitionBy(key))))


def artefacts_by_rule(components: DataFrame, key: str, rules: dict[str, dict] = ARTEFACT_RULES) -> DataFrame:
    """``components`` with ``rule`` and ``artefact``: a row for each rule by which one is an artefact, from one pass over them."""
    sized = components.withColumn("_big", F.max("area").over(Window.partitionBy(key)))
    told = F.array(*(F.struct(F.lit(name).alias("rule"), artefact_reason(rule, F.col("_big")).alias("artefact")) for name, rule in sorted(rules.items())))
    return sized.withColumn("_t", F.explode(told)).drop("_big").select("*", "_t.rule", "_t.artefact").drop("_t").where("artefact is not null")


def summary(components: DataFrame, key: str) -> DataFrame:
    """Per mask with foreground: number, largest and smallest area, border pixels, whether pixel (0, 0) is set."""
    return components.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_components"), F.max("area").alias("largest"), F.min("area").alias("smallest"), F.sum("border_pixels").alias("border_pixels"), F.bool_or("has_origin").alias("has_origin")
    )
