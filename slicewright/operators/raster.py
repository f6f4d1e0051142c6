"""Masks in their three forms and the operators between them.

* run lengths (``mask_hw``, ``counts``): column-major, the first run zeros; for storage;
* dense (row-major array with height and width): for arithmetic within a row;
* long (key, y, x, value): for joins by pixel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewright.session import share_package


def encode_runs(m: np.ndarray) -> np.ndarray:
    """Run lengths of a 2-dimensional mask."""
    flat = np.concatenate([[False], m.ravel(order="F")])
    flips = np.flatnonzero(flat[1:] != flat[:-1])
    return np.diff(np.concatenate([[0], flips, [m.size]]))


def decode_runs(counts: np.ndarray, h: int, w: int) -> np.ndarray:
    """The mask of run lengths; pixels that the runs leave out are zero, runs beyond the image are cut."""
    values = np.repeat(np.arange(len(counts)) % 2 == 1, counts)[: h * w]
    if len(values) < h * w:
        values = np.concatenate([values, np.zeros(h * w - len(values), bool)])
    return values.reshape((w, h)).T


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0), kind))


def to_rle(df: DataFrame, key: str, values: str, h: int, w: int, threshold: float = 0.0) -> DataFrame:
    """key, mask_hw, counts of dense rows: what is above the threshold is foreground."""
    share_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [encode_runs(np.asarray(v.as_py(), float).reshape(h, w) > threshold) for v in b.column(1)]
            hw = [np.array([h, w])] * len(counts)
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(hw, pa.int32()), _lists(counts, pa.int32())], names=[key, "mask_hw", "counts"])

    return df.select(key, values).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, mask_hw array<int>, counts array<int>")


def to_dense(df: DataFrame, key: str, hw: str = "mask_hw", counts: str = "counts") -> DataFrame:
    """key, h, w, values (0 and 1, row-major) of run lengths."""
    share_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a mask at a time: dense masks are large
                h, w = b.column(1)[i].as_py()
                m = decode_runs(np.asarray(b.column(2)[i].as_py(), np.int64), h, w)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([h], pa.int32()), pa.array([w], pa.int32()), _lists([m.astype(np.int8).ravel()], pa.int8())], names=[key, "h", "w", "values"])

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(hw).isNotNull() & F.col(counts).isNotNull()).select(key, hw, counts).mapInArrow(run, f"{key} {kind}, h int, w int, values array<tinyint>")


def resample(
    df: DataFrame, key: str, new_h: Column, new_w: Column, canvas_h: Column, canvas_w: Column,
    offset_y: Column | None = None, offset_x: Column | None = None, crop: tuple[Column, Column, Column, Column] | None = None, hw: str = "mask_hw", counts: str = "counts",
) -> DataFrame:
    """key, mask_hw, counts of run-length masks cropped (y, x, h, w), resized by nearest neighbour, and laid on a canvas at an offset.

    Nearest is the floor of target x source / size, in integers. What lies beyond the canvas is cut off. From
    native to a canvas: resize and lay; back: crop and resize to the native size.
    """
    share_package(df.sparkSession)
    zero = F.lit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, sizes = [], []
            for hw_, runs, nh, nw, ch, cw, oy, ox, *part in zip(*(b.column(i).to_pylist() for i in range(1, b.num_columns))):
                m = decode_runs(np.asarray(runs, np.int64), *hw_)
                if part:
                    m = m[part[0] : part[0] + part[2], part[1] : part[1] + part[3]]
                h, w = m.shape
                y, x = np.arange(nh) * h // nh, np.arange(nw) * w // nw
                canvas = np.zeros((ch, cw), bool)
                y0, x0, y1, x1 = max(0, oy), max(0, ox), min(ch, oy + nh), min(cw, ox + nw)
                if h and w and y1 > y0 and x1 > x0:
                    canvas[y0:y1, x0:x1] = m[np.ix_(y, x)][y0 - oy : y1 - oy, x0 - ox : x1 - ox]
                out.append(encode_runs(canvas))
                sizes.append(np.array([ch, cw]))
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(sizes, pa.int32()), _lists(out, pa.int32())], names=[key, "mask_hw", "counts"])

    kind = df.schema[key].dataType.simpleString()
    good = df.where(F.col(hw).isNotNull() & F.col(counts).isNotNull())
    numbers = [new_h, new_w, canvas_h, canvas_w, zero if offset_y is None else offset_y, zero if offset_x is None else offset_x, *(crop or ())]
    picked = good.select(key, F.col(hw).alias("_hw"), F.col(counts).alias("_c"), *(n.cast("int").alias(f"_n{i}") for i, n in enumerate(numbers))).dropna()
    return picked.mapInArrow(run, f"{key} {kind}, mask_hw array<int>, counts array<int>")


def uncrop_masks(df: DataFrame, key: str, crop: Column, image_h: Column, image_w: Column, hw: str = "mask_hw", counts: str = "counts") -> DataFrame:
    """key, mask_hw, counts of the masks of crops (x1, y1, x2, y2; half-open) in their whole images, zero around them."""
    at = lambda i: F.get(crop, F.lit(i)).cast("int")
    return resample(df, key, at(3) - at(1), at(2) - at(0), image_h, image_w, at(1), at(0), hw=hw, counts=counts)


def long_pixels(df: DataFrame, keep: list[str], values: str, w: int) -> DataFrame:
    """keep, y, x, value of dense rows."""
    return df.select(*keep, F.posexplode(values).alias("pos", "value")).select(*keep, F.floor(F.col("pos") / w).cast("int").alias("y"), (F.col("pos") % w).alias("x"), "value")


def rle_box(counts: str, hw: str) -> Column:
    """The tight inclusive box (x1, y1, x2, y2) of run lengths, null if there is no foreground: one pass over the runs."""
    return F.expr(
        f"""aggregate({counts}, named_struct('p', 0L, 'i', 0, 'x1', 2147483647L, 'y1', 2147483647L, 'x2', -1L, 'y2', -1L),
          (s, c) -> if(s.i % 2 = 1 and c > 0,
            named_struct('p', s.p + c, 'i', s.i + 1,
              'x1', least(s.x1, s.p div {hw}[0]),
              'y1', if(s.p div {hw}[0] < (s.p + c - 1) div {hw}[0], 0L, least(s.y1, s.p % {hw}[0])),
              'x2', greatest(s.x2, (s.p + c - 1) div {hw}[0]),
              'y2', if(s.p div {hw}[0] < (s.p + c - 1) div {hw}[0], {hw}[0] - 1L, greatest(s.y2, (s.p + c - 1) % {hw}[0]))),
            named_struct('p', s.p + coalesce(c, 0), 'i', s.i + 1, 'x1', s.x1, 'y1', s.y1, 'x2', s.x2, 'y2', s.y2)),
          s -> if(s.x2 < 0, null, array(s.x1, s.y1, s.x2, s.y2)))"""
    )


def pixel_box_cover(boxes: DataFrame, key: str, box: str, label: str, h: int, w: int) -> DataFrame:
    """key, label, y, x of the pixels in any box of a label: pixels are made from the boxes, so the join by pixel is an equi-join."""
    b = F.col(box)
    xs = F.sequence(F.greatest(F.lit(0), F.floor(b[0]).cast("int")), F.least(F.lit(w - 1), F.ceil(b[2]).cast("int")))
    ys = F.sequence(F.greatest(F.lit(0), F.floor(b[1]).cast("int")), F.least(F.lit(h - 1), F.ceil(b[3]).cast("int")))
    good = boxes.where((b[0] <= b[2]) & (b[1] <= b[3]) & (b[2] >= 0) & (b[3] >= 0) & (b[0] <= w - 1) & (b[1] <= h - 1))
    return good.select(key, label, F.explode(ys).alias("y"), xs.alias("xs")).select(key, label, "y", F.explode("xs").alias("x")).distinct()


def percentile_bounds(df: DataFrame, key: list[str], value: str, low: float, high: float) -> DataFrame:
    """key, lo, hi: percentiles with linear interpolation of the positive values of each key."""
    return df.where(F.col(value) > 0).groupBy(*key).agg(F.percentile(value, F.lit(low / 100.0)).alias("lo"), F.percentile(value, F.lit(high / 100.0)).alias("hi"))


def percentile_scale(df: DataFrame, key: list[str], value: str, low: float, high: float, name: str = "scaled") -> DataFrame:
    """``df`` with the value clipped to its key's percentiles over positive values and scaled to [0, 1]; what isn't positive is 0, as is a key without range."""
    j = df.join(percentile_bounds(df, key, value, low, high), key, "left")
    v = F.greatest(F.col("lo"), F.least(F.col("hi"), F.col(value)))
    scaled = F.when(F.col(value) > 0, F.coalesce(F.try_divide(v - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))).otherwise(F.lit(0.0))
    return j.withColumn(name, scaled).drop("lo", "hi")


def window_min_max(df: DataFrame, key: list[str], value: str, low: float, high: float, name: str = "scaled") -> DataFrame:
    """``df`` with the value clipped to an intensity window, then scaled to 0 to 255 by the least and greatest that occur in its key."""
    clipped = df.withColumn("_v", F.greatest(F.lit(low), F.least(F.lit(high), F.col(value))))
    return clipped.withColumn(name, min_max("_v", key) * 255.0).drop("_v")


def min_max(value: str, key: list[str]) -> Column:
    """The value scaled to [0, 1] within its key; 0 where all are equal."""
    w = Window.partitionBy(*key)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.coalesce(F.try_divide(F.col(value) - lo, hi - lo), F.lit(0.0))


def point_grid(spark, n: int) -> DataFrame:
    """k, x, y of n x n points in the middle of equal cells of the unit square."""
    return spark.range(n * n).select(F.col("id").cast("int").alias("k"), ((F.col("id") % n + 0.5) / n).alias("x"), ((F.floor(F.col("id") / n) + 0.5) / n).alias("y"))


def layered_point_grids(spark, n: int, layers: int, shrink: int) -> DataFrame:
    """layer, k, x, y: a grid of n / shrink^layer points a side for each layer."""
    out = None
    for i in range(layers + 1):
        one = point_grid(spark, max(1, n // shrink**i)).withColumn("layer", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def crop_boxes(images: DataFrame, key: str, h: str, w: str, layers: int, overlap: float) -> DataFrame:
    """key, layer, x1, y1, x2, y2: overlapping crops, 2^layer a side; layer 0 is the whole image."""
    side = F.pow(F.lit(2), F.col("layer")).cast("int")
    base = images.select(key, F.col(h).alias("_h"), F.col(w).alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(layers))).alias("layer")).withColumn("_n", side)
    lap = F.when(F.col("layer") == 0, 0).otherwise(F.floor(F.lit(overlap) * F.least("_h", "_w") * 2 / F.col("_n")).cast("int"))
    base = base.withColumn("_lap", lap)
    cw = F.ceil((F.col("_lap") * (F.col("_n") - 1) + F.col("_w")) / F.col("_n")).cast("int")
    ch = F.ceil((F.col("_lap") * (F.col("_n") - 1) + F.col("_h")) / F.col("_n")).cast("int")
    grid = base.withColumn("_cw", cw).withColumn("_ch", ch).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") * F.col("_n") - 1)))
    x1 = ((F.col("_cw") - F.col("_lap")) * (F.col("_k") % F.col("_n"))).cast("int")
    y1 = ((F.col("_ch") - F.col("_lap")) * F.floor(F.col("_k") / F.col("_n"))).cast("int")
    return grid.select(key, "layer", x1.alias("x1"), y1.alias("y1"), F.least(x1 + F.col("_cw"), F.col("_w")).alias("x2"), F.least(y1 + F.col("_ch"), F.col("_h")).alias("y2"))


def tiles(images: DataFrame, key: str, h: str, w: str, size: int = 1024) -> DataFrame:
    """key, row, col, y1, x1 of the tiles of an image padded to whole tiles."""
    rows, cols = (F.ceil(F.col(c) / size).cast("int") for c in (h, w))
    t = images.select(key, rows.alias("_r"), cols.alias("_c")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_r") * F.col("_c") - 1)))
    row, col = F.floor(F.col("_k") / F.col("_c")).cast("int"), F.col("_k") % F.col("_c")
    return t.select(key, row.alias("row"), col.alias("col"), (row * size).alias("y1"), (col * size).alias("x1"))


def batches(df: DataFrame, order: list[str], size: int, by: list[str]) -> DataFrame:
    """``df`` with ``batch``: consecutive rows of each group in groups of ``size``."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("batch", F.floor(place / size).cast("int"))


#: The weights of the eight corners of a 2 x 2 x 2 neighbourhood, (dz, dy, dx) in natural order.
CORNER_WEIGHTS = {(0, 0, 0): 128, (0, 0, 1): 64, (0, 1, 0): 32, (0, 1, 1): 16, (1, 0, 0): 8, (1, 0, 1): 4, (1, 1, 0): 2, (1, 1, 1): 1}


def neighbour_codes(voxels: DataFrame, key: str) -> DataFrame:
    """key, z, y, x, code of every 2 x 2 x 2 cell that holds a voxel; 255 is inside, all others are surface.

    ``voxels``: key, z, y, x of the foreground. Each voxel adds its weight to the eight cells it is a corner of.
    """
    parts = F.array(*(F.struct(F.lit(-dz).alias("dz"), F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx"), F.lit(k).alias("k")) for (dz, dy, dx), k in CORNER_WEIGHTS.items()))
    spread = voxels.select(key, "z", "y", "x", F.explode(parts).alias("p"))
    cell = spread.select(key, (F.col("z") + F.col("p.dz")).alias("z"), (F.col("y") + F.col("p.dy")).alias("y"), (F.col("x") + F.col("p.dx")).alias("x"), F.col("p.k").alias("k"))
    return cell.groupBy(key, "z", "y", "x").agg(F.sum("k").cast("int").alias("code"))
