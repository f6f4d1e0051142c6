"""Volumes as series of run-length slices: components in three dimensions, and propagation of a result from slice to slice.

A slice is a row; no volume is gathered. Components of slices are found within each row, and which of them touch from
slice to slice within rows that hold two neighbouring slices; what is joined then are components, not pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewright.operators.components import join_segments, mask_components, segments
from slicewright.operators.graph import connected
from slicewright.operators.raster import _lists, decode_runs, encode_runs
from slicewright.session import materialize, share_package


def _numbered(counts: np.ndarray, h: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Column, top, low and component number (in raster order, from 1) of the runs of a mask."""
    who, col, top, low = segments(counts, np.array([len(counts)]), np.array([h]), np.array([w]))
    label = join_segments(who, col, top, low, 8)
    roots, k = np.unique(label, return_inverse=True)
    first = np.full(len(roots), np.iinfo(np.int64).max)
    np.minimum.at(first, k, top * np.int64(w) + col)
    number = np.empty(len(roots), np.int64)
    number[np.argsort(first)] = np.arange(1, len(roots) + 1)
    return col, top, low, number[k]


def touching(a: tuple, b: tuple) -> np.ndarray:
    """Pairs of component numbers of two slices with voxels that are neighbours by side, edge or corner, distinct."""
    found = [np.zeros((0, 2), np.int64)]
    col_b, top_b, low_b, num_b = b
    span = int(max(a[2].max(initial=0), low_b.max(initial=0))) + 3
    base = col_b * span  # runs are sorted by column, then row
    for step in (-1, 0, 1):
        near = (a[0] + step) * span
        lo = np.searchsorted(base + low_b, near + np.maximum(a[1] - 1, 0))
        hi = np.searchsorted(base + top_b, near + np.minimum(a[2] + 1, span - 1), "right")
        lo, hi = np.where(a[0] + step >= 0, lo, 0), np.where(a[0] + step >= 0, hi, 0)
        k = np.maximum(hi - lo, 0)
        i = np.repeat(np.arange(len(k)), k)
        j = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + lo[i]
        found.append(np.stack([a[3][i], num_b[j]], 1))
    return np.unique(np.concatenate(found), axis=0)


def volume_components(slices: DataFrame, volume: str, z: str, hw: str = "mask_hw", counts: str = "counts", min_voxels: int = 0, min_pixels: int = 0) -> tuple[DataFrame, DataFrame]:
    """(components, parts) of volumes with 26 neighbours.

    ``slices``: volume, z (unique in a volume) and a run-length mask; rows with a null are left out. components:
    volume, instance (from 1, in the order of z and then of the raster), n_voxels, n_slices, z1, z2, x1, y1, x2, y2. parts:
    volume, z, component (of the slice, in raster order), instance, area. Components under ``min_voxels`` go whole; of the others then parts of a slice
    under ``min_pixels``; measures are of what stays.
    """
    spark = slices.sparkSession
    share_package(spark)
    good = slices.where(F.col(volume).isNotNull() & F.col(z).isNotNull() & F.col(hw).isNotNull() & F.col(counts).isNotNull()).select(F.col(volume).cast("string").alias("_v"), F.col(z).cast("int").alias("_z"), F.col(hw).alias("_hw"), F.col(counts).alias("_c"))
    good = materialize(good.withColumn("_k", F.concat(F.lpad((F.col("_z") + (1 << 30)).cast("string"), 10, "0"), F.lit("/"), "_v")), "slices")
    comp = materialize(mask_components(good, "_k", "_hw", "_c", 8), "components")
    node = lambda k, c: F.concat(F.substring_index(k, "/", 1), F.lit("."), F.lpad(F.col(c).cast("string"), 8, "0"), F.lit("/"), F.expr(f"substring({k}, instr({k}, '/') + 1)"))
    above = good.select("_v", (F.col("_z") - 1).alias("_z"), F.col("_hw").alias("_hw2"), F.col("_c").alias("_c2"), F.col("_k").alias("_k2"))
    pairs = good.join(above, ["_v", "_z"]).select("_k", "_k2", "_hw", "_c", "_hw2", "_c2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, a, c = [], [], []
            masks = ((np.asarray(x, np.int64), *s) for x, s in zip(b.column(3).to_pylist(), b.column(2).to_pylist()))
            others = ((np.asarray(x, np.int64), *s) for x, s in zip(b.column(5).to_pylist(), b.column(4).to_pylist()))
            for i, (one, two) in enumerate(zip(masks, others)):
                met = touching(_numbered(*one), _numbered(*two))
                rows += [i] * len(met)
                a += met[:, 0].tolist()
                c += met[:, 1].tolist()
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(a, pa.int32()), pa.array(c, pa.int32())], names=["k", "k2", "c", "c2"])

    met = pairs.mapInArrow(run, "k string, k2 string, c int, c2 int")
    groups = connected(met.select(node("k", "c").alias("a"), node("k2", "c2").alias("b")))
    parts = comp.withColumn("node", node("_k", "component")).join(groups.withColumnRenamed("component", "top"), "node", "left").withColumn("top", F.coalesce("top", "node"))
    parts = parts.select(F.expr("substring(_k, instr(_k, '/') + 1)").alias(volume), (F.substring_index("_k", "/", 1).cast("bigint") - (1 << 30)).cast("int").alias(z), "component", "top", "area", "x1", "y1", "x2", "y2")
    parts = materialize(parts, "parts")
    whole = parts.groupBy(volume, "top").agg(F.sum("area").alias("n_voxels")).where(F.col("n_voxels") >= min_voxels).select(volume, "top")
    parts = parts.join(whole, [volume, "top"], "left_semi").where(F.col("area") >= min_pixels)
    found = parts.groupBy(volume, "top").agg(F.sum("area").alias("n_voxels"), F.count_distinct(z).alias("n_slices"), F.min(z).alias("z1"), F.max(z).alias("z2"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    # names sort by slice, then place in it; a volume has few instances
    found = materialize(found.withColumn("instance", F.row_number().over(Window.partitionBy(volume).orderBy("top"))), "instances")
    told = parts.join(found.select(volume, "top", "instance"), [volume, "top"]).select(volume, z, "component", "instance", "area")
    return found.select(volume, "instance", "n_voxels", "n_slices", "z1", "z2", "x1", "y1", "x2", "y2"), told


def without_labels(pixels: DataFrame, label: str, removed: list[int]) -> DataFrame:
    """``pixels`` with the labels in ``removed`` set to 0."""
    return pixels.withColumn(label, F.when(F.col(label).isin(removed), 0).otherwise(F.col(label))) if removed else pixels


def nonempty_slices(slices: DataFrame, foreground: Column) -> DataFrame:
    """The slices with foreground; a null condition counts as none."""
    return slices.where(F.coalesce(foreground, F.lit(False)))


Predictor = Callable[[np.ndarray, tuple[float, float, float, float]], np.ndarray]


def inside_box(mask: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """A stand-in for a predictor: what a given mask holds within the box (whole pixels touched)."""
    out = np.zeros_like(mask)
    x1, y1, x2, y2 = box
    rows, cols = slice(max(0, int(np.floor(y1))), max(0, int(np.ceil(y2)) + 1)), slice(max(0, int(np.floor(x1))), max(0, int(np.ceil(x2)) + 1))
    out[rows, cols] = mask[rows, cols]
    return out


def propagate(slices: DataFrame, series: str, z: str, box: str, predict: Predictor = inside_box, slack: int = 0, hw: str = "mask_hw", counts: str = "counts") -> DataFrame:
    """series, z, used (own, before, beside or last), box, mask_hw, counts: a result carried from one slice of a series both ways.

    ``slices``: series, z, box (null where there is none) and what the predictor works on, a run-length mask. The slice
    with the largest box (the lowest z of equals) is predicted first, then those above and below it up to the last prompted
    ones: with its own box, else the tight box of the result before, widened by ``slack`` within the image; else, if that is empty, with
    the box of a prompted slice right beside it (the lower of two), else with the box used last.
    A result depends on the one before, so a direction of a series is one sorted stream; it is read batch by batch and only the last
    result is kept. Series without a box, and rows with a null, are left out.
    """
    spark = slices.sparkSession
    share_package(spark)
    kind = slices.schema[series].dataType.simpleString()
    good = slices.where(F.col(series).isNotNull() & F.col(z).isNotNull() & F.col(hw).isNotNull() & F.col(counts).isNotNull()).select(F.col(series).alias("s"), F.col(z).cast("int").alias("z"), F.col(box).cast("array<double>").alias("b"), F.col(hw).alias("hw"), F.col(counts).alias("c"))
    boxed = good.where("b is not null")
    area = (F.col("b")[2] - F.col("b")[0]) * (F.col("b")[3] - F.col("b")[1])
    ends = boxed.groupBy("s").agg(F.min("z").alias("z1"), F.max("z").alias("z2"), F.max(F.struct(area, -F.col("z"))).alias("m"))
    ends = ends.select("s", "z1", "z2", (-F.col("m")["col2"]).alias("start"))
    rows = good.join(ends, "s").where("z between z1 and z2")
    order = Window.partitionBy("s").orderBy("z")
    beside = lambda c, d: F.when(c("z").over(order) == F.col("z") + d, c("b").over(order))
    rows = rows.withColumn("beside", F.coalesce(beside(F.lag, -1), beside(F.lead, 1)))
    ways = F.when(F.col("z") == F.col("start"), F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.signum(F.col("z") - F.col("start")).cast("int")))
    steps = rows.select("s", F.explode(ways).alias("way"), "z", F.abs(F.col("z") - F.col("start")).alias("step"), "b", "beside", "hw", "c")
    stream = steps.repartition("s", "way").sortWithinPartitions("s", "way", "step")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, place = None, None, None
        for batch in batches:
            names, zs, used, boxes, sizes, results = [], [], [], [], [], []
            for s, way, at_z, step, own, close, (h, w), runs in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if (s, way) != now:
                    now, last = (s, way), None
                if own is not None:
                    how, place = "own", own
                elif last is not None and last.any():
                    ys, xs = np.nonzero(last)
                    how, place = "before", [float(v) for v in (max(0, xs.min() - slack), max(0, ys.min() - slack), min(w - 1, xs.max() + slack), min(h - 1, ys.max() + slack))]
                elif close is not None:
                    how, place = "beside", close
                else:
                    how = "last"
                last = predict(decode_runs(np.asarray(runs, np.int64), h, w), tuple(place))
                if step == 0 and way < 0:
                    continue  # the first slice begins both ways and is given once
                names.append(s)
                zs.append(at_z)
                used.append(how)
                boxes.append(place)
                sizes.append(np.array([h, w]))
                results.append(encode_runs(last))
            columns = [pa.array(names, batch.schema.field(0).type), pa.array(zs, pa.int32()), pa.array(used, pa.string()), pa.array(boxes, pa.list_(pa.float64())), _lists(sizes, pa.int32()), _lists(results, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[series, z, "used", "box", "mask_hw", "counts"])

    return stream.mapInArrow(run, f"{series} {kind}, {z} int, used string, box array<double>, mask_hw array<int>, counts array<int>")
