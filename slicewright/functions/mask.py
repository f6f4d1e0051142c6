"""Functions on single masks. Dense masks are row-major arrays with a width; run lengths are column-major and start with zeros."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rle_area(counts: Column) -> Column:
    """Foreground pixels: the runs at odd places."""
    return F.aggregate(F.filter(counts, lambda v, i: i % 2 == 1), F.lit(0).cast("bigint"), lambda s, v: s + F.coalesce(v, F.lit(0)))


def threshold(values: Column, at: float = 0.0) -> Column:
    """A dense mask of 0 and 1: where the value is above ``at``."""
    return F.transform(values, lambda v: F.when(v > at, 1).otherwise(0))


#: Data sets whose masks are grey and split at 128; all others are foreground above 0.
GREY_MASKS = ("tn3k", "tg3k", "kvasirseg")


def binarize(values: Column, dataset: Column) -> Column:
    """A mask of 0 and 1 by the rule of its data set: from 128 on for grey masks, else above 0."""
    grey = F.lower(F.translate(F.trim(dataset), "- ", "__")).isin(*GREY_MASKS)
    return F.transform(values, lambda v: F.when(v >= F.when(grey, 128).otherwise(1), 1).otherwise(0))


def mask_audit(values: Column, head: int = 12) -> Column:
    """What a raw mask holds: pixels above 0, from 128 on, equal to 255; how many different values, the least and the greatest of them."""
    zero = F.lit(0).cast("bigint")
    n = lambda test: F.aggregate(values, zero, lambda s, v: s + F.when(test(v), 1).otherwise(0))
    distinct = F.array_sort(F.array_distinct(values))
    tail = F.slice(distinct, F.greatest(F.lit(1), F.size(distinct) - head + 1), F.lit(head))
    return F.struct(
        n(lambda v: v > 0).alias("above_0"), n(lambda v: v >= 128).alias("from_128"), n(lambda v: v == 255).alias("equal_255"),
        F.size(distinct).alias("n_values"), F.slice(distinct, 1, head).alias("head"), tail.alias("tail"),
    )


def dense_area(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda s, v: s + F.when(v > 0, 1).otherwise(0))


def overlap(a: Column, b: Column) -> Column:
    """(inter, total_a, total_b) of two dense masks of one size, without a shuffle."""
    zero = F.lit(0).cast("bigint")
    pairs = F.zip_with(a, b, lambda x, y: F.struct((x > 0).alias("x"), (y > 0).alias("y")))
    return F.struct(
        F.aggregate(pairs, zero, lambda s, p: s + F.when(p["x"] & p["y"], 1).otherwise(0)).alias("inter"),
        F.aggregate(pairs, zero, lambda s, p: s + F.when(p["x"], 1).otherwise(0)).alias("a"),
        F.aggregate(pairs, zero, lambda s, p: s + F.when(p["y"], 1).otherwise(0)).alias("b"),
    )


def iou_of(o: Column) -> Column:
    """Intersection over union; NaN if both masks are empty."""
    union = o["a"] + o["b"] - o["inter"]
    return F.when(union == 0, F.lit(float("nan"))).otherwise(F.try_divide(o["inter"], union))


def dice_of(o: Column) -> Column:
    """Twice the intersection over both areas; NaN if both masks are empty."""
    both = o["a"] + o["b"]
    return F.when(both == 0, F.lit(float("nan"))).otherwise(F.try_divide(2 * o["inter"], both))


def smooth_dice_of(o: Column) -> Column:
    return (2.0 * o["inter"] + 1.0) / (o["a"] + o["b"] + 1.0)


def soft_dice_loss(p: Column, target: Column) -> Column:
    """1 - Dice of probabilities against a mask, smoothed by 1e-6."""
    zero = F.lit(0.0)
    inter = F.aggregate(F.zip_with(p, target, lambda x, y: x.cast("double") * y), zero, lambda s, v: s + v)
    both = F.aggregate(p, zero, lambda s, v: s + v.cast("double")) + F.aggregate(target, zero, lambda s, v: s + v.cast("double"))
    return 1.0 - (2.0 * inter + 1e-6) / (both + 1e-6)


def stability(values: Column, at: float = 0.0, delta: float = 0.1) -> Column:
    """Pixels above the raised threshold over those above the lowered one; NaN if there are none."""
    zero = F.lit(0).cast("bigint")
    high = F.aggregate(values, zero, lambda s, v: s + F.when(v > at + delta, 1).otherwise(0))
    low = F.aggregate(values, zero, lambda s, v: s + F.when(v > at - delta, 1).otherwise(0))
    return F.when(low == 0, F.lit(float("nan"))).otherwise(F.try_divide(high, low))


def dense_bbox(values: Column, width: int) -> Column:
    """The tight inclusive box of a dense mask, null if it is empty."""
    at = F.filter(F.transform(values, lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull())
    xs = F.transform(at, lambda i: i % width)
    ys = F.transform(at, lambda i: F.floor(i / width).cast("int"))
    return F.when(F.size(at) > 0, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def rot90(values: Column, h: int, w: int) -> Column:
    """A dense mask turned a quarter against the clock: w rows of h."""
    return F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: F.get(values, ((i % h) * w + (w - 1 - F.floor(i / h))).cast("int")))


def resize_nearest(values: Column, h: int, w: int, new_h: int, new_w: int) -> Column:
    """Nearest neighbour by floor(target * source / size), in integers."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(new_h * new_w - 1)),
        lambda i: F.get(values, (F.floor(F.floor(i / new_w) * h / new_h) * w + F.floor((i % new_w) * w / new_w)).cast("int")),
    )


def box_mask(box: Column, h: int, w: int, half_open: bool = False) -> Column:
    """A dense mask of a box: from the floor of the near corner to the ceiling of the far one, inclusive unless ``half_open``."""
    x1, y1 = F.floor(F.get(box, F.lit(0))), F.floor(F.get(box, F.lit(1)))
    x2, y2 = F.ceil(F.get(box, F.lit(2))), F.ceil(F.get(box, F.lit(3)))
    far = 1 if half_open else 0

    def inside(i: Column) -> Column:
        x, y = i % w, F.floor(i / w)
        return (x >= x1) & (x <= x2 - far) & (y >= y1) & (y <= y2 - far)

    return F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: F.when(inside(i), 1).otherwise(0))
