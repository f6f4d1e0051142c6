"""Boxes, points and canvas geometry. Boxes are (x1, y1, x2, y2) arrays with inclusive corners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(box: Column, i: int) -> Column:
    return F.get(box, F.lit(i)).cast("double")


def _within(v: Column, top: Column) -> Column:
    # greatest and least pass over nulls: a null stays one only if asked for
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(top - 1.0, v)))


def make_box(x1, y1, x2, y2) -> Column:
    """A box, or null if a corner is null."""
    return F.when(x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull(), F.array(x1, y1, x2, y2))


def clip_box(box: Column, w: Column, h: Column) -> Column:
    """Clipped into the image; a side without extent becomes one pixel long, as far as the image goes."""
    w, h = w.cast("double"), h.cast("double")
    x1, y1, x2, y2 = _within(_at(box, 0), w), _within(_at(box, 1), h), _within(_at(box, 2), w), _within(_at(box, 3), h)
    return make_box(x1, y1, F.when(x2 <= x1, F.least(w - 1.0, x1 + 1.0)).otherwise(x2), F.when(y2 <= y1, F.least(h - 1.0, y1 + 1.0)).otherwise(y2))


def clip_points(points: Column, w: Column, h: Column) -> Column:
    """An array of (x, y) clipped into the image."""
    return F.transform(points, lambda p: F.array(_within(_at(p, 0), w.cast("double")), _within(_at(p, 1), h.cast("double"))))


def map_box(box: Column, transform: Column, fallback: str | None = None) -> Column:
    """A box moved by a transform struct (scale_x, scale_y, or where they are null the field ``fallback``; offsets), not clipped."""
    sx, sy = (F.coalesce(transform[n], transform[fallback]) if fallback else transform[n] for n in ("scale_x", "scale_y"))
    ox, oy = F.coalesce(transform["offset_x"], F.lit(0)), F.coalesce(transform["offset_y"], F.lit(0))
    return make_box(_at(box, 0) * sx + ox, _at(box, 1) * sy + oy, _at(box, 2) * sx + ox, _at(box, 3) * sy + oy)


def native_to_teacher(box: Column, transform: Column, fallback: str | None = None) -> Column:
    """A native box on the teacher canvas, clipped to it."""
    return clip_box(map_box(box, transform, fallback), transform["target_w"], transform["target_h"])


def geometry_sizes(native_hw: Column, inverse: Column, teacher_hw: Column) -> Column:
    """(orig_h, orig_w, new_h, new_w): the native size, and the size of the image on the teacher canvas: the crop of the way back, else the canvas, else 1024."""
    new = lambda crop, i: F.coalesce(inverse[crop], F.get(teacher_hw, F.lit(i)), F.lit(1024))
    return F.struct(F.get(native_hw, F.lit(0)).alias("orig_h"), F.get(native_hw, F.lit(1)).alias("orig_w"), new("crop_h", 0).alias("new_h"), new("crop_w", 1).alias("new_w"))


def teacher_to_native(box: Column, sizes: Column) -> Column:
    """A teacher box by the ratio of native to resized image alone, whatever the offset, clipped to the native image."""
    h, w = sizes["orig_h"], sizes["orig_w"]
    rx, ry = w / F.greatest(sizes["new_w"], F.lit(1)), h / F.greatest(sizes["new_h"], F.lit(1))
    return clip_box(make_box(_at(box, 0) * rx, _at(box, 1) * ry, _at(box, 2) * rx, _at(box, 3) * ry), w, h)


def canvas_geometry(h: Column, w: Column, target_h: Column, target_w: Column) -> Column:
    """How an image is fitted into a canvas: one scale, sizes rounded half-even (at least 1), top left, padded."""
    scale = F.least(target_h / F.greatest(h, F.lit(1)), target_w / F.greatest(w, F.lit(1)))
    new_h, new_w = F.greatest(F.rint(h * scale).cast("int"), F.lit(1)), F.greatest(F.rint(w * scale).cast("int"), F.lit(1))
    return F.struct(
        h.alias("orig_h"), w.alias("orig_w"), target_h.alias("target_h"), target_w.alias("target_w"),
        new_h.alias("new_h"), new_w.alias("new_w"), F.lit(0).alias("offset_x"), F.lit(0).alias("offset_y"),
        (target_w - new_w).alias("pad_right"), (target_h - new_h).alias("pad_bottom"), scale.alias("scale"), scale.alias("scale_x"), scale.alias("scale_y"), F.lit("top_left").alias("canvas_origin"),
    )


def inverse_geometry(g: Column) -> Column:
    """The way back from a canvas: crop the image out, and scale to its native size."""
    return F.struct(
        g["target_h"].alias("from_h"), g["target_w"].alias("from_w"), g["new_h"].alias("crop_h"), g["new_w"].alias("crop_w"),
        g["offset_x"].alias("offset_x"), g["offset_y"].alias("offset_y"), g["orig_h"].alias("to_h"), g["orig_w"].alias("to_w"),
        (g["orig_w"] / F.greatest(g["new_w"], F.lit(1))).alias("scale_x"), (g["orig_h"] / F.greatest(g["new_h"], F.lit(1))).alias("scale_y"),
    )


PAIR_FIELDS = ("orig_h", "orig_w", "target_h", "target_w", "new_h", "new_w", "scale", "scale_x", "scale_y", "offset_x", "offset_y", "pad_right", "pad_bottom", "canvas_origin")


def geometry_mismatch(a: Column, b: Column, fields: tuple[str, ...] = PAIR_FIELDS) -> Column:
    """The names of the fields in which two geometries of a pair differ."""
    return F.filter(F.array(*(F.when(~a[f].eqNullSafe(b[f]), f) for f in fields)), lambda x: x.isNotNull())


def resolve_spacing(manifest: dict[str, Column], geometry: dict[str, Column] | None = None) -> Column:
    """(value in z, y, x order, source): of the manifest zyx, else xyz reversed, else the legacy field reversed; then the same of the geometry.

    ``manifest`` and ``geometry`` give the columns by spacing_zyx, spacing_xyz and spacing, as far as there are any.
    The first three numbers count; they must be finite and above zero.
    """

    def told(side: str, name: str, c: Column) -> Column:
        first = F.slice(c, 1, 3)
        good = F.when((F.size(c) >= 3) & F.forall(first, lambda v: v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf"))), first)
        value = good if name == "spacing_zyx" else F.reverse(good)
        source = f"{side}.{'spacing_legacy_xyz' if name == 'spacing' else name}"
        return F.when(good.isNotNull(), F.struct(value.alias("zyx"), F.lit(source).alias("source")))

    sides = (("manifest", manifest), ("geometry", geometry or {}))
    return F.coalesce(*(told(side, n, cols[n]) for side, cols in sides for n in ("spacing_zyx", "spacing_xyz", "spacing") if n in cols))


def longest_side_shape(h: Column, w: Column, side: int) -> Column:
    """(new_h, new_w) with the longest side at ``side``, halves up."""
    scale = F.lit(float(side)) / F.greatest(h, w)
    return F.struct(F.floor(h * scale + 0.5).cast("int").alias("new_h"), F.floor(w * scale + 0.5).cast("int").alias("new_w"))


def scale_points(points: Column, h: Column, w: Column, new_h: Column, new_w: Column) -> Column:
    """An array of (x, y) moved to a resized image."""
    return F.transform(points, lambda p: F.array(_at(p, 0) * (new_w / w), _at(p, 1) * (new_h / h)))


def xyxy_to_xywh(box: Column) -> Column:
    return make_box(_at(box, 0), _at(box, 1), _at(box, 2) - _at(box, 0), _at(box, 3) - _at(box, 1))


def uncrop_box(box: Column, crop: Column) -> Column:
    """A box of a crop in the whole image."""
    return make_box(_at(box, 0) + _at(crop, 0), _at(box, 1) + _at(crop, 1), _at(box, 2) + _at(crop, 0), _at(box, 3) + _at(crop, 1))


def uncrop_points(points: Column, crop: Column) -> Column:
    """An array of (x, y) of a crop in the whole image."""
    return F.transform(points, lambda p: F.array(_at(p, 0) + _at(crop, 0), _at(p, 1) + _at(crop, 1)))


def to_side(box: Column, w: Column, h: Column, side: int = 1024) -> Column:
    """A box scaled to a square image."""
    return make_box(_at(box, 0) / w * side, _at(box, 1) / h * side, _at(box, 2) / w * side, _at(box, 3) / h * side)


def slack_box(box: Column, shift: int, w: Column, h: Column) -> Column:
    """A box widened by ``shift`` on each side, its far corner at most at (w, h): for half-open use."""
    return make_box(
        F.greatest(F.lit(0.0), _at(box, 0) - shift), F.greatest(F.lit(0.0), _at(box, 1) - shift),
        F.least(w.cast("double"), _at(box, 2) + shift), F.least(h.cast("double"), _at(box, 3) + shift),
    )


def box_area(box: Column) -> Column:
    """Pixels of an inclusive box; 0 if it is turned inside out."""
    return F.greatest(F.lit(0.0), _at(box, 2) - _at(box, 0) + 1) * F.greatest(F.lit(0.0), _at(box, 3) - _at(box, 1) + 1)


def box_iou_open(a: Column, b: Column) -> Column:
    """Overlap over union of two boxes taken as areas between their corners (half-open); 0 where there is no union."""
    side = lambda p, q, i: F.greatest(F.lit(0.0), F.least(_at(p, i + 2), _at(q, i + 2)) - F.greatest(_at(p, i), _at(q, i)))
    inter = side(a, b, 0) * side(a, b, 1)
    area = lambda p: (_at(p, 2) - _at(p, 0)) * (_at(p, 3) - _at(p, 1))
    return F.coalesce(F.try_divide(inter, area(a) + area(b) - inter), F.lit(0.0))


def box_iou(a: Column, b: Column) -> Column:
    """Overlap of two inclusive boxes over their union; 0 where there is no union."""
    iw = F.greatest(F.lit(0.0), F.least(_at(a, 2), _at(b, 2)) - F.greatest(_at(a, 0), _at(b, 0)) + 1)
    ih = F.greatest(F.lit(0.0), F.least(_at(a, 3), _at(b, 3)) - F.greatest(_at(a, 1), _at(b, 1)) + 1)
    return F.coalesce(F.try_divide(iw * ih, box_area(a) + box_area(b) - iw * ih), F.lit(0.0))


def near_crop_edge(box: Column, crop: Column, h: Column, w: Column, tolerance: float = 20.0) -> Column:
    """Whether a side of the box is near the crop's edge but not near the image's."""
    whole = (F.lit(0.0), F.lit(0.0), w.cast("double"), h.cast("double"))
    near = [(F.abs(_at(box, i) - _at(crop, i)) <= tolerance) & (F.abs(_at(box, i) - whole[i]) > tolerance) for i in range(4)]
    return near[0] | near[1] | near[2] | near[3]
