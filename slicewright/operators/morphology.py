"""Mask operators that are iterative per mask: refinement, small regions, surface distances, propagation.

Each function works on Arrow batches with NumPy and needs no shuffle. What asks for components works on the runs
of a stack of masks (``components.join_segments``), in time linear in the runs, and paints the answer back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewright.operators.components import join_segments, segments
from slicewright.session import share_package


def _shifted(m: np.ndarray, dy: int, dx: int, fill: bool) -> np.ndarray:
    out = np.full_like(m, fill)
    h, w = m.shape
    out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = m[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]
    return out


def _swept(stack: np.ndarray, size: int, spread: bool) -> np.ndarray:
    """The union (``spread``) or intersection of a stack of masks moved within a square; beyond the image nothing counts."""
    for axis in (1, 2):
        out = stack.copy()
        for k in range(1, min(size // 2, stack.shape[axis] - 1) + 1):
            low = tuple(slice(None, -k) if i == axis else slice(None) for i in range(3))
            high = tuple(slice(k, None) if i == axis else slice(None) for i in range(3))
            for to, of in ((low, high), (high, low)):
                out[to] = out[to] | stack[of] if spread else out[to] & stack[of]
        stack = out
    return stack


def dilate(m: np.ndarray, size: int) -> np.ndarray:
    """A mask or a stack of masks dilated by a square of odd ``size``."""
    return _swept(m.reshape(-1, *m.shape[-2:]), size, True).reshape(m.shape)


def erode(m: np.ndarray, size: int) -> np.ndarray:
    """A mask or a stack of masks eroded by a square of odd ``size``; the border of the image doesn't erode."""
    return _swept(m.reshape(-1, *m.shape[-2:]), size, False).reshape(m.shape)


def _runs(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of the runs down the columns of a stack of masks, and the place behind each; a column has one place more than rows."""
    n, h, w = stack.shape
    edge = np.zeros((n, w, h + 1), np.int8)
    edge[..., :h] = stack.transpose(0, 2, 1)
    edge[..., 1:] -= edge[..., :h].copy()
    flat = edge.ravel()
    return np.flatnonzero(flat == 1), np.flatnonzero(flat == -1)


def _painted(first: np.ndarray, after: np.ndarray, n: int, h: int, w: int) -> np.ndarray:
    """The stack of masks of such runs."""
    steps = np.zeros(n * w * (h + 1), np.int8)
    steps[first] = 1
    steps[after] -= 1
    return np.cumsum(steps.reshape(n, w, h + 1), axis=-1, dtype=np.int8)[..., :h].astype(bool).transpose(0, 2, 1)


class Regions:
    """The components of a stack of masks: runs down the columns, the component of each, and per component its area and mask."""

    def __init__(self, stack: np.ndarray, connectivity: int):
        self.shape = n, h, w = stack.shape
        self.first, after = _runs(stack)
        self.length = after - self.first
        line, self.top = np.divmod(self.first, h + 1)
        self.who, self.col = np.divmod(line, w)
        self.low = self.top + self.length - 1
        roots, self.of_run = np.unique(join_segments(self.who, self.col, self.top, self.low, connectivity), return_inverse=True)
        self.mask = self.who[roots]
        self.area = np.bincount(self.of_run, self.length, len(roots)).astype(np.int64)

    def touching_border(self) -> np.ndarray:
        """Which components reach the border of the image."""
        _, h, w = self.shape
        rim = (self.col == 0) | (self.col == w - 1) | (self.top == 0) | (self.low == h - 1)
        return np.bincount(self.of_run, rim, len(self.mask)) > 0

    def largest(self) -> np.ndarray:
        """Which components are the largest of their mask; of equals the one that begins first by column."""
        order = np.lexsort((np.arange(len(self.mask)), -self.area, self.mask))
        out = np.zeros(len(self.mask), bool)
        out[order[np.append(True, np.diff(self.mask[order]) > 0)[: len(order)]]] = True
        return out

    def paint(self, chosen: np.ndarray) -> np.ndarray:
        """The stack with only the chosen components."""
        take = chosen[self.of_run]
        return _painted(self.first[take], (self.first + self.length)[take], *self.shape)


def fill_holes(m: np.ndarray) -> np.ndarray:
    """Background that doesn't reach the border (by sides) becomes foreground; for a mask or a stack."""
    stack = m.reshape(-1, *m.shape[-2:])
    # a hole has foreground above and below, so only masks with two runs in a column can have one
    runs = stack[:, :1].sum(axis=1) + (stack[:, 1:] & ~stack[:, :-1]).sum(axis=1)
    some = np.flatnonzero((runs > 1).any(axis=1))
    if not len(some):
        return m
    back = Regions(~stack[some], 4)
    out = stack.copy()
    out[some] |= back.paint(~back.touching_border())
    return out.reshape(m.shape)


def refine(m: np.ndarray, box: np.ndarray, multiclass: bool, keep_largest: bool = False, within: np.ndarray | None = None) -> np.ndarray:
    """Masks clipped to the prompt's box, closed and filled; binary data also opened and filled again; clipped once more.

    ``within``: where the masks are frames of larger images, which of their pixels lie in the image; the others don't count.
    """
    stack, inside = (x.reshape(-1, *x.shape[-2:]) for x in (m, box))
    if within is None:
        spread, shrink = dilate, erode
    else:
        beyond = ~within.reshape(stack.shape)
        spread = lambda s, size: dilate(s, size) & ~beyond
        shrink = lambda s, size: erode(s | beyond, size) & ~beyond
    work = fill_holes(shrink(spread(stack & inside, 5), 5))
    if not multiclass:
        work = fill_holes(spread(shrink(work, 3), 3))
    if keep_largest:
        parts = Regions(work, 8)
        work = parts.paint(parts.largest())
    return (work & inside).reshape(m.shape)


#: Pixels around what a mask holds in its box: closing by 5 reaches two beyond it, and the next is background.
MARGIN = 3
#: Sides of frames that share a stack: up to 8, 12, 16, 24, 32 pixels and so on.
ROOMS = np.sort([k << i for i in range(28) for k in (8, 12)])


def box_pixels(corners: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last column and row of the whole pixels that boxes (x1, y1, x2, y2) touch in images; none has a last before its first."""
    x1, y1, x2, y2 = corners.T
    good = (x1 <= x2) & (y1 <= y2)
    low = lambda v, side: np.clip(np.floor(np.where(good, v, 0)), 0, side).astype(np.int64)
    high = lambda v, side: np.clip(np.ceil(np.where(good, v, -1)), -1, side - 1).astype(np.int64)
    return low(x1, w), high(x2, w), low(y1, h), high(y2, h)


def refine_runs(counts: np.ndarray, size: np.ndarray, h: np.ndarray, w: np.ndarray, box: tuple[np.ndarray, ...], multiclass: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Run lengths of masks, one after the other, refined by their boxes (``box_pixels``), and how many each has.

    Only a frame around what a mask holds in its box is painted: beyond ``MARGIN`` nothing changes. Frames of about one size go
    through ``refine`` as a stack of about four million pixels at most, so the work is linear in the pixels of the frames, not of the images.
    """
    if (counts < 0).any():
        raise ValueError("a run length is negative")
    n, total = len(size), h * w
    x1, x2, y1, y2 = box
    wide = np.maximum(x2 - x1 + 1, 0)
    # the runs within the columns of the box
    mask = np.repeat(np.arange(n), size)
    first = np.append(True, mask[1:] != mask[:-1])[: len(mask)]
    run = np.append(0, np.cumsum(counts))
    end = run[1:] - run[np.cumsum(size) - size][mask]
    end = np.clip(end, (x1 * h)[mask], ((x1 + wide) * h)[mask]) - (x1 * h)[mask]
    who, col, top, low = segments(end - np.where(first, 0, np.append(0, end[:-1])[: len(end)]), size, h, wide)
    keep = (low >= y1[who]) & (top <= y2[who])
    who, col, top, low = who[keep], col[keep] + x1[who[keep]], np.maximum(top, y1[who])[keep], np.minimum(low, y2[who])[keep]
    base = np.cumsum(total + 1) - (total + 1)  # a number for each place of each mask, and for its end
    flips = [base + total]
    if len(who):
        at = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        owner, many = who[at], np.diff(np.append(at, len(who)))
        left, up = col[at] - MARGIN, np.minimum.reduceat(top, at) - MARGIN
        fw, fh = col[at + many - 1] - left + MARGIN + 1, np.maximum.reduceat(low, at) - up + MARGIN + 1
        kind = np.searchsorted(ROOMS, fw) * len(ROOMS) + np.searchsorted(ROOMS, fh)
        order = np.argsort(kind, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
            wid, hei = int(fw[group].max()), int(fh[group].max())
            most = max(1, 4_000_000 // (wid * hei))
            for k in (group[i : i + most] for i in range(0, len(group), most)):
                of, m = owner[k], many[k]
                i = np.repeat(np.arange(len(k)), m)
                s = np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + at[k][i]
                start = (i * wid + col[s] - left[k][i]) * (hei + 1) + top[s] - up[k][i]
                area = lambda xa, xb, ya, yb: _between(ya - up[k], yb - up[k], hei)[:, :, None] & _between(xa - left[k], xb - left[k], wid)[:, None, :]  # noqa: B023, E731
                done = refine(_painted(start, start + low[s] - top[s] + 1, len(k), hei, wid), area(x1[of], x2[of], y1[of], y2[of]), multiclass, within=area(0, w[of] - 1, 0, h[of] - 1))
                begin, after = _runs(done)
                line, y = np.divmod(begin, hei + 1)
                i, x = np.divmod(line, wid)
                begin, length, of = (left[k][i] + x) * h[of[i]] + up[k][i] + y, after - begin, of[i]
                inner = begin + length < total[of]  # a run up to the end of the image has no flip there
                flips += [base[of] + begin, (base[of] + begin + length)[inner]]
    place = np.sort(np.concatenate(flips))
    twice = np.append(False, place[1:] == place[:-1])  # a run down to the bottom of a column goes on at the top of the next
    place = place[~(twice | np.append(twice[1:], False)[: len(twice)])] if len(place) else place
    bound = np.searchsorted(place, base)
    out = np.diff(place, prepend=0)
    out[bound] = place[bound] - base
    return out, np.diff(np.append(bound, len(place)))


def _between(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    return (np.arange(n) >= np.reshape(a, (-1, 1))) & (np.arange(n) <= np.reshape(b, (-1, 1)))


def clear_specks(stack: np.ndarray, area: int) -> np.ndarray:
    """Masks without their components below ``area``; where no component reaches it, the largest stays."""
    parts = Regions(stack, 8)
    enough = parts.area >= area
    reached = np.bincount(parts.mask, enough, len(stack)) > 0
    return parts.paint(enough | ~reached[parts.mask] & parts.largest())


def plug_gaps(stack: np.ndarray, area: int) -> np.ndarray:
    """Masks with the parts of their background below ``area`` filled."""
    gaps = Regions(~stack, 8)
    return stack | gaps.paint(gaps.area < area)


SMALL_REGIONS = {"holes": plug_gaps, "islands": clear_specks}


def _stack(column: pa.Array, h: int, w: int) -> np.ndarray:
    """Dense masks of one size as a stack; the column has no nulls."""
    return (column.flatten().to_numpy(zero_copy_only=False) > 0).reshape(-1, h, w)


def _dense(stack: np.ndarray) -> pa.ListArray:
    n, size = len(stack), stack.shape[1] * stack.shape[2]
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(stack.ravel().astype(np.int32)))


def _in_chunks(df: DataFrame, h: int, w: int, schema: str, work) -> DataFrame:
    """``work(batch) -> RecordBatch`` over Arrow batches of about four million pixels of each mask column at most."""
    share_package(df.sparkSession)
    most = max(1, 4_000_000 // (h * w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                yield work(batch.slice(at, most))

    return df.mapInArrow(run, schema)


def refined_masks(df: DataFrame, key: str, values: str, box: str, h: int, w: int, multiclass: bool = False) -> DataFrame:
    """key, values (0 and 1) of each dense mask refined by its box mask (a dense array as well). Rows with a null mask or box are left out."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), _dense(refine(_stack(b.column(1), h, w), _stack(b.column(2), h, w), multiclass))], names=[key, "values"])

    kind = df.schema[key].dataType.simpleString()
    return _in_chunks(df.select(key, values, box).dropna(subset=[values, box]), h, w, f"{key} {kind}, values array<int>", work)


def without_small_regions(df: DataFrame, key: str, values: str, h: int, w: int, area: int, mode: str) -> DataFrame:
    """key, values, changed (whether there was a small region). ``mode``: ``holes`` are filled, ``islands`` dropped. Rows with a null mask are left out."""
    if mode not in SMALL_REGIONS:
        raise ValueError("mode is holes or islands")

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        stack = _stack(b.column(1), h, w)
        parts = Regions(~stack if mode == "holes" else stack, 8)
        changed = np.bincount(parts.mask, parts.area < area, len(stack)) > 0
        return pa.RecordBatch.from_arrays([b.column(0), _dense(SMALL_REGIONS[mode](stack, area)), pa.array(changed)], names=[key, "values", "changed"])

    kind = df.schema[key].dataType.simpleString()
    return _in_chunks(df.select(key, values).dropna(subset=[values]), h, w, f"{key} {kind}, values array<int>, changed boolean", work)


def refined_runs(df: DataFrame, key: str, box: str, multiclass: bool = False, hw: str = "mask_hw", counts: str = "counts") -> DataFrame:
    """key, mask_hw, counts of run-length masks of any sizes refined by their boxes (x1, y1, x2, y2; whole pixels touched, inclusive).

    Rows with a null mask, size or box are left out; a box with swapped corners holds no pixel.
    """
    share_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 2).T
            box = box_pixels(batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 4), h, w)
            size = np.diff(batch.column(2).offsets.to_numpy())
            # at most about two million runs and columns of boxes at a time
            part = np.cumsum(size + np.maximum(box[1] - box[0] + 1, 0)) // 2_000_000
            for rows in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
                if not len(rows):
                    continue
                b, k = batch.slice(rows[0], len(rows)), slice(rows[0], rows[-1] + 1)
                out, many = refine_runs(b.column(2).flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), size[k], h[k], w[k], tuple(v[k] for v in box), multiclass)
                counts = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), pa.array(out, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.list_(pa.int32())), counts], names=[key, "mask_hw", "counts"])

    kind = df.schema[key].dataType.simpleString()
    good = df.where(F.col(hw).isNotNull() & F.col(counts).isNotNull() & F.col(box).isNotNull()).where((F.size(hw) == 2) & (F.size(box) == 4) & ~F.exists(box, lambda x: x.isNull()) & ~F.exists(hw, lambda x: x.isNull()))
    return good.select(key, F.col(hw).alias("_hw"), F.col(counts).alias("_c"), F.col(box).alias("_b")).mapInArrow(run, f"{key} {kind}, mask_hw array<int>, counts array<int>")


def surface(m: np.ndarray) -> np.ndarray:
    """Pixels of the mask with a neighbour by side that isn't (beyond the image counts as not)."""
    inner = np.logical_and.reduce([_shifted(m, dy, dx, False) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    return m & ~inner


def distance_to(m: np.ndarray, spacing: tuple[float, ...] | None = None) -> np.ndarray:
    """The exact Euclidean distance of every pixel or voxel to the nearest of the mask; infinite if it is empty.

    First along the first axis, then the least over all shifts along each other: memory stays that of a few images.
    """
    spacing = spacing or (1.0,) * m.ndim
    rows = np.arange(m.shape[0], dtype=float).reshape(-1, *(1,) * (m.ndim - 1))
    above = np.maximum.accumulate(np.where(m, rows, -np.inf), axis=0)
    below = np.minimum.accumulate(np.where(m, rows, np.inf)[::-1], axis=0)[::-1]
    best = (np.minimum(rows - above, below - rows) * spacing[0]) ** 2
    for axis in range(1, m.ndim):
        g = np.moveaxis(best, axis, -1)
        out = g.copy()
        for dx in range(1, g.shape[-1]):
            cost = (dx * spacing[axis]) ** 2
            np.minimum(out[..., dx:], g[..., :-dx] + cost, out=out[..., dx:])
            np.minimum(out[..., :-dx], g[..., dx:] + cost, out=out[..., :-dx])
        best = np.moveaxis(out, -1, axis)
    return np.sqrt(best)


def surface_distances(a: np.ndarray, b: np.ndarray, spacing: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """From each surface pixel of one mask to the nearest of the other, both ways; infinite if the other is empty."""
    sa, sb = surface(a), surface(b)
    return distance_to(sb, spacing)[sa], distance_to(sa, spacing)[sb]


def _table(b: pa.RecordBatch, rows: list[int], names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *columns], names=names)


def distance_table(df: DataFrame, key: str, a: str, b: str, h: int, w: int, spacing: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """key, side (a or b), pos, distance of each surface pixel of two dense masks. Rows with a null mask are left out."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, side, pos, far = [], [], [], [np.zeros(0)]
        for i, (ma, mb) in enumerate(zip(_stack(batch.column(1), h, w), _stack(batch.column(2), h, w))):
            for name, own, d in zip("ab", (ma, mb), surface_distances(ma, mb, spacing)):
                at = np.flatnonzero(surface(own).ravel())
                rows += [i] * len(at)
                side += [name] * len(at)
                pos += at.tolist()
                far.append(d)
        return _table(batch, rows, [key, "side", "pos", "distance"], [pa.array(side, pa.string()), pa.array(pos, pa.int32()), pa.array(np.concatenate(far))])

    kind = df.schema[key].dataType.simpleString()
    return _in_chunks(df.select(key, a, b).dropna(subset=[a, b]), h, w, f"{key} {kind}, side string, pos int, distance double", work)


def corner_codes(volume: np.ndarray) -> np.ndarray:
    """The code of every 2 x 2 x 2 cell of a volume, one more along each axis: the sum of its voxels' weights."""
    from slicewright.operators.raster import CORNER_WEIGHTS

    p = np.pad(volume.astype(np.int16), 1)
    d, h, w = (n + 1 for n in volume.shape)
    return sum(k * p[dz : dz + d, dy : dy + h, dx : dx + w] for (dz, dy, dx), k in CORNER_WEIGHTS.items())


def volume_distance_table(df: DataFrame, key: str, a: str, b: str, shape: tuple[int, int, int], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """key, side (a or b), code, distance of each surface cell of two dense volumes (flat, by z, y, x).

    A cell is surface if its code is neither 0 nor 255; its area depends on its code and the spacing, and is
    joined by the caller who has a table of areas.
    """

    d, h, w = shape

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, side, code, far = [], [], [np.zeros(0, np.int32)], [np.zeros(0)]
        for i, pair in enumerate(zip(_stack(batch.column(1), d * h, w), _stack(batch.column(2), d * h, w))):
            codes = [corner_codes(v.reshape(shape)) for v in pair]
            faces = [(c != 0) & (c != 255) for c in codes]
            for k, name in enumerate("ab"):
                far.append(distance_to(faces[1 - k], spacing)[faces[k]])
                code.append(codes[k][faces[k]].astype(np.int32))
                rows += [i] * len(far[-1])
                side += [name] * len(far[-1])
        return _table(batch, rows, [key, "side", "code", "distance"], [pa.array(side, pa.string()), pa.array(np.concatenate(code), pa.int32()), pa.array(np.concatenate(far))])

    kind = df.schema[key].dataType.simpleString()
    return _in_chunks(df.select(key, a, b).dropna(subset=[a, b]), d * h, w, f"{key} {kind}, side string, code int, distance double", work)


def interpolate_labels(df: DataFrame, case: str, z: str, values: str, h: int, w: int) -> DataFrame:
    """case, z, values for the slices between two labelled ones: where the blend of their signed distances is inside.

    Each slice is put beside the next labelled one by a window, so a row holds all its work, however long a case is.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(case).orderBy(z)
    pairs = df.where(F.col(z).isNotNull() & F.col(values).isNotNull()).select(case, z, values, F.lead(z).over(order).alias("z2"), F.lead(values).over(order).alias("v2")).where(f"z2 > {z} + 1")

    def signed(m: np.ndarray) -> np.ndarray:
        far = float(h + w)
        return (np.minimum(distance_to(~m), far) - np.minimum(distance_to(m), far)).ravel()

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        rows, at, out = [], [], [np.zeros((0, h, w), bool)]
        pairs_of = zip(b.column(1).to_pylist(), b.column(3).to_pylist(), _stack(b.column(2), h, w), _stack(b.column(4), h, w))
        for i, (z1, z2, m1, m2) in enumerate(pairs_of):
            d1, d2 = signed(m1).reshape(h, w), signed(m2).reshape(h, w)
            t = ((np.arange(z1 + 1, z2) - z1) / (z2 - z1))[:, None, None]
            out.append((1 - t) * d1 + t * d2 > 0)
            rows += [i] * (z2 - z1 - 1)
            at += range(z1 + 1, z2)
        return _table(b, rows, [case, z, values], [pa.array(at, pa.int32()), _dense(np.concatenate(out))])

    kind = df.schema[case].dataType.simpleString()
    return _in_chunks(pairs, h, w, f"{case} {kind}, {z} int, {values} array<int>", work)
