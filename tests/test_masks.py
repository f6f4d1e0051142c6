"""Components, morphology, run lengths, distances and suppression against plain NumPy."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slicewright.functions import box as B
from slicewright.functions import mask as M
from slicewright.operators import components as C
from slicewright.operators import detection, morphology, raster, resolve

masks = st.integers(1, 7).flatmap(lambda h: st.integers(1, 7).flatmap(lambda w: st.lists(st.booleans(), min_size=h * w, max_size=h * w).map(lambda v: np.array(v).reshape(h, w))))


def flood(m, reach8):
    """Component sets by flood fill, in raster order of their first pixel."""
    todo, out = {tuple(p) for p in np.argwhere(m)}, []
    for p in sorted(todo):
        if p not in todo:
            continue
        stack, got = [p], set()
        todo.discard(p)
        while stack:
            y, x = stack.pop()
            got.add((y, x))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    q = (y + dy, x + dx)
                    if q in todo and (reach8 or abs(dy) + abs(dx) == 1):
                        todo.discard(q)
                        stack.append(q)
        out.append(got)
    return out


@settings(max_examples=150, deadline=None)
@given(masks, st.sampled_from([4, 8]))
def test_components_by_runs(m, connectivity):
    h, w = m.shape
    got = C.component_rows(raster.encode_runs(m), h, w, connectivity)
    want = flood(m, connectivity == 8)
    assert len(got) == len(want)
    for r, s in zip(got, want):
        ys, xs = [p[0] for p in s], [p[1] for p in s]
        assert r[1:6] == (len(s), min(xs), min(ys), max(xs), max(ys))
        assert r[6] == pytest.approx(np.mean(xs)) and r[7] == pytest.approx(np.mean(ys))
        assert r[8] == sum(y in (0, h - 1) or x in (0, w - 1) for y, x in s) and r[9] == ((0, 0) in s)
    assert sum(r[1] for r in got) == m.sum()


@settings(max_examples=100, deadline=None)
@given(masks)
def test_runs_round_trip(m):
    runs = raster.encode_runs(m)
    assert runs.sum() == m.size and (raster.decode_runs(runs, *m.shape) == m).all()


@settings(max_examples=60, deadline=None)
@given(masks)
def test_distance_is_exact(m):
    d, at = morphology.distance_to(m, (1.0, 2.0)), np.argwhere(m)
    for y in range(m.shape[0]):
        for x in range(m.shape[1]):
            want = min((np.hypot(y - a, 2.0 * (x - b)) for a, b in at), default=np.inf)
            assert d[y, x] == want or d[y, x] == pytest.approx(want)


@settings(max_examples=60, deadline=None)
@given(masks)
def test_holes_and_refinement(m):
    filled = morphology.fill_holes(m)
    assert (filled | m == filled).all() and (morphology.fill_holes(filled) == filled).all()
    box = np.zeros_like(m)
    box[: m.shape[0] // 2 + 1, : m.shape[1] // 2 + 1] = True
    assert not (morphology.refine(m, box, True) & ~box).any()


@settings(max_examples=60, deadline=None)
@given(masks, st.integers(1, 6), st.booleans())
def test_refinement_by_steps(m, k, multiclass):
    """Against sets of pixels."""
    h, w = m.shape
    box = np.zeros_like(m)
    box[: h // 2 + 1, : w // 2 + 2] = True
    near = lambda p, r: [(p[0] + dy, p[1] + dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    within = lambda p: 0 <= p[0] < h and 0 <= p[1] < w
    every = {(y, x) for y in range(h) for x in range(w)}
    grow = lambda s, r: {q for p in s for q in near(p, r) if within(q)}
    shrink = lambda s, r: {p for p in every if all(q in s for q in near(p, r) if within(q))}

    def fill(s):
        back = np.ones((h, w), bool)
        for p in s:
            back[p] = False
        return s | {p for part in flood(back, False) if not any(y in (0, h - 1) or x in (0, w - 1) for y, x in part) for p in part}

    want = fill(shrink(grow({tuple(p) for p in np.argwhere(m & box)}, 2), 2))
    if not multiclass:
        want = fill(grow(shrink(want, 1), 1))
    want &= {tuple(p) for p in np.argwhere(box)}
    assert {tuple(p) for p in np.argwhere(morphology.refine(m, box, multiclass))} == want
    parts = flood(m, True)
    stay = [p for p in parts if len(p) >= k]
    if not stay and parts:
        got = {tuple(p) for p in np.argwhere(morphology.clear_specks(m[None], k)[0])}
        assert got in parts and len(got) == max(map(len, parts))
    else:
        assert {tuple(p) for p in np.argwhere(morphology.clear_specks(m[None], k)[0])} == set().union(*stay)
    holes = [p for p in flood(~m, True) if len(p) < k]
    assert {tuple(p) for p in np.argwhere(morphology.plug_gaps(m[None], k)[0])} == {tuple(p) for p in np.argwhere(m)}.union(*holes)


def test_stacks_are_masks_side_by_side():
    rng = np.random.default_rng(5)
    stack, box = rng.random((9, 12, 7)) < 0.6, rng.random((9, 12, 7)) < 0.9
    for f in (lambda s, b: morphology.refine(s, b, False, True), lambda s, b: morphology.fill_holes(s), lambda s, b: morphology.clear_specks(s.reshape(-1, 12, 7), 4).reshape(s.shape)):
        assert (f(stack, box) == np.stack([f(s, b) for s, b in zip(stack, box)])).all()


def test_refinement_of_runs(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for i in range(12):
        h, w = int(rng.integers(5, 40)), int(rng.integers(5, 40))
        m, box = rng.random((h, w)) < 0.6, [2.0, 1.0, float(w - 2), float(h + 3)]
        inside = np.zeros((h, w), bool)
        inside[1:, 2 : w - 1] = True
        rows.append((i, [h, w], raster.encode_runs(m).tolist(), box))
        want[i] = raster.encode_runs(morphology.refine(m, inside, True)).tolist()
    rows += [(90, None, [1], [0.0] * 4), (91, [1, 1], None, [0.0] * 4), (92, [2, 2], [0, 4], None), (93, [2, 2], [0, 4], [1.0, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "i int, mask_hw array<int>, counts array<int>, box array<double>")
    got = {r.i: r.counts for r in morphology.refined_runs(df, "i", "box", True).collect()}
    assert got.pop(93) == [4] and got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(masks, st.tuples(*[st.floats(-2, 9)] * 4), st.integers(0, 9), st.integers(0, 9), st.integers(0, 2)), min_size=1, max_size=6), st.booleans())
def test_refinement_in_frames(rows, multiclass):
    """Masks of several sizes at once, at and away from the border, with runs left out, against whole images."""
    counts, sizes, boxes, want = [], [], [], []
    for m, (x1, y1, x2, y2), dy, dx, cut in rows:
        m = np.pad(m, ((dy, 9 - dy), (dx, 3)))
        runs = raster.encode_runs(m)[: -cut or None]
        m, inside = raster.decode_runs(runs, *m.shape), np.zeros(m.shape, bool)
        if x1 <= x2 and y1 <= y2:
            inside[max(0, int(np.floor(y1 + dy))) : max(0, int(np.ceil(y2 + dy)) + 1), max(0, int(np.floor(x1 + dx))) : max(0, int(np.ceil(x2 + dx)) + 1)] = True
        counts.append(runs)
        sizes.append(m.shape)
        boxes.append([x1 + dx, y1 + dy, x2 + dx, y2 + dy] if x1 <= x2 and y1 <= y2 else [x1, y1, x2, y2])
        want.append(raster.encode_runs(morphology.refine(m, inside, multiclass)).tolist())
    h, w = np.array(sizes).T
    out, many = morphology.refine_runs(np.concatenate(counts), np.array([len(c) for c in counts]), h, w, morphology.box_pixels(np.array(boxes), h, w), multiclass)
    assert [v.tolist() for v in np.split(out, np.cumsum(many)[:-1])] == want


def test_refinement_costs_the_frame_not_the_image(spark, monkeypatch):
    """What is painted is what a mask holds in its box, however large its image is and whatever lies beside the box."""
    side, painted, whole = 2000, [], morphology.refine
    m = np.zeros((side, side), bool)
    m[100:110, 200:212] = m[1500:1900, 300:1900] = m[:5, -4:] = True
    runs, boxes = raster.encode_runs(m).tolist(), [[195.0, 90.0, 215.0, 120.0], [1990.0, 0.0, 2500.0, 8.0], [500.0, 10.0, 600.0, 20.0]]
    df = spark.createDataFrame([(i, [side, side], runs, b) for i, b in enumerate(boxes)], "i int, mask_hw array<int>, counts array<int>, box array<double>")
    batch = pa.RecordBatch.from_arrays([pa.array(range(3), pa.int32()), pa.array([[side, side]] * 3, pa.list_(pa.int32())), pa.array([runs] * 3, pa.list_(pa.int32())), pa.array(boxes)], names=["i", "_hw", "_c", "_b"])
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, work, schema: work)
    monkeypatch.setattr(morphology, "refine", lambda m, *rest, **kept: painted.append(m.size) or whole(m, *rest, **kept))
    got = [c for b in morphology.refined_runs(df, "i", "box")(iter([batch])) for c in b.column(2).to_pylist()]
    assert [sum(c[1::2]) for c in got] == [120, 20, 0] and [sum(c) for c in got] == [side * side] * 3
    assert sum(painted) < 2000


def test_geometry_round_trip(spark):
    """A mask doubled in size and brought back is the same."""
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, (rng.random(200) < 0.4).astype(int).tolist()) for i in range(20)], "i int, v array<int>")
    up = df.withColumn("u", M.resize_nearest(F.col("v"), 10, 20, 20, 40))
    back = up.withColumn("b", M.resize_nearest(F.col("u"), 20, 40, 10, 20))
    assert back.where(M.iou_of(M.overlap(F.col("v"), F.col("b"))) < 1).count() == 0


def test_overlap_of_empty_masks_is_nan(spark):
    r = spark.createDataFrame([([0, 0], [0, 0])], "a array<int>, b array<int>").select(M.iou_of(M.overlap(F.col("a"), F.col("b"))).alias("i"), M.dice_of(M.overlap(F.col("a"), F.col("b"))).alias("d")).first()
    assert np.isnan(r.i) and np.isnan(r.d)


def greedy(boxes, t):
    kept = []
    for k, b, s in sorted(boxes, key=lambda r: (-r[2], r[0])):
        def iou(a, c):
            iw, ih = min(a[2], c[2]) - max(a[0], c[0]), min(a[3], c[3]) - max(a[1], c[1])
            i = max(0, iw) * max(0, ih)
            area = lambda z: (z[2] - z[0]) * (z[3] - z[1])
            return i / (area(a) + area(c) - i)

        if all(iou(b, o) <= t for _, o in kept):
            kept.append((k, b))
    return {k for k, _ in kept}


@pytest.mark.parametrize("cell", [4.0, 64.0])
def test_suppression_is_greedy(spark, cell):
    rng = random.Random(8)
    rows = []
    for image in ("a", "b"):
        for k in range(60):
            x, y = rng.randrange(30), rng.randrange(30)
            rows.append((image, k, [float(x), float(y), float(x + rng.randrange(1, 12)), float(y + rng.randrange(1, 12))], rng.choice([0.5, round(rng.random(), 1)])))
    rows += [("c", 1, None, 0.5), ("c", 2, [0.0, 0.0, 1.0, 1.0], None)]
    df = spark.createDataFrame(rows, "image string, k int, box array<double>, score double")
    got = {(r.image, r.k) for r in detection.non_maximum_suppression(df, "image", "k", 0.3, cell).collect()}
    assert got == {(i, k) for i in ("a", "b") for k in greedy([r[1:] for r in rows if r[0] == i], 0.3)}
    again = detection.non_maximum_suppression(df.join(spark.createDataFrame(list(got), "image string, k int"), ["image", "k"]), "image", "k", 0.3, cell)
    assert again.count() == len(got)  # nothing more goes the second time


def test_chain_where_only_neighbours_overlap(spark):
    rows = [("i", k, [6.0 * k, 0.0, 6.0 * k + 9, 9.0], 1.0 - k / 10) for k in range(5)]
    df = spark.createDataFrame(rows, "image string, k int, box array<double>, score double")
    assert {r.k for r in detection.non_maximum_suppression(df, "image", "k", 0.15).collect()} == {0, 2, 4}


def test_resolver_cases(spark):
    ev = [("s", 1, 0, 0.9, True), ("s", 2, 0, 0.5, True), ("s", 1, 1, 0.7, True), ("s", 2, 1, 0.7 - 1e-7, True), ("s", 3, 2, 0.4, True), ("s", 1, 3, 0.9, False), ("s", 2, 4, float("nan"), True), ("s", 255, 5, 0.9, True), ("s", 2, 9, 0.9, True), ("s", 1, 6, 0.5, True), ("s", 2, 6, 0.5 + 2e-6, True)]
    e = spark.createDataFrame(ev, "slice string, label int, pos int, probability double, support boolean")
    u = spark.createDataFrame([("s", p) for p in range(7)], "slice string, pos int")
    out = resolve.resolve(u, resolve.same_class_evidence(e))
    assert {r.pos: r.value for r in out.collect()} == {0: 1, 1: 255, 2: 3, 3: 255, 4: 2, 5: 255, 6: 2}
    assert resolve.contradictions(out, e).count() == 0
    s = resolve.resolver_statistics(out).first()
    assert (s.union_pixels, s.no_support, s.single, s.contested, s.tied, s.confirmed) == (7, 2, 2, 3, 1, 4)


def test_best_component(spark):
    comp = spark.createDataFrame([("a", 1, 0, 0, 4, 4), ("a", 2, 10, 10, 14, 14), ("b", 5, 0, 0, 3, 3)], "img string, component int, x1 int, y1 int, x2 int, y2 int")
    inst = spark.createDataFrame([("a", 0, 2, [0.0, 0.0, 4.0, 4.0]), ("a", 1, 9, [1.0, 1.0, 5.0, 5.0]), ("a", 2, 9, [30.0, 30.0, 31.0, 31.0]), ("b", 3, 1, None), ("a", 5, None, None), ("z", 4, 1, [0.0, 0.0, 1.0, 1.0])], "img string, k int, component_id int, box array<double>")
    got = {r.k: (r.component, r.how) for r in detection.best_component(inst, comp, "img", ["k"]).collect()}
    assert got == {0: (2, "exact"), 1: (1, "overlap"), 2: (1, "overlap"), 3: (5, "single"), 4: (None, None), 5: (None, None)}


def test_degenerate_boxes(spark):
    df = spark.createDataFrame([([5.0, 5.0, 5.0, 3.0],), ([-4.0, 2.0, 99.0, 99.0],), ([9.0, 9.0, 9.0, 9.0],), (None,)], "b array<double>")
    got = [r[0] for r in df.select(B.clip_box(F.col("b"), F.lit(10), F.lit(10))).collect()]
    assert got == [[5.0, 5.0, 6.0, 6.0], [0.0, 2.0, 9.0, 9.0], [9.0, 9.0, 9.0, 9.0], None]


def test_label_interpolation(spark):
    a, b = np.zeros((6, 6), int), np.zeros((6, 6), int)
    a[1:5, 1:5] = b[1:5, 1:5] = 1
    df = spark.createDataFrame([("c", 0, a.ravel().tolist()), ("c", 3, b.ravel().tolist()), ("d", 0, a.ravel().tolist())], "c string, z int, v array<int>")
    got = morphology.interpolate_labels(df, "c", "z", "v", 6, 6).collect()
    assert sorted(r.z for r in got) == [1, 2] and all(r.v == a.ravel().tolist() for r in got)


def test_to_the_canvas_and_back(spark):
    """A run-length mask on a larger canvas at an offset, cropped out again, is the same."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [10, 20], raster.encode_runs(rng.random((10, 20)) < 0.3).tolist()) for i in range(15)], "i int, mask_hw array<int>, counts array<int>")
    n = lambda *v: [F.lit(x) for x in v]
    up = raster.resample(df, "i", *n(20, 40, 64, 64, 5, 7))
    assert {tuple(r.mask_hw) for r in up.collect()} == {(64, 64)}
    back = raster.resample(up, "i", *n(10, 20, 10, 20), crop=tuple(n(5, 7, 20, 40)))
    want = {r.i: r.counts for r in df.collect()}
    assert {r.i: r.counts for r in back.collect()} == want
    out = raster.resample(df, "i", *n(10, 20, 8, 8, -4, 100))
    assert {tuple(r.counts) for r in out.collect()} == {(64,)}  # wholly beyond the canvas


def test_volume_codes():
    v = np.zeros((3, 3, 3), bool)
    assert set(np.unique(morphology.corner_codes(v))) == {0}
    v[:] = True
    codes = morphology.corner_codes(v)
    assert codes.shape == (4, 4, 4) and (codes == 255).sum() == 8 and codes[0, 0, 0] == 1 and codes[-1, -1, -1] == 128


def test_runs_that_leave_pixels_out():
    for counts in ([5], [5, 3], [2, 0, 3], [0, 4, 1], [], [0], [12], [3, 99]):
        m = raster.decode_runs(np.array(counts, np.int64), 3, 4)
        assert sum(r[1] for r in C.component_rows(np.array(counts, np.int64), 3, 4, 8)) == m.sum()


@settings(max_examples=8, deadline=None)
@given(masks, st.randoms())
def test_overlap_measures(spark, m, rng):
    other = [int(rng.random() < 0.5) for _ in range(m.size)]
    df = spark.createDataFrame([(m.astype(int).ravel().tolist(), other)], "a array<int>, b array<int>")
    o, back = M.overlap(F.col("a"), F.col("b")), M.overlap(F.col("b"), F.col("a"))
    r = df.select(M.iou_of(o).alias("i"), M.iou_of(back).alias("j"), M.dice_of(o).alias("d")).first()
    if np.isnan(r.i):
        assert np.isnan(r.j) and np.isnan(r.d) and not m.any() and not any(other)
    else:
        assert r.i == r.j and 0 <= r.i <= 1 and r.d == pytest.approx(2 * r.i / (1 + r.i))


def test_slices_are_resolved_like_pixels(spark):
    rng = random.Random(5)
    ev, long, un = [], [], []
    for s in range(6):
        for label in (1, 2, 2, 7):
            p = [rng.choice([0.2, 0.5, 0.5 + 5e-7, 0.5 + 3e-6, float("nan"), 1.5]) for _ in range(20)]
            on = [rng.random() < 0.6 for _ in range(20)]
            ev.append((s, label, p, on))
            long += [(s, label, k, p[k], on[k]) for k in range(20)]
        un.append((s, [rng.random() < 0.8 for _ in range(20)]))
    un.append((9, [True, False]))  # without evidence
    u = spark.createDataFrame([(s, k) for s, m in un for k, x in enumerate(m) if x], "slice int, pos int")
    want = {(r.slice, r.pos): (r.n_support, r.value) for r in resolve.resolve(u, resolve.same_class_evidence(spark.createDataFrame(long, "slice int, label int, pos int, probability double, support boolean"))).collect()}
    e = spark.createDataFrame(ev, "slice int, label int, probability array<double>, support array<boolean>")
    union = spark.createDataFrame(un, "slice int, inside array<boolean>")
    out = {r.slice: r for r in resolve.resolve_slices(e, union).collect()}
    assert {(s, k): (out[s].n_support[k], out[s].value[k]) for s, m in un for k, x in enumerate(m) if x} == want
    assert all(out[s].value[k] == 0 for s, m in un for k, x in enumerate(m) if not x)
    with pytest.raises(Exception, match="labels are 1 to 254"):
        resolve.resolve_slices(e.withColumn("label", F.lit(255)), union).collect()
