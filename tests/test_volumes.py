"""Volumes, graphs, codecs and surfaces against plain NumPy."""

import random
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slicewright.operators import codecs, graph, volumes
from slicewright.operators.raster import decode_runs, encode_runs


def flood(v):
    """The number of its 26-connected component at each voxel, 0 outside, in raster order."""
    out, n = np.zeros(v.shape, int), 0
    for p in zip(*np.nonzero(v)):
        if out[p]:
            continue
        n += 1
        stack = [p]
        out[p] = n
        while stack:
            q = stack.pop()
            for d in product((-1, 0, 1), repeat=3):
                r = tuple(a + b for a, b in zip(q, d))
                if all(0 <= a < s for a, s in zip(r, v.shape)) and v[r] and not out[r]:
                    out[r] = n
                    stack.append(r)
    return out


def slices(spark, named):
    rows = [(name, z, list(m.shape), encode_runs(m).tolist()) for name, v in named.items() for z, m in enumerate(v)]
    return spark.createDataFrame(rows + [(None, 1, [1, 1], [0, 1]), ("n", None, [1, 1], [0, 1]), ("n", 3, None, None)], "v string, z int, mask_hw array<int>, counts array<int>")


@pytest.mark.parametrize(("least3", "least2"), [(0, 0), (6, 0), (4, 3)])
def test_volume_components(spark, least3, least2):
    rng = np.random.default_rng(2)
    named = {"a/b": rng.random((6, 9, 8)) < 0.12, "c": rng.random((5, 7, 11)) < 0.2, "empty": np.zeros((3, 4, 4), bool)}
    named["gap"] = rng.random((7, 6, 6)) < 0.3
    named["gap"][3] = False
    found, parts = volumes.volume_components(slices(spark, named), "v", "z", min_voxels=least3, min_pixels=least2)
    got = {(r.v, r.instance): r for r in found.collect()}
    per = {}
    for r in parts.collect():
        per.setdefault((r.v, r.instance), []).append((r.z, r.area))
    want = []
    for name, v in named.items():
        lab = flood(v)
        for k in range(1, lab.max() + 1):
            own = lab == k
            if own.sum() < least3:
                continue
            keep = []  # the 8-connected parts of each slice
            for z in range(len(own)):
                two = flood(own[z][None])
                keep += [(z, int((two == j).sum())) for j in range(1, two.max() + 1) if (two == j).sum() >= least2]
            if keep:
                want.append((name, sum(a for _, a in keep), sorted(keep)))
    assert sorted(want) == sorted((v, got[v, i].n_voxels, sorted(p)) for (v, i), p in per.items()) and len(got) == len(want)
    if not least2:
        boxes = sorted((n, *(int(f(np.nonzero(flood(v) == k)[a])) for a in (0, 1, 2) for f in (np.min, np.max))) for n, v in named.items() for k in range(1, flood(v).max() + 1) if (flood(v) == k).sum() >= least3)
        assert boxes == sorted((r.v, r.z1, r.z2, r.y1, r.y2, r.x1, r.x2) for r in got.values())


def test_connected_graph(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(60):03d}", f"n{rng.randrange(60):03d}") for _ in range(40)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)] + [("hub", f"h{i}") for i in range(30)] + [("x", None), ("y", "y")]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.connected(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert graph.connected(spark.createDataFrame([], "a string, b string")).count() == 0


def test_propagation(spark):
    rng = np.random.default_rng(3)
    v = rng.random((9, 10, 10)) < 0.5
    v[4] = v[5] = v[6] = False
    boxes = {1: [1.0, 1.0, 7.0, 7.0], 3: [0.0, 0.0, 8.0, 9.0], 8: [2.0, 0.0, 9.0, 8.0]}
    rows = [("s", z, boxes.get(z), [10, 10], encode_runs(v[z]).tolist()) for z in range(9)] + [("none", 0, None, [1, 1], [0, 1])]
    df = spark.createDataFrame(rows, "s string, z int, b array<double>, mask_hw array<int>, counts array<int>")
    got = {r.z: r for r in volumes.propagate(df, "s", "z", "b").collect()}
    assert sorted(got) == list(range(1, 9)) and all(r.s == "s" for r in got.values())
    seg, box, order = {}, None, [3, 4, 5, 6, 7, 8, 2, 1]
    for z in order:
        before = seg.get(z - 1 if z > 3 else z + 1)
        if z in boxes:
            how, box = "own", boxes[z]
        elif before.any():
            ys, xs = np.nonzero(before)
            how, box = "before", [float(xs.min()), float(ys.min()), float(xs.max()), float(ys.max())]
        elif z - 1 in boxes or z + 1 in boxes:
            how, box = "beside", boxes[z - 1] if z - 1 in boxes else boxes[z + 1]
        else:
            how = "last"
        seg[z] = volumes.inside_box(v[z], box)
        assert (got[z].used, got[z].box) == (how, box) and (decode_runs(np.array(got[z].counts), 10, 10) == seg[z]).all()
    assert {r.used for r in got.values()} == {"own", "before", "beside", "last"}


def textbook_pack(counts):
    """The public format, number by number."""
    out = ""
    for i, c in enumerate(counts):
        x = c - counts[i - 2] if i > 2 else c
        while True:
            digit = x & 31
            x >>= 5
            more = x != -1 if digit & 16 else x != 0
            out += chr((digit | 32 if more else digit) + 48)
            if not more:
                break
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2_000_000), max_size=12), min_size=1, max_size=6))
def test_packed_runs(lists):
    flat, size = np.array([x for one in lists for x in one], np.int64), np.array([len(x) for x in lists])
    signs, n = codecs.pack_counts(flat, size)
    texts = [bytes(x).decode() for x in np.split(signs, np.cumsum(n)[:-1])]
    assert texts == [textbook_pack(x) for x in lists]
    back, runs = codecs.unpack_counts(signs, n)
    assert runs.tolist() == size.tolist() and back.tolist() == flat.tolist()


def test_codecs_in_spark(spark):
    df = spark.createDataFrame([(1, [3, 2, 5, 700, 0, 4]), (2, []), (3, None)], "i int, counts array<int>")
    packed = codecs.pack_runs(df, "i")
    assert {r.i: r.packed for r in packed.collect()} == {1: textbook_pack([3, 2, 5, 700, 0, 4]), 2: ""}
    assert {r.i: r.counts for r in codecs.unpack_runs(packed, "i").collect()} == {1: [3, 2, 5, 700, 0, 4], 2: []}


def test_masks_of_pairs(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for i in range(30):
        h, w = rng.randint(1, 6), rng.randint(1, 6)
        pairs = [(rng.randrange(h * w), rng.randint(0, 9)) for _ in range(rng.randint(0, 5))]
        flat = np.zeros(h * w, bool)
        for a, n in pairs:
            flat[a : a + n] = True
        rows.append((i, " ".join(f"{a} {n}" for a, n in pairs) + (" 7" if i % 3 == 0 else ""), h, w))
        want[i] = flat.reshape(h, w).T
    df = spark.createDataFrame(rows + [(99, None, 1, 1), (98, "0 1", None, 1)], "i int, t string, h int, w int")
    got = {r.i: decode_runs(np.array(r.counts), *r.mask_hw) for r in codecs.mask_of_pairs(df, "i", "t", "h", "w").collect()}
    assert set(got) == set(want) and all((got[i] == want[i]).all() for i in want)


def test_surface_of_cells():
    from slicewright.operators import surfaces

    a = surfaces.cell_areas((1.0, 1.0, 1.0))
    assert a[0] == a[255] == 0 and all(x > 0 for x in a[1:255])
    assert a[128] == a[1] == pytest.approx(np.sqrt(3) / 8)  # one corner cut off
    assert a[0b11110000] == pytest.approx(1) == a[0b11001100] == a[0b10101010]  # a plane through the cell
    assert a[0b11000000] == pytest.approx(np.sqrt(2) / 2)  # one edge cut off
    assert surfaces.cell_areas((3.0, 1.0, 2.0))[0b11110000] == pytest.approx(2)
    assert a[0b10000001] == pytest.approx(np.sqrt(3) / 4)  # two corners far apart
    # turned and mirrored cells have the same area
    for axis in range(3):
        for code in range(256):
            inside = [c for c in surfaces.CORNERS if code & surfaces.CORNER_WEIGHTS[c]]
            other = sum(surfaces.CORNER_WEIGHTS[tuple(1 - v if i == axis else v for i, v in enumerate(c))] for c in inside)
            assert a[code] == pytest.approx(a[other])


def test_surface_of_a_cube():
    from slicewright.operators import morphology, surfaces

    v = np.zeros((6, 6, 6), bool)
    v[1:5, 1:5, 1:5] = True
    codes = morphology.corner_codes(v)
    total = surfaces.cell_areas((1.0, 1.0, 1.0))[codes].sum()
    assert 6 * 3 * 3 < total < 6 * 4 * 4  # a cube of four voxels with its edges cut off
