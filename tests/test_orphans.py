import random
from datetime import datetime, timedelta

import pytest

from slicewright.operators import orphans as O

T0 = datetime(2024, 1, 1)


def at(k):
    return None if k is None else T0 + timedelta(days=k)


def build(spark, m, g, p, extra=False):
    more = ", t string, ref_table string, kind string" if extra else ""
    add = (lambda r: (*r, "x", "y", "z")) if extra else (lambda r: r)
    mdf = spark.createDataFrame([add((k, at(b), at(e))) for k, b, e in m], "k string, b timestamp_ntz, e timestamp_ntz" + more)
    gdf = spark.createDataFrame([add((k, at(b), ok)) for k, b, ok in g], "k string, b timestamp_ntz, ok boolean" + more)
    pdf = spark.createDataFrame([add((k, at(b))) for k, b in p], "k string, b timestamp_ntz" + more)
    return [O.Node("m", mdf, "k", "b", "e"), O.Node("g", gdf, "k", "b", parent="m", refers="ok", serves="ok"), O.Node("p", pdf, "k", "b", parent="g")]


def brute(m, g, p):
    out = set()

    def state(rows, k, t):
        own = [r for r in rows if r[0] == k]
        there = [r for r in own if r[1] is not None and r[1] <= t and (r[2] is None or r[2] > t) and (r[2] is None or r[2] > r[1])]
        begun = [r for r in own if r[1] is not None and r[1] <= t]
        return there, "absent" if not own else "late" if not begun else "deleted"

    bad = set()
    for k, t, ok in g:
        if ok and k is not None and t is not None:
            there, s = state(m, k, t)
            if not there:
                out.add(("g", k, t, s, "direct"))
                bad.add((k, t))
    geo = [(k, t, None) for k, t, ok in g if ok]
    for k, t in p:
        if k is not None and t is not None:
            there, s = state(geo, k, t)
            if not there:
                out.add(("p", k, t, s, "direct"))
            elif all((r[0], r[1]) in bad for r in there):
                out.add(("p", k, t, "unsound", "inherited"))
    return out


def found(nodes, **k):
    return {(r.ref_table, r.key, (r.t - T0).days, r.ref_state, r.kind) for r in O.orphan_cascade(nodes, **k).collect()}


@pytest.mark.parametrize("hot", [False, True])
def test_against_brute_force(spark, hot):
    rng = random.Random(3)
    names = ["a"] * 20 + list("bcdef") + [None] if hot else [f"s{i}" for i in range(40)] + [None]
    day = lambda: rng.choice([None, *range(90)])
    m = [(rng.choice(names), day(), rng.choice([None, day()])) for _ in range(120)]
    g = [(rng.choice(names), day(), rng.random() < 0.8) for _ in range(120)]
    p = [(rng.choice(names), day()) for _ in range(120)]
    m, g, p = m + m[:5], g + g[:5], p + p[:5]  # repeated rows
    want = brute(m, g, p)
    assert found(build(spark, m, g, p)) == want
    if hot:
        assert found(build(spark, m, g, p), slot_rows=7) == want == found(build(spark, m, g, p), slot_rows=1)


def test_extra_columns_with_clashing_names(spark):
    m, g, p = [("a", 1, None)], [("a", 0, True), ("b", 2, True)], [("a", 3), ("c", 1)]
    assert found(build(spark, m, g, p, extra=True)) == brute(m, g, p)


def test_empty_tables(spark):
    assert found(build(spark, [], [], [])) == set()
    assert found(build(spark, [], [("a", 1, True)], [("a", 2)])) == {("g", "a", 1, "absent", "direct"), ("p", "a", 2, "unsound", "inherited")}


def test_circle_is_an_error(spark):
    df = spark.createDataFrame([("a", T0)], "k string, b timestamp_ntz")
    with pytest.raises(ValueError):
        O.orphan_cascade([O.Node("x", df, "k", "b", parent="y"), O.Node("y", df, "k", "b", parent="x")])
