import random
from collections import Counter

import pytest

from slicewright.llm import splits as S

SCHEMA = "slice_name string, patient_id string, case_id string, split string"


def brute_components(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[root(a)] = root(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(root(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def graph(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(90)]
    edges += [(f"c{i}", f"c{i + 1}") for i in range(60)] + [("hub", f"h{i}") for i in range(80)] + [("hub", "c30"), ("x", None), ("self", "self")]
    return edges, spark.createDataFrame(edges + edges[:9], "a string, b string")


@pytest.mark.parametrize(("small", "part"), [(10, 7), (10**6, 3)])
def test_components(spark, small, part):
    edges, df = graph(spark)
    got = {}
    for r in S.components(df, small, part).collect():
        got.setdefault(r.component, set()).add(r.node)
    assert {frozenset(g) for g in got.values()} == brute_components(edges)
    assert all(name in members for name, members in got.items())


def test_names_do_not_depend_on_the_way_labels_are_merged(spark):
    df = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(40)] + [("hub", f"h{i}") for i in range(20)], "a string, b string")
    take = lambda *a: {tuple(r) for r in S.components(df, *a).collect()}
    assert take() == take(0, 5)


def rows():
    return [
        ("s1", "P1", "c1", "train"), ("s2", " p1 ", "c2", "TEST "), ("s3", None, "C2", None), ("s4", "p2", None, "train"), ("s4", "p2", None, "train"), ("s5", None, None, "train"),
        ("s6", None, None, "test"), (None, "p1", None, "train"), ("s7", "p3", "c3", None), ("s8", "p3", "c4", " Train"), ("s9", "c1", "p9", "test"),
    ]


def test_conflicts(spark):
    df = spark.createDataFrame(rows(), SCHEMA).selectExpr("*", "'x' AS component", "1 AS lo", "2 AS _node", "'y' AS new_split")
    assert {r.slice_name for r in S.split_conflicts(df).collect()} == {"s1", "s2", "s3"}


def test_keep_together(spark):
    df = spark.createDataFrame(rows(), SCHEMA).selectExpr("*", "'x' AS component", "'y' AS new_split")
    got = S.keep_together(df, {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    assert len(got) == len(rows())
    side = {}
    for r in got:
        side.setdefault(r.component, set()).add(r.new_split)
    assert all(len(v) == 1 for v in side.values())
    comp = {r.slice_name: r.component for r in got if r.slice_name}
    assert comp["s1"] == comp["s2"] == comp["s3"] and comp["s7"] == comp["s8"] and comp["s5"] != comp["s6"]


def test_proportions_with_a_hot_component(spark):
    rng = random.Random(9)
    data = [(f"a{i}", "hot", f"c{i % 500}", None) for i in range(4000)] + [(f"b{i}", f"p{rng.randrange(3000)}", None, None) for i in range(8000)]
    df = spark.createDataFrame(data, SCHEMA)
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    got = [(r.slice_name, r.new_split) for r in S.keep_together(df, shares).collect()]
    n = Counter(s for _, s in got)
    assert all(abs(n[s] / 12000 - x) < 0.01 for s, x in shares.items())
    assert sorted(got) == sorted((r.slice_name, r.new_split) for r in S.keep_together(df.repartition(5), shares).collect())


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.split_conflicts(df).count() == 0 and S.keep_together(df, {"train": 0.9, "test": 0.1}).count() == 0
