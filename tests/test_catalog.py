import pytest
from pyspark.sql import functions as F

from slicewright.functions import number, text
from slicewright.operators import catalog, metrics, progress, scoring


def test_budget_table(spark):
    want = {18: 1, 24: 1, 30: 2, 60: 3, 80: 4, 100: 5, 139: 7, 200: 10, 1000: 50}
    df = spark.createDataFrame([(n,) for n in [*want, 0]], "n int")
    got = {r.n: r.b for r in df.select("n", number.nearest_budget(F.col("n")).alias("b")).collect()}
    assert got == want | {0: None}


def test_seeded_sample(spark):
    df = spark.createDataFrame([(f"c{i:02d}",) for i in range(20)] + [(None,)], "i string")
    a = catalog.sample_exact(df, "i", 5, 2026)
    assert a == catalog.sample_exact(df.repartition(3), "i", 5, 2026) and a != catalog.sample_exact(df, "i", 5, 2027) and len(a) == 5
    with pytest.raises(ValueError):
        catalog.sample_exact(df, "i", 21, 1)
    train, test = catalog.split_fixed_exact(df, "i", 15, 1)
    assert len(train) == 15 and not set(train) & set(test)


def test_stratified_exact():
    train, test = catalog.stratified_exact({f"a{i}": "a" for i in range(5)} | {"b0": "b"} | {f"c{i}": "c" for i in range(2)}, 0.5, 3)
    assert sum(x[0] == "a" for x in train) == 2 and sum(x[0] == "c" for x in train) == 1 and len(train) + len(test) == 8


def test_partition(spark):
    ids = lambda s: spark.createDataFrame([(x,) for x in s] or [], "k string")
    assert catalog.partition_errors(ids("abc"), ids("a"), ids("bc"), "k").count() == 0
    got = {(r.k, r.error) for r in catalog.partition_errors(ids("abd"), ids("ax"), ids("ab"), "k").collect()}
    assert got == {("a", "in both"), ("d", "in neither"), ("x", "unknown")}
    assert catalog.partition_errors(ids(""), ids(""), ids(""), "k").count() == 0


def test_prefix_join_wants_exactly_one(spark):
    left = spark.createDataFrame([("1",), ("2",), ("12",)], "k string")
    right = spark.createDataFrame([("1_a",), ("2_a",), ("2_b",), ("12_x_y",), ("3",)], "r string")
    got = {(r.k, r.r) for r in catalog.prefix_join(left, "k", right, "r").collect()}
    assert got == {("1", "1_a"), ("12", "12_x_y")}


def test_stems(spark):
    names = {"a/b.nii.gz": ("b", ".nii.gz"), "c.npy.h5": ("c", ".h5"), "d\\e.PNG": ("e", ".png"), "x.y.npy": ("x.y", ".npy"), "noext": ("noext", ""), ".hidden": (".hidden", "")}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: (r.s, r.x) for r in df.select("n", text.safe_stem(F.col("n")).alias("s"), text.copy_suffix(F.col("n")).alias("x")).collect()}
    assert got == names


def test_sample_names_keep_long_indexes(spark):
    r = spark.range(1).select(text.sample_name(F.lit("train"), F.lit("c"), F.lit(1234)).alias("a"), text.sample_name(F.lit("train"), F.lit("c"), F.lit(None).cast("int")).alias("b")).first()
    assert tuple(r) == ("train__c__z1234.npy", "train__c.npy")


def test_hash_of_trees(spark):
    df = spark.createDataFrame([("a/x", bytearray(b"1")), ("a/y", bytearray(b"2")), ("b/z", bytearray(b"3"))], "path string, content binary")
    one = catalog.tree_hash(df).first()[0]
    assert one == catalog.tree_hash(df.repartition(3)).first()[0]
    assert one != catalog.tree_hash(df.withColumn("content", F.when(F.col("path") == "b/z", F.lit(b"9")).otherwise(F.col("content")))).first()[0]


def test_weighted_percentile_and_worst_fraction(spark):
    df = spark.createDataFrame([("k", float(v), 1.0) for v in range(1, 11)] + [("i", float("inf"), 1.0)], "k string, v double, w double")
    assert {r.k: r.v for r in metrics.weighted_percentile(df, ["k"], "v", F.col("w"), 95.0).collect()} == {"k": 10.0, "i": float("inf")}
    w = {r.k: r.worst for r in metrics.worst_fraction_mean(df.where("k = 'k'").unionByName(df.where("k = 'k'")), ["k"], "v").collect()}
    assert w == {"k": 1.5}


def test_cases_with_nothing_to_score(spark):
    lab = spark.createDataFrame([("c", 1, 0, 0, 0, 0)], "c string, label int, inter int, uni int, gt int, pred int")
    r = scoring.per_case(lab, ["c"], 0.5).first()
    assert (r.macro, r.least, r.worst, r.missed, r.hard) == (1.0, 1.0, 1.0, 0, False)


def test_throttle_is_greedy(spark):
    df = spark.createDataFrame([("a", s) for s in (0, 1, 2, 3, 4, 5)] + [("b", 1), (None, 1), ("b", None)], "k string, s int").selectExpr("k", "cast(timestamp_seconds(s) as timestamp_ntz) AS t")
    got = sorted((r.k, r.t.second) for r in progress.throttle(df, "k", "t", 2.0).collect())
    assert got == [("a", 0), ("a", 2), ("a", 4), ("b", 1)]


def test_scalar_stats(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x", "c": [1], "d": {"e": 1}, "f": null, "g": true}',), ("broken",), (None,)], "j string")
    got = [r[0] for r in df.select(progress.scalar_stats("j")).collect()]
    assert got == [{"a": "1", "b": "x", "f": None, "g": "true"}, None, None]


def test_hybrid_supervision(spark):
    from slicewright.operators.supervision import check_hybrid

    px = lambda rows: spark.createDataFrame(rows, "k string, y int, x int, value int")
    truth = px([("f", 0, 0, 1), ("f", 0, 1, 2), ("g", 0, 0, 1)])
    labels = px([("f", 0, 0, 1), ("f", 1, 1, 255), ("g", 0, 0, 1), ("b", 0, 0, 255), ("b", 5, 5, 1)])
    union = spark.createDataFrame([("b", 0, 0)], "k string, y int, x int")
    full = spark.createDataFrame([("f",), ("g",)], "k string")
    got = {(r.k, r.problem): r.n for r in check_hybrid(labels, truth, union, full, "k").collect()}
    assert got == {("f", "full differs from truth"): 2, ("f", "full with ignore"): 1, ("b", "outside of prompts"): 1}


def test_run_pairs(spark):
    from slicewright.operators.supervision import run_pairs

    df = spark.createDataFrame([("3 2  10 1",), ("",), (None,), ("7",), ("1 2 3",)], "s string")
    got = [r[0] and [tuple(p) for p in r[0]] for r in df.select(run_pairs(F.col("s"))).collect()]
    assert got == [[(3, 2), (10, 1)], [], None, [], [(1, 2)]]


def test_points_are_inside(spark):
    from slicewright.operators.supervision import inner_point

    df = spark.createDataFrame([("a", y, x) for y, x in ((0, 0), (5, 5), (9, 1))] + [("b", 2, 2)], "k string, y int, x int")
    got = inner_point(df, ["k"], 1)
    assert got.join(df, ["k", "y", "x"]).count() == 2 == got.count()


def test_names_by_list_or_all():
    assert catalog.known_names(" ALL ", ["b", "a"]) == ["a", "b"] and catalog.known_names("b, a,", ["b", "a"]) == ["b", "a"]
    with pytest.raises(ValueError, match="unknown: x"):
        catalog.known_names("a,x", ["a"])


def test_tree_hash_has_the_same_shape_everywhere(spark):
    df = spark.createDataFrame([(f"d{i % 7}/f{i}", str(i).encode()) for i in range(60)], "path string, content binary")
    catalog.FAN_OUT, fan = 4, catalog.FAN_OUT
    try:
        one = catalog.tree_hash(df).first()[0]
        assert one == catalog.tree_hash(df.repartition(5)).first()[0]
        assert one != catalog.tree_hash(df.where("path <> 'd3/f3'")).first()[0]
    finally:
        catalog.FAN_OUT = fan
    assert catalog.tree_hash(df.limit(0)).first()[0] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
