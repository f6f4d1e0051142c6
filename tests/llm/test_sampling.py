import random

from pyspark.sql import functions as F

from slicewright.llm import sampling as S

SCHEMA = "run_id bigint, dataset_name string, fold string, seed int, round int, cumulative_full_case_ids array<string>, series string, n int, due int"


def test_lost_members_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        ids = rng.choice([None, [], [rng.choice([None, *"abcdefgh"]) for _ in range(rng.randint(1, 12))]])
        rows.append((i, rng.choice(["d", None]), "f", rng.choice([None, 7, 9]), rng.randrange(4), ids, "x", 1, 2))
    rows += rows[:10]
    want = set()
    real = [(r[0], (r[1], r[2], 7 if r[3] is None else r[3]), r[4], {x for x in r[5] if x is not None}) for r in rows if r[5] is not None]
    for run, series, rnd, own in real:
        due = set().union(*(o for _, s, k, o in real if s == series and k <= rnd))
        want |= {(run, x) for x in due - own}
    got = {tuple(r) for r in S.lost_members(spark.createDataFrame(rows, SCHEMA), 7).collect()}
    assert got == want


def test_empty(spark):
    assert S.lost_members(spark.createDataFrame([], SCHEMA), 7).count() == 0
    m = spark.createDataFrame([], "dataset_name string, case_id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz")
    assert S.growing_case_sample(m, 1, 0.5).count() == 0


def manifest(spark, n):
    df = spark.range(n).selectExpr("'d' AS dataset_name", "concat('c', id % 400) AS case_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(id div 40 AS int)) AS ingested_at", "timestamp_ntz '2024-06-01 00:00:00' + make_dt_interval(cast(id div 10 AS int)) AS deleted_at", "'w' AS hash", "1 AS month")
    return df.unionByName(df.limit(1).withColumn("case_id", F.lit(None).cast("string")))


def test_the_sample_is_stable_and_only_grows(spark):
    take = lambda df: {(r.case_id, r.from_month) for r in S.growing_case_sample(df, 42, 0.5, 20).collect()}
    small, large = manifest(spark, 3000), manifest(spark, 9000)
    a, b = take(small), take(large)
    assert a == take(small.repartition(9)) and a  # reruns and partitionings
    assert {c for c, _ in a} <= {c for c, _ in b} and len(b) > len(a)  # nothing selected is lost
    assert all(dict(b)[c] == m for c, m in a)
    assert 0.35 < len(b) / 400 < 0.65  # all weights have reached 1: half is selected


def test_running_maximum(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.2), ("a", 3, 0.9), ("a", 3, 0.1), ("b", 1, None), (None, 1, 1.0), ("c", None, 1.0)], "_weight string, r int, w double")
    got = {tuple(r) for r in S.weight_rises(df.withColumnRenamed("_weight", "i"), [], "i", "r", "w").collect()}
    assert got == {("a", 1, 0.5), ("a", 3, 0.9), ("b", 1, 0.0)}


def test_the_state_outlives_its_deliveries(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    take = lambda df: {(r.case_id, r.from_month) for r in S.growing_case_sample(df, 42, 0.5, 20, path).collect()}
    old = manifest(spark, 3000)
    first = take(old)
    late = manifest(spark, 9000).where("ingested_at >= timestamp_ntz '2024-04-01 00:00:00'")  # the old rows are gone, weights fall
    second = take(late)
    assert first and first <= second
    assert take(late.limit(0)) == second == take(old)
    assert first - {(r.case_id, r.from_month) for r in S.growing_case_sample(late, 42, 0.5, 20).collect()}  # without the state some are lost


def test_weights_fall_with_withdrawn_slices(spark):
    df = spark.createDataFrame([("d", "c", "2024-01-03", None), ("d", "c", "2024-01-05", "2024-03-01"), ("d", "c", "2024-01-06", "2023-01-01"), ("d", None, "2024-01-03", None)], "dataset_name string, case_id string, i string, e string")
    df = df.selectExpr("dataset_name", "case_id", "cast(i AS timestamp_ntz) AS ingested_at", "cast(e AS timestamp_ntz) AS deleted_at")
    assert {(r.month, r.weight) for r in S.case_weights(df, 4).collect()} == {("2024-01", 0.5), ("2024-03", 0.25)}
