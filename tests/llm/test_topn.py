import random
from datetime import datetime

from slicewright.llm import topn as T

SCHEMA = "dataset string, round int, slice_name string, case_id string, image_min_iou double, scored_at timestamp_ntz, rank int, k int, _r string"
NAN = float("nan")


def pool(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(3000):
        case = "hot" if i % 3 == 0 else rng.choice([None, *(f"c{j}" for j in range(60))])
        score = rng.choice([None, NAN, 0.0, 0.5, round(rng.random(), 2), -0.2, 1.7]) if i % 4 else 0.25
        rows.append(("d", rng.randrange(3), f"s{rng.randrange(900)}", case, score, rng.choice([None, datetime(2024, 1, rng.randint(1, 28), rng.randrange(24), rng.randrange(60))]), 7, 1, "x"))
    return rows + rows[:50]


def brute(rows, n):
    best = {}
    for r in rows:
        key = (r[2], r[1])
        order = (r[5] is not None, r[5] or datetime.min, r[3] is not None, r[3] or "", r[4] is not None, float("inf") if r[4] is not None and r[4] != r[4] else (r[4] or 0.0))
        if key not in best or order > best[key][0]:
            best[key] = (order, r)
    by = {}
    for _, r in best.values():
        if r[3] is not None and r[4] is not None and r[4] == r[4]:
            by.setdefault(r[3], []).append((r[4], r[2], r[1]))
    return {(c, k + 1, *x) for c, xs in by.items() for k, x in enumerate(sorted(xs)[:n])}


def test_against_brute_force(spark):
    rows = pool()
    df = spark.createDataFrame(rows, SCHEMA)
    for n in (1, 3, 100):
        got = {(r.case_id, r["rank"], r.image_min_iou, r.slice_name, r["round"]) for r in T.hardest_images(df.repartition(6), n).collect()}
        assert got == brute(rows, n)


def test_huge_tie(spark):
    df = spark.range(20_000).selectExpr("'g' AS g", "0.5D AS score", "id AS tie", "'a' AS _cut")
    assert [r.tie for r in T.top_n(df, "g", "score", ["tie"], 3).orderBy("rank").collect()] == [0, 1, 2]


def test_empty(spark):
    assert T.hardest_images(spark.createDataFrame([], SCHEMA)).count() == 0
