import random

from slicewright.llm import mixing as M


def tables(spark, docs, targets):
    d = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint").selectExpr("*", "'x' AS share", "1 AS run", "'y' AS total")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int").selectExpr("*", "1 AS n_tokens")
    return d, t


def corpus(seed=1):
    rng = random.Random(seed)
    docs = [(i, "big" if i % 3 else "mid", rng.randint(1, 50)) for i in range(3000)]
    docs += [(10_000 + i, "small", rng.randint(1, 50)) for i in range(120)]
    return docs + [(1, "other", 5), (2, None, 5), (3, "big", 0), (4, "mid", None), (9005, "big", 20), (9005, "big", 20)]


TARGETS = [("big", 0.5, 1), ("mid", 0.3, 1), ("small", 0.1, 3), ("small", 0.05, 3), ("ghost", 0.05, 5), (None, 0.2, 1), ("zero", 0.0, 1), ("null", None, 1)]


def test_shares_and_repeats(spark):
    d, t = tables(spark, corpus(), TARGETS)
    mixed = M.mix(d, t)
    rows = mixed.collect()
    assert mixed.columns == ["doc_id", "source", "copy_no", "n_tokens", "finish"]
    assert [r.finish for r in rows] == sorted(r.finish for r in rows)
    shares = {r.source: r for r in M.shares_reached(mixed, t).collect()}
    assert set(shares) == {"big", "mid", "small", "ghost"}
    for s, goal in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert abs(shares[s].share - goal / 0.95) < 0.01
    assert shares["ghost"].gap is None and abs(shares["big"].gap - (shares["big"].share - 0.5 / 0.95)) < 1e-9
    for budget in (None, 30_000):
        kept = M.rules_kept(M.mix(d, t, budget=budget), d, t, budget).collect()
        assert len(kept) == 4 and all(r.copies_within_cap and r.share_within_a_document and r.total_within_budget for r in kept)
    assert shares["ghost"].n_tokens == 0 and shares["small"].most_copies == 3
    copies = {}
    for r in rows:
        copies.setdefault((r.source, r.doc_id), []).append(r.copy_no)
    assert all(len(v) <= (3 if s == "small" else 2) for (s, _), v in copies.items())  # the repeated row of 9005 is two documents
    assert sorted(r.doc_id for r in rows if r.source == "small") == sorted(3 * [10_000 + i for i in range(120)])  # the source that runs out is used up


def test_brute_force_queue_with_budget(spark):
    d, t = tables(spark, corpus(2), TARGETS)
    whole = [(r.finish, r.source, r.copy_no, r.doc_id, r.n_tokens) for r in M.mix(d, t, budget=10**9).collect()]
    assert whole == sorted(whole)
    budget, got, total = 20_000, [], 0
    for r in whole:
        if total + r[4] > budget:
            break
        total += r[4]
        got.append(r)
    ours = [(r.finish, r.source, r.copy_no, r.doc_id, r.n_tokens) for r in M.mix(d, t, budget=budget).collect()]
    assert ours == got
    served = M.mix(d, t, budget=10**9)
    M.BINS, bins = 4, M.BINS
    try:  # the bin of the cut is refined down to a few rows
        for rows in (1, 30):
            assert {r.finish for r in M.truncate(served, budget, rows).collect()} == {r[0] for r in got}
    finally:
        M.BINS = bins
    run = {}
    for f, s, c, _, n in whole:
        run[s] = run.get(s, 0) + n
        assert abs(f - run[s] / {"big": 0.5, "mid": 0.3, "small": 0.15}[s]) < 1e-6


def test_same_in_any_partitioning(spark):
    d, t = tables(spark, corpus(), TARGETS)
    a = [tuple(r) for r in M.mix(d.repartition(7), t).collect()]
    assert a == [tuple(r) for r in M.mix(d.coalesce(1), t).collect()]


def test_empty(spark):
    d, t = tables(spark, corpus(), TARGETS)
    assert M.mix(d.limit(0), t).count() == 0 and M.mix(d, t.limit(0)).count() == 0 and M.mix(d.limit(0), t, budget=5).count() == 0
    assert M.shares_reached(M.mix(d.limit(0), t), t).count() == 4
