import itertools
import json
import random

import pytest

from slicewright.operators import drift as D

SCHEMA = "file_id bigint, dataset_name string, fold string, file_seq int, line_no int, payload string"


def raw(spark, files, extra=False):
    """files: {file_id: (dataset, seq, [objects or text])}."""
    rows = [(f, ds, "f0", seq, i, x if x is None or isinstance(x, str) else json.dumps(x)) for f, (ds, seq, lines) in files.items() for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    return df.withColumn("fields", F.lit(1)).withColumn("kind", F.lit("k")).withColumn("value", F.lit("v")) if extra else df


def changes(df):
    got = D.field_changes(D.match_columns(D.profile_fields(df), D.file_pairs(df)))
    return {(r.file_id, r.field_name, r.change_kind) for r in got.collect()}


@pytest.mark.parametrize("extra", [False, True])
def test_changes(spark, extra):
    files = {
        1: ("a", 1, [{"x": 1, "y": "s", "z": None}, "{broken", None, "[1, 2]", "7"]),
        2: ("a", 3, [{"x": 2.5, "y": 3}, {"x": 2.5, "y": 3}, {"z": [1, 2]}]),  # y: string > number; z had no values: no type change
        3: ("a", 4, [{"x": [1.5], "y": 3, "z": ["q"]}]),
        4: ("a", 5, ["nothing valid"]),
        5: ("b", 1, [{"x": True}]),
        6: ("b", 2, [{"x": {"a": 1}, "w": []}]),
    }
    want = {(2, "y", "type"), (3, "x", "type"), (3, "z", "type"), (4, "x", "removed"), (4, "y", "removed"), (4, "z", "removed"), (6, "x", "type"), (6, "w", "added")}
    assert changes(raw(spark, files, extra)) == want


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert changes(df) == set()
    assert D.unify(df).count() == 0


def test_slots_of_a_long_series(spark):
    rows = [(i, "a", "f", s, 0, '{"x": 1}') for i, s in enumerate([1, 5, 1023, 1024, 3000, 3001, 9000])]
    pairs = {(r.file_id, r.prev_id) for r in D.file_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert pairs == {(0, None), (1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5)}


def test_assignment_is_optimal():
    rng = random.Random(0)
    for _ in range(60):
        n, m = rng.randint(1, 4), rng.randint(1, 5)
        gain = [[rng.random() for _ in range(m)] for _ in range(n)]
        got = sum(gain[i][j] for i, j in D.best_assignment(gain))
        short, long = min(n, m), range(max(n, m))
        best = max(sum(gain[i][p[i]] if n <= m else gain[p[i]][i] for i in range(short)) for p in itertools.permutations(long, short))
        assert abs(got - best) < 1e-9


def test_renames_and_unified_table(spark):
    files = {k: ("a", k, [{"patient_id": f"PV-{k}{i}", "n": i} for i in range(5)]) for k in (1, 2)}
    files |= {k: ("a", k, [{"subject": f"PV-{k}{i}", "n": i} for i in range(5)]) for k in (3, 4)}
    files |= {5: ("a", 5, [{"patient_id": "PV-1", "n": 3}] * 2)}
    df = raw(spark, files)
    prof = D.profile_fields(df)
    ren = D.match_renames(D.match_columns(prof, D.file_pairs(df)))
    assert {(r.file_id, r.old_name, r.new_name) for r in ren.collect()} == {(3, "patient_id", "subject"), (5, "subject", "patient_id")}
    names = D.canonical_names(ren, prof, ["patient_id", "n"])
    assert names == {"subject": "patient_id"}
    out = D.wide(D.unify(df, names), {"patient_id": "string", "n": "int"})
    assert out.count() == 21  # the repeated line counts once
    assert out.where("patient_id is null or n is null").count() == 0
    assert {r.patient_id for r in out.where("file_id = 3").collect()} == {f"PV-3{i}" for i in range(5)}


def test_every_value_has_a_place(spark):
    files = {1: ("a", 1, [{"a": "A", "b": 1, "c": [2], "d": None, "e": "E"}, {"b": 3, "c": 4}, {"c": 5}]), 2: ("a", 2, [{"t": 6, "s": 7, "b": 8}, {"t": 9, "s": 10}, {"t": 11}])}
    renames = [("b", "a"), ("c", "a"), ("s", "b"), ("t", "s")]
    got = {(r.file_id, r.line_no): (r.a, r.other_fields) for r in D.wide(D.unify(raw(spark, files), dict(renames)), {"a": "string"}).collect()}
    assert got == {
        (1, 0): ("A", {"b": "1", "c": "[2]", "e": "E"}),
        (1, 1): ("3", {"c": "4"}),
        (1, 2): ("5", {}),
        (2, 0): ("8", {"s": "7", "t": "6"}),
        (2, 1): (None, {"b": "10", "t": "9"}),
        (2, 2): (None, {"s": "11"}),
    }


def test_one_off_rename_loses_no_value(spark):
    files = {1: ("a", 1, [{"patient_id": f"PV-{i}"} for i in range(5)]), 2: ("a", 2, [{"subject": f"PV-{i}"} for i in range(5)])}
    df = raw(spark, files)
    prof = D.profile_fields(df)
    ren = D.match_renames(D.match_columns(prof, D.file_pairs(df)))
    assert ren.count() == 1
    names = D.canonical_names(ren, prof, ["patient_id"])
    assert names == {"subject": "patient_id"}  # the values are the same, so once is enough
    got = D.wide(D.unify(df, names), {"patient_id": "string"}).where("file_id = 2").collect()
    assert sorted(r.patient_id for r in got) == [f"PV-{i}" for i in range(5)] and all(r.other_fields == {} for r in got)


def test_faint_one_off_rename_loses_no_value(spark):
    files = {1: ("a", 1, [{"patient_id": f"PV-{i}"} for i in range(5)]), 2: ("a", 2, [{"site_id": f"PV-1{i}"} for i in range(5)])}
    df = raw(spark, files)
    prof = D.profile_fields(df)
    names = D.canonical_names(D.match_renames(D.match_columns(prof, D.file_pairs(df))), prof, ["patient_id"])
    assert names == {}
    got = D.wide(D.unify(df, names), {"patient_id": "string"}).where("file_id = 2").collect()
    assert sorted(r.other_fields["site_id"] for r in got) == [f"PV-1{i}" for i in range(5)]


def test_renames_are_followed_through(spark):
    lines = lambda name: [{name: f"PV-{i}", "n": i} for i in range(6)]
    files = {k: ("a", k, lines(name)) for k, name in enumerate(["a_ref", "b_ref", "c_ref", "c_ref"])}
    df = raw(spark, files)
    prof = D.profile_fields(df)
    names = D.canonical_names(D.match_renames(D.match_columns(prof, D.file_pairs(df))), prof, ["n"])
    assert names == {"a_ref": "c_ref", "b_ref": "c_ref"}
    assert D.wide(D.unify(df, names), {"c_ref": "string"}).where("c_ref is null").count() == 0


def test_names_of_the_schema_stay_apart():
    assert D.name_groups([("x", "a", 2.0), ("x", "b", 1.0), ("y", "b", 0.9), ("p", "q", 0.1)], {"x": 3}, ["a", "b"]) == {"x": "a", "y": "b"}
    assert D.name_groups([("p", "q", 0.9), ("q", "r", 0.8)], {"q": 2, "r": 2}, []) == {"p": "q", "r": "q"}


def test_typed_columns(spark):
    values = ["[1, 2.5, 3]", '["1.0", "2.50", "3"]', '"1 x 2.5 x 3"', '{"z": 3, "y": 2.5, "x": 1}', "7", '"abc"', "null", '{"x": 1}', '"007"', '"Yes"', "0", "true", '{"id": "p7", "site": "s"}', '"two 3"']
    df = raw(spark, {1: ("a", 1, [f'{{"l": {v}, "spacing_zyx": {v}, "i": {v}, "b": {v}, "s": {v}}}' for v in values])})
    out = {r.line_no: r for r in D.wide(D.unify(df), {"l": "array<double>", "spacing_zyx": "array<double>", "i": "int", "b": "boolean", "s": "string"}).collect()}
    three = [1.0, 2.5, 3.0]
    assert [out[k].l for k in range(14) if k in out and k not in (4, 8, 10)] == [three, three, three, three] + [None] * 7
    assert out[4].l == [7.0] and out[3].spacing_zyx == three[::-1] and out[0].spacing_zyx == three
    assert [(out[k].i, out[k].b) for k in (4, 8, 9, 10, 11, 5)] == [(7, None), (7, None), (None, True), (0, False), (None, True), (None, None)]
    assert out[12].s == "p7" and out[5].s == "abc" and out[6].other_fields == {}
    assert out[5].other_fields == {"l": "abc", "spacing_zyx": "abc", "i": "abc", "b": "abc"}  # what can't be read stays


def planted(files, rng):
    """Consecutive files of a series, other lines in each, with some of their common fields renamed and decoys added: (files, true renames)."""
    alias = {"patient_id": "subj", "case_id": "study_key", "spacing": "px_size", "orig_h": "rows", "orig_w": "n_columns", "slice_name": "file", "native_gt": "label_path", "slice_idx": "z", "split": "part", "has_fg": "foreground"}
    out, truth = {}, set()
    filled = lambda objects: {n for o in objects for n, v in o.items() if v is not None}
    for (series, _, old), (same, _, new) in zip(files, files[1:]):
        if series != same:
            continue
        k = len(out)
        common = filled(old) & filled(new)
        moved = rng.sample(sorted(common & set(alias)), min(2, len(common & set(alias))))
        gone = [{n: v for n, v in o.items() if n in common} | {"legacy_flag": rng.choice(["A", "B"])} for o in old]
        come = [{alias[n] if n in moved else n: v for n, v in o.items() if n in common} for o in new]
        for o in come:
            o[f"{moved[0]}_note"] = rng.choice(["", "checked", f"by {rng.randrange(9)}"])  # named like the old one
            o["batch_no"] = [rng.randrange(1000)]
        out[k], out[k + 1] = (f"d{k}", 1, gone), (f"d{k}", 2, come)
        truth |= {(k + 1, n, alias[n]) for n in moved}
    return out, truth


def test_planted_renames_are_found(spark):
    by_file = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/manifest_raw.parquet").collect():
        try:
            o = json.loads(r.payload)
        except ValueError:
            continue
        if isinstance(o, dict):
            by_file.setdefault((r.dataset_name, r.fold, r.file_seq), []).append(o)
    files, truth = planted([(k[:2], k[2], v) for k, v in sorted(by_file.items())], random.Random(7))
    df = raw(spark, files)
    found = {(r.file_id, r.old_name, r.new_name) for r in D.match_renames(D.match_columns(D.profile_fields(df), D.file_pairs(df))).collect()}
    recall, precision = len(found & truth) / len(truth), len(found & truth) / len(found)
    print(f"planted {len(truth)}, recall {recall:.3f}, precision {precision:.3f}", sorted(truth - found)[:12], sorted(found - truth)[:12])
    assert len(truth) > 100 and recall >= 0.95 and precision >= 0.95
