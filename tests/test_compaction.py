import numpy as np
import pytest
from pyspark.sql import functions as F

from slicewright.operators import compaction as C
from slicewright.operators.raster import decode_runs
from slicewright.plans import datawork
from slicewright.sources import versions

SCHEMA = "file_id bigint, file_path string, case_id string, slice_name string, mask_hw array<int>, counts array<int>, size_bytes bigint"


def test_digest_tells_pixels_not_encodings(spark):
    rng = np.random.default_rng(1)
    rows, masks = [], []
    for i in range(300):
        h, w = 3, 4
        counts, left = [], h * w
        while left:
            c = int(rng.integers(0, min(4, left) + 1))
            counts.append(c)
            left -= c
            if left <= 6 and i % 3 == 0:
                break  # the runs leave the rest out
        rows.append((i, [h, w], counts))
        masks.append(decode_runs(np.array(counts), h, w).tobytes())
    df = spark.createDataFrame(rows, "i int, hw array<int>, counts array<int>")
    got = {r.i: tuple(r.d) for r in df.select("i", C.mask_digest("counts", "hw").alias("d")).collect()}
    for a in range(300):
        for b in range(a):
            assert (got[a] == got[b]) == (masks[a] == masks[b])


def test_null_masks_have_no_digest(spark):
    df = spark.createDataFrame([(None, [1]), ([1, 1], None)], "hw array<int>, counts array<int>")
    assert [r[0] for r in df.select(C.mask_digest("counts", "hw")).collect()] == [None, None]


def files(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("part", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("name", F.lit("n")) if extra else df


@pytest.mark.parametrize("extra", [False, True])
def test_found_pairs(spark, tmp_path, extra):
    hw, m, same, other = [2, 2], [1, 2, 1], [1, 1, 0, 1, 1], [0, 4]
    rows = [
        (1, "a/s1.npy", "c", "s1.npy", hw, m, 5),
        (2, "b\\s1.npy", None, " s1.npy ", hw, same, None),  # spaces, other encoding, other case
        (3, "x/s1.npy", "c", None, hw, m, 5),  # name from the path
        (4, "x/s1.npy", "c", "  ", hw, other, 5),  # other mask
        (5, "x/s2.npy", "c", "s2.npy", hw, m, 5),  # other name
        (6, None, "c", None, hw, m, 5),  # no name
        (7, None, "c", None, hw, m, 5),
        (8, "x/s1.npy", "c", "s1.npy", None, None, 5),  # no mask
        (9, "x/s1.npy", "c", "s1.npy", [4, 1], m, 5),  # other size
    ]
    slices = spark.createDataFrame([("s1.npy", "c"), ("s1.npy", "c"), (None, "d")], "slice_name string, case_id string")
    filed = C.filed_masks(files(spark, rows, extra), slices)
    path = f"file://{tmp_path}/t"
    C.lay_out(filed, path)
    done = C.compact_table(spark, path, ["name", "digest"], "file_id", pick_copies=True)
    assert {tuple(r) for r in C.pairs_of(done.copies).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {r.file_id for r in versions.read(spark, path).collect()} == {1, 4, 5, 6, 7, 8, 9}


def test_empty(spark, tmp_path):
    slices = spark.createDataFrame([], "slice_name string, case_id string")
    path = f"file://{tmp_path}/t"
    C.lay_out(C.filed_masks(files(spark, []), slices), path)
    done = C.compact_table(spark, path, ["name", "digest"], "file_id", pick_copies=True)
    assert C.pairs_of(done.copies).count() == 0 and done.log.count() == 0 and versions.read(spark, path).count() == 0


def small_table(spark, path):
    rows = [(i, f"r{i % 30}" if i % 7 else None, i % 3, 0) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, name string, bucket int, n_target_files int")
    versions.append(spark, path, df.where("bucket < 2").repartition(12), "bucket")
    versions.append(spark, path, df.where("bucket = 2").coalesce(1), "bucket")
    return df


def kept(df):
    """Of rows with a name the first of each name and bucket; all without one."""
    named = df.where("name is not null").groupBy("name", "bucket").agg(F.min("id").alias("id")).select("id", "name", "bucket")
    return {tuple(r) for r in named.unionByName(df.where("name is null").select("id", "name", "bucket")).collect()}


def rows_of(spark, path, version=None):
    return {tuple(r) for r in versions.read(spark, path, version).select("id", "name", "bucket").collect()}


def test_table_is_compacted_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = small_table(spark, path)
    before = versions.latest(spark, path)
    log = {r.part: r for r in C.compact_table(spark, path, ["name"], "id").log.collect()}
    assert set(log) == {"0", "1"}  # bucket 2 is one file already
    assert all(r.n_target_files == 1 and r.files_before > 1 for r in log.values())
    want = kept(df.where("bucket < 2")) | {tuple(r) for r in df.where("bucket = 2").select("id", "name", "bucket").collect()}
    assert rows_of(spark, path) == want and versions.read(spark, path).columns == df.columns
    assert versions.read(spark, path, before).count() == 90  # who reads the version before still has it
    listed = lambda: {r[0]: r.n for r in versions.files(spark, path).groupBy(versions.PART).agg(F.count("*").alias("n")).collect()}
    assert listed() == {"0": 1, "1": 1, "2": 1}
    again = C.compact_table(spark, path, ["name"], "id")
    assert again.log.count() == 0 and again.version.number == 2  # nothing left to do
    assert versions.vacuum(spark, path).number == 3 and rows_of(spark, path) == want and listed() == {"0": 1, "1": 1, "2": 1}


def test_append_before_the_commit_is_a_conflict(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = small_table(spark, path)
    late = lambda: versions.append(spark, path, spark.createDataFrame([(999, "late", 0, 0)], df.schema), "bucket")
    with pytest.raises(C.CompactionConflict):
        C.compact_table(spark, path, ["name"], "id", before_commit=late)
    assert versions.read(spark, path).count() == 91  # nothing lost, nothing rewritten
    C.compact_table(spark, path, ["name"], "id", pick_copies=True)
    assert (999, "late", 0) in rows_of(spark, path)


def test_of_two_compactors_one_is_refused(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = small_table(spark, path)
    with pytest.raises(C.CompactionConflict):
        C.compact_table(spark, path, ["name"], "id", pick_copies=True, before_commit=lambda: C.compact_table(spark, path, ["name"], "id", pick_copies=True))
    assert rows_of(spark, path) == kept(df)


def test_odd_partition_values(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    values = ["a/b:c", "x%41y", "é +1", "", None, "007", "{q}"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values * 2)], "id int, p string")
    for _ in range(2):
        versions.append(spark, path, df.repartition(2), "p")
    done = C.compact_table(spark, path, ["p"], "id")
    assert {r.part for r in done.log.collect()} == {v or "" for v in values}
    assert sorted((r.id, r.p) for r in versions.read(spark, path).collect() if r.p is not None) == [(i, v) for i, v in enumerate(values) if v is not None for _ in range(2)]
    assert versions.read(spark, path).where("p is null").count() == 4
    versions.vacuum(spark, path)
    assert versions.read(spark, path).count() == 16 and versions.files(spark, path).select(versions.BATCH).distinct().count() == 1


def test_large_partition_gets_several_files(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    small_table(spark, path)
    log = C.compact_table(spark, path, ["name"], "id", target_bytes=4000, min_small_files=2).log.collect()
    assert {r.n_target_files > 1 for r in log} == {True}
    got = {r[0]: r.n for r in versions.files(spark, path).groupBy(versions.PART).agg(F.count("*").alias("n")).collect()}
    assert all(1 < got[r.part] <= r.n_target_files for r in log)


def test_copies_of_large_files_are_found(spark, tmp_path):
    rows = [(1, "a/s1.npy", "c", "s1.npy", [2, 2], [1, 2, 1], 900), (2, "b/s1.npy", "c", "s1.npy", [2, 2], [1, 2, 1], 900)]
    files(spark, rows).withColumn("written_at", F.lit(None).cast("timestamp_ntz")).write.parquet(f"file://{tmp_path}/gts.parquet")
    spark.createDataFrame([("s1.npy", "c")], "slice_name string, case_id string").write.parquet(f"file://{tmp_path}/manifest.parquet")
    spark.createDataFrame([("storage.target_file_bytes", "100")], "param string, param_text string").write.parquet(f"file://{tmp_path}/default_config.parquet")
    assert [tuple(r) for r in datawork.p2_found(spark, str(tmp_path)).collect()] == [(1, 2)]
    assert datawork.p2_partitions(spark, str(tmp_path)).count() == 0


def test_copies_alone_make_a_partition_due(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = small_table(spark, path)
    log = {r.part: r for r in C.compact_table(spark, path, ["name"], "id", pick_copies=True).log.collect()}
    assert set(log) == {"0", "1", "2"} and log["2"].files_before == 1 and log["2"].copies_dropped > 0
    assert rows_of(spark, path) == kept(df)
    assert C.compact_table(spark, path, ["name"], "id", pick_copies=True).log.count() == 0
