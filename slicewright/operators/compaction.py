"""Far too many small files: compact only the partitions that need it, once and safely.

The table is a versioned one (``sources.versions``). ``compact_table``

1. takes a snapshot: the latest version with its data files and their sizes, from the listing alone;
2. picks the partitions with too many small files, and with ``pick_copies`` those with records held twice;
3. finds the copies in them: of the records of one key the first stays, and the log of copies names the others;
4. rewrites only these partitions, near the target size, each record once, by dynamic partition overwrite into
   a batch of its own, which no reader sees yet;
5. checks that no record is missing, and commits the batch in place of the old directories. If any version was
   committed since the snapshot, it stops with ``CompactionConflict`` and the table is as it was.

No list of files or records is collected: listings are DataFrames, only counts reach the driver.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewright.session import materialize
from slicewright.sources import versions
from slicewright.sources.versions import BATCH, FILE, PART

DEFAULT_TARGET = 134_217_728


class CompactionConflict(RuntimeError):
    """The table changed between snapshot and commit, or the rewritten records aren't those of the snapshot."""


@dataclass
class Compaction:
    """``log``: a row for each rewritten partition; ``copies``: kept, dropped of each record left out; ``version``: the table after it."""

    log: DataFrame
    copies: DataFrame
    version: versions.Version


def record_name(slice_name: Column, file_path: Column) -> Column:
    """slice_name without surrounding spaces; if null or blank, the last component of file_path; else null."""
    named = F.trim(slice_name)
    last = F.regexp_extract(file_path, r"([^/\\]*)$", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(last, F.lit("")))


def mask_digest(counts: str, mask_hw: str) -> Column:
    """A 128-bit digest of the decoded pixels of a column-major run-length mask, with the number of pixels.

    A mask is fixed by the pixel offsets at which the value flips. The digest is the XOR over all run
    ends of a hash of the offset, so a run of length zero, which flips twice at one offset, cancels out,
    and any two encodings of the same pixels agree. Offsets at or beyond the last pixel don't count, nor does the
    end of a last run of zeros: pixels that the runs leave out are zero.
    Null when counts or mask_hw is null. One linear pass, in the JVM.
    """
    end = f"s.p + coalesce(c, 0) < {mask_hw}[0] * {mask_hw}[1] and (s.i % 2 = 1 or s.i < size({counts}) - 1)"
    return F.expr(
        f"""aggregate({counts},
              named_struct('p', 0L, 'i', 0, 'a', 0L, 'b', 0L),
              (s, c) -> named_struct(
                'p', s.p + coalesce(c, 0),
                'i', s.i + 1,
                'a', s.a ^ if({end}, xxhash64(s.p + coalesce(c, 0)), 0L),
                'b', s.b ^ if({end}, xxhash64(s.p + coalesce(c, 0), 'mask'), 0L)),
              s -> if({mask_hw} is null, null, named_struct('h', {mask_hw}[0], 'w', {mask_hw}[1], 'a', s.a, 'b', s.b)))"""
    )


def filed_masks(files: DataFrame, slices: DataFrame) -> DataFrame:
    """``files`` with ``name``, ``part`` and ``digest``: where each small mask file belongs.

    ``files``: file_id, file_path, case_id, slice_name, mask_hw, counts and others; ``slices``: slice_name, case_id. A
    file is filed under the case of its slice, whatever its own case_id says, so copies of one record meet in one
    partition; a name no slice has is filed under ``unfiled``. Columns of these names are replaced.
    """
    own = files.drop("name", "part", "digest")
    named = own.select("*", record_name(F.col("slice_name"), F.col("file_path")).alias("name"), mask_digest("counts", "mask_hw").alias("digest"))
    filed = slices.where(F.col("slice_name").isNotNull()).groupBy(F.trim("slice_name").alias("name")).agg(F.min(F.trim("case_id")).alias("part"))
    return named.join(filed, "name", "left").withColumn("part", F.coalesce("part", F.lit("unfiled")))


def small_file_counts(filed: DataFrame, min_small_files: int = 2, target_bytes: int = DEFAULT_TARGET) -> DataFrame:
    """part, n_files, n_small, bytes of the cases with at least ``min_small_files`` files under the target; a null size counts as small."""
    small = F.col("size_bytes").isNull() | (F.col("size_bytes") < target_bytes)
    stats = filed.groupBy("part").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(small).alias("n_small"), F.sum("size_bytes").alias("bytes"))
    return stats.where(F.col("n_small") >= min_small_files)


def lay_out(filed: DataFrame, path: str, target_bytes: int = DEFAULT_TARGET) -> versions.Version:
    """Write filed masks as a versioned table of small files, partitioned by ``bucket``, a hash of the case.

    There are as many buckets as the records fill files of the target size: a file a case would leave files as
    small as they were.
    """
    spark = filed.sparkSession
    stored = filed.agg(F.sum(4 * F.size("counts") + F.length("file_path") + 64)).collect()[0][0] or 0
    bucket = F.pmod(F.xxhash64("part"), F.lit(max(1, round(stored / target_bytes)))).cast("int")
    return versions.append(spark, path, filed.withColumn("bucket", bucket), "bucket")


def _whole(key: list[str]) -> Column:
    out = F.lit(True)
    for c in key:
        out = out & F.col(c).isNotNull()
    return out


def copies_of(rows: DataFrame, key: list[str], ident: str) -> DataFrame:
    """PART, kept, dropped: of the rows of a partition with the same key the first by ``ident`` is kept. Keys with a null have no copies.

    Only keys and ids are shuffled, folded to the first id of each key before that; a key with many copies is met by
    a join, which may be split, and is never gathered.
    """
    keyed = rows.where(_whole(key) & F.col(ident).isNotNull()).select(PART, *key, ident)
    first = keyed.groupBy(PART, *key).agg(F.min(ident).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return keyed.join(first, [PART, *key]).where(F.col(ident) != F.col("kept")).select(PART, "kept", F.col(ident).alias("dropped"))


def pairs_of(copies: DataFrame, a: str = "file_id_a", b: str = "file_id_b") -> DataFrame:
    """Pairs a < b of records that are the same, from the log of copies.

    One row per pair is asked for, so a record written k times gives k (k - 1) / 2 rows.
    """
    first = copies.select(F.col("kept").alias(a), F.col("dropped").alias(b))
    left, right = copies.alias("l"), copies.alias("r")
    rest = left.join(right, (F.col("l.kept") == F.col("r.kept")) & (F.col("l.dropped") < F.col("r.dropped")))
    return first.unionByName(rest.select(F.col("l.dropped").alias(a), F.col("r.dropped").alias(b)))


def compact_table(
    spark: SparkSession,
    path: str,
    key: list[str],
    ident: str,
    target_bytes: int = DEFAULT_TARGET,
    min_small_files: int = 2,
    before_commit=None,
    pick_copies: bool = False,
) -> Compaction:
    """Compact the partitions of a versioned table that have at least ``min_small_files`` files under half the target.

    ``key``: columns that make two rows the same record; ``ident``: tells rows apart. Rows with a null in ``key`` or
    ``ident`` are never taken for copies. The log has part, files_before, bytes_before, rows_before, rows_after,
    copies_dropped, n_target_files. A table without such a partition is left as it is, under its version.
    ``pick_copies``: also partitions that hold a record twice, whatever the sizes of their files.
    ``before_commit``: called between writing and commit (for tests).
    """
    base = versions.latest(spark, path)
    per = versions.files(spark, path, base).groupBy(PART).agg(F.count(F.lit(1)).alias("files_before"), F.count_if(F.col("bytes") < target_bytes // 2).alias("n_small"), F.sum("bytes").alias("bytes_before"))
    due = F.col("n_small") >= min_small_files
    table = versions.read(spark, path, base, parts=True)
    twice = None
    if pick_copies:
        twice = materialize(copies_of(table, key, ident), "copies")
        per = per.join(twice.groupBy(PART).agg(F.count(F.lit(1)).alias("twice")), PART, "left")
        due = due | F.col("twice").isNotNull()
    picked = materialize(per.where(due).select(PART, "files_before", "bytes_before", F.ceil(F.col("bytes_before") / target_bytes).cast("int").alias("n_target_files")), "picked")
    rows = table.join(picked.select(PART, F.col("n_target_files").alias("_files")), PART)
    # with pick_copies every partition with a copy is picked, so the copies are those found before
    copies = twice if pick_copies else materialize(copies_of(rows, key, ident), "copies")
    kept = rows.drop(BATCH).join(copies.select(PART, F.col("dropped").alias(ident)), [PART, ident], "left_anti")
    # rows go by target file, so a hot partition is spread over as many tasks as it has files
    kept = kept.withColumn(FILE, F.pmod(F.xxhash64(*key, ident), F.col("_files")).cast("int")).drop("_files").repartition(PART, FILE)
    token = uuid.uuid4().hex
    versions.write_batch(kept, path, token)
    counted = lambda df, n: df.groupBy(PART).agg(F.count(F.lit(1)).alias(n))
    written = versions.read(spark, path, versions.Version(path, 0, [token], None, base.schema), parts=True)
    log = picked.join(counted(rows, "rows_before"), PART).join(counted(written, "rows_after"), PART, "left").join(counted(copies, "copies_dropped"), PART, "left").na.fill(0, ["rows_after", "copies_dropped"])
    log = materialize(log, "log")
    if not log.where("rows_after + copies_dropped <> rows_before").isEmpty():
        raise CompactionConflict(f"the rewritten records aren't those of version {base.number}")
    version = base
    if not log.isEmpty():
        old = versions.files(spark, path, base).select(BATCH, PART).distinct().join(picked, PART, "left_semi")
        dead = old.unionByName(spark.read.parquet(base.dead)) if base.dead else old
        dead = materialize(dead, "dead", f"{path}/dead/{token}")
        if before_commit:
            before_commit()
        try:
            version = versions.commit(spark, path, base, [*base.batches, token], dead._slicewright_path, base.schema)
        except versions.VersionConflict as e:
            raise CompactionConflict(f"the table changed after version {base.number}") from e
    out = log.select(F.col(PART).alias("part"), "files_before", "bytes_before", "rows_before", "rows_after", "copies_dropped", "n_target_files")
    return Compaction(out, copies.select("kept", "dropped"), version)
