"""The queries of problems 2, 3 and 6, with production parameters over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewright.operators import compaction, drift, orphans
from slicewright.session import config_value, materialize, new_table_path, share_package, table
from slicewright.sources import versions


def _target(spark: SparkSession, d: str) -> int:
    return int(config_value(spark, d, "storage.target_file_bytes", str(compaction.DEFAULT_TARGET)))


def _compacted(spark: SparkSession, d: str) -> compaction.Compaction:
    """The mask files, laid out by case as a table of many small files, and compacted."""
    gts = table(spark, d, "gts").select("file_id", "file_path", "case_id", "slice_name", "mask_hw", "counts", "size_bytes", "written_at")
    path = new_table_path(spark, "gts-small-files")
    compaction.lay_out(compaction.filed_masks(gts, table(spark, d, "manifest")), path, _target(spark, d))
    return compaction.compact_table(spark, path, ["name", "digest"], "file_id", target_bytes=_target(spark, d), pick_copies=True)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The copies that compaction drops, each with all others of its record."""
    return compaction.pairs_of(_compacted(spark, d).copies)


def p2_partitions(spark: SparkSession, d: str) -> DataFrame:
    """The cases with too many small files."""
    return compaction.small_file_counts(compaction.filed_masks(table(spark, d, "gts"), table(spark, d, "manifest")), target_bytes=_target(spark, d))


def p2_compaction(spark: SparkSession, d: str) -> DataFrame:
    """The log of the rewrite: files, bytes and records of each partition before and after."""
    return _compacted(spark, d).log


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """Per case the records of the compacted table, read back: each record once."""
    version = _compacted(spark, d).version
    return versions.read(spark, version.path, version).groupBy("part").agg(F.count(F.lit(1)).alias("n_records"), F.sum("file_id").alias("sum_ids"), F.sum(F.size("counts")).cast("bigint").alias("n_runs"))


def _p3(spark: SparkSession, d: str) -> DataFrame:
    geometry = table(spark, d, "geometry_meta").select("slice_name", "written_at", F.col("native_to_teacher").isNotNull().alias("has"))
    prompts = table(spark, d, "prompts_train").select("slice_name", "written_at", F.exists("instances.bbox_teacher", lambda b: b.isNotNull()).alias("has"))
    return orphans.orphan_cascade(
        [
            orphans.Node("manifest", table(spark, d, "manifest").select("slice_name", "ingested_at", "deleted_at"), "slice_name", "ingested_at", "deleted_at"),
            orphans.Node("geometry_meta", geometry, "slice_name", "written_at", parent="manifest", refers="has", serves="has"),
            orphans.Node("score_box_pool", table(spark, d, "score_box_pool").select("slice_name", "scored_at"), "slice_name", "scored_at", parent="manifest"),
            orphans.Node("prompts_train", prompts, "slice_name", "written_at", parent="geometry_meta", refers="has"),
        ]
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    direct = _p3(spark, d).where("kind = 'direct'")
    return direct.select("ref_table", F.date_format("t", "yyyy-MM").alias("ref_month"), F.col("key").alias("slice_name"), "ref_state").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans per table and month."""
    return orphans.orphan_report(_p3(spark, d).distinct())


def _p6(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    share_package(spark)
    raw = table(spark, d, "manifest_raw")
    profiles = materialize(drift.profile_fields(raw), "profiles")
    return raw, profiles, drift.match_columns(profiles, drift.file_pairs(raw))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The changes that the matching of each file's columns with those of the file before it shows."""
    return drift.field_changes(_p6(spark, d)[2]).select("file_id", "field_name", "change_kind")


def p6_changes(spark: SparkSession, d: str) -> DataFrame:
    """Every change; a removed and an added field that match are told as one rename."""
    matched = materialize(_p6(spark, d)[2], "matched")
    kinds = lambda n: F.array_join(n, ", ").alias(n)
    told = F.coalesce((F.col("old_name") != F.col("new_name")) & (F.col("score") >= drift.LEAST_SCORE), F.lit(False))
    renames = matched.where(told).select("file_id", F.concat_ws(" > ", "old_name", "new_name").alias("field_name"), F.lit("rename").alias("change_kind"), kinds("old_kinds"), kinds("new_kinds"))
    return drift.field_changes(matched.where(~told)).select("file_id", "field_name", "change_kind", kinds("old_kinds"), kinds("new_kinds")).unionByName(renames)


MANIFEST_FIELDS = {
    "slice_name": "string", "dataset_name": "string", "case_id": "string", "patient_id": "string", "split": "string", "slice_idx": "int", "has_fg": "boolean", "native_gt": "string", "orig_h": "int", "orig_w": "int",
    "spacing": "array<double>", "spacing_xyz": "array<double>", "spacing_zyx": "array<double>",
}


def p6_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The raw lines as one consistent manifest, renamed fields under their canonical name; ``other_fields`` holds all that have no column."""
    raw, profiles, matched = _p6(spark, d)
    names = drift.canonical_names(drift.match_renames(matched), profiles, list(MANIFEST_FIELDS))
    return drift.wide(drift.unify(raw, names), MANIFEST_FIELDS)


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per file the lines of the unified manifest, and the values of all its columns and of ``other_fields``: as many as the raw lines have."""
    out = p6_manifest(spark, d)
    held = sum((F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in MANIFEST_FIELDS), F.size("other_fields"))
    same = F.col("slice_name").isNotNull() & (F.col("slice_name") != "")
    return out.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(held).cast("bigint").alias("n_values"), F.count_if(same).alias("n_named"), F.count_if(F.col("has_fg")).alias("n_foreground"))


QUERIES = {
    "p2_found": p2_found,
    "p2_partitions": p2_partitions,
    "p2_compaction": p2_compaction,
    "p2_records": p2_records,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p6_found": p6_found,
    "p6_changes": p6_changes,
    "p6_manifest": p6_manifest,
    "p6_kept": p6_kept,
}

#: Canonical masks in SQL: the offsets at which the value flips an odd number of times.
_GTS_KEYED = """
named AS (SELECT file_id, coalesce(nullif(trim(slice_name), ''), nullif(regexp_extract(file_path, '([^/\\\\]*)$', 1), '')) AS name, mask_hw, counts FROM gts),
runs AS (SELECT file_id, unnest(counts) AS c, generate_subscripts(counts, 1) AS i FROM named),
ends AS (SELECT file_id, sum(c) OVER (PARTITION BY file_id ORDER BY i) AS p FROM runs),
flips AS (SELECT file_id, p FROM ends GROUP BY file_id, p HAVING count(*) % 2 = 1),
inside AS (SELECT f.file_id, list(p ORDER BY p) AS flips FROM flips f JOIN named n USING (file_id) WHERE p < mask_hw[1]::BIGINT * mask_hw[2] GROUP BY f.file_id),
keyed AS (SELECT n.file_id, name, mask_hw, coalesce(flips, []) AS flips FROM named n LEFT JOIN inside i USING (file_id) WHERE counts IS NOT NULL AND mask_hw IS NOT NULL AND name IS NOT NULL)
"""

_FILED = """
named AS (SELECT file_id, coalesce(nullif(trim(slice_name), ''), nullif(regexp_extract(file_path, '([^/\\\\]*)$', 1), '')) AS name, size_bytes FROM gts),
filed AS (SELECT trim(slice_name) AS name, min(trim(case_id)) AS part FROM manifest WHERE slice_name IS NOT NULL GROUP BY 1)
"""

_P3_SQL = """
m AS (SELECT slice_name AS k, ingested_at AS b, deleted_at AS e FROM manifest),
g AS (SELECT slice_name AS k, written_at AS b FROM geometry_meta WHERE native_to_teacher IS NOT NULL),
refs AS (
  SELECT 'geometry_meta' AS ref_table, k AS slice_name, b AS t FROM g
  UNION SELECT 'score_box_pool', slice_name, scored_at FROM score_box_pool
  UNION SELECT 'prompts_train', slice_name, written_at FROM prompts_train WHERE len(list_filter(instances, lambda x: x.bbox_teacher IS NOT NULL)) > 0),
targets AS (SELECT 'm' AS side, k, b, e FROM m UNION ALL SELECT 'g', k, b, NULL FROM g),
joined AS (
  SELECT r.ref_table, r.slice_name, r.t, count(x.k) AS n, count(*) FILTER (WHERE x.b <= r.t) AS begun,
         count(*) FILTER (WHERE x.b <= r.t AND (x.e IS NULL OR x.e > r.t)) AS there
  FROM refs r LEFT JOIN targets x ON x.k = r.slice_name AND x.side = CASE WHEN r.ref_table = 'prompts_train' THEN 'g' ELSE 'm' END
  WHERE r.slice_name IS NOT NULL AND r.t IS NOT NULL GROUP BY ALL),
direct AS (SELECT *, CASE WHEN n = 0 THEN 'absent' WHEN begun = 0 THEN 'late' ELSE 'deleted' END AS ref_state FROM joined WHERE there = 0)
"""

_P6_KIND = """
CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number'
  WHEN 'HUGEINT' THEN 'number' WHEN 'UHUGEINT' THEN 'number' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL
  ELSE CASE WHEN len(e) > 0 AND len(list_filter(e, lambda x: json_type(x) = 'VARCHAR')) = len(e) THEN 'array of strings'
            WHEN len(e) > 0 AND len(list_filter(e, lambda x: json_type(x) IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT'))) = len(e) THEN 'array of numbers' ELSE 'array' END END
"""

ORACLES = {
    "p2_found": f"WITH {_GTS_KEYED} SELECT a.file_id AS file_id_a, b.file_id AS file_id_b FROM keyed a JOIN keyed b ON a.name = b.name AND a.mask_hw = b.mask_hw AND a.flips = b.flips AND a.file_id < b.file_id",
    "p2_partitions": f"""WITH {_FILED}, s AS (SELECT coalesce(part, 'unfiled') AS part, size_bytes FROM named LEFT JOIN filed USING (name))
SELECT part, count(*)::BIGINT AS n_files, count(*) FILTER (WHERE size_bytes IS NULL OR size_bytes < t)::BIGINT AS n_small, sum(size_bytes)::BIGINT AS bytes
FROM s, (SELECT param_text::BIGINT AS t FROM default_config WHERE param = 'storage.target_file_bytes') GROUP BY part HAVING n_small >= 2""",
    "p2_records": f"""WITH {_GTS_KEYED}, filed AS (SELECT trim(slice_name) AS name, min(trim(case_id)) AS part FROM manifest WHERE slice_name IS NOT NULL GROUP BY 1),
once AS (SELECT min(file_id) AS file_id FROM keyed GROUP BY name, mask_hw, flips UNION ALL SELECT file_id FROM named WHERE counts IS NULL OR mask_hw IS NULL OR name IS NULL)
SELECT coalesce(part, 'unfiled') AS part, count(*)::BIGINT AS n_records, sum(file_id)::BIGINT AS sum_ids, sum(len(counts))::BIGINT AS n_runs FROM once JOIN named USING (file_id) LEFT JOIN filed USING (name) GROUP BY 1""",
    "p3_found": f"WITH {_P3_SQL} SELECT DISTINCT ref_table, strftime(t, '%Y-%m') AS ref_month, slice_name, ref_state FROM direct",
    "p3_report": f"""WITH {_P3_SQL},
bad AS (SELECT DISTINCT slice_name AS k, t AS b FROM direct WHERE ref_table = 'geometry_meta'),
sound AS (SELECT g.k, g.b FROM g ANTI JOIN bad ON g.k = bad.k AND g.b = bad.b),
inherited AS (
  SELECT ref_table, slice_name, t, 'unsound' AS ref_state FROM joined j WHERE ref_table = 'prompts_train' AND there > 0
  AND NOT EXISTS (SELECT 1 FROM sound s WHERE s.k = j.slice_name AND s.b <= j.t)),
every AS (SELECT ref_table, slice_name, t, ref_state, 'direct' AS kind FROM direct UNION ALL SELECT ref_table, slice_name, t, ref_state, 'inherited' FROM inherited)
SELECT ref_table, strftime(t, '%Y-%m') AS ref_month, kind, ref_state, count(*)::BIGINT AS n_refs, count(DISTINCT slice_name)::BIGINT AS n_keys FROM every GROUP BY ALL""",
    "p6_found": f"""WITH ok AS (SELECT file_id, payload::JSON AS p FROM manifest_raw WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
cells AS (SELECT file_id, unnest(json_keys(p)) AS field_name, p FROM ok),
vals AS (SELECT file_id, field_name, json_extract(p, '$."' || field_name || '"') AS v FROM cells),
kinds AS (SELECT file_id, field_name, {_P6_KIND} AS kind FROM (SELECT *, CASE WHEN json_type(v) = 'ARRAY' THEN v::JSON[] END AS e FROM vals)),
prof AS (SELECT file_id, field_name, coalesce(list_sort(list(DISTINCT kind) FILTER (WHERE kind IS NOT NULL)), []) AS kinds FROM kinds GROUP BY ALL),
files AS (SELECT DISTINCT file_id, dataset_name, fold, file_seq FROM manifest_raw),
pairs AS (SELECT file_id, lag(file_id) OVER (PARTITION BY dataset_name, fold ORDER BY file_seq, file_id) AS prev_id FROM files),
new AS (SELECT q.file_id, field_name, kinds FROM pairs q JOIN prof USING (file_id) WHERE prev_id IS NOT NULL),
old AS (SELECT q.file_id, field_name, kinds FROM pairs q JOIN prof f ON f.file_id = q.prev_id),
both_sides AS (SELECT coalesce(n.file_id, o.file_id) AS file_id, coalesce(n.field_name, o.field_name) AS field_name, n.kinds AS nk, o.kinds AS ok FROM new n FULL JOIN old o ON n.file_id = o.file_id AND n.field_name = o.field_name),
told AS (SELECT file_id, field_name, CASE WHEN ok IS NULL THEN 'added' WHEN nk IS NULL THEN 'removed' WHEN len(nk) > 0 AND len(ok) > 0 AND nk <> ok THEN 'type' END AS change_kind FROM both_sides)
SELECT file_id, field_name, change_kind FROM told WHERE change_kind IS NOT NULL""",
    "p6_kept": """WITH ok AS (SELECT DISTINCT file_id, payload FROM manifest_raw WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
n AS (SELECT file_id, payload, len(list_filter(json_keys(payload), lambda k: json_type(json_extract(payload, '$."' || k || '"')) <> 'NULL')) AS n FROM ok)
SELECT file_id, count(*) AS n_lines, sum(n)::BIGINT AS n_values, count(*) FILTER (WHERE payload ->> '$.slice_name' <> '') AS n_named,
  count(*) FILTER (WHERE lower(payload ->> '$.has_fg') IN ('true', 'yes', 'y', '1')) AS n_foreground FROM n GROUP BY file_id""",
}
