"""Queries over the scalar functions: names, times, numbers, boxes, geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewright.functions import box, clock, number, text
from slicewright.session import table

c = F.col


def names(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "gts").where("file_path is not null")
    p = c("file_path")
    return df.select("file_id", text.base_name(p).alias("base"), text.safe_stem(p).alias("stem"), text.copy_suffix(p).alias("suffix"), text.sanitize_id(p).alias("sane"), text.norm_name(c("case_id")).alias("normed"), text.safe_tag(text.base_name(p)).alias("tag"), text.safe_file_name(c("slice_name")).alias("safe"))


def sample_names(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "manifest").where("split is not null and case_id is not null").select(F.lower(F.trim("split")).alias("s"), F.trim("case_id").alias("c"), "slice_idx").distinct()
    return df.select(text.sample_name(c("s"), c("c"), c("slice_idx")).alias("name"), "slice_idx")


def pair_ids(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "prompts_train").select("slice_name", F.posexplode("instances").alias("k", "i"))
    return df.select(text.pair_id(c("slice_name"), c("k"), c("i.component_id")).alias("pair_id"), c("i.label_id").alias("label_id")).distinct()


def key_parts(spark: SparkSession, d: str) -> DataFrame:
    """Case number and slice number cut out of names by pattern."""
    df = table(spark, d, "manifest").where("slice_name is not null").select("slice_name").distinct()
    return df.select("slice_name", text.key_part(c("slice_name"), r"_(\d{8})").alias("case_no"), text.key_part(c("slice_name"), r"__z(\d+)").cast("int").alias("z"), text.class_from_suffix(text.safe_stem(c("slice_name"))).alias("kind"))


def comma_lists(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part")
    return df.select("p_partkey", F.array_join(text.parse_list(F.concat_ws(" , ", "p_name", F.lit(""), "p_type")), "|").alias("items"), text.html_escape(F.concat(F.lit("<b class='x'>"), "p_name", F.lit("&\"</b>"))).alias("html"))


def times(spark: SparkSession, d: str) -> DataFrame:
    """Elapsed time and progress of event pairs, with their clock forms; and ISO text parsed, or null."""
    df = table(spark, d, "events")
    base = F.to_timestamp_ntz(F.lit("2024-01-02 00:00:00"))
    secs = clock.elapsed_seconds(base, c("ts"))
    iso = F.when(c("event_id") % 7 == 0, F.lit("not a time")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(c("event_id") % 2 == 0, "Z").otherwise("+02:00")))
    return df.select(
        "event_id", F.round(secs, 3).alias("secs"), clock.clock(secs).alias("clock"), clock.clock_millis(F.round(secs, 3)).alias("millis"),
        clock.percent(c("event_id") % 100, c("user_id") % 40).alias("pct"), F.unix_seconds(clock.parse_iso(iso)).alias("parsed"),
    )


def probabilities(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "score_box_pool").where("num_instances > 0")
    raw = F.when(F.isnan("image_min_iou"), F.lit(float("nan"))).otherwise(c("image_min_iou") * 2 - 0.5)
    return df.select("slice_name", "round", F.round(number.sigmoid((c("image_macro_iou") - 0.5) * 100), 6).alias("p"), F.round(number.clean_probability(raw), 6).alias("clean"), number.safe_double(F.concat(c("num_instances").cast("string"), F.when(c("round") % 2 == 0, "x").otherwise("")), -1.0).alias("safe")).where("not isnan(p)").distinct()


def budgets(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "manifest").groupBy("dataset_name", "fold").agg(F.count_distinct("case_id").alias("n"))
    n = c("n")
    return df.select("dataset_name", "fold", "n", number.quota_2d(n).alias("quota_2d"), number.cap_2d(n).alias("cap_2d"), number.quota_3d(n).alias("quota_3d"), number.cap_3d(n).alias("cap_3d"), number.nearest_budget(n).alias("nearest"))


#: Moves values off the ties of rounding, where engines differ.
NUDGE = 1e-7


def _flat(b, prefix: str) -> list:
    return [F.round(F.get(b, F.lit(i)) + NUDGE, 4).alias(f"{prefix}{k}") for i, k in enumerate(("x1", "y1", "x2", "y2"))]


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Instance boxes beside the transform of their slice (its first writing)."""
    p = table(spark, d, "prompts_train").select("slice_name", F.posexplode("instances").alias("k", "i")).select("slice_name", "k", c("i.bbox_native").alias("nb"), c("i.bbox_teacher").alias("tb"), c("i.component_id").alias("cc")).where("nb is not null").distinct()
    g = table(spark, d, "geometry_meta").where("native_to_teacher is not null").groupBy("slice_name").agg(F.min(F.struct("written_at", F.col("native_hw")[0].alias("nh"), F.col("native_hw")[1].alias("nw"), F.col("teacher_to_native.crop_h").alias("crop_h"), F.col("teacher_to_native.crop_w").alias("crop_w"), "native_to_teacher.orig_h", "native_to_teacher.orig_w", "native_to_teacher.target_h", "native_to_teacher.target_w", "native_to_teacher.scale_x", "native_to_teacher.scale_y", "native_to_teacher.offset_x", "native_to_teacher.offset_y")).alias("g"))
    return p.join(g, "slice_name")


def _sizes():
    return box.geometry_sizes(F.array("g.nh", "g.nw"), F.col("g"), F.array("g.target_h", "g.target_w"))


def boxes_to_teacher(spark: SparkSession, d: str) -> DataFrame:
    df = _boxes(spark, d).withColumn("t", box.native_to_teacher(c("nb"), c("g")))
    return df.select("slice_name", "k", "cc", *_flat(c("nb"), "n"), *_flat(c("t"), "t")).distinct()


def boxes_to_native(spark: SparkSession, d: str) -> DataFrame:
    df = _boxes(spark, d).where("tb is not null").withColumn("back", box.teacher_to_native(c("tb"), _sizes()))
    return df.select("slice_name", "k", "cc", *_flat(c("tb"), "t"), *_flat(c("back"), "n")).distinct()


def box_clip(spark: SparkSession, d: str) -> DataFrame:
    """Boxes clipped into half the image, and the same as x, y, width, height, widened, and on a 1024 square."""
    h, w = F.floor(c("g.orig_h") / 2), F.floor(c("g.orig_w") / 2)
    # a column of its own, so that the functions of the box don't each carry its expression
    df = _boxes(spark, d).withColumn("b", box.clip_box(c("nb"), w, h))
    b = c("b")
    return df.select("slice_name", "k", "cc", *_flat(c("nb"), "n"), *_flat(b, "c"), *_flat(box.xyxy_to_xywh(b), "s"), *_flat(box.slack_box(b, 5, w, h), "k"), *_flat(box.to_side(b, c("g.orig_w"), c("g.orig_h")), "u")).distinct()


def box_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of each instance's native box, moved forth and back, with itself; and whether it is near a crop's edge."""
    df = _boxes(spark, d).where("tb is not null").withColumn("back", box.teacher_to_native(c("tb"), _sizes()))
    df = df.withColumn("moved", box.uncrop_box(c("nb"), F.array(F.lit(10.0), F.lit(20.0))))
    crop = F.array(F.lit(100.0), F.lit(100.0), F.lit(300.0), F.lit(300.0))
    return df.select("slice_name", "k", "cc", *_flat(c("nb"), "n"), F.round(box.box_iou(c("nb"), c("back")), 4).alias("iou"), box.near_crop_edge(c("moved"), crop, c("g.orig_h"), c("g.orig_w")).alias("edge")).distinct()


def points(spark: SparkSession, d: str) -> DataFrame:
    """Centres of instances clipped into 400 x 300 and moved to an image whose longest side is 1024."""
    p = table(spark, d, "prompts_train").select("slice_name", F.posexplode("instances").alias("k", "i")).select("slice_name", "k", F.array("i.centroid_native").alias("p")).where("p[0] is not null").distinct()
    clipped = p.withColumn("q", box.clip_points(c("p"), F.lit(400), F.lit(300)))
    shape = box.longest_side_shape(F.lit(300), F.lit(400), 1024)
    moved = clipped.withColumn("m", box.scale_points(c("q"), F.lit(300), F.lit(400), shape["new_h"], shape["new_w"]))
    r = lambda n, i: F.round(c(n)[0][i] + NUDGE, 4)
    return moved.select("slice_name", "k", r("p", 0).alias("px"), r("q", 0).alias("qx"), r("q", 1).alias("qy"), r("m", 0).alias("mx"), r("m", 1).alias("my")).distinct()


def canvas(spark: SparkSession, d: str) -> DataFrame:
    """Canvas geometry from sizes alone, with its inverse, against what was written."""
    df = table(spark, d, "geometry_meta").where("native_to_teacher is not null").select("slice_name", "native_to_teacher").distinct()
    t = c("native_to_teacher")
    g = box.canvas_geometry(t["orig_h"], t["orig_w"], t["target_h"], t["target_w"])
    wrong = F.array_join(box.geometry_mismatch(g, t, ("new_h", "new_w", "pad_right", "pad_bottom", "offset_x", "offset_y")), ",")
    inv = box.inverse_geometry(g)
    return df.select("slice_name", g["new_h"].alias("new_h"), g["new_w"].alias("new_w"), g["pad_right"].alias("pad_right"), g["pad_bottom"].alias("pad_bottom"), F.round(g["scale"], 6).alias("scale"), F.round(inv["scale_x"], 6).alias("back_x"), F.round(inv["scale_y"], 6).alias("back_y"), box.longest_side_shape(t["orig_h"], t["orig_w"], 1024)["new_h"].alias("side_h"), wrong.alias("wrong")).distinct()


def spacing(spark: SparkSession, d: str) -> DataFrame:
    """Spacing in z, y, x order with its source."""
    m = table(spark, d, "manifest").where("slice_name is not null").select("slice_name", "ingested_at", "spacing", "spacing_xyz", "spacing_zyx").distinct()
    r = box.resolve_spacing({n: c(n) for n in ("spacing_zyx", "spacing_xyz", "spacing")})
    return m.select("slice_name", "ingested_at", F.array_join(F.transform(r["zyx"], lambda v: F.round(v, 4).cast("string")), ",").alias("zyx"), r["source"].alias("source")).distinct()


def spacing_sources(spark: SparkSession, d: str) -> DataFrame:
    return spacing(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (names, sample_names, pair_ids, key_parts, comma_lists, times, probabilities, budgets, boxes_to_teacher, boxes_to_native, box_clip, box_overlap, points, canvas, spacing, spacing_sources)}
QUERIES = {f"fn_{k}": f for k, f in QUERIES.items()}

_BASE = r"regexp_extract(file_path, '([^/\\]*)$', 1)"

_SQL_BOXES = """
p0 AS (SELECT slice_name, unnest(instances) AS i, generate_subscripts(instances, 1) - 1 AS k FROM prompts_train),
p AS (SELECT DISTINCT slice_name, k::INTEGER AS k, i.bbox_native AS nb, i.bbox_teacher AS tb, i.component_id AS cc FROM p0 WHERE i.bbox_native IS NOT NULL),
g1 AS (SELECT slice_name, written_at, native_to_teacher AS t, native_hw[1] AS nh, native_hw[2] AS nw, teacher_to_native.crop_h AS ch, teacher_to_native.crop_w AS cw FROM geometry_meta WHERE native_to_teacher IS NOT NULL),
g AS (SELECT slice_name, t, nh, nw, coalesce(ch, t.target_h, 1024) AS ch, coalesce(cw, t.target_w, 1024) AS cw FROM (SELECT *, row_number() OVER (PARTITION BY slice_name ORDER BY written_at, nh NULLS FIRST, nw NULLS FIRST, ch NULLS FIRST, cw NULLS FIRST, t.orig_h, t.orig_w, t.target_h, t.target_w, t.scale_x, t.scale_y) AS r FROM g1) WHERE r = 1),
b AS (SELECT p.*, g.* EXCLUDE (slice_name) FROM p JOIN g USING (slice_name))
"""


def _clip_sql(x1: str, y1: str, x2: str, y2: str, w: str, h: str) -> str:
    """Columns cx1..cy2 of a clipped box, as a subselect over the aliases of ``b``."""
    return f"""(SELECT cx1, cy1, CASE WHEN cx2 <= cx1 THEN least({w} - 1.0, cx1 + 1.0) ELSE cx2 END AS cx2, CASE WHEN cy2 <= cy1 THEN least({h} - 1.0, cy1 + 1.0) ELSE cy2 END AS cy2
  FROM (SELECT greatest(0.0, least({w} - 1.0, {x1})) AS cx1, greatest(0.0, least({h} - 1.0, {y1})) AS cy1, greatest(0.0, least({w} - 1.0, {x2})) AS cx2, greatest(0.0, least({h} - 1.0, {y2})) AS cy2))"""


def _rounded(prefix: str, *cols: str) -> str:
    return ", ".join(f"round(({x})::DOUBLE + {NUDGE}::DOUBLE, 4) AS {prefix}{k}" for x, k in zip(cols, ("x1", "y1", "x2", "y2")))


_N = _rounded("n", "nb[1]", "nb[2]", "nb[3]", "nb[4]")
_T = _rounded("t", "tb[1]", "tb[2]", "tb[3]", "tb[4]")
_BACK = _clip_sql("tb[1] * (nw::DOUBLE / greatest(cw, 1))", "tb[2] * (nh::DOUBLE / greatest(ch, 1))", "tb[3] * (nw::DOUBLE / greatest(cw, 1))", "tb[4] * (nh::DOUBLE / greatest(ch, 1))", "nw::DOUBLE", "nh::DOUBLE")
_AREA = "greatest(0.0, {0}[3] - {0}[1] + 1) * greatest(0.0, {0}[4] - {0}[2] + 1)"

ORACLES = {
    "names": rf"""SELECT file_id, {_BASE} AS base,
  CASE WHEN {_BASE} LIKE '%.nii.gz' OR {_BASE} LIKE '%.npy.h5' THEN left({_BASE}, -7) ELSE regexp_replace({_BASE}, '(.)[.][^.]+$', '\1') END AS stem,
  CASE WHEN {_BASE} LIKE '%.nii.gz' THEN '.nii.gz' WHEN {_BASE} LIKE '%.npy.h5' THEN '.h5' ELSE lower(regexp_extract({_BASE}, '.([.][^.]+)$', 1)) END AS suffix,
  regexp_replace(replace(replace(trim(file_path), '/', '_'), '\', '_'), '\s+', '_', 'g') AS sane,
  lower(replace(replace(trim(case_id), '-', '_'), ' ', '_')) AS normed,
  CASE WHEN trim({_BASE}) = '' THEN '' ELSE '_' || regexp_replace(trim({_BASE}), '[^\p{{L}}\p{{N}}_-]', '_', 'g') END AS tag,
  regexp_replace(coalesce(nullif(trim(slice_name), ''), 'unknown'), '[^\p{{L}}\p{{N}}_.-]', '_', 'g') AS safe FROM gts WHERE file_path IS NOT NULL""",
    "sample_names": "SELECT s || '__' || c || CASE WHEN slice_idx IS NULL THEN '' ELSE '__z' || CASE WHEN slice_idx > 999 THEN slice_idx::VARCHAR ELSE lpad(slice_idx::VARCHAR, 3, '0') END END || '.npy' AS name, slice_idx FROM (SELECT DISTINCT lower(trim(split)) AS s, trim(case_id) AS c, slice_idx FROM manifest WHERE split IS NOT NULL AND case_id IS NOT NULL)",
    "pair_ids": r"""SELECT DISTINCT regexp_replace(slice_name, '[.][^.]+$', '') || '__i' || lpad(k::VARCHAR, 3, '0') || '_c' || i.component_id::VARCHAR AS pair_id, i.label_id AS label_id
FROM (SELECT slice_name, unnest(instances) AS i, generate_subscripts(instances, 1) - 1 AS k FROM prompts_train)""",
    "key_parts": r"""SELECT slice_name, nullif(regexp_extract(slice_name, '_(\d{8})', 1), '') AS case_no, nullif(regexp_extract(slice_name, '__z(\d+)', 1), '')::INTEGER AS z,
  CASE WHEN s LIKE '%\_h' ESCAPE '\' THEN 'h' WHEN s LIKE '%\_dr' ESCAPE '\' THEN 'dr' WHEN s LIKE '%\_g' ESCAPE '\' THEN 'g' END AS kind
FROM (SELECT DISTINCT slice_name, regexp_replace(slice_name, '[.][^.]+$', '') AS s FROM manifest WHERE slice_name IS NOT NULL)""",
    "comma_lists": """SELECT p_partkey, p_name || '|' || p_type AS items, replace(replace(replace(replace(replace('<b class=''x''>' || p_name || '&"</b>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html FROM part""",
    "times": """WITH e AS (SELECT *, greatest(0::BIGINT, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-02')) AS us FROM events),
s AS (SELECT *, us // 1000000 AS s, round(us / 1e6, 3) AS secs, floor(round(us / 1e6, 3) * 1000)::BIGINT AS ms FROM e)
SELECT event_id, secs,
  CASE WHEN s >= 3600 THEN CASE WHEN s // 3600 < 100 THEN lpad((s // 3600)::VARCHAR, 2, '0') ELSE (s // 3600)::VARCHAR END || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0')
       ELSE lpad((s // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS clock,
  CASE WHEN ms // 3600000 < 100 THEN lpad((ms // 3600000)::VARCHAR, 2, '0') ELSE (ms // 3600000)::VARCHAR END || ':' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') AS millis,
  CASE WHEN user_id % 40 > 0 THEN round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, (100.0 * (event_id % 100))::DOUBLE / (user_id % 40))), 2) END AS pct,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE epoch(date_trunc('second', ts))::BIGINT - CASE WHEN event_id % 2 = 0 THEN 0 ELSE 7200 END END AS parsed FROM s""",
    "probabilities": """SELECT DISTINCT slice_name, round, p, clean, safe FROM (SELECT slice_name, round, round(1.0 / (1.0 + exp(-greatest(-40.0::DOUBLE, least(40.0::DOUBLE, (image_macro_iou - 0.5) * 100)))), 6) AS p,
  round(CASE WHEN image_min_iou IS NULL OR isnan(image_min_iou) THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, image_min_iou * 2 - 0.5)) END, 6) AS clean,
  CASE WHEN round % 2 = 0 THEN -1.0::DOUBLE ELSE num_instances::DOUBLE END AS safe, image_macro_iou FROM score_box_pool WHERE num_instances > 0) WHERE NOT isnan(p)""",
    "budgets": """SELECT dataset_name, fold, n, least(greatest(1, ceil(n / 100.0)), 5, n)::BIGINT AS quota_2d, least(greatest(1, ceil(n * 5 / 100.0)), 5 * least(greatest(1, ceil(n / 100.0)), 5, n))::BIGINT AS cap_2d,
  least(greatest(ceil(n / 100.0), 5), n)::BIGINT AS quota_3d, greatest(1, ceil(n * 5 / 100.0))::BIGINT AS cap_3d, CASE WHEN n > 0 THEN greatest(1, floor((n * 5 + 50) / 100.0))::BIGINT END AS nearest
FROM (SELECT dataset_name, fold, count(DISTINCT case_id)::BIGINT AS n FROM manifest GROUP BY ALL)""",
    "boxes_to_teacher": f"""WITH {_SQL_BOXES} SELECT DISTINCT slice_name, k, cc, {_N}, {_rounded("t", "cx1", "cy1", "cx2", "cy2")}
FROM b, LATERAL {_clip_sql("nb[1] * t.scale_x + t.offset_x", "nb[2] * t.scale_y + t.offset_y", "nb[3] * t.scale_x + t.offset_x", "nb[4] * t.scale_y + t.offset_y", "t.target_w::DOUBLE", "t.target_h::DOUBLE")} z""",
    "boxes_to_native": f"""WITH {_SQL_BOXES} SELECT DISTINCT slice_name, k, cc, {_T}, {_rounded("n", "cx1", "cy1", "cx2", "cy2")} FROM b, LATERAL {_BACK} z WHERE tb IS NOT NULL""",
    "box_clip": f"""WITH {_SQL_BOXES} SELECT DISTINCT slice_name, k, cc, {_N}, {_rounded("c", "cx1", "cy1", "cx2", "cy2")}, {_rounded("s", "cx1", "cy1", "cx2 - cx1", "cy2 - cy1")},
  {_rounded("k", "greatest(0.0, cx1 - 5)", "greatest(0.0, cy1 - 5)", "least((t.orig_w // 2)::DOUBLE, cx2 + 5)", "least((t.orig_h // 2)::DOUBLE, cy2 + 5)")},
  {_rounded("u", "cx1 / t.orig_w * 1024", "cy1 / t.orig_h * 1024", "cx2 / t.orig_w * 1024", "cy2 / t.orig_h * 1024")}
FROM b, LATERAL {_clip_sql("nb[1]", "nb[2]", "nb[3]", "nb[4]", "(t.orig_w // 2)::DOUBLE", "(t.orig_h // 2)::DOUBLE")} z""",
    "box_overlap": f"""WITH {_SQL_BOXES}, m AS (SELECT b.*, [cx1, cy1, cx2, cy2] AS v FROM b, LATERAL {_BACK} z WHERE tb IS NOT NULL),
o AS (SELECT *, greatest(0.0, least(nb[3], v[3]) - greatest(nb[1], v[1]) + 1) * greatest(0.0, least(nb[4], v[4]) - greatest(nb[2], v[2]) + 1) AS inter, {_AREA.format("nb")} AS an, {_AREA.format("v")} AS av FROM m)
SELECT DISTINCT slice_name, k, cc, {_N}, round(coalesce(inter / nullif(an + av - inter, 0), 0.0)::DOUBLE, 4) AS iou,
  (abs(nb[1] + 10 - 100) <= 20 AND abs(nb[1] + 10) > 20) OR (abs(nb[2] + 20 - 100) <= 20 AND abs(nb[2] + 20) > 20) OR (abs(nb[3] + 10 - 300) <= 20 AND abs(nb[3] + 10 - t.orig_w) > 20) OR (abs(nb[4] + 20 - 300) <= 20 AND abs(nb[4] + 20 - t.orig_h) > 20) AS edge FROM o""",
    "points": f"""WITH p0 AS (SELECT slice_name, unnest(instances) AS i, generate_subscripts(instances, 1) - 1 AS k FROM prompts_train), p AS (SELECT slice_name, k::INTEGER AS k, i.centroid_native[1] AS x, i.centroid_native[2] AS y FROM p0 WHERE i.centroid_native IS NOT NULL),
q AS (SELECT *, greatest(0.0::DOUBLE, least(399.0::DOUBLE, x)) AS qx, greatest(0.0::DOUBLE, least(299.0::DOUBLE, y)) AS qy FROM p)
SELECT DISTINCT slice_name, k, round(x + {NUDGE}::DOUBLE, 4) AS px, round(qx + {NUDGE}::DOUBLE, 4) AS qx, round(qy + {NUDGE}::DOUBLE, 4) AS qy, round(qx * (1024::DOUBLE / 400) + {NUDGE}::DOUBLE, 4) AS mx, round(qy * (768::DOUBLE / 300) + {NUDGE}::DOUBLE, 4) AS my FROM q""",
    "canvas": """WITH g AS (SELECT DISTINCT slice_name, native_to_teacher AS t FROM geometry_meta WHERE native_to_teacher IS NOT NULL),
s AS (SELECT *, least(t.target_h::DOUBLE / greatest(t.orig_h, 1), t.target_w::DOUBLE / greatest(t.orig_w, 1)) AS sc FROM g),
n AS (SELECT *, greatest(round_even(t.orig_h * sc, 0)::INTEGER, 1) AS nh, greatest(round_even(t.orig_w * sc, 0)::INTEGER, 1) AS nw FROM s)
SELECT DISTINCT slice_name, nh AS new_h, nw AS new_w, t.target_w - nw AS pad_right, t.target_h - nh AS pad_bottom, round(sc, 6) AS scale, round(t.orig_w::DOUBLE / greatest(nw, 1), 6) AS back_x, round(t.orig_h::DOUBLE / greatest(nh, 1), 6) AS back_y,
  floor(t.orig_h * (1024.0::DOUBLE / greatest(t.orig_h, t.orig_w)) + 0.5)::INTEGER AS side_h,
  concat_ws(',', CASE WHEN t.new_h IS DISTINCT FROM nh THEN 'new_h' END, CASE WHEN t.new_w IS DISTINCT FROM nw THEN 'new_w' END, CASE WHEN t.pad_right IS DISTINCT FROM t.target_w - nw THEN 'pad_right' END,
    CASE WHEN t.pad_bottom IS DISTINCT FROM t.target_h - nh THEN 'pad_bottom' END, CASE WHEN t.offset_x IS DISTINCT FROM 0 THEN 'offset_x' END, CASE WHEN t.offset_y IS DISTINCT FROM 0 THEN 'offset_y' END) AS wrong FROM n""",
}
_SPACING = """
r AS (SELECT DISTINCT slice_name, ingested_at, CASE WHEN zyx THEN spacing_zyx[1:3] WHEN xyz THEN list_reverse(spacing_xyz[1:3]) WHEN leg THEN list_reverse(spacing[1:3]) END AS v,
  CASE WHEN zyx THEN 'manifest.spacing_zyx' WHEN xyz THEN 'manifest.spacing_xyz' WHEN leg THEN 'manifest.spacing_legacy_xyz' END AS source FROM (SELECT *,
  coalesce(len(spacing_zyx) >= 3 AND len(list_filter(spacing_zyx[1:3], lambda x: x IS NOT NULL AND isfinite(x) AND x > 0)) = 3, false) AS zyx,
  coalesce(len(spacing_xyz) >= 3 AND len(list_filter(spacing_xyz[1:3], lambda x: x IS NOT NULL AND isfinite(x) AND x > 0)) = 3, false) AS xyz,
  coalesce(len(spacing) >= 3 AND len(list_filter(spacing[1:3], lambda x: x IS NOT NULL AND isfinite(x) AND x > 0)) = 3, false) AS leg FROM manifest WHERE slice_name IS NOT NULL)),
out AS (SELECT DISTINCT slice_name, ingested_at, array_to_string(list_transform(v, lambda x: round(x, 4)::VARCHAR), ',') AS zyx, source FROM r)
"""
ORACLES |= {
    "spacing": f"WITH {_SPACING} SELECT * FROM out",
    "spacing_sources": f"WITH {_SPACING} SELECT source, count(*)::BIGINT AS n FROM out GROUP BY source",
}
ORACLES = {f"fn_{k}": v for k, v in ORACLES.items()}
