"""Queries over supervision: training pairs, guards, lookups, augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewright.operators import components as C
from slicewright.operators import raster, supervision
from slicewright.plans import masks
from slicewright.session import table

c = F.col
SEED = 4117
WORDS = {1: ["tumour", "lesion"], 2: ["liver"], 3: ["left kidney", "kidney on the left"], 4: ["spleen"]}


def _pairs(spark, d):
    """Prompts as first written, and the components of each slice's first mask file."""
    p = table(spark, d, "prompts_train")
    area = F.aggregate("instances", F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x["area_native"], F.lit(0)))
    p = supervision.seen_first(p.withColumn("n", F.size("instances")).withColumn("a", area).withColumn("t", F.array_join("instances.component_id", ",")).withColumn("b", F.array_join(F.transform("instances", lambda x: F.coalesce(F.array_join(x["bbox_native"], ","), F.lit("none"))), ";")), ["slice_name"], ["written_at", "n", "a", "t", "b"])
    g = table(spark, d, "gts").where("slice_name is not null")
    first = g.groupBy("slice_name").agg(F.min("file_id").alias("file_id"))
    comp = C.mask_components(g.join(first, ["slice_name", "file_id"]), "slice_name")
    return supervision.training_pairs(p.select("slice_name", "instances"), comp)


def training_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)[0].select("pair_id", "slice_name", "k", "component", "how")


def pair_problems(spark, d):
    return _pairs(spark, d)[1].groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def guards(spark, d):
    live = table(spark, d, "manifest").where("deleted_at is null")
    return supervision.guards(table(spark, d, "prompts_train"), live, "slice_name", ["split", "fold", "dataset_name", "case_id", "patient_id"])


def guards_by_patient(spark, d):
    """Patients whose prompts and samples are of different cases, folds or splits: there are some, as a patient may have several."""
    live = table(spark, d, "manifest").where("deleted_at is null")
    return supervision.guards(table(spark, d, "prompts_train"), live, "patient_id", ["split", "fold", "case_id"])


def hybrid_check(spark, d):
    """Resolved labels as hybrid supervision: slices that hold class 3 as if they were full, which they aren't."""
    at = lambda df: df.select("slice", F.floor(c("pos") / 8).cast("int").alias("y"), (c("pos") % 8).alias("x"), *(n for n in ("value",) if n in df.columns))
    labels = at(masks._resolved(spark, d).select("slice", "pos", "value"))
    union = at(masks._union(spark, d))
    truth = labels.where("value <> 255")
    full = labels.where("value = 3").select("slice").distinct()
    return supervision.check_hybrid(labels, truth, union, full, "slice")


def point_labels(spark, d):
    """The resolved label at one point of each slice, and the majority label of its left half."""
    px = masks._resolved(spark, d).where("value <> 255").select("slice", F.floor(c("pos") / 8).cast("int").alias("y"), (c("pos") % 8).alias("x"), "value")
    pts = masks._union(spark, d).select("slice").distinct().select("slice", (c("slice") % 8).cast("int").alias("y"), (c("slice") % 7).cast("int").alias("x"))
    half = px.where("x < 4").select("slice", "y", "x")
    return supervision.value_at(px, pts, "slice").join(supervision.majority_label(px, half, "slice").withColumnRenamed("value", "most"), "slice", "left")


def share_split(spark, d):
    return supervision.split_by_shares(table(spark, d, "manifest"), "case_id", {"train": 0.8, "validation": 0.1, "test": 0.1}, SEED)


def jittered(spark, d):
    p = table(spark, d, "prompts_train").select("slice_name", F.posexplode("instances").alias("k", "i")).where("i.bbox_native is not null")
    p = p.select("slice_name", "k", c("i.bbox_native").alias("nb")).distinct()
    b = supervision.jitter_box(c("nb"), 20, F.lit(512), F.lit(512), SEED, F.concat_ws(":", "slice_name", "k"))
    p = p.withColumn("b", b)
    return p.select("slice_name", "k", *(F.round(c("b")[i], 3).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))), F.round(c("nb")[0], 3).alias("nx1"))


def inner_points(spark, d):
    """One pixel inside each raster's foreground."""
    px = raster.long_pixels(table(spark, d, "embeddings"), ["vec_id"], "embedding", 8).where("value > 0")
    return supervision.inner_point(px, ["vec_id"], SEED)


def synonyms(spark, d):
    i = table(spark, d, "prompts_train").select("slice_name", F.explode("instances.label_id").alias("label_id")).distinct()
    return i.select("slice_name", "label_id", supervision.synonym(c("label_id"), WORDS, SEED, c("slice_name")).alias("word"))


def epoch_means(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.round(c("value") * 100).cast("bigint").alias("cents"))
    return supervision.epoch_mean(e, ["user_id", "event_type"], "cents").select("user_id", "event_type", F.round(c("mean") + 1e-7, 4).alias("mean"), F.round(c("legacy_mean") + 1e-7, 4).alias("legacy_mean"))


NAMES = (training_pairs, pair_problems, guards, guards_by_patient, hybrid_check, point_labels, share_split, jittered, inner_points, synonyms, epoch_means)
QUERIES = {f"sup_{f.__name__}": f for f in NAMES}

_IN = """
pf AS (SELECT slice_name, instances FROM (SELECT *, row_number() OVER (PARTITION BY slice_name ORDER BY written_at, len(instances) NULLS FIRST, a NULLS FIRST, t NULLS FIRST, b NULLS FIRST) AS r FROM
  (SELECT *, list_sum(list_transform(instances, lambda x: coalesce(x.area_native, 0))) AS a, array_to_string(list_transform(instances, lambda x: x.component_id), ',') AS t,
   array_to_string(list_transform(instances, lambda x: coalesce(array_to_string(x.bbox_native, ','), 'none')), ';') AS b FROM prompts_train)) WHERE r = 1),
inst AS (SELECT slice_name, i, k, [floor(i.bbox_native[1]), floor(i.bbox_native[2]), ceil(i.bbox_native[3]), ceil(i.bbox_native[4])] AS wb FROM (SELECT slice_name, unnest(instances) AS i, generate_subscripts(instances, 1) - 1 AS k FROM pf)),
firsts AS (SELECT slice_name, min(file_id) AS file_id FROM gts WHERE slice_name IS NOT NULL GROUP BY 1),
sc AS (SELECT f.slice_name, component, [x1, y1, x2, y2] AS b, count(*) OVER (PARTITION BY f.slice_name) AS n FROM comp JOIN firsts f USING (file_id)),
j AS (SELECT inst.slice_name, k, i.component_id AS cid, CASE WHEN i.bbox_native IS NOT NULL THEN wb END AS a, component, b, n,
  greatest(0.0, least(wb[3], b[3]) - greatest(wb[1], b[1]) + 1) * greatest(0.0, least(wb[4], b[4]) - greatest(wb[2], b[2]) + 1) AS inter FROM inst LEFT JOIN sc USING (slice_name)),
o AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE coalesce(inter / nullif(greatest(0.0, a[3] - a[1] + 1) * greatest(0.0, a[4] - a[2] + 1) + (b[3] - b[1] + 1) * (b[4] - b[2] + 1) - inter, 0), 0.0) END AS iou FROM j),
k2 AS (SELECT *, CASE WHEN component IS NULL THEN 3 WHEN cid = component THEN 0 WHEN a IS NOT NULL THEN 1 WHEN n = 1 THEN 2 ELSE 3 END AS rk FROM o),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slice_name, k ORDER BY rk, iou DESC NULLS LAST, component) AS r FROM k2) WHERE r = 1)
"""
_AT = f"{masks._EV}, pxl AS (SELECT slice, pos // 8 AS y, pos % 8 AS x, value FROM res)"


def _unit(seed: int, ident: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {ident}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"


_J = [f"floor({_unit(SEED + s, chr(39) + chr(39) + ' || slice_name || ' + chr(39) + ':' + chr(39) + ' || k')} * 21)" for s in range(4)]
ORACLES = {
    "training_pairs": rf"""WITH RECURSIVE {masks._COMPS}, {_IN} SELECT regexp_replace(slice_name, '[.][^.]+$', '') || '__i' || lpad(k::VARCHAR, 3, '0') || '_c' || component AS pair_id, slice_name, k::INTEGER AS k, component, CASE rk WHEN 0 THEN 'exact' WHEN 1 THEN 'overlap' ELSE 'single' END AS how FROM top WHERE rk < 3""",
    "pair_problems": f"""WITH RECURSIVE {masks._COMPS}, {_IN} SELECT problem, count(*) AS n FROM (SELECT 'no target' AS problem FROM top WHERE rk = 3 UNION ALL SELECT 'empty' FROM pf WHERE coalesce(len(instances), 0) = 0) GROUP BY 1""",
    "guards": """WITH m AS (SELECT DISTINCT slice_name, lower(trim(split)) AS a, lower(trim(fold)) AS b, lower(trim(dataset_name)) AS c, lower(trim(case_id)) AS d, lower(trim(patient_id)) AS e FROM manifest WHERE deleted_at IS NULL AND slice_name IS NOT NULL),
j AS (SELECT p.slice_name, unnest([CASE WHEN lower(trim(p.split)) <> a THEN 'split' END, CASE WHEN lower(trim(p.fold)) <> b THEN 'fold' END, CASE WHEN lower(trim(p.dataset_name)) <> c THEN 'dataset_name' END, CASE WHEN lower(trim(p.case_id)) <> d THEN 'case_id' END, CASE WHEN lower(trim(p.patient_id)) <> e THEN 'patient_id' END]) AS field FROM prompts_train p JOIN m USING (slice_name))
SELECT field, count(DISTINCT slice_name) AS n FROM j WHERE field IS NOT NULL GROUP BY field""",
    "guards_by_patient": """WITH m AS (SELECT DISTINCT patient_id, lower(trim(split)) AS a, lower(trim(fold)) AS b, lower(trim(case_id)) AS d FROM manifest WHERE deleted_at IS NULL AND patient_id IS NOT NULL),
j AS (SELECT patient_id, unnest([CASE WHEN lower(trim(p.split)) <> a THEN 'split' END, CASE WHEN lower(trim(p.fold)) <> b THEN 'fold' END, CASE WHEN lower(trim(p.case_id)) <> d THEN 'case_id' END]) AS field FROM prompts_train p JOIN m USING (patient_id))
SELECT field, count(DISTINCT patient_id) AS n FROM j WHERE field IS NOT NULL GROUP BY field""",
    "inner_points": f"""WITH {masks._PX}, o AS (SELECT vec_id, pos // 8 AS y, pos % 8 AS x, md5('{SEED}:' || vec_id || ':' || (pos // 8) || ':' || (pos % 8)) AS h FROM px WHERE v > 0)
SELECT vec_id, y::INTEGER AS y, x::INTEGER AS x FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY h, y, x) AS r FROM o) WHERE r = 1""",
    "synonyms": f"""WITH i AS (SELECT DISTINCT slice_name, label_id FROM (SELECT slice_name, unnest(instances).label_id AS label_id FROM prompts_train)),
w AS (SELECT *, CASE label_id {" ".join(f"WHEN {k} THEN {v!r}" for k, v in sorted(WORDS.items()))} END AS words FROM i)
SELECT slice_name, label_id, words[1 + floor({_unit(SEED, "slice_name")} * len(words))::INTEGER] AS word FROM w""",
    "hybrid_check": f"""WITH {_AT} SELECT slice, problem, count(*) AS n FROM (SELECT slice, unnest(['full differs from truth', 'full with ignore']) AS problem FROM pxl WHERE slice IN (SELECT slice FROM pxl WHERE value = 3) AND value = 255) GROUP BY ALL""",
    "point_labels": f"""WITH {_AT}, s AS (SELECT DISTINCT slice FROM u), f AS (SELECT * FROM pxl WHERE value <> 255), n AS (SELECT slice, value, count(*) AS n FROM f WHERE x < 4 GROUP BY ALL), b AS (SELECT slice, value AS most FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY n DESC, value) AS r FROM n) WHERE r = 1)
SELECT s.slice, (s.slice % 8)::INTEGER AS y, (s.slice % 7)::INTEGER AS x, coalesce(f.value, 0) AS value, most FROM s LEFT JOIN f ON f.slice = s.slice AND f.y = s.slice % 8 AND f.x = s.slice % 7 LEFT JOIN b ON b.slice = s.slice""",
    "share_split": f"""SELECT DISTINCT case_id, CASE WHEN u < 0.8::DOUBLE THEN 'train' WHEN u < 0.9::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM (SELECT case_id, {_unit(SEED, "case_id")} AS u FROM manifest WHERE case_id IS NOT NULL)""",
    "jittered": f"""WITH p0 AS (SELECT slice_name, unnest(instances) AS i, generate_subscripts(instances, 1) - 1 AS k FROM prompts_train), p AS (SELECT DISTINCT slice_name, k, i.bbox_native AS nb FROM p0 WHERE i.bbox_native IS NOT NULL)
SELECT slice_name, k::INTEGER AS k, round(greatest(0.0::DOUBLE, nb[1] - {_J[0]}), 3) AS x1, round(greatest(0.0::DOUBLE, nb[2] - {_J[1]}), 3) AS y1, round(least(512.0::DOUBLE, nb[3] + {_J[2]}), 3) AS x2, round(least(512.0::DOUBLE, nb[4] + {_J[3]}), 3) AS y2, round(nb[1], 3) AS nx1 FROM p""",
    "epoch_means": """SELECT user_id, event_type, round(avg(c) + 1e-7::DOUBLE, 4) AS mean, round(sum(c)::DOUBLE / nullif(count(c) - 1, 0) + 1e-7::DOUBLE, 4) AS legacy_mean FROM (SELECT user_id, event_type, round(value * 100)::BIGINT AS c FROM events) GROUP BY ALL""",
}
ORACLES = {f"sup_{k}": v for k, v in ORACLES.items()}
