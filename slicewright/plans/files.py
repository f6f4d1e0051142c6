"""Readers, writers and adapters: tables are written in the layouts of a pipeline and read back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewright.operators import adapters, catalog, codecs
from slicewright.operators import components as C
from slicewright.plans import masks
from slicewright.session import new_table_path, table
from slicewright.sources import documents, schemas, sinks

c = F.col


def _put(spark: SparkSession, path: str, text: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(text.encode())
    out.close()


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """The manifest as JSON lines, read back with its schema."""
    path = new_table_path(spark, "manifest")
    names = [f for f in schemas.MANIFEST.fieldNames()]
    sinks.write_json(table(spark, d, "manifest").select(*names), path)
    m = documents.read_manifest(spark, path, lines=True)
    n = lambda x: F.coalesce(F.when(c(x).isNotNull(), F.size(x)), F.lit(-1))
    return m.groupBy("dataset_name", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("orig_h").alias("h"), F.sum(n("spacing_zyx")).cast("bigint").alias("zyx"), F.sum(n("student_aux")).cast("bigint").alias("aux"), F.count_if("has_fg").alias("fg"))


def _first_geometry(spark, d) -> DataFrame:
    g = table(spark, d, "geometry_meta").where("slice_name is not null")
    return g.groupBy("slice_name").agg(F.min(F.struct("slice_idx", "native_hw", "native_to_teacher")).alias("r")).select("slice_name", "r.*")


def geometry(spark, d):
    """Geometry documents by slice name, read back for each name of the manifest, with or without its suffix."""
    path = new_table_path(spark, "geometry")
    sinks.write_keyed(_first_geometry(spark, d), path, per_file=1000)
    names = table(spark, d, "manifest").where("slice_name is not null").select("slice_name").distinct()
    got = documents.geometry_for(names, documents.read_geometry(spark, path))
    return got.select("slice_name", c("native_hw")[0].alias("h"), c("native_to_teacher.new_w").alias("new_w"), F.round("native_to_teacher.scale", 6).alias("scale"))


def prompts(spark, d):
    """Prompts of the training split, written below a fold, found there and read back; the alias of an earlier run is removed."""
    root = new_table_path(spark, "fold")
    p = table(spark, d, "prompts_train").where("slice_name is not null")
    names = ["dataset_name", "fold", "split", "case_id", "patient_id", "slice_idx", "empty_slice", "instances"]
    rows = p.select("slice_name", *names).distinct()  # a record of its own for each version of a slice
    once = rows.withColumn("slice_name", F.concat_ws("#", "slice_name", F.md5(F.to_json(F.struct(*names)))))
    sinks.write_prompts(once, root, "train", alias=True)
    done = sinks.write_prompts(once, root, "train")
    found = documents.find_prompts(spark, root, "prompts_train.json", root_first=True)
    got = documents.read_prompts(spark, found)
    told = (F.lit("removed" in done)) & F.lit(found == done["canonical"])
    return got.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("instances")).cast("bigint").alias("n_instances"), F.bool_and(told).alias("alias_removed"))


def csv(spark, d):
    """A table as CSV with fixed fields, one of them missing, joined to another with other columns, read back as texts."""
    path = new_table_path(spark, "csv")
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    sinks.write_csv(sinks.union_sorted([s, n]), path, ["n_name", "s_suppkey", "s_name", "note"])
    t = documents.read_table(spark, path + "/*.csv")
    ident, label = documents.discover_columns(t, "suppkey", ("name",))
    return t.groupBy(F.coalesce(c(label), F.lit("none")).alias("label")).agg(F.count(c(ident)).alias("n"), F.count("note").alias("notes"), F.max(F.lit(len(t.columns))).alias("columns"))


def split_lists(spark, d):
    """Lists of names for training and validation at any depth of JSON documents."""
    path = new_table_path(spark, "lists")
    names = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.when(c("n_regionkey") < 3, "train_list").otherwise("val").alias("s"))
    doc = names.groupBy(F.pmod(F.xxhash64("name"), F.lit(4)).alias("f")).agg(F.to_json(F.struct(F.lit("x").alias("note"), F.array(F.map_from_entries(F.array(*(F.struct(F.lit(k), F.array_compact(F.collect_list(F.when(c("s") == k, c("name"))))) for k in ("train_list", "val"))))).alias("folds"))).alias("value"))
    doc.write.partitionBy("f").text(path)
    return documents.read_split_lists(spark, path)


def selections(spark, d):
    """Selection documents as JSON, one a file of runs."""
    path = new_table_path(spark, "selections")
    s = table(spark, d, "selection")
    rows = s.select("round", "selection_type", "selected_new_ids", "cumulative_full_case_ids", "cumulative_full_slice_names", F.pmod("run_id", F.lit(16)).alias("f"))
    lists = rows.groupBy("f").agg(F.to_json(F.collect_list(F.struct("round", "selection_type", "selected_new_ids", "cumulative_full_case_ids", "cumulative_full_slice_names"))).alias("value"))
    lists.write.partitionBy("f").text(path)
    got = documents.read_selection(spark, path)
    return got.groupBy("round", "selection_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.when(c("cumulative_full_case_ids").isNotNull(), F.size("cumulative_full_case_ids")), F.lit(0))).cast("bigint").alias("ids"))


def pairs(spark, d):
    """Training pairs read back, and those that lack a required key."""
    path = new_table_path(spark, "pairs")
    i = table(spark, d, "prompts_train").select("slice_name", F.posexplode("instances").alias("k", "i"))
    rows = i.select(F.concat_ws("_", "slice_name", "k").alias("pair_id"), "slice_name", c("i.label_id").alias("label_id"), F.lit("t.npy").alias("teacher_img"), c("slice_name").alias("target_mask"), c("i.bbox_teacher").alias("bbox_teacher"))
    lists = rows.groupBy(F.pmod(F.xxhash64("pair_id"), F.lit(max(8, -(-i.count() // 20_000)))).alias("f")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    lists.write.partitionBy("f").text(path)
    good, bad = documents.read_pairs(spark, path)
    n = lambda df, name: df.groupBy("label_id").agg(F.count(F.lit(1)).alias(name))
    return n(good, "good").join(n(bad, "bad"), "label_id", "full").na.fill(0, ["good", "bad"])


def fold_metadata(spark, d):
    """Size, classes and dimension of each fold by its metadata, with defaults where a field or document is missing."""
    base = new_table_path(spark, "folds")
    folds = []
    for i, r in enumerate(table(spark, d, "manifest").select("dataset_name").where("dataset_name is not null").distinct().orderBy("dataset_name").collect()):  # data sets are few
        root = f"{base}/{r[0]}/fold_0"
        folds.append((r[0], root))
        if i % 3 != 2:
            _put(spark, f"{root}/meta/split_meta.json", json.dumps({"teacher_target_size": 512, "multi_class_preserved": True, "is_3d": 1 == 0} if i % 3 else {"split_protocol": "official", "has_volume": True}))
    return documents.read_split_meta(spark, spark.createDataFrame(folds, "dataset_name string, root string")).drop("root")


def case_index(spark, d):
    """Cases of the index documents of a data set, with their metadata; one case has none."""
    root = new_table_path(spark, "organized")
    cases = [(f"case{r.n_nationkey:02d}", r.n_name, r.n_regionkey) for r in table(spark, d, "nation").collect()]  # 25 rows
    for split, rows in (("train", cases[:18]), ("test", cases[18:])):
        _put(spark, f"{root}/{split}/index.json", json.dumps([{"case_id": a, "patient_id": b, "case_dir": f"{split}/cases/{a}"} for a, b, _ in rows]))
        for a, b, k in rows[1:]:
            _put(spark, f"{root}/{split}/cases/{a}/case_meta.json", json.dumps({"image_file": f"{a}.png", "region": k, "nested": {"x": 1}}))
    index = documents.read_case_index(spark, root)
    return documents.read_case_meta(spark, root, index).select("split", "case_id", "patient_id", F.try_element_at("meta", F.lit("image_file")).alias("image_file"), F.try_element_at("meta", F.lit("region")).cast("int").alias("region"))


def metadata_bundle(spark, d):
    """The metadata of a fold written as one bundle, each document read back and counted."""
    root = new_table_path(spark, "bundle")
    m = table(spark, d, "manifest")
    named = m.where("dataset_name is not null and case_id is not null and split is not null")
    spacing = m.where("case_id is not null").groupBy("case_id").agg(F.max("spacing_xyz").alias("spacing_xyz"))
    labels = catalog.label_counts(table(spark, d, "prompts_train").select("slice_name", "case_id", F.explode("instances.label_id").alias("label_id")), "label_id", "slice_name", "case_id")
    paths = sinks.write_metadata(
        root, manifest=m, geometry_meta=_first_geometry(spark, d), leakage_audit=catalog.leakage(named, "case_id", "split"), case_spacing=spacing, label_meta=labels,
        aux_meta=m.where("student_aux is not null").select("slice_name", "student_aux"), preprocess_stats=m.groupBy("dataset_name").count(),
        split_meta=named.select("dataset_name").distinct().withColumn("teacher_target_size", F.lit(1024)), tiny_gt_filter_records=catalog.tiny_totals(_verdicts(spark, d), "file_id"),
    )
    out = None
    for p in paths:
        one = spark.read.text(p).agg(F.count(F.lit(1)).alias("n")).select(F.lit(p.rsplit("/", 1)[1]).alias("document"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _verdicts(spark, d) -> DataFrame:
    return C.tiny_verdicts(C.mask_components(table(spark, d, "gts"), "file_id"), "file_id", 12, 3)


def tiny_totals(spark, d):
    """What the filter of tiny components removes in all."""
    return catalog.tiny_totals(_verdicts(spark, d), "file_id")


def label_audit(spark, d):
    """The audit of labels by data set: how masks were made binary and cleaned, and what they held."""
    m = table(spark, d, "manifest").where("slice_name is not null and dataset_name is not null").groupBy("slice_name").agg(F.min("dataset_name").alias("dataset_name"))
    g = table(spark, d, "gts").where("slice_name is not null and counts is not null").select("file_id", "slice_name", F.size("counts").alias("source_unique_count"))
    v = _verdicts(spark, d).groupBy("file_id").agg(F.count_if("removed").cast("int").alias("removed_components"))
    mode = F.when(c("dataset_name").startswith("d"), "threshold").otherwise("canonical")
    audits = g.join(m, "slice_name").join(v, "file_id", "left").select("dataset_name", mode.alias("binarize_mode"), F.when(c("removed_components") > 0, "tiny").alias("cleanup_mode"), "removed_components", "source_unique_count")
    out = catalog.label_audit_summary(audits)
    return out.withColumn("binarize_modes", F.array_join("binarize_modes", ",")).withColumn("cleanup_modes", F.array_join("cleanup_modes", ","))


#: For each data set the files of a case k, with %s for its key; a case whose number is divisible by five lacks its mask.
FILES = {
    "tn3k": ("trainval-image/%s.jpg", "trainval-mask/%s.png"), "cvc_clinicdb": ("train/image/%s.png", "train/masks/%s.png"), "tg3k": ("thyroid-image/%s.jpg", "thyroid-mask/%s.jpg"),
    "kvasirseg": ("images/%s.jpg", "masks/%s.jpg"), "synapse": ("train_npz/case%s_slice001.npz", "train_npz/case%s_slice002.npz"), "acdc": ("training/patient%s/patient%s_frame01.nii.gz", "training/patient%s/patient%s_frame01_gt.nii.gz"),
    "btcv": ("images/img%s.nii.gz", "labels/label%s.nii.gz"), "chasedb1": ("Image_%sL.jpg", "Image_%sL_1stHO.png"), "ddti": ("image/%s.png", "mask/%s.png"), "drive": ("training/images/%s_training.tif", "training/1st_manual/%s_manual1.gif"),
    "hrf": ("images/%s_dr.jpg", "manual1/%s_dr.tif"), "monuseg": ("train/Tissue Images/%s.tif", "train/Annotations/%s.xml"), "otu_2d": ("images/%s.JPG", "annotations/%s_binary.PNG"),
    "ph2": ("PH2 Dataset images/%s/%s_Dermoscopic_Image/a.bmp", "PH2 Dataset images/%s/%s_lesion/b.bmp"), "prostate158": ("train/train/%s/t2.nii.gz", "train/train/%s/t2_anatomy_reader1.nii.gz"),
}


def adapter_items(spark, d):
    """The cases that each data set's adapter finds in its folder, made from the keys of parts: how many of a split, with and without a label."""
    keys = table(spark, d, "part").select("p_partkey", F.lpad(F.concat(c("p_partkey").cast("string")), 7, "0").alias("key"))
    out = None
    for name, patterns in sorted(FILES.items()):
        image, mask = (F.replace(F.lit(p), F.lit("%s"), c("key")) for p in patterns)
        files = keys.select(F.explode(F.when((c("p_partkey") % 5 == 0) & F.lit(name != "synapse"), F.array(image)).otherwise(F.array(image, mask))).alias("path"))
        lists = keys.select("key", F.when(c("p_partkey") % 4 == 0, "val").otherwise("train").alias("split"))
        labels = keys.select("key", F.when(c("p_partkey") % 3 == 0, "a").otherwise("b").alias("label")) if name in ("ddti",) else None
        items = adapters.organize(files, adapters.layout_of(name), name, 7, lists=lists, labels=labels)
        one = items.groupBy("dataset_name", "split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("case_id").alias("n_cases"), F.count("label_src").alias("n_labels"))
        out = one if out is None else out.unionByName(one)
    return out


def packed_runs(spark, d):
    """Run lengths as compact text and back: its length, and whether the runs are the same."""
    g = table(spark, d, "gts").where("counts is not null").select("file_id", "counts")
    packed = codecs.pack_runs(g, "file_id")
    back = codecs.unpack_runs(packed, "file_id").withColumnRenamed("counts", "again")
    return g.join(packed, "file_id").join(back, "file_id").select("file_id", F.length("packed").alias("signs"), (c("counts") == c("again")).alias("same"))


def pair_masks(spark, d):
    """Masks as texts of starts and lengths, read back: their area and turned size."""
    g = table(spark, d, "gts").where("counts is not null and mask_hw is not null")
    rows = codecs.pairs_of_mask(g, "file_id").join(g.select("file_id", c("mask_hw")[0].alias("h"), c("mask_hw")[1].alias("w")), "file_id")
    from slicewright.functions import mask as M

    got = codecs.mask_of_pairs(rows, "file_id", "pairs", "h", "w")
    return got.select("file_id", M.rle_area(c("counts")).alias("area"), c("mask_hw")[0].alias("rows"), c("mask_hw")[1].alias("columns"))


NAMES = (manifest, geometry, prompts, csv, split_lists, selections, pairs, fold_metadata, case_index, metadata_bundle, tiny_totals, label_audit, adapter_items, packed_runs, pair_masks)
QUERIES = {f"io_{f.__name__}": f for f in NAMES}

_TINY = f"""{masks._COMPS}, t AS (SELECT *, area <= 12 OR greatest(x2 - x1, y2 - y1) + 1 <= 3 AS tiny FROM comp),
tn AS (SELECT *, count(*) OVER (PARTITION BY file_id) AS n, count(*) FILTER (WHERE tiny) OVER (PARTITION BY file_id) AS k FROM t),
gone AS (SELECT file_id, area FROM tn WHERE tiny AND n > 1 AND k < n)"""
_DIGITS = "CASE {0} END".format(" ".join(f"WHEN v >= {-16 * 32**k} AND v < {16 * 32**k} THEN {k + 1}" for k in range(6)))

ORACLES = {
    "manifest": """SELECT dataset_name, split, count(*) AS n, sum(orig_h)::BIGINT AS h, sum(coalesce(len(spacing_zyx), -1))::BIGINT AS zyx, sum(coalesce(cardinality(student_aux), -1))::BIGINT AS aux, count(*) FILTER (WHERE has_fg) AS fg FROM manifest GROUP BY ALL""",
    "geometry": """WITH g AS (SELECT slice_name, native_hw[1] AS h, native_to_teacher.new_w AS new_w, round(native_to_teacher.scale, 6) AS scale FROM (SELECT *, row_number() OVER (PARTITION BY slice_name ORDER BY slice_idx NULLS FIRST, native_hw NULLS FIRST, native_to_teacher NULLS FIRST) AS r FROM geometry_meta WHERE slice_name IS NOT NULL) WHERE r = 1),
m AS (SELECT DISTINCT slice_name FROM manifest WHERE slice_name IS NOT NULL)
SELECT m.slice_name, h, new_w, scale FROM m JOIN g USING (slice_name) UNION ALL SELECT m.slice_name, h, new_w, scale FROM m JOIN g ON g.slice_name = regexp_replace(m.slice_name, '[.][^.]+$', '') WHERE m.slice_name NOT IN (SELECT slice_name FROM g)""",
    "prompts": """SELECT dataset_name, count(*) AS n, sum(CASE WHEN coalesce(empty_slice, false) THEN 0 ELSE coalesce(len(instances), 0) END)::BIGINT AS n_instances, true AS alias_removed
FROM (SELECT DISTINCT dataset_name, fold, split, case_id, patient_id, slice_name, slice_idx, empty_slice, instances FROM prompts_train WHERE slice_name IS NOT NULL) GROUP BY 1""",
    "split_lists": "SELECT n_name AS name, CASE WHEN n_regionkey < 3 THEN 'train' ELSE 'val' END AS split FROM nation",
    "csv": "SELECT 'none' AS label, (SELECT count(*) FROM supplier) AS n, 0::BIGINT AS notes, 4::INTEGER AS columns UNION ALL SELECT n_name, 0, 0, 4 FROM nation",
    "selections": "SELECT round, selection_type, count(*) AS n, sum(coalesce(len(cumulative_full_case_ids), 0))::BIGINT AS ids FROM selection GROUP BY ALL",
    "pairs": """WITH i AS (SELECT slice_name, unnest(instances) AS i FROM prompts_train) SELECT i.label_id AS label_id, count(*) FILTER (WHERE slice_name IS NOT NULL AND i.bbox_teacher IS NOT NULL) AS good, count(*) FILTER (WHERE slice_name IS NULL OR i.bbox_teacher IS NULL) AS bad FROM i GROUP BY 1""",
    "fold_metadata": """WITH n AS (SELECT dataset_name, row_number() OVER (ORDER BY dataset_name) - 1 AS i FROM (SELECT DISTINCT dataset_name FROM manifest WHERE dataset_name IS NOT NULL)), k AS (SELECT *, lower(trim(dataset_name)) IN ('acdc', 'btcv', 'prostate158', 'synapse') AS known FROM n)
SELECT dataset_name, (CASE WHEN i % 3 = 1 THEN 512 ELSE 1024 END)::INTEGER AS teacher_target_size, i % 3 = 1 OR known AS is_multiclass, i % 3 = 0 OR known AS is_3d, CASE WHEN i % 3 = 0 THEN 'official' END AS split_protocol FROM k""",
    "case_index": """WITH k AS (SELECT 'case' || lpad(n_nationkey::VARCHAR, 2, '0') AS case_id, n_name, n_regionkey, n_nationkey AS i FROM nation)
SELECT CASE WHEN i < 18 THEN 'train' ELSE 'test' END AS split, case_id, n_name AS patient_id, CASE WHEN i NOT IN (0, 18) THEN case_id || '.png' END AS image_file, (CASE WHEN i NOT IN (0, 18) THEN n_regionkey END)::INTEGER AS region FROM k""",
    "metadata_bundle": """WITH p AS (SELECT unnest(instances).label_id AS l FROM prompts_train)
SELECT 'manifest.json' AS document, (SELECT count(*) FROM manifest) AS n UNION ALL SELECT 'geometry_meta.json', (SELECT count(DISTINCT slice_name) FROM geometry_meta) UNION ALL SELECT 'leakage_audit.json', 1
UNION ALL SELECT 'case_spacing.json', (SELECT count(DISTINCT case_id) FROM manifest) UNION ALL SELECT 'label_meta.json', (SELECT count(DISTINCT l) + max((l IS NULL)::INTEGER) FROM p)
UNION ALL SELECT 'aux_meta.json', (SELECT count(*) FROM manifest WHERE student_aux IS NOT NULL) UNION ALL SELECT 'preprocess_stats.json', (SELECT count(*) FROM (SELECT DISTINCT dataset_name FROM manifest))
UNION ALL SELECT 'split_meta.json', (SELECT count(DISTINCT dataset_name) FROM manifest WHERE case_id IS NOT NULL AND split IS NOT NULL) UNION ALL SELECT 'tiny_gt_filter_records.json', 1""",
    "tiny_totals": f"WITH RECURSIVE {_TINY} SELECT count(DISTINCT file_id) AS samples, count(*) AS components, coalesce(sum(area), 0)::BIGINT AS pixels FROM gone",
    "label_audit": f"""WITH RECURSIVE {_TINY}, m AS (SELECT slice_name, min(dataset_name) AS dataset_name FROM manifest WHERE slice_name IS NOT NULL AND dataset_name IS NOT NULL GROUP BY 1), r AS (SELECT file_id, count(*) AS n FROM gone GROUP BY 1),
a AS (SELECT dataset_name, CASE WHEN dataset_name LIKE 'd%' THEN 'threshold' ELSE 'canonical' END AS b, CASE WHEN r.n > 0 THEN 'tiny' END AS cl, coalesce(r.n, 0) AS n, len(counts)::INTEGER AS u FROM gts JOIN m USING (slice_name) LEFT JOIN r USING (file_id) WHERE counts IS NOT NULL)
SELECT dataset_name, count(*) AS num_cases, array_to_string(list_sort(list(DISTINCT b)), ',') AS binarize_modes, coalesce(array_to_string(list_sort(list(DISTINCT cl) FILTER (WHERE cl IS NOT NULL)), ','), '') AS cleanup_modes, count(*) FILTER (WHERE n > 0) AS cases_with_removed, max(u) AS max_unique FROM a GROUP BY 1""",
    "packed_runs": f"""WITH r AS (SELECT file_id, unnest(counts) AS c, generate_subscripts(counts, 1) AS i, counts FROM gts WHERE counts IS NOT NULL), d AS (SELECT file_id, CASE WHEN i > 3 THEN c - counts[i - 2] ELSE c END AS v FROM r)
SELECT g.file_id, coalesce(sum({_DIGITS}), 0)::INTEGER AS signs, true AS same FROM gts g LEFT JOIN d USING (file_id) WHERE g.counts IS NOT NULL GROUP BY 1""",
    "pair_masks": f"""WITH {masks._FLIPS} SELECT g.file_id, coalesce(sum(low - top + 1), 0)::BIGINT AS area, any_value(g.mask_hw[2]) AS rows, any_value(g.mask_hw[1]) AS columns FROM gts g LEFT JOIN segs USING (file_id) WHERE g.counts IS NOT NULL AND g.mask_hw IS NOT NULL GROUP BY g.file_id""",
    "adapter_items": """WITH p AS (SELECT p_partkey AS k FROM part), l AS (SELECT k FROM p WHERE k % 5 <> 0), n AS (SELECT count(*) AS n FROM l),
s AS (SELECT x.name, k, CASE x.rule WHEN 'train' THEN 'train' WHEN 'lists' THEN CASE WHEN k % 4 = 0 THEN 'test' ELSE 'train' END WHEN 'patients' THEN CASE WHEN k <= 10 THEN 'train' ELSE 'test' END END AS split
  FROM l, (SELECT unnest(['tn3k', 'cvc_clinicdb', 'acdc', 'drive', 'monuseg', 'prostate158', 'tg3k', 'otu_2d', 'chasedb1']) AS name, unnest(['train', 'train', 'train', 'train', 'train', 'train', 'lists', 'lists', 'patients']) AS rule) x),
f AS (SELECT unnest(['kvasirseg', 'btcv', 'hrf', 'ph2']) AS name, unnest([900, 24, 10, 160]) AS k),
st AS (SELECT k % 3 = 0 AS a, count(*) AS n FROM l GROUP BY 1), sp AS (SELECT sum(greatest(1, least(n - 1, round_even(n * 0.8, 0)::BIGINT)))::BIGINT AS t, sum(n)::BIGINT AS n FROM st),
c AS (SELECT name, split, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT name, unnest(['train', 'test']), unnest([least(k, n.n), n.n - least(k, n.n)]) FROM f, n UNION ALL SELECT 'ddti', unnest(['train', 'test']), unnest([t, n - t]) FROM sp)
SELECT name AS dataset_name, split, n, n AS n_cases, n AS n_labels FROM c WHERE n > 0 UNION ALL SELECT 'synapse', 'train', count(*), count(*), 0 FROM p""",
}
ORACLES = {f"io_{k}": v for k, v in ORACLES.items()}
