"""Queries over the sample catalogue, scores, selections and the progress log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewright.functions import clock, number, text
from slicewright.operators import catalog, detection, metrics, progress, scoring
from slicewright.operators.catalog import plain
from slicewright.session import table

c = F.col
SEED = 4117


def _manifest(spark, d) -> DataFrame:
    return table(spark, d, "manifest")


def _live(spark, d) -> DataFrame:
    """Named rows that aren't withdrawn."""
    return _manifest(spark, d).where("slice_name is not null and deleted_at is null")


def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return catalog.duplicate_keys(_live(spark, d), ["slice_name"])


def sample_keys(spark, d):
    m = _manifest(spark, d)
    return m.select(catalog.sample_key(m, ["native_gt", "teacher_img"]).alias("key"), plain("split").alias("split")).groupBy("split").agg(F.count_distinct("key").alias("n"), F.count_if(c("key").isNull()).alias("unnamed"))


def counters(spark, d):
    """Samples in all, by split, with and without foreground."""
    m = _live(spark, d)
    s = plain("split")
    return m.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(s == "train").alias("n_train"), F.count_if(s == "test").alias("n_test"), F.count_if("has_fg").alias("n_fg"), F.count_if(~c("has_fg")).alias("n_empty"))


def label_counts(spark, d):
    i = table(spark, d, "prompts_train").select("slice_name", "case_id", F.explode("instances.label_id").alias("label_id"))
    return catalog.label_counts(i, "label_id", "slice_name", "case_id")


def prompt_stats(spark, d):
    p = table(spark, d, "prompts_train")
    n = F.coalesce(F.size("instances"), F.lit(0))
    n = F.when(c("instances").isNull(), 0).otherwise(n)
    return p.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(n == 0).alias("n_empty"), F.sum(n).cast("bigint").alias("n_instances"), F.max(n).alias("most"), F.sum(F.aggregate("instances", F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x["area_native"], F.lit(0)))).alias("area"))


def legacy_boxes(spark, d):
    """The box of each instance with where it was found: bbox_teacher, else bbox."""
    i = table(spark, d, "prompts_train").select("slice_name", F.posexplode("instances").alias("k", "i"))
    return i.select("slice_name", "k", F.round(F.coalesce("i.bbox_teacher", "i.bbox")[0], 3).alias("x1"), F.when(c("i.bbox_teacher").isNotNull(), "bbox_teacher").when(c("i.bbox").isNotNull(), "bbox").otherwise("none").alias("origin"))


def label_map(spark, d):
    """Per data set the number of instances of each label, as a map in text."""
    i = table(spark, d, "prompts_train").select("dataset_name", F.explode("instances.label_id").alias("l")).where("l is not null")
    n = i.groupBy("dataset_name", "l").agg(F.count(F.lit(1)).alias("n"))
    m = F.sort_array(F.collect_list(F.struct("l", "n")))  # a row a label
    return n.groupBy("dataset_name").agg(F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["l"], x["n"])), " ").alias("labels"))


def first_round(spark, d):
    """The images annotated first: of the foreground images of each data set a quota by hash."""
    p = table(spark, d, "prompts_train").where("size(instances) > 0 and case_id is not null").select("dataset_name", "case_id").distinct()
    n = p.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n"))
    first = catalog.take_per_group(p, "case_id", "dataset_name", 5, SEED)  # five is the most a quota can be
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("dataset_name").orderBy(catalog.unit_order(SEED, c("case_id")), "case_id"))
    return first.withColumn("place", place).join(n, "dataset_name").where(c("place") <= number.quota_2d(c("n"))).select("dataset_name", "case_id", "place")


def foreground_slices(spark, d):
    """Live slices with at least one instance."""
    p = table(spark, d, "prompts_train").where(F.size("instances") > 0)
    return _live(spark, d).select("slice_name", "dataset_name").distinct().join(p.select("slice_name"), "slice_name", "left_semi")


def missing_extra(spark, d):
    return catalog.missing_and_extra(_live(spark, d).select("slice_name"), table(spark, d, "geometry_meta").select("slice_name"), "slice_name")


def three_way_join(spark, d):
    """Prompts with their slice's row and geometry, and how many of each they have."""
    m = _live(spark, d).groupBy("slice_name").agg(F.count(F.lit(1)).alias("n_rows"))
    g = table(spark, d, "geometry_meta").groupBy("slice_name").agg(F.count(F.lit(1)).alias("n_geometry"))
    return table(spark, d, "prompts_train").select("slice_name", "dataset_name").distinct().join(m, "slice_name").join(g, "slice_name")


def stem_join(spark, d):
    """Mask files and the slices' paths to them, by stem."""
    g = table(spark, d, "gts").select(F.replace("file_path", F.lit("\\"), F.lit("/")).alias("p"))
    m = _manifest(spark, d).select(c("native_gt").alias("p"))
    return catalog.stem_pairs(g, m, "p")


def aux_left_join(spark, d):
    """Every live slice with its optional auxiliary masks, each under its name."""
    m = _live(spark, d).select("slice_name", "student_aux").where("student_aux is not null")
    return _live(spark, d).select("slice_name").distinct().join(m.select("slice_name", F.explode("student_aux").alias("aux", "path")).distinct(), "slice_name", "left")


def prefix_join(spark, d):
    """Cases by the prefix they share with the phases of a study, where exactly one fits."""
    m = _manifest(spark, d).where("case_id is not null")
    left = m.select(F.regexp_extract("case_id", r"^([a-z]+_[0-9]+)", 1).alias("study")).where("study <> ''").distinct()
    return catalog.prefix_join(left, "study", m.select("case_id").distinct(), "case_id").select("study", "case_id")


def split_lists(spark, d):
    """Cases by membership in the splits' lists, train first."""
    m = _manifest(spark, d).where("case_id is not null")
    items = m.select(plain("case_id").alias("case_id")).distinct()
    lists = m.select(plain("case_id").alias("case_id"), plain("split").alias("split")).distinct()
    return catalog.split_membership(items, "case_id", lists, ["train", "test"])


def case_slices(spark, d):
    """Selected cases with the number of their slices."""
    s = table(spark, d, "selection").select("run_id", F.explode("cumulative_full_case_ids").alias("case_id")).where("case_id is not null").distinct()
    n = _live(spark, d).groupBy("case_id").agg(F.count_distinct("slice_name").alias("n_slices"))
    return s.join(n, "case_id").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_cases"), F.sum("n_slices").alias("n_slices"))


def dataset_names(spark, d):
    """Data sets matched by normalised name."""
    a = _manifest(spark, d).select("dataset_name").distinct().select("dataset_name", text.norm_name(c("dataset_name")).alias("k"))
    b = table(spark, d, "score_box_pool").select("dataset").distinct().select("dataset", text.norm_name(c("dataset")).alias("k"))
    return a.join(b, "k")


def leakage(spark, d):
    m = _manifest(spark, d).select(plain("patient_id").alias("u"), plain("split").alias("s"))
    return catalog.leakage(m, "u", "s").withColumn("examples", F.array_join("examples", ","))


def running_duplicates(spark, d):
    m = _manifest(spark, d).where("case_id is not null and slice_name is not null").select(plain("case_id").alias("case_id"), plain("split").alias("split"), "slice_name", "ingested_at").distinct()
    return catalog.running_duplicates(m, ["split", "case_id"], ["ingested_at", "slice_name"]).groupBy("seen_before").agg(F.count(F.lit(1)).alias("n"))


def last_size(spark, d):
    """The image height last written for each case."""
    return catalog.last_value(_manifest(spark, d).where("case_id is not null"), ["case_id"], "orig_h", ["ingested_at", "orig_h"])


def partition_check(spark, d):
    """Selected slices of the first runs that no training slice of any data set or fold has: errors by kind.

    As in the SQL twin, the remaining slices are what is not selected, so only ``unknown`` can occur.
    """
    m = _live(spark, d).where(plain("split") == "train").select("slice_name", "dataset_name", "fold").distinct()
    full = table(spark, d, "selection").where("round = 0").select(F.explode("cumulative_full_slice_names").alias("slice_name")).distinct()
    box = m.join(full, "slice_name", "left_anti")
    return catalog.partition_errors(m, full, box, "slice_name").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def set_operations(spark, d):
    """Cases of manifest and scores: in both, in either alone, in all."""
    a = _manifest(spark, d).select("case_id").where("case_id is not null")
    b = table(spark, d, "score_box_pool").select("case_id").where("case_id is not null")
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("op"), "n")
    return one(a.intersect(b), "intersect").unionByName(one(a.subtract(b), "minus")).unionByName(one(b.subtract(a), "plus")).unionByName(one(a.union(b).distinct(), "union"))


def cumulative_full(spark, d):
    """Cases known to each series up to a round: running union as the count of first appearances."""
    s = table(spark, d, "selection").where("seed is not null").select("dataset_name", "fold", "seed", "round", F.explode("selected_new_ids").alias("id")).where("id is not null")
    first = s.groupBy("dataset_name", "fold", "seed", "id").agg(F.min("round").alias("round"))
    per = first.groupBy("dataset_name", "fold", "seed", "round").agg(F.count(F.lit(1)).alias("new"))
    from pyspark.sql import Window

    return per.withColumn("known", F.sum("new").over(Window.partitionBy("dataset_name", "fold", "seed").orderBy("round")))


def fixed_split(spark, d):
    return catalog.split_fixed(_manifest(spark, d), "case_id", 100, SEED)


def stratified_split(spark, d):
    return catalog.split_stratified(_manifest(spark, d).select("case_id", "dataset_name"), "case_id", "dataset_name", 0.8, SEED)


def per_group(spark, d):
    return catalog.take_per_group(_manifest(spark, d).select("case_id", "dataset_name"), "case_id", "dataset_name", 10, SEED)


def slice_index(spark, d):
    """Position of each slice in its case by name."""
    from pyspark.sql import Window

    m = _live(spark, d).where("case_id is not null").select("case_id", "slice_name").distinct()
    return m.withColumn("at", F.row_number().over(Window.partitionBy("case_id").orderBy("slice_name")) - 1)


def incremental(spark, d):
    """Scored images whose prompts aren't written yet."""
    s = table(spark, d, "score_box_pool").select("slice_name").distinct()
    return s.join(table(spark, d, "prompts_train").select("slice_name"), "slice_name", "left_anti")


def contract(spark, d):
    """The catalogue's contract: what breaks it, counted with examples."""
    m, p, g = _live(spark, d), table(spark, d, "prompts_train"), table(spark, d, "geometry_meta")
    names, geo = m.select("slice_name").distinct(), g.select("slice_name").distinct()
    train = m.where(plain("split") == "train").select("slice_name").distinct()
    found = catalog.violations(
        key_repeated=catalog.duplicate_keys(m, ["slice_name"]),
        prompt_without_row=p.select("slice_name").distinct().join(names, "slice_name", "left_anti"),
        train_without_prompt=train.join(p.select("slice_name"), "slice_name", "left_anti"),
        train_without_geometry=train.join(geo, "slice_name", "left_anti"),
        prompt_not_train=p.where(plain("split") != "train").select("slice_name").distinct(),
        no_split=m.where("split is null").select("slice_name").distinct(),
    )
    return catalog.violation_counts(found)


def nearest_prompt(spark, d):
    """For each slice of a volume the nearest slice with a prompt."""
    m = _live(spark, d).where("slice_idx is not null and case_id is not null").select("slice_name", "case_id", "slice_idx").distinct()
    p = table(spark, d, "prompts_train").where(F.size("instances") > 0).select("slice_name").distinct().withColumn("has", F.lit(True))
    j = m.join(p, "slice_name", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    return detection.nearest_marked(j, ["case_id"], "slice_idx", "has")


def prompt_gaps(spark, d):
    p = table(spark, d, "prompts_train").where("slice_idx is not null and case_id is not null").withColumn("has", F.size("instances") > 0)
    return detection.marked_pairs(p, ["case_id"], "slice_idx", "has")


def start_slices(spark, d):
    p = table(spark, d, "prompts_train").where("case_id is not null").select("case_id", "slice_idx", F.explode("instances.bbox_native").alias("b"))
    return detection.start_slice(p, ["case_id"], "slice_idx", "b")


def round_summary(spark, d):
    return scoring.round_summary(table(spark, d, "score_box_pool").distinct(), ["dataset", "round"])


def hard_ranking(spark, d):
    s = table(spark, d, "score_box_pool").select("dataset", "round", "slice_name", "image_min_iou", "image_macro_iou", "empty_instance_count").distinct()
    once = s.groupBy("dataset", "round", "slice_name").agg(F.min(F.struct(scoring.finite(c("image_min_iou")).alias("image_min_iou"), scoring.finite(c("image_macro_iou")).alias("image_macro_iou"), "empty_instance_count")).alias("x")).select("dataset", "round", "slice_name", "x.*")
    return scoring.hard_ranking(once, ["dataset", "round"], "slice_name", 0.45, 5).select("dataset", "round", "slice_name", "place")


def image_scores(spark, d):
    """Per order (as an image) from its lines (as instances)."""
    o = table(spark, d, "orders").select(c("o_orderkey").alias("image"))
    i = table(spark, d, "lineitem").select(c("l_orderkey").alias("image"), F.when(c("l_linenumber") == 7, F.lit(float("nan"))).otherwise(c("l_discount") * 10).alias("iou"), (c("l_linenumber") == 7).alias("prediction_empty"))
    return scoring.per_image(o, i, ["image"], 0.2).withColumn("macro", F.round(c("macro") + 1e-7, 5)).withColumn("least", F.round("least", 5))


def case_scores(spark, d):
    """Per customer (as a case) from the lines of its orders (as slices with labels)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    q = c("l_quantity").cast("bigint")
    k = c("l_linenumber").cast("bigint") * 6
    lab = table(spark, d, "lineitem").join(o, c("l_orderkey") == c("o_orderkey")).select(c("o_custkey").alias("case"), c("l_linenumber").alias("label"), F.greatest(F.lit(0), F.least(q, k) - 5).alias("inter"), F.greatest(q, k).alias("uni"), q.alias("gt"), F.when(c("l_linenumber") == 7, 0).otherwise(k).alias("pred"))
    out = scoring.per_case(lab, ["case"], 0.1)
    return out.select("case", *(F.round(c(n) + 1e-7, 5).alias(n) for n in ("macro", "least", "worst")), "missed", "n_classes", "n_evaluated", "hard")


def worst_fifth(spark, d):
    s = table(spark, d, "score_box_pool").where("case_id is not null").distinct()
    return metrics.worst_fraction_mean(s, ["case_id"], "image_min_iou").select("case_id", F.round(c("worst") + 1e-7, 5).alias("worst"))


def weighted_percentile(spark, d):
    s = table(spark, d, "lineitem")
    return metrics.weighted_percentile(s, ["l_suppkey"], "l_extendedprice", c("l_quantity"), 95.0)


def gap_closure(spark, d):
    """Per data set the score of the first, the last and the best round, and the part of the gap closed."""
    s = table(spark, d, "score_box_pool").where("image_macro_iou is not null and not isnan(image_macro_iou)").distinct()
    micro = F.round(c("image_macro_iou") * 1_000_000).cast("bigint")
    per = s.groupBy("dataset", "round").agg((F.sum(micro) / F.count(F.lit(1)) / 1e6).alias("m"))
    f = per.groupBy("dataset").agg(F.min_by("m", "round").alias("base"), F.max_by("m", "round").alias("ours"), F.max("m").alias("best"))
    return f.select("dataset", F.round(metrics.gain(c("base"), c("ours")), 5).alias("gain"), F.round(metrics.gap_closure(c("base"), c("ours"), c("best")), 4).alias("closed"))


def progress_state(spark, d):
    e = table(spark, d, "events")
    status = F.when(c("event_type") == "purchase", "success").when(c("event_type") == "error", "failed").otherwise("running")
    st = progress.latest_state(e.withColumn("status", status), ["user_id"], "ts", "status")
    return st.withColumn("elapsed", F.round(clock.elapsed_seconds(c("started_at"), c("last_update_at")), 3))


def progress_stats(spark, d):
    """The scalar statistics of the log, flattened, the last value of each."""
    e = table(spark, d, "events").select("user_id", "event_id", progress.scalar_stats("props").alias("stats"))
    return progress.merged_stats(e, ["user_id"], "event_id", "stats")


def moving_mean(spark, d):
    e = table(spark, d, "events")
    return progress.moving_mean(e, ["user_id"], ["ts", "event_id"], "value", 5).select("event_id", F.round(c("moving_mean") + 1e-7, 4).alias("moving_mean"))


def throttled(spark, d):
    return progress.throttle(table(spark, d, "events"), "user_id", "ts", 3600.0)


NAMES = (
    duplicate_keys, sample_keys, counters, label_counts, prompt_stats, label_map, first_round, legacy_boxes, foreground_slices, missing_extra, three_way_join, stem_join, aux_left_join, prefix_join, split_lists, case_slices, dataset_names,
    leakage, running_duplicates, last_size, partition_check, set_operations, cumulative_full, fixed_split, stratified_split, per_group, slice_index, incremental, contract, nearest_prompt, prompt_gaps, start_slices,
    round_summary, hard_ranking, image_scores, case_scores, worst_fifth, weighted_percentile, gap_closure, progress_state, progress_stats, moving_mean, throttled,
)
QUERIES = {f"cat_{f.__name__}": f for f in NAMES}

_LIVE = "live AS (SELECT *, lower(trim(split)) AS sp FROM manifest WHERE slice_name IS NOT NULL AND deleted_at IS NULL)"
_BASE = r"regexp_extract({0}, '([^/\\]*)$', 1)"
_STEM = r"regexp_replace(" + _BASE + r", '(.)[.][^.]+$', '\1')"
_FIN = "CASE WHEN {0} IS NULL OR isnan({0}) THEN 0.0::DOUBLE ELSE {0} END"
_H = f"md5('{SEED}:' || case_id)"

ORACLES = {
    "throttled": """WITH k AS (SELECT user_id, list([ts] ORDER BY ts) AS l FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1),
r AS (SELECT user_id, list_reduce(l, lambda a, x: CASE WHEN x[1] - a[-1] >= INTERVAL 1 HOUR THEN list_concat(a, x) ELSE a END) AS kept FROM k)
SELECT user_id, unnest(kept) AS ts FROM r""",
    "duplicate_keys": f"WITH {_LIVE} SELECT slice_name, count(*) AS n FROM live GROUP BY 1 HAVING n > 1",
    "sample_keys": rf"SELECT split, count(DISTINCT key) AS n, count(*) FILTER (WHERE key IS NULL) AS unnamed FROM (SELECT lower(trim(split)) AS split, coalesce(nullif(trim(slice_name), ''), nullif({_BASE.format('native_gt')}, ''), nullif({_BASE.format('teacher_img')}, '')) AS key FROM manifest) GROUP BY split",
    "counters": f"WITH {_LIVE} SELECT dataset_name, count(*) AS n, count(*) FILTER (WHERE sp = 'train') AS n_train, count(*) FILTER (WHERE sp = 'test') AS n_test, count(*) FILTER (WHERE has_fg) AS n_fg, count(*) FILTER (WHERE NOT has_fg) AS n_empty FROM live GROUP BY 1",
    "label_counts": "SELECT label_id, count(DISTINCT slice_name) AS n_slices, count(DISTINCT case_id) AS n_cases FROM (SELECT slice_name, case_id, unnest(instances).label_id AS label_id FROM prompts_train) GROUP BY 1",
    "prompt_stats": "SELECT dataset_name, count(*) AS n, count(*) FILTER (WHERE coalesce(len(instances), 0) = 0) AS n_empty, sum(coalesce(len(instances), 0))::BIGINT AS n_instances, max(coalesce(len(instances), 0))::INTEGER AS most, sum(CASE WHEN instances IS NOT NULL THEN coalesce(list_sum(list_transform(instances, lambda x: coalesce(x.area_native, 0))), 0) END)::BIGINT AS area FROM prompts_train GROUP BY 1",
    "label_map": "WITH n AS (SELECT dataset_name, l, count(*) AS n FROM (SELECT dataset_name, unnest(instances).label_id AS l FROM prompts_train) WHERE l IS NOT NULL GROUP BY ALL) SELECT dataset_name, string_agg(l || ':' || n, ' ' ORDER BY l) AS labels FROM n GROUP BY dataset_name",
    "first_round": f"WITH p AS (SELECT DISTINCT dataset_name, case_id FROM prompts_train WHERE len(instances) > 0 AND case_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY {_H}, case_id)::INTEGER AS place, count(*) OVER (PARTITION BY dataset_name) AS n FROM p) SELECT dataset_name, case_id, place FROM r WHERE place <= least(greatest(1, ceil(n / 100.0)), 5, n)",
    "legacy_boxes": "SELECT slice_name, k::INTEGER AS k, round(coalesce(i.bbox_teacher, i.bbox)[1], 3) AS x1, CASE WHEN i.bbox_teacher IS NOT NULL THEN 'bbox_teacher' WHEN i.bbox IS NOT NULL THEN 'bbox' ELSE 'none' END AS origin FROM (SELECT slice_name, unnest(instances) AS i, generate_subscripts(instances, 1) - 1 AS k FROM prompts_train)",
    "foreground_slices": f"WITH {_LIVE} SELECT DISTINCT slice_name, dataset_name FROM live WHERE slice_name IN (SELECT slice_name FROM prompts_train WHERE len(instances) > 0)",
    "missing_extra": f"WITH {_LIVE}, g AS (SELECT DISTINCT slice_name FROM geometry_meta) SELECT DISTINCT slice_name, 'missing' AS side FROM live WHERE slice_name NOT IN (SELECT slice_name FROM g) UNION ALL SELECT slice_name, 'extra' FROM g WHERE slice_name NOT IN (SELECT slice_name FROM live)",
    "three_way_join": f"WITH {_LIVE}, m AS (SELECT slice_name, count(*) AS n_rows FROM live GROUP BY 1), g AS (SELECT slice_name, count(*) AS n_geometry FROM geometry_meta GROUP BY 1) SELECT DISTINCT p.slice_name, dataset_name, n_rows, n_geometry FROM prompts_train p JOIN m USING (slice_name) JOIN g USING (slice_name)",
    "stem_join": rf"WITH a AS (SELECT {_STEM.format('p')} AS stem, max(p) AS image FROM (SELECT replace(file_path, '\', '/') AS p FROM gts) WHERE p IS NOT NULL GROUP BY 1), b AS (SELECT {_STEM.format('native_gt')} AS stem, max(native_gt) AS mask FROM manifest WHERE native_gt IS NOT NULL GROUP BY 1) SELECT * FROM a JOIN b USING (stem)",
    "aux_left_join": f"WITH {_LIVE}, e AS (SELECT DISTINCT slice_name, unnest(map_entries(student_aux)) AS x FROM live WHERE student_aux IS NOT NULL) SELECT DISTINCT l.slice_name, e.x.key AS aux, e.x.value AS path FROM live l LEFT JOIN e USING (slice_name)",
    "prefix_join": "WITH r AS (SELECT DISTINCT case_id FROM manifest WHERE case_id IS NOT NULL), l AS (SELECT DISTINCT regexp_extract(case_id, '^([a-z]+_[0-9]+)', 1) AS study FROM r), j AS (SELECT study, case_id, count(*) OVER (PARTITION BY study) AS n FROM l JOIN r ON starts_with(case_id, study || '_') WHERE study <> '') SELECT study, case_id FROM j WHERE n = 1",
    "split_lists": "WITH m AS (SELECT DISTINCT lower(trim(case_id)) AS case_id, lower(trim(split)) AS split FROM manifest WHERE case_id IS NOT NULL) SELECT case_id, CASE WHEN bool_or(split = 'train') THEN 'train' ELSE 'test' END AS split FROM m WHERE split IN ('train', 'test') GROUP BY 1",
    "case_slices": f"WITH {_LIVE}, s AS (SELECT DISTINCT run_id, unnest(cumulative_full_case_ids) AS case_id FROM selection), n AS (SELECT case_id, count(DISTINCT slice_name) AS n FROM live GROUP BY 1) SELECT run_id, count(*) AS n_cases, sum(n)::BIGINT AS n_slices FROM s JOIN n USING (case_id) GROUP BY run_id",
    "dataset_names": "WITH a AS (SELECT DISTINCT dataset_name, lower(replace(replace(trim(dataset_name), '-', '_'), ' ', '_')) AS k FROM manifest), b AS (SELECT DISTINCT dataset, lower(replace(replace(trim(dataset), '-', '_'), ' ', '_')) AS k FROM score_box_pool) SELECT k, dataset_name, dataset FROM a JOIN b USING (k)",
    "leakage": "WITH p AS (SELECT lower(trim(patient_id)) AS u, bool_or(lower(trim(split)) = 'train') AS a, bool_or(lower(trim(split)) = 'test') AS b FROM manifest WHERE patient_id IS NOT NULL AND split IS NOT NULL GROUP BY 1) SELECT count(*) FILTER (WHERE a) AS n_train, count(*) FILTER (WHERE b) AS n_test, count(*) FILTER (WHERE a AND b) AS n_both, coalesce((SELECT string_agg(u, ',' ORDER BY u) FROM (SELECT u FROM p WHERE a AND b ORDER BY u LIMIT 20)), '') AS examples, count(*) FILTER (WHERE a AND b) = 0 AS clean FROM p",
    "running_duplicates": "WITH m AS (SELECT DISTINCT lower(trim(case_id)) AS c, lower(trim(split)) AS s, slice_name, ingested_at FROM manifest WHERE case_id IS NOT NULL AND slice_name IS NOT NULL) SELECT seen_before, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY s, c ORDER BY ingested_at, slice_name) > 1 AS seen_before FROM m) GROUP BY 1",
    "last_size": "SELECT case_id, orig_h FROM (SELECT case_id, orig_h, row_number() OVER (PARTITION BY case_id ORDER BY ingested_at DESC NULLS LAST, orig_h DESC) AS r FROM manifest WHERE case_id IS NOT NULL AND orig_h IS NOT NULL) WHERE r = 1",
    "partition_check": f"WITH {_LIVE}, m AS (SELECT DISTINCT slice_name FROM live WHERE sp = 'train'), f AS (SELECT DISTINCT unnest(cumulative_full_slice_names) AS s FROM selection WHERE round = 0) SELECT 'unknown' AS error, count(*) AS n FROM f WHERE s IS NOT NULL AND s NOT IN (SELECT slice_name FROM m) HAVING n > 0",
    "set_operations": "WITH a AS (SELECT DISTINCT case_id FROM manifest WHERE case_id IS NOT NULL), b AS (SELECT DISTINCT case_id FROM score_box_pool WHERE case_id IS NOT NULL) SELECT 'intersect' AS op, count(*) AS n FROM a WHERE case_id IN (SELECT case_id FROM b) UNION ALL SELECT 'minus', count(*) FROM a WHERE case_id NOT IN (SELECT case_id FROM b) UNION ALL SELECT 'plus', count(*) FROM b WHERE case_id NOT IN (SELECT case_id FROM a) UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)",
    "cumulative_full": "WITH s AS (SELECT dataset_name, fold, seed, round, unnest(selected_new_ids) AS id FROM selection WHERE seed IS NOT NULL), f AS (SELECT dataset_name, fold, seed, id, min(round) AS round FROM s WHERE id IS NOT NULL GROUP BY ALL), p AS (SELECT dataset_name, fold, seed, round, count(*) AS new FROM f GROUP BY ALL) SELECT *, (sum(new) OVER (PARTITION BY dataset_name, fold, seed ORDER BY round))::BIGINT AS known FROM p",
    "fixed_split": f"WITH i AS (SELECT DISTINCT case_id FROM manifest WHERE case_id IS NOT NULL) SELECT case_id, CASE WHEN row_number() OVER (ORDER BY {_H}, case_id) <= 100 THEN 'train' ELSE 'test' END AS split FROM i",
    "stratified_split": f"WITH i AS (SELECT DISTINCT case_id, dataset_name FROM manifest WHERE case_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY {_H}, case_id) AS r, count(*) OVER (PARTITION BY dataset_name) AS n FROM i) SELECT case_id, dataset_name, CASE WHEN r <= CASE WHEN n > 1 THEN greatest(1, least(n - 1, round_even(n * 0.8::DOUBLE, 0))) ELSE round_even(n * 0.8::DOUBLE, 0) END THEN 'train' ELSE 'test' END AS split FROM r",
    "per_group": f"WITH i AS (SELECT DISTINCT case_id, dataset_name FROM manifest WHERE case_id IS NOT NULL) SELECT case_id, dataset_name FROM (SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY {_H}, case_id) AS r FROM i) WHERE r <= 10",
    "slice_index": f"WITH {_LIVE} SELECT case_id, slice_name, (row_number() OVER (PARTITION BY case_id ORDER BY slice_name) - 1)::INTEGER AS at FROM (SELECT DISTINCT case_id, slice_name FROM live WHERE case_id IS NOT NULL)",
    "incremental": "SELECT DISTINCT slice_name FROM score_box_pool WHERE slice_name NOT IN (SELECT slice_name FROM prompts_train WHERE slice_name IS NOT NULL)",
    "contract": f"""WITH {_LIVE}, n AS (SELECT DISTINCT slice_name AS k FROM live), t AS (SELECT DISTINCT slice_name AS k FROM live WHERE sp = 'train'), p AS (SELECT DISTINCT slice_name AS k FROM prompts_train), g AS (SELECT DISTINCT slice_name AS k FROM geometry_meta),
v AS (SELECT 'key_repeated' AS "check", slice_name AS k FROM live GROUP BY slice_name HAVING count(*) > 1
UNION ALL SELECT 'prompt_without_row', k FROM p WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT 'train_without_prompt', k FROM t WHERE k NOT IN (SELECT k FROM p)
UNION ALL SELECT 'train_without_geometry', k FROM t WHERE k NOT IN (SELECT k FROM g) UNION ALL SELECT DISTINCT 'prompt_not_train', slice_name FROM prompts_train WHERE lower(trim(split)) <> 'train'
UNION ALL SELECT DISTINCT 'no_split', slice_name FROM live WHERE split IS NULL), r AS (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY k) AS r FROM v)
SELECT "check", count(*) AS n, coalesce(string_agg(k, ',' ORDER BY k) FILTER (WHERE r <= 10), '') AS examples FROM r GROUP BY 1""",
    "nearest_prompt": f"""WITH {_LIVE}, p AS (SELECT DISTINCT slice_name FROM prompts_train WHERE len(instances) > 0), s AS (SELECT case_id, slice_idx, bool_or(p.slice_name IS NOT NULL) AS has FROM live LEFT JOIN p USING (slice_name) WHERE slice_idx IS NOT NULL AND case_id IS NOT NULL GROUP BY ALL)
SELECT a.case_id, a.slice_idx, (SELECT b.slice_idx FROM s b WHERE b.case_id = a.case_id AND b.has ORDER BY abs(b.slice_idx - a.slice_idx), b.slice_idx LIMIT 1) AS nearest FROM s a""",
    "prompt_gaps": 'WITH m AS (SELECT DISTINCT case_id, slice_idx AS z1 FROM prompts_train WHERE slice_idx IS NOT NULL AND case_id IS NOT NULL AND len(instances) > 0), l AS (SELECT *, lead(z1) OVER (PARTITION BY case_id ORDER BY z1) AS z2 FROM m) SELECT *, z2 - z1 - 1 AS "between" FROM l WHERE z2 IS NOT NULL',
    "start_slices": "WITH b AS (SELECT case_id, slice_idx, unnest(instances).bbox_native AS b FROM prompts_train WHERE case_id IS NOT NULL), a AS (SELECT case_id, slice_idx, greatest(0.0, b[3] - b[1] + 1) * greatest(0.0, b[4] - b[2] + 1) AS area FROM b WHERE b IS NOT NULL AND slice_idx IS NOT NULL) SELECT case_id, slice_idx, area FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY area DESC, slice_idx) AS r FROM a) WHERE r = 1",
    "round_summary": f"SELECT dataset, round, count(*) AS n, bool_and(all_instance_iou_ge_threshold = 1) AS all_pass, min({_FIN.format('image_min_iou')}) AS least, sum(hard_candidate)::BIGINT AS n_hard, sum(empty_instance_count)::BIGINT AS empties FROM (SELECT DISTINCT * FROM score_box_pool) GROUP BY dataset, round",
    "hard_ranking": f"""WITH s AS (SELECT dataset, round, slice_name, {_FIN.format('image_min_iou')} AS l, {_FIN.format('image_macro_iou')} AS m, empty_instance_count AS e FROM score_box_pool), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, round, slice_name ORDER BY l, m, e) AS r FROM s) WHERE r = 1)
SELECT dataset, round, slice_name, place FROM (SELECT *, row_number() OVER (PARTITION BY dataset, round ORDER BY l, e DESC, m, slice_name)::INTEGER AS place FROM o WHERE l < 0.45::DOUBLE) WHERE place <= 5""",
    "image_scores": """WITH i AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber = 7 THEN 0.0::DOUBLE ELSE l_discount * 10 END AS iou, l_linenumber = 7 AS e FROM lineitem), a AS (SELECT k, count(*) AS n, avg(iou) AS macro, min(iou) AS least, count(*) FILTER (WHERE e) AS empties FROM i GROUP BY k)
SELECT o_orderkey AS image, coalesce(n, 0) AS num_instances, round(coalesce(macro, 1.0::DOUBLE) + 1e-7::DOUBLE, 5) AS macro, round(coalesce(least, 1.0::DOUBLE), 5) AS least, coalesce(empties, 0) AS empties, coalesce(least, 1.0::DOUBLE) >= 0.2::DOUBLE AS passes, coalesce(least, 1.0::DOUBLE) < 0.2::DOUBLE AS hard FROM orders LEFT JOIN a ON k = o_orderkey""",
    "case_scores": """WITH l AS (SELECT o_custkey AS c, l_linenumber AS lab, l_quantity::BIGINT AS q, l_linenumber::BIGINT * 6 AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey), x AS (SELECT c, lab, greatest(0, least(q, k) - 5) AS i, greatest(q, k) AS u, q AS g, CASE WHEN lab = 7 THEN 0 ELSE k END AS p FROM l),
po AS (SELECT c, lab, sum(i)::DOUBLE / sum(u) AS iou, sum(p) AS p FROM x GROUP BY c, lab HAVING sum(g) > 0), bc AS (SELECT c, avg(iou) AS macro, count(*) FILTER (WHERE p = 0) AS missed, count(*) AS n_classes FROM po GROUP BY c),
r AS (SELECT c, i::DOUBLE / u AS iou, row_number() OVER (PARTITION BY c ORDER BY i::DOUBLE / u) AS r, count(*) OVER (PARTITION BY c) AS n FROM x WHERE u > 0), w AS (SELECT c, min(iou) AS least, avg(iou) FILTER (WHERE r <= ceil(n * 0.2::DOUBLE)) AS worst, count(*) AS n_evaluated FROM r GROUP BY c)
SELECT c AS "case", round(macro + 1e-7::DOUBLE, 5) AS macro, round(least + 1e-7::DOUBLE, 5) AS least, round(worst + 1e-7::DOUBLE, 5) AS worst, missed, n_classes, n_evaluated, least < 0.1::DOUBLE OR missed > 0 AS hard FROM bc JOIN w USING (c)""",
    "worst_fifth": "WITH s AS (SELECT DISTINCT * FROM score_box_pool WHERE case_id IS NOT NULL), r AS (SELECT case_id, image_min_iou AS v, row_number() OVER (PARTITION BY case_id ORDER BY image_min_iou) AS r, count(*) OVER (PARTITION BY case_id) AS n FROM s WHERE image_min_iou IS NOT NULL AND NOT isnan(image_min_iou)) SELECT case_id, round(avg(v) FILTER (WHERE r <= ceil(n * 0.2::DOUBLE)) + 1e-7::DOUBLE, 5) AS worst FROM r GROUP BY case_id",
    "weighted_percentile": "WITH f AS (SELECT l_suppkey, l_extendedprice, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) / sum(w) OVER (PARTITION BY l_suppkey) AS s FROM f) SELECT l_suppkey, min(l_extendedprice) FILTER (WHERE s >= 0.95::DOUBLE) AS l_extendedprice FROM r GROUP BY l_suppkey",
    "gap_closure": """WITH s AS (SELECT DISTINCT * FROM score_box_pool WHERE image_macro_iou IS NOT NULL AND NOT isnan(image_macro_iou)), p AS (SELECT dataset, round, sum(round(image_macro_iou * 1000000)::BIGINT)::DOUBLE / count(*) / 1e6::DOUBLE AS m FROM s GROUP BY ALL),
f AS (SELECT dataset, arg_min(m, round) AS base, arg_max(m, round) AS ours, max(m) AS best FROM p GROUP BY dataset) SELECT dataset, round(ours - base, 5) AS gain, round((ours - base) / nullif(best - base, 0), 4) AS closed FROM f""",
    "progress_state": """WITH e AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' ELSE 'running' END AS status FROM events),
s AS (SELECT user_id, min(ts) AS started_at, max(ts) AS last_update_at, arg_max(status, (ts, status)) AS status, max(ts) FILTER (WHERE status IN ('success', 'failed', 'skipped')) AS finished_at, count(*) AS n_updates FROM e GROUP BY user_id)
SELECT *, round(greatest(0, epoch_us(last_update_at) - epoch_us(started_at)) / 1e6::DOUBLE, 3) AS elapsed FROM s""",
    "progress_stats": """WITH f AS (SELECT user_id, event_id, unnest(json_keys(props)) AS name, props FROM events), v AS (SELECT user_id, event_id, name, json_extract_string(props, '$."' || name || '"') AS value, json_type(json_extract(props, '$."' || name || '"')) AS t FROM f)
SELECT user_id, name, arg_max(value, event_id) AS value FROM v WHERE t NOT IN ('OBJECT', 'ARRAY') GROUP BY user_id, name""",
    "moving_mean": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) + 1e-7::DOUBLE, 4) AS moving_mean FROM events",
}
ORACLES = {f"cat_{k}": v for k, v in ORACLES.items()}
