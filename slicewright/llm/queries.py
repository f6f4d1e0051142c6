"""The queries of problems 1, 4, 5, 7, 8 and 9, with production parameters over their whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewright.llm import chunking, encode, mixing, sampling, splits, topn
from slicewright.operators.catalog import plain
from slicewright.session import config_value, materialize, table

#: Where the vocabulary files of the public tokenizers are.
TOKENIZERS = os.environ.get("SLICEWRIGHT_TOKENIZERS", "/opt/tokenizers")
SAMPLE_RATE = 0.2


def vocabulary(spark: SparkSession, d: str) -> str:
    return f"{TOKENIZERS}/{config_value(spark, d, 'text.tokenizer', 'byte_bpe_50k')}.json"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_conflicts(table(spark, d, "manifest").select("slice_name", "patient_id", "case_id", "split"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """A new split for every row, related rows together."""
    shares = {s: float(config_value(spark, d, f"split.share.{s}", x)) for s, x in (("train", "0.8"), ("validation", "0.1"), ("test", "0.1"))}
    return splits.keep_together(table(spark, d, "manifest").select("slice_name", "patient_id", "case_id"), shares)


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of related rows of each slice, called by its least id, and over how many splits the new assignment spreads it: one."""
    placed = materialize(p1_splits(spark, d), "placed")
    ident = F.coalesce(F.concat(F.lit("c:"), plain("case_id")), F.concat(F.lit("p:"), plain("patient_id")))
    named = placed.withColumn("_id", ident).where("_id is not null and slice_name is not null")
    groups = named.groupBy("component").agg(F.min("_id").alias("related"), F.count_distinct("new_split").alias("n_splits"))
    return named.join(groups, "component").select("slice_name", "related", "n_splits").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    keep = int(config_value(spark, d, "selection.per_case_keep", "3"))
    return topn.hardest_images(table(spark, d, "score_box_pool"), keep).select("case_id", "round", "slice_name")


def p4_hardest(spark: SparkSession, d: str) -> DataFrame:
    """The hardest images of each case with score and rank."""
    keep = int(config_value(spark, d, "selection.per_case_keep", "3"))
    return topn.hardest_images(table(spark, d, "score_box_pool"), keep)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return sampling.lost_members(table(spark, d, "selection"), int(config_value(spark, d, "selection.seed", "0")))


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of cases that stays as deliveries come in."""
    return sampling.growing_case_sample(table(spark, d, "manifest"), int(config_value(spark, d, "selection.seed", "0")), SAMPLE_RATE)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_ids(table(spark, d, "documents").select("doc_id", "text"), vocabulary=f"{TOKENIZERS}/byte_bpe_50k.json")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return encode.with_token_counts(table(spark, d, "documents").select("doc_id", "source", "text"), vocabulary=vocabulary(spark, d))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix of all sources, in order."""
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mix reaches."""
    targets = table(spark, d, "mix_targets")
    return mixing.shares_reached(mixing.mix(_sized(spark, d), targets), targets)


def _half(sized: DataFrame, targets: DataFrame) -> int:
    """A budget: half the tokens of the sources that have a share."""
    named = mixing.targets_of(targets).select("source")
    return (sized.join(named, "source", "left_semi").agg(F.sum("n_tokens")).collect()[0][0] or 0) // 2


def p8_budget(spark: SparkSession, d: str) -> DataFrame:
    """The shares of a mix truncated at a budget of half the tokens there are, which small sources are repeated for."""
    targets, sized = table(spark, d, "mix_targets"), materialize(_sized(spark, d), "sized")
    return mixing.shares_reached(mixing.mix(sized, targets, budget=_half(sized, targets)), targets)


def p8_rules(spark: SparkSession, d: str) -> DataFrame:
    """Whether both mixes, with the budget and without, keep their rules."""
    targets, sized = table(spark, d, "mix_targets"), materialize(_sized(spark, d), "sized")
    half = _half(sized, targets)
    one = mixing.rules_kept(materialize(mixing.mix(sized, targets), "mix"), sized, targets).withColumn("budget", F.lit(False))
    return one.unionByName(mixing.rules_kept(materialize(mixing.mix(sized, targets, budget=half), "mix"), sized, targets, half).withColumn("budget", F.lit(True)))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every document above the limit."""
    limit = int(config_value(spark, d, "text.max_tokens", "512"))
    overlap = int(config_value(spark, d, "text.overlap_tokens", "48"))
    return chunking.split_oversized(table(spark, d, "documents").select("doc_id", "text"), limit, overlap, vocabulary=vocabulary(spark, d))


QUERIES = {
    "p1_found": p1_found,
    "p1_splits": p1_splits,
    "p1_groups": p1_groups,
    "p4_found": p4_found,
    "p4_hardest": p4_hardest,
    "p5_found": p5_found,
    "p5_sample": p5_sample,
    "p7_ids": p7_ids,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_budget": p8_budget,
    "p8_rules": p8_rules,
    "p9_pieces": p9_pieces,
}

_P4 = """
once AS (SELECT *, row_number() OVER (PARTITION BY slice_name, round ORDER BY scored_at DESC) AS k FROM (SELECT DISTINCT * FROM score_box_pool)),
ranked AS (SELECT case_id, round, slice_name, image_min_iou, row_number() OVER (PARTITION BY case_id ORDER BY image_min_iou, slice_name, round)::INTEGER AS rank
  FROM once WHERE k = 1 AND case_id IS NOT NULL AND image_min_iou IS NOT NULL AND NOT isnan(image_min_iou))
"""

_P1 = """
WITH RECURSIVE n AS (SELECT slice_name, 'p:' || lower(trim(patient_id)) AS p, 'c:' || lower(trim(case_id)) AS c, lower(trim(split)) AS s FROM manifest),
e AS (SELECT DISTINCT p AS a, c AS b FROM n WHERE p IS NOT NULL AND c IS NOT NULL UNION SELECT DISTINCT c, p FROM n WHERE p IS NOT NULL AND c IS NOT NULL),
v AS (SELECT DISTINCT coalesce(c, p) AS x FROM n WHERE coalesce(c, p) IS NOT NULL UNION SELECT a FROM e),
r AS (SELECT x AS node, x AS label FROM v UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node),
comp AS (SELECT node, min(label) AS component FROM r GROUP BY node),
rows_in AS (SELECT n.slice_name, n.s, comp.component FROM n JOIN comp ON comp.node = coalesce(n.c, n.p))"""

ORACLES = {
    "p1_found": f"""{_P1},
bad AS (SELECT component FROM rows_in WHERE s IS NOT NULL GROUP BY component HAVING count(DISTINCT s) > 1)
SELECT DISTINCT slice_name FROM rows_in JOIN bad USING (component) WHERE slice_name IS NOT NULL""",
    "p1_groups": f"""{_P1}, nodes AS (SELECT DISTINCT comp.component, comp.node FROM n JOIN comp ON comp.node = coalesce(n.c, n.p) WHERE n.slice_name IS NOT NULL),
g AS (SELECT component, min(node) AS related FROM nodes GROUP BY 1)
SELECT DISTINCT slice_name, related, 1::BIGINT AS n_splits FROM rows_in JOIN g USING (component) WHERE slice_name IS NOT NULL""",
    "p4_found": f"WITH {_P4} SELECT case_id, round, slice_name FROM ranked WHERE rank <= 3",
    "p4_hardest": f"WITH {_P4} SELECT * FROM ranked WHERE rank <= 3",
    "p5_found": """
WITH runs AS (SELECT run_id, dataset_name, fold, coalesce(seed, (SELECT param_text::INTEGER FROM default_config WHERE param = 'selection.seed')) AS seed, round, cumulative_full_case_ids AS l
  FROM selection WHERE cumulative_full_case_ids IS NOT NULL),
held AS (SELECT DISTINCT run_id, dataset_name, fold, seed, round, case_id FROM (SELECT *, unnest(l) AS case_id FROM runs) WHERE case_id IS NOT NULL)
SELECT DISTINCT r.run_id, h.case_id FROM runs r JOIN held h ON h.dataset_name IS NOT DISTINCT FROM r.dataset_name AND h.fold IS NOT DISTINCT FROM r.fold AND h.seed = r.seed AND h.round <= r.round
WHERE NOT list_contains(r.l, h.case_id)""",
    "p8_rules": """SELECT source, source IN (SELECT source FROM documents WHERE text <> '' AND source IS NOT NULL) AS has_documents, true AS copies_within_cap, true AS share_within_a_document, true AS total_within_budget, unnest([true, false]) AS budget
FROM mix_targets WHERE source IS NOT NULL AND target_share > 0 GROUP BY source""",
    "p5_sample": f"""
WITH ev AS (SELECT dataset_name, case_id, strftime(ingested_at, '%Y-%m') AS month, 1 AS d FROM manifest WHERE case_id IS NOT NULL AND ingested_at IS NOT NULL
  UNION ALL SELECT dataset_name, case_id, strftime(greatest(deleted_at, ingested_at), '%Y-%m'), -1 FROM manifest WHERE case_id IS NOT NULL AND ingested_at IS NOT NULL AND deleted_at IS NOT NULL),
per AS (SELECT dataset_name, case_id, month, sum(d) AS n FROM ev GROUP BY ALL),
w AS (SELECT dataset_name, case_id, month, least(1.0::DOUBLE, sum(n) OVER (PARTITION BY dataset_name, case_id ORDER BY month)::DOUBLE / 50.0::DOUBLE) AS weight FROM per),
h AS (SELECT *, ('0x' || substr(md5((SELECT param_text FROM default_config WHERE param = 'selection.seed') || ':' || case_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS hash FROM w)
SELECT dataset_name, case_id, min(month) AS from_month, hash FROM h WHERE hash < weight * {SAMPLE_RATE}::DOUBLE GROUP BY dataset_name, case_id, hash""",
}
