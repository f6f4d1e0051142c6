"""Building and checking supervision: training pairs, guards, lookups, augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewright.functions import text
from slicewright.operators.catalog import unit_order
from slicewright.operators.detection import best_component


def training_pairs(prompts: DataFrame, components: DataFrame, image: str = "slice_name") -> tuple[DataFrame, DataFrame]:
    """(pairs, problems): one pair for each instance with its component.

    ``prompts``: image, instances; ``components``: image, component, x1, y1, x2, y2. Pairs have pair_id, image, k,
    label_id, component and how it was found; problems name images without instances (``empty``) and instances
    without a component (``no target``).
    """
    inst = prompts.select(image, F.posexplode("instances").alias("k", "i")).select(image, "k", F.col("i.component_id").alias("component_id"), F.col("i.label_id").alias("label_id"), F.col("i.bbox_native").alias("box"))
    found = best_component(inst.select(image, "k", "component_id", "box"), components, image, ["k"])
    joined = inst.select(image, "k", "label_id").join(found, [image, "k"])
    pairs = joined.where("component is not null").withColumn("pair_id", text.pair_id(F.col(image), F.col("k"), F.col("component")))
    empty = prompts.where(F.coalesce(F.size("instances"), F.lit(0)) <= 0).select(image, F.lit("empty").alias("problem"))
    lost = joined.where("component is null").select(image, F.lit("no target").alias("problem"))
    return pairs.select("pair_id", image, "k", "label_id", "component", "how"), empty.unionByName(lost)


def guards(prompts: DataFrame, samples: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """field, n of the rows whose field differs from that of their sample (spaces and case apart); nulls don't differ."""
    plain = lambda c: F.lower(F.trim(c))
    s = samples.where(F.col(key).isNotNull()).select(key, *(plain(F.col(f)).alias(f"_{f}") for f in fields)).distinct()
    j = prompts.join(s, key)
    wrong = F.array(*(F.when(plain(F.col(f)) != F.col(f"_{f}"), f) for f in fields))
    return j.select(key, F.explode(F.array_compact(wrong)).alias("field")).distinct().groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def check_hybrid(labels: DataFrame, truth: DataFrame, union: DataFrame, full: DataFrame, key: str) -> DataFrame:
    """key, problem, n: pixels that break the rules of hybrid supervision.

    ``labels`` and ``truth``: key, y, x, value (non-zero pixels only); ``union``: key, y, x of pixels in any prompt;
    ``full``: keys with full annotation. Full labels equal the truth and hold no 255; others are non-zero inside
    the union only. A key with labels but no sample in ``truth`` is not judged here; see ``missing_and_extra``.
    """
    at = [key, "y", "x"]
    own = labels.join(full.select(key), key, "left_semi")
    differs = own.alias("l").join(truth.join(full.select(key), key, "left_semi").alias("t"), at, "full").where(~F.col("l.value").eqNullSafe(F.col("t.value"))).select(key, F.lit("full differs from truth").alias("problem"))
    ignore = own.where("value = 255").select(key, F.lit("full with ignore").alias("problem"))
    outside = labels.join(full.select(key), key, "left_anti").join(union.select(*at), at, "left_anti").select(key, F.lit("outside of prompts").alias("problem"))
    return differs.unionByName(ignore).unionByName(outside).groupBy(key, "problem").agg(F.count(F.lit(1)).alias("n"))


def value_at(pixels: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """points (key, y, x) with the value there; 0 where no pixel is."""
    return points.join(pixels.select(key, "y", "x", "value"), [key, "y", "x"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def majority_label(pixels: DataFrame, under: DataFrame, key: str) -> DataFrame:
    """key and the most frequent value of the pixels under a mask (key, y, x); of equals the lowest."""
    n = pixels.join(under.select(key, "y", "x").distinct(), [key, "y", "x"]).groupBy(key, "value").agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(key).agg(F.max_by("value", F.struct("_n", (-F.col("value")).alias("v"))).alias("value"))


def synonym(label: Column, words: dict[int, list[str]], seed: int, ident: Column) -> Column:
    """A word for a label, picked by a hash of the identifier; null for labels without words."""
    table = F.create_map(*(x for k, v in sorted(words.items()) for x in (F.lit(k), F.array(*(F.lit(w) for w in v)))))
    choice = F.try_element_at(table, label)
    return F.get(choice, F.floor(unit_number(seed, ident) * F.size(choice)).cast("int"))


def unit_number(seed: int, ident: Column) -> Column:
    """A number in [0, 1) that depends on seed and identifier only."""
    return F.conv(F.substring(unit_order(seed, ident), 1, 13), 16, 10).cast("double") / float(1 << 52)


def split_by_shares(items: DataFrame, ident: str, shares: dict[str, float], seed: int) -> DataFrame:
    """ident, split: each identifier on its own by its number, so it stays where it is as others come."""
    u = unit_number(seed, F.col(ident))
    names, upto, choice = list(shares), 0.0, None
    cuts = []
    for s in names[:-1]:
        upto += shares[s]
        cuts.append((s, upto))
    choice = F.lit(names[-1])
    for s, cut in reversed(cuts):
        choice = F.when(u < cut, s).otherwise(choice)
    return items.select(ident).where(F.col(ident).isNotNull()).distinct().select(ident, choice.alias("split"))


def jitter_box(box: Column, shift: int, w: Column, h: Column, seed: int, ident: Column) -> Column:
    """A box widened on each side by 0 to ``shift`` pixels of its own, at most to (w, h): for training, half-open."""
    step = lambda side: F.floor(unit_number(seed + side, ident) * (shift + 1))
    b = [F.get(box, F.lit(i)) for i in range(4)]
    out = F.array(F.greatest(F.lit(0.0), b[0] - step(0)), F.greatest(F.lit(0.0), b[1] - step(1)), F.least(w.cast("double"), b[2] + step(2)), F.least(h.cast("double"), b[3] + step(3)))
    return F.when(box.isNotNull(), out)


def inner_point(pixels: DataFrame, key: list[str], seed: int) -> DataFrame:
    """key, y, x of one pixel of each object, picked by hash: a row of it, so the point is always inside."""
    order = F.struct(unit_order(seed, F.concat_ws(":", *key, "y", "x")).alias("h"), "y", "x")
    best = pixels.groupBy(*key).agg(F.min(order).alias("p"))
    return best.select(*key, F.col("p.y").alias("y"), F.col("p.x").alias("x"))


def epoch_mean(log: DataFrame, by: list[str], loss: str) -> DataFrame:
    """by, mean, legacy_mean: the mean loss, and the sum over one step less that older logs hold (null for one step)."""
    n = F.count(loss)
    return log.groupBy(*by).agg(F.avg(loss).alias("mean"), F.try_divide(F.sum(loss), n - 1).alias("legacy_mean"))


def run_pairs(s: Column) -> Column:
    """(start, length) structs of a text of alternating starts and lengths; a last odd number is left out; null for null."""
    n = F.transform(F.filter(F.split(F.trim(s), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("bigint"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / 2).cast("int") - 1), lambda i: F.struct(F.get(n, 2 * i).alias("start"), F.get(n, 2 * i + 1).alias("length")))
    return F.when(F.size(n) >= 2, pairs).when(s.isNotNull(), F.array().cast("array<struct<start:bigint,length:bigint>>"))


def seen_first(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group by ``order``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")
