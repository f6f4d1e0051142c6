"""Operators of the sample catalogue: keys, joins, partition checks, audits, splits."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewright.functions import text
from slicewright.operators.prefix import hash_running_sum, slot_bits
from slicewright.session import materialize


def plain(c: Column | str) -> Column:
    return F.lower(F.trim(c))


def sample_key(df: DataFrame, paths: list[str]) -> Column:
    """slice_name, else the base name of the first path that isn't empty."""
    return F.coalesce(F.nullif(F.trim("slice_name"), F.lit("")), *(F.nullif(text.base_name(F.col(p)), F.lit("")) for p in paths))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and n of the keys that more than one row has (nulls are a key too)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_and_extra(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key and side: ``missing`` on the right or ``extra`` there; null keys are neither."""
    a, b = left.select(key).where(F.col(key).isNotNull()).distinct(), right.select(key).where(F.col(key).isNotNull()).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def prefix_join(left: DataFrame, left_key: str, right: DataFrame, right_key: str, separator: str = "_") -> DataFrame:
    """left joined with the right rows whose key begins with the left key and a separator, where there is exactly one.

    The right key's possible prefixes end before a separator, so each is exploded and met by an equi-join.
    """
    parts = F.split(F.col(right_key), separator)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))
    heads = right.where(F.size(parts) > 1).withColumn("_head", F.explode(prefixes))
    joined = left.join(heads, left[left_key] == heads["_head"])
    n = F.count(F.lit(1)).over(Window.partitionBy(left_key))
    return joined.withColumn("_n", n).where("_n = 1").drop("_n", "_head")


def split_membership(items: DataFrame, key: str, lists: DataFrame, order: list[str]) -> DataFrame:
    """items with ``split``, by the lists (key, split); of several the first in ``order``; those in none are dropped."""
    rank = F.array_position(F.array(*(F.lit(s) for s in order)), F.col("split"))
    best = lists.where(rank > 0).groupBy(key).agg(F.min_by("split", rank).alias("split"))
    return items.drop("split").join(best, key)


def stem_pairs(images: DataFrame, masks: DataFrame, path: str) -> DataFrame:
    """stem, image, mask of the paths whose stems agree; of several of one stem the last path wins."""
    one = lambda df, name: df.where(F.col(path).isNotNull()).groupBy(text.safe_stem(F.col(path)).alias("stem")).agg(F.max(path).alias(name))
    return one(images, "image").join(one(masks, "mask"), "stem")


def label_counts(instances: DataFrame, label: str, slice_col: str, case: str) -> DataFrame:
    return instances.groupBy(label).agg(F.count_distinct(slice_col).alias("n_slices"), F.count_distinct(case).alias("n_cases"))


def leakage(df: DataFrame, unit: str, split: str, head: int = 20) -> DataFrame:
    """One row: units per train and test, how many are in both, the first examples, and whether it is clean. Null units and splits are left out."""
    per = df.where(F.col(unit).isNotNull() & F.col(split).isNotNull()).groupBy(F.col(unit).alias("u")).agg(F.bool_or(F.col(split) == "train").alias("a"), F.bool_or(F.col(split) == "test").alias("b"))
    both = F.col("a") & F.col("b")
    counts = per.agg(F.count_if("a").alias("n_train"), F.count_if("b").alias("n_test"), F.count_if(both).alias("n_both"))
    first = per.where(both).orderBy("u").limit(head).agg(F.sort_array(F.collect_list("u")).alias("examples"))  # at most ``head`` values
    # two rows of one each, met by a constant key
    k = F.lit(1).alias("k")
    return counts.select(k, "*").join(first.select(k, "*"), "k").drop("k").withColumn("clean", F.col("n_both") == 0)


def running_duplicates(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with ``seen_before``: not the first row of its group by ``order``."""
    return df.withColumn("seen_before", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) > 1)


def last_value(df: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """by and the non-null value written last."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value))


def partition_errors(whole: DataFrame, full: DataFrame, box: DataFrame, key: str) -> DataFrame:
    """key, error where full and box don't make a partition of whole: ``in both``, ``in neither``, ``unknown``."""
    tag = lambda df, n: df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("side", F.lit(n))
    sides = tag(whole, "w").unionByName(tag(full, "f")).unionByName(tag(box, "b")).groupBy(key).agg(F.bool_or(F.col("side") == "w").alias("w"), F.bool_or(F.col("side") == "f").alias("f"), F.bool_or(F.col("side") == "b").alias("b"))
    error = F.when(~F.col("w"), "unknown").when(F.col("f") & F.col("b"), "in both").when(~F.col("f") & ~F.col("b"), "in neither")
    return sides.select(key, error.alias("error")).where("error is not null")


def unit_order(seed: int, ident: Column) -> Column:
    """A hash that puts identifiers in a random but fixed order, the same in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), ident))


def split_fixed(items: DataFrame, ident: str, n_train: int, seed: int) -> DataFrame:
    """ident and split: the first n by hash train, the others test."""
    ids = items.select(ident).where(F.col(ident).isNotNull()).distinct()
    return _placed(ids, [], ident, seed).select(ident, F.when(F.col("_place") <= n_train, "train").otherwise("test").alias("split"))


def _placed(ids: DataFrame, by: list[str], ident: str, seed: int) -> DataFrame:
    """``ids`` with ``_place``, their number in their group by hash: a running sum by slots of the hash range, so no task sorts a group.

    The hash is a text of hex digits; its first 15 as a number go before all of it, so the order is that of the text.
    """
    hexed = ids.withColumn("_hex", unit_order(seed, F.col(ident))).withColumn("_one", F.lit(1))
    # sixty bits as a signed number in the same order, moved up to the top bits that make the slots
    number = F.shiftleft(F.conv(F.substring("_hex", 1, 15), 16, 10).cast("bigint") - F.lit(1 << 59), 4)
    return hash_running_sum(hexed, by, number, ["_hex", ident], "_one", "_place", slot_bits(ids.count())).drop("_hex", "_one")


def split_stratified(items: DataFrame, ident: str, label: str, ratio: float, seed: int) -> DataFrame:
    """ident, label, split: per label a rounded part (half-even), at least one on each side of two or more."""
    ids = items.select(ident, F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("")).alias("_label"), label).where(F.col(ident).isNotNull()).distinct()
    n = F.col("_n")
    want = F.rint(n * ratio).cast("bigint")
    want = F.when(n > 1, F.greatest(F.lit(1), F.least(n - 1, want))).otherwise(want)
    sizes = ids.groupBy("_label").agg(F.count(F.lit(1)).alias("_n"))
    placed = _placed(ids, ["_label"], ident, seed).join(sizes, "_label")
    return placed.select(ident, label, F.when(F.col("_place") <= want, "train").otherwise("test").alias("split"))


def take_per_group(items: DataFrame, ident: str, group: str, k: int, seed: int) -> DataFrame:
    """group, ident: k of each group by hash."""
    ids = items.select(ident, group).where(F.col(ident).isNotNull()).distinct()
    place = F.row_number().over(Window.partitionBy(group).orderBy(unit_order(seed, F.col(ident)), ident))
    return ids.withColumn("_p", place).where(F.col("_p") <= k).drop("_p")


#: Identifiers that an exact split may bring to the driver: the shuffle of the generator it has to agree with goes
#: through all of them in turn. Beyond it there is the hash form, which splits the same numbers in another order.
EXACT_LIMIT = 1_000_000


def _sorted_ids(items: DataFrame, ident: str) -> list[str]:
    got = [r[0] for r in items.select(ident).where(F.col(ident).isNotNull()).distinct().orderBy(ident).limit(EXACT_LIMIT + 1).collect()]
    if len(got) > EXACT_LIMIT:
        raise ValueError(f"more than {EXACT_LIMIT} identifiers; use the hash form")
    return got


def split_fixed_exact(items: DataFrame, ident: str, n_train: int, seed: int) -> tuple[list[str], list[str]]:
    """Train and test by a seeded Mersenne Twister shuffle of the sorted identifiers, of which there may be EXACT_LIMIT."""
    ids = _sorted_ids(items, ident)
    random.Random(seed).shuffle(ids)
    return sorted(ids[:n_train]), sorted(ids[n_train:])


def sample_exact(items: DataFrame, ident: str, n: int, seed: int) -> list[str]:
    """n identifiers by a seeded shuffle of the sorted ones; more than there are is an error."""
    ids = _sorted_ids(items, ident)
    if not 0 <= n <= len(ids):
        raise ValueError(f"{n} of {len(ids)} identifiers")
    random.Random(seed).shuffle(ids)
    return sorted(ids[:n])


def stratified_exact(case_to_label: dict[str, str], ratio: float, seed: int) -> tuple[list[str], list[str]]:
    """Train and test with one generator for all labels in sorted order."""
    rng = random.Random(seed)
    train, test = [], []
    for label in sorted(set(case_to_label.values())):
        ids = sorted(k for k, v in case_to_label.items() if v == label)
        rng.shuffle(ids)
        n = round(len(ids) * ratio)
        if len(ids) > 1:
            n = max(1, min(len(ids) - 1, n))
        train += ids[:n]
        test += ids[n:]
    return sorted(train), sorted(test)


def violations(**checks: DataFrame) -> DataFrame:
    """check, key of every violation: the union of queries that should be empty; each has one column."""
    out = None
    for name, df in checks.items():
        one = df.select(F.lit(name).alias("check"), F.col(df.columns[0]).cast("string").alias("key"))
        out = one if out is None else out.unionByName(one)
    return out


def violation_counts(found: DataFrame, head: int = 10) -> DataFrame:
    """check, n and the first examples in order."""
    # a rank filter keeps ``head`` rows a check on each side of its shuffle
    first = found.select("check", "key").withColumn("_r", F.row_number().over(Window.partitionBy("check").orderBy("key"))).where(F.col("_r") <= head)
    some = first.groupBy("check").agg(F.array_join(F.sort_array(F.collect_set("key")), ",").alias("examples"))
    return found.groupBy("check").agg(F.count(F.lit(1)).alias("n")).join(some, "check")


def content_hash(files: DataFrame) -> DataFrame:
    """path and sha256 of binary files (path, content)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


#: Children of a node of the hash tree: what one task folds at most, on average.
FAN_OUT = 4096


def tree_hash(files: DataFrame) -> DataFrame:
    """One hash of a tree of files (path, content), ``sha256``; of an empty tree that of an empty text.

    A Merkle tree over the hashes of paths: the files are cut by the hash of their path into as many leaves as a fixed
    fan-out asks for, each leaf hashes its sorted paths and contents, and leaves are folded in turn. The shape depends on
    the number of files alone, so the same tree gives the same hash however it is stored.
    """
    level = content_hash(files).select(F.sha2("path", 256).alias("k"), F.concat_ws(":", "path", "sha256").alias("v"))
    level = materialize(level, "hashes")
    n = level.count()
    while True:
        bits = max(0, (max(0, n - 1) // FAN_OUT).bit_length())
        node = F.substring(F.lpad(F.conv(F.substring("k", 1, 8), 16, 2), 32, "0"), 1, bits) if bits else F.lit("")
        folded = level.groupBy(node.alias("node")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("v")), "\n"), 256).alias("h"))
        if not bits:
            break
        level = materialize(folded.select(F.sha2("node", 256).alias("k"), F.concat_ws(":", "node", "h").alias("v")), "hashes")
        n = 1 << bits
    return folded.agg(F.coalesce(F.first("h"), F.sha2(F.lit(""), 256)).alias("sha256"))


def label_audit_summary(audits: DataFrame) -> DataFrame:
    """Per dataset_name: num_cases, binarize_modes and cleanup_modes (sorted, distinct, without nulls), cases_with_removed, max_unique.

    ``audits``: dataset_name, binarize_mode, cleanup_mode, removed_components, source_unique_count, a row a case.
    """
    return audits.groupBy("dataset_name").agg(
        F.count(F.lit(1)).alias("num_cases"), F.sort_array(F.collect_set("binarize_mode")).alias("binarize_modes"), F.sort_array(F.collect_set(F.nullif("cleanup_mode", F.lit("")))).alias("cleanup_modes"),
        F.count_if(F.coalesce("removed_components", F.lit(0)) > 0).alias("cases_with_removed"), F.coalesce(F.max("source_unique_count"), F.lit(0)).alias("max_unique"),
    )


def tiny_totals(verdicts: DataFrame, key: str) -> DataFrame:
    """One row: samples with a removed component, removed components and removed pixels (``components.tiny_verdicts``)."""
    gone = verdicts.where("removed")
    return gone.agg(F.count_distinct(key).alias("samples"), F.count(F.lit(1)).alias("components"), F.coalesce(F.sum("area"), F.lit(0)).alias("pixels"))


def known_names(chosen: str, there: list[str]) -> list[str]:
    """The names that a comma list chooses, ``all`` standing for all there are, sorted; an unknown one is an error."""
    if chosen.strip().lower() == "all":
        return sorted(there)
    names = [x.strip() for x in chosen.split(",") if x.strip()]
    unknown = [x for x in names if x not in there]
    if unknown:
        raise ValueError(f"unknown: {', '.join(unknown)}; known: {', '.join(sorted(there))}")
    return names
