"""Schemas that drift between files: profile, match, unify.

Input: one row per raw line with file_id, dataset_name, fold, file_seq and payload (one JSON object).

* ``profile_fields``: per file and top-level field the set of value kinds, and min-hash sketches of its values
  and of their shapes;
* ``match_columns``: the columns of each file matched with those of the file before it in its series: columns
  of the same name with each other, the others by bipartite matching over name likeness, kinds and sketches;
* ``field_changes`` and ``match_renames`` read added, removed, changed type and renames from the matching;
* ``canonical_names`` and ``wide``: one consistent table over all files.

Lines that are no valid JSON object (null payloads included) are skipped; a file with only such lines has
no fields. JSON null values have no kind. Everything but the matching of columns left over in a pair of files, whose
number is that of the fields of a file, runs in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of the sketches: each keeps the least hash that falls into it.
VALUE_BUCKETS, SHAPE_BUCKETS = 16, 8
#: What a JSON value can be.
KINDS = ("array", "array of numbers", "array of strings", "boolean", "number", "object", "string")
#: Weights of what makes two columns alike: their names, a kind in common, their values, the shapes of these. None is
#: enough alone; how well they tell planted renames is in the README and the tests.
WEIGHTS = (0.2, 0.2, 0.3, 0.3)
#: Renames below this likeness are taken for a removed and an added column.
LEAST_SCORE = 0.45
#: Likeness, added up over the files a rename is seen in, from which two names are one column: one clear rename, or two faint ones.
LEAST_EVIDENCE = 0.7
#: Renames that may be brought to the driver as a map of names; checked.
MOST_NAMES = 100_000
#: Files in one slot of a series; the windows over files hold at most this many.
SLOT_FILES = 1024


def kind_of(t: Column) -> Column:
    """One of KINDS from a variant's schema; ``array`` for empty or mixed ones; null for JSON null."""
    number = r"(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))"
    return (
        F.when(t == "VOID", F.lit(None).cast("string"))
        .when(t == "STRING", "string")
        .when(t.rlike(f"^{number}$"), "number")
        .when(t == "BOOLEAN", "boolean")
        .when(t.startswith("OBJECT"), "object")
        .when(t.rlike(f"^ARRAY<{number}>$"), "array of numbers")
        .when(t == "ARRAY<STRING>", "array of strings")
        .otherwise("array")
    )


def parse_lines(raw: DataFrame) -> DataFrame:
    """raw with ``fields``: map of the top-level fields as variants; null for lines that are no JSON object."""
    return raw.withColumn("fields", F.try_variant_get(F.try_parse_json("payload"), "$", "map<string,variant>"))


def _least(h: str, bucket: str, buckets: int) -> Column:
    return F.array(*(F.min(F.when(F.col(bucket) == b, F.col(h))) for b in range(buckets)))


def shape_of(value: Column) -> Column:
    """A value with its runs of digits and of letters levelled, so that alike ids agree."""
    return F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), "[A-Za-z]+", "a")


def profile_fields(raw: DataFrame) -> DataFrame:
    """file_id, field_name, kinds (sorted), n_lines, n_values, sketch and shapes.

    A sketch keeps the least hash in each of a fixed number of buckets, so a group of any size is folded before
    the shuffle.
    """
    # an inner explode would be given a filter on its map, which parses each line twice more
    rows = parse_lines(raw).select("file_id", F.explode_outer("fields").alias("field_name", "v")).where("field_name is not null")
    rows = rows.select("file_id", "field_name", F.schema_of_variant("v").alias("t"), F.to_json("v").alias("value"))
    rows = rows.select("file_id", "field_name", kind_of(F.col("t")).alias("kind"), "value")
    bit = F.coalesce(*(F.when(F.col("kind") == k, 1 << i) for i, k in enumerate(KINDS)), F.lit(0))
    there = F.col("kind").isNotNull()
    rows = rows.select("file_id", "field_name", bit.alias("bit"), there.alias("there"), F.when(there, F.xxhash64("value")).alias("h"), F.when(there, F.xxhash64(shape_of(F.col("value")))).alias("s"))
    rows = rows.select("*", F.pmod("h", F.lit(VALUE_BUCKETS)).cast("int").alias("hb"), F.pmod("s", F.lit(SHAPE_BUCKETS)).cast("int").alias("sb"))
    # all of the buffers are numbers, so the rows are hashed, not sorted
    folded = rows.groupBy("file_id", "field_name").agg(
        F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("n_lines"), F.count_if("there").alias("n_values"), _least("h", "hb", VALUE_BUCKETS).alias("sketch"), _least("s", "sb", SHAPE_BUCKETS).alias("shapes")
    )
    kinds = F.array_compact(F.array(*(F.when(F.col("bits").bitwiseAND(1 << i) != 0, k) for i, k in enumerate(KINDS))))
    return folded.select("file_id", "field_name", kinds.alias("kinds"), "n_lines", "n_values", "sketch", "shapes")


def file_pairs(raw: DataFrame) -> DataFrame:
    """file_id and prev_id, the file before it by file_seq (then file_id) in its dataset_name and fold.

    A series may hold a third of all files, so files are first ordered in slots of file_seq; the first of a
    slot takes the last of the slot before, which is a window over slots only.
    """
    files = raw.select("file_id", "dataset_name", "fold", "file_seq").distinct().withColumn("slot", F.floor(F.col("file_seq") / SLOT_FILES))
    series = ["dataset_name", "fold"]
    inside = Window.partitionBy(*series, "slot").orderBy("file_seq", "file_id")
    ordered = files.withColumn("p", F.lag("file_id").over(inside)).withColumn("first", F.row_number().over(inside) == 1)
    last = files.groupBy(*series, "slot").agg(F.max(F.struct("file_seq", "file_id")).alias("last"))
    before = last.select(*series, "slot", F.lag("last.file_id").over(Window.partitionBy(*series).orderBy("slot")).alias("b"))
    same = (ordered.dataset_name.eqNullSafe(before.dataset_name)) & (ordered.fold.eqNullSafe(before.fold)) & (ordered.slot.eqNullSafe(before.slot))
    joined = ordered.join(before, same, "left")
    return joined.select(ordered.file_id, F.when(F.col("first"), F.col("b")).otherwise(F.col("p")).alias("prev_id"))


def _name_likeness(a: str, b: str) -> float:
    """Half shared words, half shared letter pairs: 0 to 1."""
    wa, wb = set(a.lower().split("_")), set(b.lower().split("_"))
    ga, gb = ({x[i : i + 2] for i in range(len(x) - 1)} or {x} for x in (a.lower(), b.lower()))
    return 0.5 * len(wa & wb) / max(1, min(len(wa), len(wb))) + 0.5 * len(ga & gb) / max(1, len(ga | gb))


def _alike(a, b) -> float:
    """Estimated overlap of the values behind two sketches."""
    pairs = [(x, y) for x, y in zip(a, b) if x or y]  # 0: an empty bucket
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0


def best_assignment(gain: list[list[float]]) -> list[tuple[int, int]]:
    """The matching of rows to columns with the largest total gain: the Hungarian method by shortest augmenting paths, O(n^2 m)."""
    if not gain or not gain[0]:
        return []
    n, m = len(gain), len(gain[0])
    if n > m:
        return [(i, j) for j, i in best_assignment([list(c) for c in zip(*gain)])]
    inf = float("inf")
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = [inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = -gain[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            match[j0] = match[j1]
            j0 = j1
    return sorted((match[j] - 1, j - 1) for j in range(1, m + 1) if match[j])


def likeness(old: dict, new: dict) -> float:
    """How alike two columns are, 0 to 1. A column: field_name, kinds, sketch, shapes (0 for an empty bucket)."""
    parts = (_name_likeness(old["field_name"], new["field_name"]), float(bool(set(old["kinds"]) & set(new["kinds"]))), _alike(old["sketch"], new["sketch"]), _alike(old["shapes"], new["shapes"]))
    return sum(w * p for w, p in zip(WEIGHTS, parts))


MATCHED = "file_id long, old_name string, new_name string, score double, old_kinds array<string>, new_kinds array<string>"


def _matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for file_id, retyped, gone, come in zip(pdf["file_id"], pdf["retyped"], pdf["gone"], pdf["come"]):
            rows += [(file_id, r["field_name"], r["field_name"], None, list(r["old_kinds"]), list(r["new_kinds"])) for r in retyped]
            gone, come = sorted(gone, key=lambda c: c["field_name"]), sorted(come, key=lambda c: c["field_name"])
            gain = [[likeness(g, c) for c in come] for g in gone]
            met = best_assignment(gain)
            rows += [(file_id, gone[i]["field_name"], come[j]["field_name"], gain[i][j], list(gone[i]["kinds"]), list(come[j]["kinds"])) for i, j in met]
            rows += [(file_id, g["field_name"], None, None, list(g["kinds"]), None) for i, g in enumerate(gone) if i not in {i for i, _ in met}]
            rows += [(file_id, None, c["field_name"], None, None, list(c["kinds"])) for j, c in enumerate(come) if j not in {j for _, j in met}]
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in MATCHED.split(", ")]).astype({"score": float})


def match_columns(profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """file_id, old_name, new_name, score, old_kinds, new_kinds: the columns of each file matched with those of the file before it.

    Columns of the same name are matched first, which is part of a largest matching, as no two other pairs are more
    alike together; those whose kinds didn't change, or have none on a side, are not in the result, the others come without a score.
    All other columns are matched one to one with the largest total likeness, their score; a column without a partner has
    nulls on the other side.
    """
    full = lambda n: F.transform(n, lambda x: F.coalesce(x, F.lit(0))).alias(n)
    of_file = profiles.groupBy("file_id").agg(F.collect_list(F.struct("field_name", "kinds", full("sketch"), full("shapes"))).alias("columns"))
    both = pairs.where(F.col("prev_id").isNotNull()).join(of_file.withColumnRenamed("columns", "new"), "file_id", "left")
    both = both.join(of_file.select(F.col("file_id").alias("prev_id"), F.col("columns").alias("old")), "prev_id", "left")
    none = F.array().cast(of_file.schema["columns"].dataType)
    both = both.select("file_id", F.coalesce("old", none).alias("old"), F.coalesce("new", none).alias("new"))
    names = lambda a: F.transform(a, lambda y: y["field_name"])
    but = lambda a, b: F.filter(a, lambda x: ~F.array_contains(names(b), x["field_name"]))
    kinds = lambda a, n: F.get(F.filter(a, lambda y: y["field_name"] == n), F.lit(0))["kinds"]
    kept = F.transform(F.array_intersect(names("new"), names("old")), lambda n: F.struct(n.alias("field_name"), kinds("old", n).alias("old_kinds"), kinds("new", n).alias("new_kinds")))
    differ = lambda k: (F.size(k["old_kinds"]) > 0) & (F.size(k["new_kinds"]) > 0) & (k["old_kinds"] != k["new_kinds"])
    rest = both.select("file_id", F.filter(kept, differ).alias("retyped"), but("old", "new").alias("gone"), but("new", "old").alias("come"))
    return rest.where("size(retyped) + size(gone) + size(come) > 0").mapInPandas(_matched, MATCHED)


def field_changes(matched: DataFrame) -> DataFrame:
    """file_id, field_name, change_kind (added, removed, type), old_kinds, new_kinds; a rename is one removed and one added."""
    none = F.lit(None).cast("array<string>")
    side = lambda name, kind, old, new: F.struct(F.col(name).alias("field_name"), F.lit(kind).alias("change_kind"), old.alias("old_kinds"), new.alias("new_kinds"))
    same = F.array(side("new_name", "type", F.col("old_kinds"), F.col("new_kinds")))
    moved = F.array(side("old_name", "removed", F.col("old_kinds"), none), side("new_name", "added", none, F.col("new_kinds")))
    told = F.explode(F.when(F.col("old_name") == F.col("new_name"), same).otherwise(moved))
    return matched.select("file_id", told.alias("c")).select("file_id", "c.*").where("field_name is not null")


def match_renames(matched: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """file_id, old_name, new_name, score of the matched pairs of different names that are alike enough."""
    return matched.where((F.col("old_name") != F.col("new_name")) & (F.col("score") >= least_score)).select("file_id", "old_name", "new_name", "score")


def name_groups(evidence: list[tuple[str, str, float]], files: dict[str, int], schema: list[str], least: float = LEAST_EVIDENCE) -> dict[str, str]:
    """The canonical name of each name that has another one, from (name, name, evidence).

    Pairs are taken by falling evidence, and names joined by them are one column, so renames are followed through any
    chain; but two names of ``schema`` never become one. A group is called by its name in the schema, else by the most frequent.
    """
    parent: dict[str, str] = {}
    known: dict[str, str | None] = {}

    def root(x: str) -> str:
        parent.setdefault(x, x)
        known.setdefault(x, x if x in schema else None)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, weight in sorted(evidence, key=lambda r: (-r[2], r[0], r[1])):
        a, b = root(a), root(b)
        if weight >= least and a != b and (known[a] is None or known[b] is None):
            parent[b] = a
            known[a] = known[a] or known[b]
    groups: dict[str, list[str]] = {}
    for x in parent:
        groups.setdefault(root(x), []).append(x)
    out = {}
    for top, names in groups.items():
        called = known[top] or min(names, key=lambda n: (-files.get(n, 0), n))
        out |= {n: called for n in names if n != called}
    return out


def canonical_names(renames: DataFrame, profiles: DataFrame, schema: list[str] = (), least: float = LEAST_EVIDENCE) -> dict[str, str]:
    """The canonical name of each renamed field (see ``name_groups``).

    The evidence of two names is the likeness of their renames added up over files. A rename with too little evidence is
    taken for chance: its field stays under its own name, which ``wide`` keeps in ``other_fields``. Only pairs with
    enough evidence reach the driver, at most MOST_NAMES.
    """
    pair = renames.select(F.least("old_name", "new_name").alias("a"), F.greatest("old_name", "new_name").alias("b"), "score")
    sure = pair.groupBy("a", "b").agg(F.sum("score").alias("w")).where(F.col("w") >= least)
    rows = sure.limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} pairs of renamed fields")
    ends = sure.select(F.explode(F.array("a", "b")).alias("field_name")).distinct()
    files = {r[0]: r[1] for r in profiles.join(ends, "field_name", "left_semi").groupBy("field_name").agg(F.count(F.lit(1))).collect()}
    return name_groups([tuple(r) for r in rows], files, list(schema), least)


def unify(raw: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """One row for each distinct valid line: file_id, line_no, cells: array of (name, source, kind, value), sorted by name, its own first.

    A repeated line of a file counts once, with its least line_no. ``name`` is the canonical name of the field
    ``source``, ``value`` its JSON text. JSON null values are left out. Nothing is exploded or shuffled but the lines.
    """
    lines = parse_lines(raw.groupBy("file_id", "payload").agg(F.min("line_no").alias("line_no"))).where("fields is not null")
    called = F.create_map(*(F.lit(x) for pair in sorted((names or {}).items()) for x in pair)) if names else None
    canonical = lambda k: F.coalesce(F.try_element_at(called, k), k) if called is not None else k
    cell = lambda x: F.struct(canonical(x["key"]).alias("name"), (canonical(x["key"]) != x["key"]).alias("other"), x["key"].alias("source"), kind_of(F.schema_of_variant(x["value"])).alias("kind"), F.to_json(x["value"]).alias("value"))
    found = F.array_sort(F.filter(F.transform(F.map_entries("fields"), cell), lambda c: c["kind"].isNotNull()))
    return lines.select("file_id", "line_no", F.transform(found, lambda c: F.struct(c["name"], c["source"], c["kind"], c["value"])).alias("cells"))


def _text(cell: Column) -> Column:
    return F.when(cell["kind"] == "string", F.get_json_object(F.concat(F.lit('{"x":'), cell["value"], F.lit("}")), "$.x")).otherwise(cell["value"])


#: Texts that stand for true and false.
TRUE, FALSE = ("true", "yes", "y", "1"), ("false", "no", "n", "0")


def typed(cell: Column, kind: str, name: str = "") -> Column:
    """The value of a cell as ``kind``: string, int, boolean or array<double>; null if it can't be read so.

    An object with an ``id`` stands for it where a string is asked for. Numbers may come as texts. A list of numbers may
    be one of texts, a text such as ``1 x 1 x 3``, a single number, or an object of x, y and z, which come in the order
    that ``name`` ends in (xyz unless it ends in zyx).
    """
    text = F.trim(_text(cell))
    if kind == "string":
        return F.when(cell["kind"] == "object", F.get_json_object(cell["value"], "$.id")).otherwise(text)
    if kind == "int":
        return text.try_cast("int")
    if kind == "boolean":
        return F.when(F.lower(text).isin(*TRUE), True).when(F.lower(text).isin(*FALSE), False)
    order = "zyx" if name.endswith("zyx") else "xyz"
    at = F.array(*(F.get_json_object(cell["value"], f"$.{axis}").try_cast("double") for axis in order))
    plain_list = F.regexp_extract_all(text, F.lit(r"([-+]?[0-9]+(?:[.][0-9]+)?(?:[eE][-+]?[0-9]+)?)"), 1).cast("array<double>")
    # only separators beside the numbers
    clean = text.rlike(r"^[\[\]\s\",;xX*+\-0-9.eE]*$") & (F.size(plain_list) > 0)
    return F.when(cell["kind"] == "object", F.when(~F.exists(at, lambda x: x.isNull()), at)).when(clean, plain_list)


def wide(found: DataFrame, fields: dict[str, str]) -> DataFrame:
    """One row per line with a typed column for each of ``fields`` (name: kind), and ``other_fields``, a map of all its other values as text.

    Of several source fields of one name that with the field's own name is taken first, then the first by name; the
    others stay in ``other_fields`` under their source name, as do values that can't be read as the kind of their
    column. So every value of the line is in exactly one place. JSON null values are in none.
    """

    def placed(x: Column, i: Column) -> Column:
        first = ~F.get("cells", i - 1)["name"].eqNullSafe(x["name"])
        # a name that another field of the line was given stays its own: no two fields of a line share a key
        free = ~F.exists("cells", lambda y: (y["source"] == x["name"]) & (y["source"] != x["source"]))
        return F.struct(F.when(first & free, x["name"]).otherwise(x["source"]).alias("key"), x.alias("cell"))

    lines = found.select("file_id", "line_no", F.map_from_entries(F.transform("cells", placed)).alias("m"))
    at = lambda f: F.try_element_at("m", F.lit(f))
    lines = lines.select("file_id", "line_no", "m", *(typed(at(f), k, f).alias(f"_v_{i}") for i, (f, k) in enumerate(fields.items())))
    read = F.array_compact(F.array(*(F.when(F.col(f"_v_{i}").isNotNull(), F.lit(f)) for i, f in enumerate(fields)))).cast("array<string>")
    lines = lines.withColumn("_read", read)
    rest = F.map_filter("m", lambda k, v: ~F.array_contains("_read", k))
    return lines.select("file_id", "line_no", *(F.col(f"_v_{i}").alias(f) for i, f in enumerate(fields)), F.transform_values(rest, lambda k, v: _text(v)).alias("other_fields"))
