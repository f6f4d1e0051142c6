"""Readers of manifests, keyed documents, lists and logs."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from slicewright.sources import schemas


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON list of sample rows, or with ``lines`` one row a line, which can be split among tasks. A row without a usable name is kept, with null; see ``duplicate_keys`` for the check of uniqueness."""
    return spark.read.schema(schemas.MANIFEST).option("multiLine", not lines).json(path)


#: Data sets that are volumes with several classes, whatever their metadata say.
VOLUME_DATASETS = ("acdc", "btcv", "prostate158", "synapse")


def read_split_meta(spark: SparkSession, folds: DataFrame) -> DataFrame:
    """``folds`` (dataset_name, root) with teacher_target_size, is_multiclass, is_3d and split_protocol from ``meta/split_meta.json`` below each root.

    Where the document is missing, is no object or lacks a field: size 1024, several classes or volumes by the name of the
    data set, and no protocol. The documents are read together; a root that isn't there is one without a document.
    """
    docs = spark.createDataFrame([], "root string, m map<string,variant>")
    named = [r[0] for r in folds.select("root").distinct().collect()]  # folds are few: they are folders
    there = [p for p in (f"{r}/meta/split_meta.json" for r in named) if first_existing(spark, [p])]
    if there:
        raw = spark.read.text(there, wholetext=True).select(F.regexp_extract(F.input_file_name(), "^(.*)/meta/split_meta[.]json$", 1).alias("root"), "value")
        docs = raw.select(_plain_path("root").alias("root"), F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>").alias("m"))
    got = folds.select("*", _plain_path("root").alias("_root")).join(docs.withColumnRenamed("root", "_root"), "_root", "left")
    field = lambda n, kind: F.try_variant_get(F.try_element_at("m", F.lit(n)), "$", kind)
    known = F.lower(F.trim("dataset_name")).isin(*VOLUME_DATASETS)
    flags = F.coalesce(*(F.when(F.coalesce(field(n, "boolean"), F.lit(False)), True) for n in ("is_3d", "volume_level_split", "has_volume")), F.lit(False))
    return got.select(
        *folds.columns, F.coalesce(field("teacher_target_size", "int"), F.lit(1024)).alias("teacher_target_size"), F.coalesce(field("multi_class_preserved", "boolean"), known, F.lit(False)).alias("is_multiclass"),
        (F.coalesce(known, F.lit(False)) | flags).alias("is_3d"), field("split_protocol", "string").alias("split_protocol"),
    )


def _plain_path(c: Column | str) -> Column:
    """A path without its scheme, so that the ways to write one agree."""
    return F.regexp_replace(c, "^[a-z0-9]+:/*(?=/)", "")


def read_case_index(spark: SparkSession, root: str, splits: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """split, case_id, patient_id, case_dir of the index documents of a data set; a split without an index has no cases."""
    schema = "case_id string, patient_id string, case_dir string"
    out = spark.createDataFrame([], f"split string, {schema}")
    for split in splits:
        path = first_existing(spark, [f"{root}/{split}/index.json"])
        if path:
            out = out.unionByName(spark.read.schema(schema).option("multiLine", True).json(path).select(F.lit(split).alias("split"), "*"))
    return out.where("case_id is not null")


def read_case_meta(spark: SparkSession, root: str, index: DataFrame) -> DataFrame:
    """``index`` with ``meta``, the metadata document of each case as a map of texts; null where it is missing."""
    docs = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "case_meta.json").text(root, wholetext=True)
    base = _plain_path(F.lit(root.rstrip("/")))
    place = F.regexp_replace(_plain_path(F.col("_metadata.file_path")), "/case_meta[.]json$", "")
    meta = docs.select(place.alias("_p"), base.alias("_b"), F.from_json("value", "map<string,string>").alias("meta"))
    meta = meta.select(F.substring("_p", F.length("_b") + 2, F.length("_p")).alias("case_dir"), "meta")
    return index.join(meta, "case_dir", "left").select(*index.columns, "meta")


def read_keyed(spark: SparkSession, path: str, value: T.StructType, key: str = "slice_name") -> DataFrame:
    """A JSON object of records by key, one row a record. A document that is no such object gives no row."""
    docs = spark.read.text(path, wholetext=True)
    typed = f"map<string,{value.simpleString()}>"
    return docs.select(F.explode(F.from_json("value", typed)).alias(key, "r")).select(key, "r.*")


def read_geometry(spark: SparkSession, path: str) -> DataFrame:
    return read_keyed(spark, path, schemas.GEOMETRY)


def geometry_for(names: DataFrame, geometry: DataFrame) -> DataFrame:
    """names (slice_name) with their geometry: by the name, else by the name without its suffix."""
    stem = F.regexp_replace("slice_name", r"[.][^.]+$", "")
    by_name = names.join(geometry, "slice_name", "left_semi").select("slice_name", F.col("slice_name").alias("_key"))
    rest = names.join(geometry, "slice_name", "left_anti").select("slice_name", stem.alias("_key"))
    return by_name.unionByName(rest).join(geometry.withColumnRenamed("slice_name", "_key"), "_key").drop("_key")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of prompt records, with the older layouts folded into ``instances``."""
    raw = read_keyed(spark, path, schemas.PROMPT)
    empty = T.ArrayType(schemas.INSTANCE)
    names = schemas.INSTANCE.fieldNames()

    def boxed(b: Column) -> Column:
        return F.struct(*(b.alias(n) if n == "bbox" else F.lit(None).cast(schemas.INSTANCE[n].dataType).alias(n) for n in names))

    old = F.when(F.col("bboxes").isNotNull(), F.transform("bboxes", boxed)).when(F.col("bbox").isNotNull(), F.array(boxed(F.col("bbox"))))
    none = F.array().cast(empty)
    return raw.withColumn("instances", F.when(F.coalesce("empty_slice", F.lit(False)), none).otherwise(F.coalesce("instances", old, none))).drop("bboxes", "bbox")


def check_points(prompts: DataFrame) -> DataFrame:
    """slice_name, k of instances whose point lists differ in length: must be empty before point prompts are used."""
    i = prompts.select("slice_name", F.posexplode("instances").alias("k", "i"))
    n = lambda c: F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0))
    return i.where(n(F.col("i.point_coords")) != n(F.col("i.point_labels"))).select("slice_name", "k")


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of the paths that is there."""
    for p in paths:
        hp = spark._jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hp):
            return p
    return None


def find_prompts(spark: SparkSession, root: str, name: str, root_first: bool = False) -> str | None:
    """The prompt file of a fold: in its prompts folder, then at its root, or the other way round."""
    places = [f"{root}/prompts/{name}", f"{root}/{name}"]
    return first_existing(spark, places[::-1] if root_first else places)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header; every column is text."""
    return spark.read.option("header", True).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV, or a spreadsheet where pandas can read one; other suffixes are an error."""
    low = path.lower()
    if low.endswith(".csv"):
        return read_csv(spark, path)
    if low.endswith((".xls", ".xlsx")):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path, dtype=str))
    raise ValueError(f"no table format: {path}")


def discover_columns(df: DataFrame, ident: str = "name", label_words: tuple[str, ...] = (), probe: int = 50) -> tuple[str, str | None]:
    """(id column, label column): by the word in a column's name, else the first; the label by name, else the first whose leading values hold a word."""
    cols = df.columns
    chosen = next((c for c in cols if ident in c.lower()), cols[0])
    label = next((c for c in cols if c != chosen and any(w in c.lower() for w in label_words)), None)
    if label is None and label_words:
        rows = df.limit(probe).collect()  # a look at the head, not the data
        label = next((c for c in cols if c != chosen and any(w in str(r[c]).lower() for r in rows for w in label_words)), None)
    return chosen, label


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stems of the lines that aren't blank."""
    t = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> ''")
    return t.select(F.regexp_replace(F.regexp_extract("v", r"([^/\\]*)$", 1), r"(?<=.)[.](nii[.]gz|npy[.]h5|[^.]+)$", "").alias("stem"))


def read_split_lists(spark: SparkSession, path: str) -> DataFrame:
    """stem, split of the train and validation lists found at any depth of JSON documents; distinct."""
    docs = spark.read.text(path, wholetext=True)

    @F.udtf(returnType="name: string, split: string")
    class Lists:
        def eval(self, text: str) -> Iterator[tuple[str, str]]:
            def walk(x) -> Iterator[tuple[str, str]]:
                if isinstance(x, dict):
                    for k, v in x.items():
                        low = str(k).lower()
                        split = "train" if "train" in low else "val" if "val" in low or "test" in low else None
                        if split and isinstance(v, list) and all(isinstance(i, (str, int)) for i in v):
                            for i in v:
                                yield str(i), split
                        else:
                            yield from walk(v)
                elif isinstance(x, list):
                    for v in x:
                        yield from walk(v)

            try:
                doc = json.loads(text)
            except ValueError:
                return
            yield from walk(doc)

    return docs.lateralJoin(Lists(F.col("value").outer())).select("name", "split").distinct()


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SELECTION).option("multiLine", True).json(path)


def read_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, those that lack a required key)."""
    p = spark.read.schema(schemas.PAIR).option("multiLine", True).json(path)
    lacks = F.col("pair_id").isNull() | F.col("teacher_img").isNull() | F.col("target_mask").isNull() | F.col("bbox_teacher").isNull()
    return p.where(~lacks), p.where(lacks)


def read_progress(spark: SparkSession, pattern: str) -> DataFrame:
    """Progress records of a glob, ordered; files that can't be read as one are skipped."""
    got = spark.read.schema(schemas.PROGRESS).option("multiLine", True).option("mode", "DROPMALFORMED").json(pattern)
    return got.where("stage is not null").orderBy("dataset", "stage", "fold", "split")


def read_polygons(spark: SparkSession, path: str, row_tag: str = "Region") -> DataFrame:
    """path, region, points (arrays of x, y) of annotation XML; regions of fewer than three points are left out."""
    point = T.StructType([T.StructField("_X", T.DoubleType()), T.StructField("_Y", T.DoubleType())])
    shape = T.StructType([T.StructField("_Id", T.StringType()), T.StructField("Vertices", T.StructType([T.StructField("Vertex", T.ArrayType(point))]))])
    r = spark.read.schema(shape).option("rowTag", row_tag).xml(path)
    pts = F.transform("Vertices.Vertex", lambda p: F.array(p["_X"], p["_Y"]))
    return r.select(F.input_file_name().alias("path"), F.col("_Id").alias("region"), pts.alias("points")).where(F.size("points") >= 3)
