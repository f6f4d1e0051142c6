"""Raw data sets to case items: one operator, and a layout for each data set.

A layout names its roles by patterns on the path below the data set's folder; what a pattern captures is the
key on which image, label and auxiliary files meet, and, where folders tell it, the split. ``organize`` joins
the roles (label inner, auxiliary left), checks uniqueness where a layout asks for it, and applies the split
rule. Of several files of a role with one key the last path stays, or the first where ``first`` is set.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewright.operators import catalog


@dataclass(frozen=True)
class Role:
    """``pattern`` with the numbers of the groups that hold key, split and (for series) the order; 0: none."""

    pattern: str
    key: int = 1
    split: int = 0
    order: int = 0


@dataclass(frozen=True)
class Layout:
    """``rule``: path, lists, fixed:N, stratified:R, group:K, or patients:N (the first N of zero-padded numbers).

    ``case`` and ``patient``: patterns on the image path whose first group names them (default: the key).
    ``replace``: what is replaced in label keys. ``unique``: images whose key another image shares are left out.
    """

    image: Role
    label: Role | None
    rule: str
    aux: dict[str, Role] = field(default_factory=dict)
    modality: str = ""
    task_dim: str = "2D"
    class_info: str = "binary"
    case: str | None = None
    patient: str | None = None
    replace: tuple[str, str] | None = None
    unique: bool = False
    first: bool = False
    series: bool = False


#: What the names of split folders mean.
SPLITS = {"train": "train", "trainval": "train", "training": "train", "val": "test", "test": "test", "testing": "test"}
_FILE = r"([^/]+?)[.](?:nii[.]gz|npy[.]h5|[^./]+)$"
#: The layouts of the public data sets.
LAYOUTS = {
    "tn3k": Layout(Role(rf"^(trainval|test)-image/{_FILE}", 2, 1), Role(rf"^(trainval|test)-mask/{_FILE}", 2, 1), "path", modality="Ultrasound"),
    "cvc_clinicdb": Layout(Role(rf"^(train|test)/images?/{_FILE}", 2, 1), Role(rf"^(train|test)/masks/{_FILE}", 2, 1), "path", modality="Endoscopy"),
    "tg3k": Layout(Role(rf"^thyroid-image/{_FILE}"), Role(rf"^thyroid-mask/{_FILE}"), "lists", modality="Ultrasound"),
    "kvasirseg": Layout(Role(rf"^(?:images?|imgs?|Original|Images)/{_FILE}"), Role(rf"^(?:masks?|annotations|gts|GT|Ground Truth)/{_FILE}"), "fixed:900", modality="Endoscopy"),
    "synapse": Layout(Role(r"^(train)_npz/(case[0-9]+)_slice([0-9]+)[.]npz$|^(test)_vol_h5/([^/]+?)(?:[.]npy)?[.]h5$", 2, 1, 3), None, "path", modality="CT", task_dim="3D", class_info="multiclass", series=True),
    "acdc": Layout(
        Role(r"^(training|testing)/patient[^/]*/([^/]+(?<!_gt)(?<!_4d))[.]nii[.]gz$", 2, 1), Role(r"^(training|testing)/patient[^/]*/([^/]+)_gt[.]nii[.]gz$", 2, 1), "path",
        {"cine_4d": Role(r"^(training|testing)/(patient[^/]*)/[^/]+_4d[.]nii[.]gz$", 2, 1)}, "Cine MRI", "3D", "multiclass", patient=r"/(patient[^/]*)/",
    ),
    "btcv": Layout(Role(rf"^images/{_FILE}"), Role(rf"^labels/{_FILE}"), "fixed:24", modality="CT", task_dim="3D", class_info="multiclass", replace=("label", "img")),
    "chasedb1": Layout(Role(r"^(Image_[0-9]+[LRlr])[.][^./]+$"), Role(r"^(Image_[0-9]+[LRlr])_1stHO[.][^./]+$"), "patients:10", {"reader2_label": Role(r"^(Image_[0-9]+[LRlr])_2ndHO[.][^./]+$")}, "Color Fundus", patient=r"Image_([0-9]+)"),
    "ddti": Layout(Role(rf"^image/{_FILE}"), Role(rf"^mask/{_FILE}"), "stratified:0.8", modality="Ultrasound"),
    "drive": Layout(
        Role(r"^(training|test)/images/([0-9]+)_[^/]+$", 2, 1), Role(r"^(training|test)/1st_manual/([0-9]+)_manual1[^/]*$", 2, 1), "path",
        {"fov_mask": Role(r"^(training|test)/mask/([0-9]+)[^/]*$", 2, 1)}, "Color Fundus", case=rf"{_FILE}", unique=True,
    ),
    "hrf": Layout(Role(rf"^images/{_FILE}"), Role(rf"^manual1/{_FILE}"), "group:10", {"fov_mask": Role(r"^mask/([^/]+?)_mask[.][^./]+$")}, "Color Fundus"),
    "monuseg": Layout(Role(r"^(train|test)/(?:Tissue Images/)?([^/]+)[.](?:png|jpe?g|bmp|tiff?)$", 2, 1), Role(r"^(train|test)/(?:Annotations/)?([^/]+)[.]xml$", 2, 1), "path", modality="Histopathology"),
    "otu_2d": Layout(Role(rf"^images/{_FILE}"), Role(r"^annotations/([^/]*(?<!_binary))_binary[.][^./]+$"), "lists", modality="Ultrasound"),
    "ph2": Layout(
        Role(r"^PH2[ _]Dataset[ _]images/([^/]+)/\1_Dermoscopic_Image/[^/]+$"), Role(r"^PH2[ _]Dataset[ _]images/([^/]+)/\1_lesion/[^/]+$"), "stratified:0.8:150:160",
        {"roi": Role(r"^PH2[ _]Dataset[ _]images/([^/]+)/\1_roi/[^/]+$")}, "Dermoscopy", first=True,
    ),
    "prostate158": Layout(
        Role(r"^(train|test)/(?:train|prostate158_test/test)/([^/]+)/t2[.]nii[.]gz$", 2, 1), Role(r"^(train|test)/(?:train|prostate158_test/test)/([^/]+)/t2_anatomy_reader1[.]nii[.]gz$", 2, 1), "path",
        {n: Role(rf"^(train|test)/(?:train|prostate158_test/test)/([^/]+)/{n}[.]nii[.]gz$", 2, 1) for n in ("adc", "dwi", "t2_anatomy_reader2", "t2_tumor_reader1", "adc_tumor_reader1", "adc_tumor_reader2", "empty")},
        "MRI", "3D", "multiclass",
    ),
}
#: Other names of the data sets.
ALIASES = {"kvasir": "kvasirseg", "kvasir_seg": "kvasirseg", "cvc_clinic_db": "cvc_clinicdb", "chase_db1": "chasedb1", "mmotu": "otu_2d"}


def layout_of(name: str) -> Layout:
    """The layout of a data set by any of its names; an unknown one is an error."""
    key = name.strip().lower().replace("-", "_").replace(" ", "_")
    key = ALIASES.get(key, key)
    if key not in LAYOUTS:
        raise ValueError(f"unknown data set {name!r}; known: {', '.join(sorted(LAYOUTS))}")
    return LAYOUTS[key]


def _group(p: str, n: int) -> Column:
    return F.nullif(F.regexp_extract("path", p, n), F.lit(""))


def _role(files: DataFrame, r: Role, name: str, first: bool, replace: tuple[str, str] | None = None) -> DataFrame:
    """split, key and one path of the files of a role."""
    key = _group(r.pattern, r.key)
    if replace:
        key = F.replace(key, F.lit(replace[0]), F.lit(replace[1]))
    split = _group(r.pattern, r.split) if r.split else F.lit("")
    hit = files.where(F.col("path").rlike(r.pattern)).select(split.alias("fsplit"), key.alias("key"), "path").where("key is not null")
    return hit.groupBy("fsplit", "key").agg((F.min if first else F.max)("path").alias(name))


def _series(files: DataFrame, layout: Layout) -> DataFrame:
    """Cases of slice files and of whole volumes: split, key, the files in order."""
    p = layout.image.pattern
    hit = files.where(F.col("path").rlike(p)).select(
        F.coalesce(_group(p, 1), _group(p, 4)).alias("fsplit"), F.coalesce(_group(p, 2), _group(p, 5)).alias("key"), F.coalesce(_group(p, 3).cast("int"), F.lit(-1)).alias("z"), "path"
    )
    # a case has as many files as a volume has slices
    return hit.groupBy("fsplit", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("z", "path"))), lambda x: x["path"]).alias("slices"), F.min("z").alias("z"))


def organize(files: DataFrame, layout: Layout, name: str, seed: int, lists: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Case items: dataset_name, case_id, patient_id, split, modality, task_dim, class_info, image_src, label_src, aux_src, pathology_label.

    ``files``: path below the data set's folder; ``lists``: key, split (train or val) for the rule ``lists``;
    ``labels``: key, label for strata. Without a label file an image is no case; in no list neither.
    """
    constant = [F.lit(name).alias("dataset_name"), F.lit(layout.modality).alias("modality"), F.lit(layout.task_dim).alias("task_dim"), F.lit(layout.class_info).alias("class_info")]
    known = F.create_map(*(F.lit(x) for kv in SPLITS.items() for x in kv))
    if layout.series:
        s = _series(files, layout)
        single = F.col("z") < 0
        aux = F.when(~single, F.create_map(F.lit("slices"), F.col("slices")))
        return s.select(*constant, F.col("key").alias("case_id"), F.col("key").alias("patient_id"), known[F.col("fsplit")].alias("split"), F.when(single, F.col("slices")[0]).alias("image_src"), F.lit(None).cast("string").alias("label_src"), aux.alias("aux_src"), F.lit(None).cast("string").alias("pathology_label"))
    images = _role(files, layout.image, "image_src", layout.first)
    if layout.unique:
        p = layout.image.pattern
        n = files.where(F.col("path").rlike(p)).groupBy(_group(p, layout.image.split).alias("fsplit"), _group(p, layout.image.key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        images = images.join(n.where("n = 1").select("fsplit", "key"), ["fsplit", "key"], "left_semi")
    items = images.join(_role(files, layout.label, "label_src", layout.first, layout.replace), ["fsplit", "key"])
    take = lambda p: F.regexp_extract("image_src", p, 1) if p else F.col("key")
    items = items.withColumn("case_id", take(layout.case)).withColumn("patient_id", take(layout.patient) if layout.patient else F.col("case_id"))
    maps = []
    for aux, role in layout.aux.items():
        by = "patient_id" if aux == "cine_4d" else "key"
        one = _role(files, role, f"_{aux}", layout.first).withColumnRenamed("key", by)
        items = items.join(one, ["fsplit", by], "left")
        maps.append(F.struct(F.lit(aux).alias("k"), F.array(F.col(f"_{aux}")).alias("v")))
    pairs = F.filter(F.array(*maps), lambda x: x["v"][0].isNotNull()) if maps else F.array().cast("array<struct<k:string,v:array<string>>>")
    items = items.withColumn("aux_src", F.map_from_entries(pairs))
    if labels is not None:
        how = "inner" if layout.rule.startswith("stratified") and layout.rule.count(":") == 1 else "left"
        items = items.join(labels.select("key", F.col("label").alias("pathology_label")), "key", how)
    elif layout.rule.startswith("group"):
        from slicewright.functions.text import class_from_suffix

        items = items.withColumn("pathology_label", class_from_suffix(F.col("case_id")))
    else:
        items = items.withColumn("pathology_label", F.lit(None).cast("string"))
    items = _split(items, layout, seed, lists, known)
    return items.select(*constant, "case_id", "patient_id", "split", "image_src", "label_src", "aux_src", "pathology_label")


def _split(items: DataFrame, layout: Layout, seed: int, lists: DataFrame | None, known: Column) -> DataFrame:
    rule, *args = layout.rule.split(":")
    if rule == "path":
        return items.withColumn("split", known[F.col("fsplit")])
    if rule == "lists":
        if lists is None:
            raise ValueError("this layout needs split lists")
        member = catalog.split_membership(items, "key", lists, ["train", "val", "test"])
        return member.withColumn("split", known[F.col("split")])
    if rule == "patients":
        number = F.regexp_replace("patient_id", "^0+", "").cast("int")
        return items.withColumn("split", F.when(number <= int(args[0]), "train").otherwise("test"))
    if rule == "group":
        first = catalog.take_per_group(items.where("pathology_label is not null"), "case_id", "pathology_label", int(args[0]), seed)
        train = first.select("case_id").withColumn("split", F.lit("train"))
    elif rule == "stratified" and (len(args) == 1 or items.where("pathology_label is not null").count() >= int(args[1])):
        train = catalog.split_stratified(items.where("pathology_label is not null"), "case_id", "pathology_label", float(args[0]), seed).where("split = 'train'").select("case_id", "split")
    else:
        train = catalog.split_fixed(items, "case_id", int(args[-1]), seed).where("split = 'train'")
    return items.join(train, "case_id", "left").withColumn("split", F.coalesce("split", F.lit("test")))


def sanity(items: DataFrame) -> DataFrame:
    """items with ``duplicate_case_within_split``: the case came before in its split, by image path."""
    order = Window.partitionBy("split", "case_id").orderBy("image_src")
    return items.withColumn("duplicate_case_within_split", F.row_number().over(order) > 1)
