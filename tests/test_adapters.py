import pytest

from slicewright.operators import adapters as A


def items(spark, name, paths, **kw):
    df = spark.createDataFrame([(p,) for p in [*paths, "readme.txt"]], "path string")
    return {(r.case_id, r.split): r for r in A.organize(df, A.layout_of(name), name, 7, **kw).collect()}


def test_splits_from_folders(spark):
    got = items(spark, "tn3k", ["trainval-image/1.jpg", "trainval-mask/1.png", "test-image/1.jpg", "test-mask/1.png", "test-image/2.jpg"])
    assert set(got) == {("1", "train"), ("1", "test")}
    got = items(spark, "CVC-ClinicDB", ["train/image/1.png", "train/masks/1.png", "test/images/2.png", "test/masks/2.png"])
    assert set(got) == {("1", "train"), ("2", "test")}
    got = items(spark, "monuseg", ["train/Tissue Images/a.tif", "train/Annotations/a.xml", "test/b.tif", "test/b.xml", "test/c.tif"])
    assert set(got) == {("a", "train"), ("b", "test")}


def test_optional_files(spark):
    got = items(spark, "acdc", ["training/patient001/patient001_frame01.nii.gz", "training/patient001/patient001_frame01_gt.nii.gz", "training/patient001/patient001_4d.nii.gz", "testing/patient101/patient101_frame01.nii.gz", "testing/patient101/patient101_frame01_gt.nii.gz"])
    assert set(got) == {("patient001_frame01", "train"), ("patient101_frame01", "test")}
    assert got["patient001_frame01", "train"].aux_src == {"cine_4d": ["training/patient001/patient001_4d.nii.gz"]} and got["patient101_frame01", "test"].aux_src == {}
    assert got["patient001_frame01", "train"].patient_id == "patient001"
    got = items(spark, "prostate158", ["train/train/020/t2.nii.gz", "train/train/020/t2_anatomy_reader1.nii.gz", "train/train/020/adc.nii.gz", "train/train/021/t2.nii.gz", "test/prostate158_test/test/001/t2.nii.gz", "test/prostate158_test/test/001/t2_anatomy_reader1.nii.gz"])
    assert set(got) == {("020", "train"), ("001", "test")} and set(got["020", "train"].aux_src) == {"adc"}


def test_prefix_with_uniqueness(spark):
    got = items(spark, "drive", ["training/images/21_training.tif", "training/1st_manual/21_manual1.gif", "training/mask/21_training_mask.gif", "test/images/01_test.tif", "test/images/01_other.tif", "test/1st_manual/01_manual1.gif"])
    assert set(got) == {("21_training", "train")} and "fov_mask" in got["21_training", "train"].aux_src


def test_patients_stay_together(spark):
    paths = [f"Image_{i:02d}{s}{x}" for i in range(1, 15) for s in "LR" for x in (".jpg", "_1stHO.png")] + ["Image_01L_2ndHO.png"]
    got = items(spark, "chasedb1", paths)
    assert {c for c, s in got if s == "train"} == {f"Image_{i:02d}{s}" for i in range(1, 11) for s in "LR"} and len(got) == 28
    assert got["Image_01L", "train"].aux_src == {"reader2_label": ["Image_01L_2ndHO.png"]}


def test_lists_and_rewritten_keys(spark):
    lists = spark.createDataFrame([("1", "train"), ("2", "val"), ("2", "train"), ("4", "val")], "key string, split string")
    paths = [f"{d}/{i}.jpg" for d in ("thyroid-image", "thyroid-mask") for i in (1, 2, 3, 4)]
    assert set(items(spark, "tg3k", paths, lists=lists)) == {("1", "train"), ("2", "train"), ("4", "test")}
    otu = ["images/1.JPG", "annotations/1_binary.PNG", "annotations/1.PNG", "annotations/2_binary_binary.PNG", "images/2.JPG", "images/2_binary.JPG"]
    assert set(items(spark, "mmotu", otu, lists=lists)) == {("1", "train")}
    btcv = [f"{d}/{n}{i:04d}.nii.gz" for d, n in (("images", "img"), ("labels", "label")) for i in range(30)]
    got = items(spark, "btcv", btcv)
    assert len(got) == 30 and sum(s == "train" for _, s in got) == 24
    with pytest.raises(ValueError):
        items(spark, "tg3k", paths)


def test_counted_splits(spark):
    kvasir = [f"{d}/k{i}.jpg" for d in ("images", "masks") for i in range(1000)]
    assert sum(s == "train" for _, s in items(spark, "kvasir", kvasir)) == 900
    hrf = [f"{d}/{i:02d}_{g}.jpg" for d in ("images", "manual1") for i in range(15) for g in ("h", "dr", "g")] + ["mask/01_h_mask.tif"]
    got = items(spark, "hrf", hrf)
    assert [sum(c.endswith("_" + g) and s == "train" for c, s in got) for g in ("h", "dr", "g")] == [10, 10, 10] and len(got) == 45
    labels = spark.createDataFrame([(str(i), "ab"[i % 2]) for i in range(20)], "key string, label string")
    got = items(spark, "ddti", [f"{d}/{i}.png" for d in ("image", "mask") for i in range(25)], labels=labels)
    assert len(got) == 20 and sum(s == "train" for _, s in got) == 16
    ph2 = [f"PH2 Dataset images/IMD{i}/IMD{i}_{d}/{x}.bmp" for i in range(200) for d, x in (("Dermoscopic_Image", "a"), ("lesion", "b"), ("roi", "c"))]
    assert sum(s == "train" for _, s in items(spark, "ph2", ph2)) == 160
    some = spark.createDataFrame([(f"IMD{i}", "nevus") for i in range(150)], "key string, label string")
    assert sum(s == "train" for _, s in items(spark, "ph2", ph2, labels=some)) == 120


def test_series(spark):
    got = items(spark, "synapse", ["train_npz/case0005_slice010.npz", "train_npz/case0005_slice002.npz", "test_vol_h5/case0001.npy.h5"])
    assert set(got) == {("case0005", "train"), ("case0001", "test")}
    assert got["case0005", "train"].aux_src == {"slices": ["train_npz/case0005_slice002.npz", "train_npz/case0005_slice010.npz"]}
    assert got["case0001", "test"].image_src.endswith(".h5")


def test_unknown_and_empty(spark):
    with pytest.raises(ValueError):
        A.layout_of("nothing")
    for name in A.LAYOUTS:
        lists = spark.createDataFrame([], "key string, split string")
        assert items(spark, name, [], lists=lists) == {}


def test_sanity(spark):
    df = spark.createDataFrame([("a", "train", "1"), ("a", "train", "2"), ("a", "test", "3")], "case_id string, split string, image_src string")
    assert sorted((r.image_src, r.duplicate_case_within_split) for r in A.sanity(df).collect()) == [("1", False), ("2", True), ("3", False)]
