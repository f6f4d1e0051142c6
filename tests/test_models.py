"""The scorer's place, and volume readers with or without their libraries."""

import importlib.util

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicewright.operators import resolve
from slicewright.operators.scorer import score_prompts
from slicewright.sources import volumes


def make_factory():
    """A factory that goes to the workers by value."""

    class Boxes:
        """Answers a box with itself, and with itself shrunk by one."""

        embedded = 0

        def embed(self, image):
            Boxes.embedded += 1
            return np.asarray(image).reshape(8, 8)

        def predict(self, embedding, box):
            out = []
            for k, shrink in enumerate((0, 1)):
                m = np.full((8, 8), -1.0)
                x1, y1, x2, y2 = (int(v) for v in box)
                m[y1 + shrink : y2 + 1 - shrink, x1 + shrink : x2 + 1 - shrink] = 1.0
                out.append((m, 0.5 + 0.001 * k + Boxes.embedded))
            return out

    return lambda: Boxes()


def test_scored_prompts_give_proposals(spark):
    rows = [("a", 0, [0] * 64, [1.0, 1.0, 5.0, 6.0]), ("a", 1, [0] * 64, [2.0, 2.0, 4.0, 4.0]), ("a", 2, [0] * 64, None), ("b", 0, [0] * 64, [0.0, 0.0, 7.0, 7.0])]
    df = spark.createDataFrame(rows, "slice string, inst int, img array<int>, box array<double>")
    got = score_prompts(df, make_factory(), "slice", "inst", "img", "box")
    out = got.collect()
    assert len(out) == 6 and {(r.h, r.w) for r in out} == {(8, 8)}
    a = [r.model_score for r in out if r.slice == "a"]
    assert max(a) - min(a) < 0.01  # embedded once for both prompts
    scored = resolve.score_candidates(got.join(df.select("slice", "inst", "box"), ["slice", "inst"]), 8, 8, F.lit(True))
    best = {(r.slice, r.inst): (r.candidate_index, r.area) for r in resolve.best_candidates(scored, ["slice", "inst"]).collect()}
    assert best[("a", 0)] == (0, 30) and best[("a", 1)] == (0, 9)


def test_no_prompts(spark):
    df = spark.createDataFrame([], "slice string, inst int, img array<int>, box array<double>")
    assert score_prompts(df, make_factory(), "slice", "inst", "img", "box").count() == 0


@pytest.mark.parametrize(("kind", "module", "name"), [("hdf5", "h5py", "a.h5"), ("nifti", "nibabel", "a.nii.gz"), ("dicom", "pydicom", "a.dcm")])
def test_files_without_a_decoder_are_told(spark, tmp_path, kind, module, name):
    (tmp_path / name).write_bytes(b"nothing")
    r = volumes.read_volumes(spark, f"file://{tmp_path}", kind).first()
    assert r.error and r.image is None
    if not importlib.util.find_spec(module):
        assert "ModuleNotFoundError" in r.error


def test_series_and_pairs(spark):
    s = spark.createDataFrame([("1", "u", [2, 2]), ("2", "u", [2, 2]), ("3", "v", [2, 2]), ("4", "v", [3, 2]), ("5", None, None)], "path string, series string, shape array<int>")
    assert {(r.series, r.n_slices, r.one_shape) for r in volumes.series_summary(s).collect()} == {("u", 2, True), ("v", 2, False)}
    v = spark.createDataFrame([("k", [1, 2], [1.0, 2.0], [0]), ("l", [1, 1], [3.0], [0])], "k string, shape array<int>, image array<float>, label array<int>")
    lab = spark.createDataFrame([("k", [1, 2], [0.0, 1.0]), ("l", [2, 1], [0.0, 1.0])], "k string, shape array<int>, image array<float>")
    assert [(r.k, r.label) for r in volumes.volume_pairs(v, lab, "k").collect()] == [("k", [0.0, 1.0])]


def test_a_failed_row_stops_nothing(spark):
    from slicewright.operators.driver import run_fold

    df = spark.createDataFrame([(i, None if i == 3 else 6 // max(i, 1) if i else 0) for i in range(5)], "i int, v int")

    def work(row):
        if row["i"] == 4:
            raise KeyError("no image")
        return {"w": int(row["v"]) + 1}

    good, bad, counts = run_fold(df, ["i"], work, "w int, note string")
    assert {(r.i, r.w, r.note) for r in good.collect()} == {(0, 1, None), (1, 7, None), (2, 4, None)}
    assert {r.i for r in bad.collect()} == {3, 4} and any("KeyError" in r.reason for r in bad.collect())
    assert tuple(counts.first()) == (5, 3, 2)
    assert tuple(run_fold(df.limit(0), ["i"], work, "w int")[2].first()) == (0, 0, 0)
