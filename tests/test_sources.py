import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicewright.sources import arrays, documents, sinks
from slicewright.streaming import progress as stream


def dump(path, x):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(x if isinstance(x, str) else json.dumps(x))
    return f"file://{path}"


def test_manifest_geometry_prompts(spark, tmp_path):
    m = dump(tmp_path / "manifest.json", [{"slice_name": "a.npy", "split": "train", "orig_h": 10, "student_aux": {"roi": "r.npy"}}, {"case_id": "c"}])
    assert [(r.slice_name, r.orig_h, r.student_aux) for r in documents.read_manifest(spark, m).collect()] == [("a.npy", 10, {"roi": "r.npy"}), (None, None, None)]
    g = dump(tmp_path / "geometry.json", {"a.npy": {"native_hw": [10, 20], "native_to_teacher": {"orig_h": 10, "scale": 2.0}}, "b": {"native_hw": [1, 2]}})
    geo = documents.read_geometry(spark, g)
    assert {(r.slice_name, r.native_hw[0]) for r in geo.collect()} == {("a.npy", 10), ("b", 1)}
    names = spark.createDataFrame([("a.npy",), ("b.npy",), ("c.npy",)], "slice_name string")
    assert {(r.slice_name, r.native_hw[0]) for r in documents.geometry_for(names, geo).collect()} == {("a.npy", 10), ("b.npy", 1)}
    p = dump(tmp_path / "prompts" / "p.json", {"a": {"instances": [{"label_id": 1, "bbox": [1, 2, 3, 4], "point_coords": [[1, 2]], "point_labels": [1, 0]}]}, "b": {"bboxes": [[0, 0, 1, 1], [2, 2, 3, 3]]}, "c": {"bbox": [1, 1, 2, 2]}, "d": {"empty_slice": True, "bbox": [1, 1, 2, 2]}, "e": {}})
    got = documents.read_prompts(spark, p)
    assert {r.slice_name: len(r.instances) for r in got.collect()} == {"a": 1, "b": 2, "c": 1, "d": 0, "e": 0}
    assert [tuple(r) for r in documents.check_points(got).collect()] == [("a", 0)]
    root = f"file://{tmp_path}"
    assert documents.find_prompts(spark, root, "p.json") == f"{root}/prompts/p.json" and documents.find_prompts(spark, root, "nothing.json") is None
    assert documents.read_geometry(spark, dump(tmp_path / "bad.json", "[1, 2")).count() == 0


def test_lists_and_tables(spark, tmp_path):
    assert [r.stem for r in documents.read_lines(spark, dump(tmp_path / "l.txt", "a/b.nii.gz\n\n  c.png \n")).collect()] == ["b", "c"]
    s = dump(tmp_path / "s.json", {"x": [{"train": ["a", "b", "a"]}, {"fold": {"val_list": ["c"], "n": 1}}]})
    assert {tuple(r) for r in documents.read_split_lists(spark, s).collect()} == {("a", "train"), ("b", "train"), ("c", "val")}
    assert documents.read_split_lists(spark, dump(tmp_path / "t.json", "{oops")).count() == 0
    t = documents.read_table(spark, dump(tmp_path / "t.csv", "Image Name,diag\nIMD1,nevus\nIMD2,melanoma\n"))
    assert dict(t.dtypes) == {"Image Name": "string", "diag": "string"}
    assert documents.discover_columns(t, "name", ("nevus",)) == ("Image Name", "diag")
    with pytest.raises(ValueError):
        documents.read_table(spark, "x.parquet")
    good, bad = documents.read_pairs(spark, dump(tmp_path / "pairs.json", [{"pair_id": "p", "teacher_img": "i", "target_mask": "m", "bbox_teacher": [1, 2, 3, 4]}, {"pair_id": "q"}]))
    assert good.count() == 1 and bad.count() == 1
    x = dump(tmp_path / "a.xml", "<Annotations><Region Id='1'><Vertices><Vertex X='0' Y='0'/><Vertex X='4' Y='0'/><Vertex X='4' Y='4'/><Vertex X='0' Y='4'/></Vertices></Region><Region Id='2'><Vertices><Vertex X='1' Y='1'/></Vertices></Region></Annotations>")
    r = documents.read_polygons(spark, x).collect()
    assert len(r) == 1 and arrays.polygon_mask(r[0].points, 6, 6)[1:4, 1:4].all() and not arrays.polygon_mask(r[0].points, 6, 6)[5].any()


def test_arrays(spark, tmp_path):
    m = np.arange(12).reshape(3, 4)
    np.save(tmp_path / "a.npy", m[None])
    np.save(tmp_path / "z.npy", np.zeros(3))
    (tmp_path / "sub").mkdir()
    np.savez(tmp_path / "sub" / "b.npz", imgs=m.astype(float), gts=m)
    np.savez(tmp_path / "sub" / "c.npz", other=m)
    root = f"file://{tmp_path}"
    got = {r.path[-5:]: r for r in arrays.read_masks(spark, root).collect()}
    assert (got["a.npy"].h, got["a.npy"].w, got["a.npy"].values) == (3, 4, list(range(12)))
    assert got["z.npy"].values is None and "ValueError" in got["z.npy"].error
    b = {r.path[-5:]: r for r in arrays.read_bundles(spark, root).collect()}
    assert b["b.npz"].task == "sub" and b["b.npz"].label == list(range(12)) and b["b.npz"].shape == [3, 4]
    assert b["c.npz"].error
    files = arrays.list_files(spark, root)
    assert {r.stem for r in files.collect()} == {"a", "z", "b", "c"}
    assert arrays.rgb_uint8(np.ones((3, 8, 9)) * 0.5).shape == (8, 9, 3) and arrays.rgb_uint8(np.ones((8, 9)))[0, 0, 0] == 255
    assert {r.path[-5:]: r.error for r in arrays.read_images(spark, root).collect()}["z.npy"]
    assert arrays.with_image(files, files.where("stem = 'a'")).count() == 1 and arrays.stem_map(files).count() == 4


def test_sinks(spark, tmp_path):
    root = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, None, "x")], "a int, b string, c string")
    sinks.write_csv(df, f"{root}/c", ["b", "a", "d"])
    assert documents.read_csv(spark, f"{root}/c").columns == ["b", "a", "d"]
    assert sinks.union_sorted([df, df.withColumn("aa", F.lit(2))]).columns == ["a", "aa", "b", "c"]
    sinks.append_log(df, f"{root}/log")
    sinks.append_log(df, f"{root}/log")
    assert spark.read.parquet(f"{root}/log").count() == 2
    good, bad = sinks.quarantine(df.unionByName(df.withColumn("b", F.lit("ok"))), F.col("b") != "ok", F.lit("no b"))
    assert good.count() == 1 and [r.reason for r in bad.collect()] == ["no b"]
    assert "&lt;x&gt;" in sinks.dashboard(df.withColumn("c", F.lit("<x>")))
    with pytest.raises(RuntimeError), sinks.stage_timer(spark, f"{root}/times", "s"):
        raise RuntimeError("no")
    with sinks.stage_timer(spark, f"{root}/times", "s"):
        time.sleep(0.01)
    assert sorted(r.status for r in spark.read.json(f"{root}/times").collect()) == ["failed", "success"]
    keys = lambda s: spark.createDataFrame([(k, k + ".png") for k in s], "k string, path string")
    got = {(r.k, r.origin) for r in sinks.assemble_supervision(keys("abc").select("k"), keys("a"), keys("bc"), keys("abc"), "k").collect()}
    assert got == {("a", "full"), ("b", "box"), ("c", "box")}
    with pytest.raises(Exception, match="no label for c"):
        sinks.assemble_supervision(keys("abc").select("k"), keys("a"), keys("b"), keys("a"), "k").collect()
    sinks.write_samples(df.selectExpr("'d' AS dataset_name", "'f' AS fold", "'train' AS split", "a"), f"{root}/samples")
    assert spark.read.parquet(f"{root}/samples").where("split = 'train'").count() == 1
    sinks.publish_view(df, "labels_in_use")
    assert spark.table("labels_in_use").count() == 1


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    one, two = events.where("event_id < 500"), events.where("event_id >= 400")  # a hundred are delivered twice
    one.coalesce(1).write.parquet(f"file://{tmp_path}/in/a")
    time.sleep(1.1)
    two.coalesce(1).write.parquet(f"file://{tmp_path}/in/b")
    log = stream.read_log(spark, f"file://{tmp_path}/in/*", events.schema)
    q = stream.append_once(stream.deduplicated(log, "event_id", "ts", "400 days"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").start()
    q.awaitTermination(120)
    out = spark.read.parquet(f"file://{tmp_path}/out")
    assert out.count() == events.count() and out.select("event_id").distinct().count() == events.count()
    counted = stream.windowed_counts(log, "ts", "event_type", "1 day", "400 days").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination(120)
    assert spark.table("counted").agg(F.sum("n")).first()[0] == one.count() + two.count()
    t = stream.throttled(log, "user_id", "ts", 3600.0).writeStream.format("memory").queryName("thin").trigger(availableNow=True).start()
    t.awaitTermination(120)
    from slicewright.operators.progress import throttle

    assert 0 < spark.table("thin").count() <= throttle(events, "user_id", "ts", 3600.0).count() + 5
