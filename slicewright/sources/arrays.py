"""Readers and writers of array files: NumPy arrays and bundles through the binary source, image files where a decoder is there."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewright.session import share_package

#: Keys under which bundles hold their image and label, in order of preference.
IMAGE_KEYS, LABEL_KEYS = ("image", "img", "imgs", "data"), ("label", "gt", "gts", "mask", "seg")


def list_files(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, name, stem, length of the files under a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(root)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)[.](nii[.]gz|npy[.]h5|[^.]+)$", "")
    return files.select("path", name.alias("name"), stem.alias("stem"), "length")


def stem_map(files: DataFrame) -> DataFrame:
    """stem, path: of several files of one stem the last path wins."""
    return files.groupBy("stem").agg(F.max("path").alias("path"))


def with_image(masks: DataFrame, images: DataFrame) -> DataFrame:
    """The masks that have an image of the same name."""
    return masks.join(images.select("name"), "name", "left_semi")


def mask_2d(a: np.ndarray) -> np.ndarray:
    """Squeezed to two dimensions, the first channel of three; else an error."""
    a = np.squeeze(a)
    if a.ndim == 3:
        a = a[..., 0]
    if a.ndim != 2:
        raise ValueError(f"no mask: {a.shape}")
    return a


def rgb_uint8(a: np.ndarray) -> np.ndarray:
    """Height, width, three channels of bytes: grey is repeated, channels first are turned, values up to 1.5 are scaled by 255."""
    a = np.asarray(a)
    if a.ndim == 2:
        a = np.repeat(a[..., None], 3, axis=2)
    if a.ndim == 3 and a.shape[0] in (1, 3) and a.shape[2] not in (1, 3):
        a = np.moveaxis(a, 0, 2)
    if a.ndim != 3:
        raise ValueError(f"no image: {a.shape}")
    if a.shape[2] == 1:
        a = np.repeat(a, 3, axis=2)
    if a.dtype != np.uint8:
        a = a.astype(np.float32)
        a = a * 255.0 if a.size and a.max() <= 1.5 else a
        a = np.clip(a, 0, 255).astype(np.uint8)
    return a[..., :3]


def bundle_arrays(content: bytes) -> tuple[np.ndarray | None, np.ndarray | None]:
    """(image, label) of an NPZ bundle by the first key that it has of each list."""
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        pick = lambda keys: next((z[k] for k in keys if k in z.files), None)
        return pick(IMAGE_KEYS), pick(LABEL_KEYS)


def _decode(spark: SparkSession, root: str, pattern: str, fn, schema: str) -> DataFrame:
    share_package(spark)
    names = [x.split()[0] for x in schema.split(", ")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):  # a file at a time: arrays are large
                try:
                    row = (*fn(content), None)
                except Exception as e:  # a broken file is told, not fatal
                    row = (*[None] * (len(names) - 2), f"{type(e).__name__}: {e}")
                yield pd.DataFrame([(path, *row)], columns=names)

    return files.mapInPandas(run, schema)


def read_masks(spark: SparkSession, root: str, pattern: str = "*.npy") -> DataFrame:
    """path, h, w, values (row-major), error of array files."""

    def one(content: bytes):
        m = mask_2d(np.load(io.BytesIO(content), allow_pickle=False))
        return m.shape[0], m.shape[1], m.astype(np.int16).ravel().tolist()

    return _decode(spark, root, pattern, one, "path string, h int, w int, values array<smallint>, error string")


def read_images(spark: SparkSession, root: str, pattern: str = "*.npy") -> DataFrame:
    """path, h, w, rgb (bytes, row-major, three a pixel), error."""

    def one(content: bytes):
        a = rgb_uint8(np.load(io.BytesIO(content), allow_pickle=False))
        return a.shape[0], a.shape[1], a.tobytes()

    return _decode(spark, root, pattern, one, "path string, h int, w int, rgb binary, error string")


def read_bundles(spark: SparkSession, root: str, pattern: str = "*.npz") -> DataFrame:
    """path, shape, image, label (flat, row-major), error; the task is the folder above a file."""

    def one(content: bytes):
        image, label = bundle_arrays(content)
        if image is None:
            raise ValueError("no image in the bundle")
        flat = lambda a, t: None if a is None else a.astype(t).ravel().tolist()
        return list(image.shape), flat(image, np.float32), flat(label, np.int16)

    got = _decode(spark, root, pattern, one, "path string, shape array<int>, image array<float>, label array<smallint>, error string")
    return got.withColumn("task", F.regexp_extract("path", r"([^/]+)/[^/]*$", 1))


def read_rasters(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    """Like read_images for picture files; needs Pillow on the workers."""

    def one(content: bytes):
        from PIL import Image

        a = rgb_uint8(np.asarray(Image.open(io.BytesIO(content)).convert("RGB")))
        return a.shape[0], a.shape[1], a.tobytes()

    return _decode(spark, root, pattern, one, "path string, h int, w int, rgb binary, error string")


def polygon_mask(points: list[list[float]], h: int, w: int) -> np.ndarray:
    """The pixels whose centre lies inside a polygon (even-odd rule) or on its corners."""
    p = np.asarray(points, float)
    y, x = np.mgrid[0:h, 0:w]
    inside = np.zeros((h, w), bool)
    for (x1, y1), (x2, y2) in zip(p, np.roll(p, -1, axis=0)):
        if y1 == y2:
            continue
        crosses = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        inside ^= crosses
    corner = np.round(p).astype(int)
    ok = (corner[:, 0] >= 0) & (corner[:, 0] < w) & (corner[:, 1] >= 0) & (corner[:, 1] < h)
    inside[corner[ok, 1], corner[ok, 0]] = True
    return inside
