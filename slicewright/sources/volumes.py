"""Readers of volume formats whose libraries may be missing: HDF5, NIfTI and DICOM.

A decoder is imported on the workers when a file is read; without it every file comes as a row with its error,
so a pipeline can tell what it lacks instead of failing halfway.
"""

from __future__ import annotations

import io
import os
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewright.sources.arrays import IMAGE_KEYS, LABEL_KEYS, _decode

SCHEMA = "path string, shape array<int>, image array<float>, label array<smallint>, spacing array<double>, series string, error string"


def _row(image: np.ndarray, label: np.ndarray | None = None, spacing: list[float] | None = None, series: str | None = None) -> tuple:
    flat = None if label is None else np.asarray(label).astype(np.int16).ravel().tolist()
    return list(image.shape), np.asarray(image, np.float32).ravel().tolist(), flat, spacing, series


def hdf5(content: bytes) -> tuple:
    """Image and label by their usual keys, else the first data set of three dimensions; spacing where there is one."""
    import h5py

    with h5py.File(io.BytesIO(content), "r") as f:
        find = lambda keys: next((f[k][()] for k in keys if k in f), None)
        image = find(IMAGE_KEYS)
        if image is None:
            image = next((d[()] for d in f.values() if getattr(d, "ndim", 0) == 3), None)
        if image is None:
            raise ValueError("no volume in the file")
        spacing = [float(x) for x in f["spacing"][()]] if "spacing" in f else None
        return _row(image, find(LABEL_KEYS), spacing)


def nifti(content: bytes) -> tuple:
    """The volume with the spacing of its header."""
    import nibabel

    with tempfile.TemporaryDirectory() as d:  # the library reads files only; a worker's own scratch for one file
        name = os.path.join(d, "v.nii.gz" if content[:2] == b"\x1f\x8b" else "v.nii")
        with open(name, "wb") as f:
            f.write(content)
        v = nibabel.load(name)
        return _row(np.asarray(v.dataobj), spacing=[float(x) for x in v.header.get_zooms()[:3]])


def dicom(content: bytes) -> tuple:
    """One slice with its pixel spacing and the UID of its series."""
    import pydicom

    s = pydicom.dcmread(io.BytesIO(content))
    spacing = [float(x) for x in getattr(s, "PixelSpacing", [])] + [float(getattr(s, "SliceThickness", 0) or 0)]
    return _row(s.pixel_array, spacing=spacing, series=str(s.SeriesInstanceUID))


DECODERS = {"hdf5": (hdf5, "*.h5"), "nifti": (nifti, "*.nii*"), "dicom": (dicom, "*.dcm")}


def read_volumes(spark: SparkSession, root: str, kind: str, pattern: str | None = None) -> DataFrame:
    """path, shape, image, label, spacing, series, error of the files of a kind: hdf5, nifti or dicom."""
    decoder, default = DECODERS[kind]
    return _decode(spark, root, pattern or default, decoder, SCHEMA)


def series_summary(slices: DataFrame) -> DataFrame:
    """series, number of slices, first and last path, and whether all slices have one shape."""
    good = slices.where("series is not null")
    return good.groupBy("series").agg(F.count(F.lit(1)).alias("n_slices"), F.min("path").alias("first_path"), F.max("path").alias("last_path"), (F.count_distinct("shape") == 1).alias("one_shape"))


def volume_pairs(images: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Images with the label volume of the same key and shape; the label's values go as ``label``."""
    own = labels.select(key, F.col("image").alias("label"), F.col("shape").alias("_shape"))
    return images.drop("label").join(own, key).where(F.col("shape") == F.col("_shape")).drop("_shape")
