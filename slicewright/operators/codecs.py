"""Run lengths as texts: start-length lists, and the compact text of public annotation formats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewright.session import share_package

#: Five bits of a number in each sign, the least first; 32 tells that more follow; signs begin at "0".
BITS, MORE, FIRST = 5, 32, 48
MOST_SIGNS = 7


def _segments(size: np.ndarray) -> np.ndarray:
    return np.repeat(np.cumsum(size) - size, size)


def pack_counts(counts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signs, signs a mask) of the run lengths of many masks one after the other, ``size`` of each.

    From the fourth run of a mask on, the difference to the run before the last one is written.
    """
    counts = counts.astype(np.int64)
    place = np.arange(len(counts)) - _segments(size)
    value = counts.copy()
    late = np.flatnonzero(place > 2)
    value[late] -= counts[late - 2]
    signs = np.zeros((len(value), MOST_SIGNS), np.uint8)
    used = np.zeros((len(value), MOST_SIGNS), bool)
    open_rows = np.ones(len(value), bool)
    for k in range(MOST_SIGNS):
        digit = value & (MORE - 1)
        value >>= BITS
        # the fifth bit is the sign of what is left, so a number ends when the rest is only that sign
        done = np.where(digit & 16, value == -1, value == 0)
        signs[:, k] = np.where(done, digit, digit | MORE) + FIRST
        used[:, k] = open_rows
        open_rows &= ~done
    n = used.sum(1)
    owner = np.repeat(np.arange(len(size)), size)
    return signs[used], np.bincount(owner, n, len(size)).astype(np.int64)


def unpack_counts(signs: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run lengths, runs a mask) of packed signs, ``size`` of each mask."""
    digit = signs.astype(np.int64) - FIRST
    ends = (digit & MORE) == 0
    number = np.cumsum(ends) - ends
    first = np.flatnonzero(np.append(True, ends[:-1])) if len(digit) else np.zeros(0, np.int64)
    place = np.arange(len(digit)) - first[number] if len(digit) else digit
    total = np.zeros(int(ends.sum()), np.int64)
    np.add.at(total, number, (digit & (MORE - 1)) << (BITS * place))
    last = np.flatnonzero(ends)
    total -= np.where(digit[last] & 16, np.int64(1) << (BITS * (place[last] + 1)), 0)
    owner = np.repeat(np.arange(len(size)), size)
    runs = np.bincount(owner[last], minlength=len(size))
    at = np.append(0, np.cumsum(runs))
    for a, b in zip(at[:-1], at[1:]):
        for start in (1, 2):  # each run adds to the one before the last, in two chains
            total[a + start : b : 2] = np.cumsum(total[a + start : b : 2])
    return total, runs


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return lists.flatten().fill_null(0).to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


def pack_runs(df: DataFrame, key: str, counts: str = "counts") -> DataFrame:
    """key, packed: run lengths as compact text; null counts are left out, an empty list is an empty text."""
    share_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signs, n = pack_counts(*_flat(b.column(1)))
            texts = pa.StringArray.from_buffers(len(n), pa.py_buffer(np.append(0, np.cumsum(n)).astype(np.int32).tobytes()), pa.py_buffer(signs.tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), texts], names=[key, "packed"])

    return df.where(F.col(counts).isNotNull()).select(key, F.col(counts).alias("_c")).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, packed string")


def unpack_runs(df: DataFrame, key: str, packed: str = "packed") -> DataFrame:
    """key, counts: compact texts as run lengths; null texts are left out."""
    share_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [t.encode() for t in b.column(1).to_pylist()]
            total, runs = unpack_counts(np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(runs)).astype(np.int32)), pa.array(total.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, "counts"])

    return df.where(F.col(packed).isNotNull()).select(key, F.col(packed).alias("_p")).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, counts array<int>")


def pairs_of_mask(df: DataFrame, key: str, counts: str = "counts") -> DataFrame:
    """key, pairs: run lengths as a text of alternating starts and lengths of their foreground; null counts are left out."""
    share_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, size = _flat(b.column(1))
            texts = []
            for c in np.split(flat.astype(np.int64), np.cumsum(size)[:-1]) if len(size) else []:
                both = np.stack([(np.cumsum(c) - c)[1::2], c[1::2]], 1)
                texts.append(" ".join(map(str, both[both[:, 1] > 0].ravel().tolist())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "pairs"])

    return df.where(F.col(counts).isNotNull()).select(key, F.col(counts).alias("_c")).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, pairs string")


def mask_of_pairs(df: DataFrame, key: str, text: str, h: str, w: str) -> DataFrame:
    """key, mask_hw, counts of texts of alternating starts and lengths over an image read row by row, transposed: the mask has w rows and h columns.

    Starts count from 0. Runs may overlap or come in any order; what lies beyond the image is cut; a last odd number is
    left out. Rows with a null text or size are left out; a text with anything but whole numbers is an error.
    """
    share_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, hh, ww in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                n = np.array(t.split(), np.int64)
                n = n[: len(n) // 2 * 2].reshape(-1, 2)
                n = n[np.lexsort((n[:, 1], n[:, 0]))]
                begin, end = (np.clip(v, 0, hh * ww) for v in (n[:, 0], n[:, 0] + n[:, 1]))
                reach = np.maximum.accumulate(end) if len(end) else end
                begin = np.maximum(begin, np.append(0, reach[:-1])) if len(end) else begin
                live = reach > begin
                flips = np.stack([begin[live], reach[live]], 1).ravel()
                # row by row over the image is column by column over its transpose
                out.append(np.diff(np.concatenate([[0], flips, [hh * ww]])) if len(flips) == 0 or flips[-1] < hh * ww else np.diff(np.concatenate([[0], flips])))
            offsets = np.append(0, np.cumsum([len(c) for c in out])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)))
            sizes = pa.array([[ww, hh] for hh, ww in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, lists], names=[key, "mask_hw", "counts"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).alias("_t"), F.col(h).cast("int").alias("_h"), F.col(w).cast("int").alias("_w")).dropna(subset=["_t", "_h", "_w"]).mapInArrow(run, f"{key} {kind}, mask_hw array<int>, counts array<int>")
