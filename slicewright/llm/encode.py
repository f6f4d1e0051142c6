"""Encoding of whole texts with a public byte-level BPE tokenizer.

Texts are split into words (``presplit``); the distinct words of a partition are merged together by a pair
occurrence index: every pair of neighbouring symbols is mapped to all its positions, the active merge ranks
are taken in ascending order from a heap, and each merge updates the lists of the pairs it makes. As a merge
only makes pairs of a higher rank, one ascending pass over all words gives what merging each word alone
would. Every word is merged once per partition however often it occurs.

Null and empty texts have no ids: an empty list. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewright.llm.presplit import GROUP_CHARS, Words, _cache, distinct, safe_cuts
from slicewright.session import share_package

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Words kept from one group of texts to the next; the store starts anew beyond it.
STORE_WORDS = 400_000
#: Rows in an Arrow batch; texts may be long.
BATCH_ROWS = 2_000


def _byte_signs() -> list[str]:
    """The printable sign that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in signs):
        signs[b] = chr(256 + k)
    return [signs[b] for b in range(256)]


class PairIndexEncoder:
    """Merges of a byte-level BPE vocabulary file, and the pass over many words at once."""

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        self.of_byte = [ids[s] for s in _byte_signs()]
        self.pairs: dict[int, tuple[int, int]] = {}
        sign_byte = {s: 1 for s in _byte_signs()}
        self.width = np.zeros(max(ids.values()) + 1, np.int32)
        for token, i in ids.items():
            self.width[i] = sum(map(sign_byte.get, token)) if all(c in sign_byte for c in token) else 0
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[ids[a] << 20 | ids[b]] = (rank, ids[a + b])
        self.merged = [0] * len(self.pairs)
        self.key = [0] * len(self.pairs)
        for k, (rank, new) in self.pairs.items():
            self.merged[rank], self.key[rank] = new, k
        self.store: dict[bytes, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.store.clear()
        self.flat = np.zeros(1 << 16, np.int32)
        self.bounds = [0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, by one ascending pass over all of them."""
        of_byte, pairs = self.of_byte, self.pairs
        sym: list[int] = []
        nxt: list[int] = []
        heads: list[int] = []
        for w in words:
            heads.append(len(sym))
            sym.extend([of_byte[b] for b in w])
            nxt.extend(range(heads[-1] + 1, len(sym) + 1))
            if w:
                nxt[-1] = -1
        prv = [-1] * len(sym)
        index: dict[int, list[int]] = {}  # rank -> positions of its pair
        for i, j in enumerate(nxt):
            if j >= 0:
                prv[j] = i
                hit = pairs.get(sym[i] << 20 | sym[j])
                if hit:
                    index.setdefault(hit[0], []).append(i)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            positions = index.pop(rank)
            a, b, new = self.key[rank] >> 20, self.key[rank] & 0xFFFFF, self.merged[rank]
            if a == b:
                positions.sort()  # runs of one sign merge from the left
            for i in positions:
                j = nxt[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue  # used up by another merge
                k = nxt[j]
                sym[i], sym[j], nxt[i] = new, -1, k
                if k >= 0:
                    prv[k] = i
                    hit = pairs.get(new << 20 | sym[k])
                    if hit:
                        r = hit[0]
                        if r in index:
                            index[r].append(i)
                        else:
                            index[r] = [i]
                            heapq.heappush(heap, r)
                p = prv[i]
                if p >= 0:
                    hit = pairs.get(sym[p] << 20 | new)
                    if hit:
                        r = hit[0]
                        if r in index:
                            index[r].append(p)
                        else:
                            index[r] = [p]
                            heapq.heappush(heap, r)
        out = []
        for w, h in zip(words, heads):
            one, i = [], h if w else -1
            while i >= 0:
                one.append(sym[i])
                i = nxt[i]
            out.append(one)
        return out

    def _known(self, words: list[bytes]) -> np.ndarray:
        """The number of each word in the store, after encoding those it lacks."""
        store = self.store
        if len(store) > STORE_WORDS:
            self._reset()
            store = self.store
        new = [w for w in words if w not in store]
        if new:
            ids = self.encode_words(new)
            total = sum(map(len, ids))
            used = self.bounds[-1]
            while used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.int32)])
            self.flat[used : used + total] = [x for one in ids for x in one]
            for w, one in zip(new, ids):
                store[w] = len(self.bounds) - 1
                self.bounds.append(self.bounds[-1] + len(one))
        return np.fromiter((store[w] for w in words), np.int64, len(words))

    def encode_group(self, texts: list[str], counts_only: bool = False) -> tuple[np.ndarray | None, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        words = Words(texts)
        if not len(words.begin):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        first, inverse = distinct(words)
        raw = words.raw
        number = self._known([raw[a:b] for a, b in zip(words.begin[first].tolist(), words.end[first].tolist())])
        bounds = np.asarray(self.bounds)
        begin, size = bounds[number], bounds[number + 1] - bounds[number]
        per_word = size[inverse]
        run = np.zeros(len(per_word) + 1, np.int64)
        np.cumsum(per_word, out=run[1:])
        per_text = np.diff(run[np.append(0, np.cumsum(words.count))])
        if counts_only:
            return None, per_text
        at = np.repeat(begin[inverse] - run[:-1], per_word) + np.arange(run[-1])
        return self.flat[at], per_text

    def encode_texts(self, texts: list[str | None], counts_only: bool = False) -> Iterator[tuple[np.ndarray | None, np.ndarray]]:
        """(ids, sizes) for successive stretches of ``texts``, in order, each of about GROUP_CHARS characters or one text."""
        group: list[str] = []
        chars = 0
        for t in texts:
            t = t or ""
            if chars and chars + len(t) > GROUP_CHARS:
                yield self.encode_group(group, counts_only)
                group, chars = [], 0
            if len(t) > GROUP_CHARS:
                parts = [self.encode_group([p], counts_only) for p in safe_cuts(t, GROUP_CHARS)]
                if group:
                    yield self.encode_group(group, counts_only)
                    group = []
                yield None if counts_only else np.concatenate([p[0] for p in parts]), np.array([sum(int(p[1][0]) for p in parts)])
            else:
                group.append(t)
                chars += len(t)
        if group:
            yield self.encode_group(group, counts_only)


def encoder(path: str) -> PairIndexEncoder:
    """The encoder of a vocabulary file, one per worker process; a file that a worker lacks is the one sent with the job."""
    cache = _cache()
    if path not in cache:
        cache[path] = PairIndexEncoder(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
    return cache[path]


def batched(df: DataFrame, vocabulary: str) -> None:
    """Importable workers that have the vocabulary, and small Arrow batches, for the Python stages over texts.

    The batch size is a setting of the session and stays for its later queries: texts may be long, and a stage
    that is run later reads the setting then.
    """
    share_package(df.sparkSession)
    if not df.sparkSession.sparkContext.master.startswith("local"):
        df.sparkSession.sparkContext.addFile(vocabulary)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def encode_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """id_col and ``ids`` (array<int>) of each row; repeated rows repeat, other columns are not read."""
    batched(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            at = 0
            for ids, sizes in enc.encode_texts(batch.column(1).to_pylist()):
                offsets = np.zeros(len(sizes) + 1, np.int32)
                np.cumsum(sizes, out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sizes)), lists], names=[id_col, "ids"])
                at += len(sizes)

    pair = docs.select(F.col(id_col), F.col(text_col).alias("_slicewright_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return pair.mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def with_token_counts(docs: DataFrame, text_col: str = "text", name: str = "n_tokens", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``docs`` without its text and with the number of tokens of each text (0 for null and empty)."""
    batched(docs, vocabulary)
    rest = [c for c in docs.columns if c not in (text_col, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            sizes = [s for _, s in enc.encode_texts(batch.column(batch.num_columns - 1).to_pylist(), counts_only=True)]
            counts = pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), counts], names=[*rest, name])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest]
    return docs.select(*(F.col(f"`{c}`") for c in rest), F.col(text_col).alias("_slicewright_text")).mapInArrow(run, ", ".join([*kinds, f"`{name}` bigint"]))
