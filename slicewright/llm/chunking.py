"""Splitting oversized documents at natural boundaries.

The tokens of a document have byte offsets by a prefix sum of their widths; its paragraph, line, sentence,
clause and word ends and separators that fall between two tokens form sorted arrays. A piece runs to the last boundary under
the limit, found by binary search, in the order of ``PREFERENCE``: the best kind first, if it fills at least
half the limit; failing all it is cut hard at the limit. The next piece starts ``overlap`` tokens before the
cut, so each shares exactly that many tokens with the one before. Cuts are only made where they and the start
of the next piece fall between characters; if no such place is left, at the limit itself, and the split
character is then shown as U+FFFD in both texts (token ranges stay exact).

Boundaries are looked for in the characters of the text, not in its bytes. Spaces and line ends are those of
Unicode: LF, VT, FF, CR, CR LF, NEL, LS and PS end a line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewright.llm.encode import DEFAULT_VOCABULARY, batched, encoder
from slicewright.llm.presplit import SPACE, char_classes

KINDS = ("paragraph", "sentence", "line", "clause", "word", "separator")
#: What is looked for, and whether it has to fill half the limit.
PREFERENCE = (("paragraph", True), ("sentence", True), ("line", True), ("sentence", False), ("line", False), ("clause", True), ("word", False), ("clause", False), ("separator", False))
_SENTENCE = re.compile("[.!?…]+[\"'”’»)\\]]*(?=\\s)|[。！？｡]+[”’」』）]*")
_CLAUSE = re.compile("[,;:](?=\\s)|[、，；：]")
_SEPARATORS = np.array([ord(x) for x in ",;|"])
_BREAKS = np.array([10, 11, 12, 13, 0x85, 0x2028, 0x2029])
_PARAGRAPH_SIGN = 0x2029


def character_ends(text: str) -> dict[str, np.ndarray]:
    """Sorted places in ``text``, in characters, before which it breaks by itself, by kind.

    A paragraph ends behind a blank line, a line behind its line end, a sentence or clause behind its sign and
    closing quotes, a word before white space; a separator is one within a word, as in lists without spaces.
    """
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    space = char_classes()[code] == SPACE
    ends_line = np.isin(code, _BREAKS)
    ends_line[:-1] &= ~((code[:-1] == 13) & (code[1:] == 10))
    line = np.flatnonzero(ends_line) + 1
    solid = np.append(0, np.cumsum(~space))
    blank = np.zeros(len(line), bool)
    blank[1:] = solid[line[1:]] == solid[line[:-1]]
    blank |= code[line - 1] == _PARAGRAPH_SIGN
    return {
        "paragraph": line[blank],
        "sentence": np.fromiter((m.end() for m in _SENTENCE.finditer(text)), np.int64),
        "line": line,
        "clause": np.fromiter((m.end() for m in _CLAUSE.finditer(text)), np.int64),
        "word": np.flatnonzero(~space[:-1] & space[1:]) + 1,
        "separator": np.flatnonzero(np.isin(code, _SEPARATORS)) + 1,
    }


def boundaries(text: str, offsets: np.ndarray, overlap: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Sorted token positions at which a piece may end, by kind; and all that fall between characters.

    ``offsets``: where each token begins in the bytes of ``text``, and where the last ends.
    """
    n = len(offsets) - 1
    byte = np.frombuffer(text.encode("utf-8", "replace") + b" ", np.uint8)
    lead = (byte & 0xC0) != 0x80
    whole = lead[offsets]
    good = whole.copy()
    good[overlap:] &= whole[: n + 1 - overlap]
    place = np.flatnonzero(lead)  # of each character in the bytes
    out = {}
    for kind, ends in character_ends(text).items():
        at = place[ends]
        k = np.searchsorted(offsets, at)
        k = k[(k < n) & (offsets[np.minimum(k, n)] == at)]
        out[kind] = k[good[k]]
    return out, np.flatnonzero(good)


def pieces(text: str, widths: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(first token, token after the last, how it was cut) of each piece."""
    offsets = np.zeros(len(widths) + 1, np.int64)
    np.cumsum(widths, out=offsets[1:])
    ends, good = boundaries(text, offsets, overlap)
    n, start, out = len(widths), 0, []

    def last(at: np.ndarray, low: int, high: int) -> int:
        k = int(np.searchsorted(at, high, "right")) - 1
        return int(at[k]) if k >= 0 and at[k] > low else -1

    while n - start > limit:
        low, high = start + overlap, start + limit
        half = max(low, start + limit // 2)
        for kind, far in PREFERENCE:
            end = last(ends[kind], half if far else low, high)
            if end > 0:
                break
        else:
            kind, end = "hard", last(good, low, high)
            if end < 0:
                end = high
        out.append((start, end, kind))
        start = end - overlap
    out.append((start, n, "end"))
    return out


def split_oversized(
    docs: DataFrame,
    limit: int = 512,
    overlap: int = 48,
    keep_short: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = DEFAULT_VOCABULARY,
) -> DataFrame:
    """id_col, piece_no, token_start, token_end, n_tokens, shared_tokens, cut and text of the pieces of each oversized text.

    A text of at most ``limit`` tokens is no piece of anything; with ``keep_short`` it comes as one piece, null
    and empty texts excepted. Repeated rows repeat; other columns are not read.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be below half the limit")
    batched(docs, vocabulary)
    names = [id_col, "piece_no", "token_start", "token_end", "n_tokens", "shared_tokens", "cut", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            for ids, sizes in enc.encode_texts(texts):
                widths = enc.width[ids]
                first = np.append(0, np.cumsum(sizes)).tolist()
                rows: list[list] = [[] for _ in names[1:]]
                owner = []
                for i, size in enumerate(sizes.tolist()):
                    if size == 0 or size <= limit and not keep_short:
                        continue
                    text = texts[at + i]
                    raw = text.encode()
                    own = widths[first[i] : first[i + 1]]
                    offsets = np.append(0, np.cumsum(own)).tolist()
                    for k, (a, b, cut) in enumerate(pieces(text, own, limit, overlap)):
                        owner.append(at + i)
                        for column, value in zip(rows, (k, a, b, b - a, overlap if k else 0, cut, raw[offsets[a] : offsets[b]].decode("utf-8", "replace"))):
                            column.append(value)
                if owner:
                    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *(pa.array(c, k) for c, k in zip(rows, kinds))], names=names)
                at += len(sizes)

    kind = docs.schema[id_col].dataType.simpleString()
    pair = docs.select(F.col(id_col), F.col(text_col).alias("_slicewright_text"))
    return pair.mapInArrow(run, f"{id_col} {kind}, piece_no int, token_start int, token_end int, n_tokens int, shared_tokens int, cut string, text string")
