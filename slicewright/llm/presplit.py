"""Vectorised splitting of texts into the words of byte-level BPE.

The rule is the public byte-level pattern: a contraction ('s 't 're 've 'm 'll 'd), letters, digits or other
signs each with at most one space in front, or white space; white space before a word leaves its last
character to stand alone or, if it is a space, to lead the word. Since the pattern never looks back and only
white space looks ahead, word starts are a local property of character classes, which NumPy finds for a whole
batch of texts at once.
"""

from __future__ import annotations

import sys

import numpy as np
import regex

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Texts are handled in groups of about so many characters, which bounds the memory of a group.
GROUP_CHARS = 400_000


def _cache() -> dict:
    """Kept on ``sys``, so it outlives the task in a reused worker."""
    return sys.__dict__.setdefault("_slicewright_llm", {})


def char_classes() -> np.ndarray:
    """The class of each code point."""
    cache = _cache()
    if "classes" not in cache:
        table = np.full(0x110000, OTHER, np.uint8)
        whole = [*range(0xD800), *range(0xE000, 0x110000)]
        text = "".join(map(chr, whole))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, text):
                a, b = whole[m.start()], whole[m.end() - 1]
                if b - a == m.end() - m.start() - 1:
                    table[a : b + 1] = kind
                else:
                    table[whole[m.start() : m.end()]] = kind
        cache["classes"] = table
    return cache["classes"]


def word_starts(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Offsets at which words begin. ``code``: code points of texts one after the other; ``first``: where each (non-empty) text begins."""
    n = len(code)
    kind = char_classes()[code]
    space = kind == SPACE
    fresh = np.zeros(n + 1, bool)
    fresh[first] = True
    fresh[n] = True
    change = fresh[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    # the last white space before a word begins something new: a word's lead, or a word of its own
    end_of_space = np.zeros(n, bool)
    end_of_space[:-1] = space[:-1] & ~space[1:] & ~fresh[1:n]
    start = change | end_of_space
    led = np.zeros(n, bool)  # signs right behind a plain space belong to it
    led[1:] = end_of_space[:-1] & (code[:-1] == 32)
    start &= ~led
    # contractions: an apostrophe that begins a run of signs and isn't led by a space
    at = np.flatnonzero((code == 39) & change & ~led)
    if len(at):
        pad = np.concatenate([code, np.zeros(3, code.dtype)])
        after = np.concatenate([fresh[: n + 1], np.ones(3, bool)])
        c1, c2 = pad[at + 1], pad[at + 2]
        in1, in2 = ~after[at + 1], ~after[at + 1] & ~after[at + 2]
        one = in1 & np.isin(c1, [115, 116, 109, 100])
        two = in2 & (((c1 == 114) & (c2 == 101)) | ((c1 == 118) & (c2 == 101)) | ((c1 == 108) & (c2 == 108)))
        for hit, size in ((one, 1), (two & ~one, 2)):
            p = at[hit]
            start[p + 1] = False
            q = p + 1 + size
            q = q[q < n]
            # what follows starts anew, unless it is a space that leads or ends as before
            start[q] |= ~led[q]
    return np.flatnonzero(start)


def safe_cuts(text: str, size: int) -> list[str]:
    """Pieces of a long text whose words together are the words of the text: cut only where white space follows something else."""
    if len(text) <= size:
        return [text]
    out, begin = [], 0
    cut = _cache().setdefault("cut", regex.compile(r"\S(?=\s)"))
    while len(text) - begin > size:
        m = cut.search(text, begin + size)
        if not m:
            break
        out.append(text[begin : m.end()])
        begin = m.end()
    out.append(text[begin:])
    return out


class Words:
    """The words of a group of texts: UTF-8 bytes ``raw``, word ``begin``/``end`` in bytes, and ``count`` words per text."""

    def __init__(self, texts: list[str]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        self.raw = joined.encode("utf-8", "replace")
        ends = np.cumsum(sizes)
        first = (ends - sizes)[sizes > 0]
        starts = word_starts(code, first) if len(code) else np.zeros(0, np.int64)
        if len(self.raw) == len(code):
            at = starts
        else:
            width = np.where(code < 0x80, 1, np.where(code < 0x800, 2, np.where(code < 0x10000, 3, 4))).astype(np.int8)
            offset = np.zeros(len(code) + 1, np.int64)
            np.cumsum(width, out=offset[1:])
            at = offset[starts]
        self.begin = at
        self.end = np.append(at[1:], len(self.raw)) if len(at) else at
        self.count = np.diff(np.searchsorted(starts, np.append(0, ends)))


_HASHED = 48


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cache = _cache()
    if "powers" not in cache or len(cache["powers"][0]) < n:
        size = max(n, 2 * GROUP_CHARS)
        base = 0x9E3779B97F4A7C15 | 1
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        rng = np.random.default_rng(7)
        cache["powers"] = np.cumprod(up), np.cumprod(down), rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    return cache["powers"]


def distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first, inverse): an example of each distinct word, and for each word the number of its example.

    Words of up to 48 bytes are told apart by a 64-bit rolling hash with their length, checked byte for byte
    against the example; longer ones, and those that fail the check, by their bytes.
    """
    n = len(words.begin)
    raw = np.frombuffer(words.raw, np.uint8)
    up, down, letter = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(letter[raw] * up[: len(raw)], out=total[1:])
    size = words.end - words.begin
    key = (total[words.end] - total[words.begin]) * down[words.begin] * np.uint64(0xD6E8FEB86659FD93) + size.astype(np.uint64)
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    # the check: compare each word with its example
    ex = first[inverse]
    odd = np.flatnonzero((size > _HASHED) | (size != size[ex]))
    short = np.flatnonzero((size <= _HASHED) & (size == size[ex]) & (ex != np.arange(n)))
    for step in range(0, _HASHED, 8):
        live = short[size[short] > step]
        if not len(live):
            break
        k = np.minimum(size[live] - step, 8)
        left, right = _eight(raw, words.begin[live] + step, k), _eight(raw, words.begin[ex[live]] + step, k)
        if (left != right).any():
            odd = np.union1d(odd, live[left != right])
    if len(odd):
        seen: dict[bytes, int] = {}
        extra = []
        for i in odd.tolist():
            w = words.raw[words.begin[i] : words.end[i]]
            if w not in seen:
                seen[w] = len(first) + len(extra)
                extra.append(i)
            inverse[i] = seen[w]
        first = np.concatenate([first, np.array(extra, first.dtype)])
    return first, inverse


def _eight(raw: np.ndarray, at: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The next ``k`` (1 to 8) bytes at each offset as one number."""
    cache = _cache()
    buf = cache.get("wide")
    if buf is None or buf[0] is not raw:
        padded = np.concatenate([raw, np.zeros(8, np.uint8)])
        buf = cache["wide"] = (raw, np.lib.stride_tricks.sliding_window_view(padded, 8))
    value = np.ascontiguousarray(buf[1][at]).view(np.uint64).ravel()
    return value & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - k) * 8).astype(np.uint64))
