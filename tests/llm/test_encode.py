import random

import pytest
from tokenizers import Tokenizer

from slicewright.llm import encode as E
from slicewright.llm.presplit import safe_cuts

HARD = [
    None, "", "  ", "a", "it's we'll 'sure ''s 's's !'s x 's \n's", "I'll've'd'm 'RE 'Ll o'er'e 'r 'v 'l", "a  b   c\n\n d \t e", " x  y", "<|endoftext|> hi", "aaaaaaa aaaa aaaaaaaaaa",
    "éàü ñ 日本語 テキスト 👩‍👩‍👧‍👦", "x" * 5000, "ab" * 3000, "12 34 5a6b7", "a\r\n\r\nb", "  lead", "trail   ", "\n\n\n", "'", "''", "'s", " 's", " 'll", "　　日 a​b ½ ²x Ⅷ '́s", "\x00\x01 \x85 ﻿",
]


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(E.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def ours(texts):
    out = []
    for ids, sizes in E.encoder(E.DEFAULT_VOCABULARY).encode_texts(texts):
        at = 0
        for n in sizes:
            out.append(ids[at : at + n].tolist())
            at += n
    return out


def test_hard_texts(public):
    assert ours(HARD) == public(HARD)


def test_random_texts(public):
    rng = random.Random(5)
    signs = " \n\t'sdtmrevl aA1é日!- ½ "
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    assert ours(texts) == public(texts)


def test_long_texts_are_cut_where_words_end_anyway(public, monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice([" ", "\n", "ab", "7", "'s", "  ", "é", "x" * 50]) for _ in range(4000))
    assert "".join(safe_cuts(text, 100)) == text and len(safe_cuts(text, 100)) > 10
    monkeypatch.setattr(E, "GROUP_CHARS", 100)
    texts = ["short", text, "", "x" * 3000, None, text[:150]]
    assert ours(texts) == public(texts)


def test_store_starts_anew(public, monkeypatch):
    monkeypatch.setattr(E, "STORE_WORDS", 5)
    texts = [f"word{i} number{i}" for i in range(50)]
    assert ours(texts) == public(texts)


def test_table(spark, public):
    rows = [(i, t, "c") for i, t in enumerate(HARD)] + [(None, "null id", "c"), (3, "a", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = E.encode_ids(df)
    assert got.columns == ["doc_id", "ids"]
    want = dict(zip(range(len(HARD)), public(HARD))) | {None: public(["null id"])[0]}
    found = got.collect()
    assert len(found) == len(rows) and all(r.ids == want[r.doc_id] for r in found)
    counts = E.with_token_counts(df.withColumnRenamed("ids", "n_tokens")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in counts) == sorted((r.doc_id is None, r.doc_id or 0, len(r.ids)) for r in found)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert E.encode_ids(df).count() == 0 and E.with_token_counts(df).count() == 0
