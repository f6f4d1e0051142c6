import random
import re

import numpy as np
import pytest

from slicewright.llm import chunking as C
from slicewright.llm import encode as E


def texts():
    rng = random.Random(2)
    words = ["alpha", "beta.", "gamma", "日本語", "é", "12,5", "x"]
    prose = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "\n\n", ". "]) for _ in range(n))
    return [prose(40), prose(400), "q" * 4000, "日" * 900, "👩" * 500, "a b " * 700, None, "", "   ", "\n\n" * 600, prose(3000)]


@pytest.mark.parametrize(("limit", "overlap"), [(64, 8), (32, 0), (128, 60)])
def test_pieces(spark, limit, overlap):
    docs = texts()
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(docs)], "doc_id bigint, text string, cut string")
    ids = {r.doc_id: r.ids for r in E.encode_ids(df).collect()}
    enc = E.encoder(E.DEFAULT_VOCABULARY)
    by: dict[int, list] = {}
    for r in C.split_oversized(df, limit, overlap).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {i for i, x in ids.items() if len(x) > limit}
    for i, rows in by.items():
        rows.sort(key=lambda r: r.piece_no)
        offsets = [0]
        for t in ids[i]:
            offsets.append(offsets[-1] + int(enc.width[t]))
        raw = docs[i].encode()
        assert offsets[-1] == len(raw)
        assert rows[0].token_start == 0 and rows[-1].token_end == len(ids[i])
        for k, r in enumerate(rows):
            assert r.piece_no == k and 0 < r.n_tokens <= limit and r.n_tokens == r.token_end - r.token_start
            assert r.text == raw[offsets[r.token_start] : offsets[r.token_end]].decode("utf-8", "replace")
            if k:
                assert rows[k - 1].token_end - r.token_start == overlap == r.shared_tokens
            if r.cut == "paragraph":
                assert r.text.rstrip(" \t\r") .endswith("\n") or "\n" in r.text[-6:]
            if r.cut == "sentence":
                assert r.text.rstrip("\"'”’)]")[-1] in ".!?…。！？"


def test_natural_cuts_come_first(spark):
    text = "\n\n".join("one two three four five six seven." for _ in range(30))
    cuts = [r.cut for r in C.split_oversized(spark.createDataFrame([(1, text)], "doc_id int, text string"), 64, 8).collect()]
    assert set(cuts) == {"paragraph", "end"}


def test_characters_stay_whole_where_they_can(spark):
    df = spark.createDataFrame([(1, "日本語テキスト" * 300)], "doc_id int, text string")
    assert not [r for r in C.split_oversized(df, 64, 8).collect() if "�" in r.text]


def test_short_and_empty(spark):
    df = spark.createDataFrame([(1, "short"), (2, ""), (3, None)], "doc_id int, text string")
    assert C.split_oversized(df).count() == 0
    assert [(r.doc_id, r.text) for r in C.split_oversized(df, keep_short=True).collect()] == [(1, "short")]
    assert C.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        C.split_oversized(df, 50, 30)


def test_sentence_ends_are_whole_signs(spark):
    text = "Wir prüfen die Größe. „Größe?” Ja…” Nein!) из р с т 检查没有。再来！」好？検査を "
    raw = text.encode()
    at, _ = C.boundaries(text, np.arange(len(raw) + 1), 0)
    want = [len(text[: m.end()].encode()) for m in re.finditer("[.!?…][\"'”’)\\]]*(?=\\s)|[。！？]」?", text)]
    assert at["sentence"].tolist() == want and len(want) == 7
    docs = ["Wir müssen die Größe der Bögen überprüfen und für später fünf grüne Hügel ausfüllen\n" * 40, "检查第455层没有发现异常情况继续检查其他图像\n" * 60]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    assert {r.cut for r in C.split_oversized(df, 64, 8).collect()} == {"line", "end"}


@pytest.mark.parametrize(
    ("text", "cut"),
    [
        ("Die Prüfung der Schädel läuft weiter. Für jede Größe gibt es zwölf Bögen!\n", "sentence"),
        ("L’élève a relevé les mâchoires “à gauche”. Où sont les côtés gênants ? ", "sentence"),
        ("第三层没有发现异常。请检查其余图像！", "sentence"),
        ("この検査では異常は見つからなかった。次の画像を確認してください。", "sentence"),
        ("ひとつの長い文、まだ続く、さらに続く、", "clause"),
        ("erste Zeile der Größe\u2028zweite Zeile für später\u2028", "line"),
        ("erste Zeile der Größe\rzweite Zeile für später\r", "line"),
        ("ein Absatz der Größe\x85 \x85", "paragraph"),
        ("Wörter\u00a0ohne\u3000gewöhnliche\u00a0Lücken\u3000", "word"),
        ("373,7997;642|", "separator"),
    ],
)
def test_languages_and_line_ends(spark, text, cut):
    df = spark.createDataFrame([(1, text * 60)], "doc_id int, text string")
    rows = C.split_oversized(df, 128, 0).collect()
    assert {r.cut for r in rows} == {cut, "end"} and len(rows) > 3
    last = {"sentence": ".!?。！", "clause": "、", "line": "\u2028\r", "paragraph": "\x85", "word": "renshe", "separator": ",;|"}[cut]
    assert all(r.text[-1] in last for r in rows if r.cut != "end")


def test_no_false_sentence_ends_in_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = C.split_oversized(docs).where("cut = 'sentence'").collect()
    assert len(rows) > 50 and all(r.text.rstrip("\"'”’»)]」』）")[-1] in ".!?…。！？｡" for r in rows)
