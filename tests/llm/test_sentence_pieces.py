"""SentencePiece ids and texts against the library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from exposure.llm import arrow_text as at
from exposure.llm import sentence_pieces
from exposure.llm.queries import QUERIES, vocabulary

PATH = vocabulary("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = [
    "", None, " ", "\n\n", "a", "é", "  two  words ", "tab\tand\x0bmore\x0c\r\n x\r y;\r", "<s> </s> <unk> <0x0A>", "日本語 テスト 🎉🎉",
    "\x00 nul \x1c sep", "▁▁ x▁y", "x" * 3000, "ab" * 2000, "。" * 100, " " * 1000, "ﬁ ẞ İ", "�﻿", "1234567890" * 30,
]


def pieces_at_random(seed=0):
    rng = random.Random(seed)
    letters = "".join(LIBRARY.id_to_piece(i) for i in range(300, 32000))
    out = []
    for n in (5, 50, 500, 5000):
        for _ in range(10):
            out += ["".join(rng.choices(letters, k=n)), "".join(rng.choices("etaoinshrdlu", k=n)), "".join(LIBRARY.id_to_piece(rng.randrange(259, 32000)) for _ in range(n))]
    return out


def whole(texts):
    model = sentence_pieces.model_at(PATH)
    return list(sentence_pieces.encoded(model, at.text_column(pa.array(texts, pa.string())), True))


def check(texts):
    found = whole(texts)
    assert len(found) == len(texts)
    for text, (ids, back) in zip(texts, found):
        want = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
        assert ids.tolist() == want and back.decode() == LIBRARY.decode(want)


def test_ids_and_texts_equal_the_library():
    check(ODD + pieces_at_random())


@given(st.lists(st.text(max_size=60) | st.text("ab e\n▁", max_size=200), max_size=5))
@settings(max_examples=150, deadline=None)
def test_any_text(texts):
    check([t.encode("utf-8", "replace").decode() for t in texts])


def test_any_ids_decode_as_the_library_says():
    rng = random.Random(2)
    pick = lambda: rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3), 28705])
    runs = [[pick() for _ in range(rng.randrange(12))] for _ in range(5000)]
    edges = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    found = sentence_pieces.model_at(PATH).decode(np.array([x for r in runs for x in r], np.int64), edges)
    assert [f.decode() for f in found] == [LIBRARY.decode(r) for r in runs]


@pytest.mark.parametrize("text", ["e" * 1_000_000, "word " * 500_000, "a\n" * 300_000 + "ä b", "日本語" * 300_000])
def test_texts_of_a_megabyte(text):
    check([text, "after it"])


def test_long_texts_are_cut_at_spaces_only(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab  é\n語", k=n)) for n in (0, 10, 100, 1000, 3)]
    model = sentence_pieces.model_at(PATH)
    spans = list(sentence_pieces.spans(at.text_column(pa.array(texts)), model.spaced, 64))
    assert len(spans) > 10 and b"".join(x for _, own, _ in spans for x in own) == "".join(texts).encode()
    monkeypatch.setattr(sentence_pieces, "spans", lambda *_: iter(spans))
    check(texts)


def test_rows_of_a_table(spark, docs_of):
    pairs = [(i % 7 if i % 5 else None, t) for i, t in enumerate(ODD + ODD[:4])]
    found = sentence_pieces.encode(docs_of(pairs), PATH, decoded=True)
    rows = sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in found.collect()), key=str)
    want = [LIBRARY.encode(t or "", add_bos=True, add_eos=True) for _, t in pairs]
    assert rows == sorted(((i, np.array(w, "<u4").tobytes(), LIBRARY.decode(w)) for (i, _), w in zip(pairs, want)), key=str)
    back = sentence_pieces.decode(found, PATH)
    assert sorted((r.text for r in back.collect()), key=str) == sorted((LIBRARY.decode(w) for w in want), key=str)
    assert sentence_pieces.encode(docs_of([]), PATH).collect() == []


def test_query_gives_the_digests(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op12_sentence_pieces"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_other_models_are_refused(monkeypatch):
    message = sentence_pieces._message
    monkeypatch.setattr(sentence_pieces, "_message", lambda raw: ((f, 1 if f == 3 and isinstance(v, int) else v) for f, v in message(raw)))  # as a unigram model
    with pytest.raises(ValueError):
        sentence_pieces.Model(PATH)
