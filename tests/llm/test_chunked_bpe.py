"""Operator 11 against the tokenizers library."""

from __future__ import annotations

import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from forecourt.llm import chunked_bpe
from forecourt.llm.chunked_bpe import LONGEST, SHORTEST, ChunkedBpe, cut_places
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
AWKWARD = [*map(chr, range(1, 0x180)), *"'''sstrevmlld   \n" * 20, *["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "̱h", "H̱", "İ", "Σ", "ẞ", "\U0001f600", "中文", " ", "　", "'re", "'ll"] * 5]
SCHEMA = "doc_id long, text string, ids string, n_tokens int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    return ChunkedBpe(PATH)


def same(library, bpe, texts):
    for text, packed in zip(texts, bpe.encode(texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == ids, repr(text[:200])
        assert bpe.decode(packed) == library.decode(ids, skip_special_tokens=False)


@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=["Cs"])) | st.text("abc'sl 1\n", max_size=3000), max_size=4))
@settings(max_examples=60, deadline=None)
def test_any_texts(texts):
    same(Tokenizer.from_file(PATH), chunked_bpe.coder(PATH), texts)


def test_awkward_characters(library, bpe):
    r = random.Random(7)
    same(library, bpe, ["".join(r.choice(AWKWARD) for _ in range(r.choice([3, 30, 200, 1500]))) for _ in range(300)])
    same(library, bpe, [f"x{chr(a)}'sy {chr(a)}1{chr(a)}'ll" for a in range(1, 0x300)])


def test_words_longer_than_chunks(library, bpe):
    same(library, bpe, ["a" * n + tail for n in (LONGEST - 1, LONGEST, 5 * LONGEST, 40_000) for tail in ("", " b", "'s", "!")] + ["!" * 3000 + "'s " + "b" * 3000, " " * 5000, " " * 5000 + "x"])


def test_chunks_are_cut_by_content():
    r = random.Random(5)
    passage = "".join(r.choice("abcdefgh ") for _ in range(8000))
    chunks = lambda text: [text[a:b] for a, b in zip([0, *cut_places(text)], cut_places(text))]
    one, two = chunks("some head " + passage + " tail"), chunks("another, longer beginning of the text; " + passage)
    assert "".join(one) == "some head " + passage + " tail"
    assert all(SHORTEST <= len(c) <= LONGEST for c in one[:-1])
    assert len(set(one) & set(two)) >= len(one) - 4


def test_cuts_do_not_depend_on_blocks(monkeypatch):
    r = random.Random(6)
    text = "".join(r.choice("abcdefgh ") for _ in range(9000))
    whole = cut_places(text)
    for block in (7, 100, 1000):
        monkeypatch.setattr(chunked_bpe, "BLOCK", block)
        assert cut_places(text) == whole


def test_shared_chunks_are_encoded_once(bpe, monkeypatch):
    r = random.Random(8)
    passage = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(2000))
    fresh = ChunkedBpe(PATH)
    cut = []
    plain = fresh.cut
    monkeypatch.setattr(fresh, "cut", lambda text: cut.append(len(text)) or plain(text))
    fresh.encode(["first one " + passage])
    first = sum(cut)
    cut.clear()
    fresh.encode(["second text, " + passage, passage + " end"])
    assert sum(cut) < 0.35 * first  # windows at the joins and the ends, instead of both texts


def test_results_do_not_depend_on_what_is_kept(library, monkeypatch):
    monkeypatch.setattr(chunked_bpe, "MOST_CHUNKS", 3)
    monkeypatch.setattr(chunked_bpe, "MOST_WORDS", 5)
    r = random.Random(9)
    texts = [" ".join(r.choice(["alpha", "beta's", "gam ma", "1234"]) for _ in range(400)) for _ in range(6)]
    same(library, ChunkedBpe(PATH), texts + texts)


def test_documents(spark, library):
    rows = [(1, "It's a <|endoftext|> test  of THE\ncode", "clash", 1), (2, None, None, None), (3, "", "", 0), (None, "null id", "x", 2), (4, " \n\t", "x", 2), (5, "same " * 500, "x", 2), (5, "same " * 500, "x", 2), (6, "wörter über alles " * 20_000, "x", 2)]
    got = chunked_bpe.encode_documents(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert chunked_bpe.encode_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    with_ids = chunked_bpe.encode_documents(spark.createDataFrame(rows[:1], SCHEMA), with_ids=True).first()
    assert with_ids.ids == library.encode(rows[0][1], add_special_tokens=False).ids and with_ids.decoded == library.decode(with_ids.ids, skip_special_tokens=False)


def test_query_over_the_whole_table(spark, data, library):
    from forecourt.llm.queries import op11_chunked_bpe

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in op11_chunked_bpe(spark, data).collect()}
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert (got[doc_id].n_tokens, got[doc_id].ids_sha256) == (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest())
