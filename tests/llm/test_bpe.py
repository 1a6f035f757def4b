import base64
from pathlib import Path

import pytest
from helpers import awkward, frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import bpe

pytestmark = pytest.mark.skipif(not Path(bpe.DEFAULT_VOCABULARY).exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(bpe.DEFAULT_VOCABULARY).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_as_the_library_does_and_decodes(reference, text):
    content = bpe.content_of(bpe.DEFAULT_VOCABULARY)
    got, decodes = bpe.encode_texts([text], content)[0]
    assert got.tolist() == reference.encode_ordinary(text) and decodes
    assert bpe.decode_ids(got.tolist(), bpe.parsed(content)) == (text, None)


def test_documents_agree_with_the_library(spark, small, reference):
    rows = bpe.op1_bpe(spark, small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.decodes and r.n_tokens == len(r.tokens)
        assert r.tokens == reference.encode_ordinary(texts[r.doc_id])


def test_words_with_a_shared_prefix_and_the_merge_loop():
    v = bpe.load(bpe.DEFAULT_VOCABULARY)
    words = [w.encode() for w in ("token", "tokens", "tokenizer", "tokenizers", "to", "t", "zzzzzzzz", "aaaaaaaaaaaaaaaaaaaaaaa", "")]
    got = v.encode_words(words)
    for w in words:
        assert got[w] == [v.ranks[p] for p in v._merged(w)] if w else got[w] == []


def test_awkward_rows(spark):
    rows = bpe.bpe_encode(frame(spark, awkward())).collect()
    assert len(rows) == len(awkward())
    for r in rows:
        assert (r.tokens is None) == (r.n_tokens is None) == (r.decodes is None)
    assert sum(r.tokens is None for r in rows) == 3
    assert all(r.decodes for r in rows if r.tokens is not None)
    assert next(r for r in rows if r.doc_id == 3).tokens == []
    assert bpe.bpe_encode(frame(spark, [])).count() == 0


def test_round_trip_through_frames(spark):
    docs = frame(spark, [(1, prose(4)), (2, None), (3, "")])
    back = {r.doc_id: r.text for r in bpe.bpe_decode(bpe.bpe_encode(docs)).collect()}
    assert back == {1: prose(4), 2: None, 3: ""}


def test_ids_that_are_no_tokens_are_told(spark):
    rows = [(1, [10, None, 11]), (2, [10, 99_999_999]), (3, [-1]), (4, None), (5, []), (5, []), (None, [10])]
    got = sorted(map(tuple, bpe.bpe_decode(spark.createDataFrame(rows, "doc_id long, tokens array<int>")).collect()), key=str)
    ten = bpe.load(bpe.DEFAULT_VOCABULARY).bytes_of[10].decode()
    assert got == sorted([(1, None, "no token None at 1"), (2, None, "no token 99999999 at 1"), (3, None, "no token -1 at 0"), (4, None, None), (5, "", None), (5, "", None), (None, ten, None)], key=str)


def test_a_very_long_text(spark, reference):
    text = prose(9, 150_000) + " " + "x" * 50_000
    row = bpe.bpe_encode(frame(spark, [(1, text)])).first()
    assert row.decodes and row.tokens == reference.encode_ordinary(text)
