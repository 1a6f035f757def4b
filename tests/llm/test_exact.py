import numpy as np
from helpers import EXTRA, awkward, frame, ids, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import exact


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=60), st.integers(0, 45))
def test_golomb_blocks_round_trip(values, k):
    v = np.sort(np.array(values, np.int64))
    if len(v) and (v.max() >> k) > 1_000_000:  # the quotients are in unary
        k = 25
    assert exact.golomb_decode(exact.golomb_encode(v, k)).tolist() == v.tolist()


def test_bitmaps_mark_what_occurs_twice():
    got = exact.duplicate_bits([np.array([1, 5, 5, 9]), np.array([2, 9]), np.array([], np.int64)])
    assert [g.tolist() for g in got] == [[False, True, True, True], [False, True], []]


def test_suspects_are_the_repeated_fingerprints(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(5)
    want = {r.f for r in docs.select(exact.fingerprint().alias("f")).groupBy("f").count().filter("count > 1").collect()}
    assert {r.f for r in exact.suspects(docs.select("doc_id", "text")).collect()} == want != set()


def test_op5_agrees_with_its_sql(spark, small, duck):
    assert sorted(map(tuple, exact.op5_exact(spark, small).collect())) == sorted(duck.execute(exact.OP5_SQL).fetchall())


def test_equal_fingerprints_of_unequal_texts_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact, "BITS", 3)
    rows = [(k, f"text {k}") for k in range(60)] + [(60, "text 7")]
    assert [tuple(r) for r in exact.exact_duplicates(frame(spark, rows)).collect()] == [(60, 7)]


def test_awkward_rows(spark):
    docs = frame(spark, awkward() + [(9, ""), (None, prose(2))])
    kept = exact.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.schema["a.b"].dataType == docs.schema["a.b"].dataType
    assert ids(kept) == [1, 2, 3, 4, 6, 7, 8, 8, None, None]
    gone = sorted(map(tuple, exact.exact_duplicates(docs).collect()), key=str)
    assert gone == sorted([(5, 1), (5, 1), (9, 3), (None, None)], key=str)
    assert exact.exact_dedup(frame(spark, [])).count() == 0
    row = kept.filter("doc_id = 1").first()
    assert [row[c] for c in EXTRA] == [c if k % 2 else None for k, c in enumerate(EXTRA)]


def test_repeated_rows_of_the_kept_document(spark):
    """Rows with the id that is kept are listed but for one, and of those that differ elsewhere the first as JSON stays."""
    rows = [(1, "same", "b"), (1, "same", "a"), (2, "same", "c"), (None, "same", "d"), (3, "own", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string")
    assert sorted(map(tuple, exact.exact_duplicates(docs).collect()), key=str) == [(1, 1), (2, 1), (None, 1)]
    assert sorted(map(tuple, exact.exact_dedup(docs).collect())) == [(1, "same", "a"), (3, "own", None)]


def test_very_long_texts_are_compared_whole(spark):
    long = prose(3, 60_000)
    rows = [(1, long), (2, long + "!"), (3, long)]
    assert [tuple(r) for r in exact.exact_duplicates(frame(spark, rows)).collect()] == [(3, 1)]


def test_thousands_of_copies(spark):
    rows = [(k, "the same text") for k in range(3000)] + [(5000, "another")]
    assert ids(exact.exact_dedup(frame(spark, rows))) == [0, 5000]
