from helpers import awkward, frame, ids, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import quality


def brute(text, least):
    """Covered characters and the longest repeat, by comparing all pairs of positions."""
    n, covered, longest = len(text), set(), 0
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and text[i + k] == text[j + k]:
                k += 1
            if k >= least:
                longest = max(longest, k)
                covered.update(range(i, i + k))
                covered.update(range(j, j + k))
    return len(covered), longest


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abé", max_size=40), st.integers(1, 6))
def test_measures_are_those_of_brute_force(text, least):
    assert quality.repetition(text, least) == brute(text, least)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab", max_size=25)), max_size=6), st.integers(2, 6))
def test_the_quick_test_misses_nothing(texts, least):
    assert quality.has_repeats(texts, least).tolist() == [bool(t) and brute(t, least) != (0, 0) for t in texts]


def test_op2_against_brute_force_on_small_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("length(text) < 700")
    got = {r.doc_id: r for r in quality.repetition_measures(docs).collect()}
    for r in docs.collect():
        assert (got[r.doc_id].covered_chars, got[r.doc_id].longest_repeat) == brute(r.text, quality.MIN_REPEAT)
    kept = set(ids(quality.op2_quality(spark, small)))
    assert kept >= {i for i, r in got.items() if r.covered_fraction <= quality.MAX_COVERED and r.longest_repeat <= quality.MAX_LONGEST}


def test_repetitive_texts_go_and_clean_ones_stay(spark):
    rows = [(1, prose(1)), (2, "buy now and save a lot of money today! " * 40), (3, prose(5, 400) + " " + prose(5, 400)), (4, "short"), (5, "")]
    assert ids(quality.repetition_filter(frame(spark, rows))) == [1, 4, 5]


def test_awkward_rows(spark):
    docs = frame(spark, awkward())
    kept = quality.repetition_filter(docs)
    assert kept.columns == docs.columns
    assert ids(kept) == [1, 3, 4, 5, 5, 6, 7, 8, None]
    m = quality.repetition_measures(docs).collect()
    assert len(m) == len(awkward()) and sum(r.n_chars is None for r in m) == 3
    assert quality.repetition_filter(frame(spark, [])).count() == 0


def test_a_very_long_repetition(spark):
    assert quality.repetition("a" * 200_000, 30) == (200_000, 199_999)
