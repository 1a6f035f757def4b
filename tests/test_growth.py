"""What must not grow faster than the input: calls of a provider, what Python holds at once, sorts."""

import random

import pandas as pd
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import coref, extraction, harness, knowledge, pipeline, validation
from loomgraph.sources.loaders import Settings


def counting(path):
    class Counting(extraction.RuleProvider):
        def answer(self, messages):
            with open(path, "a") as f:
                f.write("x")
            return super().answer(messages)

    return Counting


def test_a_case_is_extracted_once(spark, tmp_path):
    cases = spark.sql("SELECT string(id) AS id, concat('Ann Lee', id, ' works for Big Co.') AS raw_text, array(named_struct('subject', concat('ann_lee', id), 'predicate', 'worksfor', 'object', 'Big Co')) AS expected_triples FROM range(6)")
    result = harness.evaluate_cases(cases, counting(tmp_path / "cases"))
    assert result.report().count() == 12 and result.scores.filter("tp = 1").count() == 6 and result.summary().first().n_docs == 6
    assert (tmp_path / "cases").read_text() == "x" * 6


def test_a_document_is_extracted_once(spark, tmp_path):
    docs = spark.sql("SELECT id AS doc_id, concat('Ann Lee', id, ' works for Big Co.') AS text FROM range(6)")
    labels = spark.createDataFrame([("u1", "Big Co")], "uri string, label string")
    rows = pipeline.run(docs, validation.rule_frame(spark), Settings(linking="local"), labels, counting(tmp_path / "docs"))
    assert rows.filter("n_linked = 1").count() == 6
    assert (tmp_path / "docs").read_text() == "x" * 6


def test_python_works_on_slices_of_a_batch(spark):
    s = pd.Series(["a" * 40, None, "b" * 70, "", "c" * 300, "d"])
    parts = list(T.slices(s, 100))
    assert pd.concat(parts).equals(s) and [len(p) for p in parts] == [2, 2, 1, 1]
    assert list(T.slices(pd.Series([], dtype=object))) == []
    docs = spark.createDataFrame([(k, None if k % 7 == 0 else f"Ann Lee went. He saw {'x' * 90_000}.") for k in range(20)], "doc_id long, text string")
    known = spark.createDataFrame([(k, 0, f'A "{k}"') for k in range(0, 20, 2)], "doc_id long, sentence int, entity string")
    got = {r.doc_id: r.resolved_text for r in coref.rewrite_guided(docs, known).collect()}
    assert all(got[k] is None if k % 7 == 0 else f'went. A "{k}" saw' in got[k] if k % 2 == 0 else "went. He saw" in got[k] for k in range(20))


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_antecedents_are_sorted_once_and_narrow(spark):
    found = spark.createDataFrame([(1, 0, 0, "Bo", None), (1, 0, 1, "he", "masculine"), (1, 4, 0, "she", "feminine"), (1, 3, 0, "him", "masculine"), (1, 3, 1, "Al", None), (1, 5, 0, "it", "neutral")], "doc_id long, sentence int, ordinal int, mention string, pronoun_type string")
    rows = coref.antecedents(found)
    assert {(r.sentence, r.antecedent) for r in rows.collect()} == {(0, "Bo"), (3, "Bo"), (4, "Al"), (5, None)}
    assert plan(rows).count("Sort [") == 1 and plan(rows).count("Window [") == 1


def test_simple_antecedents_need_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "“Ann”  went.\tShe_ and (Öde) x\xa0she HIM!\nIT's he"), (2, None), (3, " \n"), (4, "The they Bo them Bobs'   A b it")], "doc_id long, text string")
    rows = coref.simple_antecedents(docs)
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 2, "She", "feminine", "Ann"), (1, 6, "HIM", "masculine", "Öde"), (1, 8, "he", "masculine", "IT's")] + [(4, 1, "they", "plural", None), (4, 3, "them", "plural", None), (4, 7, "it", "neutral", "Bobs")]
    assert "Exchange" not in plan(rows)


def test_a_summary_reads_its_rows_once(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.randrange(3), r.randrange(4), r.randrange(9), r.choice(["Bob", "BOB", "Al", "Cy"]), r.choice(["Person", None]), r.choice(["x", "X", "y", None])) for _ in range(80)]
    spark.createDataFrame(rows, "doc_id long, chunk_id int, offset int, name string, type string, alias string").write.parquet(str(tmp_path / "found"))
    found = spark.read.parquet(str(tmp_path / "found"))
    known = knowledge.first_wins(found)
    want = knowledge.context_summary(known, knowledge.aliases(found.select("doc_id", "chunk_id", "name", "alias"), known))
    got = knowledge.summary_of(found)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and any("also called" in x.summary for x in got.collect())
    assert plan(got).count("FileScan") == 1 and "Join" not in plan(got)
