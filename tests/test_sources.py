import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import evaluation, triples
from loomgraph.sources import loaders, rdf


def test_ntriples_round_trip(spark, tmp_path):
    lines = [
        '<http://x/a> <http://x/p> <http://x/b> .', '_:n1 <http://x/p> "plain" .', '<http://x/a> <http://x/q> "say \\"hi\\"\\n\\\\n done"@en .', '<http://x/a> <http://x/r> "5"^^<http://x/int> . # note',
        "# comment", "", "<http://x/a> <http://x/p> _:n2 .", "broken line", '<http://x/a> <http://x/s> "looks <http://x/y> ." .',
    ]
    (tmp_path / "in.nt").write_text("\n".join(lines))
    t = rdf.read_ntriples(spark, str(tmp_path / "in.nt"))
    got = {tuple(r) for r in t.collect()}
    assert got == {
        ("http://x/a", "http://x/p", "http://x/b", "iri", None, None), ("_:n1", "http://x/p", "plain", "literal", None, None), ("http://x/a", "http://x/q", 'say "hi"\n\\n done', "literal", "en", None),
        ("http://x/a", "http://x/r", "5", "literal", None, "http://x/int"), ("http://x/a", "http://x/p", "_:n2", "bnode", None, None), ("http://x/a", "http://x/s", "looks <http://x/y> .", "literal", None, None),
    }
    rdf.ntriples_lines(t).write.text(str(tmp_path / "out"))
    assert {tuple(r) for r in rdf.read_ntriples(spark, str(tmp_path / "out")).collect()} == got
    turtle = {r.value.split("\n")[0]: r.value for r in rdf.turtle_blocks(t).collect()}
    assert turtle["_:n1"] == '_:n1\n    <http://x/p> "plain" .' and turtle["<http://x/a>"].count(" ;\n") == 4


def test_labels_and_types(spark):
    t = spark.createDataFrame([("u", rdf.LABELS[0], "U"), ("u", rdf.LABELS[1], "U"), ("u", rdf.RDF_TYPE, "T"), ("_:b", rdf.LABELS[0], "B")], "s string, p string, o string")
    assert [tuple(r) for r in rdf.labels_of(t).collect()] == [("u", "U")] and [tuple(r) for r in rdf.types_of(t).collect()] == [("u", "T")]


def test_cases_and_gold_documents_in_full(spark, tmp_path):
    case = {"id": "c1", "raw_text": "Ada was born on 1815-12-10.", "expected_triples": [{"subject": "ada", "predicate": "birthdat", "object": "1815-12-10"}], "expected_jsonld": {"@context": "c", "@type": "Person", "name": "Ada", "birthDate": "1815-12-10"}}
    (tmp_path / "cases.json").write_text(json.dumps([case]))
    rows = loaders.cases(spark, str(tmp_path / "cases.json"))
    predicted = triples.basic_triples(rows.select(F.col("id").alias("doc_id"), F.to_json("expected_jsonld").alias("jsonld")))
    assert tuple(evaluation.micro(evaluation.per_document(predicted, loaders.case_triples(rows))).first()) == (1, 0, 0, 1.0, 1.0, 1.0)
    doc = {"id": "d1", "title": "T", "sents": [["Ada", "studied", "."]], "vertexSet": [[{"name": "Ada", "sent_id": 0, "pos": [0, 1], "type": "PER"}]], "labels": []}
    (tmp_path / "gold.json").write_text(json.dumps([doc]))
    gold = loaders.annotated_documents(spark, str(tmp_path / "gold.json"))
    assert gold.first().doc_id == "d1" and triples.gold_triples(gold).count() == 0
    (tmp_path / "text.txt").write_text("one\ntwo")
    assert loaders.text_files(spark, str(tmp_path / "text.txt")).first().text == "one\ntwo"


def test_settings():
    s = loaders.Settings.from_environment({"LOOMGRAPH_MAX_RETRIES": "5", "LOOMGRAPH_PROVENANCE": "true", "LOOMGRAPH_LINK_CONFIDENCE": "0.7", "LOOMGRAPH_KB_PATH": "/kb"})
    assert (s.max_retries, s.provenance, s.link_confidence, s.kb_path, s.coref_distance) == (5, True, 0.7, "/kb", 3)
    with pytest.raises(ValueError):
        loaders.Settings.from_environment({"LOOMGRAPH_PROVENANCE": "perhaps"})
    with pytest.raises(ValueError):
        loaders.Settings.from_environment({"LOOMGRAPH_MAX_RETRIES": "many"})
