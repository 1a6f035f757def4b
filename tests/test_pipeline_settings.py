import json

import pytest

from loomgraph.functions import jsonld as J
from loomgraph.operators import coref, extraction, harness, linking, pipeline, recognition, validation
from loomgraph.sources import loaders, sinks

TEXT = "Ada Byron was born in London. Ada Byron works for Analytical Society. Acme Corp was founded by Ada Byron."


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_relations_of_several_subjects_make_a_graph():
    doc = json.loads(extraction.unwrapped(extraction.RuleProvider().answer([("user", TEXT)])))
    ada, acme = doc["@graph"]
    assert ada["birthPlace"] == {"@type": "Place", "name": "London"} and ada["worksFor"]["name"] == "Analytical Society"
    assert acme == {"@type": "Organization", "name": "Acme Corp", "foundedBy": {"@type": "Person", "name": "Ada Byron"}}


@pytest.mark.parametrize("relation", extraction.RELATIONS, ids=lambda r: r[0])
def test_every_relation_is_found(relation):
    p, kind, of, between, _, _ = relation
    text = f"Maria Sol {between[0]} {'1867-11-07' if of is None else 'New Haven'}."
    doc = json.loads(extraction.unwrapped(extraction.RuleProvider().answer([("user", text)])))
    nodes = doc.get("@graph", [doc])
    assert any(n["name"] == "Maria Sol" and n.get(p) in ("1867-11-07", {"@type": of, "name": "New Haven"}) for n in nodes)


class Stubborn:
    """Answers badly until it is told what was wrong."""

    def __init__(self):
        self.told = []

    def available(self):
        return True

    def answer(self, messages):
        self.told = [t for role, t in messages if role == "user"][1:]
        return ["{broken", '["a list"]', '{"@context": "https://schema.org", "@type": "Person", "name": "Ada"}'][min(2, len(self.told))]


def test_retries_carry_the_error_in_its_own_words():
    p = Stubborn()
    doc, attempts, error, detail = extraction.extract_one(p, "x")
    assert (attempts, error, detail) == (3, None, None) and json.loads(doc)["name"] == "ada"
    assert "not_json" in p.told[0] and "line 1 column 2" in p.told[0] and "found list" in p.told[1]
    _, attempts, error, detail = extraction.extract_one(Stubborn(), "x", extraction.Options(max_retries=0))
    assert (attempts, error) == (1, "not_json") and "column" in detail


def test_settings_reach_the_operators(spark):
    d, rules = docs(spark, TEXT, None, ""), validation.rule_frame(spark)
    labels = spark.createDataFrame([("urn:london", "London"), ("urn:londonderry", "Londonderry")], "uri string, label string")
    plain = pipeline.run(d, rules).collect()
    assert [r.doc_id for r in plain] == [0] and plain[0].n_linked == 0 and "_provenance" not in plain[0].jsonld
    s = loaders.Settings(linking="exact", provenance=True, inject_context=False)
    linked = pipeline.run(d, rules, s, labels).first()
    assert linked.n_linked == 1 and "urn:london" in linked.jsonld and json.loads(linked.jsonld)["@context"] == "https://schema.org"
    assert json.loads(plain[0].jsonld)["@context"] == J.CONTEXT
    assert '"_provenance"' in linked.jsonld
    assert pipeline.documents(d, loaders.Settings(chunk_threshold=0, chunk_size=40)).first().jsonld != plain[0].jsonld
    with pytest.raises(ValueError):
        pipeline.run(d, rules, loaders.Settings(linking="exact"))
    with pytest.raises(ValueError):
        pipeline.run(d, rules, loaders.Settings(linking="by magic"), labels)


def test_settings_from_session_environment_and_file(spark, tmp_path):
    spark.conf.set("spark.loomgraph.linking", "local")
    spark.conf.set("spark.loomgraph.max_retries", "7")
    try:
        s = loaders.Settings.from_session(spark)
        assert (s.linking, s.max_retries, s.provenance) == ("local", 7, False)
    finally:
        spark.conf.unset("spark.loomgraph.linking")
        spark.conf.unset("spark.loomgraph.max_retries")
    f = tmp_path / ".env"
    f.write_text('# settings\nexport LOOMGRAPH_PROVENANCE=true\nLOOMGRAPH_KB_PATH="/kb"\n\n')
    s = loaders.Settings.from_environment(loaders.env_file(str(f)))
    assert s.provenance and s.kb_path == "/kb" and loaders.env_file(str(tmp_path / "none")) == {}


def test_linking_strategies_are_a_registry(spark):
    names = spark.createDataFrame([("London",)], "name string")
    labels = spark.createDataFrame([("urn:london", "London")], "uri string, label string")
    assert linking.link(names, labels, "none").count() == 0 == linking.link(names, labels, "wikidata").count()
    linking.STRATEGIES["shouted"] = lambda n, given: linking.exact_candidates(n, given.labels)
    try:
        assert linking.link(names, labels, "shouted").first().uri == "urn:london"
    finally:
        del linking.STRATEGIES["shouted"]
    with pytest.raises(ValueError):
        linking.link(names, labels, "remote")


def test_documents_that_are_no_json_stay(spark):
    d = spark.createDataFrame([(1, "not json"), (2, None), (3, '{"name": "London"}')], "doc_id long, jsonld string")
    labels = spark.createDataFrame([("urn:london", "London")], "uri string, label string")
    got = {r.doc_id: (r.jsonld, r.n_names, r.n_linked) for r in linking.link_documents(d, labels, "exact").collect()}
    assert got == {1: ("not json", 0, 0), 2: (None, 0, 0), 3: ('{"name":"London","@id":"urn:london"}', 1, 1)}


class Failing:
    def available(self):
        return True

    def answer(self, messages):
        return "nothing" if "bad" in messages[1][1] else '{"@context": "https://schema.org", "@type": "Person", "name": "Ada", "knows": "Bob"}'


def test_failed_cases_are_left_out_of_the_scores(spark):
    t = "array<struct<subject:string,predicate:string,object:string>>"
    cases = spark.createDataFrame([("good", "x", [("ada", "know", "Bob")]), ("bad", "bad", [("a", "b", "c")]), ("none", None, None)], f"id string, raw_text string, expected_triples {t}")
    r = harness.evaluate_cases(cases, Failing)
    assert [(x.doc_id, x.f1, x.tier) for x in r.scores.collect()] == [("good", 1.0, "excellent")]
    assert [(x.doc_id, x.error) for x in r.failed.collect()] == [("bad", "not_json")]
    assert r.summary().first().asDict() == {"n_docs": 1, "precision": 1.0, "recall": 1.0, "f1": 1.0, "n_failed": 1}
    assert "bad: failed (not_json)" in [x.line for x in r.report().collect()]


def test_recognisers(spark):
    d = docs(spark, "Smith Corp met Ada Byron on 2020-01-02.", None, "nothing here")
    got = {(r.text, r.type) for r in recognition.recognise(d, recognition.RuleRecogniser).collect()}
    assert got == {("Smith Corp", "Organization"), ("Ada Byron", "Person"), ("2020-01-02", "Date")}
    only = recognition.RecogniserSettings(types=("Person",), confidence=0.7)
    assert recognition.recognise(d, recognition.RuleRecogniser, only).count() == 0
    with pytest.raises(recognition.ConfigurationError):
        recognition.Absent()
    graph = {r.doc_id: json.loads(r.jsonld) for r in recognition.entities_to_documents(recognition.recognise(d, recognition.RuleRecogniser), d).collect()}
    assert graph[2]["@graph"] == [] and graph[0]["_extractionMetadata"]["entityCount"] == 3


def test_guided_rewrite(spark):
    d = docs(spark, "It rained. Ada came. She saw his hat.", None)
    e = spark.createDataFrame([(0, 1, "Ada"), (5, 0, "Bob")], "doc_id long, sentence int, entity string")
    assert {r.doc_id: (r.resolved_text, r.n_replaced) for r in coref.rewrite_guided(d, e).collect()} == {0: ("It rained. Ada came. Ada saw Ada's hat.", 2), 1: (None, None)}


def test_nodes_of_one_name_are_merged():
    parts = [{"@context": "c", "@type": "Person", "name": "Ada", "birthDate": "1815"}, {"@context": "d", "@graph": [{"@type": "Person", "name": "ADA", "birthDate": "1816", "knows": "Bob"}, {"@type": "Place", "name": "Ada"}]}]
    got = J.merge_documents(parts, once=True)
    assert got == {"@context": "c", "@graph": [{"@type": "Person", "name": "Ada", "birthDate": "1815", "knows": "Bob"}, {"@type": "Place", "name": "Ada"}]}
    told_apart = [{"@context": "c", "@type": "P", "name": "A", "@id": "1"}, {"@context": "c", "@type": "P", "name": "A", "@id": "2"}]
    assert len(J.merge_documents(told_apart, once=True)["@graph"]) == 2


def test_files_of_documents(spark, tmp_path):
    d = spark.createDataFrame([(1, '{"a":1}'), (2, None), (3, '{"b":"é"}')], "doc_id long, jsonld string")
    sinks.write_jsonld(d, str(tmp_path / "lines"))
    assert {r.jsonld for r in sinks.read_jsonld(spark, str(tmp_path / "lines")).collect()} == {'{"a":1}', '{"b":"é"}'}
    sinks.write_documents(d, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 3


def test_rules_are_few(spark):
    many = validation.rule_frame(spark, [(f"r{k}", None, ["name"], "error") for k in range(validation.MOST_RULES)])
    with pytest.raises(ValueError):
        validation.validate(spark.createDataFrame([(1, "{}")], "doc_id long, jsonld string"), many)
