"""Chunking, coreference, knowledge, linking, validation, triples, evaluation, extraction."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.operators import chunking, coref, evaluation, extraction, recognition, knowledge, linking, triples, validation


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# -- chunking


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \né", max_size=120), st.integers(1, 30), st.data())
def test_pieces_hold_everything_within_bounds(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    got = chunking.pieces(text, size, overlap)
    covered = set()
    for lo, hi in got:
        assert 0 < hi - lo <= size and not text[lo].isspace() and not text[hi - 1].isspace()
        covered.update(range(lo, hi))
    assert [s for s, _ in got] == sorted({s for s, _ in got})
    assert all(c.isspace() or i in covered for i, c in enumerate(text))
    if not overlap:
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_pieces_end_at_the_best_border():
    text = "First paragraph here.\n\nSecond one is here. And more words follow it"
    assert [text[a:b] for a, b in chunking.pieces(text, 30)] == ["First paragraph here.", "Second one is here.", "And more words follow it"]
    with pytest.raises(ValueError):
        chunking.pieces("x", 5, 5)


def test_chunk_offsets_point_into_the_document(spark):
    long = "Étude number one. " * 900
    rows = chunking.chunk(docs(spark, long, "short é", "", None, "  ")).orderBy("doc_id", "chunk_id").collect()
    assert {r.doc_id for r in rows} == {0, 1}
    for r in rows:
        t = long if r.doc_id == 0 else "short é"
        assert t[r.start_char : r.end_char] == r.text and t.encode()[r.start_byte : r.end_byte].decode() == r.text
    assert len(rows) > 3 and all(len(r.text) <= chunking.SIZE for r in rows)


# -- coreference


def resolve(spark, text, **options):
    return [(r.pronoun, r.antecedent) for r in coref.antecedents(coref.mentions(docs(spark, text)), **options).orderBy("sentence", "ordinal").collect()]


def test_antecedents(spark):
    assert resolve(spark, "Marie Curie was a chemist. She met Pierre Curie. They married.") == [("She", "Marie Curie"), ("They", None)]
    assert resolve(spark, "Acme Corp makes anvils. It is old. The dogs ran. Bob saw them.") == [("It", "Acme Corp"), ("them", None)]
    assert resolve(spark, "Anna sang. One. Two. Three. She left.") == [("She", None)] or resolve(spark, "Anna sang. x. y. z. She left.") == [("She", None)]
    assert resolve(spark, "Anna sang. x. y. She left.") == [("She", "Anna")]
    assert resolve(spark, "Then she met Bob.", whole_sentence=True) == [("she", "Bob")]


def test_rewriting(spark):
    got = [r.resolved_text for r in coref.rewrite_pronouns(docs(spark, "Bob ate. Then he slept in his bed, the heap.", None, "", "no names: he")).orderBy("doc_id").collect()]
    assert got == ["Bob ate. Then Bob slept in Bob's bed, the heap.", None, "", "no names: he"]


def test_rewriting_and_relations_agree(spark):
    r = random.Random(5)
    words = "Anna Bob Acme Corp he she it they the ran saw, Paris (him) It. She. x. y. Dogs and".split()
    texts = [" ".join(r.choice(words) for _ in range(40)) + "." for _ in range(150)]
    rows = coref.antecedents(coref.mentions(docs(spark, *texts))).filter("antecedent IS NOT NULL").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sentence", "ordinal", "antecedent"))).alias("a")).collect()
    want = {x.doc_id: [a.antecedent for a in x.a] for x in rows}
    w = coref.Rewriter()
    for i, t in enumerate(texts):
        assert [n.removesuffix("'s") for _, _, n in w.spans(t)] == want.get(i, []), t


def test_very_long_and_odd_texts(spark):
    texts = ["Ab " * 60_000, "A" * 300_000, "He " * 30_000 + "Bob", "\u0001 Ab", ". . .", None, ""]
    assert coref.mentions(docs(spark, *texts)).count() == 1 + 0 + 30_001 + 1
    assert coref.antecedents(coref.mentions(docs(spark))).count() == 0


# -- knowledge

FOUND = [(1, 0, 5, "Bob", "Person"), (1, 0, 9, "Acme", "Organization"), (1, 1, 20, "BOB", "Place"), (1, 2, 30, "Carol", "Person"), (2, 0, 1, "Acme", None), (None, 0, 0, "x", "y"), (3, 0, 0, None, None)]


def found(spark):
    return spark.createDataFrame(FOUND, "doc_id long, chunk_id int, offset long, name string, type string")


def test_knowledge(spark):
    known = knowledge.first_wins(found(spark))
    assert {(r.doc_id, r.name, r.type, r.n_mentions) for r in known.filter("doc_id = 1").collect()} == {(1, "Bob", "Person", 2), (1, "Acme", "Organization", 1), (1, "Carol", "Person", 1)}
    assert {(r.type, r.name) for r in knowledge.last_of_type(known).filter("doc_id = 1").collect()} == {("Person", "Carol"), ("Organization", "Acme")}
    assert {(r.chunk_id, tuple(r.known)) for r in knowledge.prefix_state(found(spark)).filter("doc_id = 1").collect()} == {(0, ()), (1, ("acme", "bob")), (2, ("acme", "bob"))}
    alias = spark.createDataFrame([(1, 0, "Bob", "early"), (1, 1, "bob", "Bobby"), (1, 2, "Bob", "BOBBY"), (1, 2, "Bob", "the boss"), (1, 2, "Nobody", "x")], "doc_id long, chunk_id int, name string, alias string")
    lists = knowledge.aliases(alias, known)
    assert [tuple(r) for r in lists.collect()] == [(1, "bob", ["bobby", "the boss"])]
    assert knowledge.canonical_of_alias(spark.createDataFrame([(1, "BOBBY")], "doc_id long, name string"), lists).first().name_lc == "bob"
    props = knowledge.properties(spark.createDataFrame([(1, 0, "Bob", "age", "3"), (1, 2, "BOB", "age", "4"), (1, 0, "No", "age", "9")], "doc_id long, chunk_id int, name string, property string, value string"), known)
    assert [tuple(r) for r in props.collect()] == [(1, "bob", "age", "4")]
    text = knowledge.context_summary(known.filter("doc_id = 1"), lists, props).first().summary
    assert text.split("\n")[1:] == ["- Acme (Organization)", "- Bob (Person) [also called: bobby, the boss] [age: 4]", "- Carol (Person)"]
    assert [r.name_lc for r in knowledge.shared_entities(found(spark)).collect()] == ["acme"]


def test_no_task_gathers_the_rows_of_a_predicate(spark):
    gold = spark.sql("SELECT id AS doc_id, array(array(named_struct('name', concat('H', id))), array(named_struct('name', 'T'))) AS vertexSet, array(named_struct('h', 0, 't', 1, 'r', 'P17')) AS labels FROM range(50)")
    docs = spark.sql("SELECT id AS doc_id, concat('{\"@type\":\"X\",\"name\":\"N', id, '\",\"worksFor\":\"y\"}') AS jsonld FROM range(50)")
    for rows, p in ((triples.gold_triples(gold), "addresscountri"), (triples.basic_triples(docs), "worksfor")):
        assert rows.count() == 50 and {r.p for r in rows.collect()} == {p}
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "key#" not in "".join(x for x in plan.splitlines() if "Join" in x)


# -- linking


def labelled(spark, *labels):
    return spark.createDataFrame([(f"u{k}", x) for k, x in enumerate(labels)], "uri string, label string")


def named(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def test_blocked_and_nested_loop_agree(spark):
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abAB ") for _ in range(n))
    labels = labelled(spark, *(word(r.randint(0, 9)) for _ in range(200)), None)
    names = named(spark, *(word(r.randint(0, 5)) for _ in range(60)), None, "")
    rows = lambda df: sorted(map(str, df.select("name", "uri", "label").collect()))
    want = rows(linking.containing(names, labels))
    assert want and rows(linking.containing(names, labels)) == want


def test_containment_is_that_of_all_pairs_and_collects_no_side(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("aAé€1# ") for _ in range(n))
    labels, names = [word(r.randint(0, 12)) for _ in range(150)], sorted({word(r.randint(1, 7)) for _ in range(80)})
    held = linking.containing(named(spark, *names), labelled(spark, *labels))
    want = sorted((n, f"u{k}") for n in names for k, x in enumerate(labels) if n.lower() in x.lower())
    assert sorted((x.name, x.uri) for x in held.collect()) == want and want
    for df in (held, linking.link(named(spark, *names), labelled(spark, *labels))):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "BroadcastHashJoin [label_lc" not in plan and "BroadcastHashJoin [name" not in plan and "BroadcastHashJoin [gram" not in plan


def test_typos_are_those_of_all_pairs(spark):
    from plain_edits import edits

    r = random.Random(3)
    base = ["".join(r.choice("abc") for _ in range(r.randint(9, 14))) for _ in range(40)]

    def wrong(s):
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(s))
            s = r.choice([s[:k] + s[k + 1 :], s[:k] + r.choice("abc") + s[k:], s[:k] + r.choice("abc") + s[k + 1 :]])
        return s

    names = sorted({wrong(s) for s in base if len(s) > 11})
    got = {(x.name, x.label): x.edits for x in linking.typo_candidates(named(spark, *names), labelled(spark, *base)).collect()}
    want = {(n, b): edits(n, b) for n in names for b in base if len(n) >= 9 and edits(n, b) <= 2}
    assert got == want and want


def test_typos_of_numbered_names_are_not_compared_all_with_all(spark):
    from plain_edits import edits

    numbered = [f"Supplier#{k:09d}" for k in range(0, 3000, 7)]
    long = ["x" * 50 + f"{k:03d}" for k in range(40)]
    names = [*numbered[::40], *(n.replace("00000", "0000x") for n in numbered[::50]), "upplier#0000000070", "aé€ bcdefg hi", *long[::9]]
    labels = [*numbered, *(f"Customer#{k:09d}" for k in range(300)), "aé€ bcdefh", *long]
    found = linking.typo_candidates(named(spark, *names), labelled(spark, *labels))
    want = {(n, x): e for n in names for x in labels if abs(len(n) - len(x)) <= 2 and (e := edits(n.lower(), x.lower())) <= 2}
    assert {(x.name, x.label): x.edits for x in found.collect()} == want and found.count() == len(want)
    own, lab = linking._names(named(spark, *numbered)), linking._lower(labelled(spark, *numbered))
    pairs = linking._typos_by_places(own, lab, 2).count() + linking._typos_by_deletion(own, lab, 2).count()
    assert pairs < 0.2 * len(numbered) ** 2
    assert linking._near_starts(own, linking._lower(labelled(spark, *labels)), 2).filter("label_lc LIKE 'customer%'").count() == 0


def test_links(spark):
    labels = labelled(spark, "Apple Inc", "Apple", "Pineapple", "apple")
    got = {r.name: (r.uri, r.confidence) for r in linking.link(named(spark, "APPLE", "apple in", "zzz"), labels).collect()}
    assert got["APPLE"] == ("u1", 0.95) and got["apple in"][0] == "u0" and "zzz" not in got
    assert linking.link(named(spark, "APPLE"), labels, "none").count() == 0
    with pytest.raises(ValueError):
        linking.link(named(spark, "x"), labels, "other")
    pick = lambda c: c.groupBy("name").agg(F.max_by(F.struct("uri", "label", "confidence"), "uri").alias("x")).select("name", "x.*")
    assert linking.best_links(linking.exact_candidates(named(spark, "apple"), labels), choose=pick).first().uri == "u3"
    types = spark.createDataFrame([("u1", "A"), ("u1", "B")], "uri string, type string")
    assert {r.uri: r.types for r in linking.with_types(linking.exact_candidates(named(spark, "apple"), labels), types).collect()} == {"u1": ["A", "B"], "u3": []}


# -- validation


def test_validation(spark):
    c = {"@context": "https://schema.org"}
    rows = [{**c, "@type": "Person", "name": "A"}, {**c, "@type": "Person"}, {**c, "@type": "Person", "name": "A", "birthDate": "1.2.1990"}, {**c, "@type": "Organization", "name": None}, {**c, "name": "x"}, {**c, "@type": "Dataset", "@id": "urn:x", "birthDate": 5}, {**c, "@type": ["Person"]}]
    d = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)] + [(90, "junk"), (91, None)], "doc_id long, jsonld string")
    extra = [("all need a licence", None, ["license"], "warning")]
    found = validation.violations(d, validation.rule_frame(spark))
    got = {(r.doc_id, r.rule, r.property) for r in found.collect()}
    assert got == {(1, "Person needs a name", "name"), (2, "date form", "birthDate"), (3, "Organization needs a name", "name"), (4, "structure", "no_type"), (5, "date form", "birthDate"), (5, "url form", "@id"), (90, "structure", "not_json"), (91, "structure", "not_json")}
    v = {r.doc_id: (r.valid, r.confidence) for r in validation.verdicts(d, found).collect()}
    assert v[0] == (True, 1.0) and v[1] == (False, 0.8) and v[2] == (True, 0.95) and v[90] == (False, 0.5) and v[6] == (True, 1.0)
    assert validation.violations(d, validation.rule_frame(spark, extra, built_in=False)).filter("property = 'license'").count() == 6
    strict = validation.violations(spark.createDataFrame([(1, json.dumps({**c, "@type": "X", "birthDate": "2020-02-31"}))], "doc_id long, jsonld string"), validation.rule_frame(spark), validation.Settings(strict_dates=True))
    assert strict.count() == 1
    asked = validation.ask_violations(spark.createDataFrame([(0, True), (1, False)], "doc_id long, answer boolean"), "asks")
    assert [r.doc_id for r in asked.collect()] == [1]


def test_more_rules_on_triples(spark):
    t = spark.createDataFrame([(1, "a", "born", "x"), (1, "a", "born", "y"), (2, "b", "born", "x")], "doc_id long, s string, p string, o string")
    assert [r.doc_id for r in validation.cardinality_violations(t, "born", 1).collect()] == [1]
    types = spark.createDataFrame([(1, "a", "Person"), (2, "b", "Place")], "doc_id long, s string, type string")
    assert [r.doc_id for r in validation.direction_violations(t.dropDuplicates(["doc_id"]), types, {"born": "Person"}).collect()] == [2]


# -- triples and evaluation


def test_triples(spark):
    doc = {"@context": "c", "@type": "Person", "name": "Alan Bean", "birthDate": "1932-03-15", "age": 5, "_metadata": "m", "alumniOf": {"name": "UT Austin", "addressCountry": "US"}, "awards": ["x", {"name": "y"}, 3]}
    d = spark.createDataFrame([(1, json.dumps(doc)), (2, json.dumps({"@graph": [{"name": "A B", "knows": "C"}, {"knows": "D"}]})), (3, "junk"), (4, None), (5, "[]"), (6, "{}")], "doc_id long, jsonld string")
    got = {tuple(r) for r in triples.basic_triples(d).collect()}
    assert got == {(1, "alan_bean", "birthdat", "1932-03-15"), (1, "alan_bean", "alumniof", "UT Austin"), (2, "a_b", "know", "C"), (2, "unknown", "know", "D")}
    more = {tuple(r)[1:] for r in triples.document_triples(d).filter("doc_id = 1").collect()}
    assert more == {("alan_bean", "birthdat", "1932-03-15"), ("alan_bean", "alumniof", "UT Austin"), ("alan_bean", "addresscountri", "US"), ("alan_bean", "award", "x"), ("alan_bean", "award", "y")}


def test_gold_documents(spark):
    kind = "doc_id long, sents array<array<string>>, vertexSet array<array<struct<name:string,sent_id:int,pos:array<int>,type:string>>>, labels array<struct<h:int,t:int,r:string,evidence:array<int>>>"
    v = [[("Big Co.", 0, [0, 2], "ORG")], [("Rome", 1, [0, 1], "LOC"), ("Roma", 0, [1, 2], "LOC")]]
    d = spark.createDataFrame([(1, [["Big", "Co."], ["Rome", "is", "far"]], v, [(0, 1, "P159", [0]), (0, 9, "P159", [0]), (1, 0, "P999", [0])])], kind)
    assert [tuple(r) for r in triples.gold_triples(d).collect()] == [(1, "big_co.", "locat", "Rome")]
    assert triples.document_text(d).first().text == "Big Co.\n\nRome is far"
    assert tuple(triples.document_profile(d).first()) == (1, 2, 5, 2, 3, 2)


def test_evaluation(spark):
    kind = "doc_id long, s string, p string, o string"
    p = spark.createDataFrame([(1, "a", "b", "c"), (1, "a", "b", "c"), (1, "a", "b", "d"), (2, "x", "y", "z")], kind)
    g = spark.createDataFrame([(1, "a", "b", "c"), (1, "a", "b", "e"), (3, "q", "q", "q")], kind)
    rows = {r.doc_id: tuple(r)[1:] for r in evaluation.per_document(p, g).collect()}
    assert rows == {1: (1, 1, 1, 0.5, 0.5, 0.5), 2: (0, 1, 0, 0.0, 0.0, 0.0), 3: (0, 0, 1, 0.0, 0.0, 0.0)}
    scores = evaluation.per_document(p, g)
    assert tuple(evaluation.micro(scores).first())[:3] == (1, 2, 2)
    assert tuple(evaluation.macro(scores).first()) == (3, 0.166667, 0.166667, 0.166667)
    assert evaluation.macro(evaluation.per_document(p.limit(0), g.limit(0))).first().f1 == 0.0
    assert evaluation.samples(evaluation.flagged(p, g)).count() == 5


# -- extraction


class Scripted:
    def __init__(self, answers):
        self.answers = list(answers)
        self.asked = []

    def available(self):
        return True

    def answer(self, messages):
        self.asked.append(list(messages))
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a


GOOD = '{"@context": "c", "@type": "Person", "name": "A B"}'


def test_retries():
    p = Scripted(["no", '{"@context": "c"}', f"```json\n{GOOD}\n```"])
    doc, attempts, error, detail = extraction.extract_one(p, "text")
    assert (json.loads(doc)["name"], attempts, error, detail) == ("a_b", 3, None, None)
    assert extraction.HINTS["no_type"] in p.asked[2][-1][1]
    assert extraction.extract_one(Scripted(["x"] * 3), "t")[:3] == (None, 3, "not_json")
    assert extraction.extract_one(Scripted([extraction.TransportError("down"), GOOD]), "t") == (None, 1, "transport", "down")
    assert extraction.extract_one(Scripted(['{"x": 1}']), "t", extraction.Options(inject_context=True, strict=False))[1:] == (1, None, None)


def test_documents_are_extracted_chunk_by_chunk(spark):
    text = "Anna Smith was born in Berlin. " + "Nothing else is said here at all. " * 400
    rows = extraction.extract_documents(docs(spark, text, "Acme is located in Paris", None, "")).orderBy("doc_id", "chunk_id").collect()
    first = json.loads(rows[0].jsonld)
    assert first["name"] == "anna_smith" and first["birthPlace"]["name"] == "Berlin" and rows[0].attempts == 1
    assert {r.doc_id for r in rows} == {0, 1} and len(rows) > 3
    merged = {r.doc_id: json.loads(r.jsonld) for r in extraction.merge_chunks(extraction.extract_documents(docs(spark, text, "Acme is located in Paris"))).collect()}
    assert len(merged[0]["@graph"]) == len(rows) - 1 and merged[1]["location"]["name"] == "Paris"
    with_p = extraction.with_provenance(extraction.extract_documents(docs(spark, "Acme is located in Paris"))).first()
    assert json.loads(with_p.jsonld_with_provenance)["_provenance"]["textSpan"] == {"start": 0, "end": 24}


class Echo:
    def available(self):
        return True

    def answer(self, messages):
        told = messages[1][1]
        known = told.split("\n\n")[0] if told.startswith("Known") else "nothing"
        return json.dumps({"@context": "c", "@type": "T", "name": told.rsplit(" ", 1)[-1], "told": known})


def test_chunks_see_what_came_before(spark):
    c = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "z"), (1, 2, "c"), (2, 1, None)], "doc_id long, chunk_id int, text string")
    c = c.withColumn("text", F.concat(F.lit("of "), "text"))
    got = {(r.doc_id, r.chunk_id): json.loads(r.jsonld)["told"] for r in extraction.extract_with_context(c, Echo).collect()}
    assert got == {(1, 0): "nothing", (1, 1): "known_so_far_a", (1, 2): "known_so_far_a_b", (2, 0): "nothing"}  # as slugs, since normalising looks at every string


def test_recognised_entities_as_documents(spark):
    e = spark.createDataFrame([(1, "Bob", "person", 0.9, 5, 8), (1, "Rome", "city", 0.8, 1, 4), (1, "x", "event", 0.2, 0, 1), (2, "Acme", "company", 0.5, 0, 4)], "doc_id long, text string, type string, confidence double, start long, end long")
    got = {r.doc_id: json.loads(r.jsonld) for r in recognition.entities_to_documents(e).collect()}
    assert [n["name"] for n in got[1]["@graph"]] == ["Rome", "Bob"] and got[2]["@type"] == "Organization" and got[2]["@id"] == "entity_0"


# -- what is left


class Shouts:
    def __call__(self, text):
        if "fail" in text:
            raise OSError("down")
        return text.replace("he", "Bob")


def test_resolution_by_a_provider(spark):
    got = {r.doc_id: (r.resolved_text, r.n_replaced) for r in coref.resolve(docs(spark, "he ate", "plain", "fail he", None), "provider", Shouts).collect()}
    assert got == {0: ("Bob ate", 1), 1: ("plain", 0), 2: ("fail he", None), 3: (None, None)}
    assert coref.resolve(docs(spark, "he"), "none").first().resolved_text == "he"
    with pytest.raises(ValueError):
        coref.resolve(docs(spark, "x"), "other")


def test_lookups_in_what_is_known(spark):
    known = knowledge.first_wins(found(spark))
    names = spark.createDataFrame([(1, "bob"), (1, "nobody"), (2, "bob"), (2, "ACME")], "doc_id long, name string")
    assert sorted(map(tuple, knowledge.has_entity(names, known).collect())) == [(1, "bob"), (2, "ACME")]
    assert {(r.asked, r.name) for r in knowledge.entity_of(names, known).collect()} == {("bob", "Bob"), ("ACME", "Acme")}
    assert {(r.type, r.n) for r in knowledge.counts(known).filter("doc_id = 1").collect()} == {("Person", 2), ("Organization", 1), (None, 3)}
