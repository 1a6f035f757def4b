import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import jsonld as J
from loomgraph.functions import text as T
from loomgraph.functions.stem import stem


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("name, want", [("Alan Bean", "alan_bean"), ("MIT", "mit"), ("José García", "jose_garcia"), ("Björk Guðmundsdóttir", "bjork_gudmundsdottir"), ("AT&T Corporation", "at_t_corporation"), ("O'Reilly Media", "o_reilly_media"), ("Straße Æon", "strasse_aeon"), ("--", ""), (None, None)])
def test_slugs(spark, name, want):
    assert one(spark, name, T.slug) == want
    assert name is None or J.slug_text(name) == want


STEMS = {
    "running": "run", "runs": "run", "ran": "ran", "serving": "serv", "served": "serv", "graduated": "graduat", "birthdate": "birthdat", "almamater": "almamat", "cityserved": "cityserv", "alumniof": "alumniof",
    "location": "locat", "birthplace": "birthplac", "nationality": "nation", "caresses": "caress", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "agreed": "agre", "hopping": "hop", "hoping": "hope",
    "luxuriated": "luxuri", "happy": "happi", "say": "say", "by": "by", "generously": "generous", "skies": "sky", "dying": "die", "news": "news", "inning": "inning", "relational": "relat", "vietnamization": "vietnam", "hopefulness": "hope",
    "knightly": "knight", "national": "nation", "formalize": "formal", "electricity": "electr", "hopeful": "hope", "adjustment": "adjust", "adoption": "adopt", "effective": "effect", "consist": "consist", "consolingly": "consol", "knots": "knot",
}


@pytest.mark.parametrize("word", STEMS)
def test_stems(word):
    assert stem(word) == STEMS[word]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcde '", max_size=12), st.text(alphabet="abcde '", max_size=12))
def test_similarity_is_that_of_the_database(a, b):
    want = duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
    assert abs(T.jaro_winkler(a, b) - want) < 1e-9 or not a or not b


def test_pronouns_and_names(spark):
    assert [one(spark, w, T.pronoun_type) for w in ("He", "(her)", "its,", "THEM", "the", "", "hero")] == ["masculine", "feminine", "neutral", "plural", None, None, None]
    assert [one(spark, w, T.starts_name) for w in ("John", "IBM", "the", "É", "Ab")] == [True, False, False, False, True]
    assert [one(spark, w, T.continues_name) for w in ("Smith", "O'brien", "McDonald", "B", "b")] == [True, True, False, True, False]


def test_sizes(spark):
    assert one(spark, "é" * 6, T.token_estimate) == 3
    assert [one(spark, "a" * n, lambda x: T.chunk_estimate(x, 100, 20)) for n in (5, 100, 200)] == [1, 1, 3]
    with pytest.raises(ValueError):
        T.chunk_estimate(F.lit("x"), 10, 10)


def test_answers(spark):
    assert one(spark, 'x\n```json\n{"a": 1}\n```\nend', T.json_of_response) == '{"a": 1}'
    assert one(spark, 'so {"a": {"b": 1}} it is', T.json_of_response) == '{"a": {"b": 1}}'
    assert one(spark, " plain \n", T.json_of_response) == "plain"


def test_small_ones(spark):
    assert one(spark, "birthDatePlace", T.split_camel_case) == ["birth", "date", "place"]
    assert one(spark, " a, ,b ", T.csv_list) == ["a", "b"]
    assert [one(spark, d, T.is_date_shaped) for d in ("2020-01-31", "xxxx-yy-zz", "2020-1-31")] == [True, True, False]
    assert [one(spark, d, T.is_iso_date) for d in ("2020-01-31", "2020-02-31", "xxxx-yy-zz")] == [True, False, False]
    assert [one(spark, k, T.schema_type) for k in ("Company", "CITY", "person", "Widget")] == ["Organization", "Place", "Person", "Widget"]
    assert one(spark, "Apple Inc.", T.lowered_subject) == "apple_inc."


def test_documents_in_json(spark):
    doc = {"@context": "c", "@type": "Person", "name": "Alan Bean", "birthDate": "1932-03-15", "nationality": "United States", "alumniOf": {"name": "UT Austin", "x": [{"name": "B"}, 1]}}
    n = J.normalize_document(doc)
    assert n["name"] == "alan_bean" and n["birthDate"] == "1932-03-15" and n["nationality"] == "united_states" and n["alumniOf"]["name"] == "UT Austin"
    assert J.entity_names(doc) == ["Alan Bean", "B", "UT Austin"]
    assert J.enrich(doc, {"UT Austin": "u", "B": "b"})["alumniOf"] == {"name": "UT Austin", "x": [{"name": "B"}, 1], "@id": "u"}
    assert J.merge_documents([]) == {} and J.merge_documents([doc]) == doc
    assert J.merge_documents([doc, None, {"@graph": [{"name": "Z", "@context": "d"}]}])["@graph"][1] == {"name": "Z"}
    deep = "[" * 400 + "]" * 400
    rows = spark.createDataFrame([(J.dump(doc),), ("nope",), (None,), ("[1]",), ('{"a": 1}',), ('{"@context": null, "@type": "x"}',), ('{"@context": 1}',), (deep,)], "x string")
    got = [r.e for r in rows.select(J.structural_error(F.col("x")).alias("e")).collect()]
    assert got == [None, "not_json", "not_json", "not_object", "no_context", "no_context", "no_type", "not_object"]
    assert [r.y for r in rows.select(J.names(F.col("x")).alias("y")).collect()][:3] == [["Alan Bean", "B", "UT Austin"], None, None]
    assert one(spark, '{"a": 1}', lambda x: J.with_root(x, "@id", F.lit("u"))) == '{"a":1,"@id":"u"}'


def test_stemming_is_stable_on_random_words():
    r = random.Random(1)
    for _ in range(3000):
        w = "".join(r.choice("abcdeilnorstyug'") for _ in range(r.randint(1, 14)))
        assert len(stem(w)) <= len(w) + 1
