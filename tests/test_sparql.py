import pytest

from loomgraph.plans import sparql

ROWS = [
    ("a", "type", "Person"), ("a", "name", "Ann"), ("a", "age", "30"), ("a", "knows", "b"),
    ("b", "type", "Person"), ("b", "name", "Bob"), ("b", "born", "1990-05-01"), ("b", "knows", "b"),
    ("c", "type", "Place"), ("c", "name", "Coast \"x\""), ("c", "label", "coast"),
]


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame(ROWS, "s string, p string, o string").cache()


def rows(graph, query):
    return sorted((tuple(r) for r in sparql.select(graph, query).collect()), key=str)


def test_patterns_and_joins(graph):
    assert rows(graph, "SELECT ?n WHERE { ?x <type> <Person> ; <name> ?n . }") == [("Ann",), ("Bob",)]
    assert rows(graph, "SELECT ?x WHERE { ?x <knows> ?x }") == [("b",)]
    assert rows(graph, "SELECT ?n ?m WHERE { ?x <knows> ?y . ?x <name> ?n . ?y <name> ?m }") == [("Ann", "Bob"), ("Bob", "Bob")]
    assert rows(graph, 'SELECT ?x WHERE { ?x <name> "Coast \\"x\\"" }') == [("c",)]
    assert rows(graph, "SELECT DISTINCT ?t WHERE { ?x <type> ?t }") == [("Person",), ("Place",)]
    assert rows(graph, "SELECT * WHERE { <a> ?p ?o FILTER(?p = 'age') }") == [("30", "age")]
    assert rows(graph, "SELECT ?x ?y WHERE { ?x <age> ?n . ?y <label> ?l }") == [("a", "c")]


def test_optional_union_and_unbound(graph):
    assert rows(graph, "SELECT ?x ?a WHERE { ?x <type> <Person> OPTIONAL { ?x <age> ?a } }") == [("a", "30"), ("b", None)]
    assert rows(graph, "SELECT ?x ?a WHERE { ?x <type> <Person> OPTIONAL { ?x <age> ?a FILTER(?a > 40) } }") == [("a", None), ("b", None)]
    assert rows(graph, "SELECT ?x WHERE { ?x <type> <Person> OPTIONAL { ?x <age> ?a } FILTER(!BOUND(?a)) }") == [("b",)]
    assert rows(graph, "SELECT ?x ?n ?l WHERE { { ?x <name> ?n } UNION { ?x <label> ?l } }") == [("a", "Ann", None), ("b", "Bob", None), ("c", 'Coast "x"', None), ("c", None, "coast")]
    # an unbound variable goes with any value
    assert rows(graph, "SELECT ?x ?v WHERE { ?x <type> <Person> OPTIONAL { ?x <age> ?v } ?y <age> ?v }") == [("a", "30"), ("b", "30")]


def test_filters(graph):
    assert rows(graph, "SELECT ?x WHERE { ?x <age> ?a FILTER(?a >= 30 && ?a < 31.5 && ?a + 1 = 31) }") == [("a",)]
    assert rows(graph, "SELECT ?x WHERE { ?x <born> ?d FILTER(YEAR(?d) > 1989) }") == [("b",)]
    assert rows(graph, "SELECT ?x WHERE { ?x <name> ?n FILTER(REGEX(?n, '^a', 'i') || STRENDS(?n, 'ob')) }") == [("a",), ("b",)]
    assert rows(graph, "SELECT ?n WHERE { ?x <name> ?n FILTER(STRLEN(?n) = 3 && !CONTAINS(LCASE(?n), 'nn')) }") == [("Bob",)]


def test_order_limit_and_asking(graph, spark):
    assert [r.n for r in sparql.select(graph, "SELECT ?n WHERE { ?x <name> ?n } ORDER BY DESC(?n) LIMIT 2 OFFSET 1").collect()] == ["Bob", "Ann"]
    assert sparql.ask(graph, "ASK { ?x <knows> ?y . ?y <born> ?d }") and not sparql.ask(graph, "ASK { <a> <born> ?d }")
    docs = spark.createDataFrame([(1, "a", "p", "x"), (1, "x", "q", "z"), (2, "a", "p", "x"), (3, "x", "q", "z")], "doc_id long, s string, p string, o string")
    subjects = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "doc_id long")
    got = {r.doc_id: r.answer for r in sparql.ask_each(docs, subjects, "ASK { ?a <p> ?b . ?b <q> ?c }").collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_exists_minus_bind_and_values(graph):
    assert rows(graph, "SELECT ?x ?y WHERE { OPTIONAL { ?x <nothing> ?y } }") == [(None, None)]
    assert rows(graph, "SELECT ?x ?l WHERE { OPTIONAL { ?x <label> ?l } }") == [("c", "coast")]
    assert rows(graph, "SELECT ?x WHERE { ?x <name> ?n FILTER EXISTS { ?x <knows> ?y } }") == [("a",), ("b",)]
    assert rows(graph, "SELECT ?x WHERE { ?x <name> ?n FILTER NOT EXISTS { ?x <knows> ?y } }") == [("c",)]
    assert rows(graph, "SELECT ?x WHERE { ?x <name> ?n MINUS { ?x <type> <Place> } }") == [("a",), ("b",)]
    assert rows(graph, "SELECT ?x ?k WHERE { ?x <age> ?a BIND(?a + 1 AS ?k) FILTER(?k = 31) }")[0][0] == "a"
    assert rows(graph, "SELECT ?x ?n WHERE { VALUES ?x { <a> <c> } ?x <name> ?n }") == [("a", "Ann"), ("c", 'Coast "x"')]


def test_paths_and_groups(graph):
    assert rows(graph, "SELECT ?n WHERE { <a> <knows>/<name> ?n }") == [("Bob",)]
    assert rows(graph, "SELECT ?v WHERE { <c> (<name>|<label>) ?v }") == [('Coast "x"',), ("coast",)]
    assert rows(graph, "SELECT ?t (COUNT(?x) AS ?n) WHERE { ?x <type> ?t } GROUP BY ?t") == [("Person", 2), ("Place", 1)]


@pytest.mark.parametrize("query", ["", "SELECT WHERE { ?x ?y ?z }", "SELECT ?x { ?x <p> }", "SELECT ?x { ?x nope:p ?y }", "SELECT ?x { ?x <p> ?y FILTER(MAGIC(?y)) }", "DELETE { ?x ?y ?z }", "SELECT ?x { ?x <p> ?y } GROUP", "SELECT ?x { §", "ASK { ?x <p> ?y }"])
def test_what_is_outside_the_subset_is_an_error(graph, query):
    with pytest.raises(sparql.SparqlError):
        sparql.select(graph, query)
