"""Queries over the star schema as a knowledge base: documents in JSON-LD, triples, links, rules, knowledge, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonld as J
from ..functions import text as T
from ..operators import evaluation as E
from ..operators import extraction as X
from ..operators import knowledge as K
from ..operators import linking as L
from ..operators import pipeline
from ..operators import triples as R
from ..operators import validation as V
from ..sources import star
from ..sources.loaders import Settings
from ..sources.star import table
from . import sparql

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def values(pairs: dict[str, str]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in pairs.items())


# -- documents in JSON-LD ---------------------------------------------------------------------

_CUSTOMER_JSON = """to_json({'@context': 'https://schema.org', '@type': 'Organization', '@id': 'https://example.org/customer/' || c_custkey, 'name': c_name, 'areaServed': c_mktsegment,
  'location': {'@type': 'Country', 'name': n_name, 'containedInPlace': r_name}, 'knowsAbout': [c_mktsegment || ' goods', r_name || ' trade']})"""
_CUSTOMER_FROM = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def customer_documents(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, jsonld, name, nation): a document for each customer [PRJ3]."""
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    place = F.struct(F.lit("Country").alias("@type"), F.col("n_name").alias("name"), F.col("r_name").alias("containedInPlace"))
    doc = F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.lit("Organization").alias("@type"),
        F.concat(F.lit("https://example.org/customer/"), "c_custkey").alias("@id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("areaServed"),
        place.alias("location"),
        F.array(F.concat("c_mktsegment", F.lit(" goods")), F.concat("r_name", F.lit(" trade"))).alias("knowsAbout"),
    )
    return rows.select(F.col("c_custkey").alias("doc_id"), F.to_json(doc).alias("jsonld"), F.col("c_name").alias("name"), F.col("n_name").alias("nation"))


@query(f"SELECT c_custkey AS doc_id, CAST({_CUSTOMER_JSON} AS VARCHAR) AS jsonld FROM {_CUSTOMER_FROM}")
def jsonld_from_customers(spark: SparkSession, d: str) -> DataFrame:
    return customer_documents(spark, d).select("doc_id", "jsonld")


@query(f"SELECT c_custkey AS doc_id, 'Organization' AS type, c_name AS name, 'https://example.org/customer/' || c_custkey AS id, CAST(NULL AS VARCHAR) AS error FROM {_CUSTOMER_FROM}")
def jsonld_accessors(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    rows = customer_documents(spark, d).select("doc_id", "jsonld", F.try_parse_json("jsonld").alias("v"))
    return rows.select("doc_id", J.root_string(v, "@type").alias("type"), J.root_string(v, "name").alias("name"), J.root_string(v, "@id").alias("id"), J.structural_error(F.col("jsonld")).alias("error"))


@query(f"SELECT unnest([c_name, n_name]) AS name, count(*) AS n FROM {_CUSTOMER_FROM} GROUP BY 1")
def jsonld_entity_names(spark: SparkSession, d: str) -> DataFrame:
    return customer_documents(spark, d).select(F.explode(J.names(F.col("jsonld"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS doc_id, CAST(2 AS BIGINT) AS n_objects, CAST(1 AS BIGINT) AS n_arrays FROM customer")
def jsonld_counts(spark: SparkSession, d: str) -> DataFrame:
    return customer_documents(spark, d).select("doc_id", J.count_objects(F.col("jsonld")).alias("n_objects"), J.count_arrays(F.col("jsonld")).alias("n_arrays"))


@query(f"SELECT c_custkey AS doc_id, 'customer_' || regexp_extract(c_name, '\\d+') AS name, n_name AS place, CASE WHEN contains(r_name, ' ') THEN replace(lower(r_name), ' ', '_') ELSE r_name END AS region, lower(c_mktsegment) || '_goods' AS topic FROM {_CUSTOMER_FROM}")
def jsonld_normalized(spark: SparkSession, d: str) -> DataFrame:
    rows = customer_documents(spark, d).select("doc_id", F.try_parse_json(J.normalized(F.col("jsonld"))).alias("v"))
    return rows.select("doc_id", *(F.try_variant_get("v", f"$.{p}", "string").alias(a) for a, p in (("name", "name"), ("place", "location.name"), ("region", "location.containedInPlace"), ("topic", "knowsAbout[0]"))))


@query(f"SELECT c_custkey AS doc_id, 'https://example.org/customer/' || c_custkey AS id, 'https://example.org/nation/' || n_nationkey AS place_id FROM {_CUSTOMER_FROM}")
def jsonld_enriched(spark: SparkSession, d: str) -> DataFrame:
    """Nations in the documents get the URIs that linking finds; the key-based join replaces a look-up for each name [JOIN6]."""
    docs = customer_documents(spark, d)
    links = L.best_links(L.exact_candidates(docs.select(F.col("nation").alias("name")), star.labels(spark, d)))
    rows = docs.join(links.select(F.col("name").alias("nation"), "uri"), "nation", "left")
    new = J.enriched(F.col("jsonld"), F.create_map("nation", "uri"))
    rows = rows.select("doc_id", F.try_parse_json(new).alias("v"))
    return rows.select("doc_id", F.try_variant_get("v", "$['@id']", "string").alias("id"), F.try_variant_get("v", "$.location['@id']", "string").alias("place_id"))


_LINE_ROWS = "lineitem JOIN part ON l_partkey = p_partkey"


@query(
    f"""WITH x AS (SELECT l_orderkey AS doc_id, count(*) AS n, list({{'@type': 'Product', 'name': p_name}} ORDER BY l_linenumber, l_partkey) AS g FROM {_LINE_ROWS} GROUP BY 1)
SELECT doc_id, CASE WHEN n = 1 THEN '{{"@context":"https://schema.org","@type":"Product","name":"' || g[1].name || '"}}' ELSE '{{"@context":"https://schema.org","@graph":' || to_json(g) || '}}' END AS jsonld FROM x"""
)
def graph_merge(spark: SparkSession, d: str) -> DataFrame:
    """The documents of an order's lines, merged in their order [AGG19]."""
    doc = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Product").alias("@type"), F.col("p_name").alias("name"))
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return X.merge_chunks(rows.select(F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_partkey").alias("chunk_id"), F.to_json(doc).alias("jsonld")))


_BASIC = f"""SELECT c_custkey AS doc_id, 'customer_' || regexp_extract(c_name, '\\d+') AS s, unnest(['areaserv', 'locat']) AS p, unnest([c_mktsegment, n_name]) AS o FROM {_CUSTOMER_FROM}"""
_DOCUMENT = f"""SELECT c_custkey AS doc_id, replace(lower(c_name), ' ', '_') AS s, unnest(['areaserv', 'locat', 'containedinplac', 'knowsabout', 'knowsabout']) AS p,
  unnest([c_mktsegment, n_name, r_name, c_mktsegment || ' goods', r_name || ' trade']) AS o FROM {_CUSTOMER_FROM}"""


@query(_BASIC)
def jsonld_triples_basic(spark: SparkSession, d: str) -> DataFrame:
    return R.basic_triples(customer_documents(spark, d))


@query(_DOCUMENT)
def jsonld_triples_document(spark: SparkSession, d: str) -> DataFrame:
    return R.document_triples(customer_documents(spark, d))


@query("SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS total, count(*) AS n FROM events GROUP BY event_type")
def event_props_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count("*").alias("n"))


@query("SELECT event_id, props AS json FROM events")
def json_fence_extract(spark: SparkSession, d: str) -> DataFrame:
    """Answers that hold a document in a fence, in a sentence, or bare, by type of event [FN8]."""
    kind, props = F.col("event_type"), F.col("props")
    answer = F.when(kind == "click", F.concat(F.lit("Here:\n```json\n"), props, F.lit("\n```\nThat is all."))).when(kind == "view", F.concat(F.lit("The result is "), props, F.lit(" as asked."))).otherwise(F.concat(F.lit("  "), props, F.lit("\n")))
    return table(spark, d, "events").select("event_id", T.json_of_response(answer).alias("json"))


# -- names and predicates ---------------------------------------------------------------------


@query("SELECT DISTINCT name, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT p_name FROM part UNION ALL SELECT o_orderpriority FROM orders)")
def slug_names(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.col(c).alias("name")) for t, c in (("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name"), ("orders", "o_orderpriority"))]
    return reduce(DataFrame.unionByName, parts).distinct().select("name", T.slug(F.col("name")).alias("slug"))


_WORDS = {"HOUSEHOLD": "household", "MACHINERY": "machineri", "BUILDING": "build", "FURNITURE": "furnitur", "AUTOMOBILE": "automobil", "ECONOMY": "economi", "STANDARD": "standard", "PROMO": "promo", "SMALL": "small", "MEDIUM": "medium", "LARGE": "larg"}


@query(f"SELECT word, coalesce(stem, lower(word)) AS stem, count(*) AS n FROM (SELECT c_mktsegment AS word FROM customer UNION ALL SELECT p_type FROM part) LEFT JOIN (VALUES {values(_WORDS)}) v(w, stem) ON w = word GROUP BY ALL")
def predicate_stems(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "customer").select(F.col("c_mktsegment").alias("word")).unionByName(table(spark, d, "part").select(F.col("p_type").alias("word")))
    return words.groupBy("word").agg(F.count("*").alias("n")).select("word", T.predicate_stem(F.col("word")).alias("stem"), "n")


_RECOGNISED = {"Region": "LOCATION", "Country": "country", "Organization": "Company", "Product": "Product"}


@query(f"SELECT CASE t WHEN 'Region' THEN 'Place' WHEN 'Country' THEN 'Place' ELSE t END AS schema_type, count(*) AS n FROM (SELECT type AS t FROM ({star.SQL_LABELS})) GROUP BY 1")
def type_map(spark: SparkSession, d: str) -> DataFrame:
    found = F.element_at(F.create_map(*(F.lit(x) for kv in _RECOGNISED.items() for x in kv)), F.col("type"))
    return star.labels(spark, d).groupBy(T.schema_type(found).alias("schema_type")).agg(F.count("*").alias("n"))


_RELATIONS = ("P17", "P131", "P276", "P999", "P159")
_RELATION_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{p}' THEN '{r}'" for p, r in zip(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), _RELATIONS)) + " END"


@query(f"SELECT o_orderkey AS doc_id, prop AS property FROM orders JOIN (VALUES {values(T.RELATION_PROPERTIES)}) v(r, prop) ON r = {_RELATION_SQL}")
def property_map(spark: SparkSession, d: str) -> DataFrame:
    """Relations, named by the orders' priorities, as properties; one that the map lacks is dropped [PRJ12, JOIN13]."""
    props = spark.createDataFrame(list(T.RELATION_PROPERTIES.items()), "r string, property string")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(_RELATION_SQL).alias("r"))
    return rows.join(F.broadcast(props), "r").select("doc_id", "property")  # 18 rows


# -- linking ----------------------------------------------------------------------------------

_NAMES = "SELECT DISTINCT name FROM (SELECT p_name AS name FROM part UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part UNION ALL SELECT lower(n_name) FROM nation UNION ALL SELECT upper(r_name) FROM region UNION ALL SELECT s_name FROM supplier)"
_PAIRS = f"SELECT n.name, k.uri, k.label, lower(n.name) AS a, lower(k.label) AS b FROM ({_NAMES}) n JOIN ({star.SQL_LABELS}) k ON contains(lower(k.label), lower(n.name))"
_SCORED = f"SELECT name, uri, label, CASE WHEN a = b THEN 1.0 ELSE jaro_winkler_similarity(a, b) END AS confidence FROM ({_PAIRS})"
_FUZZY = f"SELECT * FROM ({_SCORED}) WHERE confidence >= 0.8"


def names(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    parts = [part.select(F.col("p_name").alias("name")), part.select(F.explode(F.split("p_name", " ")).alias("name")), table(spark, d, "nation").select(F.lower("n_name").alias("name")), table(spark, d, "region").select(F.upper("r_name").alias("name")), table(spark, d, "supplier").select(F.col("s_name").alias("name"))]
    return reduce(DataFrame.unionByName, parts).distinct()


@query(f"SELECT n.name, k.uri, k.label, CAST(0.95 AS DOUBLE) AS confidence FROM ({_NAMES}) n JOIN ({star.SQL_LABELS}) k ON lower(k.label) = lower(n.name)")
def link_exact(spark: SparkSession, d: str) -> DataFrame:
    return L.exact_candidates(names(spark, d), star.labels(spark, d))


@query(f"SELECT name, uri, label FROM ({_PAIRS})")
def link_fuzzy_contains(spark: SparkSession, d: str) -> DataFrame:
    return L.containing(names(spark, d), star.labels(spark, d)).select("name", "uri", "label")


@query(f"SELECT name, uri, label FROM ({_PAIRS}) WHERE length(name) >= 3")
def link_blocked(spark: SparkSession, d: str) -> DataFrame:
    return L.containing(names(spark, d).filter("length(name) >= 3"), star.labels(spark, d)).select("name", "uri", "label")


@query(f"SELECT name, uri, label, round(confidence, 6) AS confidence FROM ({_FUZZY})")
def link_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return L.fuzzy_candidates(names(spark, d), star.labels(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query(f"SELECT name, uri, label, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY confidence DESC, uri) AS k FROM ({_FUZZY})) WHERE k = 1")
def link_best(spark: SparkSession, d: str) -> DataFrame:
    return L.best_links(L.fuzzy_candidates(names(spark, d), star.labels(spark, d))).withColumn("confidence", F.round("confidence", 6))


@query(f"SELECT name, uri, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY confidence DESC, uri) AS k FROM ({_FUZZY})) WHERE k <= 10")
def link_top10(spark: SparkSession, d: str) -> DataFrame:
    return L.top_candidates(L.fuzzy_candidates(names(spark, d), star.labels(spark, d)), 10).select("name", "uri", "rank")


@query(f"SELECT name, count(*) AS n_candidates FROM ({_FUZZY}) GROUP BY name HAVING count(*) >= 2")
def ambiguous_names(spark: SparkSession, d: str) -> DataFrame:
    return L.ambiguous(L.fuzzy_candidates(names(spark, d), star.labels(spark, d)))


@query(
    f"""WITH m AS (SELECT DISTINCT name FROM (SELECT substr(p_name, 1, 3) || substr(p_name, 5) AS name FROM part UNION ALL SELECT replace(s_name, '00000', '0000x') FROM supplier) WHERE length(name) >= 9)
SELECT m.name, k.uri, k.label, CAST(levenshtein(lower(m.name), lower(k.label)) AS BIGINT) AS edits FROM m JOIN ({star.SQL_LABELS}) k ON levenshtein(lower(m.name), lower(k.label)) <= 2"""
)
def link_typos(spark: SparkSession, d: str) -> DataFrame:
    wrong = table(spark, d, "part").select(F.expr("substr(p_name, 1, 3) || substr(p_name, 5)").alias("name")).unionByName(table(spark, d, "supplier").select(F.expr("replace(s_name, '00000', '0000x')").alias("name")))
    return L.typo_candidates(wrong, star.labels(spark, d))


@query(f"SELECT count(DISTINCT f.name) AS n_linked, (SELECT count(*) FROM ({_NAMES})) AS n_names FROM ({_FUZZY}) f")
def link_rate(spark: SparkSession, d: str) -> DataFrame:
    own = names(spark, d)
    return L.link_rate(own, L.best_links(L.fuzzy_candidates(own, star.labels(spark, d))))


@query(f"SELECT n.name, k.uri, [k.type] AS types FROM ({_NAMES}) n JOIN ({star.SQL_LABELS}) k ON lower(k.label) = lower(n.name)")
def link_types(spark: SparkSession, d: str) -> DataFrame:
    labels = star.labels(spark, d)
    return L.with_types(L.exact_candidates(names(spark, d), labels), labels.select("uri", "type")).select("name", "uri", "types")


# -- validation -------------------------------------------------------------------------------

_DEFECTS = "o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'Person' WHEN 'O' THEN 'Organization' ELSE 'Dataset' END AS type, o_orderpriority <> '5-LOW' AS named, o_orderpriority <> '1-URGENT' AS dated, o_totalprice >= 50000 AS linked, o_totalprice < 490000 AS whole"


def order_documents(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, jsonld): a document for each order, with defects that follow from its columns."""
    x = table(spark, d, "orders").selectExpr("o_orderdate", *_DEFECTS.split(", "))
    doc = F.struct(
        F.when(F.col("whole"), "https://schema.org").alias("@context"),
        F.col("type").alias("@type"),
        F.concat(F.when(F.col("linked"), "https://example.org/order/").otherwise("urn:order:"), "doc_id").alias("@id"),
        F.when(F.col("named"), F.concat(F.lit("Order "), "doc_id")).alias("name"),
        F.when(F.col("dated"), F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("dateCreated"),
    )
    return x.select("doc_id", F.to_json(doc).alias("jsonld"))


_VIOLATIONS = f"""WITH x AS (SELECT {_DEFECTS} FROM orders),
v AS (SELECT doc_id, 'structure' AS rule, 'no_context' AS property, 'error' AS severity, -0.5 AS confidence_impact FROM x WHERE NOT whole
UNION ALL SELECT doc_id, type || ' needs a name', 'name', 'error', -0.2 FROM x WHERE whole AND NOT named AND type <> 'Dataset'
UNION ALL SELECT doc_id, 'date form', 'dateCreated', 'warning', -0.05 FROM x WHERE whole AND NOT dated
UNION ALL SELECT doc_id, 'url form', '@id', 'warning', -0.1 FROM x WHERE whole AND NOT linked)"""


@query(f"{_VIOLATIONS} SELECT doc_id, rule, property, severity, CAST(confidence_impact AS DOUBLE) AS confidence_impact FROM v")
def validate_violations(spark: SparkSession, d: str) -> DataFrame:
    return V.violations(order_documents(spark, d), V.rule_frame(spark))


@query(
    f"""{_VIOLATIONS}, g AS (SELECT x.doc_id, round(greatest(0.0, least(1.0, 1.0 + coalesce(sum(CAST(confidence_impact AS DOUBLE)), 0.0))), 6) AS confidence, count(*) FILTER (WHERE severity = 'error') AS n_errors, count(*) FILTER (WHERE severity = 'warning') AS n_warnings FROM x LEFT JOIN v ON v.doc_id = x.doc_id GROUP BY x.doc_id)
SELECT doc_id, n_errors = 0 AND confidence >= 0.7 AS valid, confidence, n_errors, n_warnings FROM g"""
)
def validate_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return V.validate(order_documents(spark, d), V.rule_frame(spark))


# -- SPARQL -----------------------------------------------------------------------------------


@query(f"SELECT k.uri AS x, k.label, CASE k.type WHEN 'Country' THEN 'https://example.org/region/' || n_regionkey END AS place FROM ({star.SQL_LABELS}) k LEFT JOIN nation ON k.uri = 'https://example.org/nation/' || n_nationkey WHERE k.type IN ('Country', 'Region')")
def sparql_optional_union(spark: SparkSession, d: str) -> DataFrame:
    return sparql.select(
        star.triples(spark, d),
        """SELECT ?x ?label ?place WHERE { { ?x a schema:Country } UNION { ?x a schema:Region } ?x rdfs:label ?label . OPTIONAL { ?x schema:containedInPlace ?place } }""",
    )


@query("SELECT s_name AS name, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(r_name), 'asia') OR n_name = 'NATION_1'")
def sparql_filter(spark: SparkSession, d: str) -> DataFrame:
    return sparql.select(
        star.triples(spark, d),
        """PREFIX s: <http://schema.org/> SELECT ?name ?nation WHERE { ?x a s:Organization ; rdfs:label ?name ; s:location ?n . ?n rdfs:label ?nation ; s:containedInPlace ?r . ?r rdfs:label ?region
           FILTER(STRSTARTS(?name, "Supplier") && (CONTAINS(LCASE(STR(?region)), "asia") || ?nation = "NATION_1")) }""",
    )


@query("SELECT label, n FROM (SELECT n_name AS label, count(*) OVER () AS n FROM nation ORDER BY n_name DESC LIMIT 5 OFFSET 2)")
def sparql_order_limit(spark: SparkSession, d: str) -> DataFrame:
    rows = sparql.select(star.triples(spark, d), "SELECT ?label WHERE { ?x a schema:Country ; rdfs:label ?label } ORDER BY DESC(?label) LIMIT 5 OFFSET 2")
    return rows.crossJoin(table(spark, d, "nation").agg(F.count("*").alias("n")))


@query("SELECT EXISTS (SELECT 1 FROM region WHERE r_name = 'ASIA') AS asia, EXISTS (SELECT 1 FROM region WHERE r_name = 'ATLANTIS') AS atlantis")
def sparql_ask(spark: SparkSession, d: str) -> DataFrame:
    t = star.triples(spark, d)
    answers = [sparql.ask(t, f'ASK {{ ?x a schema:Region ; rdfs:label "{n}" }}') for n in ("ASIA", "ATLANTIS")]
    return spark.createDataFrame([tuple(answers)], "asia boolean, atlantis boolean")


@query(f"SELECT c_custkey AS doc_id, r_name = 'ASIA' AND c_mktsegment <> 'BUILDING' AS answer FROM {_CUSTOMER_FROM}")
def sparql_ask_each(spark: SparkSession, d: str) -> DataFrame:
    """A question asked of each document's own triples [DOM16, Q27]."""
    docs = customer_documents(spark, d)
    return sparql.ask_each(R.document_triples(docs), docs, 'ASK { ?x <containedinplac> "ASIA" ; <areaserv> ?m FILTER(?m != "BUILDING") }')


# -- knowledge --------------------------------------------------------------------------------

_FOUND = f"SELECT l_orderkey AS doc_id, l_linenumber AS chunk_id, l_partkey AS offset_, p_name AS name, p_type AS type, p_brand, l_returnflag, lower(p_name) AS name_lc FROM {_LINE_ROWS}"
_KNOWN = f"SELECT doc_id, name_lc, name, type, chunk_id, offset_, n_mentions FROM (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY doc_id, name_lc) AS n_mentions FROM ({_FOUND}) WINDOW w AS (PARTITION BY doc_id, name_lc ORDER BY chunk_id, offset_, name, type)) WHERE k = 1"


def found(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents, their lines as chunks, and the parts on them as what is mentioned."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_id"), F.col("l_partkey").alias("offset"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), "p_brand", "l_returnflag")


@query(f'SELECT doc_id, name_lc, name, type, chunk_id, offset_ AS "offset", n_mentions FROM ({_KNOWN})')
def kb_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return K.first_wins(found(spark, d))


@query(f"SELECT doc_id, name_lc, 'returned' AS property, arg_max(l_returnflag, chunk_id * 1000 + ascii(l_returnflag)) AS value FROM ({_FOUND}) GROUP BY doc_id, name_lc")
def kb_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = found(spark, d)
    return K.properties(rows.select("doc_id", "chunk_id", "name", F.lit("returned").alias("property"), F.col("l_returnflag").alias("value")), K.first_wins(rows))


_ALIASES = f"SELECT doc_id, name_lc, list(alias ORDER BY since_, alias) AS aliases FROM (SELECT f.doc_id, f.name_lc, lower(f.p_brand) AS alias, min(f.chunk_id) AS since_ FROM ({_FOUND}) f JOIN ({_KNOWN}) k ON f.doc_id = k.doc_id AND f.name_lc = k.name_lc AND f.chunk_id > k.chunk_id GROUP BY 1, 2, 3) GROUP BY doc_id, name_lc"


@query(_ALIASES)
def kb_aliases(spark: SparkSession, d: str) -> DataFrame:
    rows = found(spark, d)
    return K.aliases(rows.select("doc_id", "chunk_id", "name", F.col("p_brand").alias("alias")), K.first_wins(rows))


@query(f"SELECT doc_id, type, arg_max(name, {{'c': chunk_id, 'o': offset_, 'n': name_lc}}) AS name FROM ({_KNOWN}) GROUP BY doc_id, type")
def kb_last_of_type(spark: SparkSession, d: str) -> DataFrame:
    return K.last_of_type(K.first_wins(found(spark, d)))


@query(f"SELECT c.doc_id, c.chunk_id, count(k.name_lc) AS n_known, coalesce(list(k.name_lc ORDER BY k.name_lc) FILTER (WHERE k.name_lc IS NOT NULL), []) AS known FROM (SELECT DISTINCT doc_id, chunk_id FROM ({_FOUND})) c LEFT JOIN ({_KNOWN}) k ON k.doc_id = c.doc_id AND k.chunk_id < c.chunk_id GROUP BY 1, 2")
def kb_prefix_state(spark: SparkSession, d: str) -> DataFrame:
    return K.prefix_state(found(spark, d))


@query(
    f"""WITH a AS ({_ALIASES}), x AS (SELECT k.doc_id, k.name_lc, '- ' || name || ' (' || type || ')' || CASE WHEN len(aliases) > 0 THEN ' [also called: ' || array_to_string(aliases, ', ') || ']' ELSE '' END AS line FROM ({_KNOWN}) k LEFT JOIN a ON a.doc_id = k.doc_id AND a.name_lc = k.name_lc)
SELECT doc_id, 'Entities known from earlier chunks:' || chr(10) || string_agg(line, chr(10) ORDER BY name_lc) AS summary FROM x GROUP BY doc_id"""
)
def kb_summary(spark: SparkSession, d: str) -> DataFrame:
    return K.summary_of(found(spark, d).withColumnRenamed("p_brand", "alias"))


@query(f"SELECT name_lc, count(DISTINCT doc_id) AS n_docs FROM ({_FOUND}) GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def shared_entities(spark: SparkSession, d: str) -> DataFrame:
    return K.shared_entities(found(spark, d))


# -- evaluation -------------------------------------------------------------------------------

_TRIPLES = f"SELECT DISTINCT l_orderkey AS doc_id, 'order_' || l_orderkey AS s, 'contain' AS p, p_name AS o FROM {_LINE_ROWS}"
_OUTCOMES = f"""WITH p AS ({_TRIPLES} WHERE l_returnflag <> 'R'), g AS ({_TRIPLES} WHERE l_linestatus = 'F'),
f AS (SELECT coalesce(p.doc_id, g.doc_id) AS doc_id, coalesce(p.s, g.s) AS s, coalesce(p.p, g.p) AS p, coalesce(p.o, g.o) AS o, CASE WHEN g.o IS NULL THEN 'fp' WHEN p.o IS NULL THEN 'fn' ELSE 'tp' END AS outcome
      FROM p FULL JOIN g ON p.doc_id = g.doc_id AND p.s = g.s AND p.p = g.p AND p.o = g.o),
n AS (SELECT doc_id, count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'fp') AS fp, count(*) FILTER (WHERE outcome = 'fn') AS fn FROM f GROUP BY doc_id)"""
_RATES = "round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1"


def predicted_and_gold(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What an order holds, as told by the lines that weren't returned, against the lines that are final."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    triple = [F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("order_"), "l_orderkey").alias("s"), F.lit("contain").alias("p"), F.col("p_name").alias("o")]
    return rows.filter("l_returnflag <> 'R'").select(*triple), rows.filter("l_linestatus = 'F'").select(*triple)


@query(f"{_OUTCOMES} SELECT doc_id, s, p, o, outcome FROM f")
def eval_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return E.flagged(*predicted_and_gold(spark, d))


@query(f"{_OUTCOMES} SELECT doc_id, tp, fp, fn, {_RATES} FROM n")
def eval_per_document(spark: SparkSession, d: str) -> DataFrame:
    return E.per_document(*predicted_and_gold(spark, d))


@query(f"{_OUTCOMES}, r AS (SELECT doc_id, {_RATES} FROM n) SELECT count(*) AS n_docs, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM r")
def eval_macro(spark: SparkSession, d: str) -> DataFrame:
    return E.macro(E.per_document(*predicted_and_gold(spark, d)))


@query(f"{_OUTCOMES}, t AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM n) SELECT tp, fp, fn, {_RATES} FROM t")
def eval_micro(spark: SparkSession, d: str) -> DataFrame:
    return E.micro(E.per_document(*predicted_and_gold(spark, d)))


@query(f"{_OUTCOMES}, r AS (SELECT {_RATES} FROM n) SELECT CASE WHEN f1 >= 0.9 THEN 'excellent' WHEN f1 >= 0.75 THEN 'good' WHEN f1 >= 0.6 THEN 'fair' ELSE 'needs improvement' END AS tier, count(*) AS n_docs FROM r GROUP BY 1")
def eval_tier(spark: SparkSession, d: str) -> DataFrame:
    return E.per_document(*predicted_and_gold(spark, d)).groupBy(E.tier(F.col("f1")).alias("tier")).agg(F.count("*").alias("n_docs"))


_PREDICATES = "CASE o_orderpriority WHEN '1-URGENT' THEN 'founder' WHEN '2-HIGH' THEN 'ceo' WHEN '3-MEDIUM' THEN 'alumni' WHEN '4-NOT SPECIFIED' THEN 'alumniof' ELSE 'locat' END"


@query(f"SELECT o_orderkey AS doc_id, {_PREDICATES} AS p FROM orders WHERE {_PREDICATES} IN ('alumniof', 'locat')")
def heuristic_filter(spark: SparkSession, d: str) -> DataFrame:
    return R.plausible(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(_PREDICATES).alias("p")))


# -- extraction -------------------------------------------------------------------------------


@query()
def extract_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document: pronouns resolved, chunked, each chunk extracted, with provenance."""
    rows = X.with_provenance(X.extract_documents(table(spark, d, "documents")))
    return rows.select("doc_id", "chunk_id", "start_char", "end_char", "attempts", "error", "jsonld_with_provenance")


@query()
def pipeline_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Extract, merge, link, validate: (doc_id, valid, confidence, n_errors, n_warnings, n_names, n_linked) [DOM19, DOM27]."""
    rows = pipeline.run(table(spark, d, "documents"), V.rule_frame(spark), Settings(linking="local"), star.labels(spark, d).select("uri", "label"))
    return rows.select("doc_id", "valid", "confidence", "n_errors", "n_warnings", "n_names", "n_linked")
