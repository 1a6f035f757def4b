"""Queries over cases that are made from the star schema: gold annotations, extraction, linking of documents, RDF out and in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonld as J
from ..functions import text as T
from ..operators import annotation as A
from ..operators import chunking, coref, harness, pipeline
from ..operators import evaluation as E
from ..operators import extraction as X
from ..operators import knowledge as K
from ..operators import linking as L
from ..operators import recognition as N
from ..operators import triples as R
from ..operators import validation as V
from ..sources import rdf, star
from ..sources.loaders import Settings
from ..sources.star import table
from . import sparql
from . import text_queries as TQ
from .graph_queries import _CUSTOMER_FROM, _CUSTOMER_JSON, _DEFECTS, _FOUND, _FUZZY, _KNOWN, _LINE_ROWS, _OUTCOMES, _VIOLATIONS, customer_documents, found, names, order_documents, predicted_and_gold, values

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- gold annotations: an order is a document, its lines are sentences, it and its parts are entities -----

_STATUS = {"1-URGENT": "P17", "2-HIGH": "P131", "3-MEDIUM": "P276", "4-NOT SPECIFIED": "P999", "5-LOW": "P108"}
_STEMS = {"P17": "addresscountri", "P131": "containedinplac", "P276": "locat", "P108": "worksfor"}
_CODE = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items()) + " END"
_LINES = f"SELECT l_orderkey AS doc_id, o_orderpriority, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM {_LINE_ROWS} JOIN orders ON l_orderkey = o_orderkey"


def annotated_orders(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, sents, vertexSet, labels): the order is entity 0 in sentence 0, the part of line k entity k in sentence k - 1; a last label points nowhere."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name")))
    g = rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(lines.alias("lines")).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(_CODE).alias("r")), "doc_id")
    entity = lambda name, at: F.array(F.struct(name.alias("name"), at.cast("int").alias("sent_id"), F.array(F.lit(0), F.lit(1)).alias("pos"), F.lit("ORG").alias("type")))
    order = entity(F.concat(F.lit("Order "), F.col("doc_id").cast("string")), F.lit(0))
    label = lambda t: F.struct(F.lit(0).alias("h"), t.cast("int").alias("t"), F.col("r").alias("r"), F.array().cast("array<int>").alias("evidence"))
    return g.select(
        "doc_id",
        F.transform("lines", lambda x: F.split(x["p_name"], " ")).alias("sents"),
        F.concat(F.array(order), F.transform("lines", lambda x, i: entity(x["p_name"], i))).alias("vertexSet"),
        F.concat(F.transform("lines", lambda x, i: label(i + 1)), F.array(label(F.lit(99)))).alias("labels"),
    )


@query(f"SELECT DISTINCT doc_id, 'order_' || doc_id AS s, stem AS p, p_name AS o FROM ({_LINES}) JOIN (VALUES {values(_STEMS)}) v(r, stem) ON r = {_CODE}")
def gold_triples(spark: SparkSession, d: str) -> DataFrame:
    """[DOM23, JOIN12, PRJ14, LIM4]"""
    return R.gold_triples(annotated_orders(spark, d))


@query(f"""SELECT doc_id, CAST(count(*) AS INTEGER) AS n_sentences, CAST(sum(len(string_split(p_name, ' '))) AS INTEGER) AS n_tokens, CAST(count(*) + 1 AS INTEGER) AS n_entities, CAST(count(*) + 1 AS INTEGER) AS n_relations,
  CAST(count(*) FILTER (WHERE k > 1) AS INTEGER) AS n_cross_sentence FROM ({_LINES}) GROUP BY doc_id""")
def document_profile(spark: SparkSession, d: str) -> DataFrame:
    """[AGG22, AGG23]"""
    return R.document_profile(annotated_orders(spark, d))


@query(f"SELECT doc_id, string_agg(p_name, chr(10) || chr(10) ORDER BY k) AS text FROM ({_LINES}) GROUP BY doc_id")
def document_text(spark: SparkSession, d: str) -> DataFrame:
    """[PRJ13]"""
    return R.document_text(annotated_orders(spark, d))


# -- knowledge ----------------------------------------------------------------------------------


@query(f"SELECT doc_id, type, count(*) AS n FROM ({_KNOWN}) GROUP BY doc_id, type UNION ALL SELECT doc_id, NULL, count(*) FROM ({_KNOWN}) GROUP BY doc_id")
def kb_counts(spark: SparkSession, d: str) -> DataFrame:
    """[AGG4, AGG5]"""
    return K.counts(K.first_wins(found(spark, d)))


_ASKED = "SELECT o_orderkey AS doc_id, upper(p_name) AS name FROM orders JOIN part ON p_partkey = 1 + o_orderkey % 5 UNION ALL SELECT l_orderkey, upper(p_name) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 2"


def asked(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (1 + F.col("o_orderkey") % 5).alias("p_partkey")).join(table(spark, d, "part"), "p_partkey")
    b = table(spark, d, "lineitem").filter("l_linenumber = 2").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("p_partkey")).join(table(spark, d, "part"), "p_partkey")
    return a.unionByName(b).select("doc_id", F.upper("p_name").alias("name"))


@query(f"SELECT doc_id, name FROM ({_ASKED}) a WHERE EXISTS (SELECT 1 FROM ({_FOUND}) f WHERE f.doc_id = a.doc_id AND f.name_lc = lower(a.name))")
def kb_has_entity(spark: SparkSession, d: str) -> DataFrame:
    """[FLT22]"""
    return K.has_entity(asked(spark, d), K.first_wins(found(spark, d)))


@query(f'SELECT a.doc_id, a.name AS asked, k.name, k.type, k.chunk_id, k.offset_ AS "offset" FROM (SELECT DISTINCT * FROM ({_ASKED})) a JOIN ({_KNOWN}) k ON k.doc_id = a.doc_id AND k.name_lc = lower(a.name)')
def kb_entity_of(spark: SparkSession, d: str) -> DataFrame:
    """[JOIN17]"""
    return K.entity_of(asked(spark, d), K.first_wins(found(spark, d)))


@query(f"""WITH a AS (SELECT f.doc_id, f.name_lc, lower(f.p_brand) AS alias FROM ({_FOUND}) f JOIN ({_KNOWN}) k ON f.doc_id = k.doc_id AND f.name_lc = k.name_lc AND f.chunk_id > k.chunk_id)
SELECT doc_id, alias, min(name_lc) AS name_lc FROM a WHERE (doc_id, alias) IN (SELECT l_orderkey, lower(p_brand) FROM {_LINE_ROWS} WHERE l_returnflag = 'N') GROUP BY 1, 2""")
def kb_canonical_alias(spark: SparkSession, d: str) -> DataFrame:
    """[JOIN16]"""
    rows = found(spark, d)
    lists = K.aliases(rows.select("doc_id", "chunk_id", "name", F.col("p_brand").alias("alias")), K.first_wins(rows))
    return K.canonical_of_alias(rows.filter("l_returnflag = 'N'").select("doc_id", F.col("p_brand").alias("name")), lists)


# -- RDF ----------------------------------------------------------------------------------------

_LABEL, _TYPE = "http://www.w3.org/2000/01/rdf-schema#label", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_TRIPLES = f"""SELECT uri AS s, '{_LABEL}' AS p, label AS o, 'literal' AS o_kind FROM ({star.SQL_LABELS}) UNION ALL SELECT uri, '{_TYPE}', 'http://schema.org/' || type, 'iri' FROM ({star.SQL_LABELS})
UNION ALL SELECT '{star.BASE}nation/' || n_nationkey, 'http://schema.org/containedInPlace', '{star.BASE}region/' || n_regionkey, 'iri' FROM nation
UNION ALL SELECT '{star.BASE}supplier/' || s_suppkey, 'http://schema.org/location', '{star.BASE}nation/' || s_nationkey, 'iri' FROM supplier
UNION ALL SELECT '{star.BASE}customer/' || c_custkey, 'http://schema.org/location', '{star.BASE}nation/' || c_nationkey, 'iri' FROM customer"""
_TERM = "CASE o_kind WHEN 'iri' THEN '<' || o || '>' ELSE '\"' || o || '\"' END"


def quoted_triples(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return star.triples(spark, d).select("s", "p", "o", "o_kind", none.alias("o_lang"), none.alias("o_datatype"))


@query(f"SELECT '<' || s || '> <' || p || '> ' || {_TERM} || ' .' AS value FROM ({_TRIPLES})")
def ntriples_out(spark: SparkSession, d: str) -> DataFrame:
    return rdf.ntriples_lines(quoted_triples(spark, d))


@query(f"SELECT s, p, o || CASE o_kind WHEN 'literal' THEN ' \"x\" \\' ELSE '' END AS o, o_kind, CASE o_kind WHEN 'literal' THEN 'en' END AS o_lang, CAST(NULL AS VARCHAR) AS o_datatype FROM ({_TRIPLES})")
def ntriples_in(spark: SparkSession, d: str) -> DataFrame:
    """Lines with escapes and a language, written and read again [SRC8]."""
    rows = quoted_triples(spark, d)
    own = F.col("o_kind") == "literal"
    rows = rows.withColumn("o", F.when(own, F.concat("o", F.lit(' "x" \\'))).otherwise(F.col("o"))).withColumn("o_lang", F.when(own, "en"))
    return rdf.parse_ntriples(rdf.ntriples_lines(rows))


@query(f"SELECT DISTINCT uri, label FROM ({star.SQL_LABELS})")
def rdf_labels(spark: SparkSession, d: str) -> DataFrame:
    """[FLT12, SET3]"""
    return rdf.labels_of(rdf.parse_ntriples(rdf.ntriples_lines(quoted_triples(spark, d)).unionByName(spark.createDataFrame([(f'_:b1 <{_LABEL}> "no iri" .',)], "value string"))))


@query(f"SELECT '<' || s || '>' || chr(10) || '    ' || string_agg(DISTINCT '<' || p || '> ' || {_TERM}, ' ;' || chr(10) || '    ' ORDER BY '<' || p || '> ' || {_TERM}) || ' .' AS value FROM ({_TRIPLES}) GROUP BY s")
def turtle_out(spark: SparkSession, d: str) -> DataFrame:
    return rdf.turtle_blocks(quoted_triples(spark, d))


# -- functions ----------------------------------------------------------------------------------


@query("""SELECT DISTINCT w AS word, list_transform(list_filter(string_split(regexp_replace(w, '([A-Z])', '|\\1', 'g'), '|'), lambda x: x <> ''), lambda x: lower(x)) AS words FROM (SELECT lower(o_orderstatus) || 'Order' || substr(o_orderpriority, 3, 1) || 'Of' || lower(substr(o_orderpriority, 3)) AS w FROM orders)""")
def camel_words(spark: SparkSession, d: str) -> DataFrame:
    """[FN3]"""
    w = F.expr("lower(o_orderstatus) || 'Order' || substr(o_orderpriority, 3, 1) || 'Of' || lower(substr(o_orderpriority, 3))")
    return table(spark, d, "orders").select(w.alias("word")).distinct().select("word", T.split_camel_case(F.col("word")).alias("words"))


@query("SELECT p_partkey, [trim(p_type), p_brand, 'x'] AS parts FROM part")
def csv_lists(spark: SparkSession, d: str) -> DataFrame:
    """[FN17]"""
    return table(spark, d, "part").select("p_partkey", T.csv_list(F.concat("p_type", F.lit(" , "), "p_brand", F.lit(", ,, x ,"))).alias("parts"))


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_totalprice > 100000 THEN 'https://example.org/new/' || o_orderkey WHEN o_totalprice >= 50000 THEN 'https://example.org/order/' || o_orderkey ELSE 'urn:order:' || o_orderkey END AS id FROM orders")
def root_upsert(spark: SparkSession, d: str) -> DataFrame:
    """[PRJ4]"""
    price = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_totalprice") > 100000, F.concat(F.lit("https://example.org/new/"), "o_orderkey")).alias("uri"))
    rows = order_documents(spark, d).join(price, "doc_id")
    return rows.select("doc_id", F.try_variant_get(F.try_parse_json(J.with_root(F.col("jsonld"), "@id", F.col("uri"))), "$['@id']", "string").alias("id"))


@query(f"SELECT {_DEFECTS.split(',')[0]}, 'https://schema.org/' AS vocabulary, CASE WHEN o_orderpriority <> '5-LOW' THEN 'Order ' || o_orderkey END AS name FROM orders")
def context_injected(spark: SparkSession, d: str) -> DataFrame:
    """[PRJ5, SRC5]"""
    v = order_documents(spark, d).select("doc_id", J.parsed_with_context(F.col("jsonld")).alias("v"))
    return v.select("doc_id", F.try_variant_get("v", "$['@context']['@vocab']", "string").alias("vocabulary"), J.root_string(F.col("v"), "name").alias("name"))


@query("SELECT s_suppkey AS doc_id, '{\"@context\":\"https://schema.org\",\"@type\":\"Organization\",\"name\":\"' || s_name || '\"' || CASE WHEN s_acctbal > 0 THEN ',\"identifier\":\"' || s_suppkey || '\"' ELSE '' END || '}' AS jsonld FROM supplier")
def jsonld_built(spark: SparkSession, d: str) -> DataFrame:
    """[PRJ3]"""
    own = F.when(F.col("s_acctbal") > 0, F.col("s_suppkey").cast("string"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), J.built("Organization", {"name": F.col("s_name"), "identifier": own}).alias("jsonld"))


@query(f"""WITH j AS (SELECT c_custkey AS doc_id, CAST({_CUSTOMER_JSON} AS VARCHAR) AS j FROM {_CUSTOMER_FROM})
SELECT doc_id, substr(j, 1, length(j) - 1) || ',"_provenance":{{"textSpan":{{"start":0,"end":' || length(j) || '}},"confidence":1.0,"chunkId":0,"method":"rules"}}}}' AS jsonld_with_provenance FROM j""")
def provenance_json(spark: SparkSession, d: str) -> DataFrame:
    """[PRJ6, SNK2]"""
    rows = customer_documents(spark, d).select("doc_id", "jsonld", F.lit(0).alias("chunk_id"), F.lit(0).cast("long").alias("start_char"), F.length("jsonld").cast("long").alias("end_char"))
    return X.with_provenance(rows).select("doc_id", "jsonld_with_provenance")


@query(f"SELECT l_orderkey AS doc_id, count(DISTINCT lower(p_name)) AS n_nodes FROM {_LINE_ROWS} GROUP BY 1")
def graph_merge_once(spark: SparkSession, d: str) -> DataFrame:
    """Lines' documents merged, each product once, whatever its letters' case."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    name = F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    chunks = rows.select(F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_partkey").alias("chunk_id"), J.built("Product", {"name": name}).alias("jsonld"))
    merged = X.merge_chunks(chunks, once=True).select("doc_id", F.try_parse_json("jsonld").alias("v"))
    return merged.select("doc_id", F.coalesce(F.size(F.try_variant_get("v", "$['@graph']", "array<variant>")), F.lit(1)).cast("long").alias("n_nodes"))


# -- validation ---------------------------------------------------------------------------------


@query(f"{_VIOLATIONS} SELECT doc_id, rule, property, severity, CAST(confidence_impact AS DOUBLE) AS confidence_impact FROM v UNION ALL SELECT doc_id, 'described', 'description', 'warning', -0.2 FROM x WHERE whole UNION ALL SELECT doc_id, 'people have dates', 'dateCreated', 'error', -0.2 FROM x WHERE FALSE")
def rules_added(spark: SparkSession, d: str) -> DataFrame:
    """[SET6, EXT3]"""
    extra = [("described", None, ["description"], "warning"), ("people have dates", "Person", ["dateCreated"], "error")]
    return V.violations(order_documents(spark, d), V.rule_frame(spark, extra))


@query(f"SELECT c_custkey AS doc_id, 'asian' AS rule, CAST(NULL AS VARCHAR) AS property, 'warning' AS severity, CAST(-0.15 AS DOUBLE) AS confidence_impact FROM {_CUSTOMER_FROM} WHERE r_name <> 'ASIA'")
def ask_rule(spark: SparkSession, d: str) -> DataFrame:
    """[DOM16, EXT4]"""
    docs = customer_documents(spark, d)
    return V.ask_violations(sparql.ask_each(R.document_triples(docs), docs, 'ASK { ?x <containedinplac> "ASIA" }'), "asian")


_CONTAINS = f"SELECT DISTINCT l_orderkey AS doc_id, 'order_' || l_orderkey AS s, p_name AS o, p_type FROM {_LINE_ROWS}"


def order_triples(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("order_"), "l_orderkey").alias("s"), F.lit("contain").alias("p"), F.col("p_name").alias("o"), "p_type")


@query(f"SELECT doc_id, 'cardinality' AS rule, 'contain' AS property, 'warning' AS severity, CAST(-0.2 AS DOUBLE) AS confidence_impact FROM ({_CONTAINS}) GROUP BY doc_id, s HAVING count(DISTINCT o) > 3")
def cardinality_rule(spark: SparkSession, d: str) -> DataFrame:
    return V.cardinality_violations(order_triples(spark, d), "contain", 3)


@query("SELECT l_orderkey AS doc_id, 'direction' AS rule, 'contain' AS property, 'warning' AS severity, CAST(-0.05 AS DOUBLE) AS confidence_impact FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'P'")
def direction_rule(spark: SparkSession, d: str) -> DataFrame:
    types = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("order_"), "o_orderkey").alias("s"), F.when(F.col("o_orderstatus") == "P", "Place").otherwise("Order").alias("type"))
    return V.direction_violations(order_triples(spark, d), types, {"contain": "Order"})


# -- linking ------------------------------------------------------------------------------------


@query(f"""SELECT c_custkey AS doc_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'https://example.org/customer/' || c_custkey ELSE '{star.BASE}customer/' || c_custkey END AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN '{star.BASE}nation/' || c_nationkey END AS place_id,
  CAST(2 AS BIGINT) AS n_names, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 2 END AS BIGINT) AS n_linked FROM customer""")
def linked_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose objects get the @ids that linking finds; customers of one segment aren't in the knowledge base. Below an object that is linked nothing is looked at [DOM10, JOIN5, JOIN6, PRJ9]."""
    known = table(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'").select(star.uri("customer", "c_custkey").alias("uri"), F.col("c_name").alias("label"))
    nations = star.labels(spark, d).filter("type = 'Country'").select("uri", "label")
    rows = L.link_documents(customer_documents(spark, d).select("doc_id", "jsonld"), known.unionByName(nations), strategy="exact")
    v = F.try_parse_json("jsonld")
    return rows.select("doc_id", F.try_variant_get(v, "$['@id']", "string").alias("id"), F.try_variant_get(v, "$.location['@id']", "string").alias("place_id"), "n_names", "n_linked")


_REMOTE_TEXT = "c_name || ' of ' || n_name"


def remote_annotations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(text, name) and annotations as a service would give them: the nation twice, and the customer with too small a score."""
    rows = customer_documents(spark, d).join(table(spark, d, "nation"), F.col("nation") == F.col("n_name")).withColumn("text", F.concat("name", F.lit(" of "), "nation"))
    one = lambda uri, form, score: F.struct(uri.alias("uri"), form.alias("surface_form"), F.array(F.lit("Country")).alias("types"), F.lit(score).cast("double").alias("score"))
    found = F.array(one(star.uri("nation", "n_nationkey"), F.upper("nation"), 0.9), one(F.lit("urn:second"), F.lower("nation"), 0.8), one(star.uri("customer", "doc_id"), F.col("name"), 0.4))
    named = rows.select("text", F.explode(F.array("name", "nation")).alias("name"))
    return named, rows.select("text", found.cast(A.ANNOTATION).alias("annotations"))


@query(f"SELECT DISTINCT {_REMOTE_TEXT} AS text, n_name AS name, '{star.BASE}nation/' || n_nationkey AS uri, upper(n_name) AS label, CAST(0.9 AS DOUBLE) AS confidence FROM {_CUSTOMER_FROM}")
def linked_remote(spark: SparkSession, d: str) -> DataFrame:
    """[DOM11, DOM28, JOIN4]"""
    named, annotated = remote_annotations(spark, d)
    return L.link(named, star.labels(spark, d), "remote", annotated=annotated)


@query(f"SELECT name, uri, label, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY confidence DESC, uri) AS k FROM (SELECT n.name, k.uri, k.label, CAST(0.95 AS DOUBLE) AS confidence FROM (SELECT DISTINCT name FROM ({_FUZZY})) n JOIN ({star.SQL_LABELS}) k ON lower(k.label) = lower(n.name) UNION ALL SELECT name, uri, label, confidence FROM ({_FUZZY}) WHERE name NOT IN (SELECT f.name FROM ({_FUZZY}) f JOIN ({star.SQL_LABELS}) k ON lower(k.label) = lower(f.name)))) WHERE k = 1")
def linked_local(spark: SparkSession, d: str) -> DataFrame:
    """Exact candidates, and similar ones for the names without [DOM11, DOM14]."""
    return L.link(names(spark, d), star.labels(spark, d), "local").withColumn("confidence", F.round("confidence", 6))


# -- extraction and evaluation ------------------------------------------------------------------

_AGENT = "'Agent X' || c_custkey || ' works for ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Group. Agent X' || c_custkey || ' was born in ' || n_name || '.'"
_GROUP = "upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Group'"


def agents(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text, employer, nation, poor): two sentences about an agent for each customer."""
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return rows.select(F.col("c_custkey").alias("doc_id"), F.expr(_AGENT).alias("text"), F.expr(_GROUP).alias("employer"), F.col("n_name").alias("nation"), (F.col("c_acctbal") < 0).alias("poor"))


def agent_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases that expect both facts; of those with a negative balance, another employer."""
    t = lambda p, o: F.struct(F.concat(F.lit("agent_x"), "doc_id").alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))
    return agents(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("raw_text"), F.array(t("worksfor", F.when(F.col("poor"), "Nobody").otherwise(F.col("employer"))), t("birthplac", F.col("nation"))).alias("expected_triples"))


_CASE_SCORES = """SELECT c_custkey AS doc_id, CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 2 END AS BIGINT) AS tp, CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS BIGINT) AS fp, CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS BIGINT) AS fn,
  CAST(CASE WHEN c_acctbal < 0 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS precision, CAST(CASE WHEN c_acctbal < 0 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS recall, CAST(CASE WHEN c_acctbal < 0 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS f1, CASE WHEN c_acctbal < 0 THEN '{poor}' ELSE '{good}' END AS tier FROM customer"""


@query(_CASE_SCORES.format(poor="needs improvement", good="excellent"))
def harness_cases(spark: SparkSession, d: str) -> DataFrame:
    """[DOM24, SRC13, DOM6]"""
    return harness.evaluate_cases(agent_cases(spark, d)).scores


@query(f"SELECT count(*) AS n_docs, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, CAST(0 AS BIGINT) AS n_failed FROM ({_CASE_SCORES.format(poor='', good='')})")
def harness_summary(spark: SparkSession, d: str) -> DataFrame:
    """[SNK4]"""
    return harness.evaluate_cases(agent_cases(spark, d)).summary()


@query(f"""SELECT c_custkey AS doc_id, unnest(CASE WHEN c_acctbal < 0 THEN [c_custkey || ': P 0.50 R 0.50 F1 0.50 (needs improvement)', '  tp: agent_x' || c_custkey || ' | birthplac | ' || n_name, '  fp: agent_x' || c_custkey || ' | worksfor | ' || {_GROUP}, '  fn: agent_x' || c_custkey || ' | worksfor | Nobody']
  ELSE [c_custkey || ': P 1.00 R 1.00 F1 1.00 (excellent)', '  tp: agent_x' || c_custkey || ' | birthplac | ' || n_name || '; agent_x' || c_custkey || ' | worksfor | ' || {_GROUP}] END) AS line FROM {_CUSTOMER_FROM}""")
def harness_report(spark: SparkSession, d: str) -> DataFrame:
    """[SNK4, LIM3]"""
    return harness.evaluate_cases(agent_cases(spark, d)).report()


@query(_CASE_SCORES.format(poor="good", good="good"))
def harness_documents(spark: SparkSession, d: str) -> DataFrame:
    """[DOM25, SRC14, FLT19]"""
    rows = agents(spark, d)
    entity = lambda name, kind: F.array(F.struct(name.alias("name"), F.lit(0).alias("sent_id"), F.array(F.lit(0), F.lit(2)).alias("pos"), F.lit(kind).alias("type")))
    label = lambda t, r: F.struct(F.lit(0).alias("h"), F.lit(t).alias("t"), F.lit(r).alias("r"), F.array().cast("array<int>").alias("evidence"))
    whose = F.when(F.col("poor"), "Nobody").otherwise(F.col("employer"))
    sents = F.transform(F.filter(F.split("text", r"\."), lambda s: F.trim(s) != ""), lambda s: F.split(F.concat(F.trim(s), F.lit(" .")), " "))
    gold = rows.select("doc_id", sents.alias("sents"), F.array(entity(F.concat(F.lit("Agent X"), "doc_id"), "PER"), entity(whose, "ORG"), entity(F.col("nation"), "LOC")).alias("vertexSet"), F.array(label(1, "P108"), label(2, "P19")).alias("labels"))
    return harness.evaluate_documents(gold).scores


@query(f"{_OUTCOMES} SELECT doc_id, outcome, (list(s || ' | ' || p || ' | ' || o ORDER BY s || ' | ' || p || ' | ' || o))[1:5] AS triples FROM f GROUP BY doc_id, outcome")
def eval_samples(spark: SparkSession, d: str) -> DataFrame:
    """[LIM3]"""
    return E.samples(E.flagged(*predicted_and_gold(spark, d)))


@query("SELECT c_custkey AS doc_id, CAST(3 AS BIGINT) AS n_names, CAST(1 AS BIGINT) AS n_linked, TRUE AS valid, CAST(1.0 AS DOUBLE) AS confidence, CAST(0 AS BIGINT) AS n_errors, CAST(0 AS BIGINT) AS n_warnings, 'agent_x' || c_custkey AS name, '" + star.BASE + "nation/' || c_nationkey AS place_id FROM customer")
def pipeline_linked(spark: SparkSession, d: str) -> DataFrame:
    """Extract, link, validate under settings [DOM8, DOM9, DOM10, DOM19, DOM27, HK1, HK3, SRC15]."""
    rows = pipeline.run(agents(spark, d).select("doc_id", "text"), V.rule_frame(spark), Settings(linking="exact"), star.labels(spark, d).filter("type = 'Country'"))
    v = F.try_parse_json("jsonld")
    return rows.select("doc_id", "n_names", "n_linked", "valid", "confidence", "n_errors", "n_warnings", F.try_variant_get(v, "$.name", "string").alias("name"), F.try_variant_get(v, "$.birthPlace['@id']", "string").alias("place_id"))


@query(f"""SELECT c_custkey AS doc_id, unnest([{{'t': {_GROUP.replace(" || ' Group'", "")} || ' Corp', 'k': 'Organization', 'c': 0.9::DOUBLE, 'a': 0}}, {{'t': 'Lake Side', 'k': 'Place', 'c': 0.8::DOUBLE, 'a': length(c_mktsegment) + 10}}, {{'t': '2020-01-02', 'k': 'Date', 'c': 1.0::DOUBLE, 'a': length(c_mktsegment) + 23}}], recursive := true) FROM customer""".replace("'t':", "'text':").replace("'k':", "'type':").replace("'c':", "'confidence':").replace("'a':", "'start':"))
def recognised(spark: SparkSession, d: str) -> DataFrame:
    """[SRC11, HK4, FLT13]"""
    word = _GROUP.replace(" || ' Group'", "")
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(f"{word} || ' Corp met Lake Side on 2020-01-02'").alias("text"))
    return N.recognise(docs, N.RuleRecogniser).select("doc_id", "text", "type", "confidence", "start")


@query(f"""WITH e AS (SELECT l_orderkey AS doc_id, count(*) FILTER (WHERE l_discount >= 0.05) AS n FROM {_LINE_ROWS} GROUP BY 1)
SELECT doc_id, CAST(CASE n WHEN 1 THEN 1 ELSE n END AS BIGINT) AS n_entities, n <> 1 AS is_graph, CASE WHEN n <> 1 THEN CAST(n AS BIGINT) END AS told FROM e""")
def entity_documents(spark: SparkSession, d: str) -> DataFrame:
    """[DOM20, FLT13, PRJ10, PRJ11]"""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    found_ = rows.select(F.col("l_orderkey").alias("doc_id"), F.col("p_name").alias("text"), F.lit("Company").alias("type"), F.when(F.col("l_discount") >= 0.05, 0.9).otherwise(0.1).alias("confidence"), (F.col("l_linenumber") * 100).alias("start"), (F.col("l_linenumber") * 100 + 9).alias("end"))
    v = N.entities_to_documents(found_, rows.select(F.col("l_orderkey").alias("doc_id")).distinct()).select("doc_id", F.try_parse_json("jsonld").alias("v"))
    graph = F.try_variant_get("v", "$['@graph']", "array<variant>")
    return v.select("doc_id", F.coalesce(F.size(graph), F.lit(1)).cast("long").alias("n_entities"), graph.isNotNull().alias("is_graph"), F.try_variant_get("v", "$._extractionMetadata.entityCount", "long").alias("told"))


# -- coreference and chunks ---------------------------------------------------------------------


@query(f"WITH {TQ._ANTECEDENTS} SELECT d.doc_id, count(a.antecedent) AS n_replaced FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id WHERE d.text IS NOT NULL GROUP BY d.doc_id")
def coref_replacements(spark: SparkSession, d: str) -> DataFrame:
    """What the rewriter replaces is what the relations resolve [DOM3, FN13, SRT2]."""
    return coref.rewrite_pronouns(TQ.documents(spark, d)).filter("resolved_text IS NOT NULL").select("doc_id", "n_replaced")


_GUIDED = f"""{TQ._MENTIONS}, x AS (SELECT *, arg_max(CASE WHEN pronoun_type IS NULL THEN mention END, CASE WHEN pronoun_type IS NULL THEN {TQ._AT} END) OVER (PARTITION BY doc_id ORDER BY sentence RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS antecedent FROM m)"""


def last_names(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, sentence, entity): the last name of each sentence stands for what a recogniser finds."""
    return coref.mentions(TQ.documents(spark, d)).filter("pronoun_type IS NULL").groupBy("doc_id", "sentence").agg(F.max_by("mention", "ordinal").alias("entity"))


@query(f"WITH {_GUIDED} SELECT doc_id, antecedent, count(*) AS n_pronouns, string_agg(mention, ' ' ORDER BY sentence, ordinal) AS pronouns, CAST(min(sentence) AS INTEGER) AS first_sentence FROM x WHERE pronoun_type IS NOT NULL AND antecedent IS NOT NULL GROUP BY doc_id, antecedent")
def guided_clusters(spark: SparkSession, d: str) -> DataFrame:
    """[DOM4, AGG16]"""
    return coref.clusters(coref.guided_antecedents(coref.mentions(TQ.documents(spark, d)), last_names(spark, d))).withColumn("pronouns", F.array_join("pronouns", " "))


@query(f"WITH {_GUIDED} SELECT d.doc_id, count(x.antecedent) AS n_replaced FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id AND x.pronoun_type IS NOT NULL WHERE d.text IS NOT NULL GROUP BY d.doc_id")
def guided_replacements(spark: SparkSession, d: str) -> DataFrame:
    """[DOM4]"""
    return coref.rewrite_guided(TQ.documents(spark, d), last_names(spark, d)).filter("resolved_text IS NOT NULL").select("doc_id", "n_replaced")


@query("SELECT doc_id, text AS resolved_text, CASE WHEN text IS NOT NULL THEN CAST(0 AS BIGINT) END AS n_replaced FROM documents")
def coref_none(spark: SparkSession, d: str) -> DataFrame:
    """[DOM2, EXT2]"""
    return coref.resolve(TQ.documents(spark, d), "none")


_BARE = "length(regexp_replace({}, '[ \\t\\n\\r\\f\\v]', '', 'g'))"


@query(f"SELECT doc_id, CAST({_BARE.format('text')} AS BIGINT) AS n_kept, TRUE AS fits, TRUE AS offsets FROM documents WHERE {_BARE.format('text')} > 0")
def chunk_cover(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of at most 3500 characters hold all but white space, and stand where their offsets say [DOM1, WIN1]."""
    docs = TQ.documents(spark, d).select("doc_id", "text")
    long = docs.select("doc_id", F.col("text").alias("whole"))
    c = chunking.chunk(docs, threshold=0).join(long, "doc_id")
    bare = F.length(F.regexp_replace("text", "[ \\t\\n\\r\\f\\x0b]", ""))
    there = F.substring("whole", F.col("start_char").cast("int") + 1, (F.col("end_char") - F.col("start_char")).cast("int")) == F.col("text")
    return c.groupBy("doc_id").agg(F.sum(bare).alias("n_kept"), F.bool_and(F.length("text") <= chunking.SIZE).alias("fits"), F.bool_and(there & (F.col("end_byte") - F.col("start_byte") == F.octet_length("text"))).alias("offsets"))


# -- SPARQL -------------------------------------------------------------------------------------


@query("SELECT n_name AS label FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) AND NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_regionkey AND r_name = 'ASIA')")
def sparql_exists(spark: SparkSession, d: str) -> DataFrame:
    return sparql.select(star.triples(spark, d), """SELECT ?label WHERE { ?n a schema:Country ; rdfs:label ?label FILTER EXISTS { ?s schema:location ?n ; rdfs:label ?l FILTER(STRSTARTS(?l, "Supplier")) }
      FILTER(NOT EXISTS { ?n schema:containedInPlace ?r . ?r rdfs:label "ASIA" } && ?label != "") }""")


@query("SELECT n_name AS label FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA'")
def sparql_minus(spark: SparkSession, d: str) -> DataFrame:
    return sparql.select(star.triples(spark, d), 'SELECT ?label WHERE { ?n a schema:Country ; rdfs:label ?label MINUS { ?n schema:containedInPlace ?r . ?r rdfs:label "ASIA" } }')


@query("SELECT n_name AS label, lower(n_name) || '!' AS shout, CAST(length(n_name) + 1 AS VARCHAR) AS more FROM nation WHERE n_name IN ('NATION_1', 'NATION_7')")
def sparql_bind_values(spark: SparkSession, d: str) -> DataFrame:
    return sparql.select(star.triples(spark, d), 'SELECT ?label ?shout ?more WHERE { VALUES ?label { "NATION_1" "NATION_7" "ATLANTIS" } ?n a schema:Country ; rdfs:label ?label BIND(CONCAT(LCASE(?label), "!") AS ?shout) BIND(STRLEN(?label) + 1 AS ?more) }')


@query("SELECT r_name AS region, count(DISTINCT s_suppkey) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name HAVING count(DISTINCT s_suppkey) > 1")
def sparql_group(spark: SparkSession, d: str) -> DataFrame:
    """Patterns out of order, a path and an inverse step."""
    return sparql.select(star.triples(spark, d), 'SELECT ?region (COUNT(DISTINCT ?s) AS ?n) WHERE { ?r rdfs:label ?region . ?s rdfs:label ?name . ?s schema:location/schema:containedInPlace ?r . ?r ^schema:containedInPlace ?any FILTER(STRSTARTS(?name, "Supplier")) } GROUP BY ?region HAVING(COUNT(DISTINCT ?s) > 1)')


@query("SELECT region, count(*) OVER () AS n FROM (SELECT DISTINCT r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY region DESC LIMIT 3)")
def sparql_distinct_order(spark: SparkSession, d: str) -> DataFrame:
    rows = sparql.select(star.triples(spark, d), "SELECT DISTINCT ?region WHERE { ?n schema:containedInPlace ?r . ?r rdfs:label ?region } ORDER BY DESC(?region) LIMIT 3")
    return rows.withColumn("n", F.lit(3).cast("long"))


@query(f"SELECT k.uri AS x, k.label FROM ({star.SQL_LABELS}) k WHERE k.type IN ('Country', 'Region')")
def sparql_optional_first(spark: SparkSession, d: str) -> DataFrame:
    """An optional part that comes first, and alternatives of predicates."""
    return sparql.select(star.triples(spark, d), "SELECT ?x ?label WHERE { OPTIONAL { ?x a schema:Nowhere } ?x rdfs:label|schema:name ?label . { ?x a schema:Country } UNION { ?x a schema:Region } }")
