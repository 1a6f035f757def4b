"""Subject-predicate-object triples out of JSON-LD documents and gold annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonld as J
from ..functions import text as T
from ..functions.stem import stem


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _string_or_name(v: Column) -> Column:
    """A string, or an object's string `name`."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")).when(_kind(v).startswith("OBJECT"), J.root_string(v, "name"))


def _fields(rows: DataFrame, of: str) -> DataFrame:
    """One row for each field of the VARIANT object in column `of`, as key and value; identifiers and private fields are left out [FLT24]."""
    out = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(of).outer())).drop("pos")
    return out.filter(~F.col("key").rlike("^[@_]") & (F.col("key") != "name"))


def _stemmed(rows: DataFrame) -> DataFrame:
    """rows with p, the stem of key [FN2]. No join: predicates are few, and all rows of one would meet in one task."""
    return rows.withColumn("p", T.predicate_stem(F.col("key")))


def _nodes(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, v): documents as VARIANT, graphs as their nodes."""
    rows = docs.select("doc_id", F.try_parse_json(F.col(text)).alias("v"))
    graph = F.try_variant_get("v", "$['@graph']", "array<variant>")
    return rows.select("doc_id", F.explode(F.coalesce(graph, F.array("v"))).alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))


def basic_triples(docs: DataFrame, text: str = "jsonld") -> DataFrame:
    """(doc_id, s, p, o), each once [DOM21]: root fields that are strings, or objects with a name.

    The subject is the root's name as a slug (`unknown` without one), the predicate is stemmed. Graphs count node
    by node. Numbers, booleans, nulls and lists make no triple; texts that are no JSON object have none.
    """
    rows = _nodes(docs, text).select("doc_id", "v", F.coalesce(T.slug(J.root_string(F.col("v"), "name")), F.lit("unknown")).alias("s"))
    rows = _fields(rows, "v").select("doc_id", "s", "key", _string_or_name(F.col("value")).alias("o")).filter("o IS NOT NULL")
    return _stemmed(rows).select("doc_id", "s", "p", "o").distinct()


def document_triples(docs: DataFrame, text: str = "jsonld") -> DataFrame:
    """(doc_id, s, p, o), each once [DOM22]: as basic_triples(), and the string fields of nested objects, and the
    strings and named objects in lists. Subjects are the root's name in lower case with underscores, punctuation kept."""
    rows = _nodes(docs, text).select("doc_id", "v", F.coalesce(T.lowered_subject(J.root_string(F.col("v"), "name")), F.lit("unknown")).alias("s"))
    own = _fields(rows, "v").select("doc_id", "s", "key", "value")
    listed = own.select("doc_id", "s", "key", F.explode(F.try_variant_get("value", "$", "array<variant>")).alias("value"))
    inner = own.filter(_kind(F.col("value")).startswith("OBJECT")).select("doc_id", "s", F.col("value").alias("v"))
    nested = _fields(inner, "v").select("doc_id", "s", "key", F.when(_kind(F.col("value")) == "STRING", F.try_variant_get("value", "$", "string")).alias("o"))
    direct = own.unionByName(listed).select("doc_id", "s", "key", _string_or_name(F.col("value")).alias("o"))
    return _stemmed(direct.unionByName(nested).filter("o IS NOT NULL")).select("doc_id", "s", "p", "o").distinct()


def gold_triples(docs: DataFrame) -> DataFrame:
    """(doc_id, s, p, o) of annotated documents (doc_id, vertexSet, labels) [DOM23, JOIN12, JOIN13, PRJ12, PRJ14].

    Heads and tails are their first mentions; relations with an index out of range or without a property are dropped.
    """
    spark = docs.sparkSession
    props = spark.createDataFrame([(r, stem(key.lower())) for r, key in T.RELATION_PROPERTIES.items()], "r string, p string")
    name = lambda i: F.get(F.get("vertexSet", i), F.lit(0))["name"]
    rows = docs.select("doc_id", "vertexSet", F.explode("labels").alias("l")).select("doc_id", name(F.col("l.h")).alias("head"), name(F.col("l.t")).alias("o"), F.col("l.r").alias("r"))
    rows = rows.filter("head IS NOT NULL AND o IS NOT NULL").join(F.broadcast(props), "r")  # 18 rows
    return rows.select("doc_id", T.lowered_subject(F.col("head")).alias("s"), "p", "o").distinct()


def plausible(triples: DataFrame) -> DataFrame:
    """Triples without the predicates that extraction tends to turn round [FLT19]."""
    p = F.lower("p")
    return triples.filter(~(p.contains("founder") | p.contains("funder") | p.contains("currentceo") | (p == "ceo") | (p.contains("alumni") & ~p.contains("alumniof"))))


def document_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text): tokens joined by blanks, sentences by blank lines [PRJ13]."""
    return docs.select("doc_id", F.array_join(F.transform("sents", lambda s: F.array_join(s, " ")), "\n\n").alias("text"))


def document_profile(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, n_tokens, n_entities, n_relations, n_cross_sentence) [AGG22, AGG23]."""
    at = lambda i: F.get(F.get("vertexSet", i), F.lit(0))["sent_id"]
    cross = F.size(F.filter("labels", lambda x: at(x["h"]) != at(x["t"])))
    tokens = F.aggregate("sents", F.lit(0), lambda n, s: n + F.size(s))
    return docs.select("doc_id", F.size("sents").alias("n_sentences"), tokens.alias("n_tokens"), F.size("vertexSet").alias("n_entities"), F.size("labels").alias("n_relations"), cross.alias("n_cross_sentence"))
