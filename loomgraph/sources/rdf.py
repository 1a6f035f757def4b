"""N-Triples in and out, Turtle out, and the label and type tables that linking uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
LABELS = ("http://www.w3.org/2000/01/rdf-schema#label", "http://schema.org/name", "https://schema.org/name")
_LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:@([\w-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$'


_ESCAPES = (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ('\\"', '"'))


def _unescaped(x: Column) -> Column:
    x = F.replace(x, F.lit("\\\\"), F.lit("\0"))  # held aside, so that its second half escapes nothing
    for written, meant in _ESCAPES:
        x = F.replace(x, F.lit(written), F.lit(meant))
    return F.replace(x, F.lit("\0"), F.lit("\\"))


def parse_ntriples(lines: DataFrame) -> DataFrame:
    """(s, p, o, o_kind, o_lang, o_datatype) of (value) lines; blank lines, comments and lines that aren't triples are left out. No Python per line."""
    part = lambda k: F.regexp_extract("value", _LINE, k)
    given = lambda k: F.when(part(k) != "", part(k))
    rows = lines.filter(F.col("value").rlike(_LINE))
    kind = F.when(F.col("value").rlike(r">\s+<[^>]*>\s*\.\s*(?:#.*)?$") & (part(5) == ""), "iri").when(part(4) != "", "bnode").otherwise("literal")
    o = F.when(kind == "iri", part(3)).when(kind == "bnode", part(4)).otherwise(_unescaped(part(5)))
    return rows.select(F.regexp_replace(part(1), "^<|>$", "").alias("s"), part(2).alias("p"), o.alias("o"), kind.alias("o_kind"), given(6).alias("o_lang"), given(7).alias("o_datatype"))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """[SRC8]"""
    return parse_ntriples(spark.read.text(path))


def _escaped(x: Column) -> Column:
    x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for written, meant in _ESCAPES:
        x = F.replace(x, F.lit(meant), F.lit(written))
    return x


def _term(c: str, kind: Column) -> Column:
    literal = F.concat(F.lit('"'), _escaped(F.col(c)), F.lit('"'), F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), "o_datatype", F.lit(">"))).otherwise(""))
    return F.when(kind == "iri", F.concat(F.lit("<"), c, F.lit(">"))).when(kind == "bnode", F.col(c)).otherwise(literal)


def _subject() -> Column:
    return F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(F.concat(F.lit("<"), "s", F.lit(">")))


def ntriples_lines(triples: DataFrame) -> DataFrame:
    """(value): a line for each triple; df.write.text() is the sink."""
    return triples.select(F.concat_ws(" ", _subject(), F.concat(F.lit("<"), "p", F.lit(">")), _term("o", F.col("o_kind")), F.lit(".")).alias("value"))


def turtle_blocks(triples: DataFrame) -> DataFrame:
    """(value): a block for each subject, its predicates and objects in order."""
    rows = triples.select(_subject().alias("s"), F.concat(F.lit("<"), "p", F.lit("> "), _term("o", F.col("o_kind"))).alias("po"))
    return rows.groupBy("s").agg(F.array_join(F.sort_array(F.collect_set("po")), " ;\n    ").alias("po")).select(F.concat("s", F.lit("\n    "), "po", F.lit(" .")).alias("value"))


def labels_of(triples: DataFrame) -> DataFrame:
    """(uri, label): subjects that are IRIs with their labels [FLT12, SET3]; equal labels of different predicates count once."""
    return triples.filter(F.col("p").isin(*LABELS) & ~F.col("s").startswith("_:")).select(F.col("s").alias("uri"), F.col("o").alias("label")).distinct()


def types_of(triples: DataFrame) -> DataFrame:
    """(uri, type)"""
    return triples.filter(F.col("p") == RDF_TYPE).select(F.col("s").alias("uri"), F.col("o").alias("type")).distinct()
