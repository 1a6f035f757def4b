"""The star schema as a knowledge base: rows are labelled entities, foreign keys are relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rdf import LABELS, RDF_TYPE

BASE = "https://example.org/"
#: table: key, label, type, (foreign key, relation, table it points to)
ENTITIES = {
    "region": ("r_regionkey", "r_name", "Region", None),
    "nation": ("n_nationkey", "n_name", "Country", ("n_regionkey", "containedInPlace", "region")),
    "supplier": ("s_suppkey", "s_name", "Organization", ("s_nationkey", "location", "nation")),
    "customer": ("c_custkey", "c_name", "Organization", ("c_nationkey", "location", "nation")),
    "part": ("p_partkey", "p_name", "Product", None),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uri(kind: str, key: str):
    return F.concat(F.lit(f"{BASE}{kind}/"), F.col(key).cast("string"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uri, label, type)"""
    parts = [table(spark, sf_dir, t).select(uri(t, key).alias("uri"), F.col(label).alias("label"), F.lit(kind).alias("type")) for t, (key, label, kind, _) in ENTITIES.items()]
    return reduce(DataFrame.unionByName, parts)


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, o, o_kind): labels, types and relations."""
    rows = labels(spark, sf_dir)
    out = [
        rows.select(F.col("uri").alias("s"), F.lit(LABELS[0]).alias("p"), F.col("label").alias("o"), F.lit("literal").alias("o_kind")),
        rows.select(F.col("uri").alias("s"), F.lit(RDF_TYPE).alias("p"), F.concat(F.lit("http://schema.org/"), "type").alias("o"), F.lit("iri").alias("o_kind")),
    ]
    for t, (key, _, _, link) in ENTITIES.items():
        if link:
            foreign, relation, to = link
            out.append(table(spark, sf_dir, t).select(uri(t, key).alias("s"), F.lit(f"http://schema.org/{relation}").alias("p"), uri(to, foreign).alias("o"), F.lit("iri").alias("o_kind")))
    return reduce(DataFrame.unionByName, out)


SQL_LABELS = " UNION ALL ".join(f"SELECT '{BASE}{t}/' || CAST({key} AS VARCHAR) AS uri, {label} AS label, '{kind}' AS type FROM {t}" for t, (key, label, kind, _) in ENTITIES.items())
