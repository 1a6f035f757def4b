"""Precision, recall and F1 of predicted against gold triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIPLE = ["doc_id", "s", "p", "o"]


def flagged(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, s, p, o, outcome): tp, fp or fn, each triple once [SET1, SET2, JOIN15]. A union and one aggregation, with map-side combine, not a join."""
    both = predicted.select(*TRIPLE, F.lit(1).alias("side")).unionByName(gold.select(*TRIPLE, F.lit(2).alias("side")))
    sides = both.groupBy(*TRIPLE).agg(F.bit_or("side").alias("sides"))
    return sides.select(*TRIPLE, F.element_at(F.array(F.lit("fp"), F.lit("fn"), F.lit("tp")), F.col("sides")).alias("outcome"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def _scores(counted: DataFrame, *keys: str) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rows = counted.withColumn("precision", F.round(_ratio(tp, tp + fp), 6)).withColumn("recall", F.round(_ratio(tp, tp + fn), 6))
    # 2PR / (P + R), without the detour over rounded P and R
    return rows.select(*keys, "tp", "fp", "fn", "precision", "recall", F.round(_ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


def _counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.count_if(F.col("outcome") == x).alias(x) for x in ("tp", "fp", "fn")))


def per_document(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, tp, fp, fn, precision, recall, f1) [AGG8, AGG9]; a ratio with nothing to divide by is 0."""
    return scored(flagged(predicted, gold))


def scored(outcomes: DataFrame) -> DataFrame:
    """per_document() of flagged() triples."""
    return _scores(_counts(outcomes, "doc_id"), "doc_id")


def macro(scores: DataFrame) -> DataFrame:
    """(n_docs, precision, recall, f1): means over documents [AGG10]; nulls of no documents are 0."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c)
    return scores.agg(F.count("*").alias("n_docs"), mean("precision"), mean("recall"), mean("f1"))


def micro(scores: DataFrame) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) over all documents together [AGG11]."""
    return _scores(scores.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tp", "fp", "fn"))))


def tier(f1: Column) -> Column:
    """[AGG12]"""
    return F.when(f1 >= 0.9, "excellent").when(f1 >= 0.75, "good").when(f1 >= 0.6, "fair").otherwise("needs improvement")


def document_tier(f1: Column) -> Column:
    """[AGG12] for whole documents, which are harder."""
    return F.when(f1 >= 0.4, "good").otherwise("needs improvement")


def samples(rows: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, outcome, triples): the first k triples of each outcome, for reports [SNK4, LIM3]."""
    line = F.concat_ws(" | ", "s", "p", "o")
    return rows.groupBy("doc_id", "outcome").agg(F.slice(F.sort_array(F.collect_list(line)), 1, k).alias("triples"))
