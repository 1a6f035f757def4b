"""How well extraction does on annotated cases: documents, triples, scores and what a report says."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import loaders
from ..sources.sinks import cut
from . import evaluation as E
from . import extraction as X
from . import triples as R


@dataclass(frozen=True)
class Result:
    """outcomes (doc_id, s, p, o, outcome); scores (doc_id, tp, fp, fn, precision, recall, f1, tier) of the cases that gave a document; failed (doc_id, error, error_text) of the others."""

    outcomes: DataFrame
    scores: DataFrame
    failed: DataFrame

    def summary(self) -> DataFrame:
        """(n_docs, precision, recall, f1, n_failed): means over the cases that didn't fail."""
        return E.macro(self.scores).crossJoin(self.failed.agg(F.count("*").alias("n_failed")))  # a row each

    def report(self, k: int = 5) -> DataFrame:
        """(doc_id, line): what a person reads about each case [SNK4, LIM3]: its scores, and up to k triples of each outcome."""
        head = F.format_string("%s: P %.2f R %.2f F1 %.2f (%s)", F.col("doc_id").cast("string"), "precision", "recall", "f1", "tier")
        told = F.concat(F.lit("  "), "outcome", F.lit(": "), F.array_join("triples", "; "))
        lines = self.scores.select("doc_id", F.lit(0).alias("at"), head.alias("line")).unionByName(
            E.samples(self.outcomes, k).select("doc_id", F.element_at(F.create_map(F.lit("tp"), F.lit(1), F.lit("fp"), F.lit(2), F.lit("fn"), F.lit(3)), F.col("outcome")).alias("at"), told.alias("line"))
        )
        lines = lines.unionByName(self.failed.select("doc_id", F.lit(0).alias("at"), F.format_string("%s: failed (%s)", F.col("doc_id").cast("string"), "error").alias("line")))
        return lines.orderBy("doc_id", "at").select("doc_id", "line")


def _result(predict: Callable[[DataFrame], DataFrame], gold: DataFrame, extracted: DataFrame, tier) -> Result:
    """Texts are extracted once, and triples compared once: both are written to the shared folder."""
    extracted = cut(extracted)
    failed = extracted.filter("jsonld IS NULL").select("doc_id", "error", "error_text")
    gave = extracted.filter("jsonld IS NOT NULL").select("doc_id")
    own = gold.join(gave, "doc_id", "left_semi")
    outcomes = cut(E.flagged(predict(extracted.filter("jsonld IS NOT NULL")), own))
    scores = gave.join(E.scored(outcomes), "doc_id", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")] + [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")]
    scores = scores.select("doc_id", *zero).withColumn("tier", tier(F.col("f1")))
    return Result(outcomes, scores, failed)


def evaluate_cases(cases: DataFrame, provider: Callable[[], X.Provider] = X.RuleProvider, options: X.Options = X.Options()) -> Result:
    """Sentence-level cases (id, raw_text, expected_triples ..): extract each text, flatten to triples, score [DOM24].

    A case whose extraction fails is left out of the scores. Null texts have no row.
    """
    texts = cases.filter("raw_text IS NOT NULL").select(F.col("id").alias("doc_id"), F.col("raw_text").alias("text"))
    extracted = X.extract(texts, provider, options)
    return _result(R.basic_triples, loaders.case_triples(cases), extracted, E.tier)


def evaluate_documents(annotated: DataFrame, provider: Callable[[], X.Provider] = X.RuleProvider, options: X.Options = X.Options(), least_retries: int = 5) -> Result:
    """Annotated documents (doc_id, sents, vertexSet, labels): extract the whole text, flatten, leave out implausible predicates, score [DOM25]."""
    options = replace(options, max_retries=max(options.max_retries, least_retries))
    chunks = cut(X.extract_documents(R.document_text(annotated), provider, options))
    merged = X.merge_chunks(chunks, once=True)
    errors = chunks.groupBy("doc_id").agg(F.count("jsonld").alias("n"), F.min("error").alias("error"), F.min("error_text").alias("error_text"))
    extracted = errors.join(merged, "doc_id").select("doc_id", F.when(F.col("n") > 0, F.col("jsonld")).alias("jsonld"), "error", "error_text")
    return _result(lambda docs: R.plausible(R.document_triples(docs)), R.gold_triples(annotated), extracted, E.document_tier)
