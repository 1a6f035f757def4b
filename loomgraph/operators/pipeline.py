"""From texts to validated and linked documents, under settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.loaders import Settings
from ..sources.sinks import cut
from . import extraction as X
from . import linking as L
from . import validation as V


def options_of(settings: Settings) -> X.Options:
    """[HK1]"""
    return X.Options(max_retries=settings.max_retries, strict=settings.strict_validation, inject_context=settings.inject_context, system=settings.system or X.SYSTEM)


def extracted(docs: DataFrame, settings: Settings = Settings(), provider: Callable[[], X.Provider] = X.RuleProvider) -> DataFrame:
    """extract_documents() under settings, with provenance if they ask for it [HK1, HK2, DOM8]."""
    rows = X.extract_documents(docs, provider, options_of(settings), settings.coref_strategy, settings.chunk_size, settings.chunk_overlap, settings.chunk_threshold, settings.coref_distance)
    if settings.provenance:
        rows = X.with_provenance(rows).withColumn("jsonld", F.col("jsonld_with_provenance")).drop("jsonld_with_provenance", "provenance")
    return rows


def documents(docs: DataFrame, settings: Settings = Settings(), labels: DataFrame | None = None, provider: Callable[[], X.Provider] = X.RuleProvider, annotated: DataFrame | None = None) -> DataFrame:
    """(doc_id, jsonld, n_names, n_linked): chunks merged, objects of one name merged too, and linked by the settings' strategy [DOM8, DOM9, DOM10, HK3]."""
    merged = X.merge_chunks(extracted(docs, settings, provider), once=settings.merge_entities)
    if settings.linking == "none":
        return merged.select("doc_id", "jsonld", F.lit(0).cast("long").alias("n_names"), F.lit(0).cast("long").alias("n_linked"))
    if labels is None:
        raise ValueError("linking needs labels")
    merged = cut(merged)  # linking looks at it for the names and for the documents
    if settings.linking == "remote":
        merged = merged.join(docs.select("doc_id", "text"), "doc_id")
    return L.link_documents(merged, labels, settings.linking, settings.link_fuzzy, annotated, settings.link_confidence)


def run(docs: DataFrame, rules: DataFrame, settings: Settings = Settings(), labels: DataFrame | None = None, provider: Callable[[], X.Provider] = X.RuleProvider, annotated: DataFrame | None = None) -> DataFrame:
    """(doc_id, jsonld, n_names, n_linked, valid, confidence, n_errors, n_warnings): extract, merge, link, validate [DOM19, DOM27].

    The verdict is worked out beside the document, so validation adds no shuffle. Documents without a chunk (null or blank texts) have no row.
    """
    found = documents(docs, settings, labels, provider, annotated)
    return V.with_verdict(found, rules, V.Settings(min_confidence=settings.min_confidence, strict_dates=settings.strict_dates))
