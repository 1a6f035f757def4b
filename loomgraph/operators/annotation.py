"""Entities that a remote service finds in a text, asked for once a distinct text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANNOTATION = "array<struct<uri:string,surface_form:string,types:array<string>,score:double>>"
CACHE = f"service string, text string, annotations {ANNOTATION}, fetched_at timestamp"


class Annotator(Protocol):
    name: str

    def annotate(self, text: str) -> list[tuple[str, str, list[str], float]]:
        """(uri, surface form, types, score) in the order of the text; an exception means no answer."""


def annotate(texts: DataFrame, annotator: Callable[[], Annotator], cache: DataFrame | None = None, max_age_s: int = 3600) -> DataFrame:
    """(service, text, annotations, fetched_at) of the distinct texts of (text) [SRC9, SRC10].

    Rows of `cache` (the same columns) that are younger than max_age_s are used instead of a call; write the result
    to keep it for the next run. A call that fails has null annotations, which aren't kept as an answer. Null texts are left out.
    """
    service = annotator().name
    wanted = texts.select("text").filter("text IS NOT NULL").distinct()
    fresh = None
    if cache is not None:
        fresh = cache.filter((F.col("service") == service) & F.col("annotations").isNotNull() & (F.col("fetched_at") > F.current_timestamp() - F.make_dt_interval(secs=F.lit(max_age_s))))
        newest = F.max_by(F.struct("annotations", "fetched_at"), "fetched_at").alias("x")
        fresh = fresh.join(wanted, "text", "left_semi").groupBy("service", "text").agg(newest).select("service", "text", "x.*")
        wanted = wanted.join(fresh, "text", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = annotator()
        for b in batches:
            rows = []
            for t in b["text"]:
                try:
                    found = [{"uri": u, "surface_form": s, "types": list(k), "score": float(x)} for u, s, k, x in a.annotate(t)]
                except Exception:  # whatever a service throws; the row says so by its null
                    found = None
                rows.append((t, found))
            yield pd.DataFrame(rows, columns=["text", "annotations"])

    asked = wanted.mapInPandas(run, f"text string, annotations {ANNOTATION}").select(F.lit(service).alias("service"), "text", "annotations", F.current_timestamp().alias("fetched_at"))
    return asked if fresh is None else asked.unionByName(fresh)


def link_annotated(names: DataFrame, annotated: DataFrame, min_score: float = 0.5) -> DataFrame:
    """(text, name, uri, label, confidence, types): for (text, name), the first annotation of the text with that surface form, letters' case aside [DOM28, JOIN4]."""
    rows = annotated.select("text", F.posexplode("annotations").alias("at", "a")).filter(F.col("a.score") >= min_score)
    first = rows.groupBy("text", F.lower("a.surface_form").alias("name_lc")).agg(F.min_by("a", "at").alias("a"))
    own = names.select("text", "name", F.lower("name").alias("name_lc")).distinct()
    return own.join(first, ["text", "name_lc"]).select("text", "name", F.col("a.uri").alias("uri"), F.col("a.surface_form").alias("label"), F.col("a.score").alias("confidence"), F.col("a.types").alias("types"))
