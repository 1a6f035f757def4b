"""Named entities of texts by a recogniser that is loaded once a task."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ENTITY = "text string, type string, confidence double, start int, end int"


class ConfigurationError(RuntimeError):
    """A part that the settings ask for isn't there."""


@dataclass(frozen=True)
class RecogniserSettings:
    """[HK4] the types that are looked for and the least confidence of what is kept."""

    types: tuple[str, ...] = ("Person", "Organization", "Place", "Event", "Product", "Date")
    confidence: float = 0.5


class Recogniser(Protocol):
    def entities(self, text: str, types: tuple[str, ...]) -> list[tuple[str, str, float, int, int]]:
        """(text, type, confidence, start, end), ends exclusive."""


class Absent:
    """[HK5] stands for a recogniser that isn't installed: making one is an error."""

    def __init__(self):
        raise ConfigurationError("no recogniser is installed; give one that loads its model")


_NAME = re.compile(r"[A-ZÀ-Þ][a-zß-ÿ][\w'-]*(?: [A-ZÀ-Þ][\w'-]*)*")
_DATE = re.compile(r"\b\d{4}-\d\d-\d\d\b")


class RuleRecogniser:
    """Dates, and runs of capitalised words: organisations by their marks, events and places by a word, others persons with less confidence."""

    def entities(self, text: str, types: tuple[str, ...]) -> list[tuple[str, str, float, int, int]]:
        found = [(m.group(), "Date", 1.0, m.start(), m.end()) for m in _DATE.finditer(text)]
        for m in _NAME.finditer(text):
            name = m.group()
            if name in T.STOP_WORDS or name.lower() in _PRONOUNS:
                continue
            kind, sure = "Person", 0.6
            if any(w in name for w in T.ORGANISATION_MARKS):
                kind, sure = "Organization", 0.9
            elif re.search(r"\b(?:City|River|Mount|Lake|Island|Street)\b", name):
                kind, sure = "Place", 0.8
            elif re.search(r"\b(?:War|Festival|Conference|Games|Cup)\b", name):
                kind, sure = "Event", 0.8
            found.append((name, kind, sure, m.start(), m.end()))
        return sorted((e for e in found if e[1] in types), key=lambda e: e[3:])


_PRONOUNS = frozenset(f for forms in T.PRONOUNS.values() for f in forms)


def recognise(docs: DataFrame, recogniser: Callable[[], Recogniser] = Absent, settings: RecogniserSettings = RecogniserSettings()) -> DataFrame:
    """(doc_id, text, type, confidence, start, end) of the entities that are sure enough [SRC11, FLT13, HK4, PRJ11]; null texts have none. No shuffle."""

    @F.pandas_udf(f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in ENTITY.split(', '))}>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        r = recogniser()
        for s in batches:
            yield pd.Series([[] if t is None else [e for e in r.entities(t, settings.types) if e[2] >= settings.confidence] for t in s], dtype=object)

    return docs.select("doc_id", F.explode(run.asNondeterministic()("text")).alias("e")).select("doc_id", "e.*")


def entities_to_documents(entities: DataFrame, docs: DataFrame | None = None, min_confidence: float = 0.5, model: str = "rules") -> DataFrame:
    """(doc_id, jsonld) of recognised entities (doc_id, text, type, confidence, start, end) [DOM20, PRJ10]: one is an object of its own,
    more are a graph with what is told of the extraction; with docs, documents without an entity have an empty graph."""
    node = F.struct(T.schema_type(F.col("type")).alias("@type"), F.concat(F.lit("entity_"), "start").alias("@id"), F.col("text").alias("name"), F.col("confidence").alias("confidence"))
    g = entities.filter(F.col("confidence") >= min_confidence).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("start", node.alias("n")))), lambda x: x["n"]).alias("n"))
    if docs is not None:
        g = docs.select("doc_id").join(g, "doc_id", "left")
    context = F.lit("https://schema.org").alias("@context")
    size = F.coalesce(F.size("n"), F.lit(0))
    told = F.struct(F.lit(model).alias("model"), F.when(size > 0, size).otherwise(0).alias("entityCount"), F.lit(min_confidence).alias("minConfidence")).alias("_extractionMetadata")
    one = F.to_json(F.struct(context, *(F.col("n")[0][k].alias(k) for k in ("@type", "@id", "name", "confidence"))))
    none = F.array().cast("array<struct<`@type`:string,`@id`:string,name:string,confidence:double>>")
    return g.select("doc_id", F.when(size == 1, one).otherwise(F.to_json(F.struct(context, F.coalesce("n", none).alias("@graph"), told))).alias("jsonld"))
