"""Extraction by a pluggable provider, with retries on what its answers fail.

A provider turns a prompt into an answer. The default one is rule-based and offline. Each
row's attempts, their errors and the final document come back as columns, so a row that fails
doesn't fail the job.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import jsonld as J
from ..functions import text as T
from .chunking import LONG_DOCUMENT, OVERLAP, SIZE, chunk, chunk_spans
from .coref import MAX_DISTANCE, Rewriter, resolve


class TransportError(Exception):
    """The provider couldn't be reached; this isn't retried."""


class Provider(Protocol):
    def available(self) -> bool: ...

    def answer(self, messages: list[tuple[str, str]]) -> str: ...


SYSTEM = "Describe the entities of the text as one JSON-LD object in schema.org terms. Answer with JSON only."
_WHO = r"(?P<s>(?:[A-ZÀ-Þ]\.|[A-ZÀ-Þ][\w'-]*)(?: (?:of |de |von )?(?:[A-ZÀ-Þ]\.|[A-ZÀ-Þ][\w'-]*))*)"
_WHAT = r"(?:the )?(?P<o>[A-ZÀ-Þ][\w'-]*(?: (?:of |de |von )?[A-ZÀ-Þ][\w'-]*)*)"
_DATE = r"(?P<o>\d{4}(?:-\d\d-\d\d)?)"
#: Property, type of the subject, type of the object (none for a plain value), words between them of which a text must hold one, and how it goes on.
RELATIONS = (
    ("birthDate", "Person", None, ("was born",), r"(?: on| in)?", _DATE),
    ("birthPlace", "Person", "Place", ("was born in", "was born at"), "", _WHAT),
    ("deathDate", "Person", None, ("died", "passed away"), r"(?: on| in)?", _DATE),
    ("deathPlace", "Person", "Place", ("died in", "died at"), "", _WHAT),
    ("nationality", "Person", "Country", ("is a citizen of", "was a citizen of"), "", _WHAT),
    ("worksFor", "Person", "Organization", ("works for", "worked for", "works at", "worked at", "is employed by"), "", _WHAT),
    ("memberOf", "Person", "Organization", ("is a member of", "was a member of", "belongs to", "joined"), "", _WHAT),
    ("alumniOf", "Person", "EducationalOrganization", ("studied at", "graduated from", "was educated at", "attended"), "", _WHAT),
    ("spouse", "Person", "Person", ("married", "is married to", "was married to"), "", _WHAT),
    ("foundedBy", "Organization", "Person", ("was founded by", "was established by"), "", _WHAT),
    ("foundingDate", "Organization", None, ("was founded", "was established"), r"(?: on| in)?", _DATE),
    ("dissolutionDate", "Organization", None, ("was dissolved", "closed"), r"(?: on| in)?", _DATE),
    ("location", "Organization", "Place", ("is located in", "is based in", "is headquartered in", "serves"), "", _WHAT),
    ("containedInPlace", "Place", "Place", ("is a city in", "is a town in", "is part of", "lies in"), "", _WHAT),
    ("addressCountry", "Place", "Country", ("is in the country of", "is a country in"), "", _WHAT),
    ("language", "Country", "Language", ("has the official language",), "", _WHAT),
)
_PATTERNS = tuple((p, kind, of, between, re.compile(f"{_WHO} (?:{'|'.join(between)}){more} {end}")) for p, kind, of, between, more, end in RELATIONS)
_ANY = re.compile("|".join(sorted({w for *_, between, _, _ in RELATIONS for w in between}, key=len, reverse=True)))
_NAME = re.compile(r"[A-ZÀ-Þ][a-zß-ÿ][\w'-]*(?: [A-ZÀ-Þ][a-zß-ÿ][\w'-]*)*")


def context_prompt(known: list[str], text: str) -> str:
    """[FN10] what is asked about a chunk when earlier ones gave these names."""
    return ("Known so far: " + "; ".join(known) + "\n\n" if known else "") + text


def retry_prompt(error: str, detail: str = "") -> str:
    """[FN9, FN10] what is told to a provider about its last answer: what was wrong in its own words, and how to mend it."""
    return f"The last answer can't be used ({error})" + (f": {detail}" if detail else "") + f". {HINTS[error]}"


class RuleProvider:
    """Finds the relations of RELATIONS by patterns, for all subjects. Deterministic.

    One subject makes an object; several make a graph, in the order of their first relation. Without a relation, the text's first name is the document.
    """

    def available(self) -> bool:
        return True

    def answer(self, messages: list[tuple[str, str]]) -> str:
        text = next(t for role, t in reversed(messages) if role == "user" and not t.startswith("The last answer"))
        found: list[tuple[int, int, str, str, str | None, str, str]] = []
        if _ANY.search(text):
            for k, (p, kind, of, between, pattern) in enumerate(_PATTERNS):
                if any(w in text for w in between):
                    found += [(m.start(), k, p, kind, of, m["s"], m["o"]) for m in pattern.finditer(text)]
        nodes: dict[str, dict] = {}
        for _, _, p, kind, of, s, o in sorted(found, key=lambda x: x[:2]):
            node = nodes.setdefault(s, {"@type": kind, "name": s})
            value: object = o.rstrip(".") if of is None else {"@type": of, "name": o}
            if p not in node:
                node[p] = value
            elif value not in (own := node[p] if isinstance(node[p], list) else [node[p]]):
                node[p] = [*own, value]
        if not nodes:
            name = _NAME.search(text)
            nodes[""] = {"@type": "Thing", "name": name.group() if name else "unknown"}
        context = {"@context": "https://schema.org"}
        doc = context | next(iter(nodes.values())) if len(nodes) == 1 else context | {"@graph": list(nodes.values())}
        return "```json\n" + J.dump(doc) + "\n```"


@dataclass(frozen=True)
class Options:
    """[HK1] attempts beyond the first, whether a structure is required, whether the built-in context is put in, and the system text [EXT5]."""

    max_retries: int = 2
    strict: bool = True
    inject_context: bool = True
    system: str = SYSTEM


_FENCE = re.compile(r"```json\s*(.*?)```", re.S)
_BRACES = re.compile(r"\{.*\}", re.S)
HINTS = {  # [FN9]
    "not_json": "The answer isn't valid JSON. Check quotes, commas and brackets.",
    "not_object": "The answer must be one JSON object.",
    "no_context": "The object needs an @context.",
    "no_type": "The object needs an @type, for instance Person, Organization or Place.",
}


def unwrapped(answer: str) -> str:
    """[FN8] for one string."""
    m = _FENCE.search(answer)
    if m and m[1].strip():
        return m[1].strip()
    m = _BRACES.search(answer)
    return m.group() if m else answer.strip()


def read_answer(answer: str) -> tuple[object, str | None, str]:
    """(document, what keeps it from being one, in words) of an answer."""
    try:
        doc = json.loads(unwrapped(answer))
    except ValueError as e:
        return None, "not_json", str(e)
    if not isinstance(doc, dict):
        return doc, "not_object", f"found {type(doc).__name__}"
    if doc.get("@context") is None:
        return doc, "no_context", f"the fields are {', '.join(list(doc)[:20]) or 'none'}"
    return doc, None if "@type" in doc or doc.get("@graph") else "no_type", f"the fields are {', '.join(list(doc)[:20])}"


def extract_one(provider: Provider, prompt: str, options: Options = Options()) -> tuple[str | None, int, str | None, str | None]:
    """(document, attempts, error, its text) [DOM6, HK9]: what an answer lacks is told to the provider, up to max_retries times.

    The built-in context is put in only where an answer has one of its own, or is valid but for that.
    """
    messages = [("system", options.system), ("user", prompt)]
    error, detail = None, ""
    for attempt in range(1, options.max_retries + 2):
        try:
            answer = provider.answer(messages)
        except TransportError as e:
            return None, attempt, "transport", str(e)
        doc, error, detail = read_answer(answer)
        if options.inject_context and isinstance(doc, dict):
            doc = {"@context": J.CONTEXT} | {k: v for k, v in doc.items() if k != "@context"}
            error = None if error == "no_context" and ("@type" in doc or doc.get("@graph")) else "no_type" if error == "no_context" else error
        if error is None or (error == "no_type" and not options.strict):
            return J.dump(J.normalize_document(doc)), attempt, None, None
        messages += [("assistant", answer), ("user", retry_prompt(error, detail))]
    return None, options.max_retries + 1, error, detail


def ready(provider: Callable[[], Provider]) -> Provider:
    """[HK10]"""
    p = provider()
    if not p.available():
        raise RuntimeError("the extraction provider isn't available")
    return p


def extract(texts: DataFrame, provider: Callable[[], Provider] = RuleProvider, options: Options = Options(), column: str = "text") -> DataFrame:
    """texts (with all columns) and jsonld, attempts, error, error_text [DOM9, EXT1]. The provider is made once a task [SRC11]; null texts have nulls and no attempt."""

    @F.pandas_udf("struct<jsonld string, attempts int, error string, error_text string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = ready(provider)
        for s in batches:
            yield pd.DataFrame([(None, None, None, None) if t is None else extract_one(p, t, options) for t in s], columns=["jsonld", "attempts", "error", "error_text"]).astype({"attempts": "Int32"})

    rows = texts.withColumn("__x", run.asNondeterministic()(column))
    return rows.select(*(c for c in texts.columns), "__x.*")


_CHUNK = "chunk_id int, start_char long, end_char long, jsonld string, attempts int, error string, error_text string"


def extract_documents(
    docs: DataFrame, provider: Callable[[], Provider] = RuleProvider, options: Options = Options(), strategy: str = "rules", size: int = SIZE, overlap: int = 0, threshold: int = LONG_DOCUMENT, max_distance: int = MAX_DISTANCE
) -> DataFrame:
    """(doc_id, chunk_id, start_char, end_char, jsonld, attempts, error, error_text): resolve pronouns, chunk, extract each chunk [DOM8].

    Offsets are into the resolved text. No stage looks across chunks, so nothing is shuffled; under the rules and without resolution a text
    crosses to Python once for all three. A chunk that fails has its error; the others of its document don't depend on it.
    """
    if strategy not in ("rules", "none"):
        resolved = resolve(docs, strategy).select("doc_id", F.col("resolved_text").alias("text"))
        return extract(chunk(resolved, size, overlap, threshold), provider, options).drop("text", "start_byte", "end_byte")

    @F.pandas_udf(f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in _CHUNK.split(', '))}>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p, rewriter = ready(provider), Rewriter(max_distance)

        def one(t: str) -> list[tuple]:
            if strategy == "rules":
                t = rewriter.rewrite(t)[0]
            return [(k, lo, hi, *extract_one(p, t[lo:hi], options)) for k, (lo, hi) in enumerate(chunk_spans(t, size, overlap, threshold))]

        for batch in batches:
            for s in T.slices(batch):
                yield pd.Series([[] if t is None else one(t) for t in s], dtype=object)

    return docs.select("doc_id", F.explode(run.asNondeterministic()("text")).alias("c")).select("doc_id", "c.*")


def with_provenance(extracted: DataFrame, method: str = "rules", confidence: float = 1.0) -> DataFrame:
    """extracted with its provenance struct [PRJ6] and jsonld_with_provenance [SNK2]."""
    p = F.struct(F.struct(F.col("start_char").alias("start"), F.col("end_char").alias("end")).alias("textSpan"), F.lit(confidence).alias("confidence"), F.col("chunk_id").alias("chunkId"), F.lit(method).alias("method"))
    rows = extracted.withColumn("provenance", p)
    tail = F.concat(F.lit(',"_provenance":'), F.to_json("provenance"), F.lit("}"))
    return rows.withColumn("jsonld_with_provenance", F.when(F.col("jsonld").isNotNull(), F.concat(F.expr("substring(jsonld, 1, length(jsonld) - 1)"), tail)))


def merge_chunks(extracted: DataFrame, once: bool = False) -> DataFrame:
    """(doc_id, jsonld): one document of each document's chunks, in order [AGG19, SET4]; failed chunks are left out.

    With `once`, objects of one type and name are one object, with the properties of all, the first value of each, and their @ids told apart.
    """

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda parts: J.dump(J.merge_documents([J.load(t) for t in parts], once)))

    parts = F.transform(F.sort_array(F.collect_list(F.when(F.col("jsonld").isNotNull(), F.struct("chunk_id", "jsonld")))), lambda x: x["jsonld"])
    return extracted.groupBy("doc_id").agg(parts.alias("parts")).select("doc_id", run("parts").alias("jsonld"))


def extract_with_context(chunks: DataFrame, provider: Callable[[], Provider] = RuleProvider, options: Options = Options()) -> DataFrame:
    """(doc_id, chunk_id, jsonld, attempts, error, error_text): chunks (doc_id, chunk_id, text) of a document in order, each told the names before it [DOM7].

    For providers that read the context. One shuffle by document; a task streams over sorted chunks and keeps one document's names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, doc, names = provider(), None, []
        for b in batches:
            rows = []
            for d, c, t in zip(b["doc_id"], b["chunk_id"], b["text"]):
                if d != doc:
                    doc, names = d, []
                x, attempts, error, detail = extract_one(p, context_prompt(names, t), options)
                rows.append((d, c, x, attempts, error, detail))
                root = J.load(x) if x else None
                if isinstance(root, dict) and isinstance(root.get("name"), str) and root["name"] not in names:
                    names.append(root["name"])
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "jsonld", "attempts", "error", "error_text"])

    ordered = chunks.filter("text IS NOT NULL").select("doc_id", "chunk_id", "text").repartition("doc_id").sortWithinPartitions("doc_id", "chunk_id")
    return ordered.mapInPandas(run, "doc_id long, chunk_id int, jsonld string, attempts int, error string, error_text string")


def earlier_chunks(extracted: DataFrame) -> DataFrame:
    """extracted and n_failed_before: chunks of the document that failed so far, for reports."""
    before = W.partitionBy("doc_id").orderBy("chunk_id").rowsBetween(W.unboundedPreceding, -1)
    return extracted.withColumn("n_failed_before", F.coalesce(F.count_if(F.col("error").isNotNull()).over(before), F.lit(0)).cast("long"))


__all__ = ["OVERLAP", "SIZE", "Options", "Provider", "RuleProvider", "TransportError", "extract", "extract_documents", "extract_one", "extract_with_context", "merge_chunks", "with_provenance"]
