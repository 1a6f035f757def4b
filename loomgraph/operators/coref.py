"""Pronouns and what they refer to.

Two forms of one definition: as relations (mentions by one pass over the text; antecedents and
clusters by windows, with one shuffle of mentions by document), and as a rewrite of the text,
which works inside each row. A name is a run of capitalised words of one sentence; sentences end at
full stops. A pronoun refers to the last agreeing name before it, at most MAX_DISTANCE
sentences back.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T

MAX_DISTANCE = 3

_FORMS = [f for forms in T.PRONOUNS.values() for f in forms]
# Cheap tests come first, so that most words cost one look at their first letter.
_PRONOUN = r"(?<!\S)(?=[^\p{L}\s]*[hHsSiItT])[^\p{L}\s]*(?i:" + "|".join(sorted(_FORMS, key=len, reverse=True)) + r")[^\p{L}\s]*(?!\S)"
_NO_NAME = r"(?!(?:" + "|".join(sorted(T.STOP_WORDS, key=len, reverse=True)) + r")[^\p{L}\s]*(?!\S))(?!" + _PRONOUN.removeprefix(r"(?<!\S)") + ")"
_REST = r"[^\s\p{Lu}\p{Lt}\p{Lm}\p{Lo}]*"
_NAME = rf"(?<!\S)(?=\p{{Lu}}){_NO_NAME}\p{{Lu}}[^\p{{Lu}}\s]\S*(?:\s+(?=\p{{Lu}}){_NO_NAME}\p{{Lu}}{_REST}(?!\S))*"
MENTION = f"{_PRONOUN}|{_NAME}"
_BLANKS = " \t\n\x0b\f\r"
_MENTION_ROWS = "array<struct<sentence:int,ordinal:int,mention:string,pronoun_type:string>>"


def _ascii_blanks(pattern: str) -> str:
    """The pattern with only ASCII's white space parting words."""
    inside = regex.sub(r"(\[\^[^\]]*)\\s", lambda m: m[1] + _BLANKS, pattern)
    return inside.replace(r"\S", f"[^{_BLANKS}]").replace(r"\s", f"[{_BLANKS}]")


class Finder:
    """Names and pronouns of a text, sentence by sentence."""

    def __init__(self):
        self.pattern = regex.compile(_ascii_blanks(MENTION))
        self.kinds = {form: kind for kind, forms in T.PRONOUNS.items() for form in forms}
        self.outer, self.letters, self.gap = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"), regex.compile(r"^[^\p{L}]+|[^\p{L}]+$"), regex.compile(f"[{_BLANKS}]+")

    def find(self, text: str) -> list[tuple[int, int, str, str | None]]:
        """(sentence, ordinal, mention, pronoun_type)"""
        out, number = [], 0
        for part in text.split("."):
            if not part.strip(_BLANKS):
                continue
            for ordinal, raw in enumerate(self.pattern.findall(part)):
                kind = self.kinds.get(raw.lower())
                if kind is None:
                    kind = None if raw.isalpha() else self.kinds.get(self.letters.sub("", raw.lower()))
                    if not raw.isalnum():
                        raw = self.outer.sub("", self.gap.sub(" ", raw))
                out.append((number, ordinal, raw, kind))
            number += 1
        return out


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence, ordinal, mention, pronoun_type): names (without a type) and pronouns in order [DOM3, WIN6].

    Sentences and mentions within a sentence count from 0; blank sentences don't count. Outer punctuation is cut
    off. Null and empty texts have none. Nothing but mentions leaves the scan's stage. Texts cross to Python once, in Arrow
    batches: one pass of a compiled pattern is several times as fast there as in Java's matcher.
    """

    @F.pandas_udf(_MENTION_ROWS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = Finder()
        for batch in batches:
            for s in T.slices(batch):
                yield pd.Series([[] if t is None else f.find(t) for t in s], dtype=object)

    return docs.select("doc_id", F.explode(run("text")).alias("m")).select("doc_id", "m.*")


def _last_name(kind: str):
    fits = F.col("pronoun_type").isNull() & T.agrees(F.col("mention"), kind)
    return F.max(F.when(fits, F.struct("sentence", "ordinal", "mention")))


def antecedents(found: DataFrame, max_distance: int = MAX_DISTANCE, whole_sentence: bool = False) -> DataFrame:
    """(doc_id, sentence, ordinal, pronoun, pronoun_type, antecedent) for the pronouns of mentions() [JOIN7, FLT18].

    antecedent is null where no name agrees. With whole_sentence, names that follow the pronoun in its own sentence
    are candidates too, and the last one wins. One window over narrow rows: the last name before a pronoun stands in its own
    sentence or, if none does, in the last that has one, which may be too far back.
    """
    # Frames that only grow.
    own = W.partitionBy("doc_id")
    before = own.orderBy("sentence").rangeBetween(W.unboundedPreceding, 0) if whole_sentence else own.orderBy("sentence", "ordinal").rowsBetween(W.unboundedPreceding, -1)
    same = {"feminine": "masculine"}  # they agree with the same names
    rows = found.select("*", *(_last_name(k).over(before).alias(f"last_{k}") for k in T.PRONOUNS if k not in same))
    best = F.lit(None).cast("string")
    for k in T.PRONOUNS:
        last = F.col(f"last_{same.get(k, k)}")
        best = F.when(F.col("pronoun_type") == k, F.when(last["sentence"] >= F.col("sentence") - max_distance, last["mention"])).otherwise(best)
    return rows.filter("pronoun_type IS NOT NULL").select("doc_id", "sentence", "ordinal", F.col("mention").alias("pronoun"), "pronoun_type", best.alias("antecedent"))


def clusters(resolved: DataFrame) -> DataFrame:
    """(doc_id, antecedent, n_pronouns, pronouns, first_sentence): the pronouns of each name [AGG16]."""
    order = F.struct("sentence", "ordinal", "pronoun")
    g = resolved.filter("antecedent IS NOT NULL").groupBy("doc_id", "antecedent")
    return g.agg(F.count("*").alias("n_pronouns"), F.transform(F.sort_array(F.collect_list(order)), lambda x: x["pronoun"]).alias("pronouns"), F.min("sentence").alias("first_sentence"))


def mention_map(resolved: DataFrame) -> DataFrame:
    """(doc_id, pronoun, antecedent): what each form of pronoun, in lower case, refers to last in a document [AGG17]."""
    at = F.struct("sentence", "ordinal")
    return resolved.filter("antecedent IS NOT NULL").groupBy("doc_id", F.lower("pronoun").alias("pronoun")).agg(F.max_by("antecedent", at).alias("antecedent"))


def guided_antecedents(found: DataFrame, entities: DataFrame) -> DataFrame:
    """[DOM4, JOIN8] pronouns of mentions() with the last of entities (doc_id, sentence, entity) in an earlier sentence."""
    e = entities.select("doc_id", "sentence", F.lit(0).alias("ordinal"), F.lit(None).cast("string").alias("pronoun"), F.lit(None).cast("string").alias("pronoun_type"), "entity")
    p = found.filter("pronoun_type IS NOT NULL").select("doc_id", "sentence", "ordinal", F.col("mention").alias("pronoun"), "pronoun_type", F.lit(None).cast("string").alias("entity"))
    before = W.partitionBy("doc_id").orderBy("sentence").rangeBetween(W.unboundedPreceding, -1)
    last = F.max(F.when(F.col("entity").isNotNull(), F.struct("sentence", "entity"))).over(before)
    return e.unionByName(p).withColumn("antecedent", last["entity"]).filter("pronoun_type IS NOT NULL").drop("entity")


def rewrite_guided(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """[DOM4] (doc_id, resolved_text, n_replaced): pronouns replaced by the last of entities (doc_id, sentence, entity) in an earlier sentence.

    guided_antecedents() has the same choices as rows, which clusters() and mention_map() take. Documents without entities stay as they
    are; null texts stay null. A document's entities are joined with it, so only they and texts with one are shuffled by document.
    """

    @F.pandas_udf("struct<resolved_text string, n_replaced long>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        r = Rewriter()
        for texts, told in batches:
            for s in T.slices(texts):
                rows = zip(s, told.loc[s.index])
                yield pd.DataFrame([(None, None) if t is None else r.rewrite(t, () if k is None else [(e["sentence"], e["entity"]) for e in json.loads(k)]) for t, k in rows], columns=["resolved_text", "n_replaced"]).astype({"n_replaced": "Int64"})

    # One text a document crosses to Python, and not an object for each entity.
    own = entities.groupBy("doc_id").agg(F.to_json(F.sort_array(F.collect_set(F.struct("sentence", "entity")))).alias("known"))
    return docs.select("doc_id", "text").join(own, "doc_id", "left").select("doc_id", run("text", "known").alias("r")).select("doc_id", "r.*")


class Rewriter:
    """Replaces the pronouns of a text by their antecedents; a possessive form gets 's."""

    def __init__(self, max_distance: int = MAX_DISTANCE):
        self.pattern = regex.compile(MENTION)
        self.pronoun = regex.compile(_PRONOUN.replace(r"\s", r"\s.").replace(r"\S", r"[^\s.]"))  # full stops end words here
        self.kinds = {form: kind for kind, forms in T.PRONOUNS.items() for form in forms}
        self.reach = max_distance
        self.owns = frozenset("his hers its their theirs".split())

    def fits(self, name: str, kind: str) -> bool:
        if kind in ("masculine", "feminine"):
            return len(name.split()) <= 3 and " and " not in name.lower()
        if kind == "neutral":
            return any(m in name for m in T.ORGANISATION_MARKS)
        return " and " in name or name.endswith("s")

    def spans(self, text: str, known: list[tuple[int, str]] | None = None) -> list[tuple[int, int, str]]:
        """(start, end, replacement), left to right; with known (sentence, name) in order, a pronoun is the last of an earlier sentence."""
        out, last, number, start = [], {}, 0, 0
        if not self.pronoun.search(text):
            return out
        for part in text.split("."):
            if part.strip():
                for m in self.pattern.finditer(part):
                    lo, hi = m.span()
                    while not part[lo].isalnum() and lo < hi - 1:
                        lo += 1
                    while not part[hi - 1].isalnum() and hi > lo + 1:
                        hi -= 1
                    bare = part[lo:hi]
                    kind = self.kinds.get(bare.lower())
                    if known is not None:
                        at = bisect_left(known, (number, ""))
                        if kind is not None and at:
                            out.append((start + lo, start + hi, known[at - 1][1] + ("'s" if bare.lower() in self.owns else "")))
                    elif kind is None:
                        for k in T.PRONOUNS:
                            if self.fits(bare, k):
                                last[k] = (number, bare)
                    elif kind in last and number - last[kind][0] <= self.reach:
                        out.append((start + lo, start + hi, last[kind][1] + ("'s" if bare.lower() in self.owns else "")))
                number += 1
            start += len(part) + 1
        return out

    def rewrite(self, text: str, known: list[tuple[int, str]] | None = None) -> tuple[str, int]:
        spans, at, parts = self.spans(text, known), 0, []
        for lo, hi, new in spans:
            parts += [text[at:lo], new]
            at = hi
        return "".join([*parts, text[at:]]), len(spans)


def rewrite_pronouns(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, resolved_text, n_replaced): null texts stay null [DOM3, FN13]. No shuffle."""

    @F.pandas_udf("struct<resolved_text string, n_replaced long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        r = Rewriter(max_distance)
        for batch in batches:
            for s in T.slices(batch):
                yield pd.DataFrame([(None, None) if t is None else r.rewrite(t) for t in s], columns=["resolved_text", "n_replaced"]).astype({"n_replaced": "Int64"})

    return docs.select("doc_id", run("text").alias("r")).select("doc_id", "r.*")


def resolve(docs: DataFrame, strategy: str = "rules", provider: Callable[[], Callable[[str], str]] | None = None) -> DataFrame:
    """[DOM2, DOM3, DOM5, SRC12] (doc_id, resolved_text, n_replaced) under a strategy: none, rules, provider.

    A provider, made once a task, turns a text into the resolved one; where it fails the text stays as it is and
    n_replaced is null. It is called once a distinct text of a batch.
    """
    if strategy == "none":
        return docs.select("doc_id", F.col("text").alias("resolved_text"), F.when(F.col("text").isNotNull(), F.lit(0).cast("long")).alias("n_replaced"))
    if strategy == "rules":
        return rewrite_pronouns(docs)
    if strategy == "provider" and provider is not None:

        @F.pandas_udf("struct<resolved_text string, n_replaced long>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            p = provider()

            def one(t: str) -> tuple[str, int | None]:
                try:
                    new = p(t)
                except Exception:  # whatever a service throws; the row says so by its null
                    return t, None
                return new, int(new != t)

            for s in batches:
                known = {t: one(t) for t in dict.fromkeys(s.dropna())}
                yield pd.DataFrame([(None, None) if t is None else known[t] for t in s], columns=["resolved_text", "n_replaced"]).astype({"n_replaced": "Int64"})

        return docs.select("doc_id", run.asNondeterministic()("text").alias("r")).select("doc_id", "r.*")
    raise ValueError(f"no such strategy of resolution: {strategy}")


def simple_antecedents(docs: DataFrame) -> DataFrame:
    """(doc_id, position, pronoun, pronoun_type, antecedent): each pronoun with the last capitalised word of three letters or more before it [DOM5, JOIN9, FLT25].

    Positions are those of words in the text; outer punctuation doesn't count. Neither agreement nor distance is looked at. No shuffle.
    """

    @F.pandas_udf("array<struct<position:int,pronoun:string,pronoun_type:string,antecedent:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = LastCapitalised()
        for batch in batches:
            for s in T.slices(batch):
                yield pd.Series([[] if t is None else f.find(t) for t in s], dtype=object)

    return docs.select("doc_id", F.explode(run("text")).alias("p")).select("doc_id", "p.*")


class LastCapitalised:
    """The pronouns of a text, each with the last capitalised word before it."""

    MOST = 100_000  # words that are kept

    def __init__(self):
        self.kinds = {form: kind for kind, forms in T.PRONOUNS.items() for form in forms}
        self.words, self.outer, self.letters = regex.compile(f"[^{_BLANKS}]+"), regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\Z"), regex.compile(r"^[^\p{L}]+|[^\p{L}]+\Z")
        self.name = regex.compile(r"\p{Lu}[^\n\r\x85\u2028\u2029]{2}")
        self.known: dict[str, tuple[str, str | None] | None] = {}

    def told(self, word: str) -> tuple[str, str | None] | None:
        """(word without outer punctuation, type of pronoun), or None for what is neither pronoun nor name."""
        bare = self.outer.sub("", word)
        kind = self.kinds.get(self.letters.sub("", bare.lower()))
        return (bare, kind) if kind or self.name.match(bare) and bare not in ("The", "A", "An", "This") else None

    def find(self, text: str) -> list[tuple[int, str, str, str | None]]:
        out, last, known = [], None, self.known
        for k, w in enumerate(self.words.findall(text)):
            try:
                x = known[w]
            except KeyError:
                if len(known) >= self.MOST:
                    known.clear()
                x = known[w] = self.told(w)
            if x is not None:
                if x[1] is None:
                    last = x[0]
                else:
                    out.append((k, x[0], x[1], last))
        return out
