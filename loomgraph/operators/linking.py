"""Linking names to the labels of a knowledge base.

Names and labels are compared in lower case. Fuzzy candidates are labels that contain the name; the nested loop that
this means is avoided by an exact rewrite: a label is cut only where a name may start, into pieces as long as names with that start, and
pieces are joined with names by equality. What many uris share is worked out once a distinct label.
Either side of a join may be large, however well it compresses, so the joins ask to be merges: none is collected by the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import jsonld as J
from ..functions.text import jaro_winkler_similarity
from .annotation import link_annotated

EXACT_SCORE = 0.95
FUZZY_THRESHOLD = 0.8
MIN_CONFIDENCE = 0.5
GRAM = 3
#: Rows that a broadcast of what names start with may have.
BUCKETS = 1 << 16
#: Forms with characters left out that a name may have; with two left out, names have them up to 44 characters.
MOST_SHORTENED = 1000
#: Characters of a name that a label's start is compared with first.
START = 8


def _names(names: DataFrame) -> DataFrame:
    return names.select("name").filter("name IS NOT NULL AND name <> ''").distinct().withColumn("name_lc", F.lower("name"))


def exact_candidates(names: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, uri, label, confidence) for labels (uri, label) equal to a name but for case [JOIN1, FLT10]."""
    keyed = labels.select("uri", "label", F.lower("label").alias("name_lc"))
    return _names(names).hint("merge").join(keyed, "name_lc").select("name", "uri", "label", F.lit(EXACT_SCORE).alias("confidence"))


def _lower(labels: DataFrame) -> DataFrame:
    return labels.select(F.lower("label").alias("label_lc")).filter("label_lc IS NOT NULL").distinct()


def _bucket(x: Column) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int")


def _held(names: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, name_lc, label_lc), each once, of distinct names and labels: what is contained in what.

    The first GRAM characters of a name, all of a shorter one, tell where it may stand; which lengths go with them is broadcast by
    bucket, so at most BUCKETS rows. A bucket that starts share gives pieces that no name equals.
    """
    start = lambda x, at, size: F.substr(x, at, F.lit(size))
    own = names.withColumn("size", F.length("name_lc"))
    starts = own.groupBy(_bucket(start(F.col("name_lc"), F.lit(1), GRAM)).alias("bucket")).agg(F.collect_set("size").alias("sizes"))
    keys = lambda at: F.array(*(_bucket(start(F.col("label_lc"), at, size)) for size in range(1, GRAM + 1)))
    places = F.transform(F.sequence(F.lit(1), F.length("label_lc")), lambda at: F.struct(at.alias("at"), F.array_distinct(keys(at)).alias("buckets")))
    spots = labels.filter("label_lc <> ''").select("label_lc", F.explode(places).alias("p")).select("label_lc", "p.at", F.explode("p.buckets").alias("bucket"))
    spots = spots.join(F.broadcast(starts), "bucket").select("label_lc", "at", F.explode("sizes").alias("size")).filter("at + size <= length(label_lc) + 1")
    pieces = spots.select("label_lc", F.substr("label_lc", F.col("at"), F.col("size")).alias("name_lc"))
    return names.hint("merge").join(pieces, "name_lc").select("name", "name_lc", "label_lc").distinct()


def _with_uris(found: DataFrame, labels: DataFrame) -> DataFrame:
    """found (label_lc, ..) with the uri and label of each."""
    return found.hint("merge").join(labels.select("uri", "label", F.lower("label").alias("label_lc")), "label_lc")


def containing(names: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, name_lc, uri, label, label_lc): labels that contain the name [FLT11, FN14]."""
    return _with_uris(_held(_names(names), _lower(labels)), labels).select("name", "name_lc", "uri", "label", "label_lc")


def fuzzy_candidates(names: DataFrame, labels: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """(name, uri, label, confidence): labels that contain the name and are similar to it [JOIN2, FLT9, FN5]; similarity is worked out once a pair of strings."""
    score = F.when(F.col("name_lc") == F.col("label_lc"), F.lit(1.0)).otherwise(jaro_winkler_similarity("name_lc", "label_lc"))
    near = _held(_names(names), _lower(labels)).withColumn("confidence", score).filter(F.col("confidence") >= threshold)
    return _with_uris(near.drop("name_lc"), labels).select("name", "uri", "label", "confidence")


def _without(strings: Column) -> Column:
    """Each string without one of its characters, for all characters."""
    shorter = lambda x: F.transform(F.filter(F.sequence(F.lit(1), F.length(x)), lambda i: F.length(x) > 0), lambda i: F.overlay(x, F.lit(""), i, F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(strings, shorter)))


def _shortened(x: Column, most: int) -> list[Column]:
    """By number of characters left out, 0 to most: what is left of x."""
    out = [F.array(x)]
    for _ in range(most):
        out.append(_without(out[-1]))
    return out


def _most_deleted(max_edits: int) -> int:
    """The length up to which a string has at most MOST_SHORTENED forms with max_edits characters left out."""
    n = 0
    while sum(comb(n + 1, k) for k in range(max_edits + 1)) <= MOST_SHORTENED:
        n += 1
    return n


def _hashed(forms: Column, by: Column) -> Column:
    return F.transform(forms, lambda v: F.xxhash64(v, by))


def _typos_by_deletion(own: DataFrame, lab: DataFrame, max_edits: int) -> DataFrame:
    """(name, label_lc), some more than once: pairs with a string in common that is left of both when at most max_edits characters go.

    All pairs within max_edits are among them but for those that replacing characters makes equal. Only lengths that the other side has are looked for.
    """

    def keyed(rows: DataFrame, text: str, other: DataFrame, of: str, turn: bool) -> DataFrame:
        there = other.agg(F.collect_set(F.length(of)).alias("there"))  # a row of a length each, up to that of the names that come here
        forms, n, keys = _shortened(F.col(text), max_edits), F.length(text), []
        for mine in range(max_edits + 1):
            for its in range(max_edits + 1):
                if mine != its or 0 < mine < max_edits:
                    gone = F.lit(f"{its},{mine}" if turn else f"{mine},{its}")
                    keys.append(F.when(F.array_contains("there", n - mine + its), _hashed(forms[mine], gone)).otherwise(F.array().cast("array<long>")))
        return rows.crossJoin(F.broadcast(there)).select(*rows.columns, F.explode(F.flatten(F.array(*keys))).alias("key"))

    a = keyed(own.select("name", "name_lc"), "name_lc", lab, "label_lc", False).drop("name_lc")
    return a.hint("merge").join(keyed(lab, "label_lc", own, "name_lc", True), "key").select("name", "label_lc")


def _near_starts(own: DataFrame, lab: DataFrame, max_edits: int) -> DataFrame:
    """The labels of lab whose start may be that of a name of own within max_edits, and a few others. Starts are compared once each; of those that fit, at most BUCKETS rows are broadcast."""
    forms = lambda x: F.array_distinct(F.transform(F.flatten(F.array(*_shortened(x, max_edits))), lambda v: F.xxhash64(v)))
    starts = own.select(F.substring("name_lc", 1, START).alias("x")).distinct().select(F.explode(forms(F.col("x"))).alias("key")).distinct()
    begun = lambda: F.substring("label_lc", 1, START + max_edits)
    each = lab.select(begun().alias("x")).distinct()
    spots = each.select("x", F.explode(F.array_distinct(F.flatten(F.array(*(forms(F.substring("x", 1, n)) for n in range(START - max_edits, START + max_edits + 1)))))).alias("key"))
    fit = spots.hint("merge").join(starts, "key").select(_bucket(F.col("x")).alias("of")).distinct()
    return lab.withColumn("of", _bucket(begun())).join(F.broadcast(fit), "of", "left_semi").drop("of")


def _typos_by_places(own: DataFrame, lab: DataFrame, max_edits: int) -> DataFrame:
    """(name, label_lc), each once: labels that differ from the name at max_edits places or fewer, by what stands at the other places and where those are."""

    def keyed(rows: DataFrame, text: str) -> DataFrame:
        forms, n = F.array(F.struct(F.array().cast("array<int>").alias("at"), F.lit("").alias("out"), F.col(text).alias("rest"))), F.length(text)
        every = [forms]
        for _ in range(max_edits):
            more = lambda f: F.transform(
                F.filter(F.sequence(F.lit(1), n), lambda i: i > F.coalesce(F.array_max(f["at"]), F.lit(0))),
                lambda i: F.struct(F.array_append(f["at"], i).alias("at"), F.concat(f["out"], F.substr(F.col(text), i, F.lit(1))).alias("out"), F.overlay(f["rest"], F.lit("\0"), i, F.lit(1)).alias("rest")),
            )
            every.append(F.flatten(F.transform(every[-1], more)))
        keys = F.transform(F.flatten(F.array(*every)), lambda f: F.struct(F.xxhash64(f["at"], f["rest"]).alias("key"), f["out"].alias("out")))
        return rows.select(text, *([] if text == "label_lc" else ["name"]), F.explode(keys).alias("f")).select("*", "f.*").drop("f")

    a = keyed(own, "name_lc").withColumnRenamed("out", "own_out").drop("name_lc")
    met = a.hint("merge").join(keyed(lab, "label_lc"), "key").filter(F.length("own_out") == F.length("out"))
    apart = F.lit(True)
    for k in range(1, max_edits + 1):
        apart &= (F.length("out") < k) | (F.substring("own_out", k, 1) != F.substring("out", k, 1))
    return met.filter(apart).select("name", "label_lc")


def _typos_by_parts(own: DataFrame, lab: DataFrame, max_edits: int) -> DataFrame:
    """(name, label_lc), some more than once, all pairs within max_edits among them: of max_edits + 1 parts of a name, one is left whole by the edits and stands in the label at most max_edits places off."""
    parts = max_edits + 1
    step = lambda k: F.floor(F.length("name_lc") * k / parts).cast("int")
    keys = F.array(*(F.struct(F.lit(k).alias("k"), (step(k) + 1).alias("at"), F.substr("name_lc", step(k) + 1, step(k + 1) - step(k)).alias("part")) for k in range(parts)))
    probes = own.select("name", "name_lc", F.length("name_lc").alias("n"), F.explode(keys).alias("p")).select("name", "name_lc", "n", "p.k", "p.at", "p.part")
    lengths = own.select(F.length("name_lc").alias("n")).distinct()
    # A label is cut in the way of each length of name that is near its own.
    around = F.sequence(F.length("label_lc") - max_edits, F.length("label_lc") + max_edits)
    near = lab.select("label_lc", F.explode(around).alias("n")).join(lengths, "n")
    cut = lambda k: F.floor(F.col("n") * k / parts).cast("int")

    def places(k: int) -> Column:
        size = cut(k + 1) - cut(k)
        return F.transform(F.sequence(F.lit(-max_edits), F.lit(max_edits)), lambda d: F.struct(F.lit(k).alias("k"), F.substr("label_lc", F.greatest(F.lit(1), cut(k) + 1 + d), size).alias("part")))

    spots = F.flatten(F.array(*map(places, range(parts))))
    spots = near.select("label_lc", "n", F.explode(F.array_distinct(spots)).alias("s")).select("label_lc", "n", "s.k", "s.part")
    return probes.hint("merge").join(spots, ["n", "k", "part"]).select("name", "label_lc")


def typo_candidates(names: DataFrame, labels: DataFrame, max_edits: int = 2) -> DataFrame:
    """(name, uri, label, edits): labels within max_edits of the name, of at least 3 (max_edits + 1) characters each. Exact.

    Names that differ in a few characters only share all else, so no part of them tells which labels are near; all of them
    but max_edits characters does. Of long names there are too many such forms, and they are compared by parts.
    """
    own = _names(names).filter(F.length("name_lc") >= GRAM * (max_edits + 1))
    most = _most_deleted(max_edits)
    lab, short, long = _lower(labels), own.filter(F.length("name_lc") <= most), own.filter(F.length("name_lc") > most)
    low = lambda n: F.length("label_lc") >= n - max_edits
    near = _near_starts(short, lab.filter(low(GRAM * (max_edits + 1)) & (F.length("label_lc") <= most + max_edits)), max_edits)
    pairs = _typos_by_places(short, near, max_edits).unionByName(_typos_by_deletion(short, near, max_edits)).unionByName(_typos_by_parts(long, lab.filter(low(most + 1)), max_edits))
    edits = F.filter(F.array(F.levenshtein(F.lower("name"), "label_lc", max_edits)), lambda e: e >= 0)  # told once a pair: a filter and a column would each do it
    told = pairs.repartition("label_lc").distinct().select("name", "label_lc", F.explode(edits).alias("edits"))
    return _with_uris(told, labels).select("name", "uri", "label", F.col("edits").cast("long").alias("edits"))


def with_types(candidates: DataFrame, types: DataFrame) -> DataFrame:
    """candidates with the list of their uri's types, empty without any [JOIN3]; a uri with several types stays one candidate."""
    lists = types.groupBy("uri").agg(F.array_sort(F.collect_set("type")).alias("types"))
    return candidates.join(lists, "uri", "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))


def top_candidates(candidates: DataFrame, k: int) -> DataFrame:
    """The k best of each name, with their rank: by confidence, then uri [LIM1, SRT1]."""
    return candidates.withColumn("rank", F.row_number().over(W.partitionBy("name").orderBy(F.desc("confidence"), "uri"))).filter(F.col("rank") <= k)


def best_links(candidates: DataFrame, min_confidence: float = MIN_CONFIDENCE, choose: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(name, uri, label, confidence): one link a name among candidates with enough confidence [FLT8, WIN5, DOM12].

    `choose` gets the candidates of the names that have several and returns one row for each [DOM13]; without it
    the highest confidence wins, and among equals the first uri. The default is one aggregation, combined map-side.
    """
    fit = candidates.filter(F.col("confidence") >= min_confidence)
    if choose is None:
        best = F.min(F.struct((-F.col("confidence")).alias("c"), "uri", "label"))
        return fit.groupBy("name").agg(best.alias("b")).select("name", "b.uri", "b.label", (-F.col("b.c")).alias("confidence"))
    counted = fit.withColumn("n", F.count("*").over(W.partitionBy("name")))
    columns = ["name", "uri", "label", "confidence"]
    return counted.filter("n = 1").select(*columns).unionByName(choose(counted.filter("n > 1").drop("n")).select(*columns))


def ambiguous(candidates: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(name, n_candidates) of the names with at least two."""
    return candidates.filter(F.col("confidence") >= min_confidence).groupBy("name").agg(F.count("*").alias("n_candidates")).filter("n_candidates >= 2")


@dataclass(frozen=True)
class Knowledge:
    """What strategies may use: labels (uri, label), annotations of texts as annotate() gives them, and whether local linking is fuzzy."""

    labels: DataFrame
    annotated: DataFrame | None = None
    fuzzy: bool = True


def _no_candidates(names: DataFrame, given: Knowledge) -> DataFrame:
    return exact_candidates(names, given.labels).filter(F.lit(False))


def _local(names: DataFrame, given: Knowledge) -> DataFrame:
    exact = exact_candidates(names, given.labels)
    if not given.fuzzy:
        return exact
    rest = _names(names).hint("merge").join(_lower(given.labels).withColumnRenamed("label_lc", "name_lc"), "name_lc", "left_anti")
    return exact.unionByName(fuzzy_candidates(rest, given.labels))


def _remote(names: DataFrame, given: Knowledge) -> DataFrame:
    if given.annotated is None:
        raise ValueError("linking by a service needs its annotations")
    return link_annotated(names, given.annotated, 0.0).select("text", "name", "uri", "label", "confidence")


#: [EXT7, HK3] candidates (name, uri, label, confidence) by name of strategy; more can be added. Where a strategy looks at the text that a
#: name is from, names and candidates have the column text too.
STRATEGIES: dict[str, Callable[[DataFrame, Knowledge], DataFrame]] = {
    "none": _no_candidates,
    "wikidata": _no_candidates,  # has no look-up of its own
    "exact": lambda names, given: exact_candidates(names, given.labels),
    "local": _local,
    "remote": _remote,
}


def candidates_by(names: DataFrame, given: Knowledge, strategy: str) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy of linking: {strategy}")
    return STRATEGIES[strategy](names, given)


def link(names: DataFrame, labels: DataFrame, strategy: str = "local", fuzzy: bool = True, annotated: DataFrame | None = None, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """[DOM11, DOM14] (name, uri, label, confidence), one a name, by a strategy of STRATEGIES; with remote, names are (text, name) and the result has the text too."""
    found = candidates_by(names, Knowledge(labels, annotated, fuzzy), strategy)
    return found.filter(F.col("confidence") >= min_confidence) if "text" in found.columns else best_links(found, min_confidence)


def link_documents(docs: DataFrame, labels: DataFrame, strategy: str = "local", fuzzy: bool = True, annotated: DataFrame | None = None, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(doc_id, jsonld, n_names, n_linked) of documents (doc_id, jsonld): each object whose name is linked gets the @id [DOM10, JOIN5, JOIN6].

    The names of all documents are linked once each, and links come back by name. With remote, documents are (doc_id, jsonld, text) and a
    name is looked for in the annotations of its text. A document without links, null or not JSON stays as it is.
    """
    by = ["text", "name"] if strategy == "remote" else ["name"]
    keep = ["doc_id", *(["text"] if strategy == "remote" else [])]
    own = docs.select(*keep, F.explode(J.names(F.col("jsonld"))).alias("name"))
    links = link(own.select(*by).distinct(), labels, strategy, fuzzy, annotated, min_confidence)
    met = own.join(links.select(*by, "uri"), by, "left")
    known = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("uri").isNotNull(), F.struct("name", "uri")))))
    uris = met.select("doc_id", "name", "uri").distinct().groupBy("doc_id").agg(known.alias("uris"), F.count("*").alias("n_names"), F.count("uri").alias("n_linked"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = docs.select("doc_id", "jsonld").join(uris, "doc_id", "left")
    return rows.select("doc_id", J.enriched(F.col("jsonld"), F.when(F.col("n_linked") > 0, F.col("uris"))).alias("jsonld"), zero("n_names"), zero("n_linked"))


def link_rate(names: DataFrame, links: DataFrame) -> DataFrame:
    """(n_linked, n_names) [AGG24]."""
    return _names(names).join(links, "name", "left").agg(F.count("uri").alias("n_linked"), F.count("*").alias("n_names"))


def disambiguation_prompt(name: str, kind: str | None, labels: list[str], scores: list[float]) -> str:
    """[FN10, FN20] a numbered list to choose from."""
    lines = "\n".join(f"{k}. {label} ({score:.2f})" for k, (label, score) in enumerate(zip(labels, scores), 1))
    return f"Which of these is meant by “{name}”" + (f" of type {kind}" if kind else "") + f"? Answer with the number alone.\n{lines}"


def provider_choice(provider: Callable[[], object]) -> Callable[[DataFrame], DataFrame]:
    """A `choose` for best_links() that asks an extraction provider about each ambiguous name, once [DOM13].

    The answer must be a number of the list; a name with any other answer gets no link.
    """

    def choose(candidates: DataFrame) -> DataFrame:
        @F.pandas_udf("int")
        def ask(names: pd.Series, labels: pd.Series, scores: pd.Series) -> pd.Series:
            p, out = provider(), []
            for n, own, x in zip(names, labels, scores):
                answer = p.answer([("user", disambiguation_prompt(n, None, list(own), list(x)))]).strip()
                out.append(int(answer) if answer.isdecimal() and 1 <= int(answer) <= len(own) else 0)
            return pd.Series(out, dtype="int32")

        best_first = F.struct((-F.col("confidence")).alias("c"), "uri", "label", "confidence")
        g = candidates.groupBy("name").agg(F.sort_array(F.collect_list(best_first)).alias("x"))
        asked = g.withColumn("k", ask.asNondeterministic()("name", F.col("x.label"), F.col("x.confidence"))).filter("k > 0")
        return asked.select("name", F.element_at("x", F.col("k")).alias("b")).select("name", "b.uri", "b.label", "b.confidence")

    return choose
