"""Rules that a document must satisfy, and how much each violation costs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonld as J
from ..functions import text as T

RULE_SCHEMA = "rule string, entity_type string, required array<string>, severity string"
BUILT_IN = [(f"{t} needs a name", t, ["name"], "error") for t in ("Event", "Organization", "Person", "Place")]
DATE_FIELDS = ("dateCreated", "datePublished", "deathDate", "birthDate")
IMPACT = {"structure": -0.5, "missing": -0.2, "ask": -0.15, "date": -0.05, "url": -0.1}
#: Rules become part of the plan, so there may not be any number of them.
MOST_RULES = 1000
VIOLATION = ("doc_id", "rule", "property", "severity", "confidence_impact")


@dataclass(frozen=True)
class Settings:
    """[DOM17] min_confidence: what a document needs to be valid; strict_dates: dates must exist, not only look like one."""

    min_confidence: float = 0.7
    strict_dates: bool = False


def rule_frame(spark: SparkSession, extra: list[tuple[str, str | None, list[str], str]] = (), built_in: bool = True) -> DataFrame:
    """Rules as rows; a null type stands for every document [EXT3, SET6]."""
    return spark.createDataFrame([*(BUILT_IN if built_in else ()), *extra], RULE_SCHEMA)


def _present(v: Column, name: str) -> Column:
    field = F.try_variant_get(v, f"$['{name}']", "variant")
    return field.isNotNull() & ~F.is_variant_null(field)


def _found(v: Column, text: Column, rules: list, settings: Settings) -> Column:
    """An array of (rule, property, severity, confidence_impact): all that is wrong with a document, of which v is the parsed form."""
    one = lambda rule, prop, severity, impact: F.struct(F.lit(rule).alias("rule"), (prop if isinstance(prop, Column) else F.lit(prop)).alias("property"), F.lit(severity).alias("severity"), F.lit(impact).alias("confidence_impact"))
    broken, kind = J.structural_error_of(v, text), J.root_string(v, "@type")
    dated = T.is_iso_date if settings.strict_dates else T.is_date_shaped
    raw = lambda name: F.try_variant_get(v, f"$['{name}']", "string")
    is_text = lambda name: F.coalesce(J.root_string(v, name).isNotNull(), F.lit(False))
    checks = []
    for r in rules:
        applies = F.lit(True) if r["entity_type"] is None else kind == r["entity_type"]
        checks += [F.when(applies & ~_present(v, name), one(r["rule"], name, r["severity"], IMPACT["missing"])) for name in dict.fromkeys(r["required"] or ())]
    checks += [F.when(raw(d).isNotNull() & ~(is_text(d) & F.coalesce(dated(raw(d)), F.lit(False))), one("date form", d, "warning", IMPACT["date"])) for d in DATE_FIELDS]
    own = J.root_string(v, "@id")
    checks.append(F.when(own.isNotNull() & ~T.is_url(own), one("url form", "@id", "warning", IMPACT["url"])))
    return F.when(broken.isNotNull(), F.array(one("structure", broken, "error", IMPACT["structure"]))).otherwise(F.array_compact(F.array(*checks)))


def _judged(docs: DataFrame, rules: DataFrame, settings: Settings, text: str) -> DataFrame:
    """(doc_id, found): one scan, one parse and no join; a rule is part of the expression."""
    parsed = docs.select("doc_id", F.col(text).alias("text"), F.try_parse_json(text).alias("v"))
    return parsed.select("doc_id", _found(F.col("v"), F.col("text"), _few(rules), settings).alias("found"))


def _few(rules: DataFrame) -> list:
    given = rules.limit(MOST_RULES + 1).collect()
    if len(given) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return given


def violations(docs: DataFrame, rules: DataFrame, settings: Settings = Settings(), text: str = "jsonld") -> DataFrame:
    """(doc_id, rule, property, severity, confidence_impact) of documents (doc_id, text) [DOM18, JOIN10, JOIN11].

    A document with a broken structure has that one violation. Rules look at the root. There may be MOST_RULES of them.
    """
    # Before a plain explode the optimizer puts a filter on the array's size, for which all of it would be worked out twice.
    return _judged(docs, rules, settings, text).select("doc_id", F.explode_outer("found").alias("x")).filter("x IS NOT NULL").select("doc_id", "x.*")


def ask_violations(answers: DataFrame, rule: str) -> DataFrame:
    """Violations of (doc_id, answer): documents for which a rule's question is answered with no [DOM16]."""
    return answers.filter(~F.col("answer")).select("doc_id", F.lit(rule).alias("rule"), F.lit(None).cast("string").alias("property"), F.lit("warning").alias("severity"), F.lit(IMPACT["ask"]).alias("confidence_impact"))


def cardinality_violations(triples: DataFrame, predicate: str, at_most: int) -> DataFrame:
    """Violations for subjects with more than at_most objects of a predicate in (doc_id, s, p, o)."""
    n = triples.filter(F.col("p") == predicate).groupBy("doc_id", "s").agg(F.count_distinct("o").alias("n"))
    return n.filter(F.col("n") > at_most).select("doc_id", F.lit("cardinality").alias("rule"), F.lit(predicate).alias("property"), F.lit("warning").alias("severity"), F.lit(IMPACT["missing"]).alias("confidence_impact"))


def direction_violations(triples: DataFrame, types: DataFrame, domain: dict[str, str]) -> DataFrame:
    """Violations for triples whose subject, by types (doc_id, s, type), isn't of the type that domain asks for its predicate."""
    d = triples.sparkSession.createDataFrame(list(domain.items()), "p string, wanted string")
    wrong = triples.join(F.broadcast(d), "p").join(types, ["doc_id", "s"]).filter("type <> wanted")
    return wrong.select("doc_id", F.lit("direction").alias("rule"), F.col("p").alias("property"), F.lit("warning").alias("severity"), F.lit(IMPACT["date"]).alias("confidence_impact"))


def _verdict(impact: Column, n_errors: Column, n_warnings: Column, settings: Settings) -> list[Column]:
    confidence = F.round(T.clamp(F.lit(1.0) + F.coalesce(impact, F.lit(0.0))), 6)
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return [((whole(n_errors) == 0) & (confidence >= settings.min_confidence)).alias("valid"), confidence.alias("confidence"), whole(n_errors).alias("n_errors"), whole(n_warnings).alias("n_warnings")]


def with_verdict(docs: DataFrame, rules: DataFrame, settings: Settings = Settings(), text: str = "jsonld") -> DataFrame:
    """docs, with all their columns, and valid, confidence, n_errors, n_warnings [DOM18]: violations() and verdicts() in one narrow pass."""
    rows = docs.withColumn("__v", F.try_parse_json(text)).withColumn("__found", _found(F.col("__v"), F.col(text), _few(rules), settings))
    impact = F.aggregate("__found", F.lit(0.0), lambda n, x: n + x["confidence_impact"])
    n = lambda severity: F.size(F.filter("__found", lambda x: x["severity"] == severity))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), *_verdict(impact, n("error"), n("warning"), settings))


def validate(docs: DataFrame, rules: DataFrame, settings: Settings = Settings(), text: str = "jsonld") -> DataFrame:
    """(doc_id, valid, confidence, n_errors, n_warnings) of every row of docs."""
    return with_verdict(docs.select("doc_id", text), rules, settings, text).drop(text)


def verdicts(docs: DataFrame, found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, valid, confidence, n_errors, n_warnings) of every document, for violations from wherever [AGG13, AGG14, AGG15, FLT20, FLT21]."""
    g = found.groupBy("doc_id").agg(F.sum("confidence_impact").alias("impact"), F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"))
    rows = docs.select("doc_id").join(g, "doc_id", "left")
    return rows.select("doc_id", *_verdict(F.col("impact"), F.col("n_errors"), F.col("n_warnings"), settings))
