"""What a document has told so far: entities by name, their aliases and properties, chunk by chunk.

Input is rows (doc_id, chunk_id, offset, name, type); names are compared by lower case. All
orders are total, so results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_NAME = "name"


def first_wins(found: DataFrame) -> DataFrame:
    """(doc_id, name_lc, name, type, chunk_id, offset, n_mentions): the first mention decides [AGG1]."""
    order = F.struct("chunk_id", "offset", "name", "type")
    return found.groupBy("doc_id", F.lower(_NAME).alias("name_lc")).agg(F.min(order).alias("m"), F.count("*").alias("n_mentions")).select("doc_id", "name_lc", "m.name", "m.type", "m.chunk_id", "m.offset", "n_mentions")


def properties(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, name_lc, property, value): of (doc_id, chunk_id, name, property, value) the last chunk's value, for known entities only [AGG3]."""
    last = rows.groupBy("doc_id", F.lower(_NAME).alias("name_lc"), "property").agg(F.max(F.struct("chunk_id", "value"))["value"].alias("value"))
    return last.join(known.select("doc_id", "name_lc"), ["doc_id", "name_lc"], "left_semi")


def aliases(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, name_lc, aliases): of (doc_id, chunk_id, name, alias), in order of first use, each once.

    An alias counts only if its entity was known in an earlier chunk [AGG2].
    """
    first = rows.groupBy("doc_id", F.lower(_NAME).alias("name_lc"), F.lower("alias").alias("alias")).agg(F.max("chunk_id").alias("late"), F.collect_set("chunk_id").alias("chunks"))
    k = known.select("doc_id", "name_lc", F.col("chunk_id").alias("since"))
    own = first.join(k, ["doc_id", "name_lc"]).withColumn("at", F.array_min(F.filter("chunks", lambda c: c > F.col("since")))).filter("at IS NOT NULL")
    return own.groupBy("doc_id", "name_lc").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "alias"))), lambda x: x["alias"]).alias("aliases"))


def canonical_of_alias(names: DataFrame, alias_lists: DataFrame) -> DataFrame:
    """(doc_id, alias, name_lc): which entity an alias belongs to; the smallest name if several claim it [JOIN16]."""
    owners = alias_lists.select("doc_id", F.explode("aliases").alias("alias"), "name_lc").groupBy("doc_id", "alias").agg(F.min("name_lc").alias("name_lc"))
    return names.select("doc_id", F.lower("name").alias("alias")).distinct().join(owners, ["doc_id", "alias"])


def last_of_type(known: DataFrame) -> DataFrame:
    """(doc_id, type, name): the entity that was first mentioned last [AGG6]."""
    return known.groupBy("doc_id", "type").agg(F.max_by("name", F.struct("chunk_id", "offset", "name_lc")).alias("name"))


def prefix_state(found: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, n_known, known): names that earlier chunks of the document gave, for every chunk with a mention [WIN3].

    A name enters the state once, with its first chunk, so the window passes over distinct names and not over mentions.
    """
    first = first_wins(found).select("doc_id", "chunk_id", "name_lc")
    at = found.select("doc_id", "chunk_id").distinct()
    new = first.groupBy("doc_id", "chunk_id").agg(F.sort_array(F.collect_list("name_lc")).alias("new"))
    before = W.partitionBy("doc_id").orderBy("chunk_id").rowsBetween(W.unboundedPreceding, -1)
    rows = at.join(new, ["doc_id", "chunk_id"], "left")
    known = F.array_sort(F.flatten(F.collect_list("new").over(before)))
    return rows.select("doc_id", "chunk_id", known.alias("known")).select("doc_id", "chunk_id", F.size("known").cast("long").alias("n_known"), "known")


def _line() -> Column:
    return F.concat(F.lit("- "), "name", F.lit(" ("), F.coalesce("type", F.lit("Thing")), F.lit(")"))


def _also() -> Column:
    return F.when(F.size("aliases") > 0, F.concat(F.lit(" [also called: "), F.array_join("aliases", ", "), F.lit("]"))).otherwise("")


def context_summary(known: DataFrame, alias_lists: DataFrame | None = None, props: DataFrame | None = None) -> DataFrame:
    """(doc_id, summary): a line for each entity, by name, under a heading [AGG7]."""
    rows = known.select("doc_id", "name_lc", _line().alias("line"))
    if alias_lists is not None:
        rows = rows.join(alias_lists, ["doc_id", "name_lc"], "left").withColumn("line", F.concat("line", _also()))
    if props is not None:
        own = props.groupBy("doc_id", "name_lc").agg(F.array_join(F.sort_array(F.collect_list(F.concat("property", F.lit(": "), "value"))), ", ").alias("told"))
        rows = rows.join(own, ["doc_id", "name_lc"], "left").withColumn("line", F.concat("line", F.when(F.col("told").isNotNull(), F.concat(F.lit(" ["), "told", F.lit("]"))).otherwise("")))
    return _headed(rows)


def _headed(rows: DataFrame) -> DataFrame:
    lines = F.transform(F.sort_array(F.collect_list(F.struct("name_lc", "line"))), lambda x: x["line"])
    return rows.groupBy("doc_id").agg(F.concat(F.lit("Entities known from earlier chunks:\n"), F.array_join(lines, "\n")).alias("summary"))


def summary_of(found: DataFrame) -> DataFrame:
    """(doc_id, summary): context_summary() of first_wins() and aliases() of the same rows (doc_id, chunk_id, offset, name, type, alias).

    The rows are read once, and an entity's aliases are gathered with its first mention, so there is no join.
    """
    used = F.collect_set(F.struct(F.lower("alias").alias("alias"), "chunk_id"))
    own = found.groupBy("doc_id", F.lower(_NAME).alias("name_lc")).agg(F.min(F.struct("chunk_id", "offset", "name", "type")).alias("m"), used.alias("used"))
    own = own.select("doc_id", "name_lc", "m.name", "m.type", F.filter("used", lambda u: u["chunk_id"] > F.col("m.chunk_id")).alias("later"))
    since = lambda a: F.array_min(F.transform(F.filter("later", lambda u: u["alias"].eqNullSafe(a)), lambda u: u["chunk_id"]))
    first = F.transform(F.array_distinct(F.transform("later", lambda u: u["alias"])), lambda a: F.struct(since(a).alias("at"), a.alias("alias")))
    rows = own.withColumn("aliases", F.transform(F.sort_array(first), lambda x: x["alias"]))
    return _headed(rows.select("doc_id", "name_lc", F.concat(_line(), _also()).alias("line")))


def shared_entities(found: DataFrame) -> DataFrame:
    """(name_lc, n_docs): names that more than one document mentions [JOIN14, DOM26]; an aggregate, not a self join, so a name in all documents costs no more than another."""
    return found.groupBy(F.lower(_NAME).alias("name_lc")).agg(F.count_distinct("doc_id").alias("n_docs")).filter("n_docs > 1")


def has_entity(names: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of (doc_id, name, ..) whose document knows the name, letters' case aside [FLT22]."""
    return names.withColumn("name_lc", F.lower("name")).join(known.select("doc_id", "name_lc"), ["doc_id", "name_lc"], "left_semi").select(*names.columns)


def entity_of(names: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, asked, name, type, chunk_id, offset): the entity of each asked name that its document knows [JOIN17]."""
    asked = names.select("doc_id", F.col("name").alias("asked"), F.lower("name").alias("name_lc")).distinct()
    return asked.join(known, ["doc_id", "name_lc"]).select("doc_id", "asked", "name", "type", "chunk_id", "offset")


def counts(known: DataFrame) -> DataFrame:
    """(doc_id, type, n): entities of each type, and of all with a null type [AGG4, AGG5]."""
    return known.groupBy("doc_id", "type").agg(F.count("*").alias("n")).unionByName(known.groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("type", F.lit(None).cast("string")))
