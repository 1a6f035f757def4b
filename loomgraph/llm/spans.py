"""Substring deduplication over sliding runs of consecutive sentences.

Sentences end at a full stop, question or exclamation mark followed by white
space, or at a line's end. Every run of RUN consecutive sentences is hashed (a text
of fewer sentences is one run); runs are grouped over the whole corpus; in every run
but the first of its group the sentences are marked. Marked runs that overlap or touch
are one range, and a document loses the sentences of its ranges of MIN_WORDS words or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, fresh_name, quoted, text_frame

RUN = 2
#: Ranges of fewer words than this are left alone: chance repeats a few short sentences. Runs of any length are hashed.
MIN_WORDS = 16
_BORDER = r"(?<=[.!?])[ \t\f\r]+|[ \t\f\r]*\n[ \t\f\r]*"


def sentences(text: str = "text"):
    return F.filter(F.split(F.col(text), _BORDER), lambda s: F.trim(s) != "")


def _runs(texts: DataFrame, run: int) -> DataFrame:
    """(a, b, doc_id, at, words): a 128-bit hash of every run, the index of its first sentence and the words of each of its sentences."""
    s, n = F.col("s"), F.col("n")
    starts = F.sequence(F.lit(0), F.greatest(F.size(s) - run, F.lit(0)))
    as_text = F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_join(F.slice(s, i + 1, run), "\n").alias("run"), F.slice(n, i + 1, run).alias("words")))
    split = texts.select("doc_id", sentences().alias("s")).filter(F.size("s") > 0)
    counted = split.withColumn("n", F.transform("s", lambda x: F.size(F.split(F.trim(x), r"\s+"))))
    return counted.select("doc_id", F.explode(as_text).alias("r")).select(F.xxhash64("r.run").alias("a"), F.xxhash64(F.lit(7), "r.run", F.lit(13)).alias("b"), "doc_id", "r.at", "r.words")


def repeated_spans(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, first_sentence, last_sentence, first_id): maximal ranges of sentences to remove, of min_words words at least.

    Indices count a document's non-blank sentences from 0; first_id is the smallest doc_id that holds
    a run of the range. Occurrences are ordered by (doc_id, sentence), so the first one always stays, whichever
    document it is in; a document can repeat itself. Null and empty texts have no sentences; a text of fewer than `run`
    sentences is one run as a whole. Very long texts are taken whole, a row a run. Rows without an id are left out; of rows that
    repeat an id, all runs count as that document's, at their own indices. Other columns are ignored.

    The groups' least ids and sizes are combined before they are shuffled, and only runs that occur
    again are joined with them, so no task holds a group.
    """
    runs = cut(_runs(text_frame(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL"), run))
    groups = runs.groupBy("a", "b").agg(F.min("doc_id").alias("from_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = runs.join(groups, ["a", "b"]).repartition("doc_id")
    order = F.row_number().over(W.partitionBy("doc_id", "a", "b").orderBy("at"))
    again = met.withColumn("nth", order).filter((F.col("doc_id") != F.col("from_id")) | (F.col("nth") > 1)).groupBy("doc_id", "at").agg(F.min("from_id").alias("from_id"), F.max("words").alias("words"))
    by_doc = W.partitionBy("doc_id").orderBy("at")
    reach = F.max(F.col("at") + F.size("words")).over(by_doc.rowsBetween(W.unboundedPreceding, -1))
    seen = again.withColumn("reach", F.coalesce(reach, F.lit(-1)))
    islands = seen.withColumn("island", F.sum(F.when(F.col("at") <= F.col("reach"), 0).otherwise(1)).over(by_doc.rowsBetween(W.unboundedPreceding, 0)))
    new = F.aggregate(F.slice("words", F.greatest(F.col("reach") - F.col("at"), F.lit(0)) + 1, F.size("words")), F.lit(0), lambda x, y: x + y)
    ranges = islands.groupBy("doc_id", "island").agg(F.min("at").alias("first_sentence"), (F.max(F.col("at") + F.size("words")) - 1).alias("last_sentence"), F.min("from_id").alias("first_id"), F.sum(new).alias("n"))
    return ranges.filter(F.col("n") >= min_words).drop("island", "n")


def remove_repeated_spans(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, with all their columns, without the sentences of repeated_spans().

    Documents that lose nothing keep their text as it is; in the others what remains is joined by
    blanks (an empty text if nothing does). Null and empty texts and rows without an id stay as they are; every row that repeats
    an id loses the sentences listed for the id.
    """
    spans, key = fresh_name(docs, "spans"), fresh_name(docs, "key")
    found = repeated_spans(docs, run, min_words).groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("first_sentence", "last_sentence")).alias(spans))
    kept = F.filter(sentences(), lambda s, i: ~F.exists(F.col(spans), lambda x: i.between(x["first_sentence"], x["last_sentence"])))
    new = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.array_join(kept, " "))
    return docs.join(found, docs["doc_id"] == found[key], "left").withColumn("text", new).select(*map(quoted, docs.columns))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repeated_spans() of all documents: a row a range to remove; documents without one (null and empty texts among them) have no row."""
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of all documents without the sentences of op8_sentence_spans(): a row a document; texts that lose nothing, null and empty ones stay as they are."""
    return remove_repeated_spans(text_frame(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP8_SQL = r"""
WITH s AS (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\f\r]+', '\1' || chr(10), 'g'), '[ \t\f\r]*\n[ \t\f\r]*'), lambda x: trim(x) <> '') AS s
  FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, s, list_transform(s, lambda x: len(regexp_split_to_array(trim(x), '\s+'))) AS n, unnest(range(0, greatest(len(s) - 1, 1))) AS pos FROM s WHERE len(s) > 0),
runs AS (SELECT doc_id, pos, array_to_string(s[pos + 1 : pos + 2], chr(10)) AS run, n[pos + 1] AS n1, coalesce(n[pos + 2], 0) AS n2, least(2, len(n) - pos) AS size FROM c),
f AS (SELECT doc_id, pos, n1, n2, size, first_value(doc_id) OVER w AS from_id, row_number() OVER w AS n
      FROM runs WINDOW w AS (PARTITION BY run ORDER BY doc_id, pos)),
g AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 2, -1) AS reach FROM f WHERE n > 1),
i AS (SELECT *, sum(CASE WHEN pos <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island,
             CASE WHEN pos < reach THEN n2 ELSE n1 + n2 END AS words FROM g)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS first_sentence, CAST(max(pos + size) - 1 AS INTEGER) AS last_sentence, min(from_id) AS first_id
FROM i GROUP BY doc_id, island HAVING sum(words) >= 16
"""

#: The removal of what OP8_SQL lists.
OP8_TEXTS_SQL = rf"""
WITH spans AS ({OP8_SQL}),
gone AS (SELECT doc_id, flatten(list(range(first_sentence, last_sentence + 1))) AS gone FROM spans GROUP BY doc_id),
d AS (SELECT doc_id, text, list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\f\r]+', '\1' || chr(10), 'g'), '[ \t\f\r]*\n[ \t\f\r]*'), lambda x: trim(x) <> '') AS s
      FROM documents)
SELECT d.doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(s, lambda x, i: NOT list_contains(gone, i - 1)), ' ') END AS text
FROM d LEFT JOIN gone USING (doc_id)
"""
