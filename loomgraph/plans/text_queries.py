"""Queries over documents: sizes, chunks, sentences, mentions and what pronouns refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, coref
from ..sources.star import table

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query("SELECT doc_id, CAST(strlen(text) // 4 AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CAST(strlen(text) // 4 AS BIGINT) AS tokens, CASE WHEN strlen(text) // 4 < 2000 THEN 'short' WHEN text IS NOT NULL THEN 'long' END AS path FROM documents")
def path_choice(spark: SparkSession, d: str) -> DataFrame:
    return chunking.path_choice(documents(spark, d))


@query("SELECT doc_id, CAST(CASE WHEN strlen(text) <= 3500 THEN 1 ELSE ceil(strlen(text) / 3100.0) END AS BIGINT) AS chunks FROM documents")
def chunk_estimate(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.chunk_estimate(F.col("text"), chunking.SIZE, chunking.OVERLAP).alias("chunks"))


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk(documents(spark, d))


_SENTENCES = r"""
s AS (SELECT doc_id, list_filter(string_split(text, '.'), lambda x: regexp_matches(x, '[^ \t\n\r\f\v]')) AS l FROM documents WHERE text IS NOT NULL),
se AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS sentence FROM s)"""


@query(
    f"""WITH {_SENTENCES}
SELECT doc_id, CAST(sentence AS INTEGER) AS chunk_id, CAST(strlen(s) AS BIGINT) AS n_bytes,
  CAST(greatest(0, coalesce(sum(strlen(s) - 2) OVER w, 0)) AS BIGINT) AS start_byte, CAST(greatest(0, coalesce(sum(strlen(s) - 2) OVER w, 0)) + strlen(s) AS BIGINT) AS end_byte
FROM se WINDOW w AS (PARTITION BY doc_id ORDER BY sentence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def chunk_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).select("doc_id", F.posexplode(T.sentence_list(F.col("text"))).alias("chunk_id", "s"))
    return chunking.running_offsets(rows.select("doc_id", "chunk_id", F.octet_length("s").cast("long").alias("n_bytes")), overlap=2)


@query(
    f"""WITH {_SENTENCES}, n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(s, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) AS n FROM se)
SELECT d.doc_id, count(n) AS n_sentences, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_words FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id WHERE d.text IS NOT NULL GROUP BY d.doc_id"""
)
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    s = T.sentence_list(F.col("text"))
    words = F.aggregate(s, F.lit(0).cast("long"), lambda n, x: n + F.size(T.word_list(x)))
    return documents(spark, d).filter("text IS NOT NULL").select("doc_id", F.size(s).cast("long").alias("n_sentences"), words.alias("n_words"))


_FORMS = {k: ", ".join(f"'{f}'" for f in forms) for k, forms in T.PRONOUNS.items()}
_TYPE = "CASE " + " ".join(f"WHEN bare IN ({forms}) THEN '{k}'" for k, forms in _FORMS.items()) + " END"
_STOP = "|".join(w.replace("'", "''") for w in T.STOP_WORDS)
_TOKENS = rf"""{_SENTENCES},
w AS (SELECT doc_id, sentence, list_filter(regexp_split_to_array(s, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM se),
t AS (SELECT doc_id, sentence, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM w),
b AS (SELECT *, regexp_replace(lower(w), '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g') AS bare FROM t),
k AS (SELECT *, {_TYPE} AS pronoun_type, regexp_full_match(w, '(?:{_STOP})[^\p{{L}}]*') AS stop FROM b),
c AS (SELECT *, pronoun_type IS NULL AND NOT stop AND regexp_matches(w, '^\p{{Lu}}[^\p{{Lu}}]') AS starts,
             pronoun_type IS NULL AND NOT stop AND regexp_full_match(w, '\p{{Lu}}(?:\p{{Ll}}|[^\p{{L}}])*') AS goes_on FROM k)"""
# A block is a word that can't go on a name, and the words after it that can; its name begins with the first that can start one.
_MENTIONS = rf"""{_TOKENS},
g AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, sentence ORDER BY i ROWS UNBOUNDED PRECEDING) AS block FROM c),
f AS (SELECT *, min(CASE WHEN starts THEN i END) OVER (PARTITION BY doc_id, sentence, block) AS first FROM g),
names AS (SELECT doc_id, sentence, min(i) AS i, string_agg(w, ' ' ORDER BY i) AS raw, NULL AS pronoun_type FROM f WHERE i >= first GROUP BY doc_id, sentence, block),
both_ AS (SELECT * FROM names UNION ALL SELECT doc_id, sentence, i, w, pronoun_type FROM f WHERE pronoun_type IS NOT NULL),
m AS (SELECT doc_id, sentence, row_number() OVER (PARTITION BY doc_id, sentence ORDER BY i) - 1 AS ordinal, regexp_replace(raw, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS mention, pronoun_type FROM both_)"""


@query(
    f"""WITH {_TOKENS} SELECT lang, pronoun_type, count(*) AS n FROM c JOIN documents USING (doc_id) WHERE pronoun_type IS NOT NULL GROUP BY ALL"""
)
def pronoun_counts(spark: SparkSession, d: str) -> DataFrame:
    words = F.flatten(F.transform(T.sentence_list(F.col("text")), T.word_list))
    rows = documents(spark, d).select("lang", F.explode(words).alias("w"))
    return rows.select("lang", T.pronoun_type(F.col("w")).alias("pronoun_type")).filter("pronoun_type IS NOT NULL").groupBy("lang", "pronoun_type").agg(F.count("*").alias("n"))


@query(
    rf"""WITH {_TOKENS} SELECT w AS word, count(*) AS n, bool_or(regexp_full_match(w, '\p{{Lu}}(?:\p{{Ll}}|[^\p{{L}}])*')) AS continues FROM c WHERE regexp_matches(w, '^\p{{Lu}}[^\p{{Lu}}]') GROUP BY w"""
)
def proper_nouns(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.flatten(F.transform(T.sentence_list(F.col("text")), T.word_list)), T.starts_name)
    counted = documents(spark, d).select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.withColumn("continues", T.continues_name(F.col("word")))  # once a distinct word


@query(f"WITH {_MENTIONS} SELECT doc_id, CAST(sentence AS INTEGER) AS sentence, CAST(ordinal AS INTEGER) AS ordinal, mention, pronoun_type FROM m")
def mentions(spark: SparkSession, d: str) -> DataFrame:
    return coref.mentions(documents(spark, d))


_FITS = {
    "masculine": "len(regexp_split_to_array(trim(mention), ' +')) <= 3 AND NOT contains(lower(mention), ' and ')",
    "neutral": "regexp_matches(mention, '" + "|".join(T.ORGANISATION_MARKS) + "')",
    "plural": "(contains(mention, ' and ') OR ends_with(mention, 's'))",
}
_FITS["feminine"] = _FITS["masculine"]
_AT = "sentence * 1000000 + ordinal"
_ANTECEDENTS = f"""{_MENTIONS},
n AS (SELECT *, {", ".join(f"arg_max(mention, {_AT}) FILTER (WHERE pronoun_type IS NULL AND {fits}) OVER near AS near_{k}, arg_max(mention, {_AT}) FILTER (WHERE pronoun_type IS NULL AND {fits}) OVER here AS here_{k}" for k, fits in _FITS.items())}
      FROM m WINDOW near AS (PARTITION BY doc_id ORDER BY sentence RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), here AS (PARTITION BY doc_id, sentence ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT doc_id, sentence, ordinal, mention AS pronoun, pronoun_type, CASE pronoun_type {" ".join(f"WHEN '{k}' THEN coalesce(here_{k}, near_{k})" for k in _FITS)} END AS antecedent FROM n WHERE pronoun_type IS NOT NULL)"""


@query(f"WITH {_ANTECEDENTS} SELECT doc_id, CAST(sentence AS INTEGER) AS sentence, CAST(ordinal AS INTEGER) AS ordinal, pronoun, pronoun_type, antecedent FROM a")
def antecedent_asof(spark: SparkSession, d: str) -> DataFrame:
    """Every pronoun of the documents with the name it refers to."""
    return coref.antecedents(coref.mentions(documents(spark, d)))


@query(f"WITH {_ANTECEDENTS} SELECT doc_id, antecedent, count(*) AS n_pronouns, CAST(min(sentence) AS INTEGER) AS first_sentence, string_agg(pronoun, ' ' ORDER BY sentence, ordinal) AS pronouns FROM a WHERE antecedent IS NOT NULL GROUP BY doc_id, antecedent")
def coref_clusters(spark: SparkSession, d: str) -> DataFrame:
    return coref.clusters(coref.antecedents(coref.mentions(documents(spark, d)))).withColumn("pronouns", F.array_join("pronouns", " "))


@query(f"WITH {_ANTECEDENTS} SELECT doc_id, lower(pronoun) AS pronoun, arg_max(antecedent, {_AT}) AS antecedent FROM a WHERE antecedent IS NOT NULL GROUP BY 1, 2")
def coref_mention_map(spark: SparkSession, d: str) -> DataFrame:
    return coref.mention_map(coref.antecedents(coref.mentions(documents(spark, d))))


@query(
    f"""WITH {_MENTIONS}, x AS (SELECT *, arg_max(CASE WHEN pronoun_type IS NULL THEN mention END, CASE WHEN pronoun_type IS NULL THEN {_AT} END) OVER (PARTITION BY doc_id ORDER BY sentence RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS antecedent FROM m)
SELECT doc_id, CAST(sentence AS INTEGER) AS sentence, CAST(ordinal AS INTEGER) AS ordinal, mention AS pronoun, pronoun_type, antecedent FROM x WHERE pronoun_type IS NOT NULL"""
)
def guided_antecedents(spark: SparkSession, d: str) -> DataFrame:
    """The names found by the rules stand for a recogniser's entities; of one sentence, the last counts."""
    found = coref.mentions(documents(spark, d))
    last = found.filter("pronoun_type IS NULL").groupBy("doc_id", "sentence").agg(F.max_by("mention", "ordinal").alias("entity"))
    return coref.guided_antecedents(found, last)


@query()
def coref_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return coref.rewrite_pronouns(documents(spark, d))


@query(
    rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS position, regexp_replace(unnest(w), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS w FROM w),
b AS (SELECT *, regexp_replace(lower(w), '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g') AS bare FROM t),
k AS (SELECT *, {_TYPE} AS pronoun_type FROM b),
l AS (SELECT *, last_value(CASE WHEN pronoun_type IS NULL AND regexp_matches(w, '^\p{{Lu}}..') AND w NOT IN ('The', 'A', 'An', 'This') THEN w END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS antecedent FROM k)
SELECT doc_id, CAST(position AS INTEGER) AS position, w AS pronoun, pronoun_type, antecedent FROM l WHERE pronoun_type IS NOT NULL"""
)
def simple_antecedents(spark: SparkSession, d: str) -> DataFrame:
    return coref.simple_antecedents(documents(spark, d))
