"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A record is a JSON text in whatever layout its source uses. The nested field paths of
the parsed record are hashed; the hash selects a mapping, which is looked for once a
hash and task, and the mapping, a list of declarative steps, is run by Spark's own
expressions over the parsed record. One pass, no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class One:
    """One turn from the fields at `paths`, joined by a blank line; absent, null and empty ones are left out, the turn too if nothing remains."""

    role: str
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A turn for each element of the list at `path`."""

    path: str
    role: str
    content: str


@dataclass(frozen=True)
class Pairs:
    """The list at `path` holds [user, assistant] pairs."""

    path: str


@dataclass(frozen=True)
class Mapping:
    """needs: the field paths that a layout must have ([] stands for a list's elements)."""

    name: str
    needs: tuple[str, ...]
    steps: tuple[One | Each | Pairs, ...]


def _messages(name: str, path: str, role: str, content: str) -> Mapping:
    return Mapping(name, (f"{path}[].{role}", f"{path}[].{content}"), (One("system", ("system",)), Each(path, role, content)))


def _exchange(name: str, user: tuple[str, ...], assistant: str, optional: tuple[str, ...] = (), system: str = "system") -> Mapping:
    return Mapping(name, (*user, assistant), (One("system", (system,)), One("user", user + optional), One("assistant", (assistant,))))


MAPPINGS = (
    _messages("messages", "messages", "role", "content"),
    _messages("nested_messages", "data.messages", "role", "content"),
    _messages("conversation", "conversation", "role", "content"),
    _messages("from_value", "conversations", "from", "value"),
    _messages("role_value", "conversations", "role", "value"),
    _messages("dialog", "dialog", "speaker", "text"),
    _messages("turns", "turns", "role", "text"),
    _messages("preferred", "chosen", "role", "content"),
    Mapping("instruction_history", ("history[][]", "instruction", "output"), (One("system", ("system",)), Pairs("history"), One("user", ("instruction", "input")), One("assistant", ("output",)))),
    _exchange("instruction", ("instruction",), "output", ("input",)),
    _exchange("instruction_response", ("instruction",), "response", ("context",)),
    _exchange("prompt_completion", ("prompt",), "completion"),
    _exchange("prompt_response", ("prompt",), "response"),
    _exchange("question_answer", ("question",), "answer", ("context",)),
    Mapping("system_question", ("system_prompt", "question", "response"), (One("system", ("system_prompt",)), One("user", ("question",)), One("assistant", ("response",)))),
    _exchange("query_response", ("query",), "response"),
    _exchange("inputs_targets", ("inputs",), "targets"),
)

#: Names of roles in other layouts; all else is lower-cased and trimmed.
ROLES = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "chatgpt": "assistant", "agent": "assistant", "developer": "system"}

_SCALAR = re.compile(r"[A-Z]+(?:\([^)]*\))?")


def paths_of(schema: str) -> frozenset[str]:
    """The field paths of a schema as schema_of_variant() prints it: OBJECT<a: STRING, b: ARRAY<OBJECT<c: BIGINT>>> has a, b and b[].c."""
    out: set[str] = set()
    at = 0

    def name() -> str:
        nonlocal at
        if schema[at] == "`":
            m = re.compile(r"`((?:[^`]|``)*)`").match(schema, at)
            at = m.end()
            return m[1].replace("``", "`")
        end = schema.index(": ", at)
        word, at = schema[at:end], end
        return word

    def kind(path: str) -> None:
        nonlocal at
        if schema.startswith("OBJECT<", at):
            at += 7
            while schema[at] != ">":
                if schema.startswith(", ", at):
                    at += 2
                own = name()
                at += 2
                inner = f"{path}.{own}" if path else own
                out.add(inner)
                kind(inner)
            at += 1
        elif schema.startswith("ARRAY<", at):
            at += 6
            out.add(f"{path}[]")
            kind(f"{path}[]")
            at += 1
        else:
            at = _SCALAR.match(schema, at).end()

    try:
        kind("")
    except (AttributeError, IndexError, ValueError):  # field names that the printed form can't be told from
        return frozenset()
    return frozenset(out)


def mapping_for(paths: frozenset[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> str | None:
    """The mapping with most needs among those whose needs are all there; the first of equals."""
    fit = [m for m in mappings if paths.issuperset(m.needs)]
    return max(fit, key=lambda m: len(m.needs)).name if fit else None


def _text(v: Column) -> Column:
    """A variant's text: a string as it is, a list of parts as the parts' texts one after another, anything else as JSON."""
    parts = F.try_variant_get(v, "$", "array<struct<text:string>>")
    joined = F.array_join(F.transform(parts, lambda p: p["text"]), "")
    return F.when(F.schema_of_variant(v).startswith("ARRAY<OBJECT"), joined).otherwise(F.try_variant_get(v, "$", "string"))


def _role(c: Column) -> Column:
    plain = F.lower(F.trim(c))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv)), plain), plain)


def _turn(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def _nothing() -> Column:
    return F.array().cast("array<struct<role:string,content:string>>")


def _step(v: Column, step: One | Each | Pairs) -> Column:
    if isinstance(step, One):
        fields = F.filter(F.array(*(_text(F.try_variant_get(v, f"$.{p}", "variant")) for p in step.paths)), lambda t: t.isNotNull() & (t != ""))
        return F.when(F.size(fields) > 0, F.array(_turn(F.lit(step.role), F.array_join(fields, "\n\n")))).otherwise(_nothing())
    if isinstance(step, Each):
        items = F.try_variant_get(v, f"$.{step.path}", f"array<struct<`{step.role}`:string,`{step.content}`:variant>>")
        return F.coalesce(F.transform(items, lambda t: _turn(_role(t[step.role]), _text(t[step.content]))), _nothing())
    pairs = F.try_variant_get(v, f"$.{step.path}", "array<array<string>>")
    both = F.transform(pairs, lambda p: F.array(_turn(F.lit("user"), F.get(p, F.lit(0))), _turn(F.lit("assistant"), F.get(p, F.lit(1)))))
    return F.coalesce(F.flatten(both), _nothing())


def _parsed(records: DataFrame, key: str, record: str, mappings: tuple[Mapping, ...]) -> DataFrame:
    """(id, v VARIANT, fingerprint, layout)."""

    @F.pandas_udf("string")
    def select(fingerprint: pd.Series, schema: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(s) else known[f] if f in known else known.setdefault(f, mapping_for(paths_of(s), mappings)) for f, s in zip(fingerprint, schema)], dtype=object)

    known: dict[int, str | None] = {}
    # Scalars' types and an empty list's missing ones are no field paths, so they stay out of the hash.
    shape = F.regexp_replace("schema", r": [A-Z]+(\([^)]*\))?(?=[,>])", "")
    rows = records.select(F.col(key).alias("id"), F.try_parse_json(F.col(record)).alias("v")).withColumn("schema", F.schema_of_variant("v"))
    rows = rows.withColumn("fingerprint", F.xxhash64(shape))
    return rows.withColumn("layout", select.asNondeterministic()("fingerprint", "schema")).drop("schema")


def chat_turns(records: DataFrame, key: str = "conv_id", record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(key, turn, role, content, layout): the turns of each record, numbered from 0 in order.

    A record that is null, no JSON object (or one that repeats a field), or of no known layout has no turns;
    layouts() counts these. A message without role or content keeps its place with nulls there. Repeated
    records, and null keys, yield their turns each. Other columns are ignored.
    """
    v = F.col("v")
    turns = None
    for m in mappings:
        made = F.concat(*(_step(v, s) for s in m.steps))
        turns = F.when(F.col("layout") == m.name, made) if turns is None else turns.when(F.col("layout") == m.name, made)
    rows = _parsed(records, key, record, mappings).filter("layout IS NOT NULL")
    rows = rows.select("id", "layout", F.posexplode(turns).alias("turn", "t"))
    return rows.select(F.col("id").alias(key), F.col("turn").cast("long").alias("turn"), F.col("t.role").alias("role"), F.col("t.content").alias("content"), "layout")


def layouts(records: DataFrame, key: str = "conv_id", record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(fingerprint, layout, n): how many records have each set of field paths, and the mapping it selects (null where none fits)."""
    return _parsed(records, key, record, mappings).groupBy("fingerprint", "layout").agg(F.count("*").alias("n"))


def as_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): each conversation of (conv_id, turn, role, text) rows as a JSON record in the layout that suits its shape.

    One question with its answer is an instruction, one with a system text before it a prompt, and all else
    a list of messages, named `from` and `value` where the first speaker is the system.
    """
    turn = F.struct("turn", "role", "text")
    c = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    roles, text = F.concat_ws(",", F.transform("t", lambda x: F.coalesce(x["role"], F.lit("?")))), lambda k: F.col("t")[k]["text"]
    full = ~F.exists("t", lambda x: x["text"].isNull() | (x["text"] == ""))
    listed = lambda role, content: F.transform("t", lambda x: F.struct(x["role"].alias(role), x["text"].alias(content)))
    keep = {"ignoreNullFields": "false"}
    record = (
        F.when(full & (roles == "user,assistant"), F.to_json(F.struct(text(0).alias("instruction"), F.lit("").alias("input"), text(1).alias("output"))))
        .when(full & (roles == "system,user,assistant"), F.to_json(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response"))))
        .when(roles.startswith("system"), F.to_json(F.struct(listed("from", "value").alias("conversations")), keep))
        .otherwise(F.to_json(F.struct(listed("role", "content").alias("messages")), keep))
    )
    return c.select("conv_id", record.alias("record"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, written as records of different layouts and read back as canonical turns."""
    return chat_turns(as_records(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP4_SQL = """
WITH c AS (
  SELECT *, string_agg(coalesce(role, '?'), ',' ORDER BY turn, role, text) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS roles,
         bool_and(coalesce(text, '') <> '') OVER (PARTITION BY conv_id) AS filled,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS n
  FROM conversations)
SELECT conv_id, n AS turn, lower(trim(role)) AS role, text AS content,
       CASE WHEN filled AND roles = 'user,assistant' THEN 'instruction'
            WHEN filled AND roles = 'system,user,assistant' THEN 'prompt_response'
            WHEN starts_with(roles, 'system') THEN 'from_value' ELSE 'messages' END AS layout
FROM c
"""
