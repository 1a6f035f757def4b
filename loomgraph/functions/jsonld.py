"""Functions over JSON-LD documents held as JSON text: recursive walks that VARIANT expressions can't say."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import transliterate

CONTEXT = {"@vocab": "https://schema.org/", "schema": "https://schema.org/", "xsd": "http://www.w3.org/2001/XMLSchema#", "sameAs": {"@type": "@id"}, "birthDate": {"@type": "xsd:date"}, "deathDate": {"@type": "xsd:date"}}


def load(text: str | None) -> object:
    """The parsed text, or None where it isn't JSON."""
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return None


def dump(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def objects(value: object) -> Iterator[dict]:
    """All objects of a document, outer ones first. Iterative: depth isn't limited by the interpreter's stack."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            yield v
            stack.extend(reversed(list(v.values())))
        elif isinstance(v, list):
            stack.extend(reversed(v))


def slug_text(name: str) -> str:
    return re.sub("[^a-z0-9]+", "_", transliterate(name).lower()).strip("_")


def _sluggable(s: str) -> bool:
    """[FLT23]"""
    return not s.startswith("http") and "://" not in s and "-" not in s and any(c.isspace() for c in s) and any(c.isupper() for c in s)


def normalize_document(doc: object) -> object:
    """[FN4] the root's name as a slug, nested names as they are, other strings that look like names as slugs."""

    def walk(v: object, key: str | None, root: bool) -> object:
        if isinstance(v, dict):
            return {k: (slug_text(x) if root and k == "name" and isinstance(x, str) else x if k in ("@context", "@id", "@type", "name") else walk(x, k, False)) for k, x in v.items()}
        if isinstance(v, list):
            return [walk(x, key, False) for x in v]
        return slug_text(v) if isinstance(v, str) and _sluggable(v) else v

    return walk(doc, None, True)


def entity_names(doc: object) -> list[str]:
    """[PRJ8] every string `name` of any object, sorted, each once."""
    return sorted({o["name"] for o in objects(doc) if isinstance(o.get("name"), str)})


def enrich(doc: object, uris: dict[str, str]) -> object:
    """[PRJ9] @id for objects whose name is a key of uris. What stands below such an object isn't looked at."""
    if isinstance(doc, dict):
        if isinstance(doc.get("name"), str) and doc["name"] in uris:
            return doc | {"@id": uris[doc["name"]]}
        return {k: enrich(v, uris) for k, v in doc.items()}
    return [enrich(v, uris) for v in doc] if isinstance(doc, list) else doc


def merge_documents(docs: list[object], once: bool = False) -> object:
    """[AGG19] no document: {}; one: itself; more: a graph of all, under the first context, without contexts of their own.

    With `once`, nodes of one type and name (letters' case aside), and of one @id if both have one, become one: of each property the first value
    that is told. A graph of one node is that node.
    """
    docs = [d for d in docs if isinstance(d, dict)]
    if not docs or len(docs) < 2 and not once:
        return docs[0] if docs else {}
    nodes: list[object] = []
    for d in docs:
        inner = d.get("@graph")
        nodes += [{k: v for k, v in n.items() if k != "@context"} if isinstance(n, dict) else n for n in (inner if isinstance(inner, list) else [d])]
    context = {"@context": next((d["@context"] for d in docs if "@context" in d), CONTEXT)}
    if once:
        nodes = _merged_nodes(nodes)
        if len(nodes) == 1 and isinstance(nodes[0], dict):
            return context | nodes[0]
    return context | {"@graph": nodes}


def _merged_nodes(nodes: list[object]) -> list[object]:
    out: list[object] = []
    at: dict[tuple[str, str], list[dict]] = {}
    for n in nodes:
        if not isinstance(n, dict) or not isinstance(n.get("name"), str):
            out.append(n)
            continue
        group = at.setdefault((dump(n.get("@type")), n["name"].lower()), [])
        same = next((m for m in group if m.get("@id", n.get("@id")) == n.get("@id", m.get("@id"))), None)
        if same is None:
            group.append(dict(n))
            out.append(group[-1])
        else:
            same.update({k: v for k, v in n.items() if k not in same})
    return out


def _mapped(kind: str, f: Callable[[object], object]) -> Callable[[Column], Column]:
    def column(x: Column) -> Column:
        @F.pandas_udf(kind)
        def run(s: pd.Series) -> pd.Series:
            return pd.Series([None if (d := load(t)) is None else f(d) for t in s], dtype=object)

        return run(x)

    return column


def _count(test: Callable[[object], bool]) -> Callable[[object], int]:
    def count(doc: object) -> int:
        n, stack = 0, [doc]
        while stack:
            v = stack.pop()
            n += test(v)
            stack.extend(v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())
        return n

    return count


normalized = _mapped("string", lambda d: dump(normalize_document(d)))  # [FN4]
names = _mapped("array<string>", entity_names)  # [PRJ8]
count_arrays = _mapped("long", _count(lambda v: isinstance(v, list)))  # [AGG21]
with_context = _mapped("string", lambda d: dump({"@context": CONTEXT} | {k: v for k, v in d.items() if k != "@context"}) if isinstance(d, dict) else None)  # [PRJ5]


def parsed_with_context(x: Column) -> Column:
    """[SRC5] a text as VARIANT under the built-in context; null for what is no JSON object."""
    return F.try_parse_json(with_context(x))


def built(kind: Column | str, properties: dict[str, Column], id: Column | None = None, context: Column | str = "https://schema.org") -> Column:
    """[PRJ3] the text of a document of this type with these properties, in their order; null ones are left out."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    own = [lit(context).alias("@context"), lit(kind).alias("@type"), *([] if id is None else [id.alias("@id")])]
    return F.to_json(F.struct(*own, *(c.alias(name) for name, c in properties.items())))


def count_objects(x: Column, key: str = "@type") -> Column:
    """[AGG20] objects that have the key."""
    return _mapped("long", _count(lambda v: isinstance(v, dict) and key in v))(x)


def enriched(x: Column, uris: Column) -> Column:
    """[PRJ9] x with the @ids of a MAP<STRING, STRING>; x as it is where the map is null."""

    @F.pandas_udf("string")
    def run(s: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([t if (d := load(t)) is None or not u else dump(enrich(d, dict(u))) for t, u in zip(s, m)], dtype=object)

    return run(x, uris)


def with_root(x: Column, key: str, value: Column) -> Column:
    """[PRJ4] the document with this string at the root; unchanged where value is null or the root is no object."""

    @F.pandas_udf("string")
    def run(s: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([dump(d | {key: u}) if u is not None and isinstance(d := load(t), dict) else t for t, u in zip(s, v)], dtype=object)

    return run(x, value)


def root_string(v: Column, key: str) -> Column:
    """[PRJ1] a root field of a VARIANT, if it is a string; numbers aren't turned into one."""
    field = F.try_variant_get(v, f"$['{key}']", "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(field, "$", "string"))


def structural_error(text: Column) -> Column:
    """[SRC4, FLT1] what keeps a JSON text from being a document: not_json, not_object, no_context, no_type; null if nothing does."""
    return structural_error_of(F.try_parse_json(text), text)


def structural_error_of(v: Column, text: Column) -> Column:
    """structural_error() of a text that is parsed already."""
    context = F.try_variant_get(v, "$['@context']", "variant")
    graph = F.try_variant_get(v, "$['@graph']", "array<variant>")
    kind = F.try_variant_get(v, "$['@type']", "variant")
    typed = F.when(graph.isNotNull(), F.size(graph) > 0).otherwise(kind.isNotNull())
    return (
        F.when(v.isNull(), "not_json")
        .when(~F.schema_of_variant(v).startswith("OBJECT"), "not_object")
        .when(context.isNull() | F.is_variant_null(context), "no_context")
        .when(~F.coalesce(typed, F.lit(False)), "no_type")
    )
