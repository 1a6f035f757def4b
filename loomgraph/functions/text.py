"""Scalar functions over text columns. IDs in brackets are those of the survey."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .stem import stem

_LETTERS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ł": "l", "Ł": "L", "ı": "i", "ħ": "h", "Ħ": "H"}
PRONOUNS = {
    "masculine": "he himself his him".split(),
    "feminine": "she herself hers her".split(),
    "neutral": "it itself its".split(),
    "plural": "they themselves theirs their them".split(),
}
#: Capitalised at a sentence's start without naming anything.
STOP_WORDS = "The A An This That These Those Then There Here In On At By For From To Of And But Or If When While As With After Before It's".split()
ORGANISATION_MARKS = ("Corp", "Company", "Ltd", "LLC", "Inc")
SCHEMA_TYPES = {"Person": ("person",), "Organization": ("organization", "organisation", "company"), "Place": ("place", "location", "city", "country"), "Event": ("event",)}


#: Characters of text that a task's Python works on at once; a longer text is a step of its own.
SLICE_CHARS = 500_000


def slices(s: pd.Series, most: int = SLICE_CHARS) -> Iterator[pd.Series]:
    """A batch of texts in parts of at most `most` characters, so that results needn't be held for all of a batch, which has up to 10,000 texts."""
    at = size = 0
    for k, t in enumerate(s):
        n = len(t) if isinstance(t, str) else 0
        if k > at and size + n > most:
            yield s.iloc[at:k]
            at, size = k, 0
        size += n
    if at < len(s):
        yield s.iloc[at:]


def transliterate(text: str) -> str:
    """ASCII letters for Latin ones: accents go, ligatures and strokes are spelt out; other scripts are dropped."""
    return unicodedata.normalize("NFKD", "".join(_LETTERS.get(c, c) for c in text)).encode("ascii", "ignore").decode()


def _ascii(x: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else transliterate(t))

    return run(x)


def slug_ascii(x: Column) -> Column:
    """[FN1] for ASCII text: lower case, runs of anything but letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_|_$", "")


def slug(x: Column) -> Column:
    """[FN1] identifier of an entity name; null for null."""
    return slug_ascii(_ascii(x))


def predicate_stem(x: Column) -> Column:
    """[FN2] a predicate in lower case, stemmed; stem() keeps what it has told."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else stem(t.lower()))

    return run(x)


def split_camel_case(x: Column) -> Column:
    """[FN3] the words of a camelCase name, in lower case."""
    return F.transform(F.filter(F.split(x, r"(?=\p{Lu})"), lambda p: p != ""), lambda p: F.lower(p))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity plus, above 0.7, a tenth of what it lacks to 1 for each of up to four shared first letters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(mine, (c for c, u in zip(b, used) if u))) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((k for k in range(4) if k >= min(len(a), len(b)) or a[k] != b[k]), 4)
    return jaro + 0.1 * prefix * (1 - jaro)


def jaro_winkler_similarity(a: Column, b: Column) -> Column:
    """[FN5] null where either side is."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else jaro_winkler(s, t) for s, t in zip(x, y)], dtype="float64")

    return run(a, b)


def token_estimate(x: Column) -> Column:
    """[FN6] a quarter of the bytes, rounded down, as a whole number."""
    return F.shiftright(F.octet_length(x).cast("long"), 2)


def needs_chunking(x: Column, size: int) -> Column:
    """[FLT6] more bytes than a chunk may have."""
    return F.octet_length(x) > size


def chunk_estimate(x: Column, size: int, overlap: int) -> Column:
    """[FN7] chunks of `size` bytes that overlap: 1 if all fits in one."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    n = F.octet_length(x)
    return F.when(~needs_chunking(x, size), F.lit(1)).otherwise(F.ceil(n / (size - overlap))).cast("long")


def json_of_response(x: Column) -> Column:
    """[FN8] the body of the first json fence, else from the first { to the last }, else the trimmed text."""
    fence = F.regexp_extract(x, r"(?s)```json\s*(.*?)```", 1)
    braces = F.regexp_extract(x, r"(?s)\{.*\}", 0)
    return F.when(F.trim(fence) != "", F.regexp_replace(fence, r"^\s+|\s+$", "")).when(braces != "", braces).otherwise(F.regexp_replace(x, r"^\s+|\s+$", ""))


def sentence_list(x: Column) -> Column:
    """[FN11] what stands between full stops, blank parts left out."""
    return F.filter(F.split(x, "[.]"), lambda s: s.rlike(r"\S"))


def word_list(x: Column) -> Column:
    """[FN12] runs of characters other than white space."""
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def pronoun_type(word: Column) -> Column:
    """[FLT14] masculine, feminine, neutral or plural; null for anything else. Letters' case and outer punctuation don't count."""
    bare = F.regexp_replace(F.lower(word), r"^[^\p{L}]+|[^\p{L}]+$", "")
    out = F.lit(None).cast("string")
    for kind, forms in PRONOUNS.items():
        out = F.when(bare.isin(forms), kind).otherwise(out)
    return out


def starts_name(word: Column) -> Column:
    """[FLT15] upper-case first letter and another character that is none."""
    return word.rlike(r"^\p{Lu}[^\p{Lu}]")


def continues_name(word: Column) -> Column:
    """[FLT16] upper-case first letter; all other letters lower-case."""
    return word.rlike(r"^\p{Lu}(?:\p{Ll}|\P{L})*$")


def agrees(name: Column, kind: str) -> Column:
    """[FLT17] whether a pronoun of this type can stand for the name."""
    if kind in ("masculine", "feminine"):
        return (F.size(word_list(name)) <= 3) & ~F.lower(name).contains(" and ")
    if kind == "neutral":
        return name.rlike("|".join(ORGANISATION_MARKS))
    return name.contains(" and ") | name.endswith("s")


def lowered_subject(x: Column) -> Column:
    """[FN15] lower case with underscores for blanks; punctuation stays."""
    return F.replace(F.lower(x), F.lit(" "), F.lit("_"))


def csv_list(x: Column) -> Column:
    """[FN17] the parts of a comma-separated list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(x, ","), lambda p: F.trim(p)), lambda p: p != "")


def is_date_shaped(x: Column) -> Column:
    """[FLT3] ten bytes with hyphens where an ISO date has them; digits aren't looked at."""
    return (F.octet_length(x) == 10) & (F.substring(x, 5, 1) == "-") & (F.substring(x, 8, 1) == "-")


def is_iso_date(x: Column) -> Column:
    """A date that exists, in ISO form (stricter than is_date_shaped)."""
    return x.rlike(r"^\d{4}-\d\d-\d\d$") & F.try_to_date(x).isNotNull()


def is_url(x: Column) -> Column:
    """[FLT4]"""
    return x.startswith("http://") | x.startswith("https://")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """[FN16]"""
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def schema_type(x: Column) -> Column:
    """[PRJ10] the vocabulary's type for a recogniser's label; an unknown label stays as it is."""
    out = x
    for name, labels in SCHEMA_TYPES.items():
        out = F.when(F.lower(x).isin(*labels), name).otherwise(out)
    return out


#: [PRJ12] relation identifiers of the gold documents and the properties they stand for.
RELATION_PROPERTIES = {
    "P19": "birthPlace", "P20": "deathPlace", "P27": "nationality", "P39": "jobTitle", "P54": "memberOf", "P69": "alumniOf", "P102": "memberOf", "P108": "worksFor", "P463": "memberOf",
    "P17": "addressCountry", "P37": "language", "P131": "containedInPlace", "P159": "location", "P276": "location", "P569": "birthDate", "P570": "deathDate", "P571": "foundingDate", "P576": "dissolutionDate",
}
