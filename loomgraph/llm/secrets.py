"""Secret scanning by sliding-window entropy.

A candidate is a maximal run of the characters of a class (hexadecimal digits, or
the base64 alphabets) that is long enough. A window slides over it; the counts of
its characters are updated by the one that leaves and the one that enters, and with
them Shannon's entropy. A candidate with a window at or above its class's threshold is
a secret unless the allow-list matches it or what stands around it. Of a URL, host and path are
allowed; user and password, query, fragment and the paths of web hooks are judged like any text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, fresh_name, quoted, text_frame


@dataclass(frozen=True)
class CharacterClass:
    """least: characters of a candidate; window: characters of a window (or all, if there are fewer); needs: what a candidate must match."""

    name: str
    pattern: str
    least: int
    window: int
    threshold: float
    needs: str


CLASSES = (
    CharacterClass("hex", r"(?<![A-Za-z0-9+/_-])(?:[0-9a-f]{24,}|[0-9A-F]{24,})(?![A-Za-z0-9+/_=-])", 24, 24, 2.8, r"(?=.*[A-Fa-f])(?=.*[0-9])"),
    CharacterClass("base64", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])", 16, 20, 3.3, r"(?=.*[A-Za-z])(?=.*[0-9])"),
)
#: Matches of these, or candidates right after such words, are no secrets.
ALLOW = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|placeholder|changeme|your[_-]?(?:api|key|token)|x{6,}|^(.)\1+$|0123456789|123456789012",
    r"(?i)^(?:https?|ftp|www)|^[a-z]+(?:[-_/][a-z]+)*[-_/]?\d{0,4}$|^\d{4}-\d\d-\d\d",
)
ALLOW_BEFORE = r"(?i)(?:\bsha(?:1|256|384|512)[-:=]|\bmd5[-:=]|\bcommit |\bintegrity=\"?|\b(?:https?|ftps?|ssh|git|s3|file):)$"
#: What ends a URL, and what ends its path.
URL_END, PATH_END = r"[\s\"'<>`{}|\\^]", r"[?#;&]"
#: What stands before a candidate in the part of a URL that may hold user and password, with what comes after it if it does.
IN_AUTHORITY = r"(?i)\b[a-z][a-z0-9+.-]*:(?P<slashes>//)?(?(slashes)[^\s\"'<>/?#@]*)$"
BEFORE_HOST = r"[^\s\"'<>/?#@]*@"
#: Hosts and first path parts behind which a URL's path is itself the credential.
WEBHOOK = r"(?i)(?:hooks\.slack(?:-gov)?\.com/(?:services|workflows|triggers)/|discord(?:app)?\.com/api/(?:v\d+/)?webhooks/|\.webhook\.office\.com/webhookb2/|outlook\.office\.com/webhook/|hooks\.zapier\.com/hooks/|api\.telegram\.org/(?:file/)?bot)"
MASK = "[SECRET]"
#: Characters before a candidate in which ALLOW_BEFORE, whose words are shorter, and a URL's scheme are sought. URLs may be of any length.
NEAR = 60


def window_entropy(s: str, window: int) -> float:
    """The largest Shannon entropy, in bits a character, of any window of s."""
    w = min(window, len(s))
    counts: dict[str, int] = {}
    for c in s[:w]:
        counts[c] = counts.get(c, 0) + 1
    weight = [0.0] + [k * log2(k) for k in range(1, w + 1)]
    total = sum(weight[k] for k in counts.values())
    best = total
    for old, new in zip(s, s[w:]):
        if old != new:
            k = counts[old]
            total += weight[k - 1] - weight[k]
            counts[old] = k - 1
            k = counts.get(new, 0)
            total += weight[k + 1] - weight[k]
            counts[new] = k + 1
            if total < best:
                best = total
    return max(0.0, log2(w) - best / w) if w else 0.0


class Scanner:
    def __init__(self, classes: tuple[CharacterClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW, allowed: tuple[str, ...] = ()):
        self.classes = [(c, regex.compile(c.pattern), regex.compile(c.needs, regex.S)) for c in classes]
        self.allow = [regex.compile(a) for a in allow]
        self.before = regex.compile(ALLOW_BEFORE)
        self.url_end, self.path_end = regex.compile(URL_END), regex.compile(PATH_END)
        self.authority, self.host, self.webhook = regex.compile(IN_AUTHORITY), regex.compile(BEFORE_HOST), regex.compile(WEBHOOK)
        self.allowed = frozenset(allowed)

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, class, entropy) of each secret, in order; a run is judged by the first class that takes it."""
        out: list[tuple[int, int, str, float]] = []
        taken: set[int] = set()
        for c, pattern, needs in self.classes:
            begin, ends, end = 0, self.url_end.finditer(text), None  # begin: after the last character before a candidate that ends URLs
            for m in pattern.finditer(text):
                start, s = m.start(), m.group()
                if start in taken or not needs.match(s):
                    continue
                while (end := end or next(ends, None)) and end.start() < start:
                    begin, end = end.end(), None
                before, scheme = text[max(0, start - NEAR) : start], text.rfind("://", begin, start)
                in_path = scheme >= 0 and not self.path_end.search(text, scheme + 3, start)
                around = text[max(begin, scheme - NEAR) : start] if scheme >= 0 else before
                url = self._in_url(around, s, text, m.end()) if scheme >= 0 or before.endswith(":") else None
                if url is not None:
                    start, s = start + url, s[url:]
                by = next((k for k, p, n in self.classes if p.fullmatch(s) and n.match(s)), c) if url else c
                taken.add(m.start())
                if len(s) < by.least or s in self.allowed or any(a.search(s) for a in self.allow) or url is None and (in_path or self.before.search(before)):
                    continue
                h = window_entropy(s, by.window)
                if h >= by.threshold:
                    out.append((start, m.end(), by.name, h))
        out.sort()
        return out

    def _in_url(self, before: str, s: str, text: str, end: int) -> int | None:
        """Where in the candidate s the credential of a URL begins, if it is one: a user, a password or a web hook's path."""
        at = self.authority.search(before)
        if at and (at["slashes"] or s.startswith("//")) and self.host.match(text, end):
            skip = 0 if at["slashes"] else 2
            if "/" not in s[skip:] or at["slashes"] and before.count(":", at.start("slashes")) and not regex.match(r"\d{1,5}/", s):
                return skip
        around = before[before.rfind("://") :] + s
        hook = self.webhook.search(around)
        if hook and not regex.search(r"[\s\"'<>]", around):
            return max(0, hook.end() - (len(around) - len(s)))
        return None


def find_secrets(docs: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, start, end, kind, entropy): code points of each secret, end exclusive.

    `allowed` are strings that are no secrets besides ALLOW. Null and empty texts have none; each repeated row
    is scanned, rows without an id too; very long texts are scanned whole; other columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(allowed=allowed)
        for ids, texts in chunks(batches):
            rows = [(i, *hit) for i, t in zip(ids, texts) if t for hit in scanner.scan(t)]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()))], ["doc_id", "start", "end", "kind", "entropy"])

    return text_frame(docs).mapInArrow(run, "doc_id long, start long, end long, kind string, entropy double")


def redact_secrets(docs: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """docs with every secret in text replaced by MASK; n_chars, if there is such a column, is the new text's length where text changed.

    No row is dropped; null and empty texts stay as they are; each repeated row is cleaned; very long texts are scanned whole.
    """

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(allowed=allowed)
        for column in batches:
            out = []
            for t in column:
                for a, b, *_ in reversed(scanner.scan(t)) if isinstance(t, str) else ():
                    t = t[:a] + MASK + t[b:]
                out.append(t)
            yield pd.Series(out, dtype=object)

    text, new = F.col("text"), fresh_name(docs, "clean")
    done = docs.withColumn(new, clean.asNondeterministic()(text.cast("string")))
    columns = []
    for c in docs.columns:
        if c.lower() == "text":
            columns.append(F.col(new).alias(c))
        elif c.lower() == "n_chars":
            columns.append(F.when(F.col(new).eqNullSafe(text), quoted(c)).otherwise(F.length(new)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(quoted(c))
    return done.select(*columns)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_secrets() of all documents: a row a secret; null and empty texts have none."""
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
