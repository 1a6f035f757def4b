"""Inputs that every operator has to take: nulls, empty and long texts, repeated rows, clashing column names."""

import random

EXTRA = ["fingerprint", "suspect", "__row", "kept", "clean", "spans", "__key", "removed", "cell", "item", "n", "a.b"]
SCHEMA = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in EXTRA)


def frame(spark, rows):
    """(doc_id, text) rows with columns of names that operators use inside."""
    return spark.createDataFrame([(i, t, None, *(c if k % 2 else None for k, c in enumerate(EXTRA))) for i, t in rows], SCHEMA)


def prose(seed, n=120):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "stone river candle garden window marble thunder".split() for b in ("", "s", "ing", "ful", "less", "er", "y", "ed")]
    out = []
    while len(out) < n:
        s = [r.choice(words) for _ in range(r.randint(5, 11))]
        out += s[:-1] + [s[-1] + "."]
    return " ".join(out[:n])


def awkward():
    return [(1, prose(1)), (2, None), (None, prose(2)), (None, None), (3, ""), (4, " \n\t "), (5, prose(1)), (5, prose(1)), (6, "é ß 日本 \U0001f600 " * 3), (7, prose(3, 9000)), (8, "!!! ... ???"), (8, None)]


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.select(column).collect()), key=lambda x: (x is None, x))
