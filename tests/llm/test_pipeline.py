import pytest
from helpers import awkward, frame, ids, prose
from test_packing import check
from test_quality import brute as repetition
from test_simhash import edited, groups, near_pairs

import corpus_pipeline as P
from loomgraph.llm import packing, quality, secrets, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute(rows):
    """What the stages before packing keep, text by text: {doc_id: text}."""
    kept = {}
    for i, t in rows:
        if t is None:
            continue
        covered, longest = repetition(t, quality.MIN_REPEAT) if len(t) < 900 else quality.repetition(t)
        if not t or covered / len(t) <= quality.MAX_COVERED and longest <= quality.MAX_LONGEST:
            kept[i] = t
    first = {}
    for i in sorted(kept):
        first.setdefault(kept[i], i)
    kept = {i: t for t, i in first.items()}
    order = sorted(kept)
    have, f = simhash.fingerprints([kept[i] for i in order])
    root = groups(near_pairs(f, [order[k] for k in have], simhash.MAX_BITS), order)
    s = secrets.Scanner()
    out = {}
    for i in order:
        if root[i] == i:
            t = kept[i]
            for a, b, *_ in reversed(s.scan(t)):
                t = t[:a] + secrets.MASK + t[b:]
            out[i] = t
    return out


def documents(spark, rows, path):
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)


def test_run_is_its_stages_by_brute_force(spark, tmp_path):
    key = "Zx8Qm2Lw9Rt4Vb7Ny1Kd5Hs3Gf6Jp0Ce"
    rows = [(k, prose(k, 90)) for k in range(25)] + [(100 + k, edited(prose(k, 90), 0.02, k)) for k in range(6)] + [(200, prose(3, 90)), (201, "la la la la " * 60), (202, f"{prose(50, 60)} {key}"), (203, None), (204, "")]
    kept = brute(rows)
    assert 201 not in kept and 200 not in kept and key not in kept[202]
    got = P.run(spark, documents(spark, rows, tmp_path)).collect()
    check(got, {i: len(t.split()) for i, t in kept.items()}, packing.WINDOW)


def test_stages_pass_on_the_columns_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == COLUMNS
    assert len(P.STAGES) == 5


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_each_stage_takes_awkward_and_empty_tables(spark, small, name):
    stage = dict(P.STAGES)[name]
    docs = frame(spark, awkward())
    out = stage(spark, docs, small)
    out.collect()
    assert name == "packing" or out.columns == docs.columns
    assert stage(spark, frame(spark, []), small).count() == 0


def test_clean_documents_go_through(spark, small):
    docs = frame(spark, [(k, " ".join(f"{w}{k}" for w in prose(k, 80).split())) for k in range(8)])
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, small)
    assert ids(docs) == list(range(8))
