import random

from helpers import awkward, frame, prose

from loomgraph.llm import spans


def brute(docs, run, least):
    """Marked sentences of each document: those of its ranges of runs that aren't the first of their kind."""
    import re

    seen, marked = {}, {}
    for d, t in sorted((d, t) for d, t in docs if d is not None and t):
        s = [x for x in re.split(r"(?<=[.!?])[ \t\f\r]+|[ \t\f\r]*\n[ \t\f\r]*", t) if x.strip(" ")]
        again = set()
        for i in range(max(len(s) - run + 1, min(len(s), 1))):
            part = s[i : i + run]
            if tuple(part) in seen:
                again |= set(range(i, i + len(part)))
            else:
                seen[tuple(part)] = (d, i)
        ranges = []
        for i in sorted(again):
            if ranges and ranges[-1][-1] == i - 1:
                ranges[-1].append(i)
            else:
                ranges.append([i])
        for r in ranges:
            if sum(len(s[i].split()) for i in r) >= least:
                marked.setdefault(d, set()).update(r)
    return marked


def marked(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, set()).update(range(r.first_sentence, r.last_sentence + 1))
    return out


def test_op8_agrees_with_its_sql(spark, small, duck):
    assert sorted(map(tuple, spans.op8_sentence_spans(spark, small).select("doc_id", "first_sentence", "last_sentence", "first_id").collect())) == sorted(duck.execute(spans.OP8_SQL).fetchall())


def test_the_registered_queries_remove_the_sentences(spark, small, duck):
    """op8_texts returns every document; its SQL says the same, and some lose sentences."""
    import __spark_entry__ as entry

    got = entry.queries()["op8_texts"](spark, small)
    want = duck.execute(entry.oracle_sql()["op8_texts"]).fetchall()
    assert got.columns == ["doc_id", "text"]
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want)
    before = dict(map(tuple, spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()))
    changed = {i for i, t in rows if t != before[i]}
    assert len(rows) == len(before) and changed and changed <= {r.doc_id for r in spans.op8_sentence_spans(spark, small).collect()}


def test_against_brute_force(spark):
    r = random.Random(2)
    pool = [prose(k, 12) for k in range(12)]
    rows = [(d, " ".join(r.choice(pool) for _ in range(r.randint(1, 9)))) for d in range(60)]
    for run, least in ((3, 8), (2, 1), (2, 30), (1, 1), (4, 20)):
        assert marked(spans.repeated_spans(frame(spark, rows), run, least)) == brute(rows, run, least)


def test_removal_keeps_the_first_occurrence(spark):
    shared = "One fine day we met. The sun was out for us. Nobody knew what to say."
    rows = [(1, f"Alpha came first here. {shared}"), (2, f"{shared} Beta came last here."), (3, "Gamma stands alone.")]
    docs = frame(spark, rows)
    out = spans.remove_repeated_spans(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 2: "Beta came last here.", 3: rows[2][1]}


def test_short_sentences_count_by_the_range(spark):
    """Runs of few words are found where together they are long, and left alone where they aren't."""
    shout = " ".join(f"{w}!!" for w in "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split())
    rows = [(1, shout), (2, f"Not the same start here. {shout}"), (3, "Stop. That."), (4, "Stop. That."), (5, shout.replace(" fifteen!! sixteen!!", ""))]
    got = spans.repeated_spans(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == [(2, 1, 16, 1)]


def test_a_text_of_one_sentence_is_a_run(spark):
    one = " ".join(f"word{i}" for i in range(60))
    got = spans.repeated_spans(frame(spark, [(1, one), (2, one), (3, one + " more")])).collect()
    assert sorted(map(tuple, got)) == [(2, 0, 0, 1)]


def test_a_very_long_text(spark):
    """A document of 40,000 words that holds a shorter one's sentences twice."""
    inner = prose(77, 200)
    long = f"{prose(5, 20_000)} {inner} {prose(6, 20_000)} {inner}"
    rows = [(1, inner), (2, long)]
    assert marked(spans.repeated_spans(frame(spark, rows))) == brute(rows, spans.RUN, spans.MIN_WORDS)


def test_awkward_rows(spark):
    docs = frame(spark, awkward())
    out = spans.remove_repeated_spans(docs)
    assert out.count() == len(awkward()) and out.columns == docs.columns
    texts = {(r.doc_id, r.text) for r in out.filter("doc_id <> 5").collect()}
    assert texts == {(i, t) for i, t in awkward() if i not in (5, None)}
    assert spans.repeated_spans(frame(spark, [])).count() == 0
