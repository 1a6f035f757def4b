import random
from collections import defaultdict

import numpy as np
from helpers import awkward, frame, prose

from loomgraph.llm import suffixes


def brute(rows, n):
    """Maximal ranges of words covered by runs of n words that aren't the first of their kind."""
    seen, out = {}, defaultdict(list)
    for d, text in sorted((d, t) for d, t in rows if d is not None and t):
        w = text.split()
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if key in seen:
                out[d].append((i, seen[key]))
            else:
                seen[key] = d
    ranges = set()
    for d, starts in out.items():
        for k, (i, first) in enumerate(starts):
            if k and i <= lo_hi[1]:
                lo_hi[1], lo_hi[2] = i + n, min(lo_hi[2], first)
            else:
                if k:
                    ranges.add((d, *lo_hi))
                lo_hi = [i, i + n, first]
        ranges.add((d, *lo_hi))
    return ranges


def found(df):
    return {tuple(r) for r in df.select("doc_id", "start_word", "end_word", "first_id").collect()}


def test_difference_cover_reaches_all_differences():
    for v in (3, 7, 16, 32):
        c = suffixes.difference_cover(v)
        assert {(a - b) % v for a in c for b in c} == set(range(v))


def test_buckets_hold_the_suffixes_in_order():
    r = random.Random(3)
    for alphabet, n in ((1, 90), (2, 400), (5, 300)):
        # words, then marks that occur once and are more than V long, as after each segment
        body = [r.randrange(alphabet) + 1000 for _ in range(n)]
        tokens = np.array(body + list(range(suffixes.V + 1)), np.int64)
        starts = np.arange(n)
        got = np.concatenate(list(suffixes.sorted_buckets(tokens, starts, bucket=37)))
        assert got.tolist() == sorted(range(n), key=lambda i: tokens[i:].tolist())


def test_op3_agrees_with_its_sql(spark, small, duck):
    assert found(suffixes.op3_suffix_array(spark, small)) == {(a, b, c, d) for a, b, c, d in duck.execute(suffixes.OP3_SQL).fetchall()}


def test_against_brute_force(spark):
    r = random.Random(8)
    shared = [prose(100 + k, 70) for k in range(3)]
    rows = []
    for d in range(30):
        parts = [prose(d, r.randint(3, 60))]
        for s in r.sample(shared, r.randint(0, 2)):
            w = s.split()
            a = r.randint(0, 12)
            parts += [" ".join(w[a : a + r.randint(40, 70)]), prose(1000 + d, r.randint(1, 20))]
        rows.append((d, " ".join(parts)))
    rows += [(50, "again and " * 80), (51, shared[0] + " x " + shared[0])]
    assert found(suffixes.repeated_passages(frame(spark, rows))) == brute(rows, 50)
    assert found(suffixes.repeated_passages(frame(spark, rows), min_words=20, anchor=6)) == brute(rows, 20)


def test_awkward_rows(spark):
    rows = awkward()
    got = found(suffixes.repeated_passages(frame(spark, rows)))
    assert {d for d, *_ in got} == {5}
    assert suffixes.repeated_passages(frame(spark, [])).count() == 0
    assert suffixes.repeated_passages(frame(spark, [(1, None), (None, prose(1))])).count() == 0
