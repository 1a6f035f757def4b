import random
from itertools import combinations

import numpy as np
from helpers import awkward, frame, ids, prose

from loomgraph.llm import simhash


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(f"new{r.randrange(10**6)}" if r.random() < share else w for w in text.split())


def test_the_code_covers_all_values():
    _, offset, errors, weight = simhash.covering()
    assert (np.diff(offset) > 0).all()  # each syndrome has errors, so each value has anchors near it
    for s in range(0, 2048, 97):
        own = weight[offset[s] : offset[s + 1]]
        assert (own <= simhash.RADIUS).sum() == 1


def test_anchors_are_code_words_within_reach():
    r = np.random.default_rng(1)
    v = r.integers(0, 1 << 23, 200).astype(np.uint32)
    row, anchor, home = simhash.near_anchors(v)
    for i, a, h in zip(row, anchor, home):
        word = next(c for c in range(int(a) << 11, (int(a) + 1) << 11) if simhash._remainder(c) == 0)
        d = (word ^ int(v[i])).bit_count()
        assert d <= simhash.RADIUS + simhash.THRESHOLD and h == (d <= simhash.RADIUS)


def near_pairs(f, ids_, most):
    return {(ids_[i], ids_[j]) for i, j in combinations(range(len(f)), 2) if simhash.distance(f[i], f[j]) <= most}


def groups(pairs, every):
    root = {i: i for i in every}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in every}


def test_recall_against_brute_force(spark):
    rows = []
    for k in range(60):
        base = prose(k, 150 + 3 * k)
        rows.append((10 * k, base))
        rows += [(10 * k + j, edited(base, 0.02 * j, 7 * k + j)) for j in range(1, 4)]
    have, f = simhash.fingerprints([t for _, t in rows])
    want = groups(near_pairs(f, [rows[i][0] for i in have], simhash.MAX_BITS), [i for i, _ in rows])
    removed = {i for i, r in want.items() if i != r}
    sure = groups(near_pairs(f, [rows[i][0] for i in have], 3 * simhash.BLOCKS - 1), [i for i, _ in rows])
    for limit in (simhash.GROUP_RECORDS, 400):  # with the smaller one, anchors are dealt to several parts
        got = {r.doc_id: r.kept_id for r in simhash.near_duplicates(frame(spark, rows), limit=limit).collect()}
        assert removed and len(removed & got.keys()) >= 0.99 * len(removed)
        assert {i for i, r in sure.items() if i != r} <= got.keys()  # up to 23 bits all are found
        assert all(want[i] == want[k] for i, k in got.items())  # no pair that brute force hasn't


def far_pairs(n=1500):
    """Fingerprints in pairs that differ by 24 to 30 bits, and the pairs."""
    r = np.random.default_rng(8)
    f = r.integers(0, 1 << 63, (n, 3), np.uint64)
    f[:, 2] &= np.uint64((1 << 56) - 1)
    g = f.copy()
    for k in range(n):
        for bit in r.permutation(184)[: 24 + k % 7]:
            g[k, bit // 64] ^= np.uint64(1 << int(bit) % 64)
    return np.concatenate((f, g)), {(k, k + n) for k in range(n)}


def test_no_pair_within_the_limit_is_missed():
    f, pairs = far_pairs()
    a, b = simhash.compare(simhash._records(f, np.arange(len(f))), simhash.MAX_BITS)
    assert set(zip(b.tolist(), a.tolist())) == pairs


def test_no_pair_is_missed_by_way_of_groups(spark):
    """The same where a fingerprint goes once to a group of anchors, and where anchors are dealt to several parts."""
    f, pairs = far_pairs(150)
    prints = spark.createDataFrame([(k, *map(int, x.view("int64"))) for k, x in enumerate(f)], "doc_id long, f0 long, f1 long, f2 long")
    for limit in (simhash.GROUP_RECORDS, 300, 5):
        sets = simhash._to_anchors(prints, limit).groupBy("grp", "part").agg({"block": "collect_list"}).toDF("g", "p", "b").collect()
        found = {(int(b), int(a)) for s in sets for a, b in zip(*simhash.compare(np.frombuffer(b"".join(map(bytes, s.b)), simhash._WIRE), simhash.MAX_BITS))}
        assert found == pairs


def test_a_part_is_bounded(spark):
    """Many different texts around the same anchors: no part holds more than the limit, and none of the pairs is lost."""
    base = prose(1, 400)
    rows = [(k, edited(base, 0.01, k)) for k in range(400)]
    have, f = simhash.fingerprints([t for _, t in rows])
    leads = spark.createDataFrame([(int(rows[i][0]), *map(int, f[k].view("int64"))) for k, i in enumerate(have)], "doc_id long, f0 long, f1 long, f2 long").dropDuplicates(["f0", "f1", "f2"])
    blocks = simhash._to_anchors(leads, 500).groupBy("grp", "part").agg({"block": "collect_list"}).toDF("g", "p", "b").collect()
    sizes = [sum(map(len, r.b)) // simhash._WIRE.itemsize for r in blocks]
    assert max(sizes) <= 2 * 500 and len(sizes) > 10
    edges = {(a, b) for r in blocks for a, b in zip(*map(list, simhash.compare(np.frombuffer(b"".join(map(bytes, r.b)), simhash._WIRE), simhash.MAX_BITS)))}
    ids_ = sorted(r.doc_id for r in leads.collect())
    at = {rows[i][0]: f[k] for k, i in enumerate(have)}
    want = groups(near_pairs([at[i] for i in ids_], ids_, 3 * simhash.BLOCKS - 1), ids_)
    assert groups(edges, ids_) == want or len(set(groups(edges, ids_).values())) <= len(set(want.values()))


def test_short_words_count():
    """Texts that share their long words and differ in all others aren't near."""
    a = "my aeroplane is at the big telephone by our carriage"
    b = "an aeroplane has no red telephone or its old carriage"
    _, f = simhash.fingerprints([a, b])
    assert simhash.distance(f[0], f[1]) > simhash.MAX_BITS


def test_votes_do_not_depend_on_the_batch():
    texts = [prose(k, n) for k, n in enumerate((3, 40_000, 10, 35_000, 200))]
    together = simhash.fingerprints(texts)[1]
    assert all((simhash.fingerprints([t])[1][0] == f).all() for t, f in zip(texts, together))


def test_op6_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    have, f = simhash.fingerprints([r.text for r in docs])
    want = groups(near_pairs(f, [docs[i].doc_id for i in have], simhash.MAX_BITS), [r.doc_id for r in docs])
    removed = {i for i, r in want.items() if i != r}
    got = {r.doc_id: r.kept_id for r in simhash.op6_simhash(spark, small).collect()}
    assert got.keys() <= removed and len(got) >= 0.99 * len(removed)
    assert all(want[i] == want[k] for i, k in got.items())


def test_near_copies_go_and_unrelated_texts_stay(spark):
    base = prose(1, 300)
    rows = [(1, base), (2, edited(base, 0.03, 1)), (3, base.upper()), (4, base.replace(".", ",")), (5, prose(2, 300).replace("stone", "lake").replace("river", "hill"))]
    other = " ".join(f"w{i}x" for i in range(200))
    assert ids(simhash.near_dedup(frame(spark, [*rows[:4], (9, other)]))) == [1, 9]


def test_chains_are_one_group(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.v: r.root for r in simhash.components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 101)}, 501: 500}


def test_awkward_rows(spark):
    docs = frame(spark, awkward())
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert ids(kept) == [1, 2, 3, 4, 6, 7, 8, 8, None, None]
    assert simhash.near_dedup(frame(spark, [])).count() == 0
    assert simhash.near_duplicates(frame(spark, [(1, None), (2, "")])).count() == 0


def test_thousands_of_copies(spark):
    rows = [(k, prose(1)) for k in range(3000)] + [(5000, edited(prose(1), 0.02, 5))]
    assert ids(simhash.near_dedup(frame(spark, rows))) == [0]
