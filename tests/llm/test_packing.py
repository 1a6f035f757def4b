from collections import defaultdict

import numpy as np
from helpers import awkward, frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import packing


def brute_neighbours(ids, x, k):
    """(k nearest by (distance, id), squared distances) of each profile with words, all against all."""
    x = x.astype(float)
    words_ = np.flatnonzero(x.any(axis=1))
    out = {}
    for i in range(len(ids)):
        d = np.zeros(len(ids))
        for a in range(x.shape[1]):
            d += (x[i, a] - x[:, a]) ** 2
        order = sorted((float(d[j]), ids[j]) for j in words_ if j != i) if x[i].any() else []
        out[ids[i]] = order[:k]
    return out


def distinct_points(spark, docs):
    """The frame that neighbours() takes, and its ids and profiles: the smallest id of each profile."""
    rows = packing.vectors(docs.select("doc_id", "text")).filter("n > 0").orderBy("doc_id").collect()
    seen = {}
    for r in rows:
        seen.setdefault(bytes(r.v), r.doc_id)
    pts = spark.createDataFrame([(i, bytearray(v)) for v, i in seen.items()], "doc_id long, v binary")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(seen.values())
    return pts, ids, packing.profiles([texts[i] for i in ids])[1]


def found_edges(edges):
    got = defaultdict(dict)
    for r in edges.collect():
        got[r.doc_id][r.rank] = r.other
    return {i: [g[k] for k in sorted(g)] for i, g in got.items()}


def test_the_graph_is_that_of_brute_force(spark, small):
    pts, ids, x = distinct_points(spark, spark.read.parquet(f"{small}/documents.parquet"))
    want = {i: [j for _, j in e] for i, e in brute_neighbours(ids, x, 4).items() if e}
    for own, looking in ((packing.OWN, packing.LOOKING), (7, 30)):  # with the second, cells are dealt to several tasks
        _, edges = packing.neighbours(pts, k=4, cell_size=25, probes=10**6, own=own, looking=looking)
        assert found_edges(edges) == want


def test_neighbours_are_those_of_the_whole_profiles(spark):
    """Recall at 6 against brute force over the unprojected profiles, with more cells than a point looks through."""
    rows = [(100 * t + k, prose(1000 * t + k, 60 + k) + f" {' '.join(f'topic{t}word{(k * i) % 23}' for i in range(40))}") for t in range(40) for k in range(20)]
    pts, ids, x = distinct_points(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute_neighbours(ids, x, packing.NEIGHBOURS)
    _, edges = packing.neighbours(pts, cell_size=20)
    got = found_edges(edges)
    hits = sum(len(set(got[i]) & {j for _, j in want[i]}) for i in ids)
    assert hits / (len(ids) * packing.NEIGHBOURS) >= 0.9


def test_recall_on_the_documents(spark, small):
    """The same with the parameters of production on 10,000 documents: every 20th against all."""
    docs = spark.read.parquet(f"{small.replace('0.001', '0.1')}/documents.parquet")
    pts, ids, x = distinct_points(spark, docs)
    got = found_edges(packing.neighbours(pts, cell_size=500)[1])
    x = x.astype(np.float32)
    asked = [k for k in range(0, len(ids), 20) if x[k].any()]
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -1
    at = {i: k for k, i in enumerate(ids)}
    sixth = np.sort(s, axis=1)[:, -packing.NEIGHBOURS]
    hits = sum((s[n, [at[j] for j in got[ids[k]]]] >= sixth[n] - 1e-6).sum() for n, k in enumerate(asked))
    print("recall", hits / (len(asked) * packing.NEIGHBOURS))
    assert hits >= 0.9 * len(asked) * packing.NEIGHBOURS


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(0, 25), st.integers(1, 5), st.integers(0, 10**6))
def test_most_alike_is_brute_force(n, m, k, seed):
    r = np.random.default_rng(seed)
    unit = lambda z: (z / np.sqrt((z * z).sum(axis=1, keepdims=True))).astype(np.float32)
    y, ids = unit(r.random((n, 8)) + 0.01), np.sort(r.choice(1000, n, replace=False)).astype(np.int64)
    x, own = np.vstack([y[: n // 2], unit(r.random((m, 8)) + 0.01)]), np.concatenate([ids[: n // 2], np.full(m, -7)])
    row, other, d = packing.most_alike(x, own, y, ids, k)
    for i in range(len(x)):
        far = sorted((float(((x[i].astype(float) - y[j]) ** 2).sum()), int(ids[j])) for j in range(n) if ids[j] != own[i])[:k]
        assert [int(o) for o in other[row == i]] == [j for _, j in far]


def test_many_rows_are_searched_in_blocks():
    r = np.random.default_rng(3)
    y = r.random((9000, 16)).astype(np.float32)
    y /= np.sqrt((y * y).sum(axis=1, keepdims=True))
    ids = np.arange(9000) * 3
    row, other, _ = packing.most_alike(y[:700], ids[:700], y, ids, 6)
    s = y[:700] @ y.T
    s[np.arange(700), np.arange(700)] = -1
    want = np.argsort(-s, axis=1, kind="stable")[:, :6] * 3
    assert (np.sort(other.reshape(700, 6), axis=1) == np.sort(want, axis=1)).mean() > 0.999


def test_dense_cells_are_parted(spark, small):
    """Long texts of one language lie densely; with many cells none holds a large share of the points, and those looked through hold the neighbours."""
    texts = [r.text for r in spark.read.parquet(f"{small.replace('0.001', '0.1')}/documents.parquet").select("text").dropDuplicates().orderBy("text").collect()]
    x = np.concatenate([packing.profiles(texts[lo : lo + 500])[1] for lo in range(0, len(texts), 500)])
    x = x[np.random.default_rng(1).permutation(len(x))]
    sample = x[:4096]
    middle = packing.centres(sample, 79)
    assert np.bincount(packing._nearest_of(sample, middle)).max() <= 4 * (4096 // 79)
    near = packing.cells_of(x, middle, packing.tightness(sample, middle), packing.PROBES)
    assert (near[:, 0] == packing._nearest_of(x, middle)).all()
    asked = np.flatnonzero(x[:500].any(axis=1))
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -1
    home = near[np.argsort(-s, axis=1)[:, : packing.NEIGHBOURS], 0]
    assert (home[:, :, None] == near[asked][:, None, :]).any(axis=2).mean() >= 0.9


def test_counts_come_back_from_their_bytes():
    r = np.random.default_rng(2)
    small = r.integers(0, 256, (50, packing.BUCKETS))
    large = small.copy()
    large[3, 7], large[9, 0], large[20, 255] = 256, 70_000, 1 << 24
    for c in (small, large):
        v = packing._as_bytes(c)
        assert (packing._counts(v) == c).all() and len(v[0].as_py()) == packing.BUCKETS


def test_regions_are_bounded():
    r = np.random.default_rng(5)
    middle, sizes = r.random((40, 256)), r.integers(1, 100, 40)
    sizes[3] = 1000
    first, parts = packing.regions(middle, sizes, 300)
    held = defaultdict(int)
    for c in range(40):
        held[first[c], parts[c]] += sizes[c]
    assert all(n <= 300 * p for (_, p), n in held.items()) and parts[3] == 4
    assert (packing.regions(middle, sizes, 10**6)[0] == 0).all()


def brute_walk(ids, edges, degree):
    near = defaultdict(set)
    for a, b, d in edges:
        near[a].add((d, ids[b], b))
        near[b].add((d, ids[a], a))
    left, paths = set(range(len(ids))), []
    while left:
        node = min(left, key=lambda i: (degree[i], ids[i]))
        path = []
        while node is not None:
            left.discard(node)
            path.append(node)
            node = next((n for _, _, n in sorted(near[node]) if n in left), None)
        paths.append(path)
    return paths


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 12).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, max(0, n - 1)), st.integers(0, max(0, n - 1)), st.integers(0, 5)), max_size=30 if n else 0))))
def test_walks_are_those_of_brute_force(x):
    n, edges = x
    edges = [(a, b, d) for a, b, d in edges if a != b]
    degree = [len({b for a, b, _ in edges if a == i} | {a for a, b, _ in edges if b == i}) for i in range(n)]
    a, b, d = (np.array([e[k] for e in edges], float if k == 2 else np.int64) for k in range(3))
    assert packing.walk(np.arange(n), a, b, d, np.array(degree, np.int64)) == brute_walk(list(range(n)), edges, degree)


def check(rows, sizes, window):
    """Every token once; windows full but for the last of a region; positions count up."""
    tokens, used, positions = defaultdict(list), defaultdict(int), defaultdict(list)
    for r in rows:
        tokens[r.doc_id] += range(r.token_start, r.token_end)
        used[r.window_id] += r.token_end - r.token_start
        positions[r.window_id].append(r.position)
    assert {d: sorted(t) for d, t in tokens.items()} == {d: list(range(n)) for d, n in sizes.items() if n}
    assert all(sorted(p) == list(range(len(p))) for p in positions.values())
    last = {w >> 32: max(v for v in used if v >> 32 == w >> 32) for w in used}
    assert all(n == window or w == last[w >> 32] for w, n in used.items())


def test_op10_packs_every_token(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    check(packing.op10_packing(spark, small).collect(), {r.doc_id: len(r.text.split()) for r in docs}, packing.WINDOW)


def test_the_walk_follows_the_graph(spark, small):
    """The order of documents is that of a plain walk over the brute-force graph, or over its part in each region."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    pts, ids, x = distinct_points(spark, docs)
    near = brute_neighbours(ids, x, packing.NEIGHBOURS)
    index = {d: i for i, d in enumerate(ids)}
    edges = [(index[a], index[b], d) for a in ids for d, b in near[a]]
    degree = [len({b for a, b, _ in edges if a == i} | {a for a, b, _ in edges if b == i}) for i in range(len(ids))]
    for region in (packing.REGION, 60):
        homes = {r.doc_id: r.region for r in packing.neighbours(pts, cell_size=20, probes=10**6, region=region)[0].collect()}
        assert (len(set(homes.values())) == 1) == (region == packing.REGION)
        got = [r for r in packing.paths(spark.createDataFrame([(i, homes[i], 10) for i in ids], "doc_id long, region long, tokens long"), spark.createDataFrame([(ids[a], ids[b], d) for a, b, d in edges], "doc_id long, other long, d2 double")).collect()]
        for g in set(homes.values()):
            own = [i for i in range(len(ids)) if homes[ids[i]] == g]
            at = {i: k for k, i in enumerate(own)}
            inside = [(at[a], at[b], d) for a, b, d in edges if a in at and b in at]
            want = [ids[own[i]] for p in brute_walk([ids[i] for i in own], inside, [degree[i] for i in own]) for i in p]
            assert [r.doc_id for r in sorted((r for r in got if r.region == g), key=lambda r: r.start)] == want
    rows = sorted(packing.pack_related(docs).collect(), key=lambda r: (r.window_id, r.position))
    seen = list(dict.fromkeys(r.doc_id for r in rows if r.doc_id in index))
    assert seen == [ids[i] for p in brute_walk(ids, edges, degree) for i in p]


def test_documents_of_one_profile_follow_one_another(spark):
    """Thousands of copies are one point and none is lost."""
    rows = [(k, "the very same words again") for k in range(3000)] + [(10_000 + k, prose(k, 40)) for k in range(20)]
    got = packing.pack_related(frame(spark, rows), window=50).collect()
    check(got, {i: len(t.split()) for i, t in rows}, 50)
    order = list(dict.fromkeys(r.doc_id for r in sorted(got, key=lambda r: (r.window_id, r.position))))
    copies = [k for k, i in enumerate(order) if i < 3000]
    assert copies == list(range(copies[0], copies[0] + 3000))


def test_related_documents_are_packed_together(spark):
    topics = [[f"{t}word{i}" for i in range(30)] for t in ("aa", "bb", "cc")]
    rows = [(100 * t + k, " ".join(topics[t][(k * 7 + i) % 30] for i in range(60))) for k in range(12) for t in range(3)]
    got = sorted(packing.pack_related(frame(spark, rows), window=60).collect(), key=lambda r: (r.window_id, r.position))
    order = {r.doc_id // 100 for r in got}
    changes = sum(a.doc_id // 100 != b.doc_id // 100 for a, b in zip(got, got[1:]))
    assert len(order) == 3 and changes <= 8


def test_awkward_rows(spark):
    docs = frame(spark, awkward())
    got = packing.pack_related(docs, window=64).collect()
    sizes = {1: 120, 5: 120, 6: len(awkward()[8][1].split()), 7: 9000, 8: 3}
    check(got, sizes, 64)
    assert packing.pack_related(frame(spark, [])).count() == 0
    assert packing.pack_related(frame(spark, [(1, None), (2, "")])).count() == 0
    check(packing.pack_related(frame(spark, [(1, "one two")])).collect(), {1: 2}, packing.WINDOW)
