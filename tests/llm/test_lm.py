import random

import numpy as np
import pandas as pd
from helpers import awkward, frame, prose

from loomgraph.llm import lm
from loomgraph.llm.kernel import words


def brute(net, share, text):
    """The sum of log p(word | two words to either side), word by word."""
    h = words([text], fold=True).hash
    x, leaf = lm.input_of(h), lm.leaf_of(h)
    total = 0.0
    for i in range(len(h)):
        z = net.hidden.astype(float).copy()
        for k, s in enumerate(lm.SIDES):
            if 0 <= i + s < len(h):
                z += net.embed[x[i + s]].astype(float) * net.place[k]
        a = np.append(np.tanh(z), 1)
        g, c = leaf[i] >> lm.CLASS_BITS, leaf[i] & (lm._CLASSES - 1)
        for logits, at in ((a @ net.out, g), (a @ net.own[g], c)):
            total += logits[at] - np.log(np.exp(logits).sum())
        total += share(h[i])
    return total


def shares(model):
    known = {int(np.int64(r.h).view(np.uint64)): r.n for r in model.vocabulary.collect()}
    return lambda h: np.log(known.get(int(h), 0) + 1) - model.spread[lm.leaf_of(np.array([h]))[0]]


def test_gradient_is_that_of_differences():
    r = np.random.default_rng(0)
    net = lm.Network.start(np.ones(lm._LEAVES))
    net.out[:], net.own[:] = r.normal(0, 0.3, net.out.shape), r.normal(0, 0.3, net.own.shape)
    x, leaf, doc = r.integers(0, 40, 64).astype(np.int32), r.integers(0, lm._LEAVES, 64).astype(np.int32), np.repeat([0, 1], 32)

    def loss(n):
        return -n.log_shares(x, doc, leaf).mean()

    before = loss(net)
    new = lm.Network.of_flat(net.flat())
    new.learn(x, doc, leaf)
    for name in ("hidden", "out", "place", "embed"):
        step = getattr(net, name) - getattr(new, name)
        at = np.unravel_index(np.abs(step).argmax(), step.shape)
        if name == "embed":  # its step is the gradient's sum over the root of the sum of squares
            g = step[at] / lm.RATE_EMBED * np.sqrt(new.steps[at[0]] + 1e-3) / 64
        else:
            g = step[at] / (lm.RATE * (0.3 if name == "place" else 1))
        near = lm.Network.of_flat(net.flat())
        getattr(near, name)[at] += 1e-2
        far = lm.Network.of_flat(net.flat())
        getattr(far, name)[at] -= 1e-2
        assert abs((loss(near) - loss(far)) / 2e-2 - g) < 0.05 * abs(g) + 1e-4, name
    assert loss(new) < before


def chained(seed, n):
    """Words that come in fixed pairs, so that a neighbour tells a word."""
    r = random.Random(seed)
    return " ".join(w for k in (r.randrange(40) for _ in range(n // 2)) for w in (f"left{k}", f"right{k}"))


def test_held_out_texts_are_likelier_than_by_counts_alone_and_than_shuffled_ones(spark):
    docs = frame(spark, [(k, chained(k, 600)) for k in range(400)]).repartition(3)
    model = lm.train(docs)
    held = [chained(1000 + k, 600) for k in range(20)]
    r = random.Random(4)
    mixed = [" ".join(r.sample(t.split(), len(t.split()))) for t in held]
    mean = lambda texts, m: np.mean([x.mean_log_likelihood for x in lm.score(frame(spark, list(enumerate(texts))), m).collect()])
    n = np.zeros(lm._LEAVES)
    for h, c in ((np.int64(x.h).view(np.uint64), x.n) for x in model.vocabulary.collect()):
        n[lm.leaf_of(np.array([h]))[0]] += c
    by_counts = lm.Model(lm.Network.start(n), model.vocabulary, model.spread)
    own = mean(held, model)
    assert own > mean(held, by_counts) + 0.3
    assert own > mean(mixed, model) + 0.3


def test_many_tasks_learn_nearly_what_one_does(small):
    """Held-out gain over the start, after all rounds, of 32 tasks against one task with all the words."""
    import duckdb

    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{small.replace('0.001', '0.1')}/documents.parquet' WHERE text IS NOT NULL ORDER BY hash(doc_id)").fetchall()]
    held, parts = [], []
    for k in range(33):
        w = words(texts[k::33], fold=True)
        (parts if k < 32 else held).append((w.hash, w.doc))
    n = sum(np.bincount(lm.leaf_of(h), minlength=lm._LEAVES) for h, _ in parts)

    def gain(net):
        h, doc = held[0]
        x, leaf = lm.input_of(h), lm.leaf_of(h)
        return (net.log_shares(x, doc, leaf) - lm.Network.start(n).log_shares(x, doc, leaf)).mean()

    def rounds(tasks):
        state = lm.Averaged(lm.Network.start(n))
        for r in range(lm.ROUNDS):
            total = 0
            for task in tasks:
                net, seen = lm.Network.of_flat(state.net.flat()), 0
                for h, doc in task:
                    a, b = (len(h) * k // lm.ROUNDS for k in (r, r + 1))
                    seen += lm.fit(h[a:b], doc[a:b], net)
                total = total + lm.weighted(lm.task_step(state.net, net, seen))
            state = state.take(total)
        return gain(state.net)

    alone = lm.Network.start(n)
    for h, doc in parts:
        lm.fit(h, doc, alone)
    one, many = gain(alone), rounds([[p] for p in parts])
    print("gains", one, many)
    assert many > 0.3 and many >= 0.8 * one


def test_scores_are_those_of_brute_force(spark):
    rows = [(k, prose(k, 80)) for k in range(5)] + [(9, "one")]
    docs = frame(spark, rows)
    model = lm.train(docs)
    share = shares(model)
    new = [*rows, (10, "stones unseen words"), (11, prose(11, 20_000))]
    got = {r.doc_id: r for r in lm.score(frame(spark, new), model).collect()}
    for i, t in new:
        assert abs(got[i].log_likelihood - brute(model.net, share, t)) < 1e-3 * max(1, abs(got[i].log_likelihood))
        assert got[i].n_tokens == len(t.split())


def test_counts_are_those_of_all_texts(spark):
    rows = [(1, "a b a"), (2, "b, c."), (2, "b, c."), (3, None)]
    model = lm.train(frame(spark, rows).repartition(3))
    h = words(["a b c"], fold=True).hash
    assert {r.h: r.n for r in model.vocabulary.collect()} == dict(zip(h.view(np.int64).tolist(), [2, 3, 2]))
    net = model.net  # for any context, all known words and the unknown one have shares that add up to one
    z = np.append(np.tanh(net.embed[7] * net.place[0] + net.hidden), 1)
    soft = lambda v: np.exp(v) / np.exp(v).sum()
    leaf = (soft(z @ net.out)[:, None] * np.array([soft(z @ net.own[g]) for g in range(lm._GROUPS)])).ravel()
    known = np.zeros(lm._LEAVES)
    np.add.at(known, lm.leaf_of(h), np.array([2, 3, 2]) + 1)
    assert abs((leaf * (known + 1) / np.exp(model.spread)).sum() - 1) < 1e-4


def test_sums_in_a_tree(spark):
    from loomgraph.llm.common import tree_sum

    def vectors(batches):
        for b in batches:
            yield pd.DataFrame({"m": [np.array([float(i), 1.0]).tobytes() for i in b["id"]]})

    df = spark.range(0, 40, 1, 40).mapInPandas(vectors, "m binary")
    assert tree_sum(df, fan_in=3).tolist() == [780.0, 40.0]
    assert tree_sum(df.limit(0)) is None


def test_op7_scores_every_document(spark, small):
    rows = lm.op7_lm(spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert all(r.log_likelihood < 0 for r in rows if r.n_tokens)


def test_awkward_rows(spark):
    rows = lm.pseudo_likelihood(frame(spark, awkward())).collect()
    assert len(rows) == len(awkward())
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in awkward())
    assert sum(r.log_likelihood is None for r in rows) == 3
    empty = next(r for r in rows if r.doc_id == 3)
    assert (empty.n_tokens, empty.log_likelihood, empty.mean_log_likelihood) == (0, 0.0, None)
    assert lm.pseudo_likelihood(frame(spark, [])).count() == 0
    assert lm.pseudo_likelihood(frame(spark, [(1, None), (2, "")])).count() == 2
