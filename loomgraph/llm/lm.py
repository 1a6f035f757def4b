"""Language-model scoring by masked pseudo-likelihood.

Words are told apart by 64-bit hashes. A network sees the two words on either side of each
masked word: their embeddings, weighted by place, go through a tanh layer to a softmax over
2**GROUP_BITS groups of words, and to another, the group's own, over the 2**CLASS_BITS classes in
it. Within a class a word has its share of the counts of all documents, which are kept word by
word in a table that grows with the corpus and is joined for scoring. So every word has a probability
given both sides, and a document's score is the sum of their logarithms.

Training covers all documents in ROUNDS synchronous rounds. In each, every task descends in numpy over
its share of the round's words, from the same parameters; the tasks' steps are averaged in a tree of
sums, an embedding's by how often each task saw it, and are taken with momentum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, text_frame, tree_sum, written
from .kernel import mix, words

GROUP_BITS, CLASS_BITS, INPUT_BITS = 6, 6, 15
WIDTH = 24
SIDES = (-2, -1, 1, 2)
ROUNDS = 10
MOMENTUM = 0.8
BATCH = 2048
#: Steps of embeddings, of what all words share, and of a group's own softmax.
RATE_EMBED, RATE, RATE_GROUP = 0.1, 1.0, 0.2
#: Characters of text in a row of the table of words.
ROW_CHARS = 1_000_000
_GROUPS, _CLASSES, _INPUTS, _LEAVES = 1 << GROUP_BITS, 1 << CLASS_BITS, 1 << INPUT_BITS, 1 << (GROUP_BITS + CLASS_BITS)


def leaf_of(h: np.ndarray) -> np.ndarray:
    """A word's group and class in one number."""
    return (h >> np.uint64(64 - GROUP_BITS - CLASS_BITS)).astype(np.int32)


def input_of(h: np.ndarray) -> np.ndarray:
    return (mix(h + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - INPUT_BITS)).astype(np.int32)


@dataclass
class Network:
    """embed: of each input; place: weights by side; hidden: bias; out: of the groups; own: of the classes in each group. Their last rows are biases.

    steps: sums of squared gradients of each embedding; seen: words that moved each embedding in this task.
    """

    embed: np.ndarray
    place: np.ndarray
    hidden: np.ndarray
    out: np.ndarray
    own: np.ndarray
    steps: np.ndarray
    seen: np.ndarray

    @classmethod
    def start(cls, leaf_counts: np.ndarray) -> Network:
        r = np.random.default_rng(11)
        by = leaf_counts.reshape(_GROUPS, _CLASSES) + 1.0
        per = by.sum(axis=1)
        f = np.float32
        out, own = np.zeros((WIDTH + 1, _GROUPS), f), np.zeros((_GROUPS, WIDTH + 1, _CLASSES), f)
        out[-1] = np.log(per / per.sum())
        own[:, -1] = np.log(by / per[:, None])
        return cls(
            r.normal(0, 0.1, (_INPUTS, WIDTH)).astype(f),
            np.repeat([[0.7 if abs(s) > 1 else 1.0] for s in SIDES], WIDTH, axis=1).astype(f),
            np.zeros(WIDTH, f),
            out,
            own,
            np.zeros(_INPUTS, f),
            np.zeros(_INPUTS, f),
        )

    def flat(self) -> np.ndarray:
        """All parameters, what all words share first."""
        return np.concatenate([getattr(self, name).ravel() for name in _PARTS])

    @classmethod
    def of_flat(cls, v: np.ndarray) -> Network:
        sizes = [int(np.prod(s)) for s in _PARTS.values()]
        parts = np.split(v.astype(np.float32), np.cumsum(sizes)[:-1])
        return cls(**{name: p.reshape(s) for (name, s), p in zip(_PARTS.items(), parts)}, seen=np.zeros(_INPUTS, np.float32))

    def _activate(self, x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """(embeddings, hidden layer and a one, (side, middle, neighbour, where that is in another document)) of a run of words."""
        e = self.embed[x]
        n = len(x)
        h = np.ones((n, WIDTH + 1), np.float32)
        z = h[:, :WIDTH]
        z[:] = self.hidden
        sides = []
        for k, s in enumerate(SIDES):
            a, b = slice(max(0, -s), max(0, n - max(0, s))), slice(max(0, s), max(0, n - max(0, -s)))
            if n > abs(s):
                z[a] += e[b] * self.place[k]
                over = np.flatnonzero(doc[a] != doc[b])  # neighbours in another document don't count
                z[a][over] -= e[b][over] * self.place[k]
                sides.append((k, a, b, over))
        np.tanh(z, out=z)
        return e, h, sides

    def _softmax(self, h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """(shares of the groups, shares of the classes in each row's group, (group, first row, end)); rows are in order of their group."""
        p = h @ self.out
        q = np.empty((len(h), _CLASSES), np.float32)
        edge = np.searchsorted(group, np.arange(_GROUPS + 1)).tolist()
        spans = [(g, lo, hi) for g, (lo, hi) in enumerate(zip(edge, edge[1:])) if lo < hi]
        for g, lo, hi in spans:
            np.matmul(h[lo:hi], self.own[g], out=q[lo:hi])
        for v in (p, q):
            np.minimum(v, np.float32(60), out=v)
            np.exp(v, out=v)
            v *= 1 / v.sum(axis=1, keepdims=True)
        return p, q, spans

    def learn(self, x: np.ndarray, doc: np.ndarray, leaf: np.ndarray) -> None:
        """One step down the gradient of -log p(leaf | both sides) over a run of words with inputs x."""
        n = len(x)
        e, h, sides = self._activate(x, doc)
        order = np.argsort(leaf, kind="stable")
        h, group, cls, at = h[order], leaf[order] >> CLASS_BITS, leaf[order] & (_CLASSES - 1), np.arange(n)
        p, q, spans = self._softmax(h, group)
        p[at, group] -= 1
        q[at, cls] -= 1
        back = p @ self.out[:WIDTH].T
        for g, lo, hi in spans:
            mine, own = q[lo:hi], self.own[g]
            back[lo:hi] += mine @ own[:WIDTH].T
            own -= (h[lo:hi].T * np.float32(RATE_GROUP / (hi - lo) ** 0.5)) @ mine
        self.out -= (RATE / n) * (h.T @ p)
        h = h[:, :WIDTH]
        back *= 1 - h * h
        self.hidden -= (RATE / n) * back.sum(axis=0)
        by_word = np.empty_like(back)
        by_word[order] = back
        g_embed, g_place = np.zeros_like(e), np.zeros_like(self.place)
        for k, a, b, over in sides:
            g = by_word[a]
            if len(over):
                g = g.copy()
                g[over] = 0
            g_place[k] = np.einsum("ij,ij->j", g, e[b])
            g_embed[b] += g * self.place[k]
        self.place -= (0.3 * RATE / n) * g_place
        order = np.argsort(x, kind="stable")
        own = x[order]
        lead = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        rows = own[lead]
        self.seen[rows] += np.diff(np.append(lead, n))
        self.steps[rows] += np.add.reduceat((np.einsum("ij,ij->i", g_embed, g_embed) / WIDTH)[order], lead)
        self.embed[rows] -= (RATE_EMBED / np.sqrt(self.steps[rows] + 1e-3))[:, None] * np.add.reduceat(g_embed[order], lead, axis=0)

    def log_shares(self, x: np.ndarray, doc: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """log p(leaf | both sides) of each word; words of a document stand together."""
        out = np.empty(len(x))
        reach = max(map(abs, SIDES))
        for lo in range(0, len(x), 8192):
            hi = min(len(x), lo + 8192)
            a, b = max(0, lo - reach), min(len(x), hi + reach)
            _, h, _ = self._activate(x[a:b], doc[a:b])
            h = h[lo - a : hi - a]
            order = np.argsort(leaf[lo:hi], kind="stable")
            own, at = leaf[lo:hi][order], np.arange(hi - lo)
            p, q, _ = self._softmax(h[order], own >> CLASS_BITS)
            out[lo + order] = np.log(p[at, own >> CLASS_BITS] + np.float32(1e-30)) + np.log(q[at, own & (_CLASSES - 1)] + np.float32(1e-30))
        return out


_PARTS = {"place": (len(SIDES), WIDTH), "hidden": (WIDTH,), "out": (WIDTH + 1, _GROUPS), "own": (_GROUPS, WIDTH + 1, _CLASSES), "steps": (_INPUTS,), "embed": (_INPUTS, WIDTH)}
_SHARED = sum(int(np.prod(s)) for s in list(_PARTS.values())[:-2])


def task_step(before: Network, after: Network, n: int) -> bytes:
    """What a task sends: its step in half precision, how often it saw each embedding, and its words."""
    d = np.clip(after.flat() - before.flat(), -60_000, 60_000).astype(np.float16)
    return d.tobytes() + after.seen.tobytes() + np.array([n], np.float32).tobytes()


def weighted(sent: bytes) -> np.ndarray:
    """A task_step() weighted by the task's words, and for embeddings by how often it saw each; the weights follow."""
    d = np.frombuffer(sent, np.float16, _SHARED + _INPUTS * (WIDTH + 1)).astype(np.float32)
    weights = np.frombuffer(sent, np.float32, offset=2 * len(d))
    d[:_SHARED] *= weights[-1]
    d[_SHARED : _SHARED + _INPUTS] *= weights[:-1]
    d[_SHARED + _INPUTS :] *= np.repeat(weights[:-1], WIDTH)
    return np.concatenate((d, weights))


@dataclass
class Averaged:
    """The parameters between rounds, and the momentum of what moves them."""

    net: Network
    speed: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))

    def take(self, total: np.ndarray) -> Averaged:
        """After the round whose weighted() steps have this sum."""
        d, seen, n = total[: -_INPUTS - 1].copy(), total[-_INPUTS - 1 : -1], total[-1]
        d[:_SHARED] /= n
        d[_SHARED : _SHARED + _INPUTS] /= np.maximum(seen, 1)
        d[_SHARED + _INPUTS :] /= np.repeat(np.maximum(seen, 1), WIDTH)
        speed = MOMENTUM * self.speed + d
        moved = d + MOMENTUM * speed
        moved[_SHARED : _SHARED + _INPUTS] = d[_SHARED : _SHARED + _INPUTS]  # sums of squares have no momentum
        return Averaged(Network.of_flat(self.net.flat() + moved), speed)


def fit(h: np.ndarray, doc: np.ndarray, net: Network) -> int:
    """Descent over a row's words in their order, a batch a step; the number of words."""
    x, leaf = input_of(h), leaf_of(h)
    for lo in range(0, len(h), BATCH):
        net.learn(x[lo : lo + BATCH], doc[lo : lo + BATCH], leaf[lo : lo + BATCH])
    return len(h)


_TABLE = "row long, ids binary, sizes binary, vocabulary binary, counts binary, tokens binary, round int"


def _packed(tokens: np.ndarray) -> bytes:
    """Numbers below 2**32 with their lowest bytes first, then the next, so that they compress well."""
    return np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4")[:, 0]


def word_table(docs: DataFrame) -> DataFrame:
    """docs as rows of some million characters, in the shared folder: the ids of documents (the least number for a null) and their
    numbers of words (-1 for a null text), the row's vocabulary (hashes in order) with its counts, and the words as indices into it.

    Each text is split once; rounds are folders of the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        chars = 0

        def emit() -> pa.RecordBatch:
            ids, sizes, h = (np.concatenate(x) for x in zip(*held))
            vocabulary, tokens, counts = np.unique(h, return_inverse=True, return_counts=True)
            own = [v.tobytes() for v in (ids, sizes, vocabulary.astype("<u8"), counts.astype("<i8"))]
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + row]), *(pa.array([v], pa.binary()) for v in own), pa.array([_packed(tokens)], pa.binary()), pa.array([(part + row) % ROUNDS], pa.int32())], [c.split()[0] for c in _TABLE.split(", ")])

        for ids, texts in chunks(batches):
            w = words(texts, fold=True)
            sizes = np.where([t is None for t in texts], -1, np.diff(w.first)).astype("<i8")
            held.append((np.array([-(2**63) if i is None else i for i in ids], "<i8"), sizes, w.hash))
            chars += sum(len(t) for t in texts if t)
            if chars >= ROW_CHARS:
                yield emit()
                held, chars, row = [], 0, row + 1
        if held:
            yield emit()

    return written(text_frame(docs).mapInArrow(run, _TABLE), "words", by="round")


def _docs_of(sizes: bytes) -> np.ndarray:
    n = np.maximum(np.frombuffer(sizes, "<i8"), 0)
    return np.repeat(np.arange(len(n), dtype=np.int32), n)


def _vocabularies(table: DataFrame) -> DataFrame:
    """(h, row, n): the words of each row of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, v, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                h, c = np.frombuffer(v, "<i8"), np.frombuffer(n, "<i8")
                for lo in range(0, len(h), 50_000):
                    part = h[lo : lo + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), row)), pa.array(c[lo : lo + 50_000])], ["h", "row", "n"])

    return table.select("row", "vocabulary", "counts").mapInArrow(run, "h long, row long, n long")


@dataclass
class Model:
    """vocabulary: (h, n), how often each word occurs, one row a word of the corpus; spread: log of the counts and words of each leaf, and one for unknown words."""

    net: Network
    vocabulary: DataFrame
    spread: np.ndarray


def train_on(table: DataFrame) -> Model:
    """The model of a word_table(). Counts by word stay distributed; one number a leaf comes to the driver."""
    vocabulary = written(_vocabularies(table).groupBy("h").agg(F.sum("n").alias("n")), "vocabulary")
    leaf = F.shiftrightunsigned("h", 64 - GROUP_BITS - CLASS_BITS).cast("int")
    per = vocabulary.groupBy(leaf.alias("leaf")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).toArrow()
    n, spread = np.zeros(_LEAVES), np.ones(_LEAVES)
    n[per["leaf"].to_numpy()] = per["n"].to_numpy()
    spread[per["leaf"].to_numpy()] += per["n"].to_numpy() + per["words"].to_numpy()
    state = Averaged(Network.start(n))
    for r in range(ROUNDS):
        start = table.sparkSession.sparkContext.broadcast(state.net.flat())

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            net, n = Network.of_flat(start.value), 0
            for b in batches:
                for sizes, v, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    n += fit(np.frombuffer(v, "<u8")[_unpacked(tokens)], _docs_of(sizes), net)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([task_step(Network.of_flat(start.value), net, n)], pa.binary())], ["m"])

        total = tree_sum(table.filter(F.col("round") == r).select("sizes", "vocabulary", "tokens").mapInArrow(run, "m binary"), dtype=np.float32, read=weighted)
        if total is not None:
            state = state.take(total)
        start.destroy()
    return Model(state.net, vocabulary, np.log(spread))


def score_on(table: DataFrame, model: Model) -> DataFrame:
    """score() of the documents of a word_table(): each row of it meets the counts of its vocabulary."""
    pairs = _vocabularies(table).select("h", "row").join(model.vocabulary, "h", "left").select("row", "h", F.coalesce("n", F.lit(0)).alias("n"))
    net, spread = model.net, model.spread
    given = table.sparkSession.sparkContext.broadcast(net.flat())

    def solve(rows: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        of = Network.of_flat(given.value)
        h, total = known["h"].to_numpy().view(np.uint64), known["n"].to_numpy()
        order = np.argsort(h)
        h, total = h[order], total[order]
        for ids, sizes, tokens in zip(*(rows[c].to_pylist() for c in ("ids", "sizes", "tokens"))):
            t = _unpacked(tokens)
            leaf, doc = leaf_of(h), _docs_of(sizes)
            share = np.log(total + 1) - spread[leaf]
            n = np.frombuffer(sizes, "<i8")
            score = np.bincount(doc, of.log_shares(input_of(h)[t], doc, leaf[t]) + share[t], len(n)).astype(float)
            absent, i = n < 0, np.frombuffer(ids, "<i8")
            mean = score / np.maximum(n, 1)
            out.append(pa.table([pa.array(i, mask=i == -(2**63)), pa.array(n, mask=absent), pa.array(score, mask=absent), pa.array(mean, mask=n < 1)], ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    return table.select("row", "ids", "sizes", "tokens").groupBy("row").cogroup(pairs.groupBy("row")).applyInArrow(solve, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")


def train(docs: DataFrame) -> Model:
    """The model of all texts of docs; null and empty ones add nothing, repeated rows count each time, very long ones are taken whole. Other columns are ignored."""
    return train_on(word_table(docs))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) of every row.

    A null text has nulls; a text without words 0, 0 and a null mean. Each repeated row is scored, rows without an id too; very long
    texts are scored whole; other columns are ignored. Words that the model hasn't seen count as one unknown word of their class.
    """
    return score_on(word_table(docs), model)


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """score() of docs under the model that train() makes of them; texts are split into words once."""
    table = word_table(docs)
    return score_on(table, train_on(table))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pseudo_likelihood() of all documents: a row each, with nulls for a null text and a null mean for one without words."""
    return pseudo_likelihood(spark.read.parquet(f"{sf_dir}/documents.parquet"))
