"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Every word enters as the sum of a word vector and of vectors of its character n-grams. A
window's hidden states, of both directions, are pooled by attention into one logit. A
text's score is that of its most toxic window. Windows of WINDOW words begin every STRIDE
words, half a window, and at the end, so any passage of up to STRIDE words is whole in one.

The network is trained here with numpy, through time, from random parameters, over a
bounded sample of labelled rows. At first every window takes its text's label, whatever it
holds; then only the window that decides a text's score learns (multiple-instance
learning), which lowers the windows of other texts that look worst.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import payloads, pick, prepare

WINDOW, STRIDE = 48, 24
#: Labelled rows that the fit takes at most, of each label, and bytes of a text that it takes whole or not at all.
FIT_TOXIC, FIT_OTHER, FIT_BYTES = 1500, 3000, 20_000
FOLDS = 5
#: Minibatches in which windows, drawn from all in turn, take their text's label; rounds over
#: all texts by their deciding windows, and minibatches of those at least.
FIRST_STEPS, ROUNDS, STEPS = 260, 3, 60
RATE, MINIBATCH = 0.01, 128
INPUT, HIDDEN, ATTENTION = 12, 10, 8
GRAMS, GRAM_BITS, WORDS = (3, 4, 5), 16, 20_000
#: Windows that run through the network at once.
BLOCK = 2048

SPLIT = bytes.maketrans(b".,;:!?\"'()[]{}<>*_-/\\|", b" " * 22)


def words(text: bytes) -> list[bytes]:
    """Words without ASCII punctuation, A-Z lower-cased."""
    return text.lower().translate(SPLIT).split()


def gram_sums(vocabulary: list[bytes], table: np.ndarray) -> np.ndarray:
    """For each word the mean vector of its character n-grams, in bytes, with marks at both ends."""
    return Grams(vocabulary).means(np.arange(len(vocabulary)), table)


def gram_rows(vocabulary: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the hashed n-grams of all words end to end, and where each word's begin.
    A word that is shorter than n, marks included, has one: all its bytes."""
    data = np.frombuffer(b"".join([b"^" + w + b"$" + b"\0" * max(GRAMS) for w in vocabulary]), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary)) + 2
    begin = np.concatenate([[0], np.cumsum(sizes + max(GRAMS))])[:-1]
    for n in GRAMS:
        counts = np.maximum(1, sizes - n + 1)
        at = np.concatenate([[0], np.cumsum(counts)])
        places = np.arange(at[-1]) - np.repeat(at[:-1], counts) + np.repeat(begin, counts)
        h = np.full(len(places), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            h = (h ^ data[places + i]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        yield (h * np.uint32(0x85EBCA6B) >> np.uint32(32 - GRAM_BITS)).astype(np.int32), at


def cut(n: int) -> list[tuple[int, int]]:
    """(begin, end) of the overlapping windows over n words: one at least, none inside another."""
    last = max(0, n - WINDOW)
    starts = list(range(0, last, STRIDE)) + [last]
    return [(s, min(n, s + WINDOW)) for s in starts]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    vocabulary: dict[bytes, int]
    p: dict[str, np.ndarray]
    bias: float = 0.0
    trained: bool = True
    seen: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(vocabulary: dict[bytes, int], seed: int = 11) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *s, k=1.0: (r.standard_normal(s) * k).astype(np.float32)
        p = {"word": f(len(vocabulary) + 1, INPUT, k=0.05), "gram": f(1 << GRAM_BITS, INPUT, k=0.05)}
        p["word"][0] = 0
        for d in "fb":
            p |= {f"w{d}": f(INPUT, 3 * HIDDEN, k=INPUT**-0.5), f"u{d}": f(HIDDEN, 3 * HIDDEN, k=HIDDEN**-0.5), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        p |= {"wa": f(2 * HIDDEN, ATTENTION, k=0.3), "va": f(ATTENTION, k=0.3), "out": f(2 * HIDDEN, k=0.3), "b0": np.zeros(1, np.float32)}
        return Network(vocabulary, p)

    def embed(self, distinct: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return self.p["word"][[get(w, 0) for w in distinct]] + gram_sums(distinct, self.p["gram"])

    def _direction(self, x: np.ndarray, places: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """Hidden states (steps, windows, HIDDEN); x: inputs' projections by distinct word."""
        n, steps = places.shape
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        u = self.p[f"u{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            xt, hu = x[places[:, t]], h @ u
            zr = sigmoid(xt[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r, hc = zr[:, :HIDDEN], zr[:, HIDDEN:], hu[:, 2 * HIDDEN :]
            c = np.tanh(xt[:, 2 * HIDDEN :] + r * hc)
            new = c + z * (h - c)
            m = mask[:, t, None]
            if keep is not None:
                keep.append((t, h, z, r, c, hc))
            h = np.where(m, new, h)
            out[t] = h
        return out

    def forward(self, e: np.ndarray, places: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; places: rows of e by window and step; mask: real words."""
        states = []
        for d in "fb":
            trail = None if keep is None else keep.setdefault(d, [])
            states.append(self._direction(e @ self.p[f"w{d}"] + self.p[f"b{d}"], places, mask, d, trail))
        h = np.concatenate(states, axis=2)
        a = np.tanh(h @ self.p["wa"])
        s = np.where(mask.T, a @ self.p["va"], np.float32(-30))
        s = np.exp(s - s.max(axis=0))
        s *= mask.T
        s /= np.maximum(s.sum(axis=0), np.float32(1e-9))
        pooled = (s[:, :, None] * h).sum(axis=0)
        if keep is not None:
            keep |= {"h": h, "a": a, "s": s, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["b0"][0]

    def backward(self, e: np.ndarray, places: np.ndarray, mask: np.ndarray, keep: dict, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the dense parameters, and of the rows of e."""
        p, h, a, s = self.p, keep["h"], keep["a"], keep["s"]
        g = {"out": keep["pooled"].T @ dlogit, "b0": dlogit.sum(keepdims=True)}
        dpooled = dlogit[:, None] * p["out"]
        dh = s[:, :, None] * dpooled
        ds = (h * dpooled).sum(axis=2)
        ds = s * (ds - (s * ds).sum(axis=0))
        g["va"] = (a * ds[:, :, None]).sum(axis=(0, 1))
        da = ds[:, :, None] * p["va"] * (1 - a * a)
        g["wa"] = h.reshape(-1, 2 * HIDDEN).T @ da.reshape(-1, ATTENTION)
        dh += da @ p["wa"].T
        n, steps = places.shape
        de, at = np.zeros_like(e), places.T.ravel()
        for k, d in enumerate("fb"):
            u = p[f"u{d}"]
            du, dx = np.zeros_like(u), np.zeros((steps, n, 3 * HIDDEN), e.dtype)
            carry = np.zeros((n, HIDDEN), e.dtype)
            for t, before, z, r, c, hc in reversed(keep[d]):
                m = mask[:, t, None]
                full = carry + dh[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                dn = np.where(m, full, 0)
                dc = dn * (1 - z) * (1 - c * c)
                dz = dn * (before - c) * z * (1 - z)
                dr = dc * hc * r * (1 - r)
                dhu = np.concatenate([dz, dr, dc * r], axis=1)
                du += before.T @ dhu
                dx[t, :, : 2 * HIDDEN], dx[t, :, 2 * HIDDEN :] = dhu[:, : 2 * HIDDEN], dc
                carry = np.where(m, dn * z + dhu @ u.T, full)
            dx = sums(dx.reshape(-1, 3 * HIDDEN), at, len(e))
            g |= {f"u{d}": du, f"w{d}": e.T @ dx, f"b{d}": dx.sum(axis=0)}
            de += dx @ p[f"w{d}"].T
        return g, de

    def step(self, name: str, gradient: np.ndarray, t: int, rate: float, rows: np.ndarray | slice = slice(None)) -> None:
        """Adam, at step t from 1; rows without gradients rest."""
        m, v = self.seen.setdefault(name, (np.zeros_like(self.p[name]), np.zeros_like(self.p[name])))
        m[rows] = 0.9 * m[rows] + 0.1 * gradient
        v[rows] = 0.99 * v[rows] + 0.01 * gradient * gradient
        self.p[name][rows] -= rate * m[rows] / (1 - 0.9**t) / (np.sqrt(v[rows] / (1 - 0.99**t)) + 1e-7)

    def logits(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows of texts, and the texts' first windows' places."""
        flat, distinct = numbered(texts)
        e = self.embed(distinct) if distinct else np.zeros((1, INPUT), np.float32)
        places, mask, first = windows(flat, list(map(len, texts)))
        parts = [self.forward(e, places[i : i + BLOCK], mask[i : i + BLOCK]) for i in range(0, len(places), BLOCK)]
        return np.concatenate(parts), first

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        """The greatest window probability of each text."""
        if not texts:
            return np.zeros(0)
        if not self.trained:
            return np.full(len(texts), 1 / (1 + np.exp(-self.bias)))
        logits, first = self.logits(texts)
        return 1 / (1 + np.exp(-np.maximum.reduceat(logits, first).astype(np.float64)))


def sums(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n rows: each the sum of the rows whose `at` is its number."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    own, total = grouped(rows, at)
    out[own] = total
    return out


def grouped(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct numbers of `at`, the sum of the rows of each)."""
    # numbers of 16 bits sort in linear time
    at = at.astype(np.uint16) if at.max() < 1 << 16 else at
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], np.add.reduceat(rows[order], first, axis=0)


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, list[bytes]]:
    """The words of all texts end to end, as numbers into the distinct ones."""
    words = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode()
    return words.indices.to_numpy(), words.dictionary.to_pylist()


def windows(flat: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts as rows of word numbers, which of them are real, and each text's
    first window; from the word numbers end to end and the texts' sizes."""
    begin, size, first, at = [], [], [], 0
    for n in sizes:
        first.append(len(begin))
        for s, x in cut(n):
            begin.append(at + s)
            size.append(x - s)
        at += n
    step = np.arange(WINDOW)
    mask = step[None, :] < np.array(size)[:, None]
    places = np.array(begin)[:, None] + step[None, :]
    flat = flat if len(flat) else np.zeros(1, np.int32)
    return flat[np.where(mask, places, 0)], mask, np.array(first)


class Grams:
    """The n-gram rows of a fixed list of words."""

    def __init__(self, vocabulary: list[bytes]):
        parts = [list(gram_rows(vocabulary[i : i + 20_000])) for i in range(0, len(vocabulary), 20_000)]
        self.rows = []
        for own in zip(*parts, strict=True):
            counts = np.concatenate([np.diff(at) for _, at in own])
            self.rows.append((np.concatenate([g for g, _ in own]), np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)))

    def of(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As gram_rows, for some of the words."""
        for g, at in self.rows:
            counts = at[words + 1] - at[words]
            ends = np.concatenate([[0], np.cumsum(counts)])
            yield g[np.arange(ends[-1]) + np.repeat(at[words] - ends[:-1], counts)], ends

    def means(self, words: np.ndarray, table: np.ndarray) -> np.ndarray:
        out = 0
        for g, at in self.of(words):
            out = out + np.add.reduceat(table[g], at[:-1], axis=0) / np.diff(at)[:, None]
        return (out / len(GRAMS)).astype(table.dtype)

    def gradient(self, words: np.ndarray, de: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the table, their gradients)."""
        h, d = [], []
        for g, at in self.of(words):
            h.append(g)
            d.append(np.repeat(de / (len(GRAMS) * np.diff(at)).astype(de.dtype)[:, None], np.diff(at), axis=0))
        return grouped(np.concatenate(d), np.concatenate(h))


def fit(texts: list[bytes], labels: list[int], rate: float | None = None, seed: int = 11) -> Network:
    """Trains on whole texts. rate: share of toxic texts where scores will be used; the
    sample's if None. Without rows of both labels the score is the labels' rate."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else -4.0
        return Network({}, {}, bias, False)
    split = [words(t) for t in texts]
    flat, distinct = numbered(split)
    sizes = list(map(len, split))
    ends = np.cumsum(sizes)
    counts = np.bincount(np.concatenate([np.unique(flat[e - n : e]) for e, n in zip(ends, sizes, strict=True)]), minlength=max(1, len(distinct)))
    common = [i for i in np.argsort(-counts, kind="stable")[:WORDS].tolist() if counts[i] > 1]
    net = Network.fresh({distinct[i]: k + 1 for k, i in enumerate(common)}, seed)
    distinct = distinct or [b""]
    grams = Grams(distinct)
    row = np.zeros(len(distinct), np.int64)
    row[common] = np.arange(len(common)) + 1
    embed = lambda ids: net.p["word"][row[ids]] + grams.means(ids, net.p["gram"])
    places, mask, first = windows(flat, sizes)
    bounds = np.append(first, len(places))
    of = np.repeat(np.arange(len(y)), np.diff(bounds))
    del split, flat
    net.p["b0"][0] = np.log(y.mean() / (1 - y.mean()))
    r = np.random.default_rng(seed)
    t = 0

    def train(chosen: np.ndarray, rate: float) -> None:
        nonlocal t
        t += 1
        own, at = np.unique(places[chosen], return_inverse=True)
        at, m = at.reshape(len(chosen), -1), mask[chosen]
        e, keep = embed(own), {}
        error = (sigmoid(net.forward(e, at, m, keep)) - y[of[chosen]]) / len(chosen)
        g, de = net.backward(e, at, m, keep, error.astype(np.float32))
        for k, v in g.items():
            net.step(k, v.astype(np.float32), t, rate / 2)
        ids = row[own]
        net.step("word", de[ids > 0], t, rate, ids[ids > 0])
        touched, dgram = grams.gradient(own, de)
        net.step("gram", dgram, t, rate, touched)

    drawn = np.concatenate([r.permutation(len(places)) for _ in range(-(-FIRST_STEPS * MINIBATCH // len(places)))])
    for i in range(FIRST_STEPS):
        train(drawn[i * MINIBATCH : (i + 1) * MINIBATCH], RATE)
    used, local = np.unique(places, return_inverse=True)
    local = local.reshape(places.shape)
    for _ in range(max(ROUNDS, -(-STEPS * MINIBATCH // len(y)))):
        e = np.concatenate([embed(used[i : i + 20_000]) for i in range(0, len(used), 20_000)])
        logits = np.concatenate([net.forward(e, local[i : i + BLOCK], mask[i : i + BLOCK]) for i in range(0, len(local), BLOCK)])
        best = np.array([a + int(np.argmax(logits[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        best = best[r.permutation(len(best))]
        for i in range(0, len(best), MINIBATCH):
            train(best[i : i + MINIBATCH], RATE / 2)
    net.seen = {}
    if rate is not None:
        odds = y.mean() / (1 - y.mean())
        net.p["b0"][0] += np.log(max(rate, 1e-3) / max(1 - rate, 1e-3)) - np.log(odds)
    return net


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


def learn(docs: DataFrame, labels: DataFrame) -> Network:
    """Fits on a bounded sample: of the documents with a label whose fold isn't held out and
    a text of up to FIT_BYTES, those with the least hashed ids, FIT_TOXIC toxic and FIT_OTHER
    other ones. Labels of documents that aren't there take no place in it. A doc_id that many
    rows repeat counts once; null ids, labels and texts aren't learned from."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    rows = pick(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(fold != 0)
    one = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fitting = pick(docs, "doc_id", "text").where(F.octet_length("text") <= FIT_BYTES)
    there = one.join(fitting.select("doc_id"), "doc_id", "left_semi")
    first = lambda y, n: there.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = first(1, FIT_TOXIC).union(first(0, FIT_OTHER)).withColumnRenamed("doc_id", "id")
    # FIT_TOXIC + FIT_OTHER rows of two numbers are broadcast
    held = fitting.join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    rate = one.agg(F.avg("toxic")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for b in batches:
            texts += payloads(b.column(0))
            toxic += b.column(1).to_pylist()
        net = fit(texts, toxic, rate)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((net.vocabulary, net.p, net.bias, net.trained))], pa.binary())], names=["model"])

    # the sample, bounded as it is, is one task's; the driver gets the network alone
    sample = held.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic")).repartition(1).sortWithinPartitions("doc_id")
    got = sample.select("text", "toxic").mapInArrow(run, "model binary").first()
    return Network(*pickle.loads(got["model"])) if got else fit([], [])


def score(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs (doc_id, text).

    The windows of the whole text are scored, and the greatest counts. Null and
    empty texts have one empty window. held_out tells whether the id's fold kept its label
    from the fit; a null id is in fold 0. Repeated rows score alike. An empty table gives no
    rows; other columns are never read.
    """
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((network.vocabulary, network.p, network.bias, network.trained))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(*model.value)
        for b in batches:
            s = net.scores([words(t) for t in payloads(b.column(1))])
            folds = [held_out(i) for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(folds, pa.bool_()), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, network: Network) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns. Each row is
    judged in place, by its own text: repeated rows alike, whatever their ids. Null texts
    stay; empty ones are judged as one empty window. An empty table gives no rows."""
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((network.vocabulary, network.p, network.bias, network.trained))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(*model.value)
        for b in batches:
            s = net.scores([words(t) for t in payloads(b.column(at))])
            yield b.filter(pa.array((s < 0.5) | b.column(at).is_null().to_numpy(zero_copy_only=False)))

    return docs.mapInArrow(run, docs.schema)
