"""Embedding near-duplicates by spherical-cap filters.

Filter directions are the words of a structured random product code: after a random
rotation, a vector is cut into two halves, each half has a code of random unit vectors,
and every pair of code words is a filter. A vector is list-decoded to all filters whose
inner product with it reaches a threshold: the halves' products are sorted, and only pairs
that can reach it are visited. Vectors meet in filters, and their cosines decide.

A pair that shares several filters is judged in the first that it shares, so it is
counted once although nothing but counts and forests leaves a filter: for each vector its
number of partners, and edges that connect what is linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, parallelism, stored
from .components import connected_components
from .vectors import as_bytes, element, matrix, unit

LEAST = 0.9
#: Independent codes; filters of each that a random vector passes on average, and vectors
#: that then meet in one. The lists of one product code vary much in length; those of
#: several even out, so that few pairs share no filter.
CODES, PASSED, MEET = 8, 4, 64
#: Vectors of fewer dimensions aren't halved, and no cap is narrower than this cosine.
PRODUCT_FROM, WIDEST = 16, 0.8
#: Members of a filter that one task compares at once; larger filters are cut into blocks,
#: and every two blocks of a filter meet.
BLOCK = 512
SEED = 5


class Codes:
    """Independent product codes for dimension d and about n vectors, their filters
    numbered through."""

    def __init__(self, d: int, n: int, seed: int = SEED):
        self.codes = [Code(d, n, seed + 1000 * k) for k in range(CODES)]
        self.size = self.codes[0].sizes[0] * self.codes[0].sizes[1]

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the sorted numbers of all filters that it passes."""
        lists = [c.decode(x) for c in self.codes]
        return [np.concatenate([own[i] + k * self.size for k, own in enumerate(lists)]) for i in range(len(x))]


class Code:
    """A product code for dimension d and about n vectors."""

    def __init__(self, d: int, n: int, seed: int = SEED):
        r = np.random.default_rng([seed, d])
        size = max(8, math.ceil(math.sqrt(PASSED * max(n, 1) / MEET)))
        self.rotation = np.linalg.qr(r.standard_normal((d, d)))[0]
        if d >= PRODUCT_FROM:
            self.half, self.scale = d // 2, math.sqrt(0.5)
            self.code = [unit(r.standard_normal((size, k))) for k in (self.half, d - self.half)]
        else:
            # too few dimensions to halve: one code of as many words as pairs would be
            self.half, self.scale = d, 1.0
            self.code = [unit(r.standard_normal((min(size * size, 4096), d))), np.zeros((1, 1))]
        self.sizes = tuple(len(c) for c in self.code)
        # the threshold that a share PASSED of all filters exceeds, for random directions
        a, b = self.products(unit(r.standard_normal((256, d))))
        if b.shape[1] > 512:
            b = b[:, r.integers(0, b.shape[1], 512)]
            a = a[:, r.integers(0, a.shape[1], 512)]
        share = min(1.0, PASSED / (self.sizes[0] * self.sizes[1]))
        self.least = min(WIDEST, float(np.quantile((a[:, :, None] + b[:, None, :]).ravel(), 1 - share)))

    def products(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = x @ self.rotation
        parts = y[:, : self.half], y[:, self.half :] if y.shape[1] > self.half else np.zeros((len(y), 1))
        return tuple(p @ c.T * self.scale for p, c in zip(parts, self.code, strict=True))

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the sorted numbers of all filters that it passes."""
        a, b = self.products(x)
        order = np.argsort(-b, axis=1)
        b = np.take_along_axis(b, order, axis=1)
        row, i = np.nonzero(a + b[:, :1] >= self.least)
        need = self.least - a[row, i]
        # of each sorted row, how many reach what its partner needs: one search in all rows,
        # set apart by more than products can differ
        flat = (-b + 8.0 * np.arange(len(b))[:, None]).ravel()
        count = np.searchsorted(flat, -need + 8.0 * row, side="right") - row * self.sizes[1]
        at = np.repeat(np.arange(len(row)), count)
        j = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        filters = i[at] * self.sizes[1] + order[row[at], j]
        out = np.split(filters, np.searchsorted(row[at], np.arange(1, len(x))))
        return [np.sort(f) for f in out]


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data = b.column(1).to_pylist()
        keys = [None if v is None else xxhash.xxh3_128_digest(v) for v in data]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), b.column(1)], names=["vec_id", "key", "vector"])


def _members(kind: str, n: int, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Codes] = {}
        for b in batches:
            ids, data, many = (c.to_pylist() for c in b.columns)
            out: list[list] = [[], [], [], [], []]
            for size in sorted({len(v) for v in data}):
                own = [i for i, v in enumerate(data) if len(v) == size]
                x = unit(matrix([data[i] for i in own], kind))
                d = x.shape[1]
                code = codes.get(d) or codes.setdefault(d, Codes(d, n))
                for at in range(0, len(own), 256):
                    for i, filters in zip(own[at : at + 256], code.decode(x[at : at + 256]), strict=True):
                        # vectors of different dimension never meet
                        out[0] += (filters + (d << 44)).tolist()
                        if full:
                            packed = filters.astype("<i8" if CODES * code.size >> 31 else "<i4").tobytes()
                            for c, v in zip(out[1:], (ids[i], many[i], data[i], packed), strict=True):
                                c += [v] * len(filters)
            if not full:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64())], names=["filter"])
                continue
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            for at in range(0, len(out[0]), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 8192], k) for c, k in zip(out, kinds, strict=True)], names=["filter", "cid", "n", "vector", "filters"])

    return run


def _first_shared(lists: list[np.ndarray], of: int) -> np.ndarray:
    """For all pairs: do they share no filter before `of`?"""
    before = [f[: np.searchsorted(f, of)] for f in lists]
    known, place = np.unique(np.concatenate(before), return_inverse=True)
    out = np.ones((len(lists), len(lists)), bool)
    if len(known):
        held = np.zeros((len(lists), len(known)), np.float32)
        held[np.repeat(np.arange(len(lists)), [len(f) for f in before]), place] = 1
        shared = np.flatnonzero(held.sum(axis=0) > 1)
        if len(shared):
            held = held[:, shared]
            out = held @ held.T == 0
    return out


def _compare(kind: str, least: float, n: int):
    """Members of one filter, or of two blocks of it, in a row: counts and forests."""
    wide: dict[int, str] = {}

    def judge(of: tuple, rows: list[tuple]) -> tuple[list, list, list, list]:
        filter_, a, b = of
        ids = np.array([r[0] for r in rows], np.int64)
        many = np.array([r[1] for r in rows], np.int64)
        block = np.array([r[2] for r in rows])
        x = unit(matrix([r[3] for r in rows], kind))
        linked = x @ x.T >= least
        np.fill_diagonal(linked, False)
        if a != b:
            linked &= block[:, None] != block[None, :]
        live = np.flatnonzero(linked.any(axis=1))
        if not len(live):
            return [], [], [], []
        d = x.shape[1]
        lists = [np.frombuffer(rows[i][4], wide.get(d) or wide.setdefault(d, "<i8" if CODES * Codes(d, n).size >> 31 else "<i4")) for i in live]
        linked = linked[np.ix_(live, live)] & _first_shared(lists, filter_ - (d << 44))
        ids, many = ids[live], many[live]
        counts = linked @ many
        # a forest over what is linked: each row, unless reached, reaches out breadth first
        label = np.arange(len(ids))
        while True:
            # rows without links keep their own label
            reach = np.where(linked, label[None, :], len(ids)).min(axis=1)
            new = np.minimum(label, reach)
            new = new[new]
            if (new == label).all():
                break
            label = new
        u = np.flatnonzero(label != np.arange(len(ids)))
        held = np.flatnonzero(counts)
        return ids[held].tolist(), counts[held].tolist(), ids[u].tolist(), ids[label[u]].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        out: tuple[list, list, list, list] = ([], [], [], [])

        def flush() -> pa.RecordBatch:
            n, e = len(out[0]), len(out[2])
            batch = pa.RecordBatch.from_arrays([pa.array(out[0] + out[2], pa.int64()), pa.array(out[1] + [None] * e, pa.int64()), pa.array([None] * n + out[3], pa.int64())], names=["cid", "count", "to"])
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            for f, a, b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (f, a, b) != now:
                    if len(rows) > 1:
                        for c, got in zip(out, judge(now, rows), strict=True):
                            c += got
                    now, rows = (f, a, b), []
                    if len(out[0]) + len(out[2]) > 20_000:
                        yield flush()
                rows.append(tuple(row))
        if len(rows) > 1:
            for c, got in zip(out, judge(now, rows), strict=True):
                c += got
        yield flush()

    return run


def near_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id, embedding).

    n_links counts other rows linked directly: those found with cosine >= least, in double
    precision. Equal vectors are one class, which is compared once and counts as often as it
    has rows. Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing: 0 links, a component of their own. Vectors of different dimension don't
    link. component_id ignores null ids unless all are; a row with a null id isn't kept. An
    empty table gives no rows; other columns are ignored.
    """
    kind = element(vectors)
    rows = stored(as_bytes(vectors).mapInArrow(_classes, "vec_id long, key binary, vector binary"), "vectors")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.min("vector").alias("vector"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    source = classes.select("cid", "vector", "n").repartition(parallelism(vectors.sparkSession))
    full = "filter long, cid long, n long, vector binary, filters binary"
    sizes = source.mapInArrow(_members(kind, n, False), "filter long").groupBy("filter").count()
    large = sizes.where(F.col("count") > BLOCK).select(F.col("filter").alias("f"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    members = source.mapInArrow(_members(kind, n, True), full).join(large, F.col("filter") == F.col("f"), "left")
    block = F.pmod(F.xxhash64("cid"), F.coalesce("blocks", F.lit(1))).cast("int")
    others = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
    met = members.withColumn("block", block).withColumn("other", F.explode(others))
    met = met.select("filter", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "cid", "n", "block", "vector", "filters")
    parts = met.repartition(parallelism(vectors.sparkSession), "filter", "a", "b").sortWithinPartitions("filter", "a", "b")
    found = stored(parts.mapInArrow(_compare(kind, least, n), "cid long, count long, to long"), "links")
    counts = found.where("count is not null").groupBy("cid").agg(F.sum("count").alias("links"))
    label = connected_components(found.where("to is not null").select(F.col("cid").alias("u"), F.col("to").alias("v")))
    joined = classes.select("key", "cid", "least", "n").join(counts, "cid", "left").join(label, F.col("cid") == F.col("node"), "left")
    joined = stored(joined.select("key", "least", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("label", "cid").alias("label")), "joined")
    ids = joined.groupBy("label").agg(F.min("least").alias("component"))
    by_key = stored(joined.join(ids, "label").select("key", "links", "component", "n"), "by-key")
    out = hot_join(rows.select("vec_id", "key"), by_key, "key", "n", "left")
    # a class without rows besides, in a component whose ids are all null, has no component
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
