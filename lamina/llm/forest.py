"""Approximate nearest neighbours with a forest of hash prefixes.

The forest spans all vectors: in each tree every distinct vector has a 64-bit hash string,
and the tree is the sorted array of them, laid out over tasks by the string's first bits.
The first eight bits name the closest of 128 random directions and its sign, the others are
sides of random hyperplanes. A query descends each tree to its longest matching prefixes:
a first pass counts, for each tree and each prefix length, how many strings share it. All
trees then ascend together, one bit at a time, until their counts add up to enough
candidates. A second pass scores what shares a prefix of that length, and nothing else:
in a sorted array those are neighbours.

What moves is a fixed number of copies of each vector, one for each tree; a query meets one
part of each tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, parallelism, runs, stored
from .vectors import as_bytes, element, matrix, unit

NEAREST = 5
EVERY = 50
TREES, BITS = 64, 64
#: Random directions of a string's first symbol, and its bits with the sign.
DIRECTIONS, SYMBOL = 128, 8
#: Candidates (a tree's each count) that end the ascent: FACTOR * n ** POWER, and a share of n at most.
FACTOR, POWER, SHARE = 7.0, 0.65, 0.4
#: Strings of a part of a tree, about; parts with more are split.
BLOCK = 8192
SEED = 3
HASHED = "d int, tree int, h long, cid long"
FOUND = "q long, v long, least long, score double"


class Hasher:
    """Hash strings of unit vectors of dimension d, in all trees."""

    def __init__(self, d: int):
        r = np.random.default_rng([SEED, d])
        self.directions = r.standard_normal((d, TREES * DIRECTIONS)).astype(np.float32)
        self.planes = r.standard_normal((d, TREES * (BITS - SYMBOL))).astype(np.float32)

    def strings(self, u: np.ndarray) -> np.ndarray:
        """(vectors, trees) numbers, a string's first bit highest."""
        u = u.astype(np.float32)
        y = (u @ self.directions).reshape(len(u), TREES, DIRECTIONS)
        best = np.abs(y).argmax(axis=2)
        sign = np.take_along_axis(y, best[:, :, None], axis=2)[:, :, 0] > 0
        sides = np.packbits((u @ self.planes > 0).reshape(len(u), TREES, BITS - SYMBOL), axis=2)
        first = (best << 1 | sign).astype(np.uint8)[:, :, None]
        return np.ascontiguousarray(np.concatenate([first, sides], axis=2)).view(">u8")[:, :, 0].astype(np.uint64)


def needed(n: int, k: int, factor: float = FACTOR, share: float = SHARE) -> int:
    """Candidates at which the ascent among n vectors ends."""
    return max(k + 1, math.ceil(min(factor * n**POWER, share * n)))


def levels(low: int) -> list[int]:
    """Prefix lengths of the ascent, from the shortest on: every bit at first, then every fourth."""
    fine = list(range(low, min(low + 24, BITS) + 1))
    return fine + list(range(fine[-1] + 4, BITS + 1, 4))


def span(h: np.ndarray, asked: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where, in sorted h, strings that share the first `level` bits with each asked begin and end."""
    if not level:
        return np.zeros(len(asked), np.int64), np.full(len(asked), len(h), np.int64)
    rest = np.uint64((1 << (BITS - level)) - 1)
    return np.searchsorted(h, asked & ~rest, "left"), np.searchsorted(h, asked | rest, "right")


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [xxhash.xxh3_128_digest(v) for v in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), b.column(1)], names=["vec_id", "key", "vector"])


def _hash(kind: str, others: tuple[str, ...]):
    """(cid, vector, others...) -> for each tree (d, tree, h, cid, others...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}
        for b in batches:
            data = b.column(1).to_pylist()
            for size in sorted({len(v) for v in data}):
                own = np.array([i for i, v in enumerate(data) if len(v) == size])
                for at in range(0, len(own), 256):
                    part = own[at : at + 256]
                    u = unit(matrix([data[i] for i in part], kind))
                    d = u.shape[1]
                    h = (hashers.get(d) or hashers.setdefault(d, Hasher(d))).strings(u)
                    rows = b.take(pa.array(np.repeat(part, TREES)))
                    keys = [np.full(h.size, d, np.int32), np.tile(np.arange(TREES, dtype=np.int32), len(part)), h.ravel().view(np.int64)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, keys), rows.column(0), *rows.columns[2:]], names=["d", "tree", "h", "cid", *others])

    return run


def _count(steps: list[int]):
    """Parts of trees -> (cid, counts): for each query how many other strings share each prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in runs(batches, 4):
            h, asks = b.column(4).to_numpy().view(np.uint64), b.column(6).to_numpy(zero_copy_only=False)
            held, asked = np.sort(h[~asks]), h[asks]
            if not len(asked):
                continue
            spans = [span(held, asked, level) for level in steps]
            counts = np.stack([hi - lo for lo, hi in spans], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, counts.size + 1, len(steps)), pa.int32()), pa.array(counts.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(5).filter(pa.array(asks)), lists], names=["cid", "counts"])

    return run


def best_of(x: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k rows of x closest to q, ties to the smaller `least`."""
    rough = x.astype(np.float32) @ q.astype(np.float32)
    own = np.arange(len(rough))
    if len(rough) > k:
        own = np.flatnonzero(rough >= np.partition(rough, -k)[-k] - 1e-5)
    # scored anew in double precision row by row: equal vectors get equal scores
    s = (q * x[own]).sum(axis=1)
    best = np.lexsort((least[own], -s))[:k]
    return own[best], s[best]


def _score(kind: str, k: int):
    """Parts of trees -> (q, v, least, score): the best k of what shares the query's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in runs(batches, 4):
            h, cid, least = (b.column(i).to_numpy() for i in (4, 5, 6))
            h, level = h.view(np.uint64), b.column(7).to_numpy()
            x = unit(matrix(b.column(8).to_pylist(), kind))
            held, asked = np.flatnonzero(level < 0), np.flatnonzero(level >= 0)
            if not len(held) or not len(asked):
                continue
            held = held[np.argsort(h[held], kind="stable")]
            own, rows, names = h[held], x[held], least[held]
            out: list[list] = [[], [], [], []]
            for q in asked.tolist():
                (lo,), (hi,) = span(own, h[q : q + 1], int(level[q]))
                if lo < hi:
                    at, s = best_of(rows[lo:hi], x[q], names[lo:hi], k)
                    for c, v in zip(out, (np.full(len(at), cid[q]), cid[held[lo + at]], names[lo + at], s), strict=True):
                        c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["q", "v", "least", "score"])

    return run


def _parts(hashed: DataFrame, large: DataFrame, low: int, asks: str) -> DataFrame:
    """Every hashed row as a string of its part of the tree (column asks: false or -1 there),
    and once more for each split of the part if it asks."""
    names = hashed.columns
    prefix = F.shiftrightunsigned("h", BITS - low) if low else F.lit(0).cast("long")
    joined = hashed.withColumn("prefix", prefix).join(large, ["d", "tree", "prefix"], "left").withColumn("splits", F.coalesce("splits", F.lit(1)))
    boolean = dict(hashed.dtypes)[asks] == "boolean"
    none = F.lit(False) if boolean else F.lit(-1)
    rest = [c for c in names if c not in ("d", "tree", asks)]
    own = joined.select("d", "tree", "prefix", F.pmod(F.xxhash64("cid"), "splits").cast("int").alias("split"), *rest, none.alias(asks))
    queries = joined.where(F.col(asks) if boolean else F.col(asks) >= 0).select("d", "tree", "prefix", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"), *rest, asks)
    order = ["d", "tree", "prefix", "split"]
    columns = [*order, *[c for c in rest if c != "vector"], asks, *[c for c in rest if c == "vector"]]
    both = own.select(*columns).union(queries.select(*columns))
    return both.repartition(parallelism(hashed.sparkSession), *order).sortWithinPartitions(*order)


def _everything(rest: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """Queries that too few strings share a part with, and all vectors, in blocks."""
    blocks = max(1, math.ceil(n / BLOCK))
    d = F.octet_length("vector").cast("int").alias("d")
    head = [d, F.lit(-1).alias("tree"), F.lit(0).cast("long").alias("prefix")]
    own = classes.select(*head, F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int").alias("split"), F.lit(0).cast("long").alias("h"), "cid", "least", F.lit(-1).alias("level"), "vector")
    queries = rest.select(*head, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("split"), F.lit(0).cast("long").alias("h"), "cid", "least", F.lit(0).alias("level"), "vector")
    order = ["d", "tree", "prefix", "split"]
    return own.union(queries).repartition(parallelism(classes.sparkSession), *order).sortWithinPartitions(*order)


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = EVERY, factor: float = FACTOR, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score, scored): the k nearest found of each row whose vec_id is
    divisible by `every`, by cosine in double precision, ties to the smaller vec_id. scored
    is how many strings of all trees the query's candidates are, its own included. With
    factor and share large enough all trees ascend to their roots, and nothing is missed.

    Every row but those of the query's own id is a candidate. Equal vectors are indexed
    once, with their ids. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, nor do rows with a null vec_id; vectors of another dimension
    than the query's aren't compared. Rows that repeat a vec_id are one if their vectors are
    equal, else each is a candidate (and a query whose results merge). A query that finds
    fewer candidates than the ascent needs within its parts of the trees is compared with
    all vectors, in blocks. A query without candidates has no row; an empty table gives
    none. Other columns are ignored.
    """
    kind = element(vectors)
    rows = as_bytes(vectors).where("vec_id is not null and vector is not null")
    rows = stored(rows.mapInArrow(_classes, "vec_id long, key binary, vector binary"), "vectors")
    asks = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    classes = rows.groupBy("key").agg(F.min("vector").alias("vector"), F.min("vec_id").alias("least"), F.max(asks).alias("asks"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    low = max(0, math.ceil(math.log2(max(1, n) / BLOCK)))
    spread = classes.repartition(parallelism(vectors.sparkSession))

    narrow = spread.select("cid", "vector", "asks").mapInArrow(_hash(kind, ("asks",)), f"{HASHED}, asks boolean")
    prefix = (F.shiftrightunsigned("h", BITS - low) if low else F.lit(0).cast("long")).alias("prefix")
    sizes = narrow.groupBy("d", "tree", prefix).count()
    large = stored(sizes.where(F.col("count") > BLOCK).select("d", "tree", "prefix", F.ceil(F.col("count") / BLOCK).cast("int").alias("splits")), "large")
    # each tree counts the query's own string too
    steps, need = levels(low), needed(n, k, factor, share) + TREES
    counts = _parts(narrow, large, low, "asks").mapInArrow(_count(steps), "cid long, counts array<long>")
    sums = counts.groupBy("cid").agg(*(F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(len(steps))))
    # the longest prefix at which all trees together have enough
    deepest = list(range(len(steps)))[::-1]
    level = F.coalesce(*(F.when(F.col(f"c{i}") >= need, F.lit(steps[i])) for i in deepest), F.lit(None if low else 0).cast("int"))
    scored = F.coalesce(*(F.when(F.col(f"c{i}") >= need, F.col(f"c{i}")) for i in deepest), F.lit(None) if low else F.col("c0"))
    depths = stored(sums.select(F.col("cid").alias("asker"), level.alias("level"), scored.alias("scored")), "depths")

    told = classes.join(depths, F.col("cid") == F.col("asker"), "left")
    full = told.select("cid", "vector", "least", F.coalesce("level", F.lit(-1)).alias("level"), F.col("vector").alias("v")).repartition(parallelism(vectors.sparkSession))
    wide = full.mapInArrow(_hash(kind, ("least", "level", "vector")), f"{HASHED}, least long, level int, vector binary")
    found = _parts(wide, large, low, "level").mapInArrow(_score(kind, k + 1), FOUND)
    if low:
        rest = told.where("asks and level is null")
        if not rest.isEmpty():
            found = found.union(_everything(rest, classes, n).mapInArrow(_score(kind, k + 1), FOUND))
    once = found.groupBy("q", "v").agg(F.max("score").alias("score"), F.min("least").alias("least"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "least")
    top = once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).select("q", "v", "score")
    # of each class the k + 1 smallest ids are enough for any query
    ids = rows.select("key", "vec_id").distinct()
    few = ids.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    few = few.join(classes.select("key", "cid"), "key").select("cid", "vec_id")
    each = top.join(few, F.col("v") == F.col("cid")).select("q", "vec_id", "score")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    each = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    lists = each.groupBy("q").agg(F.collect_list(F.struct("vec_id", "score")).alias("near"))
    weight = ids.where(F.col("vec_id") % every == 0).groupBy("key").count()
    best = lists.join(told.select("cid", "key", F.coalesce("scored", F.lit(n)).alias("scored")), F.col("q") == F.col("cid")).join(weight, "key")
    best = stored(best.select("key", "near", "scored", F.col("count").alias("weight")), "near")
    answers = hot_join(ids.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id"), best, "key", "weight")
    pairs = answers.select("query_id", "scored", F.inline("near")).where("vec_id <> query_id")
    merged = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.max("scored").alias("scored"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "scored")
