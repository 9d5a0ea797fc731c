"""SimHash near-duplicates, with pivot distance tables.

A fingerprint has 64 bits; two texts are linked if theirs differ in at most `RADIUS`.
Pairs are proposed by equality of a pair of blocks: with five blocks and at most three
differing bits, two blocks are equal, so no link is lost. Every fingerprint carries a
pivot table, its Hamming distances to reference fingerprints. By the triangle
inequality, linked fingerprints differ by at most `RADIUS` in every coordinate, so a
proposed pair is discarded by its largest coordinate difference; what survives is
verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hot_join, payloads, prepare, quoted, stored
from .components import connected_components

RADIUS = 3
WIDTH = 3
SEED = 42
#: (first bit, bits) of the blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Reference fingerprints. Eight coordinates fit one long.
N_PIVOTS = 16
CHUNK = 1 << 16


def pivots(n: int = N_PIVOTS, seed: int = 7) -> list[int]:
    """Reference fingerprints: the empty one, its opposite's halves and quarters (whose
    distances tell the popcount of a part), then random ones."""
    fixed = [0, 0xFFFFFFFF, 0xFFFF0000FFFF, 0x00FF00FF00FF00FF, 0x0F0F0F0F0F0F0F0F, 0x3333333333333333, 0x5555555555555555]
    drawn = np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)
    return (fixed + [int(x) for x in drawn])[:n]


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """SimHash of a text over shingles of `width` words, A-Z lower-cased, repeats counted.

    A text of fewer words is one shingle; a text without words has fingerprint zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : min(at + CHUNK, n) + width - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(seed)), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(t) for t in payloads(b.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row of docs, in its order and number."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def with_pivots(fps: DataFrame) -> DataFrame:
    """Adds the pivot table, eight distances in each of the longs t0, t1, ..."""
    refs = pivots()

    def packed(at: int) -> Column:
        out = F.lit(0).cast("long")
        for i, p in enumerate(refs[at : at + 8]):
            signed = p - (1 << 64) if p >> 63 else p
            out = out.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed))).cast("long"), 8 * i))
        return out

    return fps.select("fp", *(packed(i).alias(f"t{i // 8}") for i in range(0, len(refs), 8)))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v), u < v: all pairs of the distinct fingerprints in fps that differ in 1 to
    `radius` bits. A pair may be given more than once."""
    if radius > 3:
        raise ValueError("five blocks prove links of up to three differing bits")

    def block(i: int) -> Column:
        at, bits = BLOCKS[i]
        return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << bits) - 1))

    keys = []
    for n, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2)):
        keys.append(F.lit(n << 40).cast("long").bitwiseOR(F.shiftleft(block(i), 16)).bitwiseOR(block(j)))
    held = with_pivots(fps).withColumn("key", F.explode(F.array(*keys)))
    a, b = held.alias("a"), held.alias("b")
    near = F.col("a.fp") < F.col("b.fp")
    for n in range(N_PIVOTS):
        one, other = (F.shiftright(F.col(f"{s}.t{n // 8}"), 8 * (n % 8)).bitwiseAND(F.lit(255)) for s in "ab")
        near = near & (F.abs(one - other) <= radius)
    exact = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius
    return a.join(b, (F.col("a.key") == F.col("b.key")) & near & exact).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def classes(held: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, label, component_id, n) for each distinct fingerprint of held (doc_id, fp), which
    n rows have."""
    each = stored(held.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fps")
    label = connected_components(links(each.select("fp"), radius))
    joined = each.join(label, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("label", "fp").alias("label"))
    joined = stored(joined, "labels")
    ids = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    return stored(joined.select("fp", "label", "n").join(ids, "label").select("fp", "label", "component_id", "n"), "classes")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (columns doc_id, text).

    component_id is the smallest doc_id that links reach, the row's own included. Null
    and empty texts have no words: fingerprint zero, linked like any other. Rows that
    repeat a doc_id are each given; a null doc_id never is the smallest unless its whole
    component has none. Very long texts are hashed in chunks. An empty table gives no
    rows. Other columns of docs are ignored.
    """
    held = stored(fingerprints(docs), "simhash")
    return hot_join(held, classes(held, radius), "fp", "n").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns, without near-duplicates: of each component the row
    with the smallest doc_id stays (null ids last; of equal ones, any single row). Null and
    empty texts are near-duplicates of each other; an empty table gives no rows."""
    prepare(docs.sparkSession)
    whole = docs.select(F.struct(*(quoted(c) for c in docs.columns)).alias("row"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in payloads(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["row", "fp"])

    kind = T.StructType([whole.schema["row"], T.StructField("fp", T.LongType())])
    held = stored(whole.mapInArrow(run, kind).withColumn("at", F.monotonically_increasing_id()), "rows")
    narrow = held.select(F.col("row.doc_id").cast("long").alias("doc_id"), "fp", "at")
    labels = hot_join(narrow, classes(narrow, radius), "fp", "n")
    first = labels.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("at"))).alias("m")).select(F.col("m.at").alias("chosen"))
    return held.join(first, F.col("at") == F.col("chosen"), "left_semi").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: the fingerprint as 16 hex digits."""
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
