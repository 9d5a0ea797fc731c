"""Line dedup with sharded cuckoo filters over exact reference-count tables.

State of a `LineStore`: postings (key, doc_id), one row for each long line key that a
document holds; references (key, n_docs, max_doc_id), exact; and for each shard of keys
a chain of cuckoo filters over the keys that reached the document threshold. Inserting
documents raises counts, deleting them lowers counts, and a key enters or leaves its
filter when its count crosses the threshold, so every insertion can be undone.

The number of shards follows the data. To find what documents lose, postings meet their
shard's filters and references in one task, or in several if a shard has many: the filters
spare lookups in the exact table, which decides what they let through.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parallelism, payloads, pick, prepare, quoted, segments, sha256, stored

MIN_CHARS = 40
MIN_DOCS = 5
#: Keys in the filters of a shard, and postings that meet them in one task, about.
SHARD_KEYS, SHARD_ROWS = 20_000, 1_000_000
SPACE = b" \t\n\x0b\x0c\r"


class CuckooFilter:
    """Buckets of four 16-bit marks; each key has two buckets; supports deletion."""

    def __init__(self, power: int = 8, slots: np.ndarray | None = None, count: int = 0):
        self.power, self.count = power, count
        self.slots = np.zeros((1 << power, 4), np.uint16) if slots is None else slots

    def _places(self, h: int) -> tuple[int, int, int]:
        mark = (h >> 48) or 1
        first = h & ((1 << self.power) - 1)
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return place ^ ((mark * 0x5BD1E995) & ((1 << self.power) - 1))

    def insert(self, h: int) -> bool:
        """False, and nothing changes, if no room can be made."""
        mark, a, b = self._places(h)
        slots, path = self.slots, []
        for place in (a, b):
            free = np.flatnonzero(slots[place] == 0)
            if len(free):
                slots[place, free[0]] = mark
                self.count += 1
                return True
        place = a
        for step in range(200):
            at = (mark + step) & 3
            path.append((place, at, int(slots[place, at])))
            mark, slots[place, at] = int(slots[place, at]), mark
            place = self._other(place, mark)
            free = np.flatnonzero(slots[place] == 0)
            if len(free):
                slots[place, free[0]] = mark
                self.count += 1
                return True
        for place, at, was in reversed(path):
            slots[place, at] = was
        return False

    def remove(self, h: int) -> bool:
        mark, a, b = self._places(h)
        for place in (a, b):
            held = np.flatnonzero(self.slots[place] == mark)
            if len(held):
                self.slots[place, held[0]] = 0
                self.count -= 1
                return True
        return False

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark = np.maximum(hashes >> np.uint64(48), 1)
        mask = np.uint64((1 << self.power) - 1)
        a = hashes & mask
        b = a ^ (mark * np.uint64(0x5BD1E995) & mask)
        mark = mark.astype(np.uint16)[:, None]
        return (self.slots[a.astype(np.int64)] == mark).any(axis=1) | (self.slots[b.astype(np.int64)] == mark).any(axis=1)


class Chain:
    """Cuckoo filters, each twice as large as the one before; a full one gets a successor."""

    def __init__(self, filters: list[CuckooFilter] | None = None):
        self.filters = filters or [CuckooFilter()]

    def insert(self, h: int) -> None:
        if not self.filters[-1].insert(h):
            self.filters.append(CuckooFilter(self.filters[-1].power + 1))
            self.insert(h)

    def remove(self, h: int) -> None:
        for f in reversed(self.filters):
            if f.remove(h):
                return
        raise KeyError("a key that isn't in the filter")

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        for f in self.filters:
            out |= f.contains(hashes)
        return out

    def dump(self) -> bytes:
        return b"".join(struct.pack("<BQ", f.power, f.count) + f.slots.tobytes() for f in self.filters)

    @staticmethod
    def load(blob: bytes) -> Chain:
        at, out = 0, []
        while at < len(blob):
            power, count = struct.unpack_from("<BQ", blob, at)
            size = (1 << power) * 8
            out.append(CuckooFilter(power, np.frombuffer(blob, np.uint16, size // 2, at + 9).reshape(-1, 4).copy(), count))
            at += 9 + size
        return Chain(out)


def line_key(line: bytes) -> bytes | None:
    """The key of a line, if it has MIN_CHARS code points: ends stripped, A-Z lowered."""
    key = line.strip(SPACE).lower()
    if len(key) < MIN_CHARS or len(key) < 4 * MIN_CHARS and len(key.decode()) < MIN_CHARS:
        return None
    return key


def hashed(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, keys = [], []
        for doc, text in zip(b.column(0).to_pylist(), payloads(b.column(1)), strict=True):
            own = {hashed(k) for k in map(line_key, text.split(b"\n")) if k is not None}
            ids += [doc] * len(own)
            keys += own
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"])


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, key): the keys of long lines, each once for a row of docs."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_postings, "doc_id long, key binary")


def references(rows: DataFrame) -> DataFrame:
    """(key, n_docs, max_doc_id); rows of one doc_id count once, null as one document."""
    seen = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    return rows.groupBy("key").agg(seen.alias("n_docs"), F.max("doc_id").alias("max_doc_id"))


def shard_of(shards: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("key", 9, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by shard: its old filters first, then keys to put in (change 1) or take out (-1)."""
    shard, chain = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([chain.dump()], pa.binary())], names=["shard", "filters"])

    for b in batches:
        for s, change, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if s != shard:
                if shard is not None:
                    yield out()
                shard, chain = s, Chain()
            if change == 0:
                chain = Chain.load(data)
            elif change > 0:
                chain.insert(int.from_bytes(data[:8], "little"))
            else:
                chain.remove(int.from_bytes(data[:8], "little"))
    if shard is not None:
        yield out()


def update_filters(old: DataFrame | None, changes: DataFrame, shards: int) -> DataFrame:
    """(shard, filters) after changes (key, change); old is such a table, None for none."""
    rows = changes.select(shard_of(shards).alias("shard"), F.col("change").cast("int").alias("change"), F.col("key").alias("data"))
    if old is not None:
        rows = rows.union(old.select("shard", F.lit(0).alias("change"), F.col("filters").alias("data")))
    first = F.abs("change")
    return rows.repartition("shard").sortWithinPartitions("shard", first, "change", "data").mapInArrow(_update, "shard int, filters binary")


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by part of a shard: its filters (kind 0), its references (1), its postings (2) ->
    (doc_id, key) of the postings whose lines go."""
    now, chain, last = None, None, {}
    for (shard, split, kind), b in segments(batches, 3):
        if (shard, split) != now:
            now, chain, last = (shard, split), None, {}
        if kind == 0:
            chain = Chain.load(b.column(3)[0].as_py())
        elif kind == 1:
            last.update(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True))
        elif chain is not None:
            keys = b.column(3)
            hashes = np.frombuffer(b"".join(keys.to_pylist()), np.uint64)[::2]
            b = b.filter(pa.array(chain.contains(hashes)))
            ids, keys = b.column(4).to_pylist(), b.column(3).to_pylist()
            # a key is there if it is exactly; its largest document, null if all are, keeps its lines
            gone = [i for i, (d, k) in enumerate(zip(ids, keys, strict=True)) if k in last and last[k] is not None and (d is None or d < last[k])]
            if gone:
                yield pa.RecordBatch.from_arrays([b.column(4), b.column(3)], names=["doc_id", "key"]).take(pa.array(gone))


class LineStore:
    """The state over some documents. `insert` and `delete` return the state after them."""

    def __init__(self, spark: SparkSession, rows: DataFrame | None = None, refs: DataFrame | None = None, filters: DataFrame | None = None, shards: int = 1, min_docs: int = MIN_DOCS):
        self.spark, self.rows, self.refs, self.filters, self.shards, self.min_docs = spark, rows, refs, filters, shards, min_docs

    def insert(self, docs: DataFrame) -> LineStore:
        """docs must not hold a doc_id that has lines in the state: that is an error."""
        new = stored(postings(docs), "postings")
        if self.rows is not None and not new.join(self.rows, new["doc_id"].eqNullSafe(self.rows["doc_id"]), "left_semi").isEmpty():
            raise ValueError("documents with these ids are in the state; delete them first")
        return self._changed(new, new if self.rows is None else self.rows.union(new))

    def delete(self, docs: DataFrame) -> LineStore:
        """Takes out all that documents with these doc_ids put in."""
        gone = pick(docs, "doc_id").distinct()
        match = self.rows["doc_id"].eqNullSafe(gone["doc_id"])
        touched = stored(self.rows.join(gone, match, "left_semi"), "gone")
        return self._changed(touched, stored(self.rows.join(gone, match, "left_anti"), "postings"))

    def _changed(self, touched: DataFrame, rows: DataFrame) -> LineStore:
        hot = lambda df: df.where(F.col("n_docs") >= self.min_docs).select("key")
        if self.refs is None:
            refs = stored(references(rows), "references")
        else:
            keys = touched.select("key").distinct()
            now = references(rows.join(keys, "key", "left_semi")).withColumn("new", F.lit(True))
            refs = stored(self.refs.join(keys, "key", "left_anti").withColumn("new", F.lit(False)).unionByName(now), "references")
        n_rows, n_hot = refs.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.count(F.when(F.col("n_docs") >= self.min_docs, 1))).first()
        least = max(n_hot / SHARD_KEYS, n_rows / SHARD_ROWS, 1)
        shards, old = self.shards, self.filters
        if old is None or not shards / 4 <= least <= 2 * shards:
            # the shards no longer fit the data: their filters are built anew
            shards, old = 1 << math.ceil(math.log2(least)), None
            changes = hot(refs).select("key", F.lit(1).alias("change"))
        else:
            before, after = hot(self.refs.join(keys, "key", "left_semi")), hot(refs.where("new"))
            changes = after.join(before, "key", "left_anti").select("key", F.lit(1).alias("change")).union(before.join(after, "key", "left_anti").select("key", F.lit(-1).alias("change")))
        filters = stored(update_filters(old, changes, shards), "filters")
        return LineStore(self.spark, rows, refs.drop("new"), filters, shards, self.min_docs)

    def drops(self) -> DataFrame:
        """(doc_id, keys): keys whose lines a document loses."""
        shard = shard_of(self.shards).alias("shard")
        hot = self.refs.where(F.col("n_docs") >= self.min_docs).select(shard, "key", F.col("max_doc_id").alias("doc_id"), "n_docs")
        # a shard whose keys have very many postings is split by documents
        loads = hot.groupBy("shard").agg(F.sum("n_docs").alias("n")).where(F.col("n") > SHARD_ROWS)
        loads = stored(loads.select(F.col("shard").alias("s"), F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("splits")), "loads")
        parts = lambda df: df.join(loads, F.col("shard") == F.col("s"), "left").withColumn("splits", F.coalesce("splits", F.lit(1)))
        each = F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split")
        none = F.lit(None).cast("long").alias("doc_id")
        filters = parts(self.filters).select("shard", each, F.lit(0).alias("kind"), F.col("filters").alias("key"), none)
        exact = parts(hot).select("shard", each, F.lit(1).alias("kind"), "key", "doc_id")
        own = F.pmod(F.xxhash64("doc_id"), "splits").cast("int").alias("split")
        rows = parts(self.rows.select(shard, "key", "doc_id")).select("shard", own, F.lit(2).alias("kind"), "key", "doc_id")
        order = ["shard", "split"]
        both = filters.union(exact).union(rows).repartition(parallelism(self.spark), *order).sortWithinPartitions(*order, "kind")
        return both.mapInArrow(_probe, "doc_id long, key binary").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def _kept(text: bytes, keys: list[bytes] | None) -> tuple[int, int, bytes]:
    lines = text.split(b"\n")
    if not keys:
        return len(lines), 0, text
    gone = set(keys)
    kept = [x for x in lines if (k := line_key(x)) is None or hashed(k) not in gone]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [_kept(t, k) for t, k in zip(payloads(b.column(1)), b.column(2).to_pylist(), strict=True)]
        text = pa.array([r[2].decode() for r in rows], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), text, *(pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1))], names=["row", "kept", "n_lines", "n_dropped"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [_kept(t, k) for t, k in zip(payloads(b.column(1)), b.column(2).to_pylist(), strict=True)]
        sums = pa.array([sha256(r[2]) for r in rows], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)), sums], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def _with_drops(docs: DataFrame, extra: list) -> DataFrame:
    drops = LineStore(docs.sparkSession).insert(docs).drops().select(F.col("doc_id").alias("d"), "keys")
    return docs.select(*extra).join(drops, F.col("doc_id").eqNullSafe(F.col("d")), "left")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows of docs with shared lines dropped from text; all columns stay.

    A line's key is the line with ASCII white space stripped and A-Z lowered. Keys of at
    least MIN_CHARS code points in at least MIN_DOCS documents stay only in the largest
    doc_id that holds them. Null texts stay null, empty ones are one empty line. Rows that
    repeat a doc_id are one document and are treated alike; null is one document, smaller
    than all. Texts that lose every line become empty. An empty table gives no rows.
    """
    whole = F.struct(*(quoted(c) for c in docs.columns)).alias("row")
    joined = _with_drops(docs, [whole, F.col("doc_id"), F.col("text")])
    kind = T.StructType([joined.schema["row"], T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    out = joined.select("row", "text", "keys").mapInArrow(_rewrite, kind)
    return out.select(*(F.when(F.col("row.text").isNotNull(), F.col("kept")).alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def line_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row of docs, by dedup_lines' rules;
    a null text counts as empty."""
    return _with_drops(docs, [F.col("doc_id").cast("long"), F.col("text")]).select("doc_id", "text", "keys").mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
