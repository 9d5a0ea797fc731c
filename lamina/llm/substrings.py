"""Substring dedup by Rabin-Karp hashes of every fixed-length word window.

Texts are packed into rows of bounded size. For each pack, two independent polynomial
rolling hashes of every window are computed, 64 and 24 bits of them kept; the distinct
ones, sorted, are cut by hash range and sent to the ranges' tasks, which count them over
all packs. A bitmap comes back for each pack and range and tells which values came more
than once. Repeated windows then merge into maximal intervals, whose words go.

Because a pack sends each value once, with a mark if the pack itself repeats it, a
passage in a third of all documents loads its range by one value for each pack. Sorted
hashes are sent as differences, compressed, and bitmaps instead of positions come back: a
row for each window and a plain aggregation would write over four times the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import payloads, prepare, sha256, stored

WINDOW = 35
#: Bytes of text in a pack; a longer text is a pack of its own.
PACK_BYTES = 12 << 20
#: Windows that a counting task gets, on average.
RANGE_WINDOWS = 3_000_000
#: Odd bases of the polynomials, modulo 2**64, and bits of the second one's hash.
BASES, CHECK_BITS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), 24


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def rolling(values: np.ndarray, window: int, base: int = BASES[0]) -> np.ndarray:
    """Hash of every `window` consecutive values: sum of value[i+j] * base**j, mixed."""
    n = len(values) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    h = (total[window:] - total[:-window]) * powers(pow(base, -1, 1 << 64), n)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def window_hashes(texts: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of all windows inside texts, and where they start in the texts' words end to end."""
    sizes = np.array([len(t) for t in texts], np.int64)
    words = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode()
    distinct = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words.dictionary.to_pylist())), np.uint64).reshape(-1, 2)
    number = words.indices.to_numpy()
    h = rolling(distinct[number, 0], window)
    left = np.repeat(np.cumsum(sizes), sizes)[: len(h)] - np.arange(len(h))
    starts = np.flatnonzero(left >= window)
    g = rolling(distinct[number, 1], window, BASES[1])
    return h[starts], (g[starts] >> np.uint64(64 - CHECK_BITS)).astype(np.uint32), starts


def ordered(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order in which equal pairs of hashes follow each other by h, where a new pair begins)."""
    order = np.argsort(h, kind="stable")
    a, b = h[order], g[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():
        order = np.lexsort((g, h))
        a, b = h[order], g[order]
    return order, np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(h)]


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def spread(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def to_blob(h: np.ndarray, g: np.ndarray) -> bytes:
    """Differences of sorted hashes, byte by byte plane, and their checks, compressed."""
    steps = np.diff(h, prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()
    return squeeze(planes + np.ascontiguousarray(g.view(np.uint8).reshape(-1, 4)[:, : CHECK_BITS // 8].T).tobytes())


def from_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(spread(blob), np.uint8).reshape(8 + CHECK_BITS // 8, -1)
    h = np.cumsum(np.ascontiguousarray(planes[:8].T).view(np.uint64).ravel(), dtype=np.uint64)
    g = np.zeros((len(h), 4), np.uint8)
    g[:, : CHECK_BITS // 8] = planes[8:].T
    return h, g.view(np.uint32).ravel()


def cuts(h: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """(the hash ranges that sorted hashes fall into, where each begins, and the end)."""
    own = (h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(h)])
    return own[first].astype(np.int64), np.append(first, len(h))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ids, texts, n_words): doc ids and a compressed concatenation with lengths."""
    ids: list = []
    texts: list[bytes] = []
    size = words = 0

    def out() -> pa.RecordBatch:
        lengths = np.array([len(t) for t in texts], np.int64).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.binary()), pa.array([squeeze(b"".join(texts))], pa.binary()), pa.array([words], pa.int64())], names=["ids", "lengths", "texts", "n_words"])

    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), payloads(b.column(1)), strict=True):
            if ids and size + len(text) > PACK_BYTES:
                yield out()
                ids, texts, size, words = [], [], 0, 0
            ids.append(doc)
            texts.append(text)
            size += len(text)
            words += text.count(b" ") + 1
    if ids:
        yield out()


def unpack(lengths: bytes, texts: bytes) -> list[list[bytes]]:
    data, ends = spread(texts), np.cumsum(np.frombuffer(lengths, np.int64)).tolist()
    return [data[a:b].split() for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _send(window: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, lengths, texts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h, g, _ = window_hashes(unpack(lengths, texts), window)
                order, new = ordered(h, g)
                first = np.flatnonzero(new)
                many = np.diff(np.append(first, len(h))) > 1
                h, g = h[order[first]], g[order[first]]
                held, at = cuts(h, ranges)
                spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                for i in range(0, len(held), 4096):
                    part = spans[i : i + 4096]
                    blobs = [to_blob(h[lo:hi], g[lo:hi]) for lo, hi in part]
                    marks = [squeeze(np.packbits(many[lo:hi]).tobytes()) for lo, hi in part]
                    yield pa.RecordBatch.from_arrays([pa.array(held[i : i + 4096]), pa.array([pack] * len(part), pa.int64()), pa.array(blobs, pa.binary()), pa.array(marks, pa.binary())], names=["range", "pack", "hashes", "marks"])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All packs' values of one range -> for each pack a bitmap of its repeated values."""

    def out(rows: list, of: int) -> pa.RecordBatch:
        parts = [from_blob(r[1]) for r in rows]
        ends = np.cumsum([len(h) for h, _ in parts])
        own = np.concatenate([np.unpackbits(np.frombuffer(spread(r[2]), np.uint8), count=len(h)) for r, (h, _) in zip(rows, parts, strict=True)]).astype(bool)
        h, g = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order, new = ordered(h, g)
        # a value comes again if it isn't new or the next one isn't
        again = ~new
        again[:-1] |= ~new[1:]
        back = np.empty_like(again)
        back[order] = again
        back |= own
        bitmaps = [squeeze(np.packbits(x).tobytes()) if x.any() else b"" for x in np.split(back, ends[:-1])]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([of] * len(rows), pa.int64()), pa.array(bitmaps, pa.binary())], names=["pack", "range", "bitmap"])

    now, rows = None, []
    for b in batches:
        for r, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r != now and rows:
                yield out(rows, now)
                rows = []
            now = r
            rows.append(rest)
    if rows:
        yield out(rows, now)


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Of n words, those in the union of the intervals that begin at starts."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + window, n), -1)
    return np.cumsum(change[:-1]) > 0


def _mark(window: int, ranges: int, texts_out: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, lengths, texts, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = unpack(lengths, texts)
                n = sum(map(len, words))
                gone = np.zeros(n, bool)
                if found:
                    h, g, starts = window_hashes(words, window)
                    order, new = ordered(h, g)
                    held, at = cuts(h[order[new]], ranges)
                    spans = dict(zip(held.tolist(), zip(at[:-1].tolist(), at[1:].tolist(), strict=True), strict=True))
                    repeated = np.zeros(at[-1], bool)
                    for f in found:
                        lo, hi = spans[f["range"]]
                        repeated[lo:hi] = np.unpackbits(np.frombuffer(spread(f["bitmap"]), np.uint8), count=hi - lo)
                    gone = covered(n, starts[order[repeated[np.cumsum(new) - 1]]], window)
                rows, begin = [], 0
                for own in words:
                    flags = gone[begin : begin + len(own)]
                    begin += len(own)
                    out = b" ".join([w for w, g in zip(own, flags.tolist(), strict=True) if not g] if flags.any() else own)
                    rows.append((len(own), int(flags.sum()), out.decode() if texts_out else sha256(out)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([r[i] for r in rows], t) for i, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.string())))], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts_out: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each row of docs (doc_id, text).

    A word goes if a window of `window` words that covers it has the same words as another
    window, in any row or elsewhere in its own; all is judged on the input. kept holds the
    other words, joined by one space, or with texts_out=False their SHA-256. Null, empty
    and shorter texts have no windows and lose nothing (null gives no words). Rows that are
    repeated repeat each other's windows. Windows are held equal if both hashes are, 88 bits:
    n windows give a false match with odds n*n/2**89, 1e-7 for 30 GB of text and 1e-4 for
    1 TB. An empty table gives no rows; other columns are ignored; null ids stay null.
    """
    prepare(docs.sparkSession)
    packed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pack, "ids array<long>, lengths binary, texts binary, n_words long")
    packs = stored(packed.withColumn("pack", F.monotonically_increasing_id()), "packs")
    total = packs.agg(F.sum("n_words")).first()[0] or 0
    ranges = max(1, math.ceil(total / RANGE_WINDOWS))
    sent = packs.select("pack", "lengths", "texts").mapInArrow(_send(window, ranges), "range long, pack long, hashes binary, marks binary")
    split = sent.repartition(ranges, "range").sortWithinPartitions("range", "pack")
    found = split.mapInArrow(_count, "pack long, range long, bitmap binary").where(F.length("bitmap") > 0)
    by_pack = found.groupBy("pack").agg(F.collect_list(F.struct("range", "bitmap")).alias("found")).withColumnRenamed("pack", "k")
    joined = packs.join(by_pack, F.col("pack") == F.col("k"), "left").select("ids", "lengths", "texts", "found")
    return joined.mapInArrow(_mark(window, ranges, texts_out), "doc_id long, n_words long, n_removed long, kept string")


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """remove_repeats with the digest of the kept words as kept_sha256."""
    return remove_repeats(docs, window, False).withColumnRenamed("kept", "kept_sha256")
