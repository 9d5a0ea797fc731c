"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is a row of symbols. An agenda holds the adjacent pairs that the vocabulary can
merge, best score first, leftmost first among equals; merging a pair puts its two new
neighbours on the agenda. No piece has a space mark after another character, so a text
falls into chunks (space marks, then other characters) that merge independently; chunks
that come again are looked up, and those that are new in an Arrow batch run their agendas together.
In every batch, a share of the new chunks and a whole text are checked against the
sentencepiece library.
"""

from __future__ import annotations

import hashlib
import re
import sys
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import payloads, prepare, sha256

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words in a generation of those that a worker process remembers, from task to task.
CACHE = 400_000
#: Longer chunks aren't remembered.
LONG = 64
#: Number of every character that no piece holds.
STRANGE = 0x1FFFF
NEVER = 1 << 62
NO_RANK = 1 << 30
#: Chunks of up to so many characters run in step.
IN_STEP = 40
#: Of the chunks that are new, those whose hash is divisible by this are checked against the
#: library, and the first text of every Arrow batch is as a whole.
CHECK_EVERY = 16


class Vocabulary:
    """A model's pieces, read with the library, and the agenda over them.

    Only models without a normalisation table are taken (the text is its own
    normalisation), with byte fallback, and with a space mark before the text.
    """

    def __init__(self, model: bytes):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.unknown = sp.unk_id()
        plain = [i for i in range(len(self.pieces)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        self.values = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(len(self.pieces)) if sp.is_control(i)}
        self.size = len(self.pieces)
        self.numbers = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p} - self.ids.keys()):
            self.numbers[c] = len(self.numbers) + self.size
        #: Of two symbols that make a piece: rank of its score, then the piece, as one
        #: number with room for the place between.
        rank = {score: r for r, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.merges = {}
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                if p[:cut] in self.numbers and p[cut:] in self.numbers:
                    self.merges[self.numbers[p[:cut]] << 17 | self.numbers[p[cut:]]] = rank[self.scores[p]] << 45 | i
        keys = np.array(sorted(self.merges), np.int64)
        values = np.array([self.merges[k] for k in keys.tolist()], np.int64)
        #: The same merges by sorted key; the last entry stands for no merge.
        self.keys = np.append(keys, NEVER)
        self.ranks = np.append((values >> 45).astype(np.int32), np.int32(NO_RANK))
        self.made = np.append((values & 0x1FFFF).astype(np.int32), np.int32(STRANGE))
        self.of_char = np.full(0x110000, STRANGE, np.int32)
        for c, i in self.numbers.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        self.decimal = [str(i) for i in range(self.size)]
        self.raw = [self.decode_bytes([i]) for i in range(self.size)]
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a space mark after another character: chunks aren't independent")
        if len(self.bytes) != 256 or 2 * self.size >= STRANGE:
            raise ValueError("a vocabulary with byte fallback and fewer than 65,535 pieces is needed")

    def merge(self, chunk: str) -> list[int]:
        """The symbols left when no adjacent pair is a piece, as numbers; STRANGE stands
        for a character that no piece holds."""
        number, merges = self.numbers.get, self.merges.get
        symbols = [number(c, STRANGE) for c in chunk]
        n = len(symbols)
        agenda = []
        for i in range(n - 1):
            if (v := merges(symbols[i] << 17 | symbols[i + 1])) is not None:
                agenda.append(v + (i << 17))
        if not agenda:
            return symbols
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            i = entry >> 17 & 0xFFFFFFF
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            v = merges(symbols[i] << 17 | symbols[j])
            if v is None or v + (i << 17) != entry:
                continue  # one of the two has merged since; their new pair has its own entry
            new = symbols[i] = entry & 0x1FFFF
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (v := merges(new << 17 | symbols[k])) is not None:
                    heappush(agenda, v + (i << 17))
            h = before[i]
            if h >= 0 and (v := merges(symbols[h] << 17 | new)) is not None:
                heappush(agenda, v + (h << 17))
        return symbols

    def encode_chunk(self, chunk: str) -> list[int]:
        out: list[int] = []
        for at, s in enumerate(self.merge(chunk)):
            if 0 <= s < self.size:
                out.append(s)
            elif s >= 0:
                # a single character that isn't a piece: its bytes
                out += [self.bytes[b] for b in chunk[at].encode()]
        return out

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs in the merges."""
        key = left.astype(np.int64) << 17 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1).astype(np.int32)

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """encode_chunk of many chunks: short ones run their agendas in step, each merging
        its best pair, leftmost among equals, in every round."""
        out: list[list[int] | None] = [None] * len(chunks)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] <= IN_STEP]
        for at in range(0, len(order), 8192):
            self._in_step(chunks, order[at : at + 8192], sizes, out)
        return [self.encode_chunk(c) if o is None else o for c, o in zip(chunks, out, strict=True)]

    def _in_step(self, chunks: list[str], rows: np.ndarray, sizes: np.ndarray, out: list) -> None:
        size = sizes[rows]
        width = max(2, int(size[-1]))
        points = self.of_char[np.frombuffer("".join([chunks[i] for i in rows.tolist()]).encode("utf-32-le"), np.uint32)]
        symbols = np.full((len(rows), width + 1), STRANGE, np.int32)
        column = np.arange(width + 1)
        symbols[column[None, :] < size[:, None]] = points
        merge = self.find(symbols[:, :-1], symbols[:, 1:])
        rank = self.ranks[merge]
        while len(rows):
            each = np.arange(len(rows))
            at = rank.argmin(axis=1)
            live = rank[each, at] < NO_RANK
            if not live.all():
                done = ~live
                for i, k, ids in zip(rows[done].tolist(), size[done].tolist(), symbols[done].tolist(), strict=True):
                    ids = ids[:k]
                    if max(ids) == STRANGE:
                        strange = (c for c in chunks[i] if c not in self.numbers)
                        ids = [b for s in ids for b in ([self.bytes[x] for x in next(strange).encode()] if s == STRANGE else (s,))]
                    if max(ids) < self.size:
                        out[i] = ids
                rows, size, symbols, merge, rank, at = (x[live] for x in (rows, size, symbols, merge, rank, at))
                each = np.arange(len(rows))
                if not len(rows):
                    break
            new = self.made[merge[each, at]]
            later = column[None, 1:-1] > at[:, None]
            symbols[:, 1:-1] = np.where(later, symbols[:, 2:], symbols[:, 1:-1])
            symbols[:, -1] = STRANGE
            symbols[each, at] = new
            rank[:, 1:-1] = np.where(later[:, :-1], rank[:, 2:], rank[:, 1:-1])
            merge[:, 1:-1] = np.where(later[:, :-1], merge[:, 2:], merge[:, 1:-1])
            rank[:, -1], merge[:, -1] = NO_RANK, len(self.keys) - 1
            size = size - 1
            for where in (each, each[at > 0]):
                i = at[where] if len(where) == len(each) and where is each else at[where] - 1
                found = self.find(symbols[where, i], symbols[where, i + 1])
                merge[where, i], rank[where, i] = found, self.ranks[found]

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without begin or end."""
        return [i for c in chunks(text) for i in self.encode_chunk(c)]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """Raw bytes of the pieces: space marks as spaces, byte pieces as bytes."""
        out = []
        for i in ids:
            if i in self.values:
                out.append(bytes([self.values[i]]))
            elif i == self.unknown:
                out.append(" ⁇ ".encode())
            elif i not in self.silent:
                out.append(self.pieces[i].replace(MARK, " ").encode())
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding put first goes."""
        return as_text(self.decode_bytes(ids))


def as_text(raw: bytes) -> str:
    raw = raw[1:] if raw[:1] == b" " else raw
    return raw.decode("utf-8", "replace")


def chunks(text: str) -> list[str]:
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def words(text: str) -> list[str]:
    """The chunks of a text, without the mark in front of each."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [c[1:] for c in chunks(text)]


class Encoder:
    """Remembers words: the decimal text of their ids. A word stands for its chunk: the
    chunk without the space mark in front. Two generations are held; a word that is used
    passes from the old one to the new one, and the old one goes when the new one is full."""

    def __init__(self, model: bytes, check: bool = True):
        self.vocabulary, self.check = Vocabulary(model), check
        self.known: dict[str, str] = {}
        self.old: dict[str, str] = {}
        #: Words that decode to something else than themselves, and to what.
        self.odd: dict[str, bytes] = {}

    def verify(self, words: list[str], ids: list[list[int]]) -> None:
        """Library and agenda must agree on words. The library puts a mark before each."""
        plain = [w.replace(MARK, " ") for w in words]
        for w, mine, its in zip(words, ids, self.vocabulary.library.encode(plain, num_threads=1), strict=True):
            if w and mine != its:
                raise AssertionError(f"agenda and library differ on {w!r}: {mine} and {its}")

    def learn(self, words: list[str]) -> None:
        vocabulary, known = self.vocabulary, self.known
        chunks = [MARK + w for w in words]
        ids = vocabulary.encode_chunks(chunks)
        if self.check:
            own = [i for i, w in enumerate(words) if zlib.crc32(w.encode()) % CHECK_EVERY == 0]
            self.verify([words[i] for i in own], [ids[i] for i in own])
        decimal, raw = vocabulary.decimal, vocabulary.raw
        for w, row in zip(words, ids, strict=True):
            known[w] = ",".join([decimal[i] for i in row])
            decoded = b"".join([raw[i] for i in row])
            if decoded != (" " + w.replace(MARK, " ")).encode():
                self.odd[w] = decoded

    def batch(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """(number of ids, their decimal text, raw decoded bytes) of each text."""
        if len(self.known) > CACHE:
            self.old, self.known = self.known, {}
            self.odd = {w: b for w, b in self.odd.items() if w in self.old}
        parts = [words(t) for t in texts]
        known, old, odd = self.known, self.old, self.odd
        new = set().union(*parts).difference(known)
        held = new.intersection(old)
        known.update({w: old[w] for w in held})
        new = list(new.difference(held))
        self.learn(new)
        for n, (text, p) in enumerate(zip(texts, parts, strict=True)):
            ids = ",".join([known[w] for w in p])
            if self.check and not n and ids != ",".join(map(str, self.vocabulary.library.encode(text, num_threads=1))):
                raise AssertionError(f"agenda and library differ on the text {text[:200]!r}")
            if odd and not odd.keys().isdisjoint(p):
                raw = b"".join([odd.get(w) or (" " + w.replace(MARK, " ")).encode() for w in p])
            else:
                raw = (" " + text.replace(MARK, " ")).encode() if text else b""
            yield ids.count(",") + 1 if ids else 0, ids.encode(), raw
        for w in new:
            if len(w) > LONG:
                del known[w]
                odd.pop(w, None)


def encoder_of(model: bytes, check: bool) -> Encoder:
    """The process's encoder for a model: worker processes outlive tasks."""
    held = sys.__dict__.setdefault("_lamina_encoders", {})
    key = (hashlib.sha256(model).digest(), check)
    if key not in held:
        held[key] = Encoder(model, check)
    return held[key]


def _digests(model: bytes, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model, check)
        for b in batches:
            texts = [t.decode() for t in payloads(b.column(1))]
            rows = [(n, sha256(ids), sha256(as_text(raw).encode())) for n, ids, raw in encoder.batch(texts)]
            columns = [pa.array([r[i] for r in rows], t) for i, t in ((0, pa.int64()), (1, pa.string()), (2, pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(model: bytes, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model, check)
        for b in batches:
            rows = [([int(i) for i in ids.split(b",") if i], as_text(raw)) for _, ids, raw in encoder.batch([t.decode() for t in payloads(b.column(1))])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str, check: bool = True) -> DataFrame:
    """(doc_id, ids, decoded) of each row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_ids(read_model(model_path), check), "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model_path: str, check: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of docs (doc_id, text).

    The file at model_path (0.5 MB) is read by the driver and travels with the tasks. Null
    and empty texts have no ids and decode to nothing. Whole texts are encoded, whatever
    their length; a chunk of any length merges in n log n steps. Repeated rows are each
    given, null ids stay null, an empty table gives no rows, other columns are ignored.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_digests(read_model(model_path), check), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
