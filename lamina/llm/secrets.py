"""Secret scans with corpus-wide ownership frequency.

One pass over the texts finds candidates: the three base kinds, and further shapes of
credentials. Candidate values travel as hashes. Counted by distinct repositories and
owners over the whole corpus, a value held by many owners or in many repositories is a widely copied example;
one of few owners, with the look of a random string, is a live-looking credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, prepare, sha256, stored

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_RUN = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "github", "slack", "stripe", "google", "jwt", "pem", "opaque")
#: Shapes that the method adds; they count as spans unless the value is widely copied.
ADDED = (
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    ("slack", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    ("stripe", re.compile(r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}")),
    ("google", re.compile(r"AIza[A-Za-z0-9_-]{35}")),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}")),
    ("opaque", re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}(?![A-Za-z0-9+/_-])")),
)
#: Bits a character that a value needs to look random.
MIN_ENTROPY = 3.0
#: A value with more owners, or in more repositories, than this is a widely copied example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 20

CANDIDATE = "struct<start:int,end:int,kind:int,base:boolean,value:binary,random:boolean>"


def entropy(value: str) -> float:
    """Shannon entropy in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_random(value: str, least: float = MIN_ENTROPY) -> bool:
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= least


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, value) of the base kinds, leftmost and non-overlapping for each kind."""
    out = [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    # a run of 16 or more is found from its first character, so this equals dropping short runs
    out += [(m.start(), m.end(), 2, m[0]) for m in HEX_RUN.finditer(text)]
    return sorted(out)


def added_spans(text: str) -> list[tuple[int, int, int, str]]:
    """Further candidates, leftmost and non-overlapping for each kind."""
    out = []
    for n, (name, pattern) in enumerate(ADDED, 3):
        for m in pattern.finditer(text):
            if name != "opaque" or looks_random(m[0]) and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0]):
                out.append((m.start(), m.end(), n, m[0]))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("base", pa.bool_()), ("value", pa.binary()), ("random", pa.bool_())])
    for b in batches:
        found = []
        for text in b.column(1).to_pylist():
            text = text or ""
            rows = []
            for is_base, spans in ((True, base_spans(text)), (False, added_spans(text))):
                for s, e, k, v in spans:
                    rows.append({"start": s, "end": e, "kind": k, "base": is_base, "value": hashlib.blake2b(v.encode(), digest_size=16).digest(), "random": looks_random(v)})
            found.append(rows)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(found, pa.list_(kind))], names=["doc_id", "owner", "repository", "found"])


def copied(row: dict) -> bool:
    """Is a candidate's value a widely copied example?"""
    return row["owners"] > MAX_OWNERS or row["repositories"] > MAX_REPOSITORIES


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[] for _ in range(8)]
        for rows in b.column(1).to_pylist():
            rows = rows or []
            base = [(r["start"], r["end"], r["kind"]) for r in rows if r["base"]]
            extra = [(r["start"], r["end"], r["kind"]) for r in rows if not r["base"] and not copied(r)]
            for k in range(3):
                out[k].append(sum(x[2] == k for x in base))
            out[3].append(sha256(joined(base).encode()))
            out[4].append(joined(base + extra))
            out[5].append(sum(not copied(r) and r["random"] for r in rows))
            out[6].append(sum(map(copied, rows)))
            out[7].append(max((r["repositories"] for r in rows), default=0))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 3
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=["doc_id", *REPORT])


REPORT = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied", "max_repositories")


def ownership(candidates: DataFrame) -> DataFrame:
    """(value, owners, repositories, n) from candidates (value, owner, repository): distinct
    holders of each value, and its rows. Both counts pre-aggregate before they shuffle, so a value in a
    third of all rows reaches one task as one row for each holder and map task at most."""
    per = candidates.groupBy("value", "owner").agg(F.count_distinct("repository").alias("r"), F.count("*").alias("n"))
    return per.groupBy("value").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"), F.sum("n").alias("n"))


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Secrets of each row of docs: base counts and digest, all spans, and how many values
    look live (few owners and repositories, random look) or copied (more of either).

    `owner` names the owner's column and `repository` the repository's. A null text is
    empty; an empty one gives zeros, the digest of nothing and no spans. A null owner is
    one owner of its own, a null repository isn't counted. Repeated rows are each given.
    Texts are scanned whole. An empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    named = F.coalesce(F.concat(F.lit("="), F.col(owner).cast("string")), F.lit("null"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"), named.alias("owner"), F.col(repository).cast("string").alias("repository"))
    found = rows.mapInArrow(_scan, f"doc_id long, owner string, repository string, found array<{CANDIDATE}>")
    held = stored(found.withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = held.where(F.size("found") > 0).select("row", "owner", "repository", F.inline("found"))
    counts = stored(ownership(each.select("value", "owner", "repository")), "owners")
    seen = hot_join(each, counts, "value", "n").groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind", "base", "random", "owners", "repositories")).alias("seen"))
    full = held.select("row", "doc_id").join(seen.withColumnRenamed("row", "k"), F.col("row") == F.col("k"), "left").select("doc_id", "seen")
    return full.mapInArrow(_report, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_live long, n_copied long, max_repositories long")
