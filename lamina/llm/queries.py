"""The queries of the ten operators, thin over the operators' own interfaces."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import caps, forest, lines, mixing, pieces, secrets, simhash, substrings, toxicity, warc
from .common import table



def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file: in the folder that LAMINA_TOKENIZERS names, else in
    the package that ships them, else where they lie on this kind of machine."""
    folder = os.environ.get("LAMINA_TOKENIZERS")
    if folder is None and importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder or "/opt/tokenizers", name)


#: SentencePiece model.
PIECES = tokenizer("piece_bpe_32k.model")


WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

SQL: dict[str, str] = {}

SQL["op4_source_mix"] = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, {WORDS} AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12))::BIGINT AS hash
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source),
total AS (SELECT sum(source_size) AS n, sum(weight) AS w FROM s),
rounds(round, share) AS (
  SELECT 0, (SELECT n / w FROM total)::DOUBLE
  UNION ALL
  SELECT round + 1, (SELECT ((SELECT n FROM total) - 3 * coalesce(sum(source_size) FILTER (weight * r.share > 3 * source_size), 0))::DOUBLE
                       / ((SELECT w FROM total) - coalesce(sum(weight) FILTER (weight * r.share > 3 * source_size), 0)) FROM s)
  FROM rounds r WHERE round < 30),
last AS (SELECT max(share) AS share FROM rounds WHERE isfinite(share)),
b AS (SELECT s.*, CASE WHEN weight * share > 3 * source_size THEN 3.0 * source_size ELSE weight * share END::DOUBLE AS target FROM s, last),
c AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM b),
h AS (
  SELECT d.source, hash, sum(size) AS n FROM sized d GROUP BY d.source, hash),
e AS (
  SELECT h.source, h.hash, h.n, c.target - c.whole * c.source_size
         - (sum(h.n) OVER (PARTITION BY h.source ORDER BY h.hash) - h.n) AS before
  FROM h JOIN c ON h.source IS NOT DISTINCT FROM c.source),
edge AS (SELECT source, max(hash) AS hash, arg_max(n, hash) AS n, arg_max(before, hash) AS before FROM e WHERE before > 0 GROUP BY source)
SELECT d.doc_id, d.size::BIGINT AS size, c.source_size, c.target,
       (d.size * (c.whole + CASE WHEN d.hash < edge.hash OR d.hash = edge.hash AND edge.n - edge.before < edge.before THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized d JOIN c ON d.source IS NOT DISTINCT FROM c.source
LEFT JOIN edge ON d.source IS NOT DISTINCT FROM edge.source
"""

SQL["op10_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT *, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND coalesce(page_id < last, last IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND coalesce(page_id < last, last IS NOT NULL) THEN last END AS refers_to
FROM q
"""

SQL["op8_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, rowid AS r, unnest(a) AS line, unnest(range(len(a))) AS i
  FROM (SELECT doc_id, row_number() OVER () AS rowid, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, (h.key IS NOT NULL AND k.doc_id < h.last) AS gone FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id, r
"""


LEADS = ", ".join(f"lead(w, {i}) OVER o" for i in range(1, 35))

SQL["op9_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
w AS (SELECT r, unnest(a) AS w, unnest(range(len(a))) AS p, len(a) AS n FROM d),
k AS (SELECT r, p, n, md5(concat_ws(' ', w, {LEADS})) AS k FROM w WINDOW o AS (PARTITION BY r ORDER BY p)),
f AS (SELECT r, p, k FROM k WHERE p + 35 <= n),
h AS (SELECT k FROM f GROUP BY k HAVING count(*) > 1),
g AS (SELECT DISTINCT r, p + j AS p FROM (SELECT r, p, unnest(range(35)) AS j FROM f JOIN h USING (k))),
s AS (SELECT w.r, count(*) AS n, count(g.p) AS gone, string_agg(w.w, ' ' ORDER BY w.p) FILTER (g.p IS NULL) AS kept FROM w LEFT JOIN g ON w.r = g.r AND w.p = g.p GROUP BY w.r)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)
"""

SQL["op3_embedding_caps"] = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT * FROM e WHERE v IS NOT NULL AND list_bool_and(list_transform(v, lambda x: x IS NOT NULL AND isfinite(x))) AND list_sum(list_transform(v, lambda x: x * x)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
c(id, label) AS (SELECT vec_id, vec_id FROM u UNION SELECT l.b, c.label FROM c JOIN l ON l.a = c.id WHERE c.label < l.b),
m AS (SELECT id, min(label) AS label FROM c GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(m.label, e.vec_id) AS component_id, coalesce(m.label, e.vec_id) = e.vec_id AS kept
FROM e LEFT JOIN m ON e.vec_id = m.id LEFT JOIN n ON e.vec_id = n.a
"""


def op1_simhash_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op3_embedding_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op5_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), PIECES)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [f for n, f in globals().items() if n.startswith("op") and n[2].isdigit()]
    return {f.__name__: f for f in sorted(own, key=lambda f: int(f.__name__[2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
