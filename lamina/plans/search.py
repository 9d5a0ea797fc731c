"""Index and search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T
from ..operators import index as I
from ..operators import search as Q
from ..operators.positions import by_document, frequencies, phrase, positions


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


POS = r"""pos AS (
  SELECT doc_id AS uid, unnest(w) AS term, unnest(range(len(w))) AS pos
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda x: x <> '') AS w FROM documents))"""


@query(f"""WITH {POS}
SELECT a.uid AS doc_id, count(*) AS hits FROM pos a JOIN pos b ON a.uid = b.uid AND b.pos = a.pos + 1
WHERE a.term = 'the' AND b.term = 'of' GROUP BY 1""")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase(positions(docs(spark, sf_dir)), ["the", "of"])
    return found.groupBy(F.col("uid").alias("doc_id")).agg(F.count("*").alias("hits"))


@query(f"""WITH {POS} SELECT term, count(DISTINCT uid) AS df, count(*) AS tf FROM pos GROUP BY 1""")
def term_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.totals(positions(docs(spark, sf_dir)))


@query(f"""WITH {POS} SELECT a.uid AS doc_id, count(*) AS hits FROM pos a JOIN pos b ON a.uid = b.uid AND b.pos = a.pos + 2
WHERE a.term = 'the' AND b.term = 'of' GROUP BY 1""")
def phrase_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase(positions(docs(spark, sf_dir)), ["the", None, "of"])
    return found.groupBy(F.col("uid").alias("doc_id")).agg(F.count("*").alias("hits"))


@query(f"""WITH {POS} SELECT DISTINCT a.uid FROM pos a JOIN pos b ON a.uid = b.uid AND b.pos > a.pos AND b.pos <= a.pos + 4 WHERE a.term = 'the' AND b.term = 'of'""")
def proximity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.search(positions(docs(spark, sf_dir)), "the ~~~ of", frozenset())


@query(f"""WITH {POS}, w AS (SELECT DISTINCT uid, term FROM pos WHERE term IN ('the', 'der', 'des', 'los'))
(SELECT uid FROM w WHERE term = 'the' INTERSECT (SELECT uid FROM w WHERE term = 'der' EXCEPT SELECT uid FROM w WHERE term = 'des')) UNION SELECT uid FROM w WHERE term = 'los'""")
def boolean_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """los OR the AND der NOT des: NOT binds before AND, AND before OR."""
    return Q.search(positions(docs(spark, sf_dir)), "los OR the AND der NOT des", frozenset())


@query(f"""WITH {POS} SELECT term, count(DISTINCT uid) AS df FROM pos WHERE term LIKE 'onth%' GROUP BY 1""")
def wildcard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.counts(positions(docs(spark, sf_dir)), "onth*")


@query(f"""WITH {POS} SELECT count(DISTINCT uid) AS df FROM pos WHERE term LIKE 'onth%'""")
def wildcard_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.count(positions(docs(spark, sf_dir)), "onth*")


@query(f"""WITH {POS} SELECT DISTINCT a.uid FROM pos a JOIN pos b ON a.uid = b.uid AND b.pos = a.pos + 1 WHERE a.term LIKE 'th%' AND b.term LIKE 'on%'""")
def wildcard_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.search(positions(docs(spark, sf_dir)), "th* on*", frozenset())


@query(f"""WITH {POS} SELECT uid, count(DISTINCT term) AS hits FROM pos WHERE term IN ('onthe', 'erly', 'edly', 'thered') GROUP BY 1""")
def ranked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.ranked_words(positions(docs(spark, sf_dir)), "onthe erly, edly: thered the")


@query(f"""WITH {POS}, t AS (SELECT term, count(DISTINCT uid) AS df FROM pos GROUP BY 1)
SELECT 'TEXT' AS field, pos.term, df, uid, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM pos JOIN t ON pos.term = t.term GROUP BY pos.term, df, uid""")
def postings_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverts every term; a frequent term stays many rows."""
    d = docs(spark, sf_dir)
    index = by_document(d).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))  # shuffles less than arrays do
    return I.exploded_postings(index, frequencies(d)).select(F.lit("TEXT").alias("field"), "term", "df", "uid", "positions")


_FOLDED = f"translate(text, '{T.FOLD_FROM}', '{T.FOLD_TO}')"
for _a, _b in T.FOLD_MORE.items():
    _FOLDED = f"replace({_FOLDED}, '{_a}', '{_b}')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#39;", "''"), ("&#34;", '"'), ("&amp;", "&")):
    _FOLDED = f"replace({_FOLDED}, '{_a}', '{_b}')"
_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(rf"""WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(lower({_FOLDED}), '[()_\-]', ' ', 'g'), chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
w AS (SELECT doc_id, i, list_filter(regexp_split_to_array(regexp_replace(p, '[.,:;]+([ \t\n\x0B\f\r]|$)', ' ', 'g'), '[^a-z0-9.]+'), lambda x: x <> '') AS w FROM p),
b AS (SELECT *, coalesce(sum((ceil((len(w) + 20) / 100) * 100)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM w),
t AS (SELECT doc_id, unnest(w) AS term, (b + unnest(range(len(w))))::INT AS pos FROM b)
SELECT doc_id AS uid, 'TEXT' AS field, term, pos FROM t WHERE term NOT IN ({_STOPS}) AND NOT regexp_matches(term, '^[0-9.]+$')""")
def field_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional index by paragraphs, with gaps between them."""
    return I.paragraph_terms(docs(spark, sf_dir), "doc_id", F.split("text", "\n"), "TEXT")


@query(f"""WITH {POS}, near AS (SELECT DISTINCT a.uid FROM pos a JOIN pos b ON a.uid = b.uid AND b.pos > a.pos AND b.pos <= a.pos + 3 WHERE a.term = 'onthe' AND b.term = 'edly')
SELECT DISTINCT uid FROM pos WHERE starts_with(term, '{T.stem("erly")}') UNION SELECT DISTINCT uid FROM pos WHERE starts_with(term, '{T.stem("things")}') AND uid IN (FROM near)""")
def stem_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.search(positions(docs(spark, sf_dir)), "erly$ OR things$ AND (onthe ~~ edly)")


@query(f"""WITH {POS}, t AS (SELECT term, count(DISTINCT uid) AS df FROM pos GROUP BY 1), n AS (SELECT count(*) AS n FROM documents)
SELECT uid, pos.term, count(*) AS tf, round(count(*) * ln(n.n / t.df), 6) AS tfidf FROM pos JOIN t ON pos.term = t.term, n GROUP BY uid, pos.term, n.n, t.df""")
def tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of every document."""
    d = docs(spark, sf_dir)
    return I.tf_idf(by_document(d).select("uid", "term", F.size("positions").cast("long").alias("tf")), frequencies(d), d)
