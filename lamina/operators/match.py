"""Fuzzy matching: word-pair votes, Jaccard scores, classification by alias tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import given, pairs, relax, words

LEAST_VOTES, MOST_CANDIDATES, LEAST_SCORE = 4, 25, 60


def jaccard(a: Column, b: Column) -> Column:
    """Whole percent of unique words in common."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(F.array_union(a, b)) > 0, F.floor(both * 100 / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))).otherwise(0).cast("long")


def jaccard_pairs(a: DataFrame, b: DataFrame, a_id: str, b_id: str, least: int) -> DataFrame:
    """(a_id, b_id, score) of all pairs of texts with a score of `least` percent or more (1 at
    least). Both: (id, text), ids unique. Pairs meet by the words they share. The score is no
    more than the smaller number of words to the larger, so pairs too unequal never meet."""
    side = lambda df, name, n: df.select(name, F.array_distinct(words(F.col("text"), True)).alias("w")).select(name, F.size("w").cast("long").alias(n), F.explode("w").alias("t"))
    alike = (F.col("n") * 100 >= F.col("m") * least) & (F.col("m") * 100 >= F.col("n") * least)
    left, right = side(a, a_id, "n"), side(b, b_id, "m")
    both = left.join(right, (left.t == right.t) & alike).groupBy(a_id, "n", b_id, "m").agg(F.count("*").alias("both"))
    score = F.floor(F.col("both") * 100 / (F.col("n") + F.col("m") - F.col("both"))).cast("long")
    return both.withColumn("score", score).where(F.col("score") >= least).select(a_id, b_id, "score")


def votes(citations: DataFrame, docs: DataFrame) -> DataFrame:
    """(cit, doc, votes): documents with most of a citation's word pairs, if at least
    LEAST_VOTES. Both: (id, text)."""
    side = lambda df, name: df.select(F.col("id").alias(name), F.explode(F.array_distinct(pairs(F.col("text")))).alias("pair"))
    counted = side(citations, "cit").join(side(docs, "doc"), "pair").groupBy("cit", "doc").agg(F.count("*").alias("votes"))
    w = Window.partitionBy("cit")
    best = counted.withColumn("most", F.max("votes").over(w)).where((F.col("votes") == F.col("most")) & (F.col("votes") >= LEAST_VOTES))
    return best.withColumn("i", F.row_number().over(w.orderBy("doc"))).where(F.col("i") <= MOST_CANDIDATES).select("cit", "doc", "votes")


def match(citations: DataFrame, docs: DataFrame, least: int = LEAST_SCORE) -> DataFrame:
    """(cit, doc, score): the best scored candidate of each citation, first among equals."""
    text = lambda df, name: df.select(F.col("id").alias(name), F.array_distinct(words(F.col("text"), True)).alias(f"w_{name}"))
    scored = votes(citations, docs).join(text(citations, "cit"), "cit").join(text(docs, "doc"), "doc").withColumn("score", jaccard(F.col("w_cit"), F.col("w_doc")))
    best = scored.where(F.col("score") >= least).groupBy("cit").agg(F.max(F.struct(F.col("score"), (-F.col("doc")).alias("d"))).alias("b"))
    return best.select("cit", (-F.col("b.d")).alias("doc"), F.col("b.score").alias("score"))


def normalised(citations: DataFrame) -> DataFrame:
    """Citations (id, author, title, journal, year, volume, page) cleaned: white space squeezed,
    journals without periods, the first page and the year alone, and `text` made of what is there."""
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s+", " "))
    out = citations.select(
        "id", clean("author").alias("author"), F.regexp_replace(clean("title"), r"[.\s]+$", "").alias("title"), F.trim(F.regexp_replace(clean("journal"), "[.]", "")).alias("journal"),
        F.regexp_extract(clean("year"), "([0-9]{4})", 1).alias("year"), clean("volume").alias("volume"), F.regexp_extract(clean("page"), r"([\p{L}\p{Nd}]+)", 1).alias("page"),
    )
    parts = [F.when(F.col(c) != "", F.col(c)) for c in ("author", "title", "journal", "year", "volume", "page")]
    return out.withColumn("text", F.concat_ws(". ", *parts))


def compared(citations: DataFrame, records: DataFrame, fields: tuple[str, ...] = ("author", "title", "journal", "year", "volume", "page")) -> DataFrame:
    """(id, doc, agree, differ, missing): citations that name a record (id, doc, fields)
    against that record (doc, fields): the fields that agree, case and punctuation aside,
    that differ, and that either lacks; all are missing if there is no such record."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[^\p{L}\p{Nd}]+", " ")))
    r = records.select(F.col("doc").alias("_doc"), *(F.col(f).alias(f"_{f}") for f in fields))
    joined = citations.join(r, F.col("doc") == F.col("_doc"), "left")
    state = [F.when((plain(F.col(f)) == "") | (plain(F.col(f"_{f}")) == ""), "missing").when(plain(F.col(f)) == plain(F.col(f"_{f}")), "agree").otherwise("differ") for f in fields]
    told = F.array(*(F.struct(F.lit(f).alias("f"), s.alias("s")) for f, s in zip(fields, state, strict=True)))
    of = lambda s: F.array_join(F.transform(F.filter(told, lambda x: x["s"] == s), lambda x: x["f"]), ",").alias(s)
    return joined.select("id", "doc", of("agree"), of("differ"), of("missing"))


def keep_unless_empty(df: DataFrame, key: str, test: Column, strict: bool = False) -> DataFrame:
    """Filters the candidates of each key; a filter that would leave none is skipped,
    unless strict."""
    if strict:
        return df.where(test)
    kept = F.max(F.coalesce(test, F.lit(False)).cast("int")).over(Window.partitionBy(key))
    return df.withColumn("_any", kept).where((F.col("_any") == 0) | test).drop("_any")


def classify(docs: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(id, labels): distinct labels, sorted, of the aliases that are whole words of a text.
    The table of aliases is a plan constant, and a text is cleaned once for all of them."""
    text = F.concat(F.lit(" "), F.lower(relax(F.col("text"))), F.lit(" "))
    hits = lambda t: F.array(*(F.when(t.contains(f" {' '.join(a.lower().split())} "), F.lit(label)) for a, label in aliases.items()))
    found = F.array_sort(F.array_distinct(F.filter(given(text, hits), lambda x: x.isNotNull())))
    return docs.select("id", found.alias("labels"))
