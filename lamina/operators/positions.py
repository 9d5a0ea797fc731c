"""Positional tables of terms and the joins over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAK = r"[^\p{L}\p{Nd}]+"


def words(text: Column) -> Column:
    """Lower-case words of a text: runs of letters and digits."""
    return F.filter(F.split(F.lower(text), BREAK), lambda w: w != "")


def positions(docs: DataFrame, uid: str = "doc_id", text: str = "text") -> DataFrame:
    """(uid, term, pos): every word of every text, places from 0."""
    return docs.select(F.col(uid).alias("uid"), F.posexplode(words(F.col(text))).alias("pos", "term")).select("uid", "term", "pos")


def by_document(docs: DataFrame, uid: str = "doc_id", text: str = "text") -> DataFrame:
    """(uid, term, positions), one row for each word of each text; ids must be unique. Words
    are sorted within their row, so nothing is shuffled."""
    placed = docs.select(F.col(uid).alias("uid"), F.sort_array(F.transform(words(F.col(text)), lambda t, i: F.struct(t.alias("term"), i.alias("pos")))).alias("w"))
    begins = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w", i)["term"] != F.get("w", i - 1)["term"]))
    marked = placed.withColumn("b", F.when(F.size("w") > 0, begins))
    place = lambda p, end: F.transform(F.slice("w", p + 1, end - p), lambda x: x["pos"])
    runs = F.transform("b", lambda p, j: F.struct(F.get("w", p)["term"].alias("term"), place(p, F.coalesce(F.get("b", j + 1), F.size("w"))).alias("positions")))
    return marked.select("uid", F.explode(runs).alias("r")).select("uid", "r.term", "r.positions")


def frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df): the number of texts that hold each word."""
    return docs.select(F.explode(F.array_distinct(words(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def phrase(index: DataFrame, terms: list[str | None]) -> DataFrame:
    """(uid, start) where the terms follow each other; None stands for any one word.

    Each document's places are gathered once for the few terms asked for; the filter on
    terms reaches the scan before the one shuffle.
    """
    wanted = [(i, t) for i, t in enumerate(terms) if t is not None]
    hits = index.where(F.col("term").isin(sorted({t for _, t in wanted})))
    shifts = [F.when(F.col("term") == t, F.struct(F.lit(i).alias("i"), (F.col("pos") - i).alias("start"))) for i, t in wanted]
    spread = hits.select("uid", F.explode(F.filter(F.array(*shifts), lambda s: s.isNotNull())).alias("s"))
    found = spread.groupBy("uid", F.col("s.start").alias("start")).agg(F.count("*").alias("n"))
    return found.where((F.col("n") == len(wanted)) & (F.col("start") >= 0)).select("uid", "start")


def proximity(a: DataFrame, length: int, b: DataFrame, within: int) -> DataFrame:
    """(uid, start): starts of b that follow a start of a, of `length` words, within so many words."""
    left, right = a.select(F.col("uid").alias("u"), F.col("start").alias("s")), b
    near = (F.col("start") > F.col("s")) & (F.col("start") <= F.col("s") + length + within)
    return left.join(right, (F.col("u") == F.col("uid")) & near).select("uid", "start").distinct()


def any_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts).distinct()
