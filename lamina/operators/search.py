"""Boolean, phrase, wildcard and proximity queries over a positional index.

Loosest to tightest: OR, AND, NOT, ~ proximity, primary. Operators are upper case; words
in a row are a phrase; + stands for any one word; ~ is one word of distance, ~~ two; a
word may end in * (prefix) or $ (stem); [FIELD] after a primary names a field.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, stem
from .positions import proximity
from .tables import spread

#: Words of a phrase that one number holds a bit each of.
BITS = 62
TOKEN = re.compile(r"\(|\)|\[[A-Za-z0-9 ]+\]|~+(?:\s+~+)*|\+|[^\s()\[\]~+]+")


@dataclass
class Phrase:
    words: list[str | None] = field(default_factory=list)
    of: str = ""


@dataclass
class Near:
    left: object
    right: object
    within: int


@dataclass
class Both:
    op: str
    left: object
    right: object


class Parser:
    def __init__(self, text: str, stops: frozenset[str] = frozenset(STOP_WORDS)):
        self.tokens, self.at, self.stops = TOKEN.findall(text), 0, stops

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def parse(self) -> object:
        out = self.level(0)
        if self.peek() is not None:
            raise ValueError(f"unexpected {self.peek()!r}")
        return out

    def level(self, i: int) -> object:
        if i == 3:
            return self.near()
        left = self.level(i + 1)
        while self.peek() == ("OR", "AND", "NOT")[i]:
            left = Both(self.take(), left, self.level(i + 1))
        return left

    def near(self) -> object:
        left = self.primary()
        while (t := self.peek()) is not None and t.startswith("~"):
            within = self.take().count("~")
            right = self.primary()
            if not isinstance(right, Phrase) or isinstance(left, Both):
                raise ValueError("proximity is between phrases; a parenthesised side has no places")
            left = Near(left, right, within)
        return left

    def primary(self) -> object:
        if self.peek() == "(":
            self.take()
            out = self.level(0)
            if self.peek() != ")":
                raise ValueError("a parenthesis isn't closed")
            self.take()
            return out
        p = Phrase()
        while (t := self.peek()) is not None and t not in ("(", ")", "OR", "AND", "NOT") and not t.startswith("~"):
            self.take()
            if t.startswith("["):
                p.of = t[1:-1].upper()
                break
            if t == "+":
                p.words.append(None)
                continue
            for w in re.findall(r"[^\W_]+[*$]?", t.lower()):
                p.words.append(None if w in self.stops or w.isdigit() else w)
        if not any(p.words):
            raise ValueError("a phrase needs a word that is indexed")
        return p


def term_test(word: str) -> Column:
    """Which terms a query word means; prefixes become ranges that reach the scan."""
    if word.endswith(("*", "$")):
        prefix = stem(word[:-1]) if word.endswith("$") else word[:-1]
        return F.col("term").startswith(prefix)
    return F.col("term") == word


def starts(index: DataFrame, p: Phrase) -> DataFrame:
    """(uid, start) of a phrase in index (uid, term, pos[, field])."""
    rows = index.where(F.col("field") == p.of) if p.of else index
    words = [(i, w) for i, w in enumerate(p.words) if w is not None]
    test = term_test(words[0][1])
    for _, w in words[1:]:
        test = test | term_test(w)
    # a bit for each word: repeated hits add nothing, so they needn't be made distinct
    own = [F.struct((F.col("pos") - i).alias("start"), F.lit(n // BITS).alias("part"), F.lit(1 << n % BITS).cast("long").alias("bit")) for n, (i, _) in enumerate(words)]
    hit = F.filter(F.array(*(F.when(term_test(w), x) for (_, w), x in zip(words, own, strict=True))), lambda s: s.isNotNull())
    hits = rows.where(test).select("uid", F.explode(hit).alias("s")).select("uid", "s.start", "s.part", "s.bit").where("start >= 0")
    full = {k: (1 << min(BITS, len(words) - k * BITS)) - 1 for k in range((len(words) + BITS - 1) // BITS)}
    masks = [F.bit_or(F.when(F.col("part") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"m{k}") for k in full]
    found = spread(hits, "uid").groupBy("uid", "start").agg(*masks)
    return found.where(reduce(lambda x, y: x & y, (F.col(f"m{k}") == m for k, m in full.items()))).select("uid", "start")


def places(index: DataFrame, node: object) -> tuple[DataFrame, int]:
    """Starts of the last phrase of a proximity chain, and its length."""
    if isinstance(node, Phrase):
        return starts(index, node), len(node.words)
    left, n = places(index, node.left)
    right, m = places(index, node.right)
    return proximity(left, n, right, node.within), m


def evaluate(index: DataFrame, node: object) -> DataFrame:
    """(uid): distinct documents."""
    if isinstance(node, Both):
        a, b = evaluate(index, node.left), evaluate(index, node.right)
        if node.op == "OR":
            return a.union(b).distinct()
        return a.join(b, "uid", "left_semi" if node.op == "AND" else "left_anti")
    return places(index, node)[0].select("uid").distinct()


def search(index: DataFrame, query: str, stops: frozenset[str] = frozenset(STOP_WORDS)) -> DataFrame:
    return evaluate(index, Parser(query, stops).parse())


def counts(index: DataFrame, pattern: str) -> DataFrame:
    """(term, df): each matching term with its number of documents; * anywhere."""
    rx = "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"
    return index.where(F.col("term").rlike(rx)).groupBy("term").agg(F.count_distinct("uid").alias("df"))


def count(index: DataFrame, word: str) -> DataFrame:
    """One row: documents with a word, prefixes merged."""
    return index.where(term_test(word)).agg(F.count_distinct("uid").alias("df"))


def links(edges: DataFrame, ids: DataFrame, hops: int = 1) -> DataFrame:
    """(uid): neighbours of ids, over edges (src, dst); each hop gathers distinct ends."""
    now = ids.select("uid")
    for _ in range(hops):
        now = edges.join(now, F.col("src") == F.col("uid"), "left_semi").select(F.col("dst").alias("uid")).distinct()
    return now


def ranked_words(index: DataFrame, text: str) -> DataFrame:
    """(uid, hits): documents by how many of the text's words they hold."""
    words = sorted({w for w in re.findall(r"[^\W_]+", text.lower()) if w not in STOP_WORDS})
    return index.where(F.col("term").isin(words)).groupBy("uid").agg(F.count_distinct("term").alias("hits"))


def ranked_pairs(index: DataFrame, text: str) -> DataFrame:
    """(uid, hits): documents by how many of the text's pairs of neighbouring informative
    words they hold as phrases. One pass over the index looks for all."""
    words = re.findall(r"[^\W_]+", text.lower())
    pairs = sorted({(a, b) for a, b in zip(words, words[1:]) if not {a, b} & set(STOP_WORDS)})
    if not pairs:
        return index.select("uid").limit(0).withColumn("hits", F.lit(0).cast("long"))
    hit = F.filter(F.array(*(x for n, (a, b) in enumerate(pairs) for x in (F.when(F.col("term") == a, F.struct(F.lit(n).alias("n"), F.lit(0).alias("side"), F.col("pos").alias("at"))), F.when(F.col("term") == b, F.struct(F.lit(n).alias("n"), F.lit(1).alias("side"), (F.col("pos") - 1).alias("at")))))), lambda s: s.isNotNull())
    held = index.where(F.col("term").isin(sorted({w for p in pairs for w in p}))).select("uid", F.explode(hit).alias("h")).select("uid", "h.n", "h.at", "h.side").distinct()
    both = held.groupBy("uid", "n", "at").agg(F.count("*").alias("sides")).where("sides = 2")
    return both.groupBy("uid").agg(F.count_distinct("n").alias("hits"))


def search_within(index: DataFrame, query: str, ids: DataFrame, stops: frozenset[str] = frozenset(STOP_WORDS)) -> DataFrame:
    """A query whose operand besides is a table of ids (uid)."""
    return search(index, query, stops).join(ids.select("uid").distinct(), "uid", "left_semi")


def exact_title(index: DataFrame, title: str, stops: frozenset[str] = frozenset(STOP_WORDS)) -> DataFrame:
    """(uid) of documents that hold a title as one phrase: no operators in it; stop words and
    numbers stand for any word."""
    words = [None if w in stops or w.isdigit() else w for w in re.findall(r"[^\W_]+", title.lower())]
    while words and words[-1] is None:
        words.pop()
    lead = next((i for i, w in enumerate(words) if w is not None), len(words))
    if lead == len(words):
        raise ValueError("a title needs a word that is indexed")
    return starts(index, Phrase(words[lead:])).select("uid").distinct()


def word_positions(index: DataFrame, pattern: str) -> DataFrame:
    """(term, uid, positions) of each matching term; * anywhere."""
    rx = "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"
    return index.where(F.col("term").rlike(rx)).groupBy("term", "uid").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def rewrites(query: str, stops: frozenset[str] = frozenset(STOP_WORDS)) -> list[tuple[str, str]]:
    """(stage, text) of how a query is read: its tokens, then the tree of operators."""
    def text(node: object) -> str:
        if isinstance(node, Both):
            return f"({text(node.left)} {node.op} {text(node.right)})"
        if isinstance(node, Near):
            return f"({text(node.left)} {'~' * node.within} {text(node.right)})"
        return "<" + " ".join(w or "+" for w in node.words) + ">" + (f"[{node.of}]" if node.of else "")

    return [("tokens", " | ".join(TOKEN.findall(query))), ("tree", text(Parser(query, stops).parse()))]


def associated(rows: DataFrame, ids: DataFrame, code: str = "code", most: int = 30, least: int = 0) -> DataFrame:
    """(code, n): the codes that most of the given documents have; rows (uid, code)."""
    held = rows.join(ids.select("uid").distinct(), "uid", "left_semi").groupBy(code).agg(F.count_distinct("uid").alias("n"))
    return held.where(F.col("n") > least).orderBy(F.desc("n"), code).limit(most)


def named_results(results: dict[str, DataFrame], formula: str) -> DataFrame:
    """(uid) of saved results combined: '(#a OR #b) AND #c NOT #d'."""
    tokens = re.findall(r"\(|\)|#\w+|AND|OR|NOT", formula)
    at = 0

    def level(i: int) -> DataFrame:
        nonlocal at
        if i == 3:
            at += 1
            if tokens[at - 1] == "(":
                out = level(0)
                at += 1
                return out
            return results[tokens[at - 1][1:]].select("uid").distinct()
        left = level(i + 1)
        while at < len(tokens) and tokens[at] == ("OR", "AND", "NOT")[i]:
            at += 1
            right = level(i + 1)
            left = left.union(right).distinct() if i == 0 else left.join(right, "uid", "left_semi" if i == 1 else "left_anti")
        return left

    return level(0)


def neighbours(edges: DataFrame, ids: DataFrame, name: str | None = None, least: int = 0) -> DataFrame:
    """(src, dst, score): scored links (src, dst, name, score) of ids, of one kind if named,
    the best of several between the same two, with at least a score; no link to itself."""
    held = edges.where(F.col("src") != F.col("dst")) if name is None else edges.where((F.col("name") == name) & (F.col("src") != F.col("dst")))
    own = held.join(ids.select(F.col("uid").alias("src")).distinct(), "src", "left_semi")
    return own.groupBy("src", "dst").agg(F.max("score").alias("score")).where(F.col("score") >= least)
