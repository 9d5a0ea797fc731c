"""External tables to fields, record rearrangement, and sequence search."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import MEANS


def concepts(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(uid, field, terms) from rows (uid, kind, code) and a table (code, term): codes
    without a term keep themselves; terms of a field sorted and distinct."""
    t = table.select(F.col("code").alias("_c"), "term")
    joined = rows.join(t, F.col("code") == F.col("_c"), "left")
    return joined.groupBy("uid", F.upper("kind").alias("field")).agg(F.array_sort(F.collect_set(F.coalesce("term", "code"))).alias("terms"))


def themes(rows: DataFrame, score_columns: list[str]) -> DataFrame:
    """(uid, theme, percent): a theme is kept if three times its score exceeds the row's sum."""
    long = rows.unpivot(["uid"], score_columns, "theme", "score")
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in score_columns), F.lit(0))
    sums = rows.select(F.col("uid").alias("_u"), total.alias("total"))
    joined = long.join(sums, F.col("uid") == F.col("_u")).where((F.col("score") * 3 > F.col("total")) & (F.col("total") > 0))
    return joined.select("uid", "theme", F.floor(F.col("score") * 100 / F.col("total")).cast("long").alias("percent"))


def link_edges(citations: DataFrame) -> DataFrame:
    """(src, dst, kind) in both directions from (citing, referenced)."""
    pairs = citations.select("citing", "referenced").where("citing is not null and referenced is not null").distinct()
    cites = pairs.select(F.col("citing").alias("src"), F.col("referenced").alias("dst"), F.lit("CITES").alias("kind"))
    return cites.union(pairs.select(F.col("referenced").alias("src"), F.col("citing").alias("dst"), F.lit("CITED").alias("kind")))


def taxonomy(nodes: DataFrame, names: DataFrame, divisions: DataFrame, max_depth: int = 60) -> DataFrame:
    """(tax_id, name, rank, division, lineage) from nodes (tax_id, parent, rank, division_id),
    names (tax_id, name, class) and divisions (division_id, division). Lineages grow by
    doubling: each round joins every path with the path of its end."""
    own = names.where("class = 'scientific name'").select("tax_id", "name")
    path = nodes.select("tax_id", F.when(F.col("parent") != F.col("tax_id"), F.array("parent")).otherwise(F.array().cast(f"array<{dict(nodes.dtypes)['parent']}>")).alias("up"))
    step = 1
    while step < max_depth:
        far = path.select(F.col("tax_id").alias("_t"), F.col("up").alias("_up"))
        path = path.join(far, F.try_element_at("up", F.lit(-1)) == F.col("_t"), "left").select("tax_id", F.when(F.col("_up").isNotNull(), F.concat("up", "_up")).otherwise(F.col("up")).alias("up"))
        step *= 2
    placed = path.select("tax_id", F.posexplode("up").alias("i", "above"))
    above = own.select(F.col("tax_id").alias("above"), F.col("name").alias("above_name"))
    line = placed.join(above, "above").groupBy("tax_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("i")).alias("i"), "above_name"))).alias("l"))
    lineage = F.array_join(F.transform("l", lambda x: x["above_name"]), "; ")
    joined = nodes.join(own, "tax_id", "left").join(divisions, "division_id", "left").join(line, "tax_id", "left")
    return joined.select("tax_id", "name", "rank", "division", F.coalesce(lineage, F.lit("")).alias("lineage"))


def tree_ancestors(codes: DataFrame, column: str = "code") -> DataFrame:
    """(code, ancestor): a tree code and each prefix of it that ends at a dot."""
    parts = F.split("code", r"\.")
    grow = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    return codes.select(F.col(column).alias("code")).select("code", F.explode(grow).alias("ancestor"))


def append_fragments(records: DataFrame, fragments: DataFrame) -> DataFrame:
    """Records (id, xml) with each id's fragment (id, fragment) before their closing tag;
    records without a fragment drop."""
    f = fragments.select(F.lower("id").alias("_id"), "fragment")
    joined = records.join(f, F.lower("id") == F.col("_id"))
    return joined.select("id", F.concat(F.regexp_extract("xml", r"(?s)^(.*)</[^<>]+>\s*$", 1), "fragment", F.regexp_extract("xml", r"(</[^<>]+>)\s*$", 1)).alias("xml"))


def damaged(x: Column) -> Column:
    """How often an entity was encoded twice or more."""
    return F.regexp_count(x, F.lit("&amp;(amp;)*(lt|gt|amp|quot|apos|#[0-9]+);"))


def expand(pattern: str) -> list[str]:
    out = [""]
    for c in pattern.upper():
        out = [p + q for p in out for q in MEANS.get(c, c)]
        if len(out) > 256:
            raise ValueError(f"{pattern} stands for too many sequences")
    return out


class Automaton:
    """Aho-Corasick: all places of all patterns, overlaps included."""

    def __init__(self, patterns: dict[str, str]):
        self.next: list[dict[str, int]] = [{}]
        self.fail, self.out = [0], [[]]
        for p, alias in patterns.items():
            s = 0
            for c in p:
                if c not in self.next[s]:
                    self.next[s][c] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.out.append([])
                s = self.next[s][c]
            self.out[s].append((len(p), alias))
        queue = list(self.next[0].values())
        for s in queue:
            for c, t in self.next[s].items():
                queue.append(t)
                f = self.fail[s]
                while f and c not in self.next[f]:
                    f = self.fail[f]
                self.fail[t] = self.next[f][c] if c in self.next[f] and self.next[f][c] != t else 0
                self.out[t] = self.out[t] + self.out[self.fail[t]]

    def find(self, text: str) -> list[tuple[int, str]]:
        s, hits = 0, []
        for i, c in enumerate(text):
            while s and c not in self.next[s]:
                s = self.fail[s]
            s = self.next[s].get(c, 0)
            hits += [(i - n + 1, alias) for n, alias in self.out[s]]
        return sorted(hits)


def _search(df: DataFrame, id_: str, text: str, patterns: dict[str, str], wrap: int, fold: bool) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = Automaton(patterns)
        for pdf in parts:
            rows = []
            for i, t in zip(pdf["id"], pdf["text"], strict=True):
                if t is not None:
                    t = t.upper() if fold else t
                    rows += [(i, p, a) for p, a in machine.find(t + t[:wrap]) if p < len(t)]
            yield pd.DataFrame(rows, columns=["id", "position", "alias"])

    return df.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text")).mapInPandas(run, "id long, position int, alias string")


def find(df: DataFrame, patterns: list[str], id_: str = "id", text: str = "text", sensitive: bool = False, circular: bool = False) -> DataFrame:
    """(id, position, alias): places of strings, from 0; circular texts wrap."""
    table = {(p if sensitive else p.upper()): p for p in patterns}
    return _search(df, id_, text, table, max(map(len, patterns)) - 1 if circular else 0, not sensitive)


def find_sequences(df: DataFrame, patterns: dict[str, str], id_: str = "id", text: str = "text", circular: bool = False, top_only: bool = False) -> DataFrame:
    """(id, position, alias): places of IUPAC patterns {pattern: alias} on both strands;
    those of the lower strand have an alias with a minus, palindromes count once."""
    pair = str.maketrans("ACGTMRWSYKVHDBN", "TGCAKYWSRMBDHVN")
    table: dict[str, str] = {}
    for p, alias in patterns.items():
        back = p.upper().translate(pair)[::-1]
        for s in expand(p):
            table[s] = alias
        if not top_only and back != p.upper():
            for s in expand(back):
                table.setdefault(s, alias + "-")
    return _search(df, id_, text, table, max(map(len, table)) - 1 if circular else 0, True)
