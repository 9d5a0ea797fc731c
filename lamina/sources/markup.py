"""Tolerant markup: records of a stream, tokens, and the node table.

The node table has a row for each element: rec_id; pre, its place in document order; end,
the place of its last descendant; depth; parent, the parent's place; name; parent_name;
contents, its own text, entities decoded; attrs. What isn't well-formed never raises:
an end tag closes the nearest open element of its name, others are ignored, and elements
that are never closed end with their parent.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--(?P<comment>.*?)-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?(?P<pi>.*?)\?>|<!(?P<doctype>[^>]*)>|</\s*(?P<end>[^\s>/]+)\s*>|<(?P<start>[^\s>/<!?]+)(?P<attrs>(?:\s+[^\s=>/\"']+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+))?)*)\s*(?P<self>/?)>|(?P<text>[^<]+|<)", re.S)
ATTR = re.compile(r"([^\s=>/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
#: HTML elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NODE = "rec_id long, pre int, end int, depth int, parent int, name string, parent_name string, contents string, attrs map<string,string>"


def attributes(text: str) -> dict[str, str]:
    return {m[1]: html.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(text)}


def tokens(text: str) -> Iterator[tuple[str, str, dict[str, str] | None]]:
    """(kind, name or content, attributes) of each piece of markup."""
    for m in TOKEN.finditer(text):
        kind = m.lastgroup if m.lastgroup not in ("attrs", "self") else "start"
        if kind == "start":
            yield ("self" if m["self"] else "start"), m["start"], attributes(m["attrs"])
        else:
            yield kind, m[kind], None


@dataclass
class Tree:
    """A record's elements in document order, one list for each property."""

    names: list[str]
    parents: list[int]
    ends: list[int]
    depths: list[int]
    contents: list[str]
    attrs: list[dict[str, str]]

    def children(self, i: int) -> list[int]:
        out, at = [], i + 1
        while at <= self.ends[i]:
            out.append(at)
            at = self.ends[at] + 1
        return out


def tolerant(text: str, void: frozenset[str] = VOID, raw: bool = False) -> Tree:
    """The elements of a text, from the tokenizer that takes anything."""
    t = Tree([], [], [], [], [], [])
    names, parents, ends, depths, attrs = t.names, t.parents, t.ends, t.depths, t.attrs
    own: list[list[str]] = []
    open_: list[int] = []

    def close(down_to: int) -> None:
        while len(open_) > down_to:
            ends[open_.pop()] = len(names) - 1

    for m in TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "text" or kind == "cdata":
            if open_:
                value = m[kind]
                if kind == "text" and "&" in value and not raw:
                    value = html.unescape(value)
                own[open_[-1]] += value.split()
        elif kind == "end":
            name = m["end"]
            for i in range(len(open_) - 1, -1, -1):
                if names[open_[i]] == name:
                    close(i)
                    break
        elif kind in ("self", "attrs", "start"):
            i, (name, given, closed) = len(names), m.group("start", "attrs", "self")
            names.append(name)
            parents.append(open_[-1] if open_ else -1)
            ends.append(i)
            depths.append(len(open_))
            attrs.append(attributes(given) if given else {})
            own.append([])
            if not closed and (not void or name.lower() not in void):
                open_.append(i)
    close(0)
    t.contents.extend(map(" ".join, own))
    return t


def nodes_of(text: str, void: frozenset[str] = VOID, raw: bool = False) -> list[dict]:
    t = tolerant(text, void, raw)
    rows = zip(t.ends, t.depths, t.parents, t.names, t.contents, t.attrs, strict=True)
    return [{"pre": i, "end": e, "depth": d, "parent": p, "name": n, "parent_name": t.names[p] if p >= 0 else "", "contents": c, "attrs": a} for i, (e, d, p, n, c, a) in enumerate(rows)]


def _walk(e: ElementTree.Element, parent: int, depth: int, t: Tree) -> None:
    i = len(t.names)
    t.names.append(e.tag)
    t.parents.append(parent)
    t.depths.append(depth)
    t.attrs.append(e.attrib)
    t.ends.append(i)
    t.contents.append("")
    parts = e.text.split() if e.text else []
    for child in e:
        _walk(child, i, depth + 1, t)
        if child.tail:
            parts += child.tail.split()
    t.contents[i] = " ".join(parts)
    t.ends[i] = len(t.names) - 1


def element_of(text: str) -> ElementTree.Element | None:
    """The element of a record that is well formed and plain, from the expat parser; None for
    what the tolerant tokenizer must read."""
    if "<!" in text or "<?" in text or "xmlns" in text:
        return None
    try:
        return ElementTree.fromstring(text)
    except (ElementTree.ParseError, ValueError):
        return None


def content_of(e: ElementTree.Element) -> str:
    """An element's own text."""
    if not len(e):
        return " ".join(e.text.split()) if e.text else ""
    return " ".join(w for part in (e.text, *(c.tail for c in e)) if part for w in part.split())


def tree_of(text: str, void: frozenset[str] = frozenset(), raw: bool = False) -> Tree:
    """The elements of a record. What is well formed and plain goes through the expat
    parser; comments, declarations, name spaces, void elements and whatever is broken go
    through the tolerant tokenizer, with equal results. raw keeps entities as they are."""
    if not raw and not void and (e := element_of(text)) is not None:
        try:
            t = Tree([], [], [], [], [], [])
            _walk(e, -1, 0, t)
            return t
        except RecursionError:
            pass
    return tolerant(text, void, raw)


#: Nodes that are gathered before they leave a Python worker.
HELD_NODES = 20_000


def _node_batch(ids: list[int], pre: list[int], above: list[str], t: Tree) -> pa.RecordBatch:
    data = [pa.array(ids, pa.int64())]
    data += [pa.array(x, pa.int32()) for x in (pre, t.ends, t.depths, t.parents)]
    data += [pa.array(x, pa.string()) for x in (t.names, above, t.contents)]
    data.append(pa.array([list(a.items()) for a in t.attrs], pa.map_(pa.string(), pa.string())))
    return pa.RecordBatch.from_arrays(data, names=["rec_id", "pre", "end", "depth", "parent", "name", "parent_name", "contents", "attrs"])


def node_batches(batches: Iterator[pa.RecordBatch], void: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Nodes of (rec_id, text), one text at a time, in batches of HELD_NODES and a text's more."""
    ids, pre, above, held = [], [], [], Tree([], [], [], [], [], [])
    for b in batches:
        for r, x in zip(b.column(0), b.column(1), strict=True):
            if not x.is_valid:
                continue
            t = tree_of(x.as_py(), void)
            ids += [r.as_py()] * len(t.names)
            pre += range(len(t.names))
            above += [t.names[i] if i >= 0 else "" for i in t.parents]
            for k in vars(t):
                getattr(held, k).extend(getattr(t, k))
            if len(ids) >= HELD_NODES:
                yield _node_batch(ids, pre, above, held)
                ids, pre, above, held = [], [], [], Tree([], [], [], [], [], [])
    yield _node_batch(ids, pre, above, held)


def node_table(records: DataFrame, rec_id: str = "rec_id", text: str = "xml", html_void: bool = False) -> DataFrame:
    """The node table of records (rec_id, text). One narrow stage; null texts have no nodes."""
    void = VOID if html_void else frozenset()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return node_batches(batches, void)

    return records.select(F.col(rec_id).cast("long").alias("rec_id"), F.col(text).alias("xml")).mapInArrow(run, NODE)


#: Characters of records that are gathered before they leave a Python worker.
HELD_CHARACTERS = 4 << 20


def split_records(text: str, pattern: str) -> Iterator[str]:
    """Outermost elements of a name, or with 'Set/*' all children of Set, as source text."""
    parent, star = (pattern.split("/")[0], True) if pattern.endswith("/*") else (pattern, False)
    depth, begin = 0, 0
    inside = 0  # star: how deep inside the set
    for m in TOKEN.finditer(text):
        start, end, closed = m["start"], m["end"], bool(m["self"])
        if not star:
            if start == parent and not closed:
                if depth == 0:
                    begin = m.start()
                depth += 1
            elif start == parent and depth == 0:
                yield m[0]
            elif end == parent and depth:
                depth -= 1
                if depth == 0:
                    yield text[begin : m.end()]
            continue
        if start and not closed:
            if inside == 1:
                begin = m.start()
            if inside or start == parent:
                inside += 1
        elif start and closed and inside == 1:
            yield m[0]
        elif end and inside:
            inside -= 1
            if inside == 1:
                yield text[begin : m.end()]


def record_batches(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[pa.RecordBatch]:
    """Records of texts, one text at a time, in batches of HELD_CHARACTERS and a record's more."""
    held, size = [], 0
    for b in batches:
        for t in b.column(0):
            for r in split_records(t.as_py(), pattern) if t.is_valid else ():
                held.append(r)
                size += len(r)
                if size >= HELD_CHARACTERS:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["xml"])
                    held, size = [], 0
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["xml"])


def records(texts: DataFrame, pattern: str, text: str = "value") -> DataFrame:
    """(rec_id, xml): the records of each row's text. rec_id follows the order of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return record_batches(batches, pattern)

    return texts.select(F.col(text).alias("t")).mapInArrow(run, "xml string").select(F.monotonically_increasing_id().alias("rec_id"), "xml")


def read_records(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Records of files, compressed ones included; a file is one text."""
    return records(spark.read.text(path, wholetext=True), pattern)


def stream_records(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(rec_id, xml): the elements of a name in files of any size. The reader splits files at
    the element's end tag, so a file is read by many tasks and no text is longer than a
    record and what stands before it. For elements that don't nest in themselves and whose
    end tags are written plainly; `read_records` takes all others."""
    rows = spark.read.option("lineSep", f"</{name}>").text(path)
    begin = F.regexp_instr("value", F.lit(f"<{re.escape(name)}[\\s>]"))
    held = rows.select(begin.alias("at"), "value").where("at > 0")
    xml = F.concat(F.col("value").substr(F.col("at"), F.length("value")), F.lit(f"</{name}>"))
    return held.select(F.monotonically_increasing_id().alias("rec_id"), xml.alias("xml"))


def token_table(texts: DataFrame, rec_id: str = "rec_id", text: str = "xml") -> DataFrame:
    """(rec_id, ord, kind, value) of every token."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(r, i, k, v) for r, t in zip(pdf["rec_id"], pdf["xml"], strict=True) if t is not None for i, (k, v, _) in enumerate(tokens(t))]
            yield pd.DataFrame(rows, columns=["rec_id", "ord", "kind", "value"])

    return texts.select(F.col(rec_id).cast("long").alias("rec_id"), F.col(text).alias("xml")).mapInPandas(run, "rec_id long, ord int, kind string, value string")


def problems(text: str) -> list[tuple[int, str]]:
    """(line, message) of end tags without a start and elements that are never closed."""
    out, open_ = [], []
    for m in TOKEN.finditer(text):
        line = text.count("\n", 0, m.start()) + 1
        if m["start"] and not m["self"]:
            open_.append((m["start"], line))
        elif m["end"]:
            if open_ and open_[-1][0] == m["end"]:
                open_.pop()
            elif any(n == m["end"] for n, _ in open_):
                while open_[-1][0] != m["end"]:
                    n, at = open_.pop()
                    out.append((at, f"<{n}> is not closed"))
                open_.pop()
            else:
                out.append((line, f"</{m['end']}> has no start"))
    return out + [(at, f"<{n}> is not closed") for n, at in open_]


def verify(texts: DataFrame, rec_id: str = "rec_id", text: str = "xml") -> DataFrame:
    """(rec_id, line, message) of nesting errors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(r, *p) for r, t in zip(pdf["rec_id"], pdf["xml"], strict=True) if t is not None for p in problems(t)]
            yield pd.DataFrame(rows, columns=["rec_id", "line", "message"])

    return texts.select(F.col(rec_id).cast("long").alias("rec_id"), F.col(text).alias("xml")).mapInPandas(run, "rec_id long, line int, message string")
