"""Markup rewritten: printed in a style, or edited inside one object. A record is rewritten in
its own task, from its tokens."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FOLD_FROM, FOLD_MORE, FOLD_TO, GREEK
from ..sources.markup import TOKEN, VOID, tree_of
from .program import as_markup

STYLES = {"compact": 1, "flush": 2, "indent": 4, "expand": 5}
ACTIONS = ("retain", "remove", "encode", "decode", "shrink", "expand", "accent")
TARGETS = ("content", "cdata", "comment", "object", "attributes", "container")
_FOLDS = str.maketrans({**dict(zip(FOLD_FROM, FOLD_TO, strict=True)), **FOLD_MORE, **GREEK})


def _rewritten(df: DataFrame, rec_id: str, text: str, f) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if t is None else f(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["rec_id", "xml"])

    return df.select(F.col(rec_id).cast("long").alias("rec_id"), F.col(text).alias("xml")).mapInArrow(run, "rec_id long, xml string")


def formatted(records: DataFrame, style: str = "indent", declaration: str = "", doctype: str = "", rec_id: str = "rec_id", text: str = "xml", html_void: bool = False) -> DataFrame:
    """(rec_id, xml): records in one line (compact), a line for each tag (flush), indented, or
    with a line for each attribute too (expand), after a declaration and a document type if
    given. Comments and declarations of the source go; elements with nothing in them go."""
    n, void = STYLES[style], VOID if html_void else frozenset()
    head = "".join(f"{x}\n" for x in (declaration, doctype) if x)

    def one(t: str) -> str:
        tree = tree_of(t, void)
        return head + "".join(as_markup(tree, i, n) for i, d in enumerate(tree.depths) if not d)

    return _rewritten(records, rec_id, text, one)


def edited(text: str, name: str, action: str, target: str) -> str:
    """Tokens, one a line, with an action on a target inside objects of a name: content, CDATA
    or comments encoded, decoded, squeezed, without accents, removed or (content) one word an
    element; the object removed; its tags alone removed; or attributes removed, those of all
    elements. CDATA and comments stay only where an action on them keeps them."""
    change = {
        "retain": lambda x: x,
        "encode": lambda x: html.escape(x, quote=False).replace('"', "&#34;").replace("'", "&#39;"),
        "decode": html.unescape,
        "shrink": lambda x: re.sub(" +", " ", x),
        "accent": lambda x: x.translate(_FOLDS),
    }
    out: list[str] = []
    inside, last = False, ""
    gone = lambda: inside and target == "object" and action == "remove"
    bare = target == "container" and action == "remove"
    for m in TOKEN.finditer(text):
        if m["start"]:
            last = m["start"]
            own = m["start"] == name
            if own and not m["self"]:
                inside = True
            if gone() or bare and own and not m["self"]:
                continue
            attrs = "" if target == "attributes" and action == "remove" else re.sub(" +", " ", m["attrs"].strip())
            out.append(f"<{m['start']}{' ' + attrs if attrs else ''}{'/' if m['self'] else ''}>")
        elif m["end"]:
            hidden = gone() or bare and m["end"] == name
            if m["end"] == name:
                inside = False
            if not hidden:
                out.append(f"</{m['end']}>")
        elif m["text"] is not None:
            value = m["text"]
            if gone() or not value.strip():
                continue
            if inside and target == "content":
                if action == "remove":
                    continue
                if action == "expand":
                    words = [w for w in re.split(r"\||,", value) if w] if re.search(r"[|,]", value) and "|" not in value else [w for w in value.split("|") if w] if "|" in value else value.split()
                    words = [w for w in (re.sub(r"(?<=.)[.,:;]+$", "", w).strip() for w in words) if w]
                    out += [x for i, w in enumerate(words) for x in ([f"</{last}>", f"<{last}>"] if i else []) + [w]]
                    continue
                value = change[action](value)
            out.append(value.strip())
        else:
            kind = "cdata" if m["cdata"] is not None else "comment" if m["comment"] is not None else ""
            if kind and inside and target == kind and action in change:
                out.append(change[action](m[kind]).strip())
    return "".join(f"{x}\n" for x in out)


def filtered(records: DataFrame, name: str, action: str, target: str, rec_id: str = "rec_id", text: str = "xml") -> DataFrame:
    """(rec_id, xml): records with one kind of thing inside one object edited, see `edited`."""
    if action not in ACTIONS or target not in TARGETS:
        raise ValueError(f"no such edit: {action} {target}")
    return _rewritten(records, rec_id, text, lambda t: edited(t, name, action, target))


def pretty_json(x: Column) -> Column:
    """JSON with a line for each value, two spaces a level; what isn't JSON gives null."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(v: str | None) -> str | None:
            try:
                return None if v is None else json.dumps(json.loads(v), indent=2, ensure_ascii=False)
            except ValueError:
                return None

        for s in parts:
            yield s.map(one)

    return run(x)


def fasta_record(name: Column, title: Column, sequence: Column, width: int = 70) -> Column:
    """'>name title' and the sequence in lines of `width`."""
    lines = F.regexp_replace(sequence, "(.{%d})(?=.)" % width, "$1\n")
    return F.concat(F.lit(">"), name, F.when(title != "", F.concat(F.lit(" "), title)).otherwise(F.lit("")), F.lit("\n"), lines, F.lit("\n"))


def without_inline_markup(x: Column) -> Column:
    """Contents without the tags of inline text style, encoded ones included."""
    style = "(?i)</?(b|i|u|em|strong|sub|sup|mml:[a-z]+|math)( [^<>]*)?/?>"
    return F.regexp_replace(F.regexp_replace(x, "(?i)&lt;(/?(?:b|i|u|em|strong|sub|sup))&gt;", "<$1>"), style, "")
