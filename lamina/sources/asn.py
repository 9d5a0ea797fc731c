"""Text ASN.1 to markup: named fields become elements, what has no name gets the name of
its holder with _E."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .converters import _escape, tag

TOKEN = re.compile(r"--.*?(?:--|$)|\"((?:[^\"]|\"\")*)\"|'([0-9A-Fa-f\s]*)'[BH]|(::=)|([{},])|([^\s{},\"']+)", re.M)


def tokens(text: str) -> list[tuple[str, str]]:
    out = []
    for m in TOKEN.finditer(text):
        if m[1] is not None:
            out.append(("value", re.sub(r"\s*\n\s*", "", m[1].replace('""', '"'))))
        elif m[2] is not None:
            out.append(("value", re.sub(r"\s", "", m[2])))
        elif m[3] or m[4]:
            out.append((m[3] or m[4], ""))
        elif m[5]:
            out.append(("word", m[5]))
    return out


def to_xml(text: str) -> list[str]:
    """Markup of each 'Name ::= { ... }' of a text; one that never ends gives what it holds."""
    parts, at, out = tokens(text), 0, []

    def members(name: str) -> str:
        nonlocal at
        got = []
        while at < len(parts) and parts[at][0] != "}":
            if parts[at][0] == ",":
                at += 1
                continue
            words = []
            while at < len(parts) and parts[at][0] == "word":
                words.append(parts[at][1])
                at += 1
            kind, value = parts[at] if at < len(parts) else ("}", "")
            if kind == "{":
                at += 1
                label = words[0] if words else name + "_E"
                inner = members(words[-1] if words else name)
                for w in reversed(words[1:]):
                    inner = f"<{tag(w)}>{inner}</{tag(w)}>"
                got.append(f"<{tag(label)}>{inner}</{tag(label)}>")
            elif kind == "value":
                at += 1
                got.append(_leaf(words or [name + "_E"], value))
            elif len(words) > 1:
                got.append(_leaf(words[:-1], words[-1]))
            elif words:
                got.append(_leaf([name + "_E"], words[0]))
        at += 1
        return "".join(got)

    while at < len(parts):
        if parts[at][0] == "word" and at + 2 < len(parts) and parts[at + 1][0] == "::=" and parts[at + 2][0] == "{":
            name = parts[at][1]
            at += 3
            out.append(f"<{tag(name)}>{members(name)}</{tag(name)}>")
        else:
            at += 1
    return out


def _leaf(names: list[str], value: str) -> str:
    body = _escape(value)
    for n in reversed(names):
        body = f"<{tag(n)}>{body}</{tag(n)}>"
    return body


def asn_records(df: DataFrame, text: str = "value") -> DataFrame:
    """(rec_id, xml) of each value in each row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"xml": [x for t in pdf["t"] if t is not None for x in to_xml(t)]}, columns=["xml"], dtype=object)

    return df.select(F.col(text).alias("t")).mapInPandas(run, "xml string").select(F.monotonically_increasing_id().alias("rec_id"), "xml")
