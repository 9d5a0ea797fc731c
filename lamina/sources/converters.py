"""JSON, delimited tables, FASTA and flatfiles as DataFrames or markup, and writers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squeeze


def escape(x: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(plain), F.lit(coded))
    return x


def _escape(x: str) -> str:
    return x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


# -- JSON ---------------------------------------------------------------------------------


def tag(name: str) -> str:
    name = re.sub(r"[^\w.:-]", "_", name)
    return name if re.match(r"[A-Za-z_]", name) else "_" + name


def json_to_xml(value: object, name: str, nest: str = "flat") -> str:
    """Markup of a JSON value. Arrays repeat their name (flat), or have a member in an
    element of the same name (recurse), the singular (singular) or 'name_E' (element)."""
    t = tag(name)
    if isinstance(value, dict):
        return f"<{t}>" + "".join(json_to_xml(v, k, nest) for k, v in value.items()) + f"</{t}>"
    if isinstance(value, list):
        inner = {"flat": name, "recurse": name, "element": name + "_E", "singular": name[:-1] if name.endswith("s") and len(name) > 1 else name}[nest]
        body = "".join(json_to_xml(v, inner, nest) for v in value)
        return body if nest == "flat" else f"<{t}>{body}</{t}>"
    text = {True: "true", False: "false", None: "null"}[value] if value is None or isinstance(value, bool) else str(value)
    return f"<{t}>{_escape(text)}</{t}>" if text else f"<{t}/>"


def json_documents(text: str) -> list[object]:
    """All documents of a text, one after the other; numbers stay as they are written. What
    follows a broken document is dropped."""
    decoder = json.JSONDecoder(parse_int=str, parse_float=str)
    at, out = 0, []
    while (m := re.compile(r"\S").search(text, at)) is not None:
        try:
            value, at = decoder.raw_decode(text, m.start())
        except ValueError:
            break
        out.append(value)
    return out


def json_records(df: DataFrame, text: str = "value", record: str = "Rec", nest: str = "flat") -> DataFrame:
    """(rec_id, xml) of each JSON document in each row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"xml": [json_to_xml(v, record, nest) for t in pdf["t"] if t is not None for v in json_documents(t)]}, columns=["xml"], dtype=object)

    return df.select(F.col(text).alias("t")).mapInPandas(run, "xml string").select(F.monotonically_increasing_id().alias("rec_id"), "xml")


# -- delimited tables -----------------------------------------------------------------------


def read_table(spark: SparkSession, path: str, columns: list[str], sep: str = "\t", skip: int = 0) -> DataFrame:
    """Lines cut at every separator, without quoting; lines of another width are dropped."""
    lines = spark.read.text(path).select(F.split("value", re.escape(sep), -1).alias("c"), F.monotonically_increasing_id().alias("o"))
    rows = lines.where(F.size("c") == len(columns))
    out = rows.select(*(F.col("c")[i].alias(n) for i, n in enumerate(columns)), F.col("o").alias("_o"))
    if skip:
        first = out.orderBy("_o").limit(skip).select(F.col("_o").alias("_skip"))
        out = out.join(F.broadcast(first), F.col("_o") == F.col("_skip"), "left_anti")  # skip rows
    return out.drop("_o")


def transform_table(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a two-column file; lines of other widths are dropped, and of a key's
    lines the last counts."""
    rows = spark.read.text(path).select(F.split("value", "\t", -1).alias("c"), F.monotonically_increasing_id().alias("o")).where(F.size("c") == 2)
    return rows.groupBy(F.col("c")[0].alias("key")).agg(F.max_by(F.col("c")[1], "o").alias("value"))


def to_records(df: DataFrame, record: str = "Rec") -> DataFrame:
    """(xml): a record of each row; a name that begins with * keeps its content as it is."""
    parts = []
    for c in df.columns:
        name, raw = tag(c.lstrip("*")), c.startswith("*")
        v = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        parts.append(F.concat(F.lit(f"<{name}>"), v if raw else escape(v), F.lit(f"</{name}>")))
    return df.select(F.concat(F.lit(f"<{record}>"), *parts, F.lit(f"</{record}>")).alias("xml"))


def wrapped(df: DataFrame, head: str, tail: str, column: str = "xml") -> DataFrame:
    """(ord, line): head, the rows, tail; nothing at all of an empty input."""
    body = df.select(F.lit(1).alias("ord"), F.col(column).alias("line"))
    one = df.limit(1)
    return one.select(F.lit(0).alias("ord"), F.lit(head).alias("line")).union(body).union(one.select(F.lit(2).alias("ord"), F.lit(tail).alias("line")))


def write_split(df: DataFrame, path: str, rows: int) -> None:
    """Text files of at most so many records."""
    df.select("xml").write.option("maxRecordsPerFile", rows).mode("overwrite").text(path)


# -- sequences ------------------------------------------------------------------------------


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, title, length, sequence); a record begins at a line that begins with >."""
    chunks = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    text = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract(text, r"^([^\n]*)", 1)
    sequence = F.regexp_replace(F.regexp_replace(text, r"^[^\n]*", ""), r"\s+", "")
    return chunks.select(F.regexp_extract(head, r"^(\S*)", 1).alias("seq_id"), F.trim(F.regexp_extract(head, r"^\S*\s*(.*)$", 1)).alias("title"), F.length(sequence).alias("length"), sequence.alias("sequence"))


def parse_location(text: str) -> list[tuple[int, int]]:
    """Intervals of a feature location; a complement reverses their order and ends. Parts in
    other records (accession:) are left out."""
    text = re.sub(r"\s", "", text)
    m = re.fullmatch(r"(join|order|complement)\((.*)\)", text)
    if not m:
        m = re.fullmatch(r"<?(\d+)(?:(?:\.\.|\^)>?(\d+))?", text)
        return [(int(m[1]), int(m[2] or m[1]))] if m else []
    parts, depth, begin = [], 0, 0
    for i, c in enumerate(m[2] + ","):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(m[2][begin:i])
            begin = i + 1
    spans = [s for p in parts for s in parse_location(p)]
    return [(b, a) for a, b in reversed(spans)] if m[1] == "complement" else spans


def parse_flatfile(text: str) -> dict | None:
    """Fields of one flatfile record: top keywords, features with qualifiers, sequence."""
    top, _, rest = text.partition("\nFEATURES")
    features_text, _, origin = rest.partition("\nORIGIN")
    fields: dict[str, str] = {}
    key = ""
    for line in top.split("\n"):
        if line[:12].strip():
            key = line[:12].strip()
            fields[key] = (fields[key] + " " if key in fields else "") + line[12:].strip()
        elif key:
            fields[key] += " " + line[12:].strip()
    if "LOCUS" not in fields:
        return None
    features: list[dict] = []
    target = ""
    for line in features_text.split("\n")[1:]:
        if line[5:21].strip():
            features.append({"key": line[5:21].strip(), "location": line[21:].strip(), "quals": []})
            target = "location"
        elif features and line[21:].startswith("/"):
            name, _, value = line[22:].partition("=")
            features[-1]["quals"].append([name.strip(), value.strip()])
            target = "qual"
        elif features and target == "location":
            features[-1]["location"] += line[21:].strip()
        elif features and features[-1]["quals"]:
            q = features[-1]["quals"][-1]
            q[1] += ("" if q[0] == "translation" else " ") + line[21:].strip()
    for f in features:
        f["intervals"] = [{"from": a, "to": b} for a, b in parse_location(f["location"])]
        f["quals"] = [{"name": n, "value": v.strip('"')} for n, v in f["quals"]]
    accession, _, version = fields.get("VERSION", fields.get("ACCESSION", "")).partition(" ")[0].partition(".")
    return {"locus": fields["LOCUS"].split()[0], "accession": accession, "version": version, "definition": fields.get("DEFINITION", "").rstrip("."), "organism": fields.get("ORGANISM", "").split("  ")[0], "features": features, "sequence": re.sub(r"[^A-Za-z]", "", origin.partition("\n")[2])}


FLAT = "locus string, accession string, version string, definition string, organism string, features array<struct<key:string,location:string,intervals:array<struct<from:int,to:int>>,quals:array<struct<name:string,value:string>>>>, sequence string"


def flatfile_records(df: DataFrame, text: str = "value") -> DataFrame:
    """Records of flatfile texts, cut at lines of //."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [r for t in pdf["t"] if t is not None for p in re.split(r"(?m)^//\s*$", t) if (r := parse_flatfile(p.strip("\n")))]
            yield pd.DataFrame(rows, columns=["locus", "accession", "version", "definition", "organism", "features", "sequence"])

    return df.select(F.col(text).alias("t")).mapInPandas(run, FLAT)


def read_flatfile(spark: SparkSession, path: str) -> DataFrame:
    return flatfile_records(spark.read.option("lineSep", "\n//").text(path).select(F.regexp_replace("value", r"^\n", "").alias("value")))


def feature_table(flat: DataFrame, key: str, qualifiers: list[str]) -> DataFrame:
    """A row for each feature of a key, with a column for each qualifier; '-' where missing."""
    f = flat.select("accession", F.posexplode("features").alias("n", "f")).where(F.col("f.key") == key)
    pick = lambda q: F.array_join(F.transform(F.filter(F.col("f.quals"), lambda x: x["name"] == q), lambda x: x["value"]), ";")
    return f.select("accession", "n", F.col("f.location").alias("location"), *(F.coalesce(F.nullif(pick(q), F.lit("")), F.lit("-")).alias(q) for q in qualifiers))


# -- identifiers ------------------------------------------------------------------------------


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(ord, uid): one identifier a line, version and space dropped."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.regexp_extract(squeeze(F.col("value")), r"^([^.\s]+)", 1).alias("uid")).where("uid <> ''")
