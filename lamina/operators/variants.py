"""Sequence variants: parsing, ordering and the pipeline from names to products."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import THREE, edit

ONE = {n: k for k, n in THREE.items()}
CLASSES = {"g": "Genomic", "c": "Coding", "p": "Protein"}
VARIANT = "id string, class string, type string, accession string, version int, position long, deleted string, inserted string"
NUCLEIC = re.compile(r"^([A-Z]{1,3}_?\d+)(?:\.(\d+))?:([gc])\.(\d+)([ACGT])>([ACGT])$")
LONGER = re.compile(r"^([A-Z]{1,3}_?\d+)(?:\.(\d+))?:([gc])\.(\d+)(?:_(\d+))?(?:del([ACGT]*)(?:ins([ACGT]+))?|ins([ACGT]+)|dup([ACGT]*))$")
PROTEIN = re.compile(r"^([A-Z]{1,3}_?\d+)(?:\.(\d+))?:p\.\(?([A-Z][a-z]{2})(\d+)([A-Z][a-z]{2}|=)\)?$")


def parse(text: str) -> dict | None:
    """A substitution in g., c. or p. notation, or a deletion, insertion, duplication or both
    in g. or c. notation with all letters named, positions from 0; other kinds, and names that
    leave deleted or duplicated letters out, give nothing."""
    text = text.strip()
    if m := LONGER.match(text):
        acc, version, kind, first, last, gone, by, added, again = m.groups()
        low, high = int(first), int(last or first)
        head = {"class": CLASSES[kind], "accession": acc, "version": int(version or 0)}
        if added:
            # between two neighbours
            return {**head, "type": "Insertion", "position": low, "deleted": "", "inserted": added} if high == low + 1 else None
        letters = again if gone is None else gone
        if len(letters) != high - low + 1:
            return None
        if gone is None:
            return {**head, "type": "Duplication", "position": high, "deleted": "", "inserted": letters}
        return {**head, "type": "Indel" if by else "Deletion", "position": low - 1, "deleted": letters, "inserted": by or ""}
    if m := NUCLEIC.match(text):
        acc, version, kind, at, old, new = m.groups()
    elif m := PROTEIN.match(text):
        acc, version, old, at, new = m.groups()
        kind, old = "p", ONE.get(m[3])
        new = old if m[5] == "=" else ONE.get(m[5])
        if old is None or new is None:
            return None
    else:
        return None
    return {"class": CLASSES[kind], "type": "Synonymous" if old == new else "Substitution", "accession": acc, "version": int(version or 0), "position": int(at) - 1, "deleted": old, "inserted": new}


def variants(df: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """A row for each substitution in comma-separated names."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [{"id": i, **v} for i, t in zip(pdf["id"], pdf["text"], strict=True) if t is not None for x in t.split(",") if (v := parse(x))]
            yield pd.DataFrame(rows, columns=["id", "class", "type", "accession", "version", "position", "deleted", "inserted"])

    return df.select(F.col(id_).cast("string").alias("id"), F.col(text).alias("text")).mapInPandas(run, VARIANT)


def newest(v: DataFrame) -> DataFrame:
    """Of each accession the newest version; predicted ones (XM_, XP_) only where an id has
    no curated one (NM_, NP_)."""
    w = Window.partitionBy("id", "accession")
    out = v.distinct().withColumn("_last", F.max("version").over(w)).where("version = _last").drop("_last")
    has = lambda p: F.max(F.col("accession").startswith(p).cast("int")).over(Window.partitionBy("id"))
    out = out.withColumn("_nm", has("NM_")).withColumn("_np", has("NP_"))
    hidden = (F.col("accession").startswith("XM_") & (F.col("_nm") == 1)) | (F.col("accession").startswith("XP_") & (F.col("_np") == 1))
    return out.where(~hidden).drop("_nm", "_np")


def spdi(v: DataFrame) -> DataFrame:
    """(id, spdi): accession.version:position:deleted:inserted."""
    name = F.concat("accession", F.when(F.col("version") > 0, F.concat(F.lit("."), F.col("version").cast("string"))).otherwise(F.lit("")))
    return v.select("id", F.concat_ws(":", name, F.col("position").cast("string"), "deleted", "inserted").alias("spdi"))


def parse_spdi(x: Column) -> Column:
    p = F.split(x, ":", -1)
    return F.when(F.size(p) == 4, F.struct(p[0].alias("accession"), p[1].try_cast("long").alias("position"), p[2].alias("deleted"), p[3].alias("inserted")))


def with_offset(v: DataFrame, offsets: DataFrame) -> DataFrame:
    """Coding positions moved by their record's offset (accession, offset); others stay."""
    o = offsets.select(F.col("accession").alias("_a"), F.col("offset").alias("_o"))
    joined = v.join(o, (F.col("accession") == F.col("_a")) & (F.col("class") == "Coding"), "left")
    return joined.withColumn("position", F.col("position") + F.coalesce("_o", F.lit(0))).drop("_a", "_o")


def products(v: DataFrame, sequences: DataFrame) -> DataFrame:
    """(id, accession, position, sequence): the edited sequence of each variant of
    sequences (accession, sequence); those whose deleted letters aren't there drop."""
    joined = v.join(sequences, "accession")
    out = joined.withColumn("sequence", edit(F.col("sequence"), F.col("position"), F.col("deleted"), F.col("inserted")))
    return out.where(F.col("sequence").isNotNull()).select("id", "accession", "position", "sequence")
