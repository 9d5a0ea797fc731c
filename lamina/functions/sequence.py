"""Nucleotide and protein sequences, and edits of them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Complements of the IUPAC letters, either case.
BASES = "ACGTUMRWSYKVHDBN-*"
COMPLEMENTS = "TGCAAKYWSRMBDHVN-*"
MEANS = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT"}
#: Residues in the order TCAG by codon, of the standard code and of some others by number.
CODES = {
    1: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    2: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG",
    4: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    5: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG",
    11: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
}
STARTS = {1: {"TTG", "CTG", "ATG"}, 2: {"ATT", "ATC", "ATA", "ATG", "GTG"}, 4: {"TTA", "TTG", "CTG", "ATT", "ATC", "ATA", "ATG", "GTG"}, 5: {"TTG", "ATT", "ATC", "ATA", "ATG", "GTG"}, 11: {"TTG", "CTG", "ATT", "ATC", "ATA", "ATG", "GTG"}}
#: Average residue weights; a chain has one water besides.
WEIGHTS = {"A": 71.0788, "R": 156.1875, "N": 114.1038, "D": 115.0886, "C": 103.1388, "E": 129.1155, "Q": 128.1307, "G": 57.0519, "H": 137.1411, "I": 113.1594, "L": 113.1594, "K": 128.1741, "M": 131.1926, "F": 147.1766, "P": 97.1167, "S": 87.0782, "T": 101.1051, "W": 186.2132, "Y": 163.1760, "V": 99.1326, "U": 150.0388, "O": 237.3018}
WATER = 18.01528
THREE = {"A": "Ala", "R": "Arg", "N": "Asn", "D": "Asp", "C": "Cys", "E": "Glu", "Q": "Gln", "G": "Gly", "H": "His", "I": "Ile", "L": "Leu", "K": "Lys", "M": "Met", "F": "Phe", "P": "Pro", "S": "Ser", "T": "Thr", "W": "Trp", "Y": "Tyr", "V": "Val", "U": "Sec", "O": "Pyl", "B": "Asx", "Z": "Glx", "J": "Xle", "X": "Xxx", "*": "Ter"}


def revcomp(x: Column) -> Column:
    """Reverse complement, case kept; unknown letters become X."""
    known = BASES + BASES.lower()
    clean = F.regexp_replace(x, f"[^{known.replace('-', '')}-]", "X")
    return F.reverse(F.translate(clean, known, COMPLEMENTS + COMPLEMENTS.lower()))


def nucleic(x: Column, low: Column, high: Column) -> Column:
    """Part low..high in upper case; from > to is the reverse complement."""
    a, b = F.least(low, high).cast("int"), F.greatest(low, high).cast("int")
    part = F.when((a >= 1) & (b <= F.length(x)), F.upper(x.substr(a, b - a + 1)))
    return F.when(low <= high, part).otherwise(revcomp(part))


def fasta(x: Column, width: int = 70) -> Column:
    """Upper-case blocks of a sequence."""
    blocks = F.sequence(F.lit(0), F.floor((F.length(x) - 1) / width).cast("int"))
    return F.when(F.length(x) > 0, F.transform(blocks, lambda i: F.upper(x.substr(i * width + 1, F.lit(width)))))


def unpack(x: Column, bits: int) -> Column:
    """Letters of packed hex bytes: four bases (2 bits each) or two (4 bits each) a byte."""
    digits = "0123456789ABCDEF"
    if bits == 2:
        letters = {d: "ACGT"[i >> 2] + "ACGT"[i & 3] for i, d in enumerate(digits)}
    else:
        letters = dict(zip(digits, "-ACMGRSVTWYHKDBN", strict=True))
    table = F.create_map(*(F.lit(v) for kv in letters.items() for v in kv))
    return F.array_join(F.transform(F.filter(F.split(F.upper(x), ""), lambda c: c != ""), lambda c: F.try_element_at(table, c)), "")


def molecular_weight(x: Column, cleave: bool = True) -> Column:
    """Weight of a peptide, rounded half up; a leading M is cleaved."""
    p = F.upper(F.regexp_replace(x, r"[^A-Za-z]", ""))
    p = F.when(F.lit(cleave) & p.startswith("M") & (F.length(p) > 1), p.substr(F.lit(2), F.length(p))).otherwise(p)
    table = F.create_map(*(F.lit(v) for kv in WEIGHTS.items() for v in kv))
    add = lambda s, c: s + F.coalesce(F.try_element_at(table, c), F.lit(0.0))
    return F.when(F.length(p) > 0, F.floor(F.aggregate(F.split(p, ""), F.lit(WATER), add) + 0.5))


def residue(codon: str, code: int = 1) -> str:
    """The residue that all readings of a codon agree on; B, Z and J for known pairs, else X."""
    table = CODES[code]
    got = {table["TCAG".index(a) * 16 + "TCAG".index(b) * 4 + "TCAG".index(c)] for a, b, c in product(*(MEANS.get(x, "ACGT") for x in codon))}
    if len(got) == 1:
        return got.pop()
    return {frozenset("DN"): "B", frozenset("EQ"): "Z", frozenset("IL"): "J"}.get(frozenset(got), "X")


def translate_cds(seq: str, code: int = 1, frame: int = 0, keep_stop: bool = False, every: bool = False, trim: bool = False, part5: bool = False, part3: bool = False, between: str = "") -> str:
    """Protein of a coding region. At a complete 5' end (not part5) an alternative start codon
    gives M; a last codon that lacks bases counts with N. Translation ends at the first stop,
    which is kept if so wanted; `every` reads on through stops. A partial last codon whose
    readings can end a protein is a stop if the stop is kept and the 3' end is complete (not
    part3). trim takes X and stops off the end. between stands between residues."""
    s = seq.upper().replace("U", "T")[frame:]
    out = []
    for i in range(0, len(s), 3):
        c = s[i : i + 3]
        full = c + "N" * (3 - len(c))
        start = i == 0 and frame == 0 and not part5 and full in STARTS[code]
        r = "M" if start else residue(full, code)
        if len(c) < 3 and r == "X":
            continue
        if len(c) < 3 and keep_stop and not part3 and r != "*" and any(residue(c + a + b, code) == "*" for a in "TCAG" for b in ("TCAG" if len(c) == 1 else [""])):
            r = "*"
        out.append(r)
    p = between.join(out)
    if not every and "*" in p:
        p = p[: p.index("*") + bool(keep_stop)]
    while trim and p.endswith(("X", "*")):
        p = p.rstrip("*").rstrip("X")
    return p


def cds_to_protein(x: Column, code: int = 1, frame: int = 0, keep_stop: bool = False, every: bool = False, trim: bool = False, part5: bool = False, part3: bool = False, between: str = "") -> Column:
    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda v: None if v is None else translate_cds(v, code, frame, keep_stop, every, trim, part5, part3, between))

    return run(x)


def codon_report(nucleotides: str, protein: str, frame: int = 0, three: bool = False) -> str:
    """Fifteen codons a line with the number of codons so far, residues below them."""
    s = nucleotides[frame:]
    if len(s) < 3:
        return ""
    codons = [s[i : i + 3].ljust(3, "N") for i in range(0, len(s), 3)]
    out, done, at = [], 0, 0
    while done < len(codons) or at < len(protein):
        line = codons[done : done + 15]
        done += len(line)
        residues = [THREE.get(r, r) if three else f" {r} " for r in protein[at : at + 15]]
        at += 15
        out.append("".join(f"{c} " for c in line) + "    " * (15 - len(line)) + f"{done:6d}\n" + "".join(f"{r} " for r in residues) + "\n\n")
    return "".join(out)


def codons(nucleotides: Column, protein: Column, frame: int = 0, three: bool = False) -> Column:
    @F.pandas_udf("string")
    def run(n: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else codon_report(a, b, frame, three) for a, b in zip(n, p, strict=True)])

    return run(nucleotides, protein)


def genetic_code(code: int = 1) -> list[tuple[str, str, bool]]:
    """(codon, residue, whether it starts) of a genetic code."""
    return [("".join(c), CODES[code][i], "".join(c) in STARTS[code]) for i, c in enumerate(product("TCAG", repeat=3))]


def plain_translation(x: Column, code: int = 1) -> Column:
    """Translation of unambiguous sequences without Python: a map of 64 codons."""
    table = F.create_map(*(F.lit(v) for i, c in enumerate(product("TCAG", repeat=3)) for v in ("".join(c), CODES[code][i])))
    steps = F.sequence(F.lit(0), F.floor(F.length(x) / 3).cast("int") - 1)
    return F.when(F.length(x) >= 3, F.array_join(F.transform(steps, lambda i: F.coalesce(F.try_element_at(table, F.upper(x).substr(i * 3 + 1, F.lit(3))), F.lit("X"))), ""))


def three_letters(x: Column) -> Column:
    table = F.create_map(*(F.lit(v) for kv in THREE.items() for v in kv))
    return F.array_join(F.transform(F.split(F.upper(x), ""), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("Xxx"))), "")


def one_letter(x: Column) -> Column:
    table = F.create_map(*(F.lit(v) for k, n in THREE.items() for v in (n.lower(), k)))
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(x), F.lit("([a-z]{3})"), F.lit(1)), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), "")


def remove_ends(x: Column, first: int = 0, last: int = 0) -> Column:
    n = F.length(x)
    return F.when(n >= first + last, x.substr(F.lit(first + 1), n - first - last)).otherwise("")


def retain(x: Column, leading: int | None = None, trailing: int | None = None) -> Column:
    return F.left(x, F.lit(leading)) if leading is not None else F.right(x, F.lit(trailing))


def edit(x: Column, offset: Column, delete: Column, insert: Column) -> Column:
    """Replaces `delete` at a 0-based offset by `insert`; NULL unless `delete` is there. At
    the end plus one only insertion is possible."""
    at, n = offset.cast("int"), F.length(delete)
    there = (at >= 0) & (at + n <= F.length(x)) & (F.upper(x.substr(at + 1, n)) == F.upper(delete))
    return F.when(there, F.concat(x.substr(F.lit(1), at), insert, x.substr(at + n + 1, F.length(x))))


def extract(x: Column, location: Column) -> Column:
    """Intervals 'a..b,c..d' end to end; from > to is reverse complemented, equal bounds
    give nothing."""

    def one(p: Column) -> Column:
        a, b = F.regexp_extract(p, r"^(\d+)", 1).try_cast("int"), F.regexp_extract(p, r"(\d+)$", 1).try_cast("int")
        return F.when(a == b, F.lit("")).otherwise(nucleic(x, a, b))

    return F.array_join(F.transform(F.split(location, ","), one), "")


def disambiguate(x: Column) -> Column:
    """All plain sequences that an ambiguous one stands for."""
    table = F.create_map(*(v for k, m in MEANS.items() for v in (F.lit(k), F.array(*(F.lit(c) for c in m)))))
    letters = F.filter(F.split(F.upper(x), ""), lambda c: c != "")
    grow = lambda s, c: F.flatten(F.transform(s, lambda p: F.transform(F.coalesce(F.try_element_at(table, c), F.array(c)), lambda q: F.concat(p, q))))
    return F.aggregate(letters, F.array(F.lit("")), grow)


def base_counts(x: Column) -> Column:
    """(letter, count) of a sequence, by letter."""
    letters = F.filter(F.split(F.upper(x), ""), lambda c: c != "")
    return F.transform(F.array_sort(F.array_distinct(letters)), lambda c: F.struct(c.alias("letter"), F.size(F.filter(letters, lambda y: y == c)).alias("count")))


def differences(a: Column, b: Column) -> Column:
    """Second sequence along the first: lower case where equal, upper where not, - past an end."""
    split = lambda x: F.filter(F.split(F.lower(x), ""), lambda c: c != "")
    return F.array_join(F.zip_with(split(a), split(b), lambda p, q: F.when(p.eqNullSafe(q), q).otherwise(F.upper(F.coalesce(q, F.lit("-"))))), "")
