"""Text normalisation, word commands and the Porter2 stemmer."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = tuple(
    "a about again all almost also although always among an and another any are as at be because been before being between both but by "
    "can could did do does done due during each either enough especially etc for found from further had has have having here how however "
    "i if in into is it its itself just kg km made mainly make may mg might ml mm most mostly must nearly neither no nor not obtained of often "
    "on or our overall perhaps pmid quite rather really regarding seem seen several should show showed shown shows significantly since so some such "
    "than that the their theirs them then there therefore these they this those through thus to upon use used using various very was we were what when "
    "which while with within without would".split()
)
BREAK = r"[^\p{L}\p{Nd}]+"


def given(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x evaluated once, however often it is used. Outside generated code Spark
    evaluates an expression anew for each mention, and a mention within a lambda anew for each
    element."""
    return F.get(F.transform(F.array(x), lambda v: use(v)), F.lit(0))


def stop(w: Column) -> Column:
    return w.isin(*STOP_WORDS)


def words(x: Column, keep_stops: bool = False) -> Column:
    """Lower-case runs of letters and digits, without stop words."""
    w = F.filter(F.split(F.lower(x), BREAK), lambda w: w != "")
    return w if keep_stops else F.filter(w, lambda w: ~stop(w))


def pairs(x: Column) -> Column:
    """Neighbouring informative words; a stop word or punctuation breaks the chain."""
    runs = F.split(F.regexp_replace(F.lower(x), r"[^\p{L}\p{Nd}\s-]", "|"), r"\|")
    marked = F.flatten(F.transform(runs, lambda r: F.concat(F.filter(F.split(r, BREAK), lambda w: w != ""), F.array(F.lit("")))))
    w = F.transform(marked, lambda w: F.when(stop(w), "").otherwise(w))
    both = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.when((a != "") & (F.coalesce(b, F.lit("")) != ""), F.concat_ws(" ", a, b)))
    return F.filter(both, lambda p: p.isNotNull())


def pairs_and_singles(x: Column) -> Column:
    """Neighbouring informative words as `pairs`, and informative words that stand alone
    between stop words, punctuation and the ends."""
    runs = F.split(F.regexp_replace(F.lower(x), r"[^\p{L}\p{Nd}\s-]", "|"), r"\|")
    marked = F.flatten(F.transform(runs, lambda r: F.concat(F.filter(F.split(r, BREAK), lambda w: w != ""), F.array(F.lit("")))))
    w = F.concat(F.array(F.lit("")), F.transform(marked, lambda w: F.when(stop(w), "").otherwise(w)), F.array(F.lit("")))
    spans = F.zip_with(F.zip_with(w, F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.slice(w, F.lit(3), F.size(w) - 2), lambda p, c: F.struct(p["a"].alias("a"), p["b"].alias("b"), c.alias("c")))
    one = F.transform(F.filter(spans, lambda s: (s["a"] == "") & (s["b"] != "") & (s["c"] == "")), lambda s: s["b"])
    return F.concat(pairs(x), one)


def reversed_words(x: Column) -> Column:
    return F.reverse(words(x))


def letters(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def clauses(x: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(x), "[.,;:]"), lambda c: F.trim(c)), lambda c: c != "")


def terms(x: Column) -> Column:
    """Parts between white space, without a trailing run of . , : ;"""
    return F.filter(F.transform(F.split(x, r"\s+"), lambda w: F.regexp_replace(w, r"(?<=.)[.,:;]+$", "")), lambda w: w != "")


def word_count(x: Column, keep_stops: bool = False) -> Column:
    return F.size(words(x, keep_stops))


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def unescape(x: Column) -> Column:
    for coded, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#34;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(coded), F.lit(plain))
    return x


def strip_markup(x: Column) -> Column:
    return squeeze(F.regexp_replace(x, r"</?[A-Za-z][^<>]*>", " "))


#: Characters that fold to one ASCII letter, and those that fold to more.
FOLD_FROM = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖØòóôõöøÙÚÛÜùúûüÝýÿŠšŽžŁłĐđĆćČčĞğİıŞş"
FOLD_TO = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOOooooooUUUUuuuuYyySsZzLlDdCcCcGgIiSs"
FOLD_MORE = {"ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "TH", "þ": "th"}
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu", "ν": "nu", "ξ": "xi", "ο": "omicron", "π": "pi", "ρ": "rho", "σ": "sigma", "τ": "tau", "υ": "upsilon", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega"}


def fold(x: Column, greek: bool = False) -> Column:
    """Accents off; with greek, Greek letters spelled out. Only values that aren't ASCII pay."""
    y = F.translate(x, FOLD_FROM, FOLD_TO)
    for a, b in (FOLD_MORE | (GREEK if greek else {})).items():
        y = F.replace(y, F.lit(a), F.lit(b))
    return F.when(x.rlike(r"[^\x00-\x7F]"), y).otherwise(x)


def basic(x: Column) -> Column:
    """Super- and subscript digits repaired, white space squeezed."""
    return squeeze(F.translate(x, "⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉", "01234567890123456789"))


def plain(x: Column) -> Column:
    return fold(strip_markup(basic(x)))


def simple(x: Column) -> Column:
    return fold(basic(x), greek=True)


def author(x: Column) -> Column:
    return F.replace(F.replace(fold(x), F.lit("&#39;"), F.lit("'")), F.lit("' "), F.lit("'"))


def prose(x: Column) -> Column:
    return fold(strip_markup(basic(unescape(x))), greek=True)


def relax(x: Column) -> Column:
    """ASCII words of letters and digits, one space between. The pattern is [^A-Za-z0-9]+, which
    is slower by a factor of ten where tasks share a JVM: they contend for the type checks of
    a class of several ranges."""
    return F.trim(F.regexp_replace(x, r"[\W_]+", " "))


def encode_url(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def decode_url(x: Column) -> Column:
    return F.try_url_decode(x)


def encode64(x: Column) -> Column:
    return F.regexp_replace(F.base64(F.encode(x, "UTF-8")), "\r?\n", "")


def decode64(x: Column) -> Column:
    return F.try_to_binary(x, F.lit("base64")).cast("string")


# -- Porter2 (English) stemmer, from the published algorithm --------------------------------

_VOWEL = "aeiouy"
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    m = re.match("gener|commun|arsen", w) or re.search("[aeiouy][^aeiouy]", w)
    r1 = m.end() if m else len(w)
    m = re.search("[aeiouy][^aeiouy]", w[r1:])
    return r1, r1 + m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search("[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch("[aeiouy][^aeiouy]", w))


def stem(word: str) -> str:
    """The Porter2 stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    if word in _SAME:
        return word
    w = word.lstrip("'")
    w = re.sub("(^|[aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)
    w = re.sub("('s'|'s|')$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # 1b
    if w.endswith(("eedly", "eed")):
        n = 5 if w.endswith("eedly") else 3
        if len(w) - n >= r1:
            w = w[:-n] + "ee"
    else:
        m = re.search("(ingly|edly|ing|ed)$", w)
        if m and re.search("[aeiouy]", w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif _short_end(w) and r1 >= len(w):
                w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    # 2
    for suffix, by in _STEP2:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + by
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] and w[-3] in "cdeghkmnrt":
            w = w[:-2]
    # 3
    for suffix, by in _STEP3:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + by
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    # 4
    for suffix in _STEP4:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r2:
                w = w[: -len(suffix)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])) or w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.replace("Y", "y")


def stemmed(x: Column) -> Column:
    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = lru_cache(maxsize=200_000)(stem)
        for s in parts:
            yield s.map(lambda w: None if w is None else known(w))

    return run(x)
