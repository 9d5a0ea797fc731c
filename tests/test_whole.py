"""Queries over a whole corpus leave no document and no term out."""

from collections import Counter
from math import log

import pytest

from lamina import catalog

TEXTS = {1: "the onthe edly of", 2: "the the cat", 3: "of 7 cats, the cat", 4: "", 5: " ".join(f"w{i}" for i in range(300))}
#: Item 1 is in document 5, of well over 400 characters; item 2 is in a short one.
ITEMS = {1: " ".join(f"w{i}" for i in range(40)), 2: "the cat sat"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(ITEMS.items()), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def terms(text):
    return text.replace(",", " ").split()


def found(spark, folder, name):
    rows = [tuple(r) for r in catalog.queries()[name](spark, folder).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_jaccard_match(spark, folder):
    want = set()
    for i, a in ITEMS.items():
        for d, b in TEXTS.items():
            x, y = set(terms(a)), set(terms(b))
            score = len(x & y) * 100 // len(x | y)
            if score >= 10:
                want.add((i, d, score))
    assert (1, 5, 13) in want and len(TEXTS[5]) > 400
    assert found(spark, folder, "jaccard_match") == want


def test_tf_idf(spark, folder):
    df = Counter(t for x in TEXTS.values() for t in set(terms(x)))
    want = {(d, t, n, round(n * log(len(TEXTS) / df[t]), 6)) for d, x in TEXTS.items() for t, n in Counter(terms(x)).items()}
    assert found(spark, folder, "tf_idf") == want


def test_postings_build(spark, folder):
    df = Counter(t for x in TEXTS.values() for t in set(terms(x)))
    want = {("TEXT", t, df[t], d, ",".join(str(i) for i, w in enumerate(terms(x)) if w == t)) for d, x in TEXTS.items() for t in terms(x)}
    assert found(spark, folder, "postings_build") == want
