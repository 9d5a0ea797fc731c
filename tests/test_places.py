"""Places in a global order, on more rows than the sampling of ranges takes in."""

import random

from lamina import catalog
from lamina.operators import tables as B

N = 20000


def test_with_place(spark):
    keys = random.Random(1).sample(range(10 * N), N)
    df = spark.createDataFrame([(k, f"v{k}") for k in keys], "k long, v string")
    want = [(k, f"v{k}", i) for i, k in enumerate(sorted(keys))]
    assert sorted(map(tuple, B.with_place(df, "k").collect())) == want


def test_with_place_repeated_and_null(spark):
    keys = [None] * 7 + [i % 50 for i in range(N)]
    rows = B.with_place(spark.createDataFrame([(k,) for k in keys], "k int"), "k").orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(len(keys)))
    assert [r["k"] for r in rows] == sorted(keys, key=lambda k: -1 if k is None else k)


def test_with_place_empty(spark):
    df = B.with_place(spark.createDataFrame([], "k long, v string"), "k")
    assert df.columns == ["k", "v", "place"] and df.collect() == []


def test_numeric_aware_sort(spark, tmp_path):
    keys = random.Random(2).sample(range(10 * N), N)
    spark.createDataFrame([(k,) for k in keys], "o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    rows = [tuple(r) for r in catalog.queries()["numeric_aware_sort"](spark, str(tmp_path)).collect()]
    assert sorted(rows, key=lambda r: r[1]) == [(str(k), i) for i, k in enumerate(sorted(keys), 1)]
