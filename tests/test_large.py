"""Steps whose work or memory must not outgrow the input, and results beyond the small tables."""

import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina import catalog
from lamina.functions import text as T
from lamina.operators import index as I
from lamina.operators import match as M
from lamina.operators import program as P
from lamina.operators import scope as S
from lamina.operators import search as Q
from lamina.operators import tables as B
from lamina.plans import exploration
from lamina.sources import markup as K


def test_given_is_evaluated_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        calls.add(1)
        return x

    df = spark.createDataFrame([("a b c",)], "text string")
    got = df.select(T.given(counted(F.col("text")), lambda v: F.transform(F.split(v, " "), lambda w: F.concat(w, v))).alias("x")).collect()
    assert got[0]["x"] == ["aa b c", "ba b c", "ca b c"] and calls.value == 1


def test_running_sums(spark):
    for n in (0, 1, 2, 7, 8, 1000):
        df = spark.createDataFrame([([*range(n)],)], "x array<int>")
        assert df.select(I.running(F.col("x"))).first()[0] == [i * (i + 1) // 2 for i in range(n)]


def test_paragraph_terms_reads_a_text_once(spark):
    """the text was cleaned anew for each of its paragraphs."""
    df = spark.createDataFrame([(1, "Café: one,\nof 7 two.\n\nthree" + "\nx" * 500)], "doc_id long, text string")
    index = I.paragraph_terms(df, "doc_id", F.split("text", "\n"), "TEXT")
    rows = sorted((r["pos"], r["term"]) for r in index.collect())
    assert rows == [(0, "cafe"), (1, "one"), (102, "two"), (300, "three"), *((400 + 100 * i, "x") for i in range(500))]
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(regexp_replace(lower(") == 1


def test_classify_cleans_a_text_once(spark):
    """the text was cleaned anew for each alias."""
    odd = "The\u00e9of_the;\u2028in\U0001d400der\nLOS"
    df = spark.createDataFrame([(1, odd), (2, None), (3, "")], "id long, text string")
    got = M.classify(df, {"the": "a", "of": "b", "in": "c", "der": "d", "los": "e", "une": "f"})
    assert [r["labels"] for r in got.orderBy("id").collect()] == [["a", "b", "c", "d", "e"], [], []]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    every = "".join(map(chr, (*range(1, 0x250), 0x2028, 0x1D400)))
    text = spark.createDataFrame([(every,)], "x string").select(T.relax(F.col("x"))).first()[0]
    assert text == re.sub("[^A-Za-z0-9]+", " ", every).strip(" ")


SEQUENCES = "base_counts codon_reports disambiguated fasta_records proteins sequence_edits sequence_search sequences variant_names".split()


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Parts whose sequences would have more than twelve letters, and more than four hex digits."""
    path = str(tmp_path_factory.mktemp("parts"))
    keys = [1, 2105, 2106, 2107, 9999, 20000, 65535, 65536, 1_200_000, 7_200_000]
    spark.createDataFrame([(k, f"part {k}") for k in keys], "p_partkey long, p_name string").write.parquet(f"{path}/part.parquet")
    return path


@pytest.mark.parametrize("name", SEQUENCES)
def test_sequences_of_large_keys(spark, parts, name):
    """F2 to F10: the first twelve digits were taken instead of the last."""
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{parts}/part.parquet/*.parquet'")
    df = catalog.queries()[name](spark, parts)
    want = con.sql(catalog.oracle_sql()[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_streams_of_records_are_bounded(spark):
    """sixteen streams held all records, and a worker all records of a batch of streams."""
    records = spark.range(5000).select(F.col("id").alias("rec_id"), F.format_string("<Order id=\"%s\"/>", "id").alias("xml"))
    sets = exploration.streams(records)
    assert [len(list(K.split_records(r["value"], "Set/*"))) for r in sets.collect()] == [1000] * 5
    assert K.records(sets, "Set/*").select("xml").distinct().count() == 5000


def test_records_leave_in_batches():
    text = "<Set>" + "".join(f"<R>{i:01000d}</R>" for i in range(12_000)) + "</Set>"
    got = list(K.record_batches(iter([pa.RecordBatch.from_arrays([pa.array([None, text, text])], names=["t"])]), "Set/*"))
    assert sum(b.num_rows for b in got) == 24_000 and len(got) > 4
    assert max(b.nbytes for b in got) < 2 * K.HELD_CHARACTERS


def test_nodes_leave_in_batches():
    """a worker held the nodes of ten thousand texts."""
    text = "<r>" + "<a b='c'>d<br></a>" * 1000 + "</r>"
    got = list(K.node_batches(iter([pa.RecordBatch.from_arrays([pa.array(range(101)), pa.array([None] + [text] * 100)], names=["rec_id", "xml"])]), K.VOID))
    assert sum(b.num_rows for b in got) == 100 * 2001 and max(b.num_rows for b in got) <= K.HELD_NODES + 2001
    assert {r for b in got for r in b.column(0).to_pylist()} == set(range(1, 101))


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("orders"))
    spark.createDataFrame([(1, "F", "5-LOW"), (2, "O", None)], "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    lines = [(1, 1, 7, "R", 5.0), (1, 2, 8, None, 6.0), (2, 1, 9, "N", None)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_order_records_print_nulls(spark, orders):
    got = [r["xml"] for r in exploration.order_records(spark, orders).orderBy("rec_id").collect()]
    assert got[1] == '<Order id="2" status="O"><Priority>null</Priority><Lines><Line n="1"><Part>9</Part><Flag>N</Flag><Qty>null</Qty></Line></Lines></Order>'
    assert "<Part>8</Part><Flag>null</Flag><Qty>6</Qty>" in got[0]


def test_scope_paths_parse_a_record_once(spark, orders):
    """a record was made and parsed anew for each path."""
    df = catalog.queries()["scope_paths"](spark, orders)
    assert plan(df).count("MapInArrow") == 1
    assert {(r["rec_id"], r["path"]): r["n"] for r in df.collect()}[1, "Lines/**"] == 8


def test_visit_counts_as_extract(spark):
    texts = ["<a><b><a><b/></a></b><c x='1'/></a>", "<a/><a><b/></a>", "", None, "<a><b>", "<n:a><n:b/></n:a>"]
    df = spark.createDataFrame(list(enumerate(texts)), "rec_id long, xml string")
    paths = ["", "*", "a", "b", "*/a", "**/b", "a/**", "a/*", "a/b", "a.b.a", ":b", "none"]
    want = {(r["rec_id"], p): r["count"] for p in paths for r in S.extract(df, p).groupBy("rec_id").count().collect()}
    assert {(r["rec_id"], r["path"]): r["n"] for r in S.visit_counts(df, paths).collect()} == want


def test_scope_namespaces_shuffle_nothing_more(spark, orders):
    """the visits of a record were rows that were shuffled to be counted."""
    df = catalog.queries()["scope_namespaces"](spark, orders)
    assert plan(df).count("Exchange hash") == plan(exploration.order_records(spark, orders)).count("Exchange hash")
    assert sorted(map(tuple, df.collect())) == [(1, 2), (2, 1)]


def test_programs_read_their_selectors_once():
    """F16, F17, F19: selectors were parsed anew at each visit."""
    assert S.Selector.parse("Line/Part[1:2]") is S.Selector.parse("Line/Part[1:2]")
    assert P.parted("A,B[1,2],C") is P.parted("A,B[1,2],C") and P.parted("A,B[1,2],C") == ["A", "B[1,2]", "C"]


def test_split_at_gaps_repeats_and_nulls(spark):
    """repeats are passed over by the window that is there anyway."""
    rows = [(1, 0, 9), (1, 0, 9), (1, 100, 109), (1, 100, 109), (1, 100, 120), (1, None, None), (1, None, None), (1, 30, None), (1, 30, None), (2, 5, 1), (2, 5, 1), (None, 1, 2), (None, 1, 2)]
    df = spark.createDataFrame(rows, "k int, s int, e int")
    con = duckdb.connect()
    con.sql("create table r0 (k int, s int, e int)")
    con.executemany("insert into r0 values (?, ?, ?)", rows)
    want = con.sql("""WITH r AS (SELECT DISTINCT * FROM r0), b AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s NULLS FIRST, e NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r),
      p AS (SELECT *, sum(CASE WHEN p IS NULL OR s IS NULL OR s - p - 1 >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s NULLS FIRST, e NULLS FIRST ROWS UNBOUNDED PRECEDING)::INT AS part FROM b)
      SELECT k, part, min(s), max(e) FROM p GROUP BY 1, 2""").fetchall()
    got = B.split_at_gaps(df, ["k"], "s", "e")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_split_at_gaps_shuffles_once_into_parts_that_are_not_merged(spark, orders):
    spark.read.parquet(f"{orders}/lineitem.parquet").withColumn("l_suppkey", F.lit(3)).write.mode("overwrite").parquet(f"{orders}/more/lineitem.parquet")
    p = plan(catalog.queries()["split_at_gaps"](spark, f"{orders}/more"))
    assert p.count("Exchange") == 1 and "REPARTITION_BY_NUM" in p


def test_phrases_shuffle_once_and_bear_repeats(spark):
    """hits were made distinct by a hash table and a shuffle of their own."""
    words = [f"w{i}" for i in range(130)]
    rows = [(1, w, i) for i, w in enumerate(words)] + [(2, w, i) for i, w in enumerate(words) if i != 100] + [(3, "w0", 4), (3, "w0", 4), (3, "w1", 5), (3, "w1", 9)]
    index = spark.createDataFrame([*rows, *rows], "uid long, term string, pos int")
    assert [tuple(r) for r in Q.starts(index, Q.Phrase(words)).collect()] == [(1, 0)]
    assert sorted(map(tuple, Q.starts(index, Q.Phrase(["w*", "w1*"])).collect()))[:2] == [(1, 0), (1, 9)]
    assert sorted(map(tuple, Q.starts(index, Q.Phrase(["w0", "w1"])).collect())) == [(1, 0), (2, 0), (3, 4)]
    found = Q.search(index, "w* w1*", frozenset())
    assert plan(found).count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan(found)
    assert {r["uid"] for r in found.collect()} == {1, 2, 3}
