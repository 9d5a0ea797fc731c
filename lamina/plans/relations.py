"""Joins, sets, counts, windows and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T
from ..operators import index as I
from ..operators import match as M
from ..operators import scope as S
from ..operators import search as Q
from ..operators import tables as B
from .elements import read


@query("""SELECT count(*) AS count, min(event_type) AS value FROM events GROUP BY lower(event_type)""")
def sort_uniq_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.sort_uniq_count(read(spark, sf_dir, "events"), "event_type")


@query("""SELECT count(*) AS count, min(p_type) AS value, row_number() OVER (ORDER BY count(*) DESC, min(p_type))::INT AS rank FROM part GROUP BY lower(p_type)""")
def sort_uniq_count_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.sort_uniq_count_rank(read(spark, sf_dir, "part"), "p_type")


@query("""SELECT l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 1""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("value")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_custkey, sum(floor(o_totalprice)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM orders""")
def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    price = F.floor("o_totalprice").cast("long")
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.sum(price).over(w).alias("total"))


def _positions(which: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
        return S.position(rows, which, ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber")

    f.__name__ = f"position_{which}"
    return f


POSITION = {"first": "i = 1", "last": "i = n", "outer": "i = 1 OR i = n", "inner": "i > 1 AND i < n", "even": "i % 2 = 0", "odd": "i % 2 = 1"}
for _which, _test in POSITION.items():
    query(f"""SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE {_test}""")(_positions(_which))


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def semi_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return read(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def anti_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def _ids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = read(spark, sf_dir, "orders")
    pick = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("uid"))
    return pick("F"), pick("O")


A_SQL, B_SQL = (f"SELECT o_custkey AS uid FROM orders WHERE o_orderstatus = '{s}'" for s in "FO")


@query(f"{A_SQL} UNION {B_SQL}")
def ids_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.union_ids(*_ids(spark, sf_dir))


@query(f"{A_SQL} INTERSECT ALL {B_SQL}")
def ids_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.intersect_ids(*_ids(spark, sf_dir))


@query(f"{A_SQL} EXCEPT ALL {B_SQL}")
def ids_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.exclude_ids(*_ids(spark, sf_dir))


@query(f"({A_SQL} EXCEPT ALL {B_SQL}) UNION ALL ({B_SQL} EXCEPT ALL {A_SQL})")
def ids_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.difference_ids(*_ids(spark, sf_dir))


@query("""SELECT v, row_number() OVER (ORDER BY length(v), v)::INT AS place FROM (SELECT DISTINCT o_custkey::VARCHAR AS v FROM orders)""")
def numeric_aware_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("v")).distinct()
    keyed = v.withColumn("k", F.struct(*(c.alias(f"k{i}") for i, c in enumerate(B.numeric_first(F.col("v"))))))
    return B.with_place(keyed, "k").select("v", (F.col("place") + 1).cast("int").alias("place"))


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1""")
def keep_last_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", F.col("m.event_id").alias("event_id"))


@query("""WITH r AS (SELECT DISTINCT l_suppkey AS k, date_diff('day', DATE '1990-01-01', l_shipdate::DATE)::BIGINT AS s, (date_diff('day', DATE '1990-01-01', l_shipdate::DATE) + l_quantity::BIGINT % 5)::BIGINT AS e FROM lineitem),
b AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM b)
SELECT k, min(s) AS start, max(e) AS "end", max(e) + 1 - min(s) AS length FROM i GROUP BY k, g""")
def fuse_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).cast("long")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), (day + F.round("l_quantity").cast("long") % 5).alias("start"), day.alias("end"))
    return B.fuse_ranges(rows, ["k"])


@query("""SELECT a.o_orderkey AS o, b.o_orderkey AS p FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
AND date_diff('day', DATE '1990-01-01', a.o_orderdate::DATE) < date_diff('day', DATE '1990-01-01', b.o_orderdate::DATE) + 30
AND date_diff('day', DATE '1990-01-01', a.o_orderdate::DATE) + 30 > date_diff('day', DATE '1990-01-01', b.o_orderdate::DATE)""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date"))
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey"), day.alias("d"))
    a = o.select("k", F.col("o_orderkey").alias("o"), F.col("d").alias("start"), (F.col("d") + 30).alias("end"))
    b = o.select("k", F.col("o_orderkey").alias("p"), F.col("d").alias("low"), (F.col("d") + 30).alias("high"))
    return B.overlap_join(a, b, "k", 64).where("o < p").select("o", "p")


@query("""SELECT n_name, r_name AS translated FROM nation JOIN region ON n_regionkey = r_regionkey""")
def translate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.col("r_name").alias("translated"))  # region is of fixed size


ALIASES = {"the": "article", "of": "preposition", "in": "preposition", "der": "german", "los": "spanish", "une": "french"}
_X = "' ' || lower(trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'))) || ' '"
_HITS = ", ".join(f"CASE WHEN contains({_X}, ' {a} ') THEN '{b}' END" for a, b in ALIASES.items())


@query(f"""SELECT doc_id AS id, array_to_string(list_sort(list_distinct(list_filter([{_HITS}], lambda x: x IS NOT NULL))), ',') AS labels FROM documents""")
def classify_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return M.classify(d, ALIASES).select("id", F.array_join("labels", ",").alias("labels"))


@query("""SELECT count(DISTINCT ts) > 1 AS ts, count(DISTINCT user_id) > 1 AS user_id, count(DISTINCT event_type) > 1 AS event_type, false AS fixed FROM events""")
def uniq_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("ts", "user_id", "event_type", F.lit(1).alias("fixed"))
    kept = B.varying_columns(e)
    return spark.range(1).select(*(F.lit(c in kept).alias(c) for c in e.columns))


@query("""SELECT grp, array_to_string(list(s_suppkey ORDER BY s_suppkey), ',') AS joined
FROM (SELECT s_suppkey, (row_number() OVER (ORDER BY s_suppkey) - 1) // 7 AS grp FROM supplier) GROUP BY 1""")
def join_into_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.groups_of(read(spark, sf_dir, "supplier"), 7, "s_suppkey", "s_suppkey")


@query("""SELECT DISTINCT b.l_suppkey AS uid FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey WHERE a.l_suppkey = 1""")
def link_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers two steps away from one, by the parts between."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    up = l.select((-F.col("l_partkey") - 1).alias("dst"), F.col("l_suppkey").alias("src")).distinct()
    edges = up.union(up.select(F.col("src").alias("dst"), F.col("dst").alias("src")))
    return Q.links(edges, spark.range(1).select((F.col("id") + 1).alias("uid")), 2)


@query("""SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations""")
def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"))


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", "text")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


_W = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda x: x <> ''))"


@query(f"""WITH b AS (SELECT item_id, {_W} AS w FROM benchmark), d AS (SELECT doc_id, {_W} AS w FROM documents),
p AS (SELECT item_id, doc_id, n, m, count(*) AS c FROM (SELECT item_id, len(w) AS n, unnest(w) AS t FROM b) x JOIN (SELECT doc_id, len(w) AS m, unnest(w) AS t FROM d) y ON x.t = y.t GROUP BY ALL)
SELECT item_id, doc_id, (c * 100 // (n + m - c))::BIGINT AS score FROM p WHERE c * 100 // (n + m - c) >= 10""")
def jaccard_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.jaccard_pairs(_benchmark(spark, sf_dir), _documents(spark, sf_dir), "item_id", "doc_id", 10)


_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_PAIRS = rf"""SELECT DISTINCT id, w[i] || ' ' || w[i + 1] AS pair FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM (SELECT id, list_filter(regexp_split_to_array(r, '[^\p{{L}}\p{{Nd}}]+'), lambda x: x <> '') AS w
  FROM (SELECT id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{Nd}}\s-]')) AS r FROM t))) WHERE w[i] NOT IN ({_STOPS}) AND w[i + 1] NOT IN ({_STOPS})"""


@query(f"""WITH c AS ({_PAIRS.replace("FROM t)", "FROM (SELECT item_id AS id, text FROM benchmark))")}), d AS ({_PAIRS.replace("FROM t)", "FROM (SELECT doc_id AS id, text FROM documents))")}),
v AS (SELECT c.id AS cit, d.id AS doc, count(*) AS votes FROM c JOIN d USING (pair) GROUP BY 1, 2),
k AS (SELECT cit, doc FROM v WHERE votes >= 4 QUALIFY votes = max(votes) OVER (PARTITION BY cit)),
f AS (SELECT cit, doc FROM k QUALIFY row_number() OVER (PARTITION BY cit ORDER BY doc) <= 25),
s AS (SELECT cit, doc, (len(list_intersect(a.w, b.w)) * 100 // len(list_distinct(a.w || b.w)))::BIGINT AS score FROM f JOIN (SELECT item_id, {_W} AS w FROM benchmark) a ON cit = item_id JOIN (SELECT doc_id, {_W} AS w FROM documents) b ON doc = doc_id)
SELECT cit, doc, score FROM s WHERE score >= 60 QUALIFY row_number() OVER (PARTITION BY cit ORDER BY score DESC, doc) = 1""")
def citation_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items against documents by shared word pairs, then by words in common."""
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return M.match(b, d)


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("""SELECT p_partkey AS uid, CASE WHEN p_partkey % 3 = 0 THEN 'NW' WHEN p_partkey % 3 = 1 THEN 'UP' ELSE 'NO' END AS status FROM part""")
def update_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = lambda name, stamp: F.format_string("<R><D>%s</D><N>%s</N></R>", F.lit(stamp), name)
    p = read(spark, sf_dir, "part")
    stored = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("uid"), xml(F.col("p_name"), "old").alias("xml"))
    changed = F.when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))
    return I.candidates(stored, p.select(F.col("p_partkey").alias("uid"), xml(changed, "new").alias("xml")), "D")
