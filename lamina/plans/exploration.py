"""Extraction from markup. Records are built from relational tables, so that relational
queries over those tables tell what extraction must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import values as V
from ..operators import scope as S
from ..sources import markup as K
from .elements import read


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, xml): an element for each order that has lines, with its lines inside."""
    put = lambda *parts: F.concat(*(F.lit(x) if i % 2 == 0 else F.coalesce(F.col(x).cast("string"), F.lit("null")) for i, x in enumerate(parts)))
    line = put('<Line n="', "l_linenumber", '"><Part>', "l_partkey", "</Part><Flag>", "l_returnflag", "</Flag><Qty>", "_qty", "</Qty></Line>")
    item = F.struct("l_linenumber", line.alias("x"))
    rows = read(spark, sf_dir, "lineitem").withColumn("_qty", F.col("l_quantity").cast("long"))
    lines = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["x"]), "").alias("lines"))
    o = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    text = put('<Order id="', "o_orderkey", '" status="', "o_orderstatus", '"><Priority>', "o_orderpriority", "</Priority><Lines>", "lines", "</Lines></Order>")
    return o.select(F.col("o_orderkey").alias("rec_id"), text.alias("xml"))


def streams(records: DataFrame) -> DataFrame:
    """(g, value): sets of records, a thousand ids to a set, so that more records are more sets."""
    text = F.concat(F.lit("<?xml version='1.0'?><Set><!-- <Order> -->"), F.array_join(F.collect_list("xml"), "\n"), F.lit("</Set>"))
    return records.groupBy(F.floor(F.col("rec_id") / 1000).alias("g")).agg(text.alias("value"))


def order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.node_table(order_records(spark, sf_dir))


_J = "orders JOIN lineitem ON o_orderkey = l_orderkey"


@query(f"""SELECT o_orderkey AS rec_id, o_orderstatus AS status, o_orderpriority AS priority, string_agg(l_partkey::VARCHAR, '|' ORDER BY l_linenumber, l_partkey::VARCHAR || '<', l_returnflag, l_quantity::BIGINT::VARCHAR || '<') AS parts,
  count(*)::VARCHAR AS n FROM {_J} GROUP BY 1, 2, 3""")
def xml_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.extract(order_records(spark, sf_dir), status="Order@status", priority="Priority", parts="Line/Part", n="#Line")
    return got.select("rec_id", V.first(F.col("status")).alias("status"), V.first(F.col("priority")).alias("priority"), V.element(F.col("parts"), "|").alias("parts"), V.first(F.col("n")).alias("n"))


@query(f"""SELECT o_orderkey AS rec_id, l_linenumber::VARCHAR AS n, l_partkey::VARCHAR AS part, l_returnflag AS flag FROM {_J}""")
def xml_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each visit of a nested loop."""
    got = S.extract(order_records(spark, sf_dir), "Lines/Line", n="@n", part="Part", flag="Flag")
    return got.select("rec_id", F.element_at("n", 1).alias("n"), F.element_at("part", 1).alias("part"), F.element_at("flag", 1).alias("flag"))


@query(f"""SELECT o_orderkey AS rec_id, sum(l_quantity::BIGINT)::BIGINT AS qty FROM {_J} WHERE l_returnflag = 'R' GROUP BY 1""")
def xml_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks kept by a condition, their values summed by record."""
    block = S.extract(order_records(spark, sf_dir), "Line", flag="Flag", qty="Qty")
    kept = block.where(V.equals(F.col("flag"), "r")).groupBy("rec_id").agg(F.flatten(F.collect_list("qty")).alias("q"))
    return kept.select("rec_id", V.total(F.col("q")).alias("qty"))


@query(f"""SELECT path, count(*) AS count FROM (SELECT unnest(['Order', 'Order/Priority', 'Order/Lines']) AS path FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT unnest(['Order/Lines/Line', 'Order/Lines/Line/Part', 'Order/Lines/Line/Flag', 'Order/Lines/Line/Qty']) FROM {_J}) GROUP BY 1""")
def xml_synopsis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.paths(order_records(spark, sf_dir))


@query("""SELECT o_orderkey AS rec_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_orderstatus = 'O'""")
def xml_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records put into streams of markup and split out of them again, then selected."""
    split = K.records(streams(order_records(spark, sf_dir)), "Set/*")
    return split.where(F.col("xml").contains('status="O"')).select(F.regexp_extract("xml", 'id="([0-9]+)"', 1).cast("long").alias("rec_id"))


@query()
def html_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = K.node_table(read(spark, sf_dir, "pages"), "page_id", "html", html_void=True)
    return S.outline(nodes)


@query(r"""SELECT page_id AS rec_id, len(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*='))::BIGINT AS n FROM pages WHERE len(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=')) > 0""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = K.node_table(read(spark, sf_dir, "pages"), "page_id", "html", html_void=True)
    return nodes.where((F.lower("name") == "a") & F.col("attrs")["href"].isNotNull()).groupBy("rec_id").agg(F.count("*").alias("n"))


@query()
def html_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.verify(read(spark, sf_dir, "pages"), "page_id", "html")
