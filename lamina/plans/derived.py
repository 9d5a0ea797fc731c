"""Queries over links, ancestors, fields, variants and sequence search, with inputs derived
from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as T
from ..functions import values as V
from ..operators import fields as X
from ..operators import index as I
from ..operators import tables as B
from ..operators import variants as G
from ..sources import converters as C
from .elements import SEQ_SQL, read, seq


@query("""SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, 'CITES' AS kind FROM lineitem UNION SELECT DISTINCT l_suppkey, l_partkey, 'CITED' FROM lineitem""")
def citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.link_edges(read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("citing"), F.col("l_suppkey").alias("referenced")))


@query("""WITH a AS (SELECT r_name AS ancestor FROM region UNION ALL SELECT r_name || '.' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT r_name || '.' || n_name || '.' || c_mktsegment AS code FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT a.ancestor, count(*) AS n FROM a JOIN c ON starts_with(c.code, a.ancestor || '.') GROUP BY 1 UNION ALL SELECT code, count(*) FROM c GROUP BY 1""")
def ancestor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each code and of every prefix of it."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    place = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    c = read(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    codes = c.select(F.concat_ws(".", "r_name", "n_name", "c_mktsegment").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    return X.tree_ancestors(codes.select("code")).join(codes, "code").groupBy("ancestor").agg(F.sum("n").alias("n"))


@query("""WITH w AS (SELECT o_custkey AS uid, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1),
l AS (UNPIVOT w ON F, O, P INTO NAME theme VALUE score)
SELECT l.uid, theme, (score * 100 // (F + O + P))::BIGINT AS percent FROM l JOIN w ON l.uid = w.uid WHERE score * 3 > F + O + P""")
def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("uid")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)
    return X.themes(wide, ["F", "O", "P"])


@query("""SELECT l_orderkey AS uid, list_sort(list(DISTINCT coalesce(s_name, l_suppkey::VARCHAR)))[1] AS first, count(DISTINCT coalesce(s_name, l_suppkey::VARCHAR)) AS n
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_suppkey % 2 = 0 GROUP BY 1""")
def concept_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uid"), F.lit("supp").alias("kind"), F.col("l_suppkey").cast("string").alias("code"))
    table = read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("code"), F.col("s_name").alias("term"))
    return X.concepts(rows, table).select("uid", F.element_at("terms", 1).alias("first"), F.size("terms").cast("long").alias("n"))


@query(f"""SELECT p_partkey AS id, unnest(list_filter(range(1, 12), lambda i: s[i:i + 1] = 'GA'))::INT - 1 AS position, 'ga' AS alias FROM {SEQ_SQL}
UNION ALL SELECT p_partkey, unnest(list_filter(range(1, 12), lambda i: s[i:i + 1] = 'TC'))::INT - 1, 'ga-' FROM {SEQ_SQL}""")
def sequence_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), seq().alias("text"))
    return X.find_sequences(rows, {"GA": "ga"})


@query(f"""SELECT p_partkey::VARCHAR AS id, 'NC_' || p_partkey || '.1:' || p_partkey % 12 || ':' || s[p_partkey % 12 + 1] || ':' || CASE s[p_partkey % 12 + 1] WHEN 'A' THEN 'C' ELSE 'A' END AS spdi FROM {SEQ_SQL}""")
def variant_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants written as names, parsed again."""
    at = F.col("p_partkey") % 12
    rows = read(spark, sf_dir, "part").select("p_partkey", seq().alias("s"), (at + 1).cast("int").alias("at"))
    old = F.col("s").substr(F.col("at"), F.lit(1))
    name = F.format_string("NC_%s.1:g.%s%s>%s", "p_partkey", "at", old, F.when(old == "A", "C").otherwise("A"))
    return G.spdi(G.newest(G.variants(rows.select(F.col("p_partkey").alias("id"), name.alias("text")))))


@query("""SELECT p_partkey AS id, '<P><N>' || replace(replace(replace(p_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</N><S>' || p_size || '</S><E>' || p_brand || '</E></P>' AS xml FROM part WHERE p_partkey % 2 = 0""")
def append_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    recs = p.select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("<P><N>"), C.escape(F.col("p_name")), F.lit("</N><S>"), F.col("p_size").cast("string"), F.lit("</S></P>")).alias("xml"))
    parts = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("<E>"), "p_brand", F.lit("</E>")).alias("fragment"))
    return X.append_fragments(recs, parts).select(F.col("id").cast("long").alias("id"), "xml")


@query("""SELECT '<Row><k>' || r_regionkey || '</k><n>' || r_name || '</n></Row>' AS xml FROM region""")
def table_to_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.to_records(read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("n")), "Row")


@query("""SELECT '<Rec><k>' || json_extract_string(props, '$.k') || '</k></Rec>' AS xml, count(*) AS n FROM events GROUP BY 1""")
def json_to_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.json_records(read(spark, sf_dir, "events"), "props").groupBy("xml").agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_id FROM (SELECT e.*, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, n FROM events e
JOIN (SELECT user_id AS u, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) ON user_id = u) WHERE i >= n""")
def keep_from_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return B.keep_from_nth(e.select("user_id", "event_id"), e.where("event_type = 'error'").select("user_id"), "user_id", "event_id").select("user_id", "event_id")


@query("""SELECT user_id, event_id FROM (SELECT *, max((event_type = 'click')::INT) OVER w AS b, coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER w, -1) AS x,
 min(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id) AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) t
WHERE b = 1 AND event_id <= coalesce((SELECT min(e.event_id) FROM events e WHERE e.user_id = t.user_id AND e.event_type = 'purchase' AND e.event_id >= t.first), event_id)""")
def between_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events from the first click to the first purchase after it."""
    e = read(spark, sf_dir, "events")
    return B.between_markers(e, "event_id", F.col("event_type") == "click", F.col("event_type") == "purchase", ["user_id"]).select("user_id", "event_id")


@query("""SELECT rpad(n_name, (max(length(n_name)) OVER ())::INT, ' ') || '  ' || lpad(n_regionkey::VARCHAR, (max(length(n_regionkey::VARCHAR)) OVER ())::INT, ' ') AS line FROM nation""")
def align_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.align(read(spark, sf_dir, "nation").select("n_name", "n_regionkey"), ["n_regionkey"])


@query("""SELECT p_partkey AS uid FROM part WHERE p_partkey % 3 = 0""")
def missing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("uid"))
    return I.missing(p.where("uid % 3 <> 0"), p)


@query(r"""SELECT doc_id, regexp_matches(text, '[^\x00-\x7F]') AS nonascii, trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')) AS relaxed FROM documents""")
def text_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", (F.size(V.accented(F.array(x))) > 0).alias("nonascii"), T.relax(x).alias("relaxed"))


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders QUALIFY place BETWEEN 101 AND 150""")
def record_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records 101 to 150 in order: the limit is the operator."""
    placed = B.with_place(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return placed.select("o_orderkey", (F.col("place") + 1).alias("place")).where("place between 101 and 150")
