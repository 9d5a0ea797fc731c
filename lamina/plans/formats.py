"""Markup rewritten, index documents, citations and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import sequence as N
from ..operators import format as W
from ..operators import index as I
from ..operators import match as M
from ..operators import scope as S
from ..operators import search as Q
from ..operators import variants as G
from .elements import SEQ_SQL, read, seq
from .exploration import order_records

_J = "orders JOIN lineitem ON o_orderkey = l_orderkey"
_O = "l_linenumber, l_partkey::VARCHAR || '<', l_returnflag, l_quantity::BIGINT::VARCHAR || '<'"
_NL = "chr(10)"


@query(f"""SELECT o_orderkey AS rec_id, '<?xml version="1.0"?>' || {_NL} || '<Order id="' || o_orderkey || '" status="' || o_orderstatus || '">' || {_NL} || '  <Priority>' || o_orderpriority || '</Priority>' || {_NL} || '  <Lines>' || {_NL} ||
  string_agg('    <Line n="' || l_linenumber || '">' || {_NL} || '      <Part>' || l_partkey || '</Part>' || {_NL} || '      <Flag>' || l_returnflag || '</Flag>' || {_NL} || '      <Qty>' || l_quantity::BIGINT || '</Qty>' || {_NL} || '    </Line>' || {_NL}, '' ORDER BY {_O})
  || '  </Lines>' || {_NL} || '</Order>' || {_NL} AS xml FROM {_J} GROUP BY o_orderkey, o_orderstatus, o_orderpriority""")
def formatted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.formatted(order_records(spark, sf_dir), "indent", '<?xml version="1.0"?>')


@query(f"""SELECT o_orderkey AS rec_id, '<Order>' || {_NL} || '<Priority>' || {_NL} || o_orderpriority || {_NL} || '</Priority>' || {_NL} || '<Lines>' || {_NL} ||
  string_agg('<Line>' || {_NL} || '<Part>' || {_NL} || l_partkey || {_NL} || '</Part>' || {_NL} || '<Flag>' || {_NL} || l_returnflag || {_NL} || '</Flag>' || {_NL} || '<Qty>' || {_NL} || l_quantity::BIGINT || {_NL} || '</Qty>' || {_NL} || '</Line>' || {_NL}, '' ORDER BY {_O}) || '</Lines>' || {_NL} || '</Order>' || {_NL} AS xml FROM {_J} GROUP BY o_orderkey, o_orderpriority""")
def attributes_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.filtered(order_records(spark, sf_dir), "Line", "remove", "attributes")


@query("""SELECT o_orderkey AS rec_id, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def object_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left without one object: all other objects of its parent."""
    got = W.filtered(order_records(spark, sf_dir), "Flag", "remove", "object")
    return got.select("rec_id", F.when(~F.col("xml").contains("Flag"), F.regexp_count("xml", F.lit("<Part>"))).cast("long").alias("n"))


@query("""SELECT event_id, '{' || chr(10) || '  "k": ' || json_extract_string(props, '$.k') || chr(10) || '}' AS json FROM events""")
def pretty_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", W.pretty_json(F.col("props")).alias("json"))


@query(f"""SELECT p_partkey, '>P' || p_partkey || ' ' || p_name || chr(10) || s[1:5] || chr(10) || s[6:10] || chr(10) || s[11:12] || chr(10) AS fasta FROM {SEQ_SQL} JOIN (SELECT p_partkey AS k, p_name FROM part) ON k = p_partkey""")
def fasta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", W.fasta_record(F.concat(F.lit("P"), F.col("p_partkey").cast("string")), F.col("p_name"), seq(), 5).alias("fasta"))


@query(f"""SELECT p_partkey, s[1:3] || ' ' || s[4:6] || ' ' || s[7:9] || ' ' || s[10:12] || ' ' || repeat('    ', 11) || '     4' || chr(10) || ' A   B   C   D  ' || chr(10) || chr(10) AS report FROM {SEQ_SQL}""")
def codon_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", N.codons(seq(), F.lit("ABCD")).alias("report"))


@query("""SELECT o_orderkey AS uid, 'STAT' AS field, lower(o_orderstatus) AS term, NULL::INT AS pos FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT DISTINCT o_orderkey, 'PART', l_partkey::VARCHAR, NULL::INT FROM orders JOIN lineitem ON o_orderkey = l_orderkey
UNION ALL SELECT o_orderkey, 'NUM', count(*)::VARCHAR, NULL::INT FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1
UNION ALL SELECT o_orderkey, 'PRIO', lower(w), i::INT FROM (SELECT o_orderkey, unnest(list_filter(regexp_split_to_array(replace(o_orderpriority, '-', ' '), ' '), lambda x: x <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(replace(o_orderpriority, '-', ' '), ' '), lambda x: x <> ''), 1) - 1 AS i FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
  WHERE NOT regexp_matches(w, '^[0-9.]+$') AND lower(w) NOT IN ('not')""")
def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several fields of records in one pass: keys, a count, and positional text."""
    values = S.extract(order_records(spark, sf_dir), status="Order@status", parts="Part", prio="Priority")
    return I.index_documents(values, "rec_id", {"STAT": ("status", "key"), "PART": ("parts", "key"), "NUM": ("parts", "count"), "PRIO": ("prio", "text")})


@query("""SELECT o_orderkey, substr(lpad(o_orderkey::VARCHAR, 8, '0'), 1, 2) || '/' || substr(lpad(o_orderkey::VARCHAR, 8, '0'), 3, 2) || '/' || substr(lpad(o_orderkey::VARCHAR, 8, '0'), 5, 2) AS folder FROM orders""")
def archive_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", I.folder(F.col("o_orderkey").cast("string")).alias("folder"))


@query("""SELECT o_orderkey AS id, o_custkey AS doc, concat_ws(',', CASE WHEN c_custkey IS NOT NULL THEN 'title' END, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'journal' END) AS agree,
  concat_ws(',', CASE WHEN c_mktsegment <> 'FURNITURE' THEN 'journal' END) AS differ, concat_ws(',', 'author', CASE WHEN c_custkey IS NULL THEN 'title,journal' END, 'year,volume,page') AS missing FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def compared_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations against the records they name, field by field."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    title = F.concat(F.lit(" customer  "), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("."))
    cited = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("doc"), F.lit("").alias("author"), title.alias("title"), F.lit("Furniture.").alias("journal"), F.lit(None).cast("string").alias("year"), F.lit("").alias("volume"), F.lit("7-9").alias("page"))
    clean = M.normalised(cited).join(cited.select(F.col("id").alias("i"), "doc"), F.col("id") == F.col("i")).drop("i")
    records = c.select(F.col("c_custkey").alias("doc"), F.lit("x").alias("author"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("journal"), F.lit("1999").alias("year"), F.lit("3").alias("volume"), F.lit("").alias("page"))
    return M.compared(clean, records)


@query("""SELECT l_suppkey AS src, l_partkey AS dst, max(l_quantity::BIGINT) AS score FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey <> l_partkey AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 5) GROUP BY 1, 2 HAVING max(l_quantity::BIGINT) >= 20""")
def scored_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of one kind from some ids, by score."""
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("name"), F.col("l_quantity").cast("long").alias("score"))
    return Q.neighbours(edges, read(spark, sf_dir, "supplier").where("s_suppkey < 5").select(F.col("s_suppkey").alias("uid")), "R", 20)


@query("""SELECT p_partkey::VARCHAR AS id, 'NC_1.2:' || p_partkey || ':AC:' AS spdi FROM part UNION ALL SELECT p_partkey::VARCHAR, 'NC_1.2:' || p_partkey + 1 || '::GG' FROM part
UNION ALL SELECT p_partkey::VARCHAR, 'NC_1.2:' || p_partkey || ':AC:T' FROM part UNION ALL SELECT p_partkey::VARCHAR, 'NC_1.2:' || p_partkey + 2 || '::AC' FROM part""")
def longer_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletions, insertions, both, and duplications."""
    k = F.col("p_partkey")
    text = F.format_string("NC_1.2:g.%s_%sdelAC,NC_1.2:g.%s_%sinsGG,NC_1.2:g.%s_%sdelACinsT,NC_1.2:g.%s_%sdupAC,junk", k + 1, k + 2, k + 1, k + 2, k + 1, k + 2, k + 1, k + 2)
    return G.spdi(G.variants(read(spark, sf_dir, "part").select(k.alias("id"), text.alias("text"))))
