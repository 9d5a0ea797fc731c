"""Programs that print, over records built from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import program as P
from .exploration import order_records

_J = "orders JOIN lineitem ON o_orderkey = l_orderkey"
_O = "l_linenumber, l_partkey::VARCHAR || '<', l_returnflag, l_quantity::BIGINT::VARCHAR || '<'"


@query(f"""SELECT o_orderkey AS rec_id, o_orderkey || '|' || o_orderpriority || string_agg('|' || CASE WHEN l_returnflag = 'R' THEN '(' || l_partkey || ',' || l_quantity::BIGINT || ')' ELSE 'kept' END, '' ORDER BY {_O}) || ';' AS out
  FROM {_J} GROUP BY o_orderkey, o_orderpriority""")
def program_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-tab, -sep, -ret, -pfx, -sfx, -lbl and -else."""
    rows = ["-block", "Line", "-tab", "|", "-ret", ";", "-if", "Flag", "-equals", "R", "-pfx", "(", "-sfx", ")", "-sep", ",", "-element", "Part,Qty", "-else", "-tab", "|", "-ret", ";", "-lbl", "kept"]
    return P.run(order_records(spark, sf_dir), ["-pattern", "Order", "-tab", "|", "-ret", ";", "-element", "Order@id", "Priority", *rows])


@query(f"""SELECT o_orderkey AS rec_id, string_agg(o_orderkey || ':' || rn || ':' || l_linenumber, chr(10) ORDER BY rn) || chr(10) || 'all=' || string_agg(l_quantity::BIGINT::VARCHAR, '+' ORDER BY rn) || chr(10) AS out
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_O}) AS rn FROM {_J}) GROUP BY 1""")
def program_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variable, an accumulator, and the index of a visit."""
    inner = ["-block", "Line", "-sep", "+", "--QTY", "Qty", "-sep", ":", "-tab", "\\n", "-element", "&ID,+,@n"]
    return P.run(order_records(spark, sf_dir), ["-pattern", "Order", "-ID", "Order@id", *inner, "-block", "*", "-pfx", "all=", "-element", "&QTY"])


@query(f"""SELECT o_orderkey AS rec_id, '<Rec><Id>' || o_orderkey || '</Id><Lines>' || string_agg('<Line><Part>' || l_partkey || '</Part></Line>', '' ORDER BY {_O}) || '</Lines><None>-</None></Rec>' AS out FROM {_J} GROUP BY 1""")
def program_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-wrp, -pkg and -def: values in tags, a loop in tags, a placeholder."""
    outer = ["-pattern", "Order", "-tab", "", "-ret", "", "-wrp", "Id", "-element", "Order@id"]
    loop = ["-block", "Lines", "-pkg", "Lines", "-subset", "Line", "-tab", "", "-ret", "", "-deq", "", "-wrp", "Line/Part", "-element", "Part"]
    rest = ["-block", "*", "-tab", "", "-ret", "", "-deq", "", "-wrp", "None", "-def", "-", "-element", "Absent"]
    return P.run(order_records(spark, sf_dir), [*outer, *loop, *rest], head="<Rec>", tail="</Rec>")


@query(f"""SELECT o_orderkey AS rec_id, string_agg('<item n="' || l_linenumber || '" kind="line">' || l_partkey || '</item>', '' ORDER BY {_O}) || chr(10) AS out FROM {_J} WHERE l_returnflag <> 'N' GROUP BY 1""")
def program_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag put together piece by piece."""
    return P.run(order_records(spark, sf_dir), ["-pattern", "Order", "-block", "Line", "-unless", "Flag", "-equals", "N", "-deq", "", "-tag", "item", "-atr", "n", "@n", "-att", "kind", "line", "-cls", "-element", "Part", "-end", "item"])


@query(f"""SELECT o_orderkey AS rec_id, '<Line n="' || n || '"><Part>' || part || '</Part><Flag>' || flag || '</Flag><Qty>' || qty || '</Qty></Line>'
  || chr(9) || 'Line ::= {{' || chr(10) || '  Part "' || part || '",' || chr(10) || '  Flag "' || flag || '",' || chr(10) || '  Qty "' || qty || '"' || chr(10) || '}}'
  || chr(9) || '{{' || chr(10) || '  "Part": "' || part || '",' || chr(10) || '  "Flag": "' || flag || '",' || chr(10) || '  "Qty": "' || qty || '"' || chr(10) || '}}'
  || chr(9) || 'Line' || chr(9) || 'Part+Flag+Qty' || chr(9) || 'n' || chr(10) AS out
  FROM (SELECT o_orderkey, l_linenumber AS n, l_partkey AS part, l_returnflag AS flag, l_quantity::BIGINT AS qty, row_number() OVER (PARTITION BY o_orderkey ORDER BY {_O}) AS rn FROM {_J}) WHERE rn = 1""")
def program_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An element as markup, as ASN.1, as JSON, and its name, children and attributes."""
    return P.run(order_records(spark, sf_dir), ["-pattern", "Order", "-block", "Line", "-position", "first", "-element", "*", ".", "%", "?", "-sep", "+", "-element", "$", "@"])


@query("""SELECT o_orderkey AS rec_id, o_orderpriority[1:1] || chr(9) || o_orderpriority[3:] || chr(9) || (CASE WHEN length(o_orderpriority) > 4 THEN o_orderpriority[3:length(o_orderpriority) - 2] || chr(9) ELSE '' END) || o_orderpriority[1:1] || chr(10) AS out
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def program_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of values: by place, by variables with offsets, and by what stands around them."""
    return P.run(order_records(spark, sf_dir), ["-pattern", "Order", "-N", "Priority[1:1]", "-LOW", "(2)", "-element", "Priority[1:1]", "Priority[3:]", "Priority[&LOW+1:-2]", "Priority[|-]"])


@query("""SELECT o_orderkey AS rec_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity::BIGINT > 45)""")
def program_silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that a program prints nothing for."""
    return P.silent(order_records(spark, sf_dir), ["-pattern", "Order", "-block", "Line", "-if", "Qty", "-gt", "45", "-element", "Part"])


@query("""WITH p AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem))
  SELECT 1 AS part, o_orderkey AS rec_id, '<Id>' || o_orderkey || '</Id>' AS out FROM p UNION ALL SELECT 0, NULL, '<Set>' WHERE EXISTS (FROM p) UNION ALL SELECT 2, NULL, '</Set>' WHERE EXISTS (FROM p)""")
def program_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output between a head and a tail."""
    return P.document(P.run(order_records(spark, sf_dir), ["-pattern", "Order", "-if", "Order@status", "-equals", "f", "-ret", "", "-wrp", "Id", "-element", "Order@id"]), "<Set>", "</Set>")


@query("""SELECT o_orderkey AS rec_id, length(out) > 60 AS long FROM (SELECT o_orderkey, '<Order id="' || o_orderkey || '" status="' || o_orderstatus || '"><Priority>' || o_orderpriority AS out FROM orders WHERE o_orderstatus = 'P' AND o_orderkey IN (SELECT l_orderkey FROM lineitem))""")
def program_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records that pass, unchanged."""
    got = P.run(order_records(spark, sf_dir), ["-pattern", "Order", "-match", "Order@status:P", "-position", "select"])
    return got.select("rec_id", (F.length(F.regexp_extract("out", "^(.*?)</Priority>", 1)) > 60).alias("long"))
