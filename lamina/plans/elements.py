"""Element commands over grouped values of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import sequence as N
from ..functions import text as T
from ..functions import values as V


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, q): whole quantities of an order's lines as text, in line order."""
    item = F.struct("l_linenumber", F.col("l_quantity").cast("long").cast("string").alias("v"))
    grouped = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.select("l_orderkey", F.transform("items", lambda x: x["v"]).alias("q"))


Q = """q AS (SELECT l_orderkey, list(l_quantity::BIGINT ORDER BY l_linenumber, l_quantity::BIGINT::VARCHAR) AS q FROM lineitem GROUP BY 1)"""


@query("""SELECT l_orderkey, sum(l_quantity::BIGINT)::BIGINT AS total, min(l_quantity::BIGINT) AS least, max(l_quantity::BIGINT) AS greatest,
  trunc(avg(l_quantity::BIGINT))::BIGINT AS mean, CASE WHEN count(*) > 1 THEN trunc(sqrt((count(*) * sum(l_quantity::BIGINT ** 2) - sum(l_quantity::BIGINT) ** 2) / (count(*) * (count(*) - 1))))::BIGINT ELSE -1 END AS deviation,
  (list_sort(list(l_quantity::BIGINT)))[(count(*) // 2) + 1] AS median, count(*)::INT AS n,
  sum(strlen(l_quantity::BIGINT::VARCHAR))::BIGINT AS bytes FROM lineitem GROUP BY 1""")
def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q")
    return lines_of(spark, sf_dir).select("l_orderkey", V.total(q).alias("total"), V.least(q).alias("least"), V.greatest(q).alias("greatest"), V.avg(q).alias("mean"), F.coalesce(V.dev(q), F.lit(-1)).alias("deviation"), V.med(q).alias("median"), V.num(q).alias("n"), V.length(q).alias("bytes"))


@query("""SELECT l_orderkey, l_linenumber, sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity ROWS UNBOUNDED PRECEDING)::BIGINT AS running
FROM lineitem""")
def running_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("v"))
    grouped = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    sums = V.running(F.transform("items", lambda x: x["v"].cast("string")))
    return grouped.select("l_orderkey", F.explode(F.arrays_zip(F.transform("items", lambda x: x["l_linenumber"]).alias("n"), sums.alias("s"))).alias("z")).select("l_orderkey", F.col("z.n").alias("l_linenumber"), F.col("z.s").alias("running"))


@query("""SELECT p_partkey, p_size - p_partkey AS sub, p_size * p_partkey AS mul, (p_partkey // p_size)::BIGINT AS div, p_partkey % p_size AS mod
FROM part WHERE p_size > 0""")
def two_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lambda *c: F.array(*(F.col(x).cast("string") for x in c))
    one, other = a("p_size", "p_partkey"), a("p_partkey", "p_size")
    return read(spark, sf_dir, "part").where("p_size > 0").select("p_partkey", V.sub(one).alias("sub"), V.mul(one).alias("mul"), V.div(other).alias("div"), V.mod(other).alias("mod"))


@query("""SELECT v, CASE WHEN v < 0 THEN '-' ELSE '' END || bin(abs(v)) AS b, CASE WHEN v < 0 THEN '-' ELSE '' END || format('{:o}', abs(v)) AS o,
  CASE WHEN v < 0 THEN '-' ELSE '' END || upper(format('{:x}', abs(v))) AS h, bit_count(v)::INT AS ones, v + 1 AS up, v - 1 AS down,
  CASE WHEN v > 0 THEN trunc(log2(v))::BIGINT ELSE -1 END AS l2, CASE WHEN v > 0 THEN trunc(ln(v))::BIGINT ELSE -1 END AS le, CASE WHEN v > 0 THEN trunc(log10(v))::BIGINT ELSE -1 END AS l10
FROM (SELECT p_partkey * 37 - 20011 AS v FROM part)""")
def numeric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.array(F.col("v").cast("string"))
    one = lambda c: F.try_element_at(c, F.lit(1))
    rows = read(spark, sf_dir, "part").select((F.col("p_partkey") * 37 - 20011).alias("v"))
    return rows.select("v", one(V.binary(a)).alias("b"), one(V.octal(a)).alias("o"), one(V.hexadecimal(a)).alias("h"), one(V.bits(a)).cast("int").alias("ones"), one(V.inc(a)).alias("up"), one(V.dec(a)).alias("down"), F.coalesce(one(V.logarithm(a, "2")), F.lit(-1)).alias("l2"), F.coalesce(one(V.logarithm(a, "e")), F.lit(-1)).alias("le"), F.coalesce(one(V.logarithm(a, "10")), F.lit(-1)).alias("l10"))


@query(f"""WITH {Q} SELECT l_orderkey, q[1]::VARCHAR AS first, q[-1]::VARCHAR AS last, array_to_string(list_reverse(q), '|') AS backward, array_to_string(q, '|') AS element FROM q""")
def first_last_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q")
    return lines_of(spark, sf_dir).select("l_orderkey", V.first(q).alias("first"), V.last(q).alias("last"), F.array_join(V.backward(q), "|").alias("backward"), V.element(q, "|").alias("element"))


@query("""SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, replace(c_mktsegment || ' ' || c_name, ' ', '_') AS c, reverse(c_name) AS m,
  trim(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g')) AS a, CASE WHEN length(c_custkey::VARCHAR) < 8 THEN lpad(c_custkey::VARCHAR, 8, '0') ELSE c_custkey::VARCHAR END AS p,
  regexp_replace(c_name, '[0-9]+', 'N', 'g') AS r, to_base64(encode(c_name)) AS b64, c_name AS d64 FROM customer""")
def string_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.array("c_name")
    one = lambda c: F.element_at(c, 1)
    return read(spark, sf_dir, "customer").select(
        "c_custkey", one(V.upper(name)).alias("u"), one(V.lower(name)).alias("l"), one(V.chain(F.array(F.concat_ws(" ", "c_mktsegment", "c_name")))).alias("c"), one(V.mirror(name)).alias("m"),
        one(V.alnum(name)).alias("a"), one(V.pad(F.array(F.col("c_custkey").cast("string")))).alias("p"), one(V.replace(name, "[0-9]+", "N")).alias("r"), T.encode64(F.col("c_name")).alias("b64"), one(V.decode(F.array(T.encode64(F.col("c_name"))))).alias("d64"),
    )


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, month(o_orderdate)::INT AS m, strftime(o_orderdate, '%Y/%m/%d') AS d FROM orders""")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("o_orderdate", "d MMM yyyy")
    a = F.array(text)
    y = V.year(a)
    return read(spark, sf_dir, "orders").select("o_orderkey", y.alias("y"), V.month(a).alias("m"), V.date(y, F.regexp_extract(text, "([A-Za-z]+)", 1), F.regexp_extract(text, r"^(\d+)", 1)).alias("d"))


@query("""SELECT o_orderkey, o_orderpriority[3:] AS tail, CASE WHEN length(o_orderpriority) >= 8 THEN o_orderpriority[1:8] END AS head,
  CASE WHEN contains(upper(o_orderpriority), '-') THEN o_orderpriority[position('-' IN o_orderpriority) + 1:] END AS after FROM orders""")
def range_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_orderpriority")
    return read(spark, sf_dir, "orders").select("o_orderkey", V.slice_range(x, F.lit(3), F.length(x)).alias("tail"), V.slice_range(x, F.lit(1), F.lit(8)).alias("head"), V.between(x, "-").alias("after"))


@query("""SELECT o_orderkey, ((o_orderstatus = 'F')::INT + (o_totalprice > 150000)::INT + (contains(o_orderpriority, 'URGENT'))::INT) >= 2 AS two_of_three,
  NOT (o_orderstatus = 'F' OR o_totalprice > 150000) AS neither FROM orders""")
def threshold_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.equals(F.array("o_orderstatus"), "f")
    b = F.col("o_totalprice") > 150000
    c = V.contains(F.array("o_orderpriority"), "urgent")
    return read(spark, sf_dir, "orders").select("o_orderkey", V.threshold(a, [b], [c]).alias("two_of_three"), V.unless(a, b).alias("neither"))


@query("""SELECT l_orderkey, bool_or(l_returnflag <> 'N') AS is_not, bool_or(l_returnflag = 'N') AS is, bool_or(l_quantity::BIGINT > 40) AS gt, bool_or(l_returnflag < 'N') AS before,
  bool_or(starts_with(l_returnflag, 'A')) AS starts FROM lineitem GROUP BY 1""")
def existential_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("f"), F.collect_list(F.col("l_quantity").cast("long").cast("string")).alias("q"))
    f = F.col("f")
    return g.select("l_orderkey", V.is_not(f, "n").alias("is_not"), V.equals(f, "n").alias("is"), V.compare(F.col("q"), "gt", F.lit(40)).alias("gt"), V.is_before(f, "n").alias("before"), V.starts_with(f, "a").alias("starts"))


@query("""WITH n AS (SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT a.r_name, a.n_name AS left, b.n_name AS right FROM n a JOIN n b ON a.r_name = b.r_name AND a.n_name <> b.n_name""")
def matrix_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = n.groupBy("r_name").agg(F.collect_list("n_name").alias("names"))
    return g.select("r_name", F.explode(V.matrix(F.col("names"))).alias("p")).select("r_name", F.col("p.left").alias("left"), F.col("p.right").alias("right"))


WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda x: x <> '')"
STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(rf"""SELECT doc_id, len(w)::INT AS n_all, len(list_filter(w, lambda x: x NOT IN ({STOPS})))::INT AS n_words FROM (SELECT doc_id, {WORDS} AS w FROM documents)""")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", T.word_count(x, True).alias("n_all"), T.word_count(x).alias("n_words"))


@query(r"""SELECT c, count(*) AS n FROM (SELECT unnest(list_filter(list_transform(regexp_split_to_array(lower(text), '[.,;:]'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS c FROM benchmark) GROUP BY 1""")
def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.explode(T.clauses(F.col("text"))).alias("c")).groupBy("c").agg(F.count("*").alias("n"))


@query(r"""SELECT w, count(*) AS n FROM (SELECT unnest(list_filter(list_transform(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: CASE WHEN length(x) > 1 THEN left(x, 1) || regexp_replace(x[2:], '[.,:;]+$', '') ELSE x END), lambda x: x <> '')) AS w FROM benchmark) GROUP BY 1""")
def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.explode(T.terms(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


@query("""SELECT c, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(c_name, '')) AS c FROM customer) WHERE c <> '' GROUP BY 1""")
def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.explode(T.letters(F.col("c_name"))).alias("c")).groupBy("c").agg(F.count("*").alias("n"))


@query()
def porter2_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words are stemmed, not every occurrence."""
    w = read(spark, sf_dir, "benchmark").select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return w.select("word", T.stemmed(F.col("word")).alias("stem"), "n")


@query(rf"""SELECT pair, count(*) AS n FROM (SELECT w[i] || ' ' || w[i + 1] AS pair FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT list_filter(regexp_split_to_array(r, '[^\p{{L}}\p{{Nd}}]+'), lambda x: x <> '') AS w
  FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{Nd}}\s-]')) AS r FROM documents))) WHERE w[i] NOT IN ({STOPS}) AND w[i + 1] NOT IN ({STOPS})) GROUP BY 1""")
def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.explode(T.pairs(F.col("text"))).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def seq() -> Column:
    """A made-up sequence for each part: the last twelve digits of its key written in bases."""
    digits = F.conv((F.col("p_partkey") * 7919 + 104729).cast("string"), 10, 4)
    return F.translate(F.right(F.lpad(digits, 32, "0"), F.lit(12)), "0123", "ACGT")


SEQ_SQL = """(SELECT p_partkey, translate(array_to_string(list_transform(range(11, -1, -1), lambda i: ((p_partkey * 7919 + 104729) // (4 ** i)::BIGINT % 4)::VARCHAR), ''), '0123', 'ACGT') AS s FROM part)"""


@query(f"""SELECT p_partkey, s, reverse(translate(s, 'ACGT', 'TGCA')) AS rc, s[1:5] AS lead, s[4:9] AS mid, s[3:10] AS cut, reverse(translate(s[2:6], 'ACGT', 'TGCA')) AS minus,
  len(list_filter(regexp_split_to_array(s, ''), lambda c: c = 'G'))::INT AS g FROM {SEQ_SQL}""")
def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    rows = read(spark, sf_dir, "part").select("p_partkey", seq().alias("s"))
    g = F.filter(N.base_counts(s), lambda x: x["letter"] == "G")
    return rows.select("p_partkey", "s", N.revcomp(s).alias("rc"), N.retain(s, leading=5).alias("lead"), N.extract(s, F.lit("4..9")).alias("mid"), N.remove_ends(s, 2, 2).alias("cut"), N.extract(s, F.lit("6..2")).alias("minus"), F.coalesce(F.try_element_at(g, F.lit(1))["count"], F.lit(0)).alias("g"))


_CODONS = "MAP {" + ", ".join(f"'{a}{b}{c}': '{N.CODES[1]['TCAG'.index(a) * 16 + 'TCAG'.index(b) * 4 + 'TCAG'.index(c)]}'" for a in "TCAG" for b in "TCAG" for c in "TCAG") + "}"
_THREE = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in N.THREE.items()) + "}"
_WEIGHTS = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in N.WEIGHTS.items()) + "}"


@query(f"""WITH c AS (SELECT p_partkey, s, list_transform([1, 4, 7, 10], lambda i: {_CODONS}[s[i:i + 2]]) AS r FROM {SEQ_SQL}),
p AS (SELECT p_partkey, s, array_to_string(r, '') AS plain, (CASE WHEN s[1:3] IN ('TTG', 'CTG', 'ATG') THEN 'M' ELSE r[1] END) || r[2] || r[3] || r[4] AS protein FROM c),
w AS (SELECT *, replace(plain, '*', '') AS bare FROM p)
SELECT p_partkey, s, regexp_replace(protein, '[*].*$', '') AS protein, plain,
  CASE WHEN length(bare) > 0 THEN floor({N.WATER} + list_sum(list_transform(regexp_split_to_array(CASE WHEN starts_with(bare, 'M') AND length(bare) > 1 THEN bare[2:] ELSE bare END, ''), lambda x: {_WEIGHTS}[x])) + 0.5)::BIGINT END AS weight,
  array_to_string(list_transform(regexp_split_to_array(plain, ''), lambda x: {_THREE}[x]), '') AS three FROM w""")
def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    rows = read(spark, sf_dir, "part").select("p_partkey", seq().alias("s"))
    p = rows.select("p_partkey", "s", N.cds_to_protein(s).alias("protein"), N.plain_translation(s).alias("plain"))
    return p.withColumn("weight", N.molecular_weight(F.regexp_replace("plain", r"\*", ""))).withColumn("three", N.three_letters(F.col("plain")))
