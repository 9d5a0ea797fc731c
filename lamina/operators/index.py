"""Index construction: field tables, inversion, merging, postings on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold, given, pairs, stop, unescape

#: Runs of anything but a-z, 0-9 and points. As a negated class of several ranges it is slower
#: by a factor of ten where tasks share a JVM: they contend for the type checks of its lambdas.
NOT_TERM = r"(?s:(?!\p{Lower}|\p{Digit}|\.).)++"
#: A paragraph begins at the next multiple of this, at least GAP after the last word.
STEP, GAP = 100, 20


def prepared(x: Column) -> Column:
    """Text for positional tokens: accents off, lower case, entities decoded, brackets and
    joiners to spaces."""
    return F.regexp_replace(F.lower(unescape(fold(x))), r"[()_\-]", " ")


def running(x: Column) -> Column:
    """Running sums of an array of numbers: sums of 1, 2, 4, 8 neighbours and so on, so that n
    numbers take n log n steps."""
    steps = lambda v: F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda n: n < F.size(v))
    return given(x, lambda v: F.aggregate(steps(v), v, lambda a, n: F.transform(a, lambda y, i: y + F.coalesce(F.get(a, i - n), F.lit(0)))))


def paragraph_terms(docs: DataFrame, uid: str, paragraphs: Column, field: str) -> DataFrame:
    """(uid, field, term, pos): every word takes a place; stop words and numbers aren't
    kept. A new paragraph leaves a gap, so phrases don't cross it."""
    # the text is prepared as a whole, in generated code, and parted again
    text = F.regexp_replace(prepared(F.array_join(paragraphs, "\x1f")), "[.,:;]+(\\s|$|(?=\x1f))", " ")
    words = F.transform(F.split(text, "\x1f"), lambda p: F.filter(F.split(p, NOT_TERM), lambda w: w != ""))
    rounded = lambda w: (F.ceil((F.size(w) + GAP) / STEP) * STEP).cast("int")
    # a paragraph begins at the sum of the rounded sizes of those before it, its own taken off again
    begins = lambda ws: F.zip_with(running(F.transform(ws, rounded)), ws, lambda end, w: end - rounded(w))
    placed = given(words, lambda ws: F.flatten(F.zip_with(ws, begins(ws), lambda w, b: F.transform(w, lambda t, i: F.struct(t.alias("term"), (b + i).cast("int").alias("pos"))))))
    rows = docs.select(F.col(uid).alias("uid"), F.explode(placed).alias("t")).select("uid", F.lit(field).alias("field"), "t.term", "t.pos")
    return rows.where(~stop(F.col("term")) & ~F.col("term").rlike("^[0-9.]+$"))


def invert(index: DataFrame) -> DataFrame:
    """(field, term, uid, positions), one posting for each."""
    return index.groupBy("field", "term", "uid").agg(F.array_sort(F.collect_set("pos")).alias("positions"))


def postings(inverted: DataFrame) -> DataFrame:
    """(field, term, df, uids): ids in numeric order. For reports and small fields; indexes
    themselves stay exploded, so that a frequent term is no single row."""
    return inverted.groupBy("field", "term").agg(F.count("*").alias("df"), F.array_sort(F.collect_list("uid")).alias("uids"))


def exploded_postings(inverted: DataFrame, df: DataFrame) -> DataFrame:
    """(term, df, uid, positions) from (uid, term, positions) and (term, df): one row for each
    posting, so that a frequent term is many."""
    return inverted.join(df, "term").select("term", "df", "uid", "positions")


def merge(*parts: DataFrame) -> DataFrame:
    """Inverted parts, later ones winning for the same (field, term, uid)."""
    marked = [p.select("field", "term", "uid", "positions", F.lit(i).alias("part")) for i, p in enumerate(parts)]
    out = marked[0]
    for p in marked[1:]:
        out = out.union(p)
    return out.groupBy("field", "term", "uid").agg(F.max_by("positions", "part").alias("positions"))


def bucket(term: Column) -> Column:
    return F.substring(term, 1, 2)


def write_index(inverted: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by field, each file a range of terms in order: a term's lookup prunes by the
    field's folder and by row-group statistics."""
    ordered = inverted.repartitionByRange(F.col("field"), F.col("term")).sortWithinPartitions("field", "term", "uid")
    ordered.write.mode(mode).partitionBy("field").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(uid, field, term, pos) of a written index."""
    return spark.read.parquet(path).select("uid", "field", "term", F.explode("positions").alias("pos"))


def totals(index: DataFrame, field: str | None = None) -> DataFrame:
    rows = index.where(F.col("field") == field) if field else index
    return rows.groupBy("term").agg(F.count_distinct("uid").alias("df"), F.count("*").alias("tf"))


def tf_idf(tf: DataFrame, df: DataFrame, docs: DataFrame) -> DataFrame:
    """(uid, term, tf, tfidf) from (uid, term, tf), (term, df) and the documents, which are counted."""
    counted = df.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n"))))  # one row
    return tf.join(counted, "term").select("uid", "term", "tf", F.round(F.col("tf") * F.ln(F.col("n") / F.col("df")), 6).alias("tfidf"))


# -- index documents -----------------------------------------------------------------------


def index_documents(values: DataFrame, uid: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """(uid, field, term, pos) of records whose columns are arrays of values, in one pass.

    fields: for each field a column and how it is indexed: "text", positions over paragraphs;
    "key", each whole value in lower case; "year", the first four digits; "pair", neighbouring
    informative words; "count", the number of values. Keys have no position."""
    rows = None
    keys = []
    for name, (column, how) in fields.items():
        a = F.coalesce(F.col(column), F.array().cast("array<string>"))
        if how == "text":
            own = paragraph_terms(values, uid, a, name)
            rows = own if rows is None else rows.union(own)
            continue
        made = {
            "key": F.transform(a, lambda x: F.lower(F.trim(x))),
            "year": F.transform(a, lambda x: F.regexp_extract(x, "([0-9]{4})", 1)),
            "pair": F.flatten(F.transform(a, pairs)),
            "count": F.array(F.size(a).cast("string")),
        }[how]
        keys.append(F.struct(F.lit(name).alias("field"), F.array_distinct(F.filter(made, lambda x: x != "")).alias("terms")))
    if keys:
        spread = values.select(F.col(uid).alias("uid"), F.explode(F.array(*keys)).alias("k")).select("uid", "k.field", F.explode("k.terms").alias("term"), F.lit(None).cast("int").alias("pos"))
        rows = spread if rows is None else rows.union(spread)
    return rows


def folder(uid: Column, depth: int = 3) -> Column:
    """The folder of an id in an archive: digits padded to eight, two a level."""
    padded = F.when(F.length(uid) < 8, F.lpad(uid, 8, "0")).otherwise(uid)
    return F.when(uid.rlike("^[0-9]+$"), F.concat_ws("/", *(padded.substr(2 * i + 1, 2) for i in range(depth))))


# -- record archive ------------------------------------------------------------------------


def archive(records: DataFrame, path: str, span: int = 10_000) -> None:
    """Records (uid, version, xml) by folders of uid ranges; the newest version stays."""
    newest = records.groupBy("uid").agg(F.max_by(F.struct("version", "xml"), "version").alias("r"))
    rows = newest.select("uid", "r.version", "r.xml", F.crc32(F.col("r.xml").cast("binary")).alias("crc"), F.floor(F.col("uid") / span).alias("span"))
    rows.write.mode("overwrite").partitionBy("span").parquet(path)


def fetch(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """Records of ids (ord, uid), in their order at the sink."""
    return ids.join(stored, "uid").orderBy("ord")


def missing(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(stored, "uid", "left_anti")


def delete(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids, "uid", "left_anti")


def candidates(stored: DataFrame, records: DataFrame, ignore: str | None = None) -> DataFrame:
    """(uid, status) of incoming records: NW new, UP changed, NO the same; `ignore` names an
    element that doesn't count."""
    plain = lambda c: F.regexp_replace(c, f"(?s)<{ignore}>.*?</{ignore}>", "") if ignore else c
    old = stored.select(F.col("uid").alias("u"), F.sha2(plain(F.col("xml")), 256).alias("h"))
    joined = records.join(old, F.col("uid") == F.col("u"), "left")
    status = F.when(F.col("u").isNull(), "NW").when(F.col("h") != F.sha2(plain(F.col("xml")), 256), "UP").otherwise("NO")
    return joined.select("uid", status.alias("status"))
