"""Mixing sources to target weights, with DataFrame operations only.

Sizes are summed by source and by the leading bits of a hash of the document. Running
sums over a source's histogram show the bucket in which its budget ends; that bucket
alone is refined by the next bits, level by level, until the threshold is exact. A
document is in the mix if its hash lies below its source's threshold: nothing is sorted
but histograms of `1 << BITS` rows a source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, stored, Stored, word_count

WEIGHTS = (5, 2, 1)
LIMIT = 3
BITS, LEVELS = 12, 4
#: Thresholds of more sources than this aren't broadcast.
MAX_BROADCAST = 100_000
#: Join keys that a source is spread over when thresholds aren't broadcast.
SALT = 32


def doc_hash(doc_id: Column) -> Column:
    """48 bits of the MD5 of the id's decimal text."""
    text = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds `place`, from 0, by code point, null last: sorted ranges are counted, and each
    adds the counts of those before it, so no task sees more than its range."""
    n = max(2, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    parts = stored(sources.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    within = parts.withColumn("within", F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1)
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))  # at most n rows
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return within.join(F.broadcast(before), "part").select(*sources.columns, (F.col("before") + F.col("within")).alias("place"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Shares go by weight; a source whose share exceeds limit times its size gets just that,
    and the others share the rest anew, until none exceeds. One aggregation a round.
    """
    place = F.pmod(F.col("place"), F.lit(len(weights)))
    weight = reduce(lambda w, i: w.when(place == i, weights[i]), range(1, len(weights)), F.when(place == 0, weights[0]))
    rows = stored(ranked(sources).withColumn("weight", weight.cast("long")), "weights")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    capped, capped_weight, all_weight = 0, 0, rows.agg(F.sum("weight")).first()[0] or 0
    share = None
    while capped_weight < all_weight:
        # a cap stays: taking capped sources out only raises the others' shares
        share = (total - limit * capped) / (all_weight - capped_weight)
        over = F.col("weight") * F.lit(share) > limit * F.col("source_size")
        got = rows.where(over).agg(F.sum("source_size"), F.sum("weight")).first()
        if (got[1] or 0) == capped_weight:
            break
        capped, capped_weight = got[0] or 0, got[1] or 0
    most = (limit * F.col("source_size")).cast("double")
    target = most if share is None else F.when(F.col("weight") * F.lit(share) > most, most).otherwise(F.col("weight") * F.lit(share))
    return rows.select("source", "source_size", target.alias("target"))


def _join(docs: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """docs with the columns of their source; sources are broadcast only if there are few,
    else each is repeated over salts, so that a hot one spreads."""
    key = sources.withColumnRenamed("source", "s")
    if few:
        return docs.join(F.broadcast(key), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    key = key.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = docs.withColumn("salt", F.pmod("hash", F.lit(SALT)).cast("int"))
    return salted.join(key, F.col("source").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("salt2"))).drop("s", "salt", "salt2")


def thresholds(docs: DataFrame, budget: DataFrame, few: bool) -> DataFrame:
    """(source, whole, low, take): a document is in the mix `whole` times, and once more if
    its hash is below low, or at low if take.

    docs: (source, size, hash); budget: (source, source_size, target).
    """
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(LIMIT))).otherwise(0).cast("long")
    now = budget.withColumn("whole", whole).select("source", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("sum"))
    now = Stored(now.withColumn("before", F.col("rest")), "thresholds")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        upper = F.shiftright("hash", shift + BITS)
        inside = _join(docs, now.df.where("before > 0").select("source", F.shiftright("low", shift + BITS).alias("prefix")), few).where(upper == F.col("prefix"))
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        # before: what is left of the budget when a bucket begins; it ends in the last bucket
        # that begins with some left
        left = now.df.select(F.col("source").alias("s"), F.col("before").alias("start"))
        order = Window.partitionBy("source").orderBy("bucket")
        edge = sums.join(left, F.col("source").eqNullSafe(F.col("s"))).withColumn("left", F.col("start") - (F.sum("n").over(order) - F.col("n"))).where("left > 0")
        last = edge.groupBy("source").agg(F.max_by(F.struct("bucket", "left", "n"), "bucket").alias("e")).select(F.col("source").alias("s"), "e")
        then = now.df.join(last, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "whole", "rest",
            F.coalesce(F.shiftleft(F.col("e.bucket"), shift), "low").alias("low"),
            F.coalesce(F.col("e.n"), "sum").alias("sum"),
            F.coalesce(F.col("e.left"), "before").alias("before"),
        )
        then = Stored(then, "thresholds")
        now.drop()
        now = then
    # the documents at the last hash go in if that brings the sum nearer to the budget
    take = (F.col("before") > 0) & (F.col("sum") - F.col("before") < F.col("before"))
    return now.df.select("source", "whole", "low", take.alias("take"))


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Sizes of docs (doc_id, source, size, hash), the plan of each source (source,
    source_size, target, whole, low, take), and whether sources are few."""
    sized = stored(docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), doc_hash(F.col("doc_id")).alias("hash")), "sizes")
    budget = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    few = budget.count() <= MAX_BROADCAST
    limits = thresholds(sized.select("source", "size", "hash"), budget, few)
    return sized, stored(limits.withColumnRenamed("source", "s").join(budget, F.col("s").eqNullSafe(F.col("source"))).drop("s"), "plan"), few


def _copies() -> Column:
    again = (F.col("hash") < F.col("low")) | (F.col("hash") == F.col("low")) & F.col("take")
    return F.col("whole") + again.cast("long")


def mix_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of docs (doc_id, text, source).

    size counts words, null has none. taken is size times the copies that the mix takes:
    whole ones of every document of a source, then one more of those below the source's
    threshold. It misses a source's target by half the boundary document at most (rows that
    share a doc_id move together). Empty texts take part with size 0; a null source is a
    source, last in order; null ids share one hash. An empty table gives no rows. A source
    without words has target 0. Other columns are ignored.
    """
    sized, sources, few = plan(docs)
    return _join(sized, sources, few).select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as mix_sizes takes them, with all their columns, whatever
    their names. Null and empty texts have size 0 and come as often as their source's whole
    copies and threshold say; a source without words gives none. Repeated rows move together.
    An empty table gives no rows."""
    _, sources, few = plan(docs)
    whole = docs.select(F.struct(*(quoted(c) for c in docs.columns)).alias("row"), F.col("source"), doc_hash(F.col("doc_id")).alias("hash"))
    joined = _join(whole, sources, few).select("row", _copies().alias("copies")).where("copies > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
