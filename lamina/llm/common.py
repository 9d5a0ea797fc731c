"""Shared pieces: scratch tables, text access in Arrow batches, sizing."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that one Arrow batch may hold on its way to a Python worker.
BATCH_BYTES = 8 << 20
#: Rows that one Arrow batch may hold.
BATCH_ROWS = 2000
#: A key with more than one in so many rows is hot, at most so many keys can be, and over so
#: many join keys its rows are spread.
HOT, SPREAD = 1000, 64
#: Pattern of a word, for JVM expressions.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches, so that long texts don't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where none is set a temporary one serves a local
    master, as in tests; a cluster's executors couldn't share it, so there it's an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lamina-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/lamina-{uuid.uuid4().hex}-{tag}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Stored:
    """A DataFrame written to the shared folder and read back: its lineage is cut,
    and a lost executor costs no more than the tasks that ran there."""

    def __init__(self, df: DataFrame, tag: str, codec: str = "zstd"):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, tag)
        df.write.option("compression", codec).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def stored(df: DataFrame, tag: str) -> DataFrame:
    return Stored(df, tag).df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that no other column of the input can clash."""
    return df.select(*(F.col(n) for n in names))


def quoted(name: str) -> Column:
    """A top-level column of any name."""
    return F.col("`" + name.replace("`", "``") + "`")


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def payloads(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def word_count(text: Column) -> Column:
    """Number of words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hot_join(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """left joined with right (one row for each key) on the column `key` of both.

    weight: a column of right, about how many rows of left hold the key; it isn't returned.
    Keys with more than one in HOT of all rows, which are fewer than HOT by count, are known
    to every task; their rows are spread over SPREAD join keys, and right is repeated for
    them, so a key in a third of all rows is never one task's. how is "inner" or "left"; null
    keys match nothing. total: the sum of weight, if known. right should be a stored table,
    as it is read more than once.
    """
    if total is None:
        total = right.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT > total
    keys = F.broadcast(right.where(is_hot).select(F.col(key).alias("_hot")))
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*left.columns), F.lit(SPREAD))).otherwise(0).cast("int")
    spread = left.join(keys, F.col(key) == F.col("_hot"), "left").select(*left.columns, salt.alias("_salt"))
    salts = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))).alias("_of")
    names = [c for c in right.columns if c not in (key, weight)]
    held = right.select(F.col(key).alias("_key"), *names, salts)
    return spread.join(held, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_of")), how).select(*left.columns, *names)


def segments(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) for each stretch of rows with equal values in the first `keys` columns, all
    integers without nulls. A stretch ends with its batch."""
    for b in batches:
        if not b.num_rows:
            continue
        columns = [c.to_numpy() for c in b.columns[:keys]]
        change = np.zeros(b.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield tuple(int(c[lo]) for c in columns), b.slice(lo, hi - lo)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """As segments, but a stretch goes on in the next batches; each is held whole."""
    now, held = None, []
    for key, rows in segments(batches, keys):
        if key != now and held:
            yield now, pa.concat_batches(held) if len(held) > 1 else held[0]
            held = []
        now = key
        held.append(rows)
    if held:
        yield now, pa.concat_batches(held) if len(held) > 1 else held[0]
