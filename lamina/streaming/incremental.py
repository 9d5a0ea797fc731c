"""Incremental index maintenance with Structured Streaming.

New document files are read once, each micro-batch is inverted by itself and appended as
a part; readers merge parts, and compaction rewrites them as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index as I
from ..operators.positions import positions


def index_batch(docs: DataFrame) -> DataFrame:
    return I.invert(positions(docs).withColumn("field", F.lit("TEXT")))


def follow(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> None:
    """Indexes all files under source that earlier runs didn't; a batch that is repeated
    after a failure overwrites its own part."""

    def write(batch: DataFrame, number: int) -> None:
        index_batch(batch).write.mode("overwrite").parquet(f"{target}/part={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, target: str) -> DataFrame:
    """(field, term, uid, positions): of a document that came again, the last part counts."""
    parts = spark.read.parquet(target)
    last = parts.groupBy("uid").agg(F.max("part").alias("last")).withColumnRenamed("uid", "u")
    return parts.join(last, (F.col("uid") == F.col("u")) & (F.col("part") == F.col("last"))).select("field", "term", "uid", "positions")
