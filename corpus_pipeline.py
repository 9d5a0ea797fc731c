"""From documents to token ids: the stages of a training corpus, each over all that the
one before kept.

Stages take any columns besides doc_id, text and source, whatever their names, and an empty
table, which stays empty. Repeated rows are each a row; null ids are ids of no document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import lines, mixing, pieces, simhash, toxicity
from lamina.llm.common import stored, table
from lamina.llm.queries import PIECES


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null texts stay, empty ones are judged. Labels
    of documents that aren't among docs aren't learned from; without any, nothing goes."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go from all but one; n_chars follows. Null texts stay
    null; a text that loses every line stays as an empty one."""
    out = lines.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id; texts without
    words, null ones too, are copies of each other."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is a source, and one
    without words is left out."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of each document's token ids and of what they decode to; null and
    empty texts have none."""
    return pieces.encode_digests(docs, PIECES)


STAGES = [
    ("toxicity", toxic),
    ("line dedup", shared_lines),
    ("SimHash near-dedup", near_copies),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", tokens),
]

#: A trained network and an encoder aren't SQL; a test holds the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
