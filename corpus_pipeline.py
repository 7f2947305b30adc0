"""The corpus pipeline: toxic documents go, near copies go, personal data is redacted, sources are mixed, and the rest is packed.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and its result is written and read again as the next one's
documents. All stages but the last return the columns of documents.

Defined cases: an empty table passes through all stages and gives no pieces; without labels nothing is toxic; a null or empty text is kept, is no copy, holds no
personal data and is never taken by the mix (it has no words); a null id is kept and is no copy; a null source is a source of its own; rows that repeat an id with
equal text are copies, of which one stays; very long texts are read whole; further columns are carried along to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, neardup, packing, pii, toxicity
from tessera.llm.shared import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the network, trained on the labels, predicts to be toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): that of the smallest id. Rows that repeat an id are copies too if
    their texts are alike; then one of them stays."""
    return neardup.without_near_copies(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become ``<KIND>``; n_chars follows the text."""
    return pii.redacted(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, by sequence and offset."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("pii", redact), ("mixing", mix), ("packing", pack)]

#: Toxicity and tokenizers have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
