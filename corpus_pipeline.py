"""A training corpus from documents: toxicity, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on every row of docs and returns whole rows of it; the last returns
the pieces of packed sequences.  Between stages the rows are a Parquet table.

Defined cases: null texts count as empty; very long texts are taken whole; of rows with equal texts, repeated rows among
them, one stays, that with the smallest id, a null id being larger than every id; documents without words are never near
copies, so one empty document stays; equal ids have equal fates in mixing; extra columns, whatever their names, are kept
until packing; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm import blocks, exact_dedup, mixing, near_dedup, packing, toxicity
from lexispark.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train the chain on the labelled documents that are here; drop what it rejects."""
    ship(spark)
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the one with the smallest id."""
    ship(spark)
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents, keep one."""
    ship(spark)
    return near_dedup.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample to the raked weights."""
    ship(spark)
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their ids."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = blocks.stored(docs, f"stage-{name}")
    return docs


#: Stages that SQL cannot express: the classifier chain, its training, and byte-pair encoding.
ORACLE_SQL = None
