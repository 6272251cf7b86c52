"""Lexicon-shaped views of the relational test tables.

document -> entry, event -> sense (parent: event_id // 10), conversation -> multitext (role: language, turn:
position), region -> range, nation -> range element.  Each view selects its columns, so scans read no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_pos, id, guid, lang, source, text."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("entry_pos"), F.concat(F.lit("d"), "doc_id").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("guid"), "lang", "source", "text")


def senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sense_id, parent_id, kind, user_id."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("sense_id"), F.when(F.col("event_id") > 0, F.floor(F.col("event_id") / 10).cast("long")).alias("parent_id"), F.col("event_type").alias("kind"), "user_id")


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, lang, text."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("lang"), "text")


def hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, pos, href: every href of every page, some of them spoilt as exporters do."""
    p = table(spark, sf_dir, "pages")
    h = p.select("page_id", F.posexplode(F.expr("regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)")).alias("pos", "raw"))
    href = F.when(F.col("page_id") % 3 == 0, F.replace("raw", F.lit("/"), F.lit("\\"))).otherwise(F.col("raw"))
    href = F.when(F.col("page_id") % 5 == 0, F.concat(href, F.lit(" "))).otherwise(href)
    return h.select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), "raw", href.alias("href"))
