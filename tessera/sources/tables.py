"""The given Parquet tables, and the roles they play.

documents are files (source: repository, lang: language), orders with line
items are files with imports, events are token sequences per user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, repo, lang, path, text of ``documents``."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"),
        F.col("source").alias("repo"),
        "lang",
        F.concat(F.col("lang"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"),
        "text",
    )


def event_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id (the user), repo, seq (time, id) and w (the event type): a corpus over five words."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_id"),
        F.concat(F.lit("r"), (F.col("user_id") % 10).cast("string")).alias("repo"),
        F.struct(F.col("ts"), F.col("event_id")).alias("seq"),
        F.col("event_type").alias("w"),
    )


def part_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_partkey, path, name of every part."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat(F.col("p_type"), F.lit("/"), F.col("p_name"), F.lit("/"), (F.col("p_partkey") % 37).cast("string")).alias("path"),
        F.col("p_brand").alias("name"),
    )


def basket_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (doc, path, name): the parts of an order are its imports, their brands the names used."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_partkey")
    parts = part_imports(spark, sf_dir)
    return lines.join(parts, "l_partkey").select("doc", "path", "name").distinct()
