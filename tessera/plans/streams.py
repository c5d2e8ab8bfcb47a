"""Queries that run as streams over ``events``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.modelling import cache_sql, positions_sql
from tessera.plans.registration import query
from tessera.sources.storage import shared_dir
from tessera.sources.tables import table
from tessera.streaming import state

_ALL = "test AS (SELECT user_id AS file_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS w FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    return state.drained(stream, f"{base}/out", f"{base}/checkpoint")


@query(f"WITH {_ALL}, {positions_sql(3, 'test')}, {cache_sql('placed', '8')} SELECT file_id, event_id, pos, round(p_cache, 9) AS p_cache FROM cached")
def stream_cache_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _events(spark, sf_dir).select(F.col("user_id").alias("file_id"), "ts", "event_id", F.col("event_type").alias("w"))
    return _drained(spark, state.cache_stream(words, 8), "stream-cache").select("file_id", "event_id", "pos", F.round("p_cache", 9).alias("p_cache"))


@query("SELECT DISTINCT user_id, event_type, CAST(floor(value / 10) AS BIGINT) AS bin FROM events")
def stream_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _events(spark, sf_dir).select("ts", "user_id", "event_type", F.floor(F.col("value") / 10).alias("bin"))
    kept = state.first_within(keyed, ["user_id", "event_type", "bin"], "ts", "60 days")
    return _drained(spark, kept, "stream-dedup").select("user_id", "event_type", "bin")
