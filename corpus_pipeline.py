"""The document pipeline: judge quality, drop near copies, decontaminate, mix, shard.

Every stage reads all that the one before it kept, as Parquet in the shared
folder, and its decisions take effect. A stage's result is to be written before
the next stage is called, which first deletes the tables that earlier stages
wrote on the way, but for those that its ``docs`` still read.

Defined results for odd input, by stage: a null or empty text is judged by the
classifier like any other, is a copy of other such texts, is never contaminated,
and has no words, so that the mix leaves it out; null and equal ids are told
apart row by row; equal rows are copies, of which one stays; ties fall as the
operators say; a text of any length is read whole; an empty table stays empty
through all stages; all columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, nearcopies, quality, sharding
from tessera.llm.shared import collected, cut, remove


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, Jaccard 0.8), the one with the least id."""
    return nearcopies.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents in the mix, in order of virtual finish time."""
    return mixing.mix(docs).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All copies with their shard and slot."""
    return sharding.with_shards(docs)


_left: list[str] = []


def _swept(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage``, called after the tables that earlier stages left are deleted."""

    @wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for f in docs.inputFiles()}
        kept = [p for p in _left if p.split(":", 1)[-1].lstrip("/") in read]
        for path in set(_left) - set(kept):
            remove(spark, path)
        collected()
        out = stage(spark, docs, sf_dir)
        _left[:] = kept + collected()
        return out

    return call


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", _swept(keep_good)),
    ("near_dedup", _swept(drop_near_copies)),
    ("decontamination", _swept(decontaminated)),
    ("mixing", _swept(mixed)),
    ("sharding", _swept(sharded)),
]

#: Components of near copies and a fitted classifier have no SQL form; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
