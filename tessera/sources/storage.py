"""Shared storage: where lineage is cut, so that a lost executor costs a reread."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode with the setting unset."""
    sc = spark.sparkContext
    set_already = sc._jsc.getCheckpointDir()
    if set_already.isPresent():
        return set_already.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessera-shared-")
    sc.setCheckpointDir(named)
    return sc._jsc.getCheckpointDir().get()


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to shared storage and read again."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
