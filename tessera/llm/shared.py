"""Cutting lineage in storage that every executor can reach."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``; a temporary one only where it is unset (tests)."""
    sc = spark.sparkContext
    base = sc._jsc.getCheckpointDir()
    if base.isPresent():
        return base.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tessera-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc._jsc.getCheckpointDir().get()


#: Seconds before a collection that has to free a large shuffle.
PAUSE = 1.0


def release(spark: SparkSession, pause: float = 0.0) -> None:
    """Let Spark drop the shuffle files of finished jobs that nothing refers to any more.

    Listeners refer to a job for a moment after its end, and what a first collection
    frees may be the last to refer to a shuffle; with a ``pause`` in seconds there are
    two collections, each after the pause.
    """
    for _ in range(2 if pause else 1):
        time.sleep(pause)
        gc.collect()
        spark._jvm.System.gc()


#: Tables written by ``cut`` since the last ``collected()``, by path; None while nobody asks.
_written: list[str] | None = None


def collected() -> list[str]:
    """Paths that ``cut`` has written since the last call, from the first call on."""
    global _written
    out, _written = _written or [], []
    return out


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a scan of it.

    A lost executor then costs a reread instead of a recomputation. What earlier
    jobs left is released first, so it does not lie beside this job's shuffle files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    release(spark)
    df.write.option("compression", "zstd").parquet(path)
    if _written is not None:
        _written.append(path)
    return spark.read.schema(schema).parquet(path)


#: Rows of a block of ``numbered``, as a power of two.
BLOCK_BITS = 18


def _block(key: str) -> Column:
    return F.shiftright(F.col(key), BLOCK_BITS)


def _buckets(spark: SparkSession) -> int:
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """``cut`` of ``df`` with a number of every row in ``key``, and that of its block in a column after it, for ``beside``.

    A block is what one task wrote, or 2 ** ``BLOCK_BITS`` rows of it. Blocks lie in one file each, or
    in few, dealt to as many buckets as there are shuffle partitions, so that what is known
    of the rows can come to them. Only a catalog tells Spark of buckets; the table leaves it at once.
    """
    spark = df.sparkSession
    path, table = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", f"tessera_{uuid.uuid4().hex}"
    rows = df.withColumn(key, F.monotonically_increasing_id())
    block = fresh(f"{key}_block", rows)
    release(spark)
    rows.withColumn(block, _block(key)).write.bucketBy(_buckets(spark), block).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(table)
    if _written is not None:
        _written.append(path)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name alone: files outside the warehouse stay
    return out


def beside(kept: DataFrame, slim: DataFrame, key: str) -> DataFrame:
    """``kept``, all of what ``numbered`` returned, with the columns that ``slim`` has for its rows.

    ``slim`` needs a row for every row of ``kept``, by ``key``. It is dealt by blocks to the
    tasks that read their files; a block's rows in order are one list, from which each
    row of ``kept`` takes its own. So the rows of ``kept`` are neither exchanged nor sorted.
    """
    block, held = kept.columns[-1], fresh(f"{key}_held", kept)
    names = [c for c in slim.columns if c != key]
    dealt = slim.withColumn(block, _block(key)).repartition(_buckets(kept.sparkSession), block)
    lists = dealt.groupBy(block).agg(F.array_sort(F.collect_list(F.struct(key, *names))).alias(held))
    at = F.col(key).bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")
    own = F.get(held, at)
    own = F.when(own[key] == F.col(key), own).otherwise(F.raise_error(F.lit("a row has nothing beside it")))
    joined = kept.join(lists.hint("shuffle_hash"), block, "left").withColumn(held, own)
    return joined.withColumns({c: F.col(held)[c] for c in names}).drop(block, held)


def discard(df: DataFrame) -> None:
    """Delete the tables that ``cut`` wrote and ``df`` scans; nothing may read them any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(spark, folder)


def fresh(name: str, df: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
