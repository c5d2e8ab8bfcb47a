"""Stored models: a folder with a header and Parquet tables; text forms of trees and merges."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import bytepairs, trees
from tessera.operators.ngram import Model
from tessera.operators.ranking import schema_hash

VERSION = 1


def write(spark: SparkSession, path: str, kind: str, language: str, tables: dict[str, DataFrame], params: dict[str, str] | None = None, features: list[str] | None = None) -> None:
    """Write ``tables`` and a header with kind, language, parameters and the digest of the feature names."""
    header = {"version": VERSION, "kind": kind, "language": language, "params": params or {}, "features": features or [], "schema_hash": schema_hash(features or []), "tables": sorted(tables)}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(header),)], "value string").coalesce(1).write.text(f"{path}/header")


def header(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/header").first()["value"])


def read(spark: SparkSession, path: str, kind: str, features: list[str] | None = None) -> tuple[dict, dict[str, DataFrame]]:
    """Header and tables; another kind, version or feature schema is refused."""
    head = header(spark, path)
    if head["version"] != VERSION or head["kind"] != kind:
        raise ValueError(f"{path} holds {head['kind']} version {head['version']}, not {kind} version {VERSION}")
    if features is not None and head["schema_hash"] != schema_hash(features):
        raise ValueError(f"{path} was made for other features")
    return head, {t: spark.read.parquet(f"{path}/{t}") for t in head["tables"]}


def write_ngram(spark: SparkSession, path: str, model: Model, language: str) -> None:
    write(spark, path, "ngram", language, {"prob": model.prob, "backoff": model.backoff}, {"order": str(model.order)})


def read_ngram(spark: SparkSession, path: str) -> Model:
    head, tables = read(spark, path, "ngram")
    return Model(int(head["params"]["order"]), tables["prob"], tables["backoff"])


def write_lists(lists: DataFrame, path: str, features: list[str]) -> None:
    """Candidate lists by fold, with the digest of their features as column metadata."""
    known = lists.withMetadata(lists.columns[0], {"schema_hash": schema_hash(features)})
    known.write.partitionBy("fold").parquet(path)


def read_lists(spark: SparkSession, path: str, features: list[str], fold: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    stored = next((f.metadata["schema_hash"] for f in rows.schema if "schema_hash" in (f.metadata or {})), None)
    if stored != schema_hash(features):
        raise ValueError(f"{path} was made for other features")
    return rows.where(F.col("fold") == fold) if fold else rows


def trees_to_text(forest: list[trees.Tree]) -> str:
    """A forest as lines: a count, then per tree its size and one node a line."""
    out = [f"trees {len(forest)}"]
    for t in forest:
        out.append(f"tree {len(t)}")
        out += [f"{n.feature} {n.threshold!r} {int(n.default_left)} {n.missing} {n.left} {n.right} {n.value!r}" for n in t]
    return "\n".join(out) + "\n"


def trees_from_text(text: str) -> list[trees.Tree]:
    lines = iter(text.splitlines())
    forest = []
    for _ in range(int(next(lines).split()[1])):
        nodes = []
        for _ in range(int(next(lines).split()[1])):
            f, t, d, m, left, right, v = next(lines).split()
            nodes.append(trees.Node(int(f), float(t), d == "1", int(m), int(left), int(right), float(v)))
        forest.append(nodes)
    return forest


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file through Spark's writer, so any store works."""
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.text(path)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def write_vocabularies(spark: SparkSession, path: str, merges: bytepairs.Merges, sizes: list[int]) -> None:
    """One vocabulary per size: a prefix of the merges."""
    for n in sizes:
        write_text(spark, f"{path}/{n}", bytepairs.dump(merges[:n]))


def read_vocabulary(spark: SparkSession, path: str) -> tuple[bytepairs.Merges, list[str]]:
    return bytepairs.load(read_text(spark, path))


def write_shards(encoded: DataFrame, path: str) -> None:
    """Packed token values by fold (file_id, repo, fold, raw)."""
    encoded.write.partitionBy("fold").parquet(path)


def read_shards(spark: SparkSession, path: str, fold: str) -> DataFrame:
    """file_id, repo, pos, id, line_start, at_line_end of a fold; only its folder is scanned."""
    rows = spark.read.parquet(path).where(F.col("fold") == fold)
    each = rows.select("file_id", "repo", F.posexplode("raw").alias("pos", "v"))
    return each.select("file_id", "repo", "pos", F.shiftright("v", 2).cast("int").alias("id"), (F.col("v").bitwiseAND(1) == 1).alias("line_start"), (F.col("v").bitwiseAND(2) == 2).alias("at_line_end"))


def run_once(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``, built and written only if it is not there: a stage that resumes."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
