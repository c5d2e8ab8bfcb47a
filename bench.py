"""Headline queries, timed one after another: prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores of local mode, BENCH_QUERIES
(comma-separated) other queries than the headline ones.
"""

import json
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "fold_totals", "lex_tokens", "vocab_build", "exact_dups", "minhash_sig", "lsh_pairs", "ngram_repos", "mkn_probs_o2", "lm_perplexity", "mixed_perplexity",
    "list_features", "rank_metrics", "pair_counts", "name_prior", "rank_imports", "pretoken_counts", "pack_flat", "threshold_table", "secret_scan", "cache_perplexity",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="tessera-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.checkpoint.dir", shared).config("spark.sql.files.maxPartitionBytes", "8m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tessera.plans.registry import QUERIES

    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark.range(1_000_000).selectExpr("sum(id % 7)").collect()  # starts the executor and compiles once
    took = {}
    try:
        for name in names:
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
            for part in Path(shared).glob("*/*"):
                shutil.rmtree(part, ignore_errors=True)
    finally:
        spark.stop()
        shutil.rmtree(shared, ignore_errors=True)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
