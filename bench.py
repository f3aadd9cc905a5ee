"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) and ``BENCH_CPUS`` (default 8).
Each query is run once to warm up and then timed once, from building the query to
the last row; rows are computed and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession, functions as F  # noqa: E402

from weftline.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "corpus_scan_pruned",
    "byte_tokens",
    "word_tokens",
    "vocab_topk",
    "vocab_encode",
    "vocab_encode_join",
    "bpe_merges",
    "bpe_encode",
    "row_ordinal",
    "pack_batches",
    "pack_global",
    "pack_by_source",
    "rank_shards",
    "labels_mask",
    "slot_layout_image",
    "interleave_turns",
    "embedding_lookup",
    "catalogue_top1",
    "routed_rows",
    "mean_pool",
    "project_features",
    "unigram_perplexity",
    "corpus_bleu",
    "rouge_n",
    "rouge_l",
    "latency_stats",
    "consistency",
    "loss_summary",
    "corpus_profile",
    "stream_encode",
    "stream_pack",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        # Ids are made after the shuffles of short texts, so keep small partitions apart.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        run(name)
        seconds[name] = round(run(name), 3)

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") + 1).alias("ids")).first()
    rates = {}
    if "pack_batches" in seconds:
        rates["packed_ids_per_s"] = round(size["ids"] / seconds["pack_batches"])
    if "vocab_encode" in seconds:
        rates["encoded_docs_per_s"] = round(size["n"] / seconds["vocab_encode"])
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rates": rates,
                "sf": float(Path(sf_dir).name.removeprefix("sf")),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
