"""Time the headline queries and print one JSON line.

Each query runs once to warm up (``BENCH_WARM=0`` skips that) and once timed. Every query is built and run from the parquet files; ``noop`` takes the rows, so that
all columns are computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from daydigest.session import build_session, staging
from suite.queries import QUERIES

HEADLINE = [
    "rank_bm25",
    "rank_rerank_colbert",
    "rank_rerank_t5",
    "rerank_maxsim",
    "eval_bertscore",
    "eval_rouge2",
    "run_digest",
    "agg_collection_stats",
    "agg_describe",
    "join_profile_chain",
    "text_tokenize",
    "text_porter_stem",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "20g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()

    def run(name: str) -> float:
        start = time.perf_counter()
        with staging(spark):
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        if os.environ.get("BENCH_WARM", "1") != "0":
            run(name)
        seconds[name] = round(run(name), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "documents_per_sec": {name: round(documents / s, 1) for name, s in seconds.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
