"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores (default 8). Each query is run
once unmeasured, so that code generation and class loading are not counted, then timed; every row and
every column is computed, by a hash over the whole result.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from gatesift.plans import registry
from gatesift.session import build_session

HEADLINES = os.environ.get("BENCH_QUERIES", "").split() or [
    "sanitize_content", "match_ioc", "match_literals", "detect_secrets", "detect_prompt_injection", "detect_xss",
    "detect_sql_injection", "anomaly_score", "scan_compliance", "redact_basic", "regulated_by_label", "scan_poisoning",
    "validate_resource_uri", "request_summary", "rps", "latency_percentiles", "token_bucket", "replay", "recon_rate",
    "task_concurrency", "overall_threat", "anomaly_ewma", "tool_shadowing", "tool_drift", "name_confusion", "verify_audit",
]


def force(df) -> None:
    """Computes the whole result without bringing it to the driver."""
    df.agg(F.count("*"), F.bit_xor(F.xxhash64(*df.columns))).collect()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.driver.memory": "20g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": cpus,
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    times = {}
    for name in HEADLINES:
        force(queries[name](spark, sf_dir))
        start = time.perf_counter()
        force(queries[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(json.dumps({
        "metric": "total time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "documents": documents,
        "documents_per_sec": {
            n: round(documents / times[n]) for n in ("sanitize_content", "scan_compliance", "match_literals") if n in times
        },
    }))
    spark.stop()


if __name__ == "__main__":
    main()
