"""Times the headline queries: one JSON line with seconds for each."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = HERE + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = (
    "edge_dedup", "neighbors_out_2hop", "impact_by_hop", "callchain_subgraph", "bm25_top30", "card_lane", "rrf_fusion",
    "hybrid_search", "vector_top30", "recall_mrr", "graph_expand_scores", "session_gate", "increment_plan", "retract_edges",
    "merkle_repo", "propagate_changes", "propagate_graph", "dependency_closure", "mechanism_inventory", "evidence_assembly", "paired_effect", "run_trace_legality", "events_tumbling", "text_windows",
)


def main() -> None:
    from heddle import registry
    from heddle.session import session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1", "spark.local.dir": scratch, "spark.sql.warehouse.dir": f"{scratch}/warehouse", "spark.checkpoint.dir": f"{scratch}/checkpoint",
    })
    spark.sparkContext.setLogLevel("ERROR")
    known = registry.queries()
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # warm-up
    took = {}
    for name in HEADLINE:
        spark.catalog.clearCache()  # nothing that an earlier query left serves a later one
        began = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
