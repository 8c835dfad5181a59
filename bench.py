"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

python bench.py [--all] [--runs N]
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_lean_report", "g1_ledger_check", "e1_paired_contrast", "e6_item_and_cluster_limits", "e12_auc", "e36_regime_comparison",
    "e27_crossed_anova", "c2_signature", "c7_bootstrap_signatures", "d1_multiplicative_score", "d3_many_templates", "d6_peak_energy",
    "d11_nearest_reference", "d20_split_overlap", "f1_sign_flip", "f2_label_permutation", "f6_hierarchical_bootstrap",
    "f11_closed_set_attribution", "b1_guarded_splits", "a4_content_dedup", "g10_job_activity",
]


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--all", action="store_true", help="every registered query")
    ap.add_argument("--runs", type=int, default=1, help="keep the fastest of this many runs")
    args = ap.parse_args()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from contrapair.plans import catalog
    from contrapair.session import local_session

    spark = local_session(cpus, max(8, cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    names = list(queries) if args.all else HEADLINE

    def run(name: str) -> float:
        t = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - t

    run("e4_adapter_statistics")  # start the JVM's warm-up outside the clock
    seconds = {n: round(min(run(n) for _ in range(args.runs)), 3) for n in names}
    print(json.dumps({
        "metric": "headline queries, total seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
