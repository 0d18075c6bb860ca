"""Benchmark the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints ONE JSON line:

    {"metric": "total_query_seconds", "value": N, "unit": "sec",
     "queries": {"q": sec, ...}, "sf": "..."}

Each query is executed fully through the ``noop`` sink (every row is
produced, nothing is collected to the driver) after one warm-up pass of the
JVM.  ``$BENCH_QUERIES`` (comma separated) restricts the set.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "calibration_table_margin", "ece_binary_big", "roc_auc_big", "average_precision_big",
    "evaluate_binary", "evaluate_multiclass", "roc_auc_ovo", "bin_mae", "pearson_spearman",
    "vocab_size_by_lang", "distinct_2", "distinct_3", "ngram_freq_min2", "clean_text",
    "mean_cosine", "intra_inter_cosine", "intra_inter_cosine_x100", "multilabel_cosine",
    "sample_n", "undersample", "bootstrap_weights", "bootstrap_50_trials", "kfold_assign",
    "few_shot_positions",
    "threshold_sweep", "select_by_index",
    "soft_lr_summary", "standard_lr_cv", "gce_lr_summary", "stream_ingest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from softlab.plans import REGISTRY
    from softlab.session import local_session

    wanted = os.environ.get("BENCH_QUERIES")
    names = [n for n in (wanted.split(",") if wanted else HEADLINE) if n in REGISTRY]
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", "16")),
                          app="softlab-bench")
    # warm-up: JVM, codegen caches, parquet footers
    REGISTRY["ece_binary"].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        try:
            REGISTRY[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001 - report and continue
            print(f"# {name} failed: {type(e).__name__}: {str(e)[:200]}", file=sys.stderr)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "n_queries": len(times)}))
    spark.stop()


if __name__ == "__main__":
    main()
