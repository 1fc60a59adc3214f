"""Headline queries on the shared tables; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vectorloom.plans import suite  # noqa: E402
from vectorloom.session import build_session  # noqa: E402

HEADLINE = (
    "alg31_coverage_counts", "alg8_neighbors_euclidean", "alg8_neighbors_cosine", "fv2_moments", "fv3_quantiles", "fv8_status",
    "win1_user_steps", "win5_event_threshold", "alg1_pca", "alg5_kernel_spectrum", "alg19_knn_outliers", "alg20_lof",
    "alg23_feature_pairs_pearson", "alg23_feature_pairs_spearman", "alg37_drift", "alg35_mantel_spearman", "smp2_fps",
    "alg14_kmeans", "alg15_dbscan", "agg10_health_counts", "join10_contacts", "join11_duplicates", "agg6_histogram",
    "gen11_coverage_gain", "str2_stream_histogram",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(f"local[{cpus}]", "bench", max(8, int(cpus)))
    spark.sparkContext.setLogLevel("ERROR")
    queries = suite.queries()
    # One small pass first, so the figures are of queries and not of start-up.
    queries["fv1_finite_counts"](spark, sf_dir).collect()
    queries["alg9_similarity_cosine"](spark, sf_dir).collect()
    queries["alg8_neighbors_manhattan"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    spark.stop()
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))


if __name__ == "__main__":
    main()
