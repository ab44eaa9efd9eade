"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the
input and the local parallelism; BENCH_QUERIES (comma separated) and BENCH_RUNS
(default 2, the best run counts) narrow or repeat the run.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "a6_layer_value_stats",
    "a12_dimension_moments",
    "a13_class_centroids",
    "a14_centroid_cosine",
    "a15_silhouette_exact",
    "a16_silhouette_scalable",
    "a20_bag_of_words",
    "a21_tfidf_totals",
    "a22_tfidf_by_class",
    "a24_box_stats",
    "a32_density_estimate",
    "e6_classification_report",
    "e12_confusion_top_k",
    "e13_summary_table",
    "e14_paired_t_test",
    "f1_clean_text_keep_punct",
    "f2_clean_text_alnum",
    "f11_tfidf",
    "f13_lexicon_sentiment",
    "f23_standardize",
    "j2_align_with_truncation",
    "m1_encode_layers",
    "m2_layer_probe_logistic",
    "m9_bce_with_logits",
    "u1_union_splits",
    "u2_dedup_rows",
    "w1_assign_row_id",
    "w6_stratified_split",
    "a30_batch_throughput",
    "a7_layer_value_median",
    "a8_file_global_stats",
    "j7_class_distances",
    "m13_project_2d",
    "s3_read_layer_vectors",
    "s9_write_layer_vectors",
    "r1_stream_ingest_batches",
    "r2_stream_layer_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from layerlab.queries import QUERIES

    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("max(length(text))").collect()
    seconds = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
