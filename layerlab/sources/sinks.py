"""Writers: layer vectors, batch files, summaries, trial logs, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIAL_SCHEMA = T.StructType(
    [
        T.StructField("trial_id", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("status", T.StringType()),
    ]
)


def storage_target(directory: str, base: str | None = None, device: str | None = None) -> str:
    """Path of the output folder, below an external base when one is given."""
    parts = [p.rstrip("/") for p in (base, device) if p]
    return "/".join([*parts, directory])


def safe_model_name(model: Column) -> Column:
    """Model name without slashes."""
    return F.replace(model, F.lit("/"), F.lit(""))


def write_layer_vectors(df: DataFrame, path: str, batches_per_file: int = 4096, mode: str = "append") -> None:
    """Long vectors as parquet by model, dataset and layer.

    Runs of batches are hashed to tasks and sorted, so a batch filter skips row
    groups and no task writes to more than a few folders; a directory per batch
    of 16 samples would not scale. Hashing, unlike range partitioning, does not
    run the (costly) input a second time for a sample.
    """
    keys = ["model", "dataset", "layer"]
    named = df.withColumn("model", safe_model_name(F.col("model")))
    run = F.floor(F.col("batch_idx") / batches_per_file)
    placed = named.repartition(*keys, run).sortWithinPartitions(*keys, "batch_idx")
    placed.write.mode(mode).partitionBy(*keys).parquet(path)


def batch_json(pos: str = "pos", layers: str = "layers") -> Column:
    """Aggregate: a batch's samples as one JSON array in position order."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.to_json(layers).alias("l"))))
    return F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["l"]), ","), F.lit("]"))


def write_batch_files(samples: DataFrame, path: str, pos: str = "pos", layers: str = "layers") -> None:
    """Interchange format: one JSON array per batch in `file=<model>_<dataset>_<batch>.json`.

    The format wants one array per batch, so a batch is one row; assign_batch gives
    batches a fixed number of samples.
    """
    name = F.concat_ws(
        "_", safe_model_name(F.col("model")), F.col("dataset"), F.col("batch_idx").cast("string")
    )
    batches = samples.groupBy("model", "dataset", "batch_idx").agg(batch_json(pos, layers).alias("value"))
    batches.select(F.concat(name, F.lit(".json")).alias("file"), "value").write.partitionBy("file").text(path)


def write_summary_csv(summary: DataFrame, path: str) -> None:
    """One CSV with header; the summary has one row per layer."""
    summary.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def append_trial_log(trials: DataFrame, path: str) -> None:
    """Append trial records (JSON lines); nothing already logged is rewritten."""
    trials.write.mode("append").json(path)


def read_trial_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRIAL_SCHEMA).json(path)


def save_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").parquet(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
