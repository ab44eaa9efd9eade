"""Batch files of layer vectors: `{model}_{dataset}_{batch}.json`.

A batch is either one JSON file or a directory of that name holding the part
file Spark wrote. Files are whole JSON arrays of `{"layer_0": [...], ...}`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "array<map<string,array<double>>>"
COMBINED_PREFIX = "all_hidden_states"


def logical_file_name(path: Column) -> Column:
    """File name of a batch, for a file or a `file=<name>` directory."""
    return F.regexp_extract(path, r"([^/=]+\.json)(?:/[^/]*)?$", 1)


def parse_file_name(name: Column) -> dict[str, Column]:
    """model = first token, dataset = middle tokens, batch_idx = last token."""
    tokens = F.split(F.regexp_replace(name, r"\.json$", ""), "_")
    n = F.size(tokens)
    return {
        "model": F.get(tokens, F.lit(0)),
        "dataset": F.when(n > 2, F.array_join(F.slice(tokens, 2, n - 2), "_")).otherwise(""),
        "batch_idx": F.element_at(tokens, -1).try_cast("int"),
    }


def filter_files(files: DataFrame, name: str = "file_name", exclude_prefix: str = COMBINED_PREFIX) -> DataFrame:
    """`.json` files except combined ones."""
    keep = F.col(name).endswith(".json") & ~F.col(name).startswith(exclude_prefix)
    return files.filter(keep)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Names and sizes of batch files; contents are not read."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(logical_file_name(F.col("path")).alias("file_name"), F.col("length").alias("bytes"))
    )
    return filter_files(found.filter(F.col("file_name") != ""))


def list_batches(spark: SparkSession, path: str, model: str | None = None, dataset: str | None = None) -> DataFrame:
    """Batches of a model and dataset with their number as int."""
    files = list_files(spark, path)
    files = files.withColumns(parse_file_name(F.col("file_name")))
    if model is not None:
        files = files.filter(F.col("model") == model)
    if dataset is not None:
        files = files.filter(F.col("dataset") == dataset)
    return files.filter(F.col("batch_idx").isNotNull())


def _raw(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    named = text.select(
        logical_file_name(F.col("_metadata.file_path")).alias("file_name"), "value"
    )
    named = filter_files(named.filter(F.col("file_name") != ""))
    return named.withColumns(parse_file_name(F.col("file_name")))


def parse_records(raw: DataFrame) -> DataFrame:
    """File text -> one row per sample with `pos` and the map `layers`."""
    keep = [c for c in raw.columns if c != "value"]
    return raw.select(*keep, F.posexplode(F.from_json("value", RECORDS)).alias("pos", "layers"))


def unreadable() -> Column:
    """A file text that is not a JSON array of records, or has one that is none."""
    parsed = F.from_json("value", RECORDS)
    return parsed.isNull() | F.exists(parsed, lambda r: r.isNull())


def read_layer_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Samples of all batch files; unreadable files give no rows (see bad_files)."""
    return parse_records(_raw(spark, path).filter(~unreadable()))


def bad_files(spark: SparkSession, path: str) -> DataFrame:
    """Batch files that are not a JSON array of records."""
    return _raw(spark, path).filter(unreadable()).select("file_name", F.lit("not a list of layer records").alias("reason"))


def limit_batches(df: DataFrame, max_batches: int) -> DataFrame:
    """Batches 0 .. max_batches-1 by number; prunes partitions or row groups."""
    return df.filter(F.col("batch_idx") < max_batches)


def limit_samples(df: DataFrame, n: int, sample: str = "sample_id") -> DataFrame:
    """The first n samples of the dense 0-based sample id."""
    return df.filter(F.col(sample) < n)


def count_samples(samples: DataFrame, keys: list[str], per_file: int = 16) -> DataFrame:
    """Files, estimate (files x per_file) and exact count."""
    files = samples.groupBy(*keys, "batch_idx").agg(F.count(F.lit(1)).alias("_n"))
    return files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_files"),
        (F.count(F.lit(1)) * per_file).alias("estimated_samples"),
        F.sum("_n").alias("n_samples"),
    )


def batch_sizes(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Samples per batch file."""
    return samples.groupBy(*keys, "batch_idx").agg(F.count(F.lit(1)).alias("n_samples"))


def preview(
    samples: DataFrame, n_rows: int, n_keys: int, n_values: int, sample: str = "sample_id", layers: str = "layers"
) -> DataFrame:
    """First samples, first layer names, first values; with the full vector length."""
    first = samples.orderBy(sample).limit(n_rows)
    names = F.slice(F.sort_array(F.map_keys(layers)), 1, n_keys)
    rows = first.select(sample, layers, F.explode(names).alias("name"))
    vec = F.element_at(layers, F.col("name"))
    return rows.select(
        sample,
        "name",
        F.size(vec).alias("length"),
        F.posexplode(F.slice(vec, 1, n_values)).alias("idx", "value"),
    )
