"""Incremental jobs over arriving batch files and vector tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerlab.functions.vectors import doubles
from layerlab.operators.tables import layer_number
from layerlab.sources.layer_files import RECORDS, filter_files, logical_file_name, parse_file_name


TABLE = (
    "batch_idx int, pos int, vec array<double>, file_path string, value string, "
    "kind string, ingest string, model string, dataset string, layer int"
)
PARTS = ["kind", "ingest", "model", "dataset", "layer"]
FILES_AT_ONCE = 10_000


def _named(raw: DataFrame) -> DataFrame:
    """(file_path, value, name parts) of whole text files that are batch files."""
    path = F.col("_metadata.file_path")
    files = raw.select(path.alias("file_path"), logical_file_name(path).alias("file_name"), "value")
    return filter_files(files).withColumns(parse_file_name(F.col("file_name"))).drop("file_name")


def _arriving(spark: SparkSession, path: str, max_files: int) -> DataFrame:
    """Streaming batch files that have not been read."""
    return _named(
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files)
        .load(path)
    )


def _rows(files: DataFrame) -> DataFrame:
    """Each file once: its samples as rows of kind `vectors`, or itself as kind `errors`.

    One pass reads and decides, so a file that is completed meanwhile is in one of
    the two. A file without samples gives no row.
    """
    parsed = files.withColumn("_records", F.from_json("value", RECORDS))
    bad = F.col("_records").isNull() | F.exists("_records", lambda r: r.isNull())
    marked = parsed.withColumn("kind", F.when(bad, "errors").otherwise("vectors"))
    wrong = F.col("kind") == "errors"
    nothing = F.create_map(F.lit("none"), F.lit(None).cast("array<double>"))
    samples = marked.select(
        "file_path", "model", "dataset", "batch_idx", "kind", F.when(wrong, F.col("value")).alias("value"),
        F.posexplode(F.when(wrong, F.array(nothing)).otherwise(F.col("_records"))).alias("pos", "layers"),
    )
    cells = samples.select("*", F.explode("layers").alias("_name", "vec"))
    return cells.withColumn("layer", F.when(~wrong, layer_number(F.col("_name")))).drop("layers", "_name")


def stream_batch_files(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Streaming samples of new batch files, long layout; unreadable files give none."""
    rows = _rows(_arriving(spark, path, max_files)).filter("kind = 'vectors'")
    return rows.select("model", "dataset", "batch_idx", "pos", "layer", "vec")


def _put(rows: DataFrame, table: str) -> None:
    """Write rows into the partitions of their ingest; doing it again replaces them."""
    columns = [f.split()[0] for f in TABLE.split(", ")]
    writer = rows.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*PARTS).parquet(table)


def ingest_batches(
    spark: SparkSession, path: str, table: str, checkpoint: str, max_files: int = 1000, start: int = 0
) -> None:
    """Append all batch files not seen before to `table`, then stop.

    One stream reads each file once and writes it to one place: its vectors
    (read_vectors), or, if it cannot be read, its path and text (read_errors). A micro
    batch writes partitions under its own number, so one that is run again after a
    crash replaces itself. Files among the errors of earlier calls are read again first.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(table)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        retry_errors(spark, path, table)

    def store(batch: DataFrame, number: int) -> None:
        _put(_rows(batch).withColumn("ingest", F.lit(f"batch-{number}")), table)

    query = (
        _arriving(spark, path, max_files)
        .filter(F.col("batch_idx") >= start)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(store)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _kind(spark: SparkSession, table: str, kind: str) -> DataFrame:
    return spark.read.schema(TABLE).parquet(table).filter(F.col("kind") == kind)


def read_vectors(spark: SparkSession, table: str) -> DataFrame:
    """(model, dataset, batch_idx, pos, layer, vec) of all files that could be read."""
    return _kind(spark, table, "vectors").select("model", "dataset", "batch_idx", "pos", "layer", "vec")


def read_errors(spark: SparkSession, table: str) -> DataFrame:
    """(file_path, file_name, value) of the files that could not be read, and have not been since."""
    settled = _kind(spark, table, "settled").select("file_path")
    errors = _kind(spark, table, "errors").join(settled, "file_path", "left_anti")
    return errors.select("file_path", logical_file_name(F.col("file_path")).alias("file_name"), "value")


def retry_errors(spark: SparkSession, path: str, table: str) -> int:
    """Read the files among the errors again; gives the number of those that are whole now.

    A file's vectors go to partitions under its own name, and after that it is marked as
    settled. A crash in between repeats this for the same file, in the same place.
    """
    paths = [r.file_path for r in read_errors(spark, table).select("file_path").distinct().collect()]
    own = F.concat(F.lit("file-"), F.md5("file_path"))
    found = 0
    for k in range(0, len(paths), FILES_AT_ONCE):
        some = paths[k : k + FILES_AT_ONCE]
        raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
        again = _named(raw.filter(F.col("_metadata.file_path").isin(some)))
        _put(_rows(again).filter("kind = 'vectors'").withColumn("ingest", own), table)
        names = spark.createDataFrame([(p,) for p in some], "file_path string").withColumn("ingest", own)
        written = _kind(spark, table, "vectors").filter(F.col("ingest").startswith("file-")).select("ingest").distinct()
        whole = [r.file_path for r in names.join(written, "ingest", "left_semi").collect()]
        if whole:
            marks = spark.createDataFrame([(p, "settled") for p in whole], "file_path string, kind string")
            rest = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in TABLE.split(", ") if c.split()[0] not in ("file_path", "kind", "ingest")}
            _put(marks.withColumns(rest).withColumn("ingest", own), table)
        found += len(whole)
    return found


def running_layer_stats(vectors: DataFrame, keys: Sequence[str] = ("layer",), vec: str = "vec") -> DataFrame:
    """Value statistics per key, kept up to date while vectors arrive.

    The state is one row per key; the deviation comes from Spark's own aggregate,
    which keeps its digits when values are far from zero.
    """
    values = vectors.select(*keys, F.explode(doubles(F.col(vec))).alias("_x"))
    return values.groupBy(*keys).agg(
        F.count("_x").alias("n_values"),
        F.avg("_x").alias("value_mean"),
        F.stddev_pop("_x").alias("value_std"),
        F.min("_x").alias("value_min"),
        F.max("_x").alias("value_max"),
    )


def stream_layer_stats(vectors: DataFrame, table: str, checkpoint: str, keys: Sequence[str] = ("layer",)) -> None:
    """Run running_layer_stats over all available input.

    Every micro batch writes a state of its own and then its number to the list of
    versions. A state that is written is never changed, so readers always find a
    whole one (latest_layer_stats).
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/state-{number}")
        done = batch.sparkSession.createDataFrame([(number,)], "version long")
        done.write.mode("append").parquet(f"{table}/versions")

    query = (
        running_layer_stats(vectors, keys)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest_layer_stats(spark: SparkSession, table: str) -> DataFrame:
    """The last state that stream_layer_stats has written in full."""
    last = spark.read.parquet(f"{table}/versions").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{table}/state-{last}")


def vector_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 1000) -> DataFrame:
    """Streaming read of a parquet vector table."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
