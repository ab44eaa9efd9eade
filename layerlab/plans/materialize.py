"""Where intermediate data goes, and when a small side may be broadcast.

Lineage is cut with reliable checkpoints in the folder the cluster names in
`spark.checkpoint.dir`, so that a lost executor never loses results.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

INLINE_ROWS = 10_000
INLINE_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a local master."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        if not context.getCheckpointDir():
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="layerlab-"))
    return context.getCheckpointDir().rstrip("/")


_OWNERS: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made inside go to one folder, which is removed at the end.

    Results must be written, or collected, before the block ends; an intermediate
    table that is read later is gone.
    """
    path = f"{shared_dir(spark)}/layerlab/run-{uuid.uuid4().hex}"
    _OWNERS.append(path)
    try:
        yield path
    finally:
        _OWNERS.remove(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of the innermost `scratch`, or in the shared folder."""
    base = _OWNERS[-1] if _OWNERS else f"{shared_dir(spark)}/layerlab"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of `df` (eager)."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def via_parquet(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back; keeps column pruning."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute a scan that has fewer partitions than the cluster has cores.

    For work that is heavy per row on an input of few files; a large input has
    many partitions already and is returned unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    # hashing a hash: later aggregates by the key still exchange, and share it
    return df.repartition(cores, F.xxhash64(*keys)) if keys else df.repartition(cores)


def small_table(df: DataFrame, max_rows: int = INLINE_ROWS) -> pa.Table | None:
    """The rows of `df` if there are at most `max_rows` of INLINE_BYTES in all; else None.

    Rows are taken partition by partition until there are max_rows + 1, so a
    big side costs no more than that.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    table = pa.Table.from_pylist([r.asDict(recursive=True) for r in rows], to_arrow_schema(df.schema))
    return table if table.nbytes <= INLINE_BYTES else None


def inline_if_small(df: DataFrame, max_rows: int = INLINE_ROWS) -> DataFrame:
    """Evaluate a small side now and broadcast it if it is small (see small_table).

    A bigger side is returned unchanged and unhinted, so the join falls back to
    a shuffle join with adaptive skew handling.
    """
    rows = small_table(df, max_rows)
    return df if rows is None else local_side(df, rows)


def local_side(df: DataFrame, rows: pa.Table) -> DataFrame:
    """Rows read by small_table as a broadcast side with the schema of `df`."""
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
