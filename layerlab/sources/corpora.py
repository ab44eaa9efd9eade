"""Readers for the labelled corpora (CSV) with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerlab.functions.fixed_values import SURVEY_FIELDS

LABELLED_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("text", "labels", "id")]
)
SURVEY_TEXT = {"MYKEY", "SIT", "STATE"}
SURVEY_SCHEMA = T.StructType(
    [
        T.StructField(c, T.StringType() if c in SURVEY_TEXT else T.IntegerType())
        for c in SURVEY_FIELDS
    ]
)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """One labelled CSV (text, labels, id) with `src_pos`, an increasing row position."""
    return (
        spark.read.schema(LABELLED_SCHEMA)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
        .withColumn("src_pos", F.monotonically_increasing_id())
    )


def read_labelled_splits(spark: SparkSession, train: str, test: str, validation: str) -> DataFrame:
    """The three splits under one schema, marked by `split` and `split_ord`."""
    paths = {"train": train, "test": test, "validation": validation}
    parts = [
        read_labelled(spark, path).withColumn("split", F.lit(name)).withColumn("split_ord", F.lit(i))
        for i, (name, path) in enumerate(paths.items())
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_survey(
    spark: SparkSession, path: str, delimiter: str = "|", schema: T.StructType = SURVEY_SCHEMA
) -> DataFrame:
    """Pipe-separated survey; anything beyond the declared columns is dropped."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", delimiter)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
