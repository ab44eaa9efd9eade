"""Corpora from files to cleaned, labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerlab.functions import labels as L
from layerlab.functions import text as X
from layerlab.functions.fixed_values import EMOTICONS, EMOTIONS
from layerlab.operators.tables import dedup_rows, union_splits
from layerlab.sources.corpora import read_labelled, read_survey


def load_labelled(spark: SparkSession, train: str, test: str, validation: str) -> DataFrame:
    """Union of the splits in the order train, test, validation, without repeats.

    Rows equal in text, labels and id count as repeats; the first one stays
    and keeps its row id, so ids have gaps where repeats were.
    """
    paths = {"train": train, "test": test, "validation": validation}
    parts = {name: read_labelled(spark, path) for name, path in paths.items()}
    union = union_splits(parts, "src_pos").drop("src_pos")
    # row id and split travel as one long, which keeps the aggregate hash-based
    names = list(paths)
    code = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("split")) - 1
    packed = union.select("text", "labels", "id", (F.col("row_id") * len(names) + code).alias("_row"))
    return dedup_rows(packed, "_row").select(
        F.floor(F.col("_row") / len(names)).alias("row_id"),
        F.get(F.array(*[F.lit(n) for n in names]), (F.col("_row") % len(names)).cast("int")).alias("split"),
        "text",
        "labels",
        "id",
    )


def labelled_corpus(
    spark: SparkSession,
    train: str,
    test: str,
    validation: str,
    table: dict[str, str] = EMOTICONS,
    emoji: dict[str, str] | None = None,
) -> DataFrame:
    """(row_id, split, clean_text, labels): sentence marks kept, labels as text.

    `emoji` maps symbols to names, as `emoji_names_by_rule()` does; without it they
    are dropped with the other marks.
    """
    rows = load_labelled(spark, train, test, validation)
    clean = X.clean_text_keep_punct(F.col("text"), table, emoji)
    return rows.select("row_id", "split", clean.alias("clean_text"), "labels")


def labelled_classes(spark: SparkSession, train: str, test: str, validation: str) -> DataFrame:
    """(row_id, split, clean_text, labels, one 0/1 column per class, dominant_emotion).

    Text is only lower-cased, labels are parsed, the dominant class is the
    lowest id present.
    """
    rows = load_labelled(spark, train, test, validation)
    parsed = rows.withColumn("labels", L.parse_label_list(F.col("labels")))
    names = F.array(*[F.lit(e) for e in EMOTIONS])
    return parsed.select(
        "row_id",
        "split",
        X.lower_text(F.col("text")).alias("clean_text"),
        "labels",
        *L.multi_hot_columns(F.col("labels"), EMOTIONS),
        F.get(names, L.dominant_label(F.col("labels"))).alias("dominant_emotion"),
    )


def survey_corpus(
    spark: SparkSession,
    path: str,
    table: dict[str, str] = EMOTICONS,
    emoji: dict[str, str] | None = None,
) -> DataFrame:
    """(row_id, clean_text, labels): survey texts with their emotion code.

    The row id grows in file order; repeats over all columns are dropped.
    `emoji` as in labelled_corpus.
    """
    rows = read_survey(spark, path).withColumn("row_id", F.monotonically_increasing_id())
    first = dedup_rows(rows, "row_id")
    clean = X.clean_text_alnum(F.col("SIT"), table, emoji)
    return first.select("row_id", clean.alias("clean_text"), F.col("EMOT").alias("labels"))
