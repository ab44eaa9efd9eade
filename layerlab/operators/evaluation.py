"""Classifier evaluation over prediction tables.

Single-label metrics all come from `confusion_counts`: one grouped count of
the predictions, after which only (classes x classes) rows remain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerlab.plans.ordering import null_safe_join


def confusion_counts(df: DataFrame, keys: Sequence[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """(keys, y, yhat, n) for the pairs that occur."""
    return df.groupBy(*keys, F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(
        F.count(F.lit(1)).alias("n")
    )


def accuracy(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of y = yhat."""
    hit = F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0))
    return counts.groupBy(*keys).agg((hit / F.sum("n")).alias("accuracy"))


def class_scores(counts: DataFrame, keys: Sequence[str], classes: int | None = None) -> DataFrame:
    """Per class: tp, support, predicted, precision, recall, f1 (0 on zero division).

    Classes are those in y or yhat; with `classes` also every id below it.
    """
    same = F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("s"), zero.alias("p"), same.cast("long").alias("t")),
        F.struct(F.col("yhat").alias("class"), zero.alias("s"), F.col("n").alias("p"), zero.alias("t")),
    )
    parts = counts.select(*keys, F.inline(sides))
    if classes is not None:
        domain = F.explode(F.sequence(F.lit(0), F.lit(classes - 1)))
        empty = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(
            *keys, domain.alias("class"), zero.alias("s"), zero.alias("p"), zero.alias("t")
        )
        parts = parts.unionByName(empty)
    sums = parts.groupBy(*keys, "class").agg(
        F.sum("t").alias("tp"), F.sum("s").alias("support"), F.sum("p").alias("predicted")
    )
    return (
        sums.withColumn("precision", _ratio(F.col("tp"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("tp"), F.col("support")))
        .withColumn("f1", _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")))
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def classification_report(counts: DataFrame, keys: Sequence[str], classes: int = 28) -> DataFrame:
    """Rows per class plus `accuracy`, `macro avg` and `weighted avg`."""
    scores = class_scores(counts, keys, classes).withColumn("_in", F.col("class").between(0, classes - 1))
    scores = scores.filter("_in")
    rows = scores.select(*keys, F.col("class").cast("string").alias("row"), "precision", "recall", "f1", "support")
    total = F.sum("support")

    def weighted(c: str) -> Column:
        return F.when(total == 0, 0.0).otherwise(F.sum(F.col(c) * F.col("support")) / total)

    macro = scores.groupBy(*keys).agg(
        F.lit("macro avg").alias("row"),
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
        total.alias("support"),
    )
    weigh = scores.groupBy(*keys).agg(
        F.lit("weighted avg").alias("row"),
        *[weighted(c).alias(c) for c in ("precision", "recall", "f1")],
        total.alias("support"),
    )
    acc = scores.groupBy(*keys).agg(
        F.lit("accuracy").alias("row"),
        *[_ratio(F.sum("tp"), total).alias(c) for c in ("precision", "recall", "f1")],
        total.alias("support"),
    )
    return rows.unionByName(acc).unionByName(macro).unionByName(weigh)


def macro_f1(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return class_scores(counts, keys).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))


def weighted_f1(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    total = F.sum("support")
    return class_scores(counts, keys).groupBy(*keys).agg(
        (F.sum(F.col("f1") * F.col("support")) / total).alias("weighted_f1")
    )


def confusion_matrix(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts over the sorted union of classes, zeros filled; percent of the true class."""
    both = F.array(F.col("y"), F.col("yhat"))
    classes = (
        counts.select(*keys, F.explode(both).alias("_c"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set("_c")).alias("_all"))
    )
    cells = classes.select(*keys, "_all", F.explode("_all").alias("y")).select(
        *keys, "y", F.explode("_all").alias("yhat")
    )
    filled = null_safe_join(cells, counts, [*keys, "y", "yhat"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )
    return filled.withColumn("percent", row_percent("n", [*keys, "y"]))


def row_percent(value: str, keys: Sequence[str]) -> Column:
    """100 * value / sum over the key; 0 for an empty key (one row per class)."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return F.when(total == 0, 0.0).otherwise(F.lit(100.0) * F.col(value) / total)


def confusion_top_k(counts: DataFrame, keys: Sequence[str], k: int = 10) -> DataFrame:
    """Confusion matrix (percentages over all classes) cut to the k largest true classes."""
    support = counts.groupBy(*keys, "y").agg(F.sum("n").alias("_s"))
    rank = F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("_s"), "y"))
    top = support.withColumn("_r", rank).filter(F.col("_r") <= k).select(*keys, F.col("y").alias("_t"))
    matrix = confusion_matrix(counts, keys)
    for axis in ("y", "yhat"):
        side = top.withColumnRenamed("_t", axis)
        matrix = matrix.join(side, [*keys, axis], "left_semi")
    return matrix


def depth_one_matrix(scores: DataFrame, layers: Sequence[int], depth: int = 0, value: str = "f1") -> DataFrame:
    """Class x layer matrix of a per-class score at one probe depth."""
    picked = scores.filter(F.col("depth") == depth)
    return picked.groupBy("class").pivot("layer", list(layers)).agg(F.first(value))


def summary_table(counts: DataFrame, silhouette: DataFrame) -> DataFrame:
    """One row per layer: accuracies, test F1s and silhouette of the test rows."""
    acc = accuracy(counts, ["layer", "split"])
    test = counts.filter(F.col("split") == "test")
    parts = acc.groupBy("layer").agg(
        F.max(F.when(F.col("split") == "train", F.col("accuracy"))).alias("train_accuracy"),
        F.max(F.when(F.col("split") == "test", F.col("accuracy"))).alias("test_accuracy"),
    )
    f1 = class_scores(test, ["layer"]).groupBy("layer").agg(
        F.avg("f1").alias("test_macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("test_weighted_f1"),
    )
    return (
        parts.join(f1, "layer", "left")
        .join(silhouette.select("layer", "silhouette"), "layer", "left")
        .select(
            "layer", "train_accuracy", "test_accuracy", "test_macro_f1", "test_weighted_f1",
            F.col("silhouette").alias("silhouette_score"),
        )
        .orderBy("layer")
    )


# ---- multi-label -------------------------------------------------------------


def bit_mismatches(bits: Column, pred: Column) -> Column:
    """Positions at which the two 0/1 arrays differ."""
    return F.aggregate(
        F.zip_with(bits, pred, lambda a, b: (a != b).cast("int")), F.lit(0), lambda acc, v: acc + v
    )


def multilabel_metrics(df: DataFrame, keys: Sequence[str], bits: str = "bits", pred: str = "pred") -> DataFrame:
    """exact_match, per_label_accuracy and hamming_loss in one pass."""
    wrong = bit_mismatches(F.col(bits), F.col(pred))
    marked = df.select(*keys, wrong.alias("_w"), F.size(bits).alias("_c"))
    share = F.sum("_w") / F.sum("_c")
    return marked.groupBy(*keys).agg(
        F.avg((F.col("_w") == 0).cast("double")).alias("exact_match"),
        (1.0 - share).alias("per_label_accuracy"),
        share.alias("hamming_loss"),
    )


def per_class_prf(df: DataFrame, keys: Sequence[str], bits: str = "bits", pred: str = "pred") -> DataFrame:
    """tp, fp, fn, precision, recall, f1 per label, 1e-8 in the denominators."""
    cells = df.select(*keys, F.posexplode(F.arrays_zip(F.col(bits).alias("b"), F.col(pred).alias("p"))).alias("label", "_z"))
    b, p = F.col("_z.b"), F.col("_z.p")
    sums = cells.groupBy(*keys, "label").agg(
        F.sum(b * p).alias("tp"), F.sum((1 - b) * p).alias("fp"), F.sum(b * (1 - p)).alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scored = sums.withColumn("precision", tp / (tp + fp + 1e-8)).withColumn("recall", tp / (tp + fn + 1e-8))
    pr, rc = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", 2 * (pr * rc) / (pr + rc + 1e-8))


def micro_f1(df: DataFrame, keys: Sequence[str], bits: str = "bits", pred: str = "pred") -> DataFrame:
    """F1 over pooled tp, fp, fn; sums are taken inside each row first."""

    def row_sum(f) -> Column:
        return F.aggregate(F.zip_with(bits, pred, f), F.lit(0), lambda acc, v: acc + v)

    rows = df.select(
        *keys,
        row_sum(lambda b, p: b * p).alias("_tp"),
        row_sum(lambda b, p: b + p).alias("_all"),
    )
    tp, total = F.sum("_tp"), F.sum("_all")
    return rows.groupBy(*keys).agg(
        F.when(total == 0, 0.0).otherwise(2.0 * tp / total).alias("micro_f1")
    )


# ---- losses over a table -----------------------------------------------------


def mean_element_loss(df: DataFrame, keys: Sequence[str], elements: Column, out: str = "loss") -> DataFrame:
    """Mean over all n x C element losses."""
    rows = df.select(
        *keys,
        F.aggregate(elements, F.lit(0.0), lambda a, v: a + v).alias("_s"),
        F.size(elements).alias("_c"),
    )
    return rows.groupBy(*keys).agg((F.sum("_s") / F.sum("_c")).alias(out))


def sum_element_loss(df: DataFrame, keys: Sequence[str], elements: Column, out: str = "loss") -> DataFrame:
    rows = df.select(*keys, F.aggregate(elements, F.lit(0.0), lambda a, v: a + v).alias("_s"))
    return rows.groupBy(*keys).agg(F.sum("_s").alias(out))


def weighted_mean_loss(df: DataFrame, keys: Sequence[str], row_loss: Column, weight: Column, out: str = "loss") -> DataFrame:
    """sum(w * loss) / sum(w)."""
    rows = df.select(*keys, row_loss.alias("_l"), weight.alias("_w"))
    return rows.groupBy(*keys).agg((F.sum(F.col("_l") * F.col("_w")) / F.sum("_w")).alias(out))


def mean_row_loss(df: DataFrame, keys: Sequence[str], row_loss: Column, out: str = "loss") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(row_loss).alias(out))
