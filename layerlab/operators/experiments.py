"""Experiment bookkeeping: plans, grids, result keys, layer comparison, logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerlab.functions.fixed_values import TUNING_GRID, TUNING_LOSSES
from layerlab.functions.significance import student_t_two_sided_p
from layerlab.functions.vectors import neg_log10
from layerlab.operators.evaluation import multilabel_metrics
from layerlab.plans.ordering import running_sums


def experiment_plan(present: DataFrame, depths: Sequence[int]) -> DataFrame:
    """(model, dataset, layer) that exist x probe depths."""
    found = present.select("model", "dataset", "layer").distinct()
    return found.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths])))


def hyperparameter_grid(tasks: DataFrame, task: str = "task") -> DataFrame:
    """Every combination of the tuning grid for each row of `tasks`.

    Losses depend on the row's task; a combination the loss does not support is
    marked `unsupported`, not dropped.
    """
    out = tasks
    for name, values in TUNING_GRID.items():
        if name == "hidden_layers":
            items = [F.lit("[" + ", ".join(map(str, v)) + "]") for v in values]
        else:
            items = [F.lit(v) for v in values]
        out = out.withColumn(name, F.explode(F.array(*items)))
    by_task = F.when(
        F.col(task) == "multilabel", F.array(*[F.lit(x) for x in TUNING_LOSSES["multilabel"]])
    ).otherwise(F.array(*[F.lit(x) for x in TUNING_LOSSES["singlelabel"]]))
    out = out.withColumn("loss_function", F.explode(by_task))
    bad = (F.col(task) == "multilabel") & (F.col("loss_function") == "hinge")
    return out.withColumn("status", F.when(bad, "unsupported").otherwise("planned"))


def experiment_results(predictions: DataFrame, keys: Sequence[str], multilabel: bool = False) -> DataFrame:
    """acc and hamming loss per experiment, from rows of predictions.

    Single-label rows have `y` and `yhat`; multi-label rows `bits` and `pred`, with
    the share of rows that are right in all labels as acc.
    """
    if multilabel:
        scored = multilabel_metrics(predictions, keys)
        return scored.select(*keys, F.col("exact_match").alias("acc"), F.col("hamming_loss").alias("hamming"))
    right = F.avg((F.col("y") == F.col("yhat")).cast("double"))
    return predictions.groupBy(*keys).agg(right.alias("acc"), (1.0 - right).alias("hamming"))


def parse_result_key(key: Column) -> tuple[Column, Column]:
    """`layer_{i}_{d}HL` -> (layer, depth); nulls for other keys."""
    layer = F.regexp_extract(key, r"^[^_]*_(\d+)_(\d+)(?:HL)?(?:_.*)?$", 1).try_cast("int")
    depth = F.regexp_extract(key, r"^[^_]*_(\d+)_(\d+)(?:HL)?(?:_.*)?$", 2).try_cast("int")
    return layer, depth


def parse_experiment_key(key: Column) -> tuple[Column, Column]:
    """`model | dataset` -> both parts; anything else is (key, 'Unknown')."""
    parts = F.split(key, r" \| ")
    two = F.size(parts) == 2
    return (
        F.when(two, F.get(parts, F.lit(0))).otherwise(key),
        F.when(two, F.get(parts, F.lit(1))).otherwise(F.lit("Unknown")),
    )


def distinct_levels(results: DataFrame) -> DataFrame:
    """Layers and depths that occur, as (kind, level)."""
    pairs = results.select("layer", "depth").distinct()
    rows = F.array(
        F.struct(F.lit("layer").alias("kind"), F.col("layer").alias("level")),
        F.struct(F.lit("depth").alias("kind"), F.col("depth").alias("level")),
    )
    return pairs.select(F.inline(rows)).distinct().orderBy("kind", "level")


def mean_metric_by_layer(results: DataFrame, metrics: Sequence[str] = ("acc", "hamming")) -> DataFrame:
    """Mean over depths; nulls are ignored."""
    return results.groupBy("model", "dataset", "layer").agg(*[F.avg(m).alias(f"mean_{m}") for m in metrics])


def depth_pivot(results: DataFrame, depths: Sequence[int], metric: str = "acc") -> DataFrame:
    """Layers as rows, depths as columns; missing cells are null."""
    named = results.withColumn("_d", F.concat(F.lit("depth_"), F.col("depth").cast("string")))
    return (
        named.groupBy("model", "dataset", "layer")
        .pivot("_d", [f"depth_{d}" for d in depths])
        .agg(F.first(metric, ignorenulls=True))
    )


def axis_bounds(results: DataFrame, metric: str = "acc", padding: float = 0.05) -> DataFrame:
    """Plot limits: the range widened by the padding, kept in [0, 1]."""
    return results.groupBy("model", "dataset").agg(
        F.greatest(F.lit(0.0), F.min(metric) - padding).alias("y_min"),
        F.least(F.lit(1.0), F.max(metric) + padding).alias("y_max"),
    )


def layer_delta(by_layer: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Differences to the previous layer; the first layer has none.

    One row per layer in each window partition.
    """
    w = Window.partitionBy("model", "dataset").orderBy("layer")
    out = by_layer.withColumn("_prev", F.lag("layer").over(w))
    for m in metrics:
        out = out.withColumn(f"delta_{m}", F.col(m) - F.lag(m).over(w))
    return out.filter(F.col("_prev").isNotNull()).select(
        "model", "dataset", "layer", *[f"delta_{m}" for m in metrics]
    )


def adjacent_layers(results: DataFrame) -> DataFrame:
    """(model, dataset, layer, next_layer) over the layers that occur."""
    layers = results.select("model", "dataset", "layer").distinct()
    w = Window.partitionBy("model", "dataset").orderBy("layer")
    return layers.withColumn("next_layer", F.lead("layer").over(w)).filter(
        F.col("next_layer").isNotNull()
    )


def adjacent_layer_pairs(results: DataFrame, metric: str = "acc") -> DataFrame:
    """Metric of each layer next to that of the following layer, same depth."""
    keys = ["model", "dataset"]
    nxt = adjacent_layers(results)
    a = results.select(*keys, "layer", "depth", F.col(metric).alias("value"))
    b = results.select(*keys, F.col("layer").alias("next_layer"), "depth", F.col(metric).alias("next_value"))
    return a.join(nxt, [*keys, "layer"]).join(b, [*keys, "next_layer", "depth"]).select(
        *keys, "layer", "next_layer", "depth", "value", "next_value"
    )


def paired_t_test(pairs: DataFrame, depths: int = 5, level: float = 0.05) -> DataFrame:
    """Paired t-test over depths for each pair of adjacent layers.

    p is null when a depth is missing or the differences do not vary.
    """
    d = F.col("value") - F.col("next_value")
    grouped = pairs.groupBy("model", "dataset", "layer", "next_layer").agg(
        F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("_sd")
    )
    usable = (F.col("n") == depths) & (F.col("_sd") > 0)
    t = F.when(usable, F.col("mean_diff") / (F.col("_sd") / F.sqrt(F.col("n").cast("double"))))
    with_t = grouped.withColumn("t", t)
    with_p = with_t.withColumn("p", student_t_two_sided_p(F.col("t"), depths - 1))
    return (
        with_p.withColumn("neg_log10_p", neg_log10(F.col("p")))
        .withColumn("significant", F.col("p") < level)
        .drop("_sd")
    )


def rank_layers(results: DataFrame, metric: str = "value") -> DataFrame:
    """Ascending rank of all (model, dataset, layer); one row per experiment."""
    order = Window.orderBy(F.asc(metric), "model", "dataset", "layer")
    return results.withColumn("rank", F.row_number().over(order))


def best_trial(trials: DataFrame, keys: Sequence[str], multilabel: bool) -> DataFrame:
    """Lowest hamming loss (multi-label) or highest accuracy, ties by trial id."""
    if multilabel:
        order, metric = F.struct(F.col("hamming_loss"), F.col("trial_id")), "hamming_loss"
    else:
        order, metric = F.struct(-F.col("accuracy"), F.col("trial_id")), "accuracy"
    usable = trials.filter(F.col(metric).isNotNull())
    return usable.groupBy(*keys).agg(
        F.min_by("trial_id", order).alias("trial_id"), F.min_by(metric, order).alias(metric)
    )


def sort_trials(trials: DataFrame, metric: str, ascending: bool = False) -> DataFrame:
    """Trials ordered by a metric, ties by trial id, nulls last."""
    by = F.asc_nulls_last(metric) if ascending else F.desc_nulls_last(metric)
    return trials.orderBy(by, "trial_id")


# ---- logs --------------------------------------------------------------------


def mean_epoch_loss(log: DataFrame, keys: Sequence[str], loss: str = "loss") -> DataFrame:
    """Mean batch loss per epoch."""
    return log.groupBy(*keys, "epoch").agg(F.avg(loss).alias("mean_loss"))


def best_epoch(log: DataFrame, keys: Sequence[str], accuracy: str = "accuracy") -> DataFrame:
    """First epoch with the highest validation accuracy above 0."""
    seen = log.filter(F.col(accuracy) > 0)
    order = F.struct(-F.col(accuracy), F.col("epoch"))
    return seen.groupBy(*keys).agg(
        F.min_by("epoch", order).alias("best_epoch"), F.max(accuracy).alias("best_accuracy")
    )


def early_stop_epoch(log: DataFrame, keys: Sequence[str], loss: str = "mean_loss", patience: int = 10) -> DataFrame:
    """First epoch that ends `patience` epochs in a row without a new lowest loss.

    One row per epoch in each window partition; null when training never stops.
    """
    w = Window.partitionBy(*keys).orderBy("epoch")
    earlier = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    at = F.row_number().over(w)
    marked = log.withColumn("_at", at).withColumn(
        "_best", F.when(earlier.isNull() | (F.col(loss) < earlier), F.col("_at"))
    )
    gap = F.col("_at") - F.last("_best", ignorenulls=True).over(w)
    stops = marked.withColumn("_gap", gap)
    return stops.groupBy(*keys).agg(
        F.min(F.when(F.col("_gap") >= patience, F.col("epoch"))).alias("stop_epoch"),
        F.count(F.lit(1)).alias("epochs"),
    )


def batch_throughput(log: DataFrame, group: Sequence[str], seconds: str = "seconds") -> DataFrame:
    """Per batch: seconds, batches so far and running mean of the seconds."""
    both = running_sums(
        log, "batch_idx", {"_s": F.col(seconds), "_n": F.lit(1).cast("long")}, group
    )
    n = F.col("_n") + 1
    return both.select(
        *group,
        "batch_idx",
        seconds,
        n.alias("batches_done"),
        ((F.col("_s") + F.col(seconds)).cast("double") / n).alias("running_avg"),
    )


def total_throughput(log: DataFrame, group: Sequence[str], seconds: str = "seconds") -> DataFrame:
    """Batches, total seconds and seconds per batch."""
    total = F.sum(seconds).cast("double")
    return log.groupBy(*group).agg(
        F.count(F.lit(1)).alias("batches"),
        total.alias("total_seconds"),
        (total / F.count(F.lit(1))).alias("seconds_per_batch"),
    )
