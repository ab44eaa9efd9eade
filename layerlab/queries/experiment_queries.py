"""Experiments and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerlab.operators import experiments as X
from layerlab.queries.base import (
    DEPTHS,
    EPOCHS_SQL,
    PRED_SQL,
    RESULTS_SQL,
    predictions,
    query,
    r6,
    results,
    s6,
    table,
    training_log,
)


def _rounded(df, columns, digits=6):
    return df.withColumns({c: r6(c, digits) for c in columns})


@query(
    "j8_experiment_plan",
    """SELECT DISTINCT d.source AS model, d.lang AS dataset, l.l_linenumber AS layer, k::INTEGER AS depth
    FROM documents d JOIN lineitem l ON l.l_orderkey = d.doc_id, range(5) r(k)""",
)
def j8(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("model"), F.col("lang").alias("dataset"), "doc_id")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("layer"))
    return X.experiment_plan(docs.join(lines, "doc_id"), DEPTHS)


@query(
    "j9_hyperparameter_grid",
    """WITH t AS (SELECT lang AS dataset, CASE WHEN max(quality + toxic) > 1 THEN 'multilabel' ELSE 'singlelabel' END AS task
      FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang),
    g AS (SELECT * FROM t, (VALUES (1e-3::DOUBLE), (3e-4::DOUBLE), (1e-4::DOUBLE)) a(learning_rate),
      (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)) b(dropout_rate), (VALUES (64), (128), (256)) c(batch_size),
      (VALUES (0.0::DOUBLE), (1e-4::DOUBLE), (1e-3::DOUBLE)) e(weight_decay), (VALUES (50), (100), (150)) f(epochs),
      (VALUES ('[]'), ('[512]'), ('[512, 256]'), ('[512, 256, 128]')) h(hidden_layers), (VALUES ('bce/ce'), ('focal'), ('hinge')) l(loss))
    SELECT dataset, task, learning_rate, dropout_rate, batch_size, weight_decay, epochs, hidden_layers,
      CASE WHEN loss <> 'bce/ce' THEN loss WHEN task = 'multilabel' THEN 'bce' ELSE 'ce' END AS loss_function,
      CASE WHEN task = 'multilabel' AND loss = 'hinge' THEN 'unsupported' ELSE 'planned' END AS status FROM g""",
)
def j9(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    tasks = rows.groupBy(F.col("lang").alias("dataset")).agg(
        F.when(F.max(F.col("quality") + F.col("toxic")) > 1, "multilabel").otherwise("singlelabel").alias("task")
    )
    return X.hyperparameter_grid(tasks)


@query(
    "j10_adjacent_layer_pairs",
    f"""WITH {RESULTS_SQL} SELECT a.model, a.dataset, a.layer, b.layer AS next_layer, a.depth, {s6('a.acc')} AS value, {s6('b.acc')} AS next_value
    FROM res a JOIN res b ON a.model = b.model AND a.dataset = b.dataset AND a.depth = b.depth AND b.layer = a.layer + 1""",
)
def j10(spark, d):
    return _rounded(X.adjacent_layer_pairs(results(spark, d)), ["value", "next_value"])


@query(
    "u6_distinct_layers_depths",
    f"""WITH {RESULTS_SQL} SELECT DISTINCT 'layer' AS kind, layer AS level FROM res UNION SELECT DISTINCT 'depth', depth FROM res""",
)
def u6(spark, d):
    return X.distinct_levels(results(spark, d))


@query(
    "a26_mean_metric_by_layer",
    f"WITH {RESULTS_SQL} SELECT model, dataset, layer, {s6('avg(acc)')} AS mean_acc, {s6('avg(hamming)')} AS mean_hamming FROM res GROUP BY ALL",
)
def a26(spark, d):
    return _rounded(X.mean_metric_by_layer(results(spark, d)), ["mean_acc", "mean_hamming"])


@query(
    "a27_depth_pivot",
    f"WITH {RESULTS_SQL} SELECT model, dataset, layer, "
    + ", ".join(f"max({s6('acc')}) FILTER (depth = {k} AND NOT (layer = 1 AND depth = 2)) AS depth_{k}" for k in range(5))
    + " FROM res GROUP BY model, dataset, layer",
)
def a27(spark, d):
    some = results(spark, d).filter(~((F.col("layer") == 1) & (F.col("depth") == 2)))
    return _rounded(X.depth_pivot(some, DEPTHS), [f"depth_{k}" for k in DEPTHS])


@query(
    "a28_best_trial",
    f"""WITH {RESULTS_SQL}, t AS (SELECT dataset, layer * 5 + depth AS trial_id, acc, hamming FROM res)
    SELECT 'accuracy' AS criterion, dataset, arg_min(trial_id, (-acc, trial_id)) AS trial_id, {s6('max(acc)')} AS value FROM t GROUP BY dataset
    UNION ALL SELECT 'hamming_loss', dataset, arg_min(trial_id, (hamming, trial_id)), {s6('min(hamming)')} FROM t WHERE hamming IS NOT NULL GROUP BY dataset""",
)
def a28(spark, d):
    trials = results(spark, d).select(
        "dataset",
        (F.col("layer") * 5 + F.col("depth")).alias("trial_id"),
        F.col("acc").alias("accuracy"),
        F.col("hamming").alias("hamming_loss"),
    )

    def named(multilabel: bool, metric: str):
        best = X.best_trial(trials, ["dataset"], multilabel)
        return best.select(F.lit(metric).alias("criterion"), "dataset", "trial_id", r6(metric).alias("value"))

    return named(False, "accuracy").unionByName(named(True, "hamming_loss"))


@query(
    "a29_axis_bounds",
    f"""WITH {RESULTS_SQL} SELECT model, dataset, {s6('greatest(0.0::DOUBLE, min(acc) - 0.05::DOUBLE)')} AS y_min,
    {s6('least(1.0::DOUBLE, max(acc) + 0.05::DOUBLE)')} AS y_max FROM res GROUP BY ALL""",
)
def a29(spark, d):
    return _rounded(X.axis_bounds(results(spark, d)), ["y_min", "y_max"])


_TIMES_SQL = "times AS (SELECT event_type, event_id AS batch_idx, value::DECIMAL(18, 2) AS seconds FROM events)"


def _times(spark, d):
    return table(spark, d, "events").select(
        "event_type", F.col("event_id").alias("batch_idx"), F.col("value").cast("decimal(18,2)").alias("seconds")
    )


@query(
    "a30_batch_throughput",
    f"""WITH {_TIMES_SQL} SELECT event_type, batch_idx, seconds::DOUBLE AS seconds, count(*) OVER w AS batches_done,
      {s6('(sum(seconds) OVER w)::DOUBLE / (count(*) OVER w)')} AS running_avg
    FROM times WINDOW w AS (PARTITION BY event_type ORDER BY batch_idx)""",
)
def a30(spark, d):
    out = X.batch_throughput(_times(spark, d), ["event_type"])
    return _rounded(out.withColumn("seconds", F.col("seconds").cast("double")), ["running_avg"])


@query(
    "a30_total_throughput",
    f"""WITH {_TIMES_SQL} SELECT event_type, count(*) AS batches, {s6('sum(seconds)::DOUBLE')} AS total_seconds,
      {s6('sum(seconds)::DOUBLE / count(*)')} AS seconds_per_batch FROM times GROUP BY event_type""",
)
def a30_total(spark, d):
    return _rounded(X.total_throughput(_times(spark, d), ["event_type"]), ["total_seconds", "seconds_per_batch"])


@query(
    "w4_layer_delta",
    f"""WITH {RESULTS_SQL}, m AS (SELECT model, dataset, layer, avg(acc) AS a, avg(hamming) AS h FROM res GROUP BY ALL),
    x AS (SELECT model, dataset, layer, a - lag(a) OVER w AS da, h - lag(h) OVER w AS dh, lag(layer) OVER w AS p
      FROM m WINDOW w AS (PARTITION BY model, dataset ORDER BY layer))
    SELECT model, dataset, layer, {s6('da')} AS delta_mean_acc, {s6('dh')} AS delta_mean_hamming FROM x WHERE p IS NOT NULL""",
)
def w4(spark, d):
    by_layer = X.mean_metric_by_layer(results(spark, d))
    out = X.layer_delta(by_layer, ["mean_acc", "mean_hamming"])
    return _rounded(out, ["delta_mean_acc", "delta_mean_hamming"])


@query(
    "w9_mean_epoch_loss",
    f"WITH {EPOCHS_SQL} SELECT run, split, epoch, {s6('avg(loss)')} AS mean_loss FROM log GROUP BY run, split, epoch",
)
def w9(spark, d):
    return _rounded(X.mean_epoch_loss(training_log(spark, d), ["run", "split"]), ["mean_loss"])


@query(
    "w7_best_epoch",
    f"""WITH {EPOCHS_SQL}, e AS (SELECT run, epoch, avg(hit) AS accuracy FROM log GROUP BY run, epoch)
    SELECT run, epoch AS best_epoch, {s6('accuracy')} AS best_accuracy FROM (
      SELECT *, row_number() OVER (PARTITION BY run ORDER BY accuracy DESC, epoch) AS rn FROM e WHERE accuracy > 0) WHERE rn = 1""",
)
def w7(spark, d):
    epochs = training_log(spark, d).groupBy("run", "epoch").agg(F.avg("hit").alias("accuracy"))
    return _rounded(X.best_epoch(epochs, ["run"]), ["best_accuracy"])


@query(
    "w8_early_stop_epoch",
    f"""WITH {EPOCHS_SQL}, e AS (SELECT run, epoch, avg(loss) AS mean_loss FROM log GROUP BY run, epoch),
    n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS n,
      min(mean_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM e),
    b AS (SELECT *, max(CASE WHEN earlier IS NULL OR mean_loss < earlier THEN n END) OVER (PARTITION BY run ORDER BY epoch) AS best FROM n)
    SELECT run, min(epoch) FILTER (n - best >= 10) AS stop_epoch, count(*) AS epochs FROM b GROUP BY run""",
)
def w8(spark, d):
    epochs = X.mean_epoch_loss(training_log(spark, d), ["run"])
    return X.early_stop_epoch(epochs, ["run"], patience=10)


@query(
    "w11_rank_layers",
    f"""WITH {RESULTS_SQL}, m AS (SELECT model, dataset, layer, round(avg(acc), 9) AS value FROM res GROUP BY ALL)
    SELECT model, dataset, layer, {s6('value')} AS value, (row_number() OVER (ORDER BY value, model, dataset, layer))::INTEGER AS rank FROM m""",
)
def w11(spark, d):
    m = results(spark, d).groupBy("model", "dataset", "layer").agg(F.round(F.avg("acc"), 9).alias("value"))
    return _rounded(X.rank_layers(m), ["value"])


@query(
    "e14_paired_t_test",
    f"""WITH {RESULTS_SQL}, p AS (SELECT a.model, a.dataset, a.layer, b.layer AS next_layer, a.acc - b.acc AS d
      FROM res a JOIN res b ON a.model = b.model AND a.dataset = b.dataset AND a.depth = b.depth AND b.layer = a.layer + 1),
    g AS (SELECT model, dataset, layer, next_layer, count(*) AS n, avg(d) AS mean_diff, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM p GROUP BY ALL),
    a AS (SELECT *, atan(abs(t) / 2) AS th FROM g),
    r AS (SELECT *, 1 - sin(th) * (1 + 0.5::DOUBLE * cos(th) * cos(th)) AS p FROM a)
    SELECT model, dataset, layer, next_layer, n, {s6('mean_diff')} AS mean_diff, {s6('t', 4)} AS t, {s6('p', 4)} AS p,
      {s6('-log10(p)', 4)} AS neg_log10_p, p < 0.05::DOUBLE AS significant FROM r""",
)
def e14(spark, d):
    out = X.paired_t_test(X.adjacent_layer_pairs(results(spark, d)))
    return _rounded(_rounded(out, ["mean_diff"]), ["t", "p", "neg_log10_p"], 4)


@query(
    "t5_sort_trials",
    f"WITH {RESULTS_SQL} SELECT dataset, layer * 5 + depth AS trial_id, {s6('acc')} AS accuracy FROM res ORDER BY acc DESC, trial_id",
)
def t5(spark, d):
    trials = results(spark, d).select(
        "dataset", (F.col("layer") * 5 + F.col("depth")).alias("trial_id"), r6("acc").alias("accuracy")
    )
    return X.sort_trials(trials, "accuracy")


@query(
    "x1_experiment_results",
    f"""WITH {PRED_SQL} SELECT layer, depth, {s6('avg((y = yhat)::INTEGER)')} AS acc, {s6('1 - avg((y = yhat)::INTEGER)')} AS hamming
    FROM pred GROUP BY ALL""",
)
def x1(spark, d):
    return _rounded(X.experiment_results(predictions(spark, d), ["layer", "depth"]), ["acc", "hamming"])
