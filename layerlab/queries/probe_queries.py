"""Encoding, classifiers per layer, summary."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layerlab.functions.fixed_values import PROBE_DEPTHS, TUNING_GRID, TUNING_LOSSES
from layerlab.operators import evaluation as E
from layerlab.operators import experiments as X
from layerlab.operators import layer_stats as S
from layerlab.operators.tables import apply_split
from layerlab.plans import probes as P
from layerlab.plans import tuning as T
from layerlab.plans.analysis import analyze_layers
from layerlab.plans.certificates import gradient_rows, within
from layerlab.plans.encode import HashEncoder, encode_layers
from layerlab.plans.materialize import via_parquet
from layerlab.queries.base import (
    LONG_SPLIT_SQL,
    LONG_SQL,
    PRED_SQL,
    corpus,
    long_vectors,
    predictions,
    query,
    r6,
    s6,
    split_of,
    split_vectors,
)

SUMMARY = ["train_accuracy", "test_accuracy", "test_macro_f1", "test_weighted_f1", "silhouette_score"]


def layer_summary(spark: SparkSession, sf_dir: str, max_iter: int = 2000) -> DataFrame:
    """Split, standardise, logistic regression per layer, metrics, silhouette."""
    analysis, _ = analyze_layers(split_vectors(spark, sf_dir), max_iter=max_iter)
    return analysis.summary


def _softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    shifted = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def _sigmoids(logits: Column) -> Column:
    return F.transform(logits, lambda x: 1 / (1 + F.exp(-x)))


# At the optimum of a penalised fit with free intercepts the predicted
# probabilities of a class add up to its number of training rows, with weights to
# its weight, the gradient of every coefficient is zero, and the loss is lower than
# that of the class shares. The SQL has these numbers and needs no fit of its own;
# intercepts alone have a gradient, and no lower loss.
def _certificate_sql(train: str, sums: str) -> str:
    return f"""WITH {train}, sums AS ({sums})
    SELECT layer, class, k::INTEGER AS dim, CASE WHEN k = -2 THEN 1.0::DOUBLE WHEN k = -1 THEN p_sum ELSE 0.0::DOUBLE END AS value
    FROM sums, range(-2, 16) r(k)"""


def _certificate(
    predicted: DataFrame, models: dict, p: Column, y: Callable[[int], Column], weight: Callable[[int], Column], one_class: bool, digits: int
) -> DataFrame:
    """(layer, class, dim, value): gradients; class sums as dim -1, and -2 for a lower loss than the shares."""
    train = predicted.filter("split = 'train'").withColumn("_p", p)
    found = gradient_rows(train, models, lambda c: (F.get("_p", F.lit(c)), y(c), weight(c)))
    near = found.select("layer", "class", "dim", within(F.col("gradient"), F.col("weight_sum")).alias("value"))
    sums = found.filter("dim = 0").select("layer", "class", F.lit(-1).alias("dim"), r6("p_sum", digits).alias("value"))
    classes = range(len(next(iter(models.values()))))
    cells = F.array(*[F.struct(F.lit(c).alias("class"), F.get("_p", F.lit(c)).alias("p"), y(c).cast("double").alias("y"), weight(c).alias("w")) for c in classes])
    own = F.col("w") * F.col("y") * -F.log("p")
    other = F.col("w") * (1 - F.col("y")) * -F.log(1 - F.col("p"))
    share, rest = F.sum(F.col("w") * F.col("y")), F.sum(F.col("w") * (1 - F.col("y")))
    total = F.sum("w")
    # nothing to gain where a class has all rows or none
    none = (share == 0) | (rest == 0)
    by_class = train.select("layer", F.inline(cells)).groupBy("layer", "class").agg(
        F.sum(own if one_class else own + other).alias("loss"),
        F.when(none, None).otherwise(-share * F.log(share / total) - (F.lit(0.0) if one_class else rest * F.log(rest / total))).alias("base"),
    )
    if one_class:
        w = Window.partitionBy("layer")
        by_class = by_class.withColumns({"loss": F.sum("loss").over(w), "base": F.sum("base").over(w)})
    lower = F.coalesce(F.col("loss") < (1 - 1e-6) * F.col("base"), F.lit(True)).cast("double")
    return near.unionByName(sums).unionByName(by_class.select("layer", "class", F.lit(-2).alias("dim"), lower.alias("value")))


_CLASS_COUNTS = _certificate_sql(
    LONG_SPLIT_SQL,
    "SELECT layer, label::INTEGER AS class, round(count(*)::DOUBLE, 2) AS p_sum FROM split_long WHERE split = 'train' GROUP BY ALL",
)


def _is(c: int) -> Column:
    return (F.col("y") == c).cast("double")


def _one(c: int) -> Column:
    return F.lit(1.0)


@query("m2_layer_probe_logistic", _CLASS_COUNTS)
def m2(spark, d):
    models: dict = {}
    predicted, _ = P.probe_logistic(P.ProbeData(split_vectors(spark, d)), 2000, keep=["features"], models=models)
    return _certificate(predicted, models, _softmax(F.col("logits")), _is, _one, True, 2)


@query("m3_layer_probe_ovr", _CLASS_COUNTS)
def m3(spark, d):
    models: dict = {}
    predicted, _ = P.probe_one_vs_rest(
        P.ProbeData(split_vectors(spark, d), scale=False), 100, keep=["features"], models=models
    )
    return _certificate(predicted, models, _sigmoids(F.col("logits")), _is, _one, False, 2)


@query(
    "m4_layer_probe_multilabel",
    _certificate_sql(
        f"""{LONG_SPLIT_SQL}, train AS (SELECT * FROM split_long WHERE split = 'train'),
    n AS (SELECT layer, count(*) AS n FROM train GROUP BY layer),
    pos AS (SELECT layer, id, count(*) AS pos FROM (
      SELECT layer, sample_id, unnest(list_distinct([label, (label * 3) % 10]))::INTEGER AS id FROM train) GROUP BY ALL)""",
        f"""SELECT layer, id AS class, {s6("pos * ((n - pos) / (pos + 1e-7))", 2)} AS p_sum FROM pos JOIN n USING (layer)""",
    ),
)
def m4(spark, d):
    labels = F.array_distinct(F.array(F.col("label"), (F.col("label") * 3) % 10))
    data = P.ProbeData(split_vectors(spark, d).withColumn("labels", labels), ["labels"])
    models: dict = {}
    predicted, _ = P.probe_multilabel(data, "labels", 10, 100, keep=["features"], models=models)
    train = predicted.filter("split = 'train'")
    positive = train.groupBy("layer").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.get("bits", F.lit(c))) for c in range(10)]).alias("pos")
    )

    def bit(c: int) -> Column:
        return F.get("bits", F.lit(c)).cast("double")

    def weight(c: int) -> Column:
        pos = F.get("pos", F.lit(c))
        return F.when(bit(c) == 1, (F.col("n") - pos) / (pos + 1e-7)).otherwise(1.0)

    rows = train.join(F.broadcast(positive), "layer")  # a row a layer
    return _certificate(rows, models, _sigmoids(F.col("logits")), bit, weight, False, 2)


@query(
    "m5_layer_probe_weighted",
    _certificate_sql(
        LONG_SPLIT_SQL,
        f"""SELECT layer, label::INTEGER AS class, {s6("count(*) / (count(*) + 1e-7)", 3)} AS p_sum
    FROM split_long WHERE split = 'train' GROUP BY ALL""",
    ),
)
def m5(spark, d):
    models: dict = {}
    predicted, _ = P.probe_weighted(P.ProbeData(split_vectors(spark, d)), 2000, keep=["features"], models=models)
    train = predicted.filter("split = 'train'")
    weights = train.groupBy("layer", "y").agg((1.0 / (F.count(F.lit(1)) + 1e-7)).alias("weight"))
    rows = train.join(weights, ["layer", "y"])
    return _certificate(rows, models, _softmax(F.col("logits")), _is, lambda c: F.col("weight"), True, 3)


def _learned(predicted: DataFrame) -> DataFrame:
    """Rows per (layer, depth, split), and whether the loss beats the class shares."""
    chosen = F.element_at(_softmax(F.col("logits")), F.col("y") + 1)
    keys = ["layer", "depth", "split"]
    rows = predicted.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("n"), F.sum(-F.log(chosen)).alias("loss"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    shares = rows.withColumn("base", -F.col("n") * F.log(F.col("n") / total))
    better = (F.col("split") != "train") | (F.sum("loss") < F.sum("base"))
    return shares.groupBy(*keys).agg(F.sum("n").alias("n"), better.alias("learned"))


@query(
    "m6_layer_probe_mlp",
    f"""WITH {LONG_SPLIT_SQL} SELECT layer, 2 AS depth, split, count(*) AS n, true AS learned FROM split_long GROUP BY ALL""",
)
def m6(spark, d):
    predicted, _ = P.probe_mlp(P.ProbeData(split_vectors(spark, d)), [256, 128], 80)
    return _learned(predicted).withColumn("learned", F.coalesce("learned", F.lit(True)))


@query(
    "m7_train_all_layers",
    f"""WITH {LONG_SPLIT_SQL} SELECT layer, depth, split, count(*) AS n, true AS learned
    FROM split_long, range({len(PROBE_DEPTHS)}) r(depth) GROUP BY ALL""",
)
def m7(spark, d):
    """All layers at all depths."""
    data = P.ProbeData(split_vectors(spark, d))
    predicted, _ = P.train_all_layers(data, PROBE_DEPTHS, 100, threads=8)
    return _learned(via_parquet(predicted, "all-layers"))


_AXES = list(TUNING_GRID)
_LIST_SQL = {
    k: "[" + ", ".join(f"'{x}'" if isinstance(x, list) else repr(x) for x in v) + "]" for k, v in TUNING_GRID.items()
}


def _trials(task: str) -> list[dict]:
    """All rows of the grid; the last axis changes fastest."""
    axes = [*TUNING_GRID.values(), TUNING_LOSSES[task]]
    return [dict(zip([*_AXES, "loss_function"], x)) for x in product(*axes)]


def _grid_sql(task: str, many: bool) -> str:
    axes = ", ".join(f"(SELECT unnest({v}) AS {k}, generate_subscripts({v}, 1) AS i_{k}) q_{k}" for k, v in _LIST_SQL.items())
    order = ", ".join(f"i_{k}" for k in _AXES)
    good = "loss IN ('bce', 'focal') AND hidden_layers = '[]'" if many else "hidden_layers = '[]' OR loss = 'ce'"
    return f"""SELECT layer, '{task}' AS task, (row_number() OVER (PARTITION BY layer ORDER BY {order}, i_loss) - 1)::BIGINT AS trial_id,
      learning_rate::DOUBLE AS learning_rate, weight_decay::DOUBLE AS weight_decay, epochs::INTEGER AS epochs, hidden_layers, loss AS loss_function,
      {good} AS done FROM (SELECT DISTINCT layer FROM long), {axes},
      (SELECT unnest({TUNING_LOSSES[task]}) AS loss, generate_subscripts({TUNING_LOSSES[task]}, 1) AS i_loss)"""


@query(
    "m8_tune",
    f"""WITH {LONG_SQL}, g AS ({_grid_sql("singlelabel", False)} UNION ALL {_grid_sql("multilabel", True)})
    SELECT layer, task, trial_id, learning_rate, weight_decay, epochs, hidden_layers, loss_function,
      CASE WHEN done THEN 'done' ELSE 'failed' END AS status, done AS falls, done AS scored,
      CASE WHEN NOT done THEN 0 WHEN hidden_layers = '[]' THEN 5 ELSE 2 END AS n_acts FROM g""",
)
def m8(spark, d):
    """The whole grid for one class and for many labels a row, on every layer."""
    labels = F.array_distinct(F.array(F.col("label"), (F.col("label") * 3) % 10))
    data = P.ProbeData(split_vectors(spark, d).withColumn("labels", labels), ["labels"])
    with ThreadPoolExecutor(2) as pool:
        tasks = {"singlelabel": pool.submit(T.tune, data, _trials("singlelabel"))}
        tasks["multilabel"] = pool.submit(T.tune, data, _trials("multilabel"), "labels", 10)
    single, multi = [fit.result().withColumn("task", F.lit(task)) for task, fit in tasks.items()]
    main = F.coalesce(F.col("metrics")["accuracy"], F.col("metrics")["exact_acc"])
    p = F.col("params")
    return single.unionByName(multi).select(
        "layer", "task", "trial_id", p["learning_rate"].cast("double").alias("learning_rate"),
        p["weight_decay"].cast("double").alias("weight_decay"), p["epochs"].cast("int").alias("epochs"),
        p["hidden_layers"].alias("hidden_layers"), p["loss_function"].alias("loss_function"), "status",
        F.coalesce("falls", F.lit(False)).alias("falls"), F.coalesce(main.between(0, 1), F.lit(False)).alias("scored"),
        F.coalesce(F.size("acts"), F.lit(0)).alias("n_acts"),
    )


@query(
    "m7_epoch_log",
    f"""WITH {LONG_SPLIT_SQL}, n AS (SELECT layer, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split <> 'train') AS n_val
      FROM split_long GROUP BY layer)
    SELECT layer, depth, epoch::INTEGER AS epoch, n_train, n_val, true AS falls, true AS beats_shares, true AS best_is_highest
    FROM n, range(3) r(depth), range(10, 90, 10) e(epoch)""",
)
def m7_log(spark, d):
    """Losses by epoch of networks fitted on from their last weights, and their best epoch."""
    data = P.ProbeData(split_vectors(spark, d))
    states = [T.chunked_network(data, hidden, 80, 10) for hidden in ([], [256], [256, 128])]
    predicted = reduce(DataFrame.unionByName, states)
    log = via_parquet(T.epoch_log(predicted), "epoch-log")
    keys = ["layer", "depth"]
    before = F.lag("train_loss").over(Window.partitionBy(*keys).orderBy("epoch"))
    counts = predicted.groupBy(*keys, "epoch", "y").agg(
        F.sum((F.col("split") == "train").cast("int")).alias("t"), F.sum((F.col("split") != "train").cast("int")).alias("v")
    )
    total = F.sum("t")
    sizes = counts.groupBy(*keys, "epoch").agg(
        total.alias("n_train"), F.sum("v").alias("n_val"), (F.sum(-F.col("t") * F.log("t")) / total + F.log(total)).alias("shares")
    )
    last = F.max("epoch").over(Window.partitionBy(*keys))  # deep networks need more than the first chunk
    # a chunk ends where the solver finds no lower loss, up to its last digits
    best = X.best_epoch(log, keys, "val_accuracy").join(log.groupBy(*keys).agg(F.max("val_accuracy").alias("top")), keys)
    return log.withColumn("falls", F.coalesce(F.col("train_loss") <= before + 1e-6, F.lit(True))).join(
        sizes, [*keys, "epoch"]
    ).join(best, keys).select(
        *keys, "epoch", "n_train", "n_val", "falls",
        ((F.col("epoch") < last) | (F.col("train_loss") < F.col("shares"))).alias("beats_shares"),
        (F.col("best_accuracy") == F.col("top")).alias("best_is_highest"),
    )


_POWER = """{name} AS (
  SELECT layer, split, c, 0 AS step, list_transform(range(16), lambda x: 1.0 + x / 7.0) AS v FROM {of}
  UNION ALL
  SELECT layer, split, c, step + 1, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u)))
  FROM (SELECT *, list_transform(c, lambda r: list_dot_product(r, v)) AS u FROM {name} WHERE step < 3000)),
{name}_last AS (
  SELECT layer, split, c, v, list_dot_product(v, list_transform(c, lambda r: list_dot_product(r, v))) AS value
  FROM {name} WHERE step = 3000)"""


@query(
    "m13_project_2d",
    f"""WITH RECURSIVE {LONG_SPLIT_SQL},
    cell AS (SELECT layer, split, sample_id, generate_subscripts(vec, 1) AS i, unnest(vec) AS x FROM split_long),
    cov AS (SELECT a.layer, a.split, a.i, b.i AS j, covar_samp(a.x, b.x) AS c FROM cell a
      JOIN cell b ON a.layer = b.layer AND a.split = b.split AND a.sample_id = b.sample_id GROUP BY ALL),
    line AS (SELECT layer, split, i, list(c ORDER BY j) AS r FROM cov GROUP BY ALL),
    m1 AS (SELECT layer, split, list(r ORDER BY i) AS c FROM line GROUP BY ALL),
    {_POWER.format(name="p1", of="m1")},
    m2 AS (SELECT layer, split, list_transform(c, lambda r, i: list_transform(r, lambda x, j: x - value * v[i] * v[j])) AS c FROM p1_last),
    {_POWER.format(name="p2", of="m2")},
    n AS (SELECT layer, split, count(*) AS n FROM split_long GROUP BY ALL)
    SELECT n.layer, n.split, n, {s6("p1_last.value")} AS var_x, {s6("p2_last.value")} AS var_y, 0.0::DOUBLE AS covariance
    FROM n JOIN p1_last USING (layer, split) JOIN p2_last USING (layer, split)""",
)
def m13(spark, d):
    """Rows, variances (the two largest eigenvalues) and covariance of the components."""
    return P.project_2d(split_vectors(spark, d)).groupBy("layer", "split").agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.var_samp("x")).alias("var_x"),
        r6(F.var_samp("y")).alias("var_y"),
        r6(F.covar_samp("x", "y")).alias("covariance"),
    )


_FEATURE = "('0x' || substr(md5(concat(layer, ':0:', i, ':', md5(text))), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(
    "m1_encode_layers",
    f"SELECT doc_id, layer::INTEGER AS layer, i::INTEGER AS dim, {s6(_FEATURE)} AS value FROM documents, range(3) a(layer), range(4) b(i)",
)
def m1(spark, d):
    out = encode_layers(corpus(spark, d), lambda: HashEncoder(3, 4), "doc_id", "text")
    return out.select("doc_id", "layer", F.posexplode("vec").alias("dim", "value")).withColumn("value", r6("value"))


@query(
    "e13_summary_table",
    f"""WITH {LONG_SPLIT_SQL}, {PRED_SQL}, p AS (SELECT pred.*, split.split FROM pred JOIN split USING (sample_id) WHERE depth = 0),
    acc AS (SELECT layer, avg((y = yhat)::INTEGER) FILTER (split = 'train') AS tr, avg((y = yhat)::INTEGER) FILTER (split = 'test') AS te FROM p GROUP BY layer),
    classes AS (SELECT layer, y AS class FROM p WHERE split = 'test' UNION SELECT layer, yhat FROM p WHERE split = 'test'),
    sums AS (SELECT c.layer, c.class, (count(*) FILTER (p.y = c.class AND p.yhat = c.class)) AS tp, (count(*) FILTER (p.y = c.class)) AS support,
        (count(*) FILTER (p.yhat = c.class)) AS predicted FROM classes c JOIN p ON p.layer = c.layer AND p.split = 'test' GROUP BY ALL),
    f AS (SELECT layer, avg(2 * tp / (support + predicted)) AS macro, sum(2 * tp / (support + predicted) * support) / sum(support) AS weighted FROM sums GROUP BY layer),
    test AS (SELECT * FROM split_long WHERE split = 'test'),
    dist AS (SELECT a.layer, a.sample_id, a.label, b.label AS other, sum(list_distance(a.vec, b.vec)) AS s, count(*) AS n
      FROM test a JOIN test b ON a.layer = b.layer GROUP BY ALL),
    ab AS (SELECT layer, sample_id, sum(s / (n - 1)) FILTER (label = other AND n > 1) AS a, min(s / n) FILTER (label <> other) AS b FROM dist GROUP BY ALL),
    sil AS (SELECT layer, avg(CASE WHEN a IS NULL THEN 0.0::DOUBLE ELSE (b - a) / greatest(a, b) END) AS sil FROM ab GROUP BY layer)
    SELECT layer, {s6('tr')} AS train_accuracy, {s6('te')} AS test_accuracy, {s6('macro')} AS test_macro_f1, {s6('weighted')} AS test_weighted_f1,
      {s6('sil')} AS silhouette_score FROM acc JOIN f USING (layer) JOIN sil USING (layer)""",
)
def e13(spark, d):
    split = split_of(spark, d)
    pred = apply_split(predictions(spark, d).filter("depth = 0"), split)
    counts = E.confusion_counts(pred, ["layer", "split"])
    test = apply_split(long_vectors(spark, d), split.filter("split = 'test'"))
    silhouette = S.silhouette_exact(test, ["layer"])
    out = E.summary_table(counts, silhouette)
    return out.select("layer", *[r6(c).alias(c) for c in SUMMARY])
