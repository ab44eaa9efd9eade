"""Evaluation and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerlab.functions import losses as LS
from layerlab.operators import evaluation as E
from layerlab.queries.base import (
    BITS_SQL,
    LOGITS_SQL,
    PRED_SQL,
    bit_predictions,
    layer_logits,
    predictions,
    query,
    r6,
    s6,
)

KEYS = ["layer", "depth"]


def _counts(spark, d):
    return E.confusion_counts(predictions(spark, d), KEYS)


def _rounded(df, columns):
    return df.withColumns({c: r6(c) for c in columns})


@query(
    "e1_accuracy",
    f"WITH {PRED_SQL} SELECT layer, depth, {s6('avg(CASE WHEN y = yhat THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS accuracy FROM pred GROUP BY ALL",
)
def e1(spark, d):
    return _rounded(E.accuracy(_counts(spark, d), KEYS), ["accuracy"])


@query(
    "e2_exact_match",
    f"WITH {BITS_SQL} SELECT layer, depth, {s6('avg(CASE WHEN bits = pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS exact_match FROM bits GROUP BY ALL",
)
def e2(spark, d):
    out = E.multilabel_metrics(bit_predictions(spark, d), KEYS)
    return out.select(*KEYS, r6("exact_match").alias("exact_match"))


_CELLS_SQL = f"WITH {BITS_SQL}, cell AS (SELECT layer, depth, i::INTEGER AS label, bits[i + 1] AS b, pred[i + 1] AS p FROM bits, range(10) r(i))"


@query(
    "e3_per_label_accuracy",
    f"{_CELLS_SQL} SELECT layer, depth, {s6('avg(CASE WHEN b = p THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS per_label_accuracy FROM cell GROUP BY layer, depth",
)
def e3(spark, d):
    out = E.multilabel_metrics(bit_predictions(spark, d), KEYS)
    return out.select(*KEYS, r6("per_label_accuracy").alias("per_label_accuracy"))


@query(
    "e4_hamming_loss",
    f"{_CELLS_SQL} SELECT layer, depth, {s6('avg(CASE WHEN b <> p THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS hamming_loss FROM cell GROUP BY layer, depth",
)
def e4(spark, d):
    out = E.multilabel_metrics(bit_predictions(spark, d), KEYS)
    return out.select(*KEYS, r6("hamming_loss").alias("hamming_loss"))


_PRF_SQL = f"""{_CELLS_SQL}, sums AS (SELECT layer, depth, label, sum(b * p)::BIGINT AS tp, sum((1 - b) * p)::BIGINT AS fp, sum(b * (1 - p))::BIGINT AS fn FROM cell GROUP BY ALL),
    pr AS (SELECT *, tp / (tp + fp + 1e-8::DOUBLE) AS precision, tp / (tp + fn + 1e-8::DOUBLE) AS recall FROM sums),
    prf AS (SELECT *, 2 * (precision * recall) / (precision + recall + 1e-8::DOUBLE) AS f1 FROM pr)"""


@query(
    "e5_per_class_prf",
    f"{_PRF_SQL} SELECT layer, depth, label, tp, fp, fn, {s6('precision')} AS precision, {s6('recall')} AS recall, {s6('f1')} AS f1 FROM prf",
)
def e5(spark, d):
    return _rounded(E.per_class_prf(bit_predictions(spark, d), KEYS), ["precision", "recall", "f1"])


def _scores_sql(domain: str) -> str:
    return f"""WITH {PRED_SQL}, classes AS ({domain}),
    sums AS (SELECT c.layer, c.depth, c.class, (count(p.y) FILTER (p.y = c.class AND p.yhat = c.class)) AS tp,
        (count(p.y) FILTER (p.y = c.class)) AS support, (count(p.y) FILTER (p.yhat = c.class)) AS predicted
      FROM classes c LEFT JOIN pred p ON p.layer = c.layer AND p.depth = c.depth AND (p.y = c.class OR p.yhat = c.class) GROUP BY ALL),
    scores AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE tp / predicted END AS precision,
        CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE tp / support END AS recall,
        CASE WHEN support + predicted = 0 THEN 0.0::DOUBLE ELSE 2 * tp / (support + predicted) END AS f1 FROM sums)"""


_PRESENT = "SELECT layer, depth, y AS class FROM pred UNION SELECT layer, depth, yhat FROM pred"
_FULL = "SELECT DISTINCT layer, depth, i::INTEGER AS class FROM pred, range(28) r(i)"


@query(
    "e6_classification_report",
    f"""{_scores_sql(_FULL)}
    SELECT layer, depth, class::VARCHAR AS row, {s6('precision')} AS precision, {s6('recall')} AS recall, {s6('f1')} AS f1, support FROM scores
    UNION ALL SELECT layer, depth, 'accuracy', {s6('sum(tp) / sum(support)')}, {s6('sum(tp) / sum(support)')}, {s6('sum(tp) / sum(support)')}, sum(support)::BIGINT FROM scores GROUP BY layer, depth
    UNION ALL SELECT layer, depth, 'macro avg', {s6('avg(precision)')}, {s6('avg(recall)')}, {s6('avg(f1)')}, sum(support)::BIGINT FROM scores GROUP BY layer, depth
    UNION ALL SELECT layer, depth, 'weighted avg', {s6('sum(precision * support) / sum(support)')}, {s6('sum(recall * support) / sum(support)')}, {s6('sum(f1 * support) / sum(support)')}, sum(support)::BIGINT FROM scores GROUP BY layer, depth""",
)
def e6(spark, d):
    return _rounded(E.classification_report(_counts(spark, d), KEYS), ["precision", "recall", "f1"])


@query("e7_macro_f1", f"{_scores_sql(_PRESENT)} SELECT layer, depth, {s6('avg(f1)')} AS macro_f1 FROM scores GROUP BY layer, depth")
def e7(spark, d):
    return _rounded(E.macro_f1(_counts(spark, d), KEYS), ["macro_f1"])


@query(
    "e8_weighted_f1",
    f"{_scores_sql(_PRESENT)} SELECT layer, depth, {s6('sum(f1 * support) / sum(support)')} AS weighted_f1 FROM scores GROUP BY layer, depth",
)
def e8(spark, d):
    return _rounded(E.weighted_f1(_counts(spark, d), KEYS), ["weighted_f1"])


@query(
    "e9_micro_f1",
    f"{_PRF_SQL} SELECT layer, depth, {s6('2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))')} AS micro_f1 FROM prf GROUP BY layer, depth",
)
def e9(spark, d):
    return _rounded(E.micro_f1(bit_predictions(spark, d), KEYS), ["micro_f1"])


_MATRIX_SQL = f"""WITH {PRED_SQL}, classes AS ({_PRESENT}), c AS (SELECT layer, depth, y, yhat, count(*) AS n FROM pred GROUP BY ALL),
    matrix AS (SELECT a.layer, a.depth, a.class AS y, b.class AS yhat, coalesce(c.n, 0) AS n
      FROM classes a JOIN classes b ON a.layer = b.layer AND a.depth = b.depth
      LEFT JOIN c ON c.layer = a.layer AND c.depth = a.depth AND c.y = a.class AND c.yhat = b.class),
    percents AS (SELECT *, CASE WHEN sum(n) OVER w = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * n / sum(n) OVER w END AS percent
      FROM matrix WINDOW w AS (PARTITION BY layer, depth, y))"""


@query("e10_confusion_matrix", f"{_MATRIX_SQL} SELECT layer, depth, y, yhat, n FROM matrix")
def e10(spark, d):
    return E.confusion_matrix(_counts(spark, d), KEYS).drop("percent")


@query("e11_confusion_percent", f"{_MATRIX_SQL} SELECT layer, depth, y, yhat, {s6('percent')} AS percent FROM percents")
def e11(spark, d):
    return _rounded(E.confusion_matrix(_counts(spark, d), KEYS), ["percent"]).drop("n")


@query(
    "e12_confusion_top_k",
    f"""{_MATRIX_SQL}, top AS (SELECT layer, depth, y FROM (SELECT layer, depth, y, row_number() OVER (PARTITION BY layer, depth ORDER BY count(*) DESC, y) AS r
        FROM pred GROUP BY layer, depth, y) WHERE r <= 5)
    SELECT p.layer, p.depth, p.y, p.yhat, p.n, {s6('p.percent')} AS percent FROM percents p
      JOIN top a ON a.layer = p.layer AND a.depth = p.depth AND a.y = p.y
      JOIN top b ON b.layer = p.layer AND b.depth = p.depth AND b.y = p.yhat""",
)
def e12(spark, d):
    return _rounded(E.confusion_top_k(_counts(spark, d), KEYS, 5), ["percent"]).select("layer", "depth", "y", "yhat", "n", "percent")


@query(
    "w12_row_percent",
    f"""WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)
    SELECT o_orderpriority, o_orderstatus, n, {s6('100.0::DOUBLE * n / sum(n) OVER (PARTITION BY o_orderpriority)')} AS percent FROM c""",
)
def w12(spark, d):
    from layerlab.queries.base import table

    c = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return _rounded(c.withColumn("percent", E.row_percent("n", ["o_orderpriority"])), ["percent"])


@query(
    "a31_layer_class_matrix",
    f"{_PRF_SQL} SELECT label AS class, "
    + ", ".join(f"""max({s6('f1')}) FILTER (layer = {k}) AS "{k}" """ for k in range(4))
    + " FROM prf WHERE depth = 0 GROUP BY label",
)
def a31(spark, d):
    scores = E.per_class_prf(bit_predictions(spark, d), KEYS).withColumnRenamed("label", "class")
    return _rounded(E.depth_one_matrix(scores, list(range(4))), [str(k) for k in range(4)])


# ---- losses ------------------------------------------------------------------

_STABLE = "greatest(x, 0.0::DOUBLE) - x * b + ln(1.0::DOUBLE + exp(-abs(x)))"
_LOSS_CELLS = f"""WITH {BITS_SQL}, cell AS (SELECT layer, depth, sample_id, i::INTEGER AS label, bits[i + 1] AS b, logits[i + 1] AS x FROM bits, range(10) r(i)),
    pos AS (SELECT label, sum(b) AS pos, count(*) AS n FROM cell WHERE layer = 0 AND depth = 0 GROUP BY label),
    w AS (SELECT label, (n - pos) / (pos + 1e-7::DOUBLE) AS w FROM pos)"""


@query(
    "m9_bce_with_logits",
    f"""{_LOSS_CELLS} SELECT layer, depth, {s6(f'avg({_STABLE})')} AS loss,
      {s6('avg((1 - b) * x + (1 + (w - 1) * b) * (ln(1.0::DOUBLE + exp(-abs(x))) + greatest(-x, 0.0::DOUBLE)))')} AS weighted_loss
    FROM cell JOIN w USING (label) GROUP BY layer, depth""",
)
def m9(spark, d):
    from layerlab.operators.corpus_stats import pos_weights, weight_array

    rows = bit_predictions(spark, d)
    one = rows.filter("layer = 0 AND depth = 0")
    ids = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda i: F.get(F.col("bits"), i) == 1)
    weights = pos_weights(one.select(ids.alias("labels")), "labels", 10)
    plain = E.mean_element_loss(rows, KEYS, LS.bce_elements(F.col("logits"), F.col("bits")))
    weighted = E.mean_element_loss(
        rows.withColumn("_w", weight_array(weights)), KEYS, LS.bce_elements(F.col("logits"), F.col("bits"), F.col("_w")), "weighted_loss"
    )
    return _rounded(plain.join(weighted, KEYS), ["loss", "weighted_loss"])


_NLL_SQL = f"""WITH {LOGITS_SQL}, lse AS (SELECT *, ln(list_sum(list_transform(logits, lambda v: exp(v)))) - logits[y + 1] AS nll FROM logits),
    w AS (SELECT label AS y, 1.0::DOUBLE / (count(*) + 1e-7::DOUBLE) AS w FROM embeddings GROUP BY label)"""


@query(
    "m10_weighted_cross_entropy",
    f"{_NLL_SQL} SELECT layer, depth, {s6('sum(w * nll) / sum(w)')} AS loss, {s6('avg(nll)')} AS plain_loss FROM lse JOIN w USING (y) GROUP BY layer, depth",
)
def m10(spark, d):
    from layerlab.operators.corpus_stats import class_weights
    from layerlab.plans.materialize import inline_if_small
    from layerlab.queries.base import table

    weights = class_weights(table(spark, d, "embeddings")).select(F.col("label").alias("y"), "weight")
    rows = layer_logits(spark, d).join(inline_if_small(weights), "y")
    nll = LS.nll_row(F.col("logits"), F.col("y"))
    weighted = E.weighted_mean_loss(rows, KEYS, nll, F.col("weight"))
    plain = E.mean_row_loss(rows, KEYS, nll, "plain_loss")
    return _rounded(weighted.join(plain, KEYS), ["loss", "plain_loss"])


@query(
    "m11_multi_margin_loss",
    f"""WITH {LOGITS_SQL}, cell AS (SELECT layer, depth, sample_id, y, i, logits[i + 1] AS x, logits[y + 1] AS own FROM logits, range(10) r(i)),
    per AS (SELECT layer, depth, sample_id, sum(CASE WHEN i = y THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - own + x) END) / 10 AS l FROM cell GROUP BY ALL)
    SELECT layer, depth, {s6('avg(l)')} AS loss FROM per GROUP BY layer, depth""",
)
def m11(spark, d):
    rows = layer_logits(spark, d)
    return _rounded(E.mean_row_loss(rows, KEYS, LS.multi_margin_row(F.col("logits"), F.col("y"))), ["loss"])


@query(
    "m12_focal_loss",
    f"""{_LOSS_CELLS}, f AS (SELECT layer, depth, {_STABLE} AS bce FROM cell)
    SELECT layer, depth, {s6('avg(0.25::DOUBLE * pow(1 - exp(-bce), 2) * bce)')} AS loss,
      {s6('sum(0.25::DOUBLE * pow(1 - exp(-bce), 2) * bce)', 4)} AS total FROM f GROUP BY layer, depth""",
)
def m12(spark, d):
    rows = bit_predictions(spark, d)
    elements = LS.focal_elements(F.col("logits"), F.col("bits"))
    mean = E.mean_element_loss(rows, KEYS, elements)
    total = E.sum_element_loss(rows, KEYS, elements, "total")
    return _rounded(mean, ["loss"]).join(total.withColumn("total", r6("total", 4)), KEYS)


@query(
    "m14_predict_rows",
    f"WITH {PRED_SQL} SELECT sample_id, layer, depth, y, yhat FROM pred",
)
def m14(spark, d):
    from layerlab.plans.probes import predictions_from_logits

    rows = layer_logits(spark, d).withColumnRenamed("y", "label")
    return predictions_from_logits(rows).select("sample_id", "layer", "depth", "y", "yhat")


