import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from layerlab.functions import labels as L
from layerlab.functions import losses as LS
from layerlab.functions import vectors as V
from layerlab.functions.fixed_values import EMOTIONS
from layerlab.functions.significance import student_t_two_sided_p

FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, value, kind, fn):
    return spark.createDataFrame([(value,)], f"t {kind}").select(fn(F.col("t")).alias("o")).first()[0]


@pytest.mark.parametrize(
    ("raw", "ids"),
    [
        ("[27]", [27]),
        ("[6 7]", [6, 7]),
        ("[6, 7]", [6, 7]),
        ("[]", []),
        ("[28]", [28]),
        ("[ 3  4 ]", [3, 4]),
        ("[x]", [None]),
        (" [ 3 ] ", [None, 3, None]),
        (None, None),
    ],
)
def test_parse(spark, raw, ids):
    assert one(spark, raw, "string", L.parse_label_list) == ids


def test_bad_label_and_arity(spark):
    assert one(spark, "[x]", "string", lambda c: L.has_bad_label(L.parse_label_list(c)))
    assert not one(spark, [], "array<int>", L.label_arity_ok)
    assert not one(spark, None, "array<int>", L.label_arity_ok)
    assert one(spark, [1, 2], "array<int>", L.label_arity_ok)


@FEW
@given(st.lists(st.lists(st.integers(0, 27), max_size=5), min_size=1, max_size=40))
def test_round_trips(spark, lists):
    df = spark.createDataFrame([(x,) for x in lists], "ids array<int>")
    again = df.select(
        "ids",
        L.parse_label_list(L.format_label_list(F.col("ids"))).alias("parsed"),
        L.flags_to_labels(L.multi_hot(F.col("ids"))).alias("set"),
        L.dominant_label(F.col("ids")).alias("dominant"),
        F.size(V.pad_or_truncate(F.col("ids"), 3)).alias("width"),
    )
    for ids, parsed, unique, dominant, width in again.collect():
        assert parsed == ids
        assert unique == sorted(set(ids))
        assert dominant == (min(ids) if ids else 0)
        assert width == 3


def test_groups_and_names(spark):
    def group(ids):
        return one(spark, ids, "array<int>", lambda c: L.sentiment_group(L.label_names(c, EMOTIONS)))

    assert group([2, 17]) == "positive"
    assert group([2, 6]) == "negative"
    assert group([27]) == "ambiguous"
    assert group([]) == "neutral" and group([99]) == "neutral" and group(None) == "neutral"


def test_zero_index(spark):
    assert one(spark, " 7 ", "string", L.zero_index_label) == 6
    assert one(spark, 1, "int", L.zero_index_label) == 0


def test_vectors(spark):
    assert one(spark, "[1,2]", "string", V.vector_from_text) == [1.0, 2.0]
    assert one(spark, "n/a", "string", V.vector_from_text) is None
    assert one(spark, [[1.0, 2.0], [3.0]], "array<array<double>>", V.flatten_nested) == [1.0, 2.0, 3.0]
    assert one(spark, [1.0, 5.0, 5.0], "array<double>", V.argmax) == 1
    assert one(spark, [0.0, 1e-9], "array<double>", V.threshold) == [0, 1]
    assert one(spark, [0.0, 0.0], "array<double>", lambda c: V.cosine(c, c)) is None
    m = spark.createDataFrame([([1.0, 2.0, 6.0],)], "v array<double>").select(
        *[c.alias(n) for n, c in V.row_moments(F.col("v")).items()]
    ).first()
    assert (m.v_min, m.v_max, m.v_mean) == (1.0, 6.0, 3.0)
    assert m.v_std == pytest.approx(np.std([1, 2, 6]))
    assert one(spark, 1234.5678, "double", V.round_display) == "1234.568"
    assert one(spark, 0.0, "double", V.neg_log10) == math.inf
    assert one(spark, 0.01, "double", V.neg_log10) == pytest.approx(2)
    assert one(spark, None, "double", V.neg_log10) is None


def test_losses_against_numpy(spark):
    rng = np.random.default_rng(3)
    logits = rng.normal(0, 8, (40, 6))
    bits = (rng.random((40, 6)) < 0.3).astype(int)
    y = rng.integers(0, 6, 40)
    w = rng.uniform(0.5, 9, 6)
    rows = [(list(map(float, a)), list(map(int, b)), int(c)) for a, b, c in zip(logits, bits, y)]
    df = spark.createDataFrame(rows, "x array<double>, b array<int>, y int")
    pw = F.array(*[F.lit(float(v)) for v in w])
    got = df.select(
        LS.bce_elements(F.col("x"), F.col("b")).alias("bce"),
        LS.bce_elements(F.col("x"), F.col("b"), pw).alias("wbce"),
        LS.focal_elements(F.col("x"), F.col("b")).alias("focal"),
        LS.nll_row(F.col("x"), F.col("y")).alias("nll"),
        LS.multi_margin_row(F.col("x"), F.col("y")).alias("mm"),
    ).toPandas()
    pos, neg = np.logaddexp(0, -logits), np.logaddexp(0, logits)
    bce = bits * pos + (1 - bits) * neg
    wbce = w * bits * pos + (1 - bits) * neg
    np.testing.assert_allclose(np.stack(got.bce), bce, rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose(np.stack(got.wbce), wbce, rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose(np.stack(got.focal), 0.25 * (1 - np.exp(-bce)) ** 2 * bce, rtol=1e-6, atol=1e-9)
    nll = np.log(np.exp(logits).sum(1)) - logits[np.arange(40), y]
    np.testing.assert_allclose(got.nll, nll, rtol=1e-6, atol=1e-9)
    margin = np.maximum(0, 1 - logits[np.arange(40), y][:, None] + logits)
    margin[np.arange(40), y] = 0
    np.testing.assert_allclose(got.mm, margin.sum(1) / 6, rtol=1e-9)


def test_loss_registry():
    assert LS.loss_by_name("ce", False) is LS.nll_row
    with pytest.raises(ValueError):
        LS.loss_by_name("hinge", True)


@pytest.mark.parametrize(("t", "df", "p"), [(1.7, 4, 0.164355), (2.0, 1, 0.295167), (2.0, 2, 0.183503), (2.0, 3, 0.139326), (2.0, 5, 0.101939), (2.0, 10, 0.073388)])
def test_student_t(spark, t, df, p):
    got = spark.range(1).select(student_t_two_sided_p(F.lit(t), df)).first()[0]
    assert got == pytest.approx(p, abs=2e-6)
    n = 200_000
    x = np.linspace(t, 2000, n)
    density = math.gamma((df + 1) / 2) / (math.sqrt(df * math.pi) * math.gamma(df / 2)) * (1 + x * x / df) ** (-(df + 1) / 2)
    if df > 2:
        assert got == pytest.approx(2 * np.trapezoid(density, x), abs=1e-4)
