import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerlab.operators import corpus_stats as C
from layerlab.operators import evaluation as E
from layerlab.operators import experiments as X
from layerlab.operators import layer_stats as S


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    label = rng.choice([0, 0, 0, 1, 2], 120)
    vec = rng.normal(0, 1, (120, 5)) + label[:, None]
    label[0] = 9  # a class with one member
    return vec, label


def frame(spark, vec, label):
    rows = [("k", i, int(c), list(map(float, v))) for i, (v, c) in enumerate(zip(vec, label))]
    return spark.createDataFrame(rows, "layer string, sample_id long, label int, vec array<double>")


def silhouette(dist, label):
    scores = []
    for i in range(len(label)):
        own = (label == label[i]) & (np.arange(len(label)) != i)
        if not own.any():
            scores.append(0.0)
            continue
        a = dist[i, own].mean()
        b = min(dist[i, label == c].mean() for c in set(label) if c != label[i])
        scores.append((b - a) / max(a, b))
    return np.mean(scores)


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_silhouettes(spark, points, block_rows):
    vec, label = points
    sq = ((vec[:, None, :] - vec[None, :, :]) ** 2).sum(2)
    df = frame(spark, vec, label)
    exact = S.silhouette_exact(df, ["layer"], block_rows=block_rows).first().silhouette
    assert exact == pytest.approx(silhouette(np.sqrt(sq), label), abs=1e-10)
    assert -1 <= exact <= 1
    scalable = S.squared_silhouette(df, ["layer"]).first().silhouette
    assert scalable == pytest.approx(silhouette(sq, label), abs=1e-8)
    dist = S.class_distances(df, ["layer"], block_rows=block_rows)
    assert dist.count() == 120 * len(set(label))
    assert dist.agg(F.sum("dist_n")).first()[0] == 120 * 120


def test_silhouette_single_class(spark, points):
    vec, label = points
    df = frame(spark, vec, label * 0)
    assert S.silhouette_exact(df, ["layer"]).first().silhouette == -1
    assert S.squared_silhouette(df, ["layer"]).first().silhouette == -1


def test_squared_silhouette_without_labels_and_with_nan(spark, points):
    vec, label = points
    df = frame(spark, vec, label)
    nobody = spark.createDataFrame([("k", 900, None, [9.0] * 5)], df.schema)
    whole = S.squared_silhouette(df, ["layer"]).first().silhouette
    assert S.squared_silhouette(df.unionByName(nobody), ["layer"]).first().silhouette == pytest.approx(whole)
    odd = spark.createDataFrame([("k", 901, 1, [float("nan")] * 5)], df.schema)
    assert S.squared_silhouette(df.unionByName(odd), ["layer"]).first().silhouette == -1


def test_value_stats_with_ragged_vectors(spark):
    rows = [("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("a", [10.0]), ("a", []), ("b", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "layer string, vec array<double>")
    got = {r.layer: r for r in S.layer_value_stats(df, ["layer"]).collect()}
    values = np.array([1, 2, 3, 4, 10.0])
    assert got["a"].n_values == 5 and got["a"].value_max == 10
    assert got["a"].value_mean == pytest.approx(values.mean())
    assert got["a"].value_std == pytest.approx(values.std())
    assert got["b"].value_std == 0
    assert S.layer_value_median(df, ["layer"]).orderBy("layer").first().value_median == 3


def test_standardize_constant_dimension(spark):
    rows = [(0, i, "train" if i < 3 else "test", [float(i), 5.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "layer int, sample_id long, split string, vec array<double>")
    out = {r.sample_id: r.vec for r in S.standardize(df).collect()}
    std = np.std([0, 1, 2])
    assert out[3][0] == pytest.approx((3 - 1) / (std + 1e-8)) and out[3][1] == 0
    leaky = {r.sample_id: r.vec for r in S.standardize(df, train_only=False).collect()}
    assert leaky[3][0] == pytest.approx((3 - 1.5) / (np.std([0, 1, 2, 3]) + 1e-8))


def test_audit(spark):
    v = [0.0, 0.0]
    rows = [
        ("good", 0, {"layer_0": v, "layer_1": v}),
        ("good", 1, {"layer_0": v, "layer_1": v}),
        ("bad", 0, {"layer_0": v}),
        ("bad", 1, {"layer_0": v, "layer_1": v}),
        ("bad", 2, {"layer_0": [0.0]}),
    ]
    df = spark.createDataFrame(rows, "file string, pos int, layers map<string,array<double>>")
    audit = {r.file: r for r in S.structure_audit(df, ["file"]).collect()}
    assert audit["good"].consistent_layers and audit["good"].consistent_dimensions
    assert (audit["bad"].num_layers, audit["bad"].layer_anomalies, audit["bad"].dim_anomalies) == (1, 1, 1)
    found = {(r.pos, r.layer, r.found, r.expected) for r in S.structure_anomalies(df, ["file"]).collect()}
    assert found == {(1, None, 2, 1), (2, "layer_0", 1, 2)}


def test_scores_with_absent_classes(spark):
    rows = [(0, 0), (0, 0), (0, 5), (1, 1), (2, 1)]
    counts = E.confusion_counts(spark.createDataFrame(rows, "y int, yhat int"), [])
    by = {r["class"]: r for r in E.class_scores(counts, []).collect()}
    assert set(by) == {0, 1, 2, 5}
    assert by[5].f1 == 0 and by[2].recall == 0 and by[1].precision == 0.5
    f1 = [0.8, 2 / 3, 0, 0]
    assert E.macro_f1(counts, []).first()[0] == pytest.approx(np.mean(f1))
    assert E.weighted_f1(counts, []).first()[0] == pytest.approx((3 * 0.8 + 2 / 3) / 5)
    report = E.classification_report(counts, [], 28)
    assert report.count() == 31
    matrix = E.confusion_matrix(counts, []).toPandas()
    assert len(matrix) == 16 and matrix.n.sum() == 5
    assert matrix[matrix.y == 5].percent.sum() == 0
    assert matrix[matrix.y == 0].percent.sum() == pytest.approx(100)
    assert set(E.confusion_top_k(counts, [], 2).toPandas().y) == {0, 1}


def test_weighted_f1_agrees_with_spark_ml(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    df = spark.range(300).select((F.col("id") % 4).cast("double").alias("label"), (F.col("id") % 3).cast("double").alias("prediction"))
    counts = E.confusion_counts(df, [], "label", "prediction")
    for metric, value in (("f1", E.weighted_f1(counts, []).first()[0]), ("accuracy", E.accuracy(counts, []).first()[0])):
        assert value == pytest.approx(MulticlassClassificationEvaluator(metricName=metric).evaluate(df))


def test_multilabel(spark):
    rows = [([1, 0, 0], [1, 0, 0]), ([0, 1, 1], [0, 1, 0])]
    df = spark.createDataFrame(rows, "bits array<int>, pred array<int>")
    m = E.multilabel_metrics(df, []).first()
    assert (m.exact_match, m.hamming_loss) == (0.5, pytest.approx(1 / 6))
    assert m.per_label_accuracy == pytest.approx(5 / 6)
    assert E.micro_f1(df, []).first()[0] == pytest.approx(4 / 5)


def test_best_and_early_stop(spark):
    acc = [0.1, 0.5, 0.5, 0.2]
    log = spark.createDataFrame([("r", i, a) for i, a in enumerate(acc)], "run string, epoch int, accuracy double")
    assert X.best_epoch(log, ["run"]).first().best_epoch == 1
    loss = [5, 4, 4, 4, 3, 3, 3, 3, 3]
    log = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(loss)], "run string, epoch int, mean_loss double")
    assert X.early_stop_epoch(log, ["run"], patience=2).first().stop_epoch == 3
    assert X.early_stop_epoch(log, ["run"], patience=4).first().stop_epoch == 8
    assert X.early_stop_epoch(log, ["run"], patience=5).first().stop_epoch is None


def test_t_test_edge_cases(spark):
    rows = [("m", "d", layer, depth, 0.5) for layer in (0, 3) for depth in range(5)]
    rows += [("m", "d", 7, depth, 0.1 * depth) for depth in range(4)]
    df = spark.createDataFrame(rows, "model string, dataset string, layer int, depth int, acc double")
    out = {r.layer: r for r in X.paired_t_test(X.adjacent_layer_pairs(df)).collect()}
    assert out[0].next_layer == 3 and out[0].p is None  # no variance
    assert out[3].n == 4 and out[3].p is None  # a depth is missing


def test_result_keys(spark):
    df = spark.createDataFrame([("layer_12_3HL",), ("layer_1",), ("layer_x_1HL",), ("layer_2_yHL",)], "k string")
    layer, depth = X.parse_result_key(F.col("k"))
    assert [tuple(r) for r in df.select(layer, depth).collect()] == [(12, 3), (None, None), (None, None), (None, None)]
    model, dataset = X.parse_experiment_key(F.col("k"))
    keys = spark.createDataFrame([("gpt | news",), ("gpt",), ("a | b | c",)], "k string")
    assert [tuple(r) for r in keys.select(model, dataset).collect()] == [("gpt", "news"), ("gpt", "Unknown"), ("a | b | c", "Unknown")]


def test_corpus_edges(spark):
    df = spark.createDataFrame([(1, "aa aa bb", "x"), (2, "", "x"), (3, "cc", None)], "d int, t string, c string")
    w = {(r.d, r.term): r.weight for r in C.tfidf(df, "d", "t").collect()}
    assert w[(3, "cc")] == 1
    assert w[(1, "aa")] ** 2 + w[(1, "bb")] ** 2 == pytest.approx(1)
    means = {r.term: r.mean_tfidf for r in C.tfidf_by_class(df, "d", "t", "c", [], 2).collect()}
    assert means["aa"] == pytest.approx(w[(1, "aa")] / w[(1, "aa")] * means["aa"]) and set(means) == {"aa", "bb"}
    lex = spark.createDataFrame([("aa", 2.0), ("cc", -1.0)], "term string, valence double")
    s = {r.d: r.compound for r in C.lexicon_sentiment(df, "d", "t", lex).collect()}
    assert s == {1: pytest.approx(4 / np.sqrt(31)), 2: 0, 3: pytest.approx(-0.25)}
    h = C.histogram(spark.createDataFrame([(0.0,), (1.0,), (1.0,)], "v double"), "v", 2).orderBy("bin").collect()
    assert [r.n for r in h] == [1, 2]
    flat = C.histogram(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v", 2).orderBy("bin").collect()
    assert [r.n for r in flat] == [2, 0]


@pytest.mark.parametrize("repeated", [False, True])
def test_tfidf_over_blocks(spark, monkeypatch, capsys, repeated):
    """Many blocks give the plain weights; ids may repeat or be null; counts are dealt once and never by term."""
    monkeypatch.setattr(C, "BLOCK_BYTES", 300, raising=False)
    rng = random.Random(5)
    rows = [(d, " ".join(["every"] + [f"w{int(rng.expovariate(0.1))}" for _ in range(12)]), "ab"[d % 2]) for d in range(60)]
    rows += [(60, None, "a"), (None, "every w1 alone", "b")]
    if repeated:
        rows += [(d, text, c) for d, text, c in rows[:20]] + [(7, "every extra", "b"), (None, "every w2", "b")]
    out = C.tfidf(spark.createDataFrame(rows, "d long, t string, c string"), "d", "t")
    got = {(r.d, r.term): (r.tf, r.weight) for r in out.collect()}
    tf = Counter((d, w) for d, text, _ in rows for w in (text or "").split())
    seen = Counter(w for _, w in tf)
    raw = {k: n * (math.log((1 + len(rows)) / (1 + seen[k[1]])) + 1) for k, n in tf.items()}
    norm = Counter()
    for (d, _), x in raw.items():
        norm[d] += x * x
    assert got == {k: (n, pytest.approx(raw[k] / math.sqrt(norm[k[0]]))) for k, n in tf.items()}
    capsys.readouterr()
    out.explain()
    plan = capsys.readouterr().out.split("Initial Plan")[0]
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.count("explode(") == 1 and "ReusedExchange" in plan


def test_box_stats_narrowing(spark):
    rows = [("a", float(i)) for i in range(100)] + [("a", 1000.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    r = C.box_stats(df, "g", "v").first()
    assert (r.q1, r.median, r.q3) == (25, 50, 75)
    assert (r.whisker_low, r.whisker_high, r.outliers) == (0, 99, 1)


def test_density_integrates_to_one(spark):
    df = spark.range(500).select((F.col("id") % 37).cast("double").alias("v"))
    d = C.density_estimate(df, "v", 200, 6).orderBy("point").toPandas()
    assert np.trapezoid(d.density, d.x) == pytest.approx(1, abs=1e-3)


def test_small_p_values_keep_their_digits(spark):
    import math

    from layerlab.functions.significance import student_t_two_sided_p

    ts = [0.5, 1.0, 1.99, 2.0, 2.01, 10.0, 1e4, 3e4, 1e6]
    df = spark.createDataFrame([(t,) for t in ts], "t double")
    for r in df.select("t", student_t_two_sided_p(F.col("t"), 4).alias("p")).collect():
        # for four degrees of freedom 1 - s - s c^2 / 2 with s = t / sqrt(4 + t^2)
        c2 = 4 / (4 + r.t**2)
        s = math.sqrt(1 - c2)
        want = c2**2 * (2 + s) / (2 * (1 + s) ** 2)
        assert abs(r.p / want - 1) < 1e-9, r.t


def test_experiment_results(spark):
    one = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 0, 0)], "layer string, y int, yhat int")
    got = {r.layer: (r.acc, r.hamming) for r in X.experiment_results(one, ["layer"]).collect()}
    assert got == {"a": (0.5, 0.5), "b": (1.0, 0.0)}
    many = spark.createDataFrame([("a", [1, 0], [1, 1]), ("a", [0, 0], [0, 0])], "layer string, bits array<int>, pred array<int>")
    assert X.experiment_results(many, ["layer"], multilabel=True).first()[1:] == (0.5, 0.25)


def test_distance_sums_go_to_both_sides_over_tiles(monkeypatch):
    """One pass over the pairs gives both sums; a NaN stays with its class; equal vectors are at 0."""
    monkeypatch.setattr(S, "TILE", (3, 4))
    rng = np.random.default_rng(8)
    x, y = rng.normal(0, 1, (10, 3)), rng.normal(0, 1, (13, 3))
    y[2], y[12] = x[1], np.nan
    x_starts, y_starts = np.array([0, 1, 6]), np.array([0, 4, 11])
    with np.errstate(invalid="ignore"):
        of_x, of_y = S._class_sums(x, y, x_starts, y_starts)
    dist = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=-1))
    np.testing.assert_allclose(of_x, np.add.reduceat(dist, y_starts, axis=1), atol=1e-12)
    np.testing.assert_allclose(of_y, np.add.reduceat(dist, x_starts, axis=0).T, atol=1e-12)
    swapped = S._class_sums(y, x, y_starts, x_starts)
    np.testing.assert_allclose(swapped[0], of_y, atol=1e-12)
    np.testing.assert_allclose(swapped[1], of_x, atol=1e-12)
