import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from layerlab.operators import evaluation as E
from layerlab.operators.tables import skip_done_batches, stratified_split
from layerlab.plans import descent as D
from layerlab.plans import networks as N
from layerlab.plans import probes as P
from layerlab.plans import tuning as T
from layerlab.plans.analysis import LayerAnalysis, analyze_layers, labelled_vectors
from layerlab.plans.encode import HashEncoder, encode_layers
from layerlab.queries import probe_queries as PQ


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(150):
        c = i % 3
        rows.append((i, 0, c, list(map(float, rng.normal(0, 1, 4)))))  # noise
        rows.append((i, 1, c, list(map(float, rng.normal(0, 1, 4) + 4 * np.eye(4)[c]))))  # separable
    df = spark.createDataFrame(rows, "sample_id long, layer int, label int, vec array<double>")
    split = stratified_split(df.filter("layer = 0").select("sample_id", "label"), "sample_id").select("sample_id", "split")
    return P.ProbeData(df.join(split, "sample_id").withColumn("labels", F.array("label", F.lit(3))), ["labels"])


def scores(predicted, failures):
    return {(r.layer, r.depth): r.accuracy for r in P.layer_accuracies(predicted, failures).collect()}


def test_logistic_family(data):
    assert data.layers == [0, 1] and data.classes == 3
    for probe in (P.probe_logistic, P.probe_weighted, P.probe_one_vs_rest):
        got = scores(*probe(data, 30))
        assert got[(1, 0)] > 0.9 > got[(0, 0)]


def test_logistic_matches_penalised_optimum(data):
    """At the optimum the gradient of summed loss + |w|^2 / 2 is zero."""
    rows = data.layer(1).filter("split = 'train'")
    model = P._logistic(200, data.shapes[1][1], family="multinomial", tol=1e-10).fit(rows)
    pdf = rows.toPandas()
    x = np.stack([v.toArray() for v in pdf.features])
    y = np.eye(3)[pdf.label.astype(int)]
    w = model.coefficientMatrix.toArray()
    z = x @ w.T + model.interceptVector.toArray()
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    assert np.abs((p - y).T @ x + w).max() < 1e-3


def test_mlp_and_plan(data):
    predicted, failures = P.train_all_layers(data, [[], [8]], 40)
    got = scores(predicted, failures)
    assert set(got) == {(0, 0), (1, 0), (0, 1), (1, 1)} and got[(1, 1)] > 0.8


def test_networks_of_all_layers_share_their_passes(data, monkeypatch):
    """As many passes as the longest fit needs, not as all fits; every core has rows of a layer."""
    passes, plain = [], N._pass
    monkeypatch.setattr(N, "_pass", lambda blocks, weights, sizes: passes.append(sorted(weights)) or plain(blocks, weights, sizes))
    predicted, failures = P.probe_mlp(data, [8], 5)
    assert not failures and passes[0] == [0, 1] and len(passes) < 20
    assert scores(predicted, failures)[1, 1] > 0.5
    blocks = N.training_blocks(data, data.layers)
    rows = blocks.map(lambda r: (r[0], len(r[1]))).glom().collect()
    assert all(len({k for k, _ in part}) == 1 for part in rows)
    sizes = [sum(n for _, n in part) for part in rows]
    assert sum(sizes) == 240 and max(sizes) - min(sizes) <= 8


def test_slope_of_a_network_and_its_lowest_point():
    rng = np.random.default_rng(5)
    x, bits, sizes = rng.normal(0, 1, (40, 3)), np.eye(4)[rng.integers(0, 4, 40)], [3, 5, 4]
    w = N.initial_weights(sizes, 1)
    slope = N.loss_and_slope(w, sizes, x, bits)[1]
    for k in range(len(w)):
        up, down = w.copy(), w.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        assert abs((N.loss_and_slope(up, sizes, x, bits)[0] - N.loss_and_slope(down, sizes, x, bits)[0]) / 2e-6 - slope[k]) < 1e-5
    scale, goal = np.arange(1.0, 9.0) ** 2, np.arange(8.0)
    steps = N.lbfgs(np.zeros(8), 100, 1e-12)
    at = next(steps)
    with pytest.raises(StopIteration) as end:
        while True:
            at = steps.send((float(scale @ (at - goal) ** 2), 2 * scale * (at - goal)))
    np.testing.assert_allclose(end.value.value, goal, atol=1e-4)


def test_layers_without_classes_or_vectors_have_a_reason(spark):
    rows = [(i, k, (None if (k, i) == (1, 0) else i % 2), "train", [float(i % 2), float(i)]) for i in range(20) for k in (0, 1)]
    odd = P.ProbeData(spark.createDataFrame(rows, "sample_id long, layer int, label int, split string, vec array<double>"), scale=False)
    predicted, failures = P.probe_mlp(odd, [4], 5)
    assert [f[:2] for f in failures] == [(1, 1)] and "without a class: 1" in failures[0][2]
    assert {r.layer for r in predicted.select("layer").distinct().collect()} == {0}


def test_failing_layer_scores_zero(data, monkeypatch):
    plain = data.layer
    monkeypatch.setattr(data, "layer", lambda k: plain(k).drop("features") if k == 0 else plain(k))
    predicted, failures = P.probe_logistic(data, 10)
    assert [f[:2] for f in failures] == [(0, 0)]
    assert scores(predicted, failures)[(0, 0)] == 0.0


def test_multilabel(data):
    predicted, failures = P.probe_multilabel(data, "labels", 4, 20)
    assert not failures
    m = {(r.layer, r.split): r for r in E.multilabel_metrics(predicted, ["layer", "split"]).collect()}
    assert m[(1, "test")].exact_match > 0.8
    always = predicted.select(F.min(F.get("pred", F.lit(3)))).first()[0]
    assert always == 1


def test_tune_records_failures(data):
    grid = [
        {"hidden_layers": [], "epochs": 10, "learning_rate": 0.3},
        {"hidden_layers": [8], "epochs": 10},
        {"loss_function": "hinge", "epochs": 10, "learning_rate": 0.3},
        {"loss_function": "focal", "epochs": 5, "learning_rate": 0.3, "weight_decay": 0.1},
        {"loss_function": "hinge", "hidden_layers": [8]},
        {"loss_function": "bce"},
    ]
    trials = {(r.layer, r.trial_id): r for r in T.tune(data, grid).collect()}
    assert len(trials) == 12
    assert [trials[1, i].status for i in range(6)] == ["done"] * 4 + ["failed"] * 2
    assert all(trials[1, i].metrics["accuracy"] > 0.9 for i in (0, 2, 3)) and trials[1, 4].metrics is None
    assert "cross-entropy only" in trials[1, 4].error and "not defined" in trials[1, 5].error
    assert "learning_rate" in trials[1, 0].acts and "learning_rate" not in trials[1, 1].acts
    assert trials[1, 0].falls and trials[1, 3].falls
    multi_grid = [{"epochs": 30, "learning_rate": 0.3}, {"hidden_layers": [8]}, {"loss_function": "hinge"}]
    multi = {r.trial_id: r for r in T.tune(data, multi_grid, "labels", 4).filter("layer = 1").collect()}
    assert multi[0].metrics["hamming_loss"] < 0.1 and [multi[i].status for i in (1, 2)] == ["failed"] * 2


def test_slopes_are_those_of_the_losses():
    rng = np.random.default_rng(4)
    for (name, many), loss in D.LOSSES.items():
        z = rng.normal(0, 2, (5, 2, 4))
        bits = rng.integers(0, 2, (5, 1, 4)).astype(float) if many else np.eye(4)[rng.integers(0, 4, 5)][:, None]
        bits = np.broadcast_to(bits, z.shape)
        _, slope = loss(z, bits)
        for at in np.ndindex(z.shape):
            up, down = z.copy(), z.copy()
            up[at] += 1e-6
            down[at] -= 1e-6
            numeric = (loss(up, bits)[0] - loss(down, bits)[0])[at[:2]] / 2e-6
            assert abs(numeric - slope[at]) < 1e-5, (name, many)


def test_heads_take_the_steps_of_adamw_on_any_layout(data):
    heads = [D.Head("ce", 0.1, 0.5), D.Head("focal", 0.01), D.Head("hinge", 0.05)]
    widths = {k: w for k, (w, _) in data.shapes.items()}
    runs = [
        D.train_heads(table, widths, 3, heads, 6, asked=[0, 6])
        for table in (data.table, data.table.repartition(5, "sample_id"))
    ]
    pdf = data.table.filter("layer = 1").toPandas()
    x, bits = np.stack(pdf.vec), np.eye(3)[pdf.label]
    train = (pdf.split == "train").to_numpy()
    for i, h in enumerate(heads):
        w, b = np.zeros((4, 3)), np.zeros(3)
        m = [np.zeros_like(a) for a in (w, b, w, b)]
        for step in range(1, 7):
            z = x[train] @ w + b
            slope = D.LOSSES[h.loss, False](z[:, None], bits[train][:, None])[1][:, 0] / train.sum()
            for k, (value, g) in enumerate(((w, x[train].T @ slope), (b, slope.sum(0)))):
                m[k] = 0.9 * m[k] + 0.1 * g
                m[k + 2] = 0.999 * m[k + 2] + 0.001 * g * g
                value *= 1 - h.learning_rate * h.weight_decay
                value -= h.learning_rate * m[k] / (1 - 0.9**step) / (np.sqrt(m[k + 2] / (1 - 0.999**step)) + 1e-8)
        for run in runs:
            np.testing.assert_allclose(run.after[6][1].w[:, i], w, atol=1e-9)
            np.testing.assert_allclose(run.after[6][1].b[i], b, atol=1e-9)
    log = runs[0].log.toPandas()
    assert len(log) == 2 * 3 * 7
    first = log[(log.layer == 1) & (log["head"] == 0) & (log.epoch == 0)].iloc[0]
    assert abs(first.train_loss - np.log(3)) < 1e-9
    assert (log[log.best].groupby(["layer", "head"]).size() == 1).all()
    scored = D.predict(data.table, runs[0].after[6], 3).filter("layer = 1 AND head = 0").toPandas()
    last = log[(log.layer == 1) & (log["head"] == 0) & (log.epoch == 6)].iloc[0]
    test = scored[scored.split != "train"]
    assert abs((test.y == test.yhat).mean() - last.val_accuracy) < 1e-9


def test_trials_are_fitted_at_once_and_scored_on_held_out_rows(data, monkeypatch):
    """The networks and the heads wait for each other's passes; no training row is predicted for the metrics."""
    from threading import Barrier

    both, plain, seen, predict = Barrier(3, timeout=60), {m: m._pass for m in (D, N)}, [], T.predict
    went: set = set()

    def meet(key):
        if key not in went:  # each fit waits in its first pass until all have begun
            went.add(key)
            both.wait()

    monkeypatch.setattr(D, "_pass", lambda *a: meet("heads") or plain[D](*a))
    monkeypatch.setattr(N, "_pass", lambda blocks, weights, sizes: meet(len(sizes[0])) or plain[N](blocks, weights, sizes))
    monkeypatch.setattr(T, "predict", lambda table, *a: seen.append({r.split for r in table.select("split").distinct().collect()}) or predict(table, *a))
    grid = [{"hidden_layers": h, "epochs": 6, "learning_rate": 0.3} for h in ([], [4], [4, 3])]
    trials = T.tune(data, grid).collect()
    assert [r.status for r in trials] == ["done"] * 6 and seen == [{"test"}]


def test_double_precision_goes_on_where_single_finds_no_lower_loss():
    scale, goal, kinds = np.arange(1.0, 9.0) ** 2, np.arange(8.0), []
    steps = N._in_turn(np.zeros(8), 100, (np.float32, np.float64))
    at = next(steps)
    with pytest.raises(StopIteration) as end:
        while True:
            kinds.append(at.dtype.type)
            at = at.astype(float)
            value, slope = float(scale @ (at - goal) ** 2) + 1, 2 * scale * (at - goal)
            # as coarse as products in single precision, or coarser
            at = steps.send((round(value, 2), slope) if kinds[-1] is np.float32 else (value, slope))
    assert kinds == sorted(kinds, key=[np.float32, np.float64].index) and set(kinds) == {np.float32, np.float64}
    np.testing.assert_allclose(end.value.value, goal, atol=1e-2)


def test_sums_of_heads_are_those_of_their_losses():
    """Blocks by class, head and row, a few rows at a time, against whole blocks by row."""
    rng = np.random.default_rng(6)
    n = D.ROWS_IN_CACHE + 40
    x, train = rng.normal(0, 1, (n, 3)), rng.random(n) < 0.5
    for many, names in ((False, ["ce", "hinge", "focal", "ce"]), (True, ["bce", "focal", "bce"])):
        bits = rng.integers(0, 2, (n, 4)).astype(float) if many else np.eye(4)[rng.integers(0, 4, n)]
        here = D.Weights(rng.normal(0, 1, (3, len(names), 4)), rng.normal(0, 1, (len(names), 4)))
        losses = [D.LOSSES[k, many] for k in names]
        got = D._sums(here, losses, x[train], bits[train], x[~train], bits[~train], many)
        z, want = here.logits(x), [[], [], [], [], []]
        for k, loss in enumerate(losses):
            by_row, slope = loss(z[:, k], bits)
            right = ((z[:, k] > 0) == (bits > 0.5)).all(1) if many else z[:, k].argmax(1) == bits.argmax(1)
            for a, v in zip(want, (x[train].T @ slope[train], slope[train].sum(0), by_row[train].sum(), by_row[~train].sum(), right[~train].sum())):
                a.append(v)
        flat = [np.stack(want[0], axis=1).reshape(-1), np.ravel(want[1]), *want[2:], [train.sum(), (~train).sum()]]
        np.testing.assert_allclose(got, np.concatenate(flat), atol=1e-9)


def test_depths_are_fitted_at_once_over_rows_dealt_once(data, monkeypatch):
    from threading import Barrier

    both, dealt, plain, fit = Barrier(2, timeout=60), [], N.training_blocks, N.train
    monkeypatch.setattr(N, "training_blocks", lambda *a: dealt.append(a) or plain(*a))
    monkeypatch.setattr(N, "train", lambda *a: both.wait() is None or fit(*a))
    predicted, failures = P.train_all_layers(data, [[4], [4, 3]], 3)
    assert not failures and len(dealt) == 1
    assert {(r.layer, r.depth) for r in predicted.select("layer", "depth").distinct().collect()} == {(k, n) for k in (0, 1) for n in (1, 2)}


def test_heads_stop_without_a_lower_validation_loss(data):
    widths = {k: w for k, (w, _) in data.shapes.items()}
    got = D.train_heads(data.table, widths, 3, [D.Head("ce", 1.0), D.Head("ce", 1e-4)], 40, patience=2)
    ends = got.log.groupBy("layer", "head").agg(F.max("epoch").alias("e")).collect()
    ends = {(r.layer, r["head"]): r.e for r in ends}
    assert ends[0, 0] < 20 and ends[1, 1] == 40


def test_epoch_log_is_that_of_the_written_logits(data):
    states = T.chunked_network(data, [], 30, 10)
    log = {(r.layer, r.epoch): r for r in T.epoch_log(states).collect()}
    files = sorted({f.replace("file://", "") for f in states.inputFiles()})
    want = duckdb.sql(
        f"""SELECT layer, epoch, avg(loss) FILTER (split = 'train') AS t, avg(loss) FILTER (split <> 'train') AS v FROM (
          SELECT *, ln(list_sum(list_transform(logits, lambda x: exp(x)))) - logits[y + 1] AS loss FROM read_parquet({files}))
        GROUP BY ALL"""
    ).fetchall()
    assert {(k, e) for k, e, _, _ in want} == set(log) == {(k, e) for k in (0, 1) for e in (10, 20, 30)}
    for k, e, t, v in want:
        assert abs(log[k, e].train_loss - t) < 1e-9 and abs(log[k, e].val_loss - v) < 1e-9
    for k in (0, 1):
        assert log[k, 30].train_loss <= log[k, 20].train_loss <= log[k, 10].train_loss
    best = T.best_states(states, T.epoch_log(states))
    assert best.groupBy("layer").agg(F.countDistinct("epoch").alias("n")).filter("n <> 1").isEmpty()
    stopped = T.chunked_network(data, [], 200, 10, patience=1)
    assert stopped.agg(F.max("epoch")).first()[0] < 200


def test_intercepts_alone_have_no_certificate(data):
    def certificate(max_iter):
        models = {}
        predicted, _ = P.probe_logistic(data, max_iter, keep=["features"], models=models)
        got = PQ._certificate(predicted, models, PQ._softmax(F.col("logits")), PQ._is, PQ._one, True, 2)
        return {(r.layer, r["class"], r.dim): r.value for r in got.collect()}

    good = certificate(500)
    assert all(v == 0 for (_, _, d), v in good.items() if d >= 0)
    assert all(good[k, c, -1] == 40 and good[k, c, -2] == 1 for k in (0, 1) for c in range(3))
    # class shares: intercepts without coefficients, as a fit that never sees the vectors
    flat = {k: [[0.0] * 4] * 3 for k in (0, 1)}
    shares = data.table.withColumn("features", array_to_vector("vec")).withColumn("y", F.col("label"))
    shares = shares.withColumn("logits", F.array(*[F.lit(0.0)] * 3))
    bad = PQ._certificate(shares, flat, PQ._softmax(F.col("logits")), PQ._is, PQ._one, True, 2)
    bad = {(r.layer, r["class"], r.dim): r.value for r in bad.collect()}
    assert all(bad[k, c, -1] == 40 and bad[k, c, -2] == 0 for k in (0, 1) for c in range(3))
    assert any(abs(bad[1, c, d]) > 0.1 for c in range(3) for d in range(4))


def test_projection(data):
    out = P.project_2d(data.table).toPandas()
    sizes = out.groupby(["layer", "split"]).size()
    assert dict(sizes) == {(k, s): n for k in (0, 1) for s, n in (("train", 120), ("test", 30))}
    assert out.x.var() > out.y.var() > 0


def test_encoder_resumes_and_pools(spark):
    df = spark.createDataFrame([(i, f"text {i}" if i else None, i // 2) for i in range(6)], "sample_id long, text string, batch_idx int")
    make = lambda: HashEncoder(2, 3)
    first = encode_layers(df, make, batch_size=2)
    assert first.count() == 12
    want = HashEncoder(2, 3)(["text 4"])
    got = {r.layer: r.vec for r in first.filter("sample_id = 4").collect()}
    np.testing.assert_allclose([got[0], got[1]], want[0, :, 0, :])
    last = encode_layers(df, make, pool="last", partitions=3).filter("sample_id = 4 AND layer = 1").first()
    np.testing.assert_allclose(last.vec, want[0, 1, -1, :])
    done = df.filter("batch_idx < 2")
    assert encode_layers(skip_done_batches(df, 0, done), make).select("sample_id").distinct().count() == 2


def test_analysis_saves_and_loads(spark, tmp_path):
    rng = np.random.default_rng(2)
    names = ["joy", "anger", "fear"]
    labels = [(i, names[i % 3]) for i in range(90)] + [(500, "joy"), (501, None)]
    vectors = [
        (i, k, list(map(float, rng.normal(0, 1, 3) + 5 * k * np.eye(3)[i % 3])))
        for i in range(90)
        for k in (0, 1, 7)
    ]
    v = spark.createDataFrame(vectors, "sample_id long, layer int, vec array<double>")
    lab = spark.createDataFrame(labels, "sample_id long, emotion string")
    with pytest.raises(ValueError, match="3"):
        labelled_vectors(v, lab, "emotion", [0, 3])
    rows = labelled_vectors(v, lab, "emotion", [0, 1])
    codes = {(r.sample_id % 3, r.label) for r in rows.collect()}
    assert codes == {(0, 2), (1, 0), (2, 1)}  # joy, anger, fear by alphabet
    analysis, failures = analyze_layers(rows, max_iter=20)
    assert not failures
    analysis.save(str(tmp_path / "run"))
    again = LayerAnalysis.load(spark, str(tmp_path / "run"))
    summary = {r.layer: r for r in again.summary.collect()}
    assert set(summary) == {0, 1} and summary[1].test_accuracy == 1.0
    assert summary[1].silhouette_score > summary[0].silhouette_score
    assert again.confusion.filter("layer = 1 AND split = 'test'").agg(F.sum("n")).first()[0] == 18
    assert again.similarities.count() == 2 * 2 * 3
    exact, _ = analyze_layers(rows, max_iter=5, exact_silhouette=True)
    assert exact.silhouettes.count() == 4
