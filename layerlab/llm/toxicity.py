"""6. Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade > j) = sigmoid(w x - t_j) with one weight vector for all ordered
thresholds t_0 < t_1 < ...; the expected severity is the sum of these over j.
Features are the presence of words and of word beginnings (five code points).
They are many and most say nothing, so those are kept that go with toxic rows
more than chance explains among a million (chi-square of `LEAST_CHI`), at most
the `N_FEATURES` strongest; their weights are not negative.

The model is fitted on at most about `SAMPLE_ROWS` labelled rows, taken by hash of
the id; documents are all scored. The labels say toxic or not; toxic rows are
split at their median number of kept features into mild (1) and severe (2), so
that there are ordered grades to learn.

Defined results: a null or empty text has no features; label rows without an id
or a label are left out, of several the most severe counts. Without labels of
both kinds nothing is toxic (severity 0).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerlab.llm.common import map_batches
from layerlab.plans.materialize import via_parquet

SAMPLE_ROWS = 20_000
N_FEATURES = 2_000
LEAST_CHI = 25
BEGINNING = 5
PENALTY = 2e-6
STEPS = 600

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words | {w[:BEGINNING] + "*" for w in words if len(w) > BEGINNING}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by feature and ordered thresholds."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def score(self, text: str | None) -> float:
        weights = self.weights
        return sum(weights[f] for f in weights.keys() & features(text or ""))

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold j, by row."""
        return _sigmoid(scores[:, None] - np.array(self.thresholds))


def fit_ordinal(
    rows: list[np.ndarray], grades: np.ndarray, n_features: int, penalty: float = PENALTY, steps: int = STEPS
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient steps (Adam) on the penalised likelihood.

    `rows` are the present features. Thresholds are the first one and positive
    gaps, so they stay ordered.
    """
    n, top = len(rows), int(grades.max())
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    place = np.concatenate(rows).astype(np.int64) if len(owner) else np.empty(0, np.int64)
    share = np.array([(grades > j).mean() for j in range(top)]).clip(1e-6, 1 - 1e-6)
    first = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(first), 1e-2))
    theta = np.concatenate((np.zeros(n_features), first[:1], gaps))
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def split(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, t = theta[:n_features], theta[n_features:]
        return w, np.cumsum(np.concatenate((t[:1], np.exp(t[1:]))))

    at = np.arange(n)
    for step in range(1, steps + 1):
        w, t = split(theta)
        score = np.bincount(owner, w[place], n)
        edges = np.column_stack([np.full(n, -np.inf), np.tile(t, (n, 1)), np.full(n, np.inf)]) - score[:, None]
        cdf = _sigmoid(edges)
        low, high = cdf[at, grades], cdf[at, grades + 1]
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p / n, low * (1 - low) / p / n
        by_threshold = np.array(
            [d_high[grades == j].sum() - d_low[grades == j + 1].sum() for j in range(top)]
        )
        tail = np.cumsum(by_threshold[::-1])[::-1]
        grad = np.concatenate(
            (
                np.bincount(place, (d_high - d_low)[owner], n_features) + penalty * w,
                -tail[:1],
                -tail[1:] * np.exp(theta[n_features + 1 :]),
            )
        )
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        theta[:n_features] = np.maximum(theta[:n_features], 0.0)
    return split(theta)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, max_rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "toxic",
) -> DataFrame:
    """(text, toxic) of about `max_rows` labelled documents at most, by hash of the id."""
    known = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("label_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    )
    n = known.count()
    part = F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_rows / max(n, 1)))
    # at most about max_rows narrow rows, so this side may be broadcast
    sample = F.broadcast(known.filter(part))
    texts = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).alias("text"))
    joined = texts.join(sample, "label_id").select("text", "toxic")
    return via_parquet(joined.repartition(docs.sparkSession.sparkContext.defaultParallelism), "labelled")


def associated_features(sample: DataFrame, n_features: int = N_FEATURES) -> list[str]:
    """Features with the largest signed chi-square for toxic rows; ties by name."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for f in features(text or ""):
                    counts.setdefault(f, [0, 0])[toxic > 0] += 1
        columns = [
            pa.array(list(counts), pa.string()),
            pa.array([c[0] for c in counts.values()], pa.int64()),
            pa.array([c[1] for c in counts.values()], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["feature", "clean", "toxic"])

    counts = (
        sample.mapInArrow(count, "feature string, clean long, toxic long")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    sizes = {bool(r["t"]): r["n"] for r in sample.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    a, b, n1, n0 = F.col("toxic"), F.col("clean"), F.lit(sizes.get(True, 0)), F.lit(sizes.get(False, 0))
    cross = (a * (n0 - b) - b * (n1 - a)).cast("double")
    all_rows = (n1 + n0).cast("double")
    chi = cross * F.abs(cross) * all_rows / ((a + b) * (n1 + n0 - a - b + 1) * n1 * n0 + 1)
    top = counts.withColumn("chi", chi).filter(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "feature").limit(n_features)
    return [r["feature"] for r in top.collect()]


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = SAMPLE_ROWS, n_features: int = N_FEATURES,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> OrdinalModel:
    """The model of a bounded labelled sample."""
    sample = labelled_sample(docs, labels, max_rows, id_col, text_col, label_col)
    names = associated_features(sample, n_features)
    if not names:
        return OrdinalModel({}, (np.inf,))
    number = docs.sparkSession.sparkContext.broadcast({f: k for k, f in enumerate(names)})

    def present(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = number.value
        found = [features(t or "") for t in batch.column("text").to_pylist()]
        lists = pa.array([sorted(known[f] for f in x & known.keys()) for x in found], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), lists], names=["toxic", "f"])

    rows = map_batches(sample, present, "toxic int, f array<int>").collect()
    if len({r["toxic"] > 0 for r in rows}) < 2:
        return OrdinalModel({}, (np.inf,))
    found = [np.array(r["f"], np.int64) for r in rows]
    toxic = np.array([r["toxic"] > 0 for r in rows])
    number_of = np.array([len(r["f"]) for r in rows])
    severe = toxic & (number_of > np.median(number_of[toxic]))
    weights, thresholds = fit_ordinal(found, toxic.astype(int) + severe, len(names))
    return OrdinalModel(dict(zip(names, weights.tolist())), tuple(thresholds.tolist()))


def graded(docs: DataFrame, model: OrdinalModel, text: Column | str = "text") -> DataFrame:
    """`docs` with a struct `toxicity`: severity (expected grade), p_toxic, grade, toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("severity double, p_toxic double, grade int, toxic boolean")
    def grade(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        above = m.above(np.array([m.score(t) for t in texts], float))
        return pd.DataFrame(
            {
                "severity": above.sum(axis=1),
                "p_toxic": above[:, 0],
                "grade": (above >= 0.5).sum(axis=1).astype("int32"),
                "toxic": above[:, 0] >= 0.5,
            }
        )

    return docs.withColumn("toxicity", grade(text))
