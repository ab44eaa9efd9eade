"""Layer analysis end to end: vectors and labels in, result tables out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerlab.operators import evaluation as E
from layerlab.operators import layer_stats as S
from layerlab.operators import tables as TB
from layerlab.plans.materialize import via_parquet
from layerlab.plans.probes import Failures, ProbeData, probe_mlp
from layerlab.sources.sinks import load_results, save_results

TABLES = ("predictions", "metrics", "confusion", "centroids", "similarities", "silhouettes", "summary")


@dataclass
class LayerAnalysis:
    """Result tables of one analysis; all are long tables keyed by layer and split."""

    predictions: DataFrame
    metrics: DataFrame
    confusion: DataFrame
    centroids: DataFrame
    similarities: DataFrame
    silhouettes: DataFrame
    summary: DataFrame

    def save(self, path: str) -> None:
        for name in TABLES:
            save_results(getattr(self, name), f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LayerAnalysis:
        return cls(**{name: load_results(spark, f"{path}/{name}") for name in TABLES})


def labelled_vectors(
    vectors: DataFrame,
    labels: DataFrame,
    label: str,
    layers: Sequence[int] | None = None,
    stratified: bool = False,
    test: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """(sample_id, layer, vec, label, split): codes by alphabetical class, 80/20 split.

    Samples without a label and labels without a vector drop out of the inner
    join. Requesting a layer that does not exist is an error.
    """
    if layers is not None:
        wanted = vectors.sparkSession.createDataFrame([(k,) for k in layers], "layer int")
        TB.require_layers(wanted, vectors.select("layer").distinct())
        vectors = vectors.filter(F.col("layer").isin(list(layers)))
    ids = vectors.select("sample_id").distinct()
    known = labels.select("sample_id", label).join(ids, "sample_id", "left_semi")
    coded = TB.encode_labels(known, label, "label").select("sample_id", "label")
    if stratified:
        split = TB.stratified_split(coded, "sample_id", "label", test, seed)
    else:
        split = TB.random_split(coded, "sample_id", test, seed)
    return TB.align_vectors_labels(vectors.select("sample_id", "layer", "vec"), split)


def analyze_layers(
    rows: DataFrame,
    hidden: Sequence[int] = (),
    max_iter: int = 100,
    train_only: bool = True,
    exact_silhouette: bool = False,
    threads: int = 4,
) -> tuple[LayerAnalysis, Failures]:
    """One classifier per layer, scores, confusion, centroids, silhouettes, summary.

    The silhouette takes squared distances and is linear in the rows;
    `exact_silhouette=True` asks for the Euclidean one, which is quadratic in the
    rows of a layer and split. Predictions and silhouettes are written once and
    read by all that follows.
    """
    data = ProbeData(rows, train_only=train_only)
    predictions, failures = probe_mlp(data, list(hidden), max_iter, threads=threads)
    predictions = via_parquet(predictions, "predictions")
    keys = ["layer", "split"]
    counts = E.confusion_counts(predictions, keys)
    centroids = S.class_centroids(data.table, keys)
    score = S.silhouette_exact if exact_silhouette else S.squared_silhouette
    silhouettes = via_parquet(score(data.table, keys), "silhouettes")
    metrics = (
        E.accuracy(counts, keys)
        .join(E.macro_f1(counts, keys), keys)
        .join(E.weighted_f1(counts, keys), keys)
    )
    return LayerAnalysis(
        predictions=predictions,
        metrics=metrics,
        confusion=E.confusion_matrix(counts, keys),
        centroids=centroids,
        similarities=S.centroid_cosine(centroids, keys),
        silhouettes=silhouettes,
        summary=E.summary_table(counts, silhouettes.filter("split = 'test'")),
    ), failures
