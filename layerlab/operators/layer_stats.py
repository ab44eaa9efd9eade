"""Statistics over per-layer vectors: values, dimensions, centroids, separation.

Input is the long layout: one row per (sample, layer) with `vec` as an array.
Per-dimension moments use Spark ML's vector summarizer, a partial aggregate
over whole vectors, so values are never exploded and shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerlab.functions import vectors as V
from layerlab.plans.materialize import inline_if_small
from layerlab.plans.ordering import exact_quantiles, null_safe_join

VECTOR_TABLE_ROWS = 512


def _moments(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """One row per (keys, dim): n and arrays mean, m2 (sum of squared deviations), min, max."""
    dense = df.filter(F.size(vec) > 0).select(
        *keys, F.size(vec).alias("dim"), array_to_vector(F.col(vec)).alias("_v")
    )
    summed = dense.groupBy(*keys, "dim").agg(
        Summarizer.metrics("count", "mean", "variance", "min", "max").summary(F.col("_v")).alias("_m")
    )
    n = F.col("_m.count")
    return summed.select(
        *keys,
        "dim",
        n.alias("n"),
        vector_to_array("_m.mean").alias("mean"),
        F.transform(vector_to_array("_m.variance"), lambda v: v * (n - 1)).alias("m2"),
        vector_to_array("_m.min").alias("lo"),
        vector_to_array("_m.max").alias("hi"),
    )


def layer_value_stats(df: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    """Per key: dimension, count, mean, population std, min, max over all values.

    Generated code explodes and aggregates in one stage, so only one row per
    key and task is shuffled; vectors may differ in length.
    """
    values = df.select(*keys, F.posexplode(V.doubles(F.col(vec))).alias("_i", "_x"))
    return values.groupBy(*keys).agg(
        (F.max("_i") + 1).alias("dimension"),
        F.count("_x").alias("n_values"),
        F.avg("_x").alias("value_mean"),
        F.stddev_pop("_x").alias("value_std"),
        F.min("_x").alias("value_min"),
        F.max("_x").alias("value_max"),
    )


def layer_value_median(df: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    """Exact median over all values of each key."""
    values = df.select(*keys, F.explode(V.doubles(F.col(vec))).alias("_value"))
    return exact_quantiles(values, keys, "_value", [0.5], ["value_median"])


def file_global_stats(df: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    """Per batch file: count, min, max, mean, population std, median of all values."""
    moments = layer_value_stats(df, keys, vec).drop("dimension")
    return null_safe_join(moments, layer_value_median(df, keys, vec), list(keys), "inner")


def aggregate_file_stats(files: DataFrame, keys: Sequence[str] = (), n: str = "n_samples") -> DataFrame:
    """Number of files and mean samples per file."""
    return files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_files"), F.avg(n).alias("avg_samples")
    )


def nan_zero_report(df: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    """Per key: values, NaN values, zero values and their percentage."""
    values = df.select(*keys, F.explode(V.doubles(F.col(vec))).alias("_x"))
    zero = (F.col("_x") == 0.0).cast("long")
    return values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_values"),
        F.sum(F.isnan("_x").cast("long")).alias("n_nan"),
        F.sum(zero).alias("n_zero"),
        (F.lit(100.0) * F.sum(zero) / F.count(F.lit(1))).alias("zero_percent"),
    )


def dimension_moments(df: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    """Per key: arrays `mean` and population `std` by dimension, and n."""
    return _moments(df, keys, vec).select(
        *keys,
        "n",
        "mean",
        F.transform("m2", lambda s: F.sqrt(F.greatest(s, F.lit(0.0)) / F.col("n"))).alias("std"),
    )


def standardize(
    df: DataFrame,
    keys: Sequence[str] = ("layer",),
    vec: str = "vec",
    train_only: bool = True,
    split: str = "split",
) -> DataFrame:
    """(x - mean) / (std + 1e-8) with moments of the training rows.

    train_only=False takes the moments of all rows (test rows leak in).
    """
    base = df.filter(F.col(split) == "train") if train_only else df
    moments = inline_if_small(
        dimension_moments(base, keys, vec).select(
            *keys, F.col("mean").alias("_mean"), F.col("std").alias("_std")
        ),
        VECTOR_TABLE_ROWS,
    )
    return (
        null_safe_join(df, moments, list(keys), "inner")
        .withColumn(vec, V.scale(F.col(vec), F.col("_mean"), F.col("_std")))
        .drop("_mean", "_std")
    )


def class_centroids(
    df: DataFrame, keys: Sequence[str], label: str = "label", vec: str = "vec"
) -> DataFrame:
    """Mean vector and row count per key and class."""
    return _moments(df, [*keys, label], vec).select(
        *keys, label, "n", F.col("mean").alias("centroid")
    )


def centroid_pairs(centroids: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Unordered class pairs within a key, lower class first (C classes per key)."""
    a = centroids.select(*keys, F.col(label).alias("class_a"), F.col("centroid").alias("centroid_a"))
    b = centroids.select(*keys, F.col(label).alias("class_b"), F.col("centroid").alias("centroid_b"))
    return null_safe_join(a, b, list(keys), "inner").filter(F.col("class_a") < F.col("class_b"))


def centroid_cosine(centroids: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Cosine similarity of each centroid pair, with the key `a_vs_b`."""
    return centroid_pairs(centroids, keys, label).select(
        *keys,
        F.concat_ws("_vs_", F.col("class_a").cast("string"), F.col("class_b").cast("string")).alias("pair"),
        "class_a",
        "class_b",
        V.cosine(F.col("centroid_a"), F.col("centroid_b")).alias("cosine"),
    )


BLOCK_VALUES = 1 << 22
TILE = 1 << 9, 1 << 10  # rows and columns of the distances that are held at once


def _by_class(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """The rows by class, their vectors, the classes, and where each begins."""
    rows = rows.sort_values("_label", kind="stable")
    classes, starts = np.unique(rows["_label"].to_numpy(), return_index=True)
    return rows, np.stack(rows["_vec"].to_numpy()).astype(np.float64), classes, starts


def _class_sums(x: np.ndarray, y: np.ndarray, x_starts: np.ndarray, y_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances between x and y, by row of x and class of y, and by row of y and class of x."""
    x_sq, y_sq = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    # one product gives |x|^2 + |y|^2 - 2 x.y
    left = np.column_stack([-2.0 * x, x_sq, np.ones(len(x))])
    right = np.column_stack([y, np.ones(len(y)), y_sq]).T.copy()
    of_x, of_y = np.zeros((len(x), len(y_starts))), np.zeros((len(x_starts), len(y)))
    member = np.eye(len(x_starts))[np.searchsorted(x_starts, np.arange(len(x)), side="right") - 1].T
    held, marks = np.empty(TILE[0] * TILE[1]), np.empty(TILE[0] * TILE[1], bool)

    def cuts(starts: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """The classes within lo..hi, and where they begin there."""
        ends = np.append(starts[1:], hi)
        inside = np.flatnonzero((starts < hi) & (ends > lo))
        return inside, np.maximum(starts[inside] - lo, 0)

    for i in range(0, len(x), TILE[0]):
        i_end = min(i + TILE[0], len(x))
        for j in range(0, len(y), TILE[1]):
            j_end = min(j + TILE[1], len(y))
            y_in, y_at = cuts(y_starts, j, j_end)
            shape = i_end - i, j_end - j
            sq = np.matmul(left[i:i_end], right[:, j:j_end], out=held[: shape[0] * shape[1]].reshape(shape))
            # close pairs lose digits in the subtraction and are taken again directly
            close = (1e-6 * (x_sq[i:i_end] + y_sq[j:j_end].max()))[:, None]
            at = np.flatnonzero(np.less(sq, close, out=marks[: sq.size].reshape(shape)))
            for k in range(0, len(at), 65_536):
                a, b = np.divmod(at[k : k + 65_536], j_end - j)
                diff = x[i + a] - y[j + b]
                sq[a, b] = np.einsum("ij,ij->i", diff, diff)
            np.sqrt(sq, out=sq)
            of_x[i:i_end, y_in] += np.add.reduceat(sq, y_at, axis=1)
            down = member[:, i:i_end] @ sq
            if not np.isfinite(down).all():  # 0 times NaN would reach the other classes
                x_in, x_at = cuts(x_starts, i, i_end)
                down[:] = 0
                down[x_in] = np.add.reduceat(sq, x_at, axis=0)
            of_y[:, j:j_end] += down
    return of_x, of_y.T


def _block_distance_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Distance sums by class between the rows of two blocks (or within one)."""
    lo, hi = int(pdf["_lo"].iloc[0]), int(pdf["_hi"].iloc[0])
    left, right = pdf[pdf["_block"] == lo], pdf[pdf["_block"] == hi]
    keys = [c for c in pdf.columns if c.startswith("_k_")]

    def rows_of(rows: pd.DataFrame, sums: np.ndarray, classes: np.ndarray, starts: np.ndarray, others: int) -> pd.DataFrame:
        out = rows[keys + ["_id", "_label"]].loc[rows.index.repeat(len(classes))].reset_index(drop=True)
        out["other"] = np.tile(classes, len(rows))
        out["dist_sum"] = sums.ravel()
        out["dist_n"] = np.tile(np.diff(np.append(starts, others)), len(rows))
        return out

    columns = keys + ["_id", "_label", "other", "dist_sum", "dist_n"]
    if len(left) == 0 or len(right) == 0:
        return pd.DataFrame(columns=columns)
    left, x, x_classes, x_starts = _by_class(left)
    if lo == hi:
        return rows_of(left, _class_sums(x, x, x_starts, x_starts)[0], x_classes, x_starts, len(x))[columns]
    right, y, y_classes, y_starts = _by_class(right)
    of_x, of_y = _class_sums(x, y, x_starts, y_starts)
    parts = [rows_of(left, of_x, y_classes, y_starts, len(y)), rows_of(right, of_y, x_classes, x_starts, len(x))]
    return pd.concat(parts)[columns]


def class_distances(
    df: DataFrame,
    keys: Sequence[str],
    sample: str = "sample_id",
    label: str = "label",
    vec: str = "vec",
    block_rows: int = 4096,
) -> DataFrame:
    """Per sample and class: sum of Euclidean distances to the class, and row count.

    Exact, all rows, over blocks: a task receives two blocks of vectors, takes each
    distance between them once and returns sums by class to both sides, so neither the
    pairs nor a whole key are ever gathered. Blocks have about `block_rows` vectors, and
    up to eight times as many in large keys (BLOCK_VALUES at most), so that fewer copies
    of the vectors and fewer partial sums are sent. The work is quadratic in the rows of a key by
    definition; squared_silhouette is the linear alternative.
    """
    n, width = F.count(F.lit(1)), F.coalesce(F.greatest(F.max(F.size(vec)), F.lit(1)), F.lit(1))
    most = F.greatest(F.lit(block_rows), F.least(n / 8, F.lit(8 * block_rows), BLOCK_VALUES / width))
    blocks = df.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(n / most)).cast("int").alias("_nb"))
    rows = null_safe_join(df, inline_if_small(blocks), list(keys), "inner").select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(sample).cast("long").alias("_id"),
        F.col(label).cast("int").alias("_label"),
        V.doubles(F.col(vec)).alias("_vec"),
        F.pmod(F.xxhash64(F.col(sample)), F.col("_nb")).cast("int").alias("_block"),
        "_nb",
    )
    paired = rows.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    paired = (
        paired.withColumn("_lo", F.least("_block", "_with"))
        .withColumn("_hi", F.greatest("_block", "_with"))
        .drop("_with", "_nb")
    )
    group = [f"_k_{k}" for k in keys] + ["_lo", "_hi"]
    types = {f.name: f.dataType.simpleString() for f in paired.schema}
    schema = ", ".join(
        [f"{c} {types[c]}" for c in group if c.startswith("_k_")]
        + ["_id long", "_label int", "other int", "dist_sum double", "dist_n long"]
    )
    partial = paired.groupBy(*group).applyInPandas(_block_distance_sums, schema)
    return (
        partial.groupBy(*[f"_k_{k}" for k in keys], "_id", "_label", "other")
        .agg(F.sum("dist_sum").alias("dist_sum"), F.sum("dist_n").alias("dist_n"))
        .select(
            *[F.col(f"_k_{k}").alias(k) for k in keys],
            F.col("_id").alias(sample),
            F.col("_label").alias(label),
            F.col("other").alias("other_label"),
            "dist_sum",
            "dist_n",
        )
    )


def _silhouette_from_means(per_sample: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of (b - a) / max(a, b); 0 for singletons.

    -1 with fewer than two classes or where a distance is not a number.
    """
    a, b = F.col("_a"), F.col("_b")
    s = F.when(a.isNull(), 0.0).when(F.greatest(a, b) == 0, 0.0).otherwise((b - a) / F.greatest(a, b))
    return per_sample.groupBy(*keys).agg(
        F.when((F.count("_b") == 0) | F.isnan(F.avg(s)), -1.0).otherwise(F.avg(s)).alias("silhouette")
    )


def silhouette_exact(
    df: DataFrame,
    keys: Sequence[str],
    sample: str = "sample_id",
    label: str = "label",
    vec: str = "vec",
    block_rows: int = 4096,
) -> DataFrame:
    """Euclidean silhouette score per key."""
    dist = class_distances(df, keys, sample, label, vec, block_rows)
    own = F.col(label) == F.col("other_label")
    inner = F.sum(F.when(own & (F.col("dist_n") > 1), F.col("dist_sum") / (F.col("dist_n") - 1)))
    outer = F.min(F.when(~own, F.col("dist_sum") / F.col("dist_n")))
    per_sample = dist.groupBy(*keys, sample, label).agg(inner.alias("_a"), outer.alias("_b"))
    return _silhouette_from_means(per_sample, keys)


def squared_silhouette(
    df: DataFrame, keys: Sequence[str], label: str = "label", vec: str = "vec"
) -> DataFrame:
    """Silhouette with squared Euclidean distance, linear in the rows.

    The mean squared distance from x to a class is |x|^2 + mean|y|^2 - 2 x.c,
    so each row needs only its key's centroids, which are joined as one array per
    key. Rows without a label or a vector take no part; with a NaN in a vector the
    key has -1.
    """
    dense = df.filter(F.col(label).isNotNull()).select(*keys, F.col(label).cast("int").alias("_label"), V.doubles(F.col(vec)).alias("_vec"))
    classes = _moments(dense, [*keys, "_label"], "_vec").select(
        *keys,
        F.col("_label").alias("c"),
        "n",
        F.col("mean").alias("m"),
        # mean |y|^2 = sum over dimensions of mean^2 + m2 / n
        F.aggregate(
            F.zip_with("mean", "m2", lambda m, s: m * m + s / F.col("n")), F.lit(0.0), lambda a, v: a + v
        ).alias("q"),
    )
    return _silhouette_from_means(_class_means(dense, classes, keys), keys)


def _class_means(dense: DataFrame, classes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _a, _b): mean squared distance to the own and the nearest other class."""
    table = classes.groupBy(*keys).agg(F.collect_list(F.struct("c", "n", "m", "q")).alias("_classes"))
    sq = F.aggregate("_vec", F.lit(0.0), lambda a, v: a + v * v)
    joined = null_safe_join(dense.filter(F.size("_vec") > 0), table, list(keys), "inner").withColumn("_sq", sq)

    def mean_sq(c: Column) -> Column:
        return F.col("_sq") + c["q"] - 2.0 * V.dot(F.col("_vec"), c["m"])

    own = F.filter("_classes", lambda c: c["c"] == F.col("_label"))
    others = F.filter("_classes", lambda c: c["c"] != F.col("_label"))
    return joined.select(
        *keys,
        F.get(
            F.transform(own, lambda c: F.when(c["n"] > 1, mean_sq(c) * c["n"] / (c["n"] - 1))), F.lit(0)
        ).alias("_a"),
        F.array_min(F.transform(others, mean_sq)).alias("_b"),
    )


def structure_audit(
    samples: DataFrame, file_keys: Sequence[str], pos: str = "pos", layers: str = "layers"
) -> DataFrame:
    """Per file: samples, expected shape (first sample), deviations, two flags.

    `layers` is the map layer -> vector of a sample. Samples are reduced to
    their shape and counted before anything is compared, so a file's size does
    not matter.
    """
    dims = F.transform(F.map_values(layers), lambda v: F.size(v))
    shapes = (
        samples.select(*file_keys, F.col(pos).alias("_pos"), F.size(layers).alias("_n"), dims.alias("_dims"))
        .groupBy(*file_keys, "_n", "_dims")
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_pos").alias("_first"))
    )
    expected = shapes.groupBy(*file_keys).agg(
        F.min_by(
            F.struct(F.col("_n").alias("n"), F.coalesce(F.get("_dims", F.lit(0)), F.lit(0)).alias("d")), "_first"
        ).alias("_e")
    )
    off_layers = F.sum(F.when(F.col("_n") != F.col("_e.n"), F.col("_c")).otherwise(0))
    off_dims = F.sum(F.col("_c") * F.size(F.filter("_dims", lambda d: d != F.col("_e.d"))))
    return (
        null_safe_join(shapes, expected, list(file_keys), "inner")
        .groupBy(*file_keys)
        .agg(
            F.sum("_c").alias("total_samples"),
            F.max("_e.n").alias("num_layers"),
            F.max("_e.d").alias("hidden_dimension"),
            off_layers.cast("long").alias("layer_anomalies"),
            off_dims.cast("long").alias("dim_anomalies"),
        )
        .withColumn("consistent_layers", F.col("layer_anomalies") == 0)
        .withColumn("consistent_dimensions", F.col("dim_anomalies") == 0)
    )


def structure_anomalies(
    samples: DataFrame, file_keys: Sequence[str], pos: str = "pos", layers: str = "layers"
) -> DataFrame:
    """One row per deviation: a sample's layer count or a layer's length."""
    audit = structure_audit(samples, file_keys, pos, layers).select(
        *file_keys, F.col("num_layers").alias("_n"), F.col("hidden_dimension").alias("_d")
    )
    joined = null_safe_join(samples, audit, list(file_keys), "inner")
    bad_count = joined.filter(F.size(layers) != F.col("_n")).select(
        *file_keys, pos, F.lit(None).cast("string").alias("layer"),
        F.size(layers).alias("found"), F.col("_n").alias("expected"),
    )
    bad_dim = (
        joined.select(*file_keys, pos, "_d", F.explode(layers).alias("layer", "_v"))
        .filter(F.size("_v") != F.col("_d"))
        .select(*file_keys, pos, "layer", F.size("_v").alias("found"), F.col("_d").alias("expected"))
    )
    return bad_count.unionByName(bad_dim)


