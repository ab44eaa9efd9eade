"""Vectors, layer statistics, separation."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerlab.functions import vectors as V
from layerlab.operators import layer_stats as S
from layerlab.queries.base import (
    LONG_SPLIT_SQL,
    LONG_SQL,
    layer_map,
    long_vectors,
    query,
    r6,
    s6,
    split_vectors,
    table,
)


def _cells(df, keys, vec, name="value", digits=6):
    out = df.select(*keys, F.posexplode(vec).alias("dim", name))
    return out.withColumn(name, r6(name, digits))


# ---- F: vector functions -----------------------------------------------------


@query(
    "f16_vector_from_text",
    """SELECT doc_id, dim::INTEGER AS dim, CASE dim WHEN 0 THEN doc_id ELSE n_chars END::DOUBLE AS value
    FROM documents, range(2) r(dim) WHERE lang <> 'fr'""",
)
def f16(spark, d):
    text = F.when(F.col("lang") == "fr", "n/a").otherwise(
        F.concat(F.lit("["), F.col("doc_id"), F.lit(", "), F.col("n_chars"), F.lit("]"))
    )
    parsed = table(spark, d, "documents").select("doc_id", V.vector_from_text(text).alias("v"))
    return parsed.select("doc_id", F.posexplode("v").alias("dim", "value"))


@query(
    "f17_flatten_nested",
    f"SELECT vec_id, i::INTEGER AS dim, {s6('embedding[i + 1]::DOUBLE')} AS value FROM embeddings, range(64) r(i)",
)
def f17(spark, d):
    nested = F.array(*[F.array(F.slice("embedding", 32 * k + 1, 16), F.slice("embedding", 32 * k + 17, 16)) for k in range(2)])
    flat = table(spark, d, "embeddings").select("vec_id", V.flatten_nested(nested, 2).cast("array<double>").alias("v"))
    return _cells(flat, ["vec_id"], "v")


@query(
    "f18_pad_or_truncate",
    f"""SELECT vec_id, 'pad' AS kind, i::INTEGER AS dim, {s6('coalesce(embedding[i + 1]::DOUBLE, 0.0::DOUBLE)')} AS value FROM embeddings, range(80) r(i)
    UNION ALL SELECT vec_id, 'cut', i::INTEGER, {s6('embedding[i + 1]::DOUBLE')} FROM embeddings, range(40) r(i)""",
)
def f18(spark, d):
    e = table(spark, d, "embeddings")
    both = F.array(
        F.struct(F.lit("pad").alias("kind"), V.pad_or_truncate(F.col("embedding"), 80).alias("v")),
        F.struct(F.lit("cut").alias("kind"), V.pad_or_truncate(F.col("embedding"), 40).alias("v")),
    )
    return _cells(e.select("vec_id", F.inline(both)), ["vec_id", "kind"], "v")


def _scaled_sql(where: str) -> str:
    return f"""WITH {LONG_SPLIT_SQL},
    cell AS (SELECT sample_id, layer, split, i::INTEGER AS dim, vec[i + 1] AS x FROM split_long, range(16) r(i)),
    m AS (SELECT layer, dim, avg(x) AS mean, stddev_pop(x) AS std FROM cell {where} GROUP BY ALL)
    SELECT sample_id, layer, dim, {s6('(x - mean) / (std + 1e-8::DOUBLE)')} AS value FROM cell JOIN m USING (layer, dim)"""


@query("f23_standardize", _scaled_sql("WHERE split = 'train'"))
def f23(spark, d):
    return _cells(S.standardize(split_vectors(spark, d)), ["sample_id", "layer"], "vec")


@query("f24_standardize_all", _scaled_sql(""))
def f24(spark, d):
    return _cells(S.standardize(split_vectors(spark, d), train_only=False), ["sample_id", "layer"], "vec")


@query(
    "f25_argmax",
    "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS best FROM embeddings",
)
def f25(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.argmax(F.col("embedding")).alias("best"))


@query(
    "f26_sigmoid",
    f"SELECT vec_id, i::INTEGER AS dim, {s6('1.0::DOUBLE / (1.0::DOUBLE + exp(-(embedding[i + 1]::DOUBLE)))')} AS value FROM embeddings, range(64) r(i)",
)
def f26(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", V.sigmoid(F.col("embedding")).alias("v"))
    return _cells(e, ["vec_id"], "v")


@query(
    "f27_pool_tokens",
    f"""SELECT vec_id, i::INTEGER AS dim, {s6('embedding[i + 1]::DOUBLE')} AS first_value, {s6('embedding[i + 49]::DOUBLE')} AS last_value
    FROM embeddings, range(16) r(i)""",
)
def f27(spark, d):
    tokens = F.array(*[F.slice("embedding", 16 * k + 1, 16) for k in range(4)])
    both = F.arrays_zip(V.pool_tokens(tokens).alias("a"), V.pool_tokens(tokens, "last").alias("b"))
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(both).alias("dim", "z"))
    return e.select(
        "vec_id", "dim", r6(F.col("z.a").cast("double")).alias("first_value"), r6(F.col("z.b").cast("double")).alias("last_value")
    )


@query("f28_neg_log10", f"SELECT event_id, {s6('-log10(value / 1000)')} AS score FROM events")
def f28(spark, d):
    return table(spark, d, "events").select("event_id", r6(V.neg_log10(F.col("value") / 1000)).alias("score"))


@query("f29_round_display", "SELECT event_id, printf('%.3f', value / 7) AS shown FROM events")
def f29(spark, d):
    return table(spark, d, "events").select("event_id", V.round_display(F.col("value") / 7).alias("shown"))


@query(
    "f30_vector_moments",
    f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT vec_id, {s6('list_min(v)')} AS v_min, {s6('list_max(v)')} AS v_max, {s6('list_avg(v)')} AS v_mean,
      {s6('list_stddev_pop(v)')} AS v_std, len(list_filter(v, lambda x: isnan(x))) > 0 AS has_nan FROM v""",
)
def f30(spark, d):
    m = V.row_moments(F.col("embedding"))
    return table(spark, d, "embeddings").select(
        "vec_id", *[(c if n == "has_nan" else r6(c)).alias(n) for n, c in m.items()]
    )


# ---- A: layer statistics -----------------------------------------------------

_CELL_SQL = f"WITH {LONG_SQL}, cell AS (SELECT sample_id, label, layer, i::INTEGER AS dim, vec[i + 1] AS x FROM long, range(16) r(i))"


@query(
    "a6_layer_value_stats",
    f"""{_CELL_SQL} SELECT layer, (max(dim) + 1)::INTEGER AS dimension, count(*) AS n_values, {s6('avg(x)')} AS value_mean, {s6('stddev_pop(x)')} AS value_std,
    {s6('min(x)')} AS value_min, {s6('max(x)')} AS value_max FROM cell GROUP BY layer""",
)
def a6(spark, d):
    out = S.layer_value_stats(long_vectors(spark, d), ["layer"])
    nums = ["value_mean", "value_std", "value_min", "value_max"]
    return out.select("layer", "dimension", "n_values", *[r6(c).alias(c) for c in nums])


@query("a7_layer_value_median", f"{_CELL_SQL} SELECT layer, {s6('median(x)')} AS value_median FROM cell GROUP BY layer")
def a7(spark, d):
    out = S.layer_value_median(long_vectors(spark, d), ["layer"])
    return out.select("layer", r6("value_median").alias("value_median"))


@query(
    "a8_file_global_stats",
    f"""{_CELL_SQL} SELECT sample_id // 16 AS batch_idx, count(*) AS n_values, {s6('min(x)')} AS value_min, {s6('max(x)')} AS value_max,
    {s6('avg(x)')} AS value_mean, {s6('stddev_pop(x)')} AS value_std, {s6('median(x)')} AS value_median FROM cell GROUP BY 1""",
)
def a8(spark, d):
    files = long_vectors(spark, d).withColumn("batch_idx", F.floor(F.col("sample_id") / 16))
    out = S.file_global_stats(files, ["batch_idx"])
    nums = ["value_min", "value_max", "value_mean", "value_std", "value_median"]
    return out.select("batch_idx", "n_values", *[r6(c).alias(c) for c in nums])


@query(
    "a9_aggregate_file_stats",
    f"""WITH f AS (SELECT source, doc_id // 16 AS batch_idx, count(*) AS n FROM documents GROUP BY ALL)
    SELECT source, count(*) AS n_files, {s6('avg(n)')} AS avg_samples FROM f GROUP BY source""",
)
def a9(spark, d):
    docs = table(spark, d, "documents").withColumn("batch_idx", F.floor(F.col("doc_id") / 16))
    files = docs.groupBy("source", "batch_idx").agg(F.count(F.lit(1)).alias("n_samples"))
    return S.aggregate_file_stats(files, ["source"]).select("source", "n_files", r6("avg_samples").alias("avg_samples"))


def _ragged(spark, d):
    """Samples whose layer count and vector lengths depend on the label."""
    layers = F.col("layers")
    fewer = F.map_filter(layers, lambda k, v: k != "layer_3")
    shorter = F.transform_values(
        layers, lambda k, v: F.when(k == "layer_1", F.slice(v, 1, 15)).otherwise(v)
    )
    changed = F.when(F.col("label") == 3, fewer).when(F.col("label") == 5, shorter).otherwise(layers)
    return layer_map(spark, d).withColumn("layers", changed)


@query(
    "a10_structure_audit",
    """WITH s AS (SELECT vec_id // 16 AS batch_idx, vec_id % 16 AS pos, label,
        CASE label WHEN 3 THEN 3 ELSE 4 END AS n FROM embeddings),
    f AS (SELECT batch_idx, arg_min(n, pos) AS exp_n FROM s GROUP BY 1)
    SELECT batch_idx, count(*) AS total_samples, max(exp_n)::INTEGER AS num_layers, 16 AS hidden_dimension,
      (count(*) FILTER (n <> exp_n)) AS layer_anomalies, (count(*) FILTER (label = 5)) AS dim_anomalies,
      (count(*) FILTER (n <> exp_n)) = 0 AS consistent_layers, (count(*) FILTER (label = 5)) = 0 AS consistent_dimensions
    FROM s JOIN f USING (batch_idx) GROUP BY batch_idx""",
)
def a10(spark, d):
    return S.structure_audit(_ragged(spark, d), ["batch_idx"])


@query(
    "a11_nan_zero_report",
    f"""{_CELL_SQL}, z AS (SELECT layer, CASE WHEN label = 2 AND dim = 0 THEN 'nan'::DOUBLE WHEN abs(x) < 0.05::DOUBLE THEN 0.0::DOUBLE ELSE x END AS x FROM cell)
    SELECT layer, count(*) AS n_values, (count(*) FILTER (isnan(x))) AS n_nan, (count(*) FILTER (x = 0)) AS n_zero,
      {s6('100.0::DOUBLE * (count(*) FILTER (x = 0)) / count(*)')} AS zero_percent FROM z GROUP BY layer""",
)
def a11(spark, d):
    marked = F.transform(
        "vec",
        lambda x, i: F.when((F.col("label") == 2) & (i == 0), F.lit(float("nan")))
        .when(F.abs(x) < 0.05, 0.0)
        .otherwise(x),
    )
    out = S.nan_zero_report(long_vectors(spark, d).withColumn("vec", marked), ["layer"])
    return out.withColumn("zero_percent", r6("zero_percent"))


@query(
    "a12_dimension_moments",
    f"{_CELL_SQL} SELECT layer, dim, {s6('avg(x)')} AS mean, {s6('stddev_pop(x)')} AS std FROM cell GROUP BY ALL",
)
def a12(spark, d):
    m = S.dimension_moments(long_vectors(spark, d), ["layer"])
    both = m.select("layer", F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "z"))
    return both.select("layer", "dim", r6("z.mean").alias("mean"), r6("z.std").alias("std"))


_CENTROID_SQL = f"""WITH {LONG_SPLIT_SQL},
    cell AS (SELECT sample_id, label, layer, split, i::INTEGER AS dim, vec[i + 1] AS x FROM split_long, range(16) r(i)),
    centroid AS (SELECT layer, split, label, dim, avg(x) AS c, count(*) AS n FROM cell GROUP BY ALL)"""


@query(
    "a13_class_centroids",
    f"{_CENTROID_SQL} SELECT layer, split, label, n, dim, {s6('c')} AS value FROM centroid",
)
def a13(spark, d):
    c = S.class_centroids(split_vectors(spark, d), ["layer", "split"])
    return _cells(c, ["layer", "split", "label", "n"], "centroid")


@query(
    "j6_centroid_pairs",
    f"""{_CENTROID_SQL} SELECT a.layer, a.split, a.label AS class_a, b.label AS class_b, {s6('sum(abs(a.c - b.c))')} AS l1
    FROM centroid a JOIN centroid b ON a.layer = b.layer AND a.split = b.split AND a.dim = b.dim AND a.label < b.label GROUP BY ALL""",
)
def j6(spark, d):
    pairs = S.centroid_pairs(S.class_centroids(split_vectors(spark, d), ["layer", "split"]), ["layer", "split"])
    l1 = F.aggregate(F.zip_with("centroid_a", "centroid_b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, v: a + v)
    return pairs.select("layer", "split", "class_a", "class_b", r6(l1).alias("l1"))


@query(
    "a14_centroid_cosine",
    f"""{_CENTROID_SQL} SELECT a.layer, a.split, concat(a.label, '_vs_', b.label) AS pair, a.label AS class_a, b.label AS class_b,
      {s6('sum(a.c * b.c) / (sqrt(sum(a.c * a.c)) * sqrt(sum(b.c * b.c)))')} AS cosine
    FROM centroid a JOIN centroid b ON a.layer = b.layer AND a.split = b.split AND a.dim = b.dim AND a.label < b.label GROUP BY ALL""",
)
def a14(spark, d):
    cos = S.centroid_cosine(S.class_centroids(split_vectors(spark, d), ["layer", "split"]), ["layer", "split"])
    return cos.withColumn("cosine", r6("cosine"))


_DIST_SQL = f"""WITH {LONG_SQL}, dist AS (
    SELECT a.layer, a.sample_id, a.label, b.label AS other_label,
      sum(list_distance(a.vec, b.vec)) AS dist_sum, count(*) AS dist_n
    FROM long a JOIN long b ON a.layer = b.layer GROUP BY ALL)"""


@query(
    "j7_class_distances",
    f"{_DIST_SQL} SELECT layer, sample_id, label, other_label, {s6('dist_sum', 5)} AS dist_sum, dist_n FROM dist",
)
def j7(spark, d):
    out = S.class_distances(long_vectors(spark, d), ["layer"])
    return out.withColumn("dist_sum", r6("dist_sum", 5))


def _silhouette_sql(dist: str, keys: str) -> str:
    return f"""{dist}, s AS (SELECT {keys}, sample_id, label,
      sum(dist_sum / (dist_n - 1)) FILTER (label = other_label AND dist_n > 1) AS a,
      min(dist_sum / dist_n) FILTER (label <> other_label) AS b FROM dist GROUP BY ALL)
    SELECT {keys}, {s6("CASE WHEN count(b) = 0 THEN -1.0::DOUBLE ELSE avg(CASE WHEN a IS NULL THEN 0.0::DOUBLE ELSE (b - a) / greatest(a, b) END) END")} AS silhouette
    FROM s GROUP BY {keys}"""


@query("a15_silhouette_exact", _silhouette_sql(_DIST_SQL, "layer"))
def a15(spark, d):
    out = S.silhouette_exact(long_vectors(spark, d), ["layer"])
    return out.select("layer", r6("silhouette").alias("silhouette"))


_SQ_SQL = _DIST_SQL.replace("sum(list_distance(a.vec, b.vec))", "sum(list_distance(a.vec, b.vec) * list_distance(a.vec, b.vec))")


@query("a16_silhouette_scalable", _silhouette_sql(_SQ_SQL, "layer"))
def a16(spark, d):
    out = S.squared_silhouette(long_vectors(spark, d), ["layer"])
    return out.select("layer", r6("silhouette").alias("silhouette"))
