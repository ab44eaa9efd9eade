"""Readers, writers and streams, as round trips of whole tables.

Each query writes a table of the input in the format concerned to the shared
folder and reads it back through the reader.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerlab.operators.tables import melt_layers
from layerlab.plans.materialize import scratch_path
from layerlab.queries.base import LONG_SQL, RESULTS_SQL, layer_map, long_vectors, query, r6, results, s6, table
from layerlab.sources import corpora, layer_files, sinks
from layerlab.streaming import layer_streams



def _total():
    return F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)


@query(
    "s1_read_labelled_splits",
    """SELECT CASE lang WHEN 'en' THEN 'train' WHEN 'fr' THEN 'test' ELSE 'validation' END AS split,
      doc_id::VARCHAR AS id, text, concat('[', n_chars % 28, ' ', doc_id % 28, ']') AS labels FROM documents""",
)
def s1(spark, d):
    docs = table(spark, d, "documents").select(
        "text",
        F.concat(F.lit("["), F.col("n_chars") % 28, F.lit(" "), F.col("doc_id") % 28, F.lit("]")).alias("labels"),
        F.col("doc_id").cast("string").alias("id"),
        "lang",
    )
    paths = {}
    for name, keep in (("train", "lang = 'en'"), ("test", "lang = 'fr'"), ("validation", "lang NOT IN ('en', 'fr')")):
        paths[name] = scratch_path(spark, f"split-{name}")
        docs.filter(keep).drop("lang").write.option("header", True).option("escape", '"').csv(paths[name])
    out = corpora.read_labelled_splits(spark, **paths)
    return out.select("split", "id", "text", "labels")


_SURVEY = T.StructType(
    [
        T.StructField("ID", T.IntegerType()),
        T.StructField("SEX", T.IntegerType()),
        T.StructField("EMOT", T.IntegerType()),
        T.StructField("SIT", T.StringType()),
    ]
)


@query("s2_read_survey", """SELECT doc_id::INTEGER AS "ID", (doc_id % 2 + 1)::INTEGER AS "SEX", (n_chars % 7 + 1)::INTEGER AS "EMOT", text AS "SIT" FROM documents""")
def s2(spark, d):
    path = scratch_path(spark, "survey")
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("ID"), (F.col("doc_id") % 2 + 1).alias("SEX"), (F.col("n_chars") % 7 + 1).alias("EMOT"),
        F.col("text").alias("SIT"), F.lit("").alias(" "),
    )
    docs.write.option("header", True).option("sep", "|").option("escape", '"').csv(path)
    return corpora.read_survey(spark, path, schema=_SURVEY)


def _samples(spark, d):
    """Vectors as batches of 16 of one model and dataset."""
    return layer_map(spark, d).select(
        F.lit("lab/model").alias("model"), F.lit("news_en").alias("dataset"), F.col("batch_idx").cast("int"),
        F.col("pos").cast("int"), "layers",
    )


def _batch_files(spark, d):
    path = scratch_path(spark, "batches")
    sinks.write_batch_files(_samples(spark, d), path)
    return path


@query(
    "s3_read_layer_vectors",
    f"""WITH {LONG_SQL} SELECT 'labmodel' AS model, 'news_en' AS dataset, (sample_id // 16)::INTEGER AS batch_idx, (sample_id % 16)::INTEGER AS pos,
      layer, {s6('list_sum(vec)')} AS total FROM long""",
)
def s3(spark, d):
    samples = layer_files.read_layer_vectors(spark, _batch_files(spark, d))
    long = melt_layers(samples.drop("file_name"))
    return long.select("model", "dataset", "batch_idx", "pos", "layer", r6(_total()).alias("total"))


@query(
    "s4_list_batches",
    """SELECT DISTINCT concat('labmodel_news_en_', vec_id // 16, '.json') AS file_name, 'labmodel' AS model, 'news_en' AS dataset,
      (vec_id // 16)::INTEGER AS batch_idx FROM embeddings""",
)
def s4(spark, d):
    found = layer_files.list_batches(spark, _batch_files(spark, d), "labmodel", "news_en")
    return found.select("file_name", "model", "dataset", "batch_idx").distinct().orderBy("batch_idx")


_FILE_SQL = """files AS (SELECT doc_id, CASE lang WHEN 'fr' THEN concat('all_hidden_states_', source, '_', doc_id, '.json')
    WHEN 'de' THEN concat(source, '_', lang, '_', doc_id, '.txt') ELSE concat(source, '_', lang, '_x_', doc_id, '.json') END AS file_name FROM documents)"""


def _file_names(spark, d):
    s, lang, i = F.col("source"), F.col("lang"), F.col("doc_id")
    name = (
        F.when(lang == "fr", F.concat(F.lit("all_hidden_states_"), s, F.lit("_"), i, F.lit(".json")))
        .when(lang == "de", F.concat(s, F.lit("_"), lang, F.lit("_"), i, F.lit(".txt")))
        .otherwise(F.concat(s, F.lit("_"), lang, F.lit("_x_"), i, F.lit(".json")))
    )
    return table(spark, d, "documents").select("doc_id", name.alias("file_name"))


@query(
    "s5_filter_files",
    f"WITH {_FILE_SQL} SELECT doc_id, file_name FROM files WHERE file_name LIKE '%.json' AND NOT starts_with(file_name, 'all_hidden_states')",
)
def s5(spark, d):
    return layer_files.filter_files(_file_names(spark, d))


@query(
    "s6_parse_file_name",
    f"""WITH {_FILE_SQL}, p AS (SELECT doc_id, string_split(regexp_replace(file_name, '\\.json$', ''), '_') AS t FROM files)
    SELECT doc_id, t[1] AS model, array_to_string(t[2:len(t) - 1], '_') AS dataset, try_cast(t[len(t)] AS INTEGER) AS batch_idx FROM p""",
)
def s6_parse(spark, d):
    names = _file_names(spark, d)
    return names.withColumns(layer_files.parse_file_name(F.col("file_name"))).drop("file_name")


@query(
    "s7_limit_batches",
    "SELECT 'batches' AS kind, vec_id FROM embeddings WHERE vec_id < 160 UNION ALL SELECT 'samples', vec_id FROM embeddings WHERE vec_id < 100",
)
def s7(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 16).alias("batch_idx"))
    a = layer_files.limit_batches(e, 10).select(F.lit("batches").alias("kind"), "vec_id")
    b = layer_files.limit_samples(e, 100, "vec_id").select(F.lit("samples").alias("kind"), "vec_id")
    return a.unionByName(b)


@query(
    "s8_count_samples",
    """SELECT source, count(DISTINCT doc_id // 16) AS n_files, count(DISTINCT doc_id // 16) * 16 AS estimated_samples, count(*) AS n_samples
    FROM documents GROUP BY source""",
)
def s8(spark, d):
    docs = table(spark, d, "documents").select("source", F.floor(F.col("doc_id") / 16).alias("batch_idx"))
    return layer_files.count_samples(docs, ["source"])


@query(
    "s9_write_layer_vectors",
    f"""WITH {LONG_SQL} SELECT 'labmodel' AS model, 'news_en' AS dataset, (sample_id // 16)::INTEGER AS batch_idx, sample_id, layer,
      {s6('list_sum(vec)')} AS total FROM long""",
)
def s9(spark, d):
    path = scratch_path(spark, "vectors")
    long = long_vectors(spark, d).select(
        F.lit("lab/model").alias("model"), F.lit("news_en").alias("dataset"),
        F.floor(F.col("sample_id") / 16).cast("int").alias("batch_idx"), "sample_id", "layer", "vec",
    )
    sinks.write_layer_vectors(long, path)
    return spark.read.parquet(path).select("model", "dataset", "batch_idx", "sample_id", "layer", r6(_total()).alias("total"))


@query(
    "s10_write_summary_csv",
    f"WITH {RESULTS_SQL} SELECT dataset, layer, depth, {s6('acc')} AS acc FROM res",
)
def s10(spark, d):
    path = scratch_path(spark, "summary")
    sinks.write_summary_csv(results(spark, d).select("dataset", "layer", "depth", r6("acc").alias("acc")), path)
    return spark.read.schema("dataset string, layer int, depth int, acc double").option("header", True).csv(path)


@query(
    "s11_append_trial_log",
    f"""WITH {RESULTS_SQL} SELECT (layer * 5 + depth)::BIGINT AS trial_id, dataset, {s6('acc')} AS accuracy, 'done' AS status FROM res""",
)
def s11(spark, d):
    path = scratch_path(spark, "trials")
    trials = results(spark, d).select(
        (F.col("layer") * 5 + F.col("depth")).cast("long").alias("trial_id"),
        F.create_map(F.lit("dataset"), F.col("dataset")).alias("params"),
        F.create_map(F.lit("accuracy"), F.col("acc")).alias("metrics"),
        F.lit("done").alias("status"),
    )
    for side in ("pos", "neg"):
        sinks.append_trial_log(trials.filter(F.col("params")["dataset"] == side), path)
    log = sinks.read_trial_log(spark, path)
    return log.select("trial_id", F.col("params")["dataset"].alias("dataset"), r6(F.col("metrics")["accuracy"]).alias("accuracy"), "status")


@query("s12_save_load_results", f"WITH {RESULTS_SQL} SELECT model, dataset, layer, depth, {s6('acc')} AS acc, {s6('hamming')} AS hamming FROM res")
def s12(spark, d):
    path = scratch_path(spark, "results")
    sinks.save_results(results(spark, d), path)
    return sinks.load_results(spark, path).select("model", "dataset", "layer", "depth", r6("acc").alias("acc"), r6("hamming").alias("hamming"))


@query(
    "s13_preview",
    f"""WITH {LONG_SQL} SELECT sample_id, concat('layer_', layer) AS name, 16 AS length, i::INTEGER AS idx, {s6('vec[i + 1]')} AS value
    FROM long, range(5) r(i) WHERE layer < 3 AND sample_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 2)""",
)
def s13(spark, d):
    return layer_files.preview(layer_map(spark, d), 2, 3, 5).withColumn("value", r6("value"))


@query("s14_storage_target", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def s14(spark, d):
    base, name = scratch_path(spark, "external").rsplit("/", 1)
    path = sinks.storage_target("counts", base, name)
    table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.schema("event_type string, n long").parquet(path)


@query(
    "s15_tolerate_bad_files",
    """SELECT concat('labmodel_news_', vec_id // 16, '.json') AS file_name, max(CASE WHEN label = 7 THEN 1 ELSE 0 END) = 1 AS bad,
      CASE WHEN max(CASE WHEN label = 7 THEN 1 ELSE 0 END) = 1 THEN 0 ELSE count(*) END AS samples FROM embeddings GROUP BY 1""",
)
def s15(spark, d):
    """Batches holding a sample of class 7 are written broken."""
    path = scratch_path(spark, "broken")
    broken = F.max((F.col("label") == 7).cast("int")) == 1
    batches = layer_map(spark, d).groupBy("batch_idx").agg(
        F.when(broken, "{not json").otherwise(sinks.batch_json()).alias("value")
    )
    name = F.concat(F.lit("labmodel_news_"), F.col("batch_idx"), F.lit(".json"))
    batches.select(name.alias("file"), "value").write.partitionBy("file").text(path)
    good = layer_files.read_layer_vectors(spark, path).groupBy("file_name").agg(F.count(F.lit(1)).alias("samples"))
    bad = layer_files.bad_files(spark, path).select("file_name", F.lit(True).alias("bad"))
    return good.join(bad, "file_name", "full_outer").select(
        "file_name", F.coalesce("bad", F.lit(False)).alias("bad"), F.coalesce("samples", F.lit(0)).alias("samples")
    )


@query(
    "r1_stream_ingest_batches",
    f"""WITH {LONG_SQL} SELECT 'labmodel' AS model, 'news_en' AS dataset, (sample_id // 16)::INTEGER AS batch_idx, (sample_id % 16)::INTEGER AS pos,
      layer, {s6('list_sum(vec)')} AS total FROM long""",
)
def r1(spark, d):
    source, target, state = _batch_files(spark, d), scratch_path(spark, "ingested"), scratch_path(spark, "ingest-state")
    for _ in range(2):  # the second run finds nothing new
        layer_streams.ingest_batches(spark, source, target, state)
    read = layer_streams.read_vectors(spark, target)
    return read.select("model", "dataset", "batch_idx", "pos", "layer", r6(_total()).alias("total"))


@query(
    "r2_stream_layer_stats",
    f"""WITH {LONG_SQL}, cell AS (SELECT layer, unnest(vec) AS x FROM long)
    SELECT layer, count(*) AS n_values, {s6('avg(x)')} AS value_mean, {s6('stddev_pop(x)')} AS value_std, {s6('min(x)')} AS value_min, {s6('max(x)')} AS value_max
    FROM cell GROUP BY layer""",
)
def r2(spark, d):
    source, target, state = (scratch_path(spark, n) for n in ("stream-in", "stream-stats", "stream-state"))
    vectors = long_vectors(spark, d).select("layer", "vec")
    vectors.write.parquet(source)
    layer_streams.stream_layer_stats(layer_streams.vector_stream(spark, source, vectors.schema), target, state)
    nums = ["value_mean", "value_std", "value_min", "value_max"]
    return layer_streams.latest_layer_stats(spark, target).select("layer", "n_values", *[r6(c).alias(c) for c in nums])
