"""Registry of runnable queries with their DuckDB counterparts, and shared inputs.

Vectors stand in for layers as four 16-wide slices of `embeddings.embedding`;
ten-wide slices stand in for logits. Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerlab.functions import vectors as V
from layerlab.plans.materialize import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its inventory key, with its SQL where there is one."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A text table, spread over the cores when it is a single small file."""
    key = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}[name]
    return spread(table(spark, sf_dir, name), key)


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded value without a negative zero."""
    x = F.round(c, digits)
    return F.when(x == 0, 0.0).otherwise(x)


def s6(sql: str, digits: int = 6) -> str:
    """The same in SQL."""
    return f"CASE WHEN round({sql}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({sql}, {digits}) END"


# ---- layers as slices of the embeddings --------------------------------------

LAYERS = 4
WIDTH = 16
DEPTHS = [0, 1, 2, 3, 4]

LONG_SQL = """long AS (
  SELECT vec_id AS sample_id, label, k::INTEGER AS layer,
         (embedding[16 * k + 1 : 16 * k + 16])::DOUBLE[] AS vec
  FROM embeddings, range(4) r(k))"""


def layer_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, label, batch_idx, pos, layers map)."""
    e = table(spark, sf_dir, "embeddings")
    pairs = [
        x
        for k in range(LAYERS)
        for x in (F.lit(f"layer_{k}"), F.slice(V.doubles(F.col("embedding")), WIDTH * k + 1, WIDTH))
    ]
    return e.select(
        F.col("vec_id").alias("sample_id"),
        "label",
        F.floor(F.col("vec_id") / 16).alias("batch_idx"),
        (F.col("vec_id") % 16).alias("pos"),
        F.create_map(*pairs).alias("layers"),
    )


def long_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, label, layer, vec)."""
    e = table(spark, sf_dir, "embeddings")
    slices = F.array(*[F.slice("embedding", WIDTH * k + 1, WIDTH) for k in range(LAYERS)])
    long = e.select(F.col("vec_id").alias("sample_id"), "label", F.posexplode(slices).alias("layer", "vec"))
    return long.withColumn("vec", V.doubles(F.col("vec")))


SPLIT_SQL = """split AS (
  SELECT vec_id AS sample_id, label,
         CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', vec_id)), vec_id)
                   <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY label))
              THEN 'test' ELSE 'train' END AS split
  FROM embeddings)"""

LONG_SPLIT_SQL = f"{LONG_SQL}, {SPLIT_SQL}, split_long AS (SELECT l.*, s.split FROM long l JOIN split s USING (sample_id))"


def split_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, label, split), stratified."""
    from layerlab.operators.tables import stratified_split

    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), "label")
    return stratified_split(ids, "sample_id")


def split_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, label, layer, vec, split)."""
    from layerlab.operators.tables import apply_split

    return apply_split(long_vectors(spark, sf_dir), split_of(spark, sf_dir))


# ---- predictions from ten-wide slices ----------------------------------------

LOGITS_SQL = """logits AS (
  SELECT vec_id AS sample_id, label AS y, k::INTEGER AS layer, d::INTEGER AS depth,
         (embedding[16 * k + 1 + d : 16 * k + 10 + d])::DOUBLE[] AS logits
  FROM embeddings, range(4) r(k), range(5) q(d))"""
PRED_SQL = f"""{LOGITS_SQL}, pred AS (
  SELECT *, (list_position(logits, list_max(logits)) - 1)::INTEGER AS yhat FROM logits)"""


def layer_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, y, layer, depth, logits)."""
    e = table(spark, sf_dir, "embeddings")
    cells = F.array(
        *[
            F.struct(
                F.lit(k).alias("layer"),
                F.lit(d).alias("depth"),
                F.slice("embedding", WIDTH * k + 1 + d, 10).cast("array<double>").alias("logits"),
            )
            for k in range(LAYERS)
            for d in DEPTHS
        ]
    )
    return e.select(F.col("vec_id").alias("sample_id"), F.col("label").alias("y"), F.inline(cells))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, y, layer, depth, logits, yhat)."""
    return layer_logits(spark, sf_dir).withColumn("yhat", V.argmax(F.col("logits")))


# multi-label targets and predictions of the same logits: ten bits per row
BITS_SQL = f"""{LOGITS_SQL}, bits AS (
  SELECT *, list_transform(range(10), lambda i: CASE WHEN i = y OR i = (y * 3 + 1) % 10 THEN 1 ELSE 0 END) AS bits,
         list_transform(logits, lambda x: CASE WHEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-x)) > 0.5::DOUBLE THEN 1 ELSE 0 END) AS pred
  FROM logits)"""


def bit_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(.., bits, pred): two true labels per row against thresholded logits."""
    from layerlab.functions.labels import multi_hot

    labels = F.array(F.col("y"), (F.col("y") * 3 + 1) % 10)
    return layer_logits(spark, sf_dir).withColumn("bits", multi_hot(labels, 10)).withColumn(
        "pred", V.threshold(F.col("logits"))
    )


# ---- experiment results ------------------------------------------------------

RESULTS_SQL = f"""{PRED_SQL}, results AS (
  SELECT 'slices' AS model, CASE WHEN e.embedding[1] >= 0 THEN 'pos' ELSE 'neg' END AS dataset,
         p.layer, p.depth, avg(CASE WHEN p.y = p.yhat THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc
  FROM pred p JOIN embeddings e ON e.vec_id = p.sample_id GROUP BY ALL),
res AS (SELECT *, CASE WHEN dataset = 'pos' THEN 1.0::DOUBLE - acc END AS hamming FROM results)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, dataset, layer, depth, acc, hamming)."""
    side = F.when(F.get("embedding", F.lit(0)) >= 0, "pos").otherwise("neg")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), side.alias("dataset"))
    p = predictions(spark, sf_dir).join(e, "sample_id")
    out = p.groupBy(F.lit("slices").alias("model"), "dataset", "layer", "depth").agg(
        F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("acc")
    )
    return out.withColumn("hamming", F.when(F.col("dataset") == "pos", 1.0 - F.col("acc")))


# ---- label strings -----------------------------------------------------------

LABELLED_SQL = """labelled AS (
  SELECT vec_id, label,
         CASE WHEN label % 2 = 0 THEN concat('[', label, ' ', (label * 3 + 1) % 28, ']')
              WHEN label = 9 THEN '[]'
              ELSE concat('[', label, ', ', label + 11, ']') END AS labels,
         CASE WHEN label % 2 = 0 THEN [label, (label * 3 + 1) % 28]
              WHEN label = 9 THEN []::INTEGER[]
              ELSE [label, label + 11] END AS ids
  FROM embeddings)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, labels): label strings with blanks, commas and empty lists."""
    lab = F.col("label")
    text = (
        F.when(lab % 2 == 0, F.concat(F.lit("["), lab, F.lit(" "), (lab * 3 + 1) % 28, F.lit("]")))
        .when(lab == 9, "[]")
        .otherwise(F.concat(F.lit("["), lab, F.lit(", "), lab + 11, F.lit("]")))
    )
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", text.alias("labels"))


# ---- text --------------------------------------------------------------------

# Parameter: function words of the four corpus languages.
STOP_WORDS = [
    "the", "and", "of", "to", "in", "is", "on", "with", "by", "for", "at", "as",
    "le", "la", "les", "un", "une", "des", "du", "et", "en", "qui", "que",
    "der", "die", "das", "und", "ist", "nicht", "mit", "el", "los", "las", "con",
]
# Parameter: letters with a mark, named as symbols.
SYMBOL_NAMES = {
    "é": "e_acute", "è": "e_grave", "ê": "e_circumflex", "ç": "c_cedilla",
    "ü": "u_umlaut", "ö": "o_umlaut", "ä": "a_umlaut", "ß": "sharp_s", "ñ": "n_tilde",
}


def sql_list(items: list[str]) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + ")"


def sql_replace(expr: str, pairs: dict[str, str]) -> str:
    for old, new in pairs.items():
        expr = f"replace({expr}, '{old.replace(chr(39), chr(39) * 2)}', '{new}')"
    return expr


WORDS_SQL = r"regexp_extract_all(lower(coalesce(text, '')), '([\p{L}\p{N}_]{2,})')"


# ---- event log as training log -----------------------------------------------

EPOCHS_SQL = """log AS (
  SELECT user_id AS run, (day(ts) - 1)::INTEGER AS epoch, value AS loss,
         CASE WHEN event_type = 'error' THEN 'validation' ELSE 'train' END AS split,
         CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit
  FROM events)"""


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, epoch, loss, split, hit): events as batch losses, days as epochs."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        (F.dayofmonth("ts") - 1).alias("epoch"),
        F.col("value").alias("loss"),
        F.when(F.col("event_type") == "error", "validation").otherwise("train").alias("split"),
        F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("hit"),
    )
