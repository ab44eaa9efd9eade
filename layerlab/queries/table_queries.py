"""P, U, J, W1-W3, W5-W6, W10, A1-A5, A17-A19, A25, T3-T6: tables and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerlab.functions import labels as L
from layerlab.functions import vectors as V
from layerlab.functions.fixed_values import CODE_DOMAINS
from layerlab.operators import corpus_stats as C
from layerlab.operators import tables as TB
from layerlab.queries.base import (
    LABELLED_SQL,
    LONG_SQL,
    RESULTS_SQL,
    SPLIT_SQL,
    labelled,
    layer_map,
    long_vectors,
    query,
    r6,
    results,
    s6,
    split_of,
    table,
)

# ---- P: projections and filters ----------------------------------------------


@query("p1_select_drop", "SELECT text AS clean_text, source AS labels FROM documents")
def p1(spark, d):
    docs = table(spark, d, "documents").withColumn("clean_text", F.col("text")).withColumn("labels", F.col("source"))
    return TB.keep_columns(TB.drop_columns(docs, ["text", "doc_id", "absent"]), ["clean_text", "labels"])


@query(
    "p2_drop_missing",
    """SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)
    WHERE l.quality IS NOT NULL AND d.lang IS NOT NULL""",
)
def p2(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return TB.drop_missing(joined.select("doc_id", "lang", "quality"), ["quality", "lang"])


def _wide(spark, d):
    e = table(spark, d, "embeddings")
    cols = [F.slice(V.doubles(F.col("embedding")), 16 * k + 1, 16).alias(f"layer_{k}") for k in range(4)]
    return e.select("vec_id", "label", *cols)


@query(
    "p3_layer_columns",
    """SELECT vec_id, 16 AS n_layer_0, 16 AS n_layer_1, 16 AS n_layer_2, 16 AS n_layer_3 FROM embeddings""",
)
def p3(spark, d):
    wide = _wide(spark, d)
    return wide.select("vec_id", *[F.size(c).alias(f"n_{c}") for c in TB.layer_columns(wide)])


@query(
    "p4_pack_layers",
    f"WITH {LONG_SQL} SELECT sample_id AS vec_id, concat('layer_', layer) AS name, {s6('list_sum(vec)')} AS total FROM long",
)
def p4(spark, d):
    packed = TB.pack_layers(_wide(spark, d))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return packed.select("vec_id", F.explode("layers").alias("name", "v")).select(
        "vec_id", "name", r6(total).alias("total")
    )


@query(
    "p5_melt_layers",
    f"WITH {LONG_SQL} SELECT sample_id AS vec_id, layer, (i - 1)::INTEGER AS dim, {s6('vec[i]')} AS value FROM long, range(1, 17) r(i)",
)
def p5(spark, d):
    long = TB.melt_layer_columns(_wide(spark, d))
    return long.select("vec_id", "layer", F.posexplode("vec").alias("dim", "value")).withColumn("value", r6("value"))


@query(
    "p6_head_slice",
    """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rn FROM documents)
    WHERE rn >= 10 AND rn < 50""",
)
def p6(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return TB.head_slice(docs, "doc_id", 10, 50, ["lang"])


def _domain_sql(domain: str) -> str:
    rows = ", ".join(f"({c}, '{v}')" for c, v in CODE_DOMAINS[domain].items())
    return f"(VALUES {rows}) dim(code, label)"


@query(
    "p7_decode",
    f"""SELECT c_custkey, c_nationkey, dim.label AS country FROM customer LEFT JOIN {_domain_sql('country')} ON dim.code = c_nationkey""",
)
def p7(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", "c_nationkey", TB.decode(F.col("c_nationkey"), CODE_DOMAINS["country"]).alias("country"))


@query("p8_zero_index_labels", "SELECT doc_id, quality - 1 AS quality, toxic - 1 AS toxic FROM labels")
def p8(spark, d):
    text = F.concat(F.lit(" "), F.col("quality").cast("string"), F.lit(" "))
    return table(spark, d, "labels").select(
        "doc_id",
        L.zero_index_label(text).alias("quality"),
        L.zero_index_label(F.col("toxic")).alias("toxic"),
    )


@query("p9_check_label_arity", f"WITH {LABELLED_SQL} SELECT vec_id, labels FROM labelled WHERE len(ids) NOT BETWEEN 1 AND 5")
def p9(spark, d):
    ids = L.parse_label_list(F.col("labels"))
    return labelled(spark, d).filter(~L.label_arity_ok(ids)).select("vec_id", "labels")


@query(
    "p10_range_check",
    """SELECT 'l_linenumber' AS rule, 1.0::DOUBLE AS lo, 4.0::DOUBLE AS hi, count(l_linenumber) AS checked,
        (count(*) FILTER (l_linenumber NOT BETWEEN 1 AND 4)) AS violations FROM lineitem
    UNION ALL SELECT 'l_discount', 0.0, 0.05, count(l_discount), count(*) FILTER (l_discount NOT BETWEEN 0 AND 0.05) FROM lineitem
    UNION ALL SELECT 'l_quantity', 0.0, 1.0, count(l_quantity), count(*) FILTER (l_quantity NOT BETWEEN 0 AND 1) FROM lineitem""",
)
def p10(spark, d):
    return TB.range_check(
        table(spark, d, "lineitem"), {"l_linenumber": (1, 4), "l_discount": (0, 0.05)}, ["l_quantity"]
    )


@query(
    "p11_guard_min_rows",
    """WITH a AS (SELECT source AS dataset, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1),
    b AS (SELECT source AS dataset, count(*) AS n FROM documents JOIN embeddings ON vec_id = doc_id GROUP BY 1),
    j AS (SELECT dataset, coalesce(a.n, 0) AS n_labels, coalesce(b.n, 0) AS n_vectors FROM a FULL JOIN b USING (dataset))
    SELECT dataset, n_labels, n_vectors, CASE WHEN least(n_labels, n_vectors) = 0 THEN 'empty'
      WHEN least(n_labels, n_vectors) < 10 THEN 'insufficient' ELSE 'run' END AS status FROM j""",
)
def p11(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("source", "dataset")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return TB.guard_min_rows(docs.join(table(spark, d, "labels"), "doc_id"), docs.join(vectors, "doc_id"))


@query(
    "p12_valid_mask",
    """SELECT doc_id, doc_id < least((SELECT count(*) FROM documents), (SELECT count(*) FROM labels)) AS valid FROM documents""",
)
def p12(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return TB.valid_rows(docs, table(spark, d, "labels"), "doc_id")


@query("p13_rows_of_class", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'fr'")
def p13(spark, d):
    return TB.rows_of_class(table(spark, d, "documents"), "lang", "fr").select("doc_id", "source", "n_chars")


@query(
    "p14_skip_done_batches",
    """SELECT doc_id, (doc_id // 16)::BIGINT AS batch_idx FROM documents WHERE doc_id // 16 >= 5
    AND doc_id // 16 NOT IN (SELECT doc_id // 16 FROM labels WHERE toxic = 1)""",
)
def p14(spark, d):
    docs = TB.assign_batch(table(spark, d, "documents").select("doc_id"), "doc_id").drop("pos")
    done = TB.assign_batch(table(spark, d, "labels").filter("toxic = 1"), "doc_id")
    return TB.skip_done_batches(docs, 5, done).select("doc_id", "batch_idx")


@query(
    "p15_threshold",
    """SELECT vec_id, array_to_string(list_transform(embedding::DOUBLE[], lambda x:
      CASE WHEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-x)) > 0.5::DOUBLE THEN 1 ELSE 0 END), '') AS bits FROM embeddings""",
)
def p15(spark, d):
    bits = V.threshold(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(bits.cast("array<string>"), "").alias("bits"))


# ---- U: sets and duplicates --------------------------------------------------


@query(
    "u1_union_splits",
    """SELECT doc_id, split, row_number() OVER (ORDER BY ord, doc_id) - 1 AS row_id FROM (
      SELECT doc_id, CASE lang WHEN 'en' THEN 'train' WHEN 'fr' THEN 'test' ELSE 'validation' END AS split,
             CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS ord FROM documents)""",
)
def u1(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    parts = {
        "train": docs.filter("lang = 'en'"),
        "test": docs.filter("lang = 'fr'"),
        "validation": docs.filter("lang NOT IN ('en', 'fr')"),
    }
    return TB.union_splits(parts, "doc_id").select("doc_id", "split", "row_id")


@query("u2_dedup_rows", "SELECT min(doc_id) AS doc_id, lang, md5(text) AS digest FROM documents GROUP BY lang, text")
def u2(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    return TB.dedup_rows(docs, "doc_id").select("doc_id", "lang", F.md5("text").alias("digest"))


@query(
    "u3_dedup_within_split",
    "SELECT min(doc_id) AS doc_id, source, md5(text) AS digest FROM documents GROUP BY source, text",
)
def u3(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("split"), "text")
    return TB.dedup_rows(docs, "doc_id", within=["split"]).select(
        "doc_id", F.col("split").alias("source"), F.md5("text").alias("digest")
    )


@query("u4_missing_layers", "SELECT DISTINCT l_linenumber AS layer FROM lineitem WHERE l_linenumber NOT IN (SELECT label FROM embeddings WHERE label < 4)")
def u4(spark, d):
    requested = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("layer")).distinct()
    available = table(spark, d, "embeddings").filter("label < 4").select(F.col("label").alias("layer"))
    return TB.missing_values(requested, available)


@query(
    "u5_union_experiments",
    f"WITH {RESULTS_SQL} SELECT 'slices' AS model, dataset, layer, depth, {s6('acc')} AS acc FROM res",
)
def u5(spark, d):
    both = results(spark, d).drop("model", "hamming")
    parts = {("slices", s): both.filter(F.col("dataset") == s).drop("dataset") for s in ("pos", "neg")}
    return TB.union_experiments(parts).select("model", "dataset", "layer", "depth", r6("acc").alias("acc"))


# ---- J: joins ----------------------------------------------------------------


@query(
    "j1_align_vectors_labels",
    f"WITH {LONG_SQL} SELECT sample_id, layer, quality, toxic, {s6('list_sum(vec)')} AS total FROM long JOIN labels ON doc_id = sample_id",
)
def j1(spark, d):
    labels = table(spark, d, "labels").withColumnRenamed("doc_id", "sample_id")
    out = TB.align_vectors_labels(long_vectors(spark, d), labels)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return out.select("sample_id", "layer", "quality", "toxic", r6(total).alias("total"))


_BATCHED_SQL = """v AS (SELECT vec_id, vec_id // 16 AS batch_idx, vec_id % 16 AS pos FROM embeddings),
    numbered AS (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM labels),
    lab AS (SELECT doc_id, quality, r // 16 AS batch_idx, r % 16 AS pos FROM numbered)"""


def _batched(spark, d):
    vectors = TB.assign_batch(table(spark, d, "embeddings").select("vec_id"), "vec_id")
    numbered = TB.assign_row_id(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return vectors, TB.assign_batch(numbered).drop("row_id")


@query(
    "j2_align_with_truncation",
    f"WITH {_BATCHED_SQL} SELECT batch_idx, pos, vec_id, doc_id, quality FROM v JOIN lab USING (batch_idx, pos)",
)
def j2(spark, d):
    vectors, labels = _batched(spark, d)
    return TB.align_batches(vectors, labels).select("batch_idx", "pos", "vec_id", "doc_id", "quality")


@query(
    "j2_batch_mismatch",
    f"""WITH {_BATCHED_SQL}, a AS (SELECT batch_idx, count(*) AS n FROM v GROUP BY 1), b AS (SELECT batch_idx, count(*) AS n FROM lab GROUP BY 1)
    SELECT batch_idx, coalesce(a.n, 0) AS n_vectors, coalesce(b.n, 0) AS n_labels,
      least(coalesce(a.n, 0), coalesce(b.n, 0)) AS kept, coalesce(a.n, 0) <> coalesce(b.n, 0) AS mismatch
    FROM a FULL JOIN b USING (batch_idx)""",
)
def j2_report(spark, d):
    return TB.batch_mismatch(*_batched(spark, d))


@query(
    "j3_apply_split",
    f"WITH {LONG_SQL}, {SPLIT_SQL} SELECT l.sample_id, l.layer, s.split, {s6('list_sum(l.vec)')} AS total FROM long l JOIN split s USING (sample_id)",
)
def j3(spark, d):
    out = TB.apply_split(long_vectors(spark, d), split_of(spark, d))
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return out.select("sample_id", "layer", "split", r6(total).alias("total"))


@query(
    "j4_lookup_dimension",
    f"SELECT p_partkey, p_size, dim.label AS occupation FROM part LEFT JOIN {_domain_sql('occupation')} ON dim.code = p_size",
)
def j4(spark, d):
    dim = TB.domain_table(spark, CODE_DOMAINS)
    part = table(spark, d, "part").select("p_partkey", "p_size")
    return TB.lookup_dimension(part, dim, "occupation", "p_size", "occupation")


@query(
    "j11_restrict_layers",
    f"WITH {LONG_SQL} SELECT sample_id, layer, len(vec)::INTEGER AS width FROM long WHERE layer IN (SELECT l_linenumber FROM lineitem)",
)
def j11(spark, d):
    requested = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("layer"))
    return TB.restrict_layers(long_vectors(spark, d), requested).select("sample_id", "layer", F.size("vec").alias("width"))


# ---- W: ids, batches, splits -------------------------------------------------


@query("w1_assign_row_id", "SELECT event_id, row_number() OVER (ORDER BY event_id * 3 + 7) - 1 AS row_id FROM events")
def w1(spark, d):
    sparse = table(spark, d, "events").select("event_id", (F.col("event_id") * 3 + 7).alias("source_pos"))
    return TB.assign_row_id(sparse, "source_pos").drop("source_pos")


@query("w2_assign_batch", "SELECT event_id, (event_id // 16)::BIGINT AS batch_idx, event_id % 16 AS pos FROM events")
def w2(spark, d):
    return TB.assign_batch(table(spark, d, "events").select("event_id"), "event_id")


@query(
    "w3_batch_offsets",
    """WITH b AS (SELECT event_type, event_id // 16 AS batch_idx, count(*) AS n_samples FROM events GROUP BY ALL)
    SELECT event_type, batch_idx, n_samples,
      (sum(n_samples) OVER (PARTITION BY event_type ORDER BY batch_idx) - n_samples)::BIGINT AS start_idx,
      (sum(n_samples) OVER (PARTITION BY event_type ORDER BY batch_idx))::BIGINT AS end_idx FROM b""",
)
def w3(spark, d):
    events = TB.assign_batch(table(spark, d, "events"), "event_id")
    sizes = events.groupBy("event_type", "batch_idx").agg(F.count(F.lit(1)).alias("n_samples"))
    return TB.batch_offsets(sizes, ["event_type"])


@query(
    "w5_random_split",
    """SELECT event_id, CASE WHEN row_number() OVER (ORDER BY md5(concat('42:', event_id)), event_id) <= ceil(0.2::DOUBLE * count(*) OVER ())
      THEN 'test' ELSE 'train' END AS split FROM events""",
)
def w5(spark, d):
    return TB.random_split(table(spark, d, "events").select("event_id"), "event_id")


@query(
    "w6_stratified_split",
    """SELECT event_id, event_type, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY md5(concat('42:', event_id)), event_id)
      <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY event_type)) THEN 'test' ELSE 'train' END AS split FROM events""",
)
def w6(spark, d):
    return TB.stratified_split(table(spark, d, "events").select("event_id", "event_type"), "event_id", "event_type")


@query(
    "w10_pad_to_batch_max",
    f"""WITH {LABELLED_SQL}, m AS (SELECT vec_id, ids, max(len(ids)) OVER (PARTITION BY vec_id // 16) AS w FROM labelled)
    SELECT vec_id, array_to_string(list_concat(ids, list_transform(range(w - len(ids)), lambda i: 0)), '|') AS labels FROM m""",
)
def w10(spark, d):
    parsed = labelled(spark, d).select("vec_id", L.parse_label_list(F.col("labels")).alias("labels"))
    out = TB.pad_labels_in_batch(TB.assign_batch(parsed, "vec_id"))
    return out.select("vec_id", F.array_join(F.col("labels").cast("array<string>"), "|").alias("labels"))


# ---- A: distributions --------------------------------------------------------


@query(
    "a1_class_distribution",
    f"""WITH {SPLIT_SQL}, c AS (SELECT split, label, count(*) AS n FROM split GROUP BY ALL)
    SELECT split, label, n, (sum(n) OVER (PARTITION BY split))::BIGINT AS n_rows, count(label) OVER (PARTITION BY split) AS n_classes FROM c""",
)
def a1(spark, d):
    return C.class_distribution(split_of(spark, d), ["split"])


@query(
    "a2_majority_share",
    f"""WITH {SPLIT_SQL}, c AS (SELECT split, label, count(*) AS n FROM split GROUP BY ALL)
    SELECT split, {s6('100.0::DOUBLE * max(n) / sum(n)')} AS majority_percent FROM c GROUP BY split""",
)
def a2(spark, d):
    return C.majority_share(split_of(spark, d), ["split"]).select("split", r6("majority_percent").alias("majority_percent"))


@query(
    "a3_min_class_count",
    """WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)
    SELECT lang, min(n) AS min_count, min(n) >= 2 AS stratify FROM c GROUP BY lang""",
)
def a3(spark, d):
    return C.min_class_count(table(spark, d, "documents"), ["lang"], "source")


@query(
    "a4_profile_table",
    """WITH j AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT 'doc_id' AS "column", 'bigint' AS type, count(*) AS n_rows, count(doc_id) AS non_null, count(*) - count(doc_id) AS nulls FROM j
    UNION ALL SELECT 'lang', 'string', count(*), count(lang), count(*) - count(lang) FROM j
    UNION ALL SELECT 'quality', 'int', count(*), count(quality), count(*) - count(quality) FROM j
    UNION ALL SELECT 'toxic', 'int', count(*), count(toxic), count(*) - count(toxic) FROM j""",
)
def a4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return C.profile_table(docs.join(table(spark, d, "labels"), "doc_id", "left"))


@query(
    "a5_crosstab",
    "SELECT o_orderpriority, "
    + ", ".join(f"nullif(count(*) FILTER (o_orderstatus = '{s}'), 0) AS \"{s}\"" for s in ("F", "O", "P"))
    + " FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY o_orderpriority",
)
def a5(spark, d):
    return C.crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query(
    "a17_class_weights",
    f"SELECT event_type, count(*) AS n, {s6('1.0::DOUBLE / (count(*) + 1e-7::DOUBLE)', 10)} AS weight FROM events GROUP BY event_type",
)
def a17(spark, d):
    return C.class_weights(table(spark, d, "events"), "event_type").select("event_type", "n", r6("weight", 10).alias("weight"))


@query(
    "a18_pos_weights",
    f"""WITH {LABELLED_SQL}, u AS (SELECT unnest(list_distinct(ids)) AS label FROM labelled),
    c AS (SELECT label, count(*) AS pos FROM u GROUP BY label)
    SELECT i::INTEGER AS label, coalesce(pos, 0) AS pos,
      {s6('((SELECT count(*) FROM embeddings) - coalesce(pos, 0)) / (coalesce(pos, 0) + 1e-7::DOUBLE)', 2)} AS pos_weight
    FROM range(28) r(i) LEFT JOIN c ON c.label = i""",
)
def a18(spark, d):
    parsed = labelled(spark, d).select(L.parse_label_list(F.col("labels")).alias("labels"))
    return C.pos_weights(parsed).select("label", "pos", r6("pos_weight", 2).alias("pos_weight"))


@query(
    "a19_num_classes",
    f"WITH {LABELLED_SQL} SELECT (max(list_max(ids)) + 1)::INTEGER AS num_classes FROM labelled",
)
def a19(spark, d):
    parsed = labelled(spark, d).select(L.parse_label_list(F.col("labels")).alias("labels"))
    return C.num_classes(parsed)


@query(
    "a25_point_counts",
    "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL",
)
def a25(spark, d):
    return C.point_counts(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


# ---- T: order and limits -----------------------------------------------------


@query("t3_top_classes", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def t3(spark, d):
    return C.top_classes(table(spark, d, "documents"), "source")


@query(
    "t4_order_layers",
    f"WITH {LONG_SQL}, n AS (SELECT layer * 5 AS layer, count(*) AS n FROM long GROUP BY 1) SELECT concat('layer_', layer) AS name, layer, n FROM n ORDER BY layer",
)
def t4(spark, d):
    named = layer_map(spark, d).select(F.explode("layers").alias("name", "vec"))
    scaled = F.concat(F.lit("layer_"), TB.layer_number(F.col("name")) * 5)
    counts = named.groupBy(scaled.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("name", TB.layer_number(F.col("name")).alias("layer"), "n").orderBy("layer")


@query(
    "t6_sample_rows",
    """SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(concat('42:', event_id)), event_id) AS rn FROM events)
    WHERE rn <= 1000""",
)
def t6(spark, d):
    return TB.sample_rows(table(spark, d, "events").select("event_type", "event_id"), "event_id", 1000, 42, ["event_type"])
