"""Text and label functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerlab.functions import labels as L
from layerlab.functions import text as X
from layerlab.functions.fixed_values import BLANKS, EMOTICONS, EMOTICONS_SHORT, EMOTIONS, NEGATIVE, POSITIVE, AMBIGUOUS
from layerlab.operators import corpus_stats as C
from layerlab.operators import experiments as X2
from layerlab.operators.tables import encode_labels, decode_labels
from layerlab.plans.materialize import spread
from layerlab.queries.base import (
    LABELLED_SQL,
    STOP_WORDS,
    SYMBOL_NAMES,
    WORDS_SQL,
    corpus,
    labelled,
    query,
    r6,
    s6,
    sql_list,
    sql_replace,
    table,
)


_NAMED = {k: f":{v}:" for k, v in SYMBOL_NAMES.items()}


def _clean_sql(column: str, keep: str, pairs: dict[str, str]) -> str:
    replaced = sql_replace(sql_replace(f"lower(coalesce({column}, ''))", pairs), _NAMED)
    kept = f"regexp_replace({replaced}, '[^a-zA-Z0-9{keep}{BLANKS}]', '', 'g')"
    return f"trim(regexp_replace({kept}, '[{BLANKS}]+', ' ', 'g'))"


@query("f1_clean_text_keep_punct", f"SELECT page_id, {_clean_sql('html', '.,!?', EMOTICONS)} AS clean_text FROM pages")
def f1(spark, d):
    clean = X.clean_text_keep_punct(F.col("html"), emoji=SYMBOL_NAMES)
    return corpus(spark, d, "pages").select("page_id", clean.alias("clean_text"))


@query("f2_clean_text_alnum", f"SELECT doc_id, {_clean_sql('text', '', EMOTICONS)} AS clean_text FROM documents")
def f2(spark, d):
    clean = X.clean_text_alnum(F.col("text"), emoji=SYMBOL_NAMES)
    return corpus(spark, d).select("doc_id", clean.alias("clean_text"))


@query(
    "f3_emoji_to_name",
    f"SELECT doc_id, {sql_replace('text', _NAMED)} AS named FROM documents",
)
def f3(spark, d):
    return corpus(spark, d).select("doc_id", X.emoji_to_name(F.col("text"), SYMBOL_NAMES).alias("named"))


@query("f4_replace_emoticons", f"SELECT page_id, {sql_replace('html', EMOTICONS_SHORT)} AS replaced FROM pages")
def f4(spark, d):
    return corpus(spark, d, "pages").select(
        "page_id", X.replace_emoticons(F.col("html"), EMOTICONS_SHORT).alias("replaced")
    )


@query("f5_lower_only", "SELECT conv_id, turn, lower(coalesce(text, '')) AS lowered FROM conversations")
def f5(spark, d):
    return corpus(spark, d, "conversations").select("conv_id", "turn", X.lower_text(F.col("text")).alias("lowered"))


@query(
    "f6_parse_label_list",
    f"""WITH {LABELLED_SQL} SELECT vec_id, array_to_string(ids, '|') AS ids, len(ids)::INTEGER AS n FROM labelled""",
)
def f6(spark, d):
    ids = L.parse_label_list(F.col("labels"))
    return labelled(spark, d).select(
        "vec_id", F.array_join(ids.cast("array<string>"), "|").alias("ids"), F.size(ids).alias("n")
    )


@query(
    "f7_format_label_list",
    f"""WITH {LABELLED_SQL} SELECT vec_id, concat('[', array_to_string(ids, ', '), ']') AS canonical FROM labelled""",
)
def f7(spark, d):
    return labelled(spark, d).select(
        "vec_id", L.format_label_list(L.parse_label_list(F.col("labels"))).alias("canonical")
    )


_NAMES_SQL = "(" + "[" + ", ".join(f"'{e}'" for e in EMOTIONS) + "]" + ")"


@query(
    "f8_sentiment_group",
    f"""WITH {LABELLED_SQL}, named AS (
      SELECT vec_id, list_transform(ids, lambda i: {_NAMES_SQL}[i + 1]) AS names FROM labelled)
    SELECT vec_id, CASE
        WHEN list_has_any(names, [{', '.join(f"'{x}'" for x in POSITIVE)}]) THEN 'positive'
        WHEN list_has_any(names, [{', '.join(f"'{x}'" for x in NEGATIVE)}]) THEN 'negative'
        WHEN list_has_any(names, [{', '.join(f"'{x}'" for x in AMBIGUOUS)}]) THEN 'ambiguous'
        ELSE 'neutral' END AS sentiment FROM named""",
)
def f8(spark, d):
    names = L.label_names(L.parse_label_list(F.col("labels")), EMOTIONS)
    return labelled(spark, d).select("vec_id", L.sentiment_group(names).alias("sentiment"))


@query(
    "f9_tokenize_words",
    f"""WITH t AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents)
    SELECT doc_id, len(w)::INTEGER AS n_tokens, array_to_string(w, ' ') AS tokens FROM t""",
)
def f9(spark, d):
    t = X.tokenize_words(F.col("text"))
    return corpus(spark, d).select("doc_id", t.alias("w")).select(
        "doc_id", F.size("w").alias("n_tokens"), F.array_join("w", " ").alias("tokens")
    )


@query(
    "f10_remove_stop_words",
    f"""WITH t AS (SELECT doc_id, list_filter({WORDS_SQL}, lambda w: w NOT IN {sql_list(STOP_WORDS)}) AS w FROM documents)
    SELECT doc_id, len(w)::INTEGER AS n_tokens, array_to_string(w, ' ') AS tokens FROM t""",
)
def f10(spark, d):
    t = X.remove_stop_words(X.tokenize_words(F.col("text")), STOP_WORDS)
    return corpus(spark, d).select("doc_id", t.alias("w")).select(
        "doc_id", F.size("w").alias("n_tokens"), F.array_join("w", " ").alias("tokens")
    )


def _tfidf_sql(stop: list[str] | None = None, vocabulary: str | None = None) -> str:
    where = f"WHERE term NOT IN {sql_list(stop)}" if stop else ""
    semi = f"WHERE term IN ({vocabulary})" if vocabulary else ""
    return f"""tok AS (SELECT doc_id, unnest({WORDS_SQL}) AS term FROM documents),
    tok2 AS (SELECT * FROM tok {where}),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM tok2 {semi} GROUP BY ALL),
    idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf
            FROM tf GROUP BY term),
    raw AS (SELECT doc_id, term, tf, tf * idf AS w FROM tf JOIN idf USING (term)),
    weights AS (SELECT doc_id, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


@query(
    "f11_tfidf",
    f"WITH {_tfidf_sql()} SELECT doc_id, term, tf, {s6('weight')} AS weight FROM weights",
)
def f11(spark, d):
    w = C.tfidf(corpus(spark, d), "doc_id", "text")
    # weights are above zero: no negative zero to replace
    return w.select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


_TOP_SQL = f"""tok AS (SELECT doc_id, unnest({WORDS_SQL}) AS term FROM documents),
    top AS (SELECT term, count(*) AS total FROM tok GROUP BY term ORDER BY total DESC, term LIMIT 20)"""


@query(
    "f12_term_long_format",
    f"""WITH {_TOP_SQL}, c AS (SELECT doc_id, term, count(*) AS n FROM tok GROUP BY ALL)
    SELECT d.doc_id, t.term, coalesce(c.n, 0) AS count
    FROM documents d CROSS JOIN top t LEFT JOIN c ON c.doc_id = d.doc_id AND c.term = t.term""",
)
def f12(spark, d):
    docs = corpus(spark, d)
    return C.term_long_format(docs, "doc_id", "text", C.top_terms(C.bag_of_words(docs, "text")))


_LEXICON_SQL = f"""tok AS (SELECT doc_id, unnest({WORDS_SQL}) AS term FROM documents),
    lexicon AS (SELECT term, (ascii(md5(term)) % 9 - 4)::DOUBLE AS valence FROM
      (SELECT term, count(*) AS total FROM tok GROUP BY term ORDER BY total DESC, term LIMIT 200)),
    scored AS (SELECT d.doc_id, d.lang, coalesce(s.s, 0.0::DOUBLE) AS s FROM documents d LEFT JOIN
      (SELECT doc_id, sum(valence) AS s FROM tok JOIN lexicon USING (term) GROUP BY doc_id) s USING (doc_id)),
    sentiment AS (SELECT doc_id, lang, s / sqrt(s * s + 15.0::DOUBLE) AS compound FROM scored)"""


def lexicon(docs):
    """The 200 most frequent terms with a valence from their digest."""
    top = C.top_terms(C.bag_of_words(docs, "text"), 200)
    return top.select("term", (F.ascii(F.md5("term")) % 9 - 4).cast("double").alias("valence"))


@query(
    "f13_lexicon_sentiment",
    f"WITH {_LEXICON_SQL} SELECT doc_id, {s6('compound')} AS compound FROM sentiment",
)
def f13(spark, d):
    docs = corpus(spark, d)
    out = C.lexicon_sentiment(docs, "doc_id", "text", lexicon(docs))
    return out.select("doc_id", r6("compound").alias("compound"))


_KEY_SQL = "CASE WHEN label = 0 THEN concat('layer_', vec_id) WHEN label = 1 THEN concat('layer_', vec_id, '_xHL') ELSE concat('layer_', vec_id, '_', label, 'HL') END"


@query(
    "f14_parse_result_key",
    f"""WITH k AS (SELECT vec_id, {_KEY_SQL} AS key FROM embeddings), p AS (
      SELECT vec_id, try_cast(split_part(key, '_', 2) AS INTEGER) AS layer,
             try_cast(replace(split_part(key, '_', 3), 'HL', '') AS INTEGER) AS depth FROM k)
    SELECT vec_id, CASE WHEN depth IS NOT NULL THEN layer END AS layer, depth FROM p""",
)
def f14(spark, d):
    lab, v = F.col("label"), F.col("vec_id")
    key = (
        F.when(lab == 0, F.concat(F.lit("layer_"), v))
        .when(lab == 1, F.concat(F.lit("layer_"), v, F.lit("_xHL")))
        .otherwise(F.concat(F.lit("layer_"), v, F.lit("_"), lab, F.lit("HL")))
    )
    layer, depth = X2.parse_result_key(F.col("key"))
    return table(spark, d, "embeddings").select("vec_id", key.alias("key")).select(
        "vec_id", layer.alias("layer"), depth.alias("depth")
    )


@query(
    "f15_parse_experiment_key",
    """SELECT doc_id, source AS model,
       CASE WHEN lang = 'en' THEN 'Unknown' ELSE lang END AS dataset FROM documents""",
)
def f15(spark, d):
    key = F.when(F.col("lang") == "en", F.col("source")).otherwise(F.concat_ws(" | ", "source", "lang"))
    model, dataset = X2.parse_experiment_key(F.col("key"))
    return corpus(spark, d).select("doc_id", key.alias("key")).select(
        "doc_id", model.alias("model"), dataset.alias("dataset")
    )


@query(
    "f19_multi_hot",
    f"""WITH {LABELLED_SQL} SELECT vec_id,
      array_to_string(list_transform(range(20), lambda i: CASE WHEN list_contains(ids, i::INTEGER) THEN 1 ELSE 0 END), '') AS bits
    FROM labelled""",
)
def f19(spark, d):
    bits = L.multi_hot(L.parse_label_list(F.col("labels")), 20)
    return labelled(spark, d).select("vec_id", F.array_join(bits.cast("array<string>"), "").alias("bits"))


@query(
    "f20_multi_hot_columns",
    f"""WITH {LABELLED_SQL} SELECT vec_id, {', '.join(f"CASE WHEN list_contains(ids, {i}) THEN 1 ELSE 0 END AS {n}" for i, n in enumerate(EMOTIONS))}
    FROM labelled""",
)
def f20(spark, d):
    parsed = labelled(spark, d).withColumn("ids", L.parse_label_list(F.col("labels")))
    return parsed.select("vec_id", *L.multi_hot_columns(F.col("ids"), EMOTIONS))


@query(
    "f21_dominant_label",
    f"WITH {LABELLED_SQL} SELECT vec_id, coalesce(list_min(ids), 0) AS dominant FROM labelled",
)
def f21(spark, d):
    return labelled(spark, d).select(
        "vec_id", L.dominant_label(L.parse_label_list(F.col("labels"))).alias("dominant")
    )


@query(
    "f22_encode_labels",
    """SELECT doc_id, source, (dense_rank() OVER (ORDER BY source) - 1)::INTEGER AS code,
       source AS decoded FROM documents""",
)
def f22(spark, d):
    docs = corpus(spark, d).select("doc_id", "source")
    coded = encode_labels(docs, "source")
    decoded = decode_labels(coded.select("doc_id", "code"), docs, "source").select(
        "doc_id", F.col("source").alias("decoded")
    )
    return coded.join(decoded, "doc_id").select("doc_id", "source", "code", "decoded")


@query(
    "f31_wide_onehot_to_list",
    f"""WITH {LABELLED_SQL} SELECT vec_id,
      array_to_string(list_sort(list_distinct(list_filter(ids, lambda i: i < 20))), '|') AS ids FROM labelled""",
)
def f31(spark, d):
    flags = L.multi_hot(L.parse_label_list(F.col("labels")), 20)
    return labelled(spark, d).select(
        "vec_id", F.array_join(L.flags_to_labels(flags).cast("array<string>"), "|").alias("ids")
    )


@query(
    "j5_label_ids_to_names",
    f"""WITH {LABELLED_SQL} SELECT vec_id,
      array_to_string(list_transform(ids, lambda i: {_NAMES_SQL}[i + 1]), '|') AS names FROM labelled""",
)
def j5(spark, d):
    names = L.label_names(L.parse_label_list(F.col("labels")), EMOTIONS)
    return labelled(spark, d).select("vec_id", F.array_join(names, "|").alias("names"))


# ---- corpus terms ------------------------------------------------------------


@query(
    "a20_bag_of_words",
    f"""WITH tok AS (SELECT unnest({WORDS_SQL}) AS term FROM documents)
    SELECT term, count(*) AS total FROM tok GROUP BY term""",
)
def a20(spark, d):
    return C.bag_of_words(corpus(spark, d), "text")


@query(
    "a21_tfidf_totals",
    f"WITH {_tfidf_sql()} SELECT term, {s6('sum(weight)')} AS total FROM weights GROUP BY term",
)
def a21(spark, d):
    return C.tfidf_totals(corpus(spark, d), "doc_id", "text").select("term", r6("total").alias("total"))


_VOC_SQL = f"SELECT term FROM tok2 GROUP BY term ORDER BY count(*) DESC, term LIMIT 30"


@query(
    "a22_tfidf_by_class",
    f"""WITH {_tfidf_sql(STOP_WORDS, _VOC_SQL)},
    sizes AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
    sums AS (SELECT lang, term, sum(weight) AS s FROM weights JOIN documents USING (doc_id) GROUP BY ALL)
    SELECT z.lang, v.term, {s6('coalesce(s.s, 0.0::DOUBLE) / z.n')} AS mean_tfidf
    FROM sizes z CROSS JOIN ({_VOC_SQL}) v LEFT JOIN sums s ON s.lang = z.lang AND s.term = v.term""",
)
def a22(spark, d):
    out = C.tfidf_by_class(corpus(spark, d), "doc_id", "text", "lang", STOP_WORDS)
    return out.select("lang", "term", r6("mean_tfidf").alias("mean_tfidf"))


@query("t1_top_terms", f"WITH {_TOP_SQL} SELECT term, total FROM top")
def t1(spark, d):
    return C.top_terms(C.bag_of_words(corpus(spark, d), "text"))


@query(
    "t2_max_features",
    f"""WITH tok AS (SELECT doc_id, unnest({WORDS_SQL}) AS term FROM documents),
    top AS (SELECT term FROM tok GROUP BY term ORDER BY count(*) DESC, term LIMIT 30)
    SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM top) GROUP BY ALL""",
)
def t2(spark, d):
    docs = corpus(spark, d)
    return C.doc_terms(docs, "doc_id", "text", only=C.vocabulary(docs, "text", 30))


@query(
    "a23_histogram",
    f"""WITH {_LEXICON_SQL}, span AS (SELECT min(compound) AS lo, max(compound) AS hi FROM sentiment),
    binned AS (SELECT least(floor((compound - lo) / ((hi - lo) / 30)), 29)::INTEGER AS bin FROM sentiment, span),
    c AS (SELECT bin, count(*) AS n FROM binned GROUP BY bin)
    SELECT b::INTEGER AS bin, {s6('lo + b * ((hi - lo) / 30)')} AS lower,
           {s6('lo + (b + 1) * ((hi - lo) / 30)')} AS upper, coalesce(c.n, 0) AS n
    FROM range(30) r(b) CROSS JOIN span LEFT JOIN c ON c.bin = b""",
)
def a23(spark, d):
    docs = corpus(spark, d)
    scores = C.lexicon_sentiment(docs, "doc_id", "text", lexicon(docs))
    return C.histogram(scores, "compound", derived=True).select("bin", r6("lower").alias("lower"), r6("upper").alias("upper"), "n")


@query(
    "a24_box_stats",
    f"""WITH {_LEXICON_SQL}, q AS (SELECT lang, quantile_cont(compound, 0.25) AS q1,
      quantile_cont(compound, 0.5) AS median, quantile_cont(compound, 0.75) AS q3 FROM sentiment GROUP BY lang),
    j AS (SELECT *, compound BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS inside
          FROM sentiment JOIN q USING (lang))
    SELECT lang, {s6('q1')} AS q1, {s6('median')} AS median, {s6('q3')} AS q3,
      {s6('min(compound) FILTER (inside)')} AS whisker_low, {s6('max(compound) FILTER (inside)')} AS whisker_high,
      (count(*) FILTER (NOT inside)) AS outliers, count(*) AS n
    FROM j GROUP BY lang, q1, median, q3""",
)
def a24(spark, d):
    docs = corpus(spark, d)
    scores = C.lexicon_sentiment(docs, "doc_id", "text", lexicon(docs), ["lang"])
    out = C.box_stats(scores, "lang", "compound")
    nums = ["q1", "median", "q3", "whisker_low", "whisker_high"]
    return out.select("lang", *[r6(c).alias(c) for c in nums], "outliers", "n")


@query(
    "a32_density_estimate",
    f"""WITH s AS (SELECT count(l_extendedprice) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
        stddev_samp(l_extendedprice) * pow(count(l_extendedprice), -0.2::DOUBLE) AS bw FROM lineitem),
    v AS (SELECT l_extendedprice AS x, count(*) AS c FROM lineitem GROUP BY 1),
    g AS (SELECT p::INTEGER AS point, lo - 3 * bw + p * ((hi - lo + 6 * bw) / 49) AS gx, bw, n FROM range(50) r(p), s)
    SELECT point, {s6('gx', 4)} AS x,
      {s6('sum(c * exp(-0.5::DOUBLE * ((gx - v.x) / bw) * ((gx - v.x) / bw))) / (n * bw * sqrt(2 * pi()))', 10)} AS density
    FROM g, v GROUP BY point, gx, bw, n""",
)
def a32(spark, d):
    prices = spread(table(spark, d, "lineitem").select("l_extendedprice"), "l_extendedprice")
    out = C.density_estimate(prices, "l_extendedprice", 50)
    return out.select("point", r6("x", 4).alias("x"), r6("density", 10).alias("density"))
