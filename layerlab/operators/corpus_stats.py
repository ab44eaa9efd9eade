"""Corpus exploration: distributions, cross-tabs, terms, TF-IDF, sentiment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerlab.functions.fixed_values import SENTIMENT_ALPHA
from layerlab.functions.text import remove_stop_words, tokenize_words
from layerlab.plans.materialize import inline_if_small, via_parquet
from layerlab.plans.ordering import exact_quantiles, null_safe_join

BLOCK_BYTES = 16 << 20  # text of one block of documents in tfidf

# ---- distributions -----------------------------------------------------------


def class_distribution(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Rows per class, with rows and number of classes of the key."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*(keys or [F.lit(0)]))  # one row per class
    return counts.withColumn("n_rows", F.sum("n").over(w)).withColumn(
        "n_classes", F.count(label).over(w)
    )


def majority_share(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """100 * largest class / rows per key."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg((F.lit(100.0) * F.max("n") / F.sum("n")).alias("majority_percent"))


def min_class_count(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Smallest class and whether a stratified split is possible."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min("n").alias("min_count")).withColumn(
        "stratify", F.col("min_count") >= 2
    )


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """1 / (count + 1e-7) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("weight", 1.0 / (F.col("n") + 1e-7))


def pos_weights(df: DataFrame, labels: str = "labels", classes: int = 28) -> DataFrame:
    """(n - pos) / (pos + 1e-7) for every label id, also those never seen."""
    ids = F.array_distinct(F.filter(labels, lambda i: i.between(0, classes - 1)))
    # one marker row (-1) per input row carries n through the same aggregate
    marked = df.select(F.explode(F.concat(F.array(F.lit(-1)), F.coalesce(ids, F.array().cast("array<int>")))).alias("label"))
    every = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    counts = marked.groupBy("label").agg(F.count(F.lit(1)).alias("pos"))
    n = counts.filter(F.col("label") == -1).agg(F.coalesce(F.max("pos"), F.lit(0))).scalar()
    pos = F.coalesce("pos", F.lit(0))
    return every.join(counts, "label", "left").select(
        "label", pos.alias("pos"), ((n - pos) / (pos + 1e-7)).alias("pos_weight")
    )


def weight_array(weights: DataFrame) -> Column:
    """pos_weights as one array in label order (as long as the label set)."""
    pairs = F.sort_array(F.collect_list(F.struct("label", "pos_weight")))
    return weights.agg(pairs.alias("_p")).select("_p.pos_weight").scalar()


def num_classes(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Largest label id + 1 over all lists."""
    return df.agg((F.max(F.array_max(labels)) + 1).alias("num_classes"))


def profile_table(df: DataFrame) -> DataFrame:
    """Per column: type, nulls, non-nulls; one scan."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"_c{i}") for i, c in enumerate(df.columns)])
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"),
                F.lit(kind).alias("type"),
                F.col("_n").alias("n_rows"),
                F.col(f"_c{i}").alias("non_null"),
                (F.col("_n") - F.col(f"_c{i}")).alias("nulls"),
            )
            for i, (name, kind) in enumerate(df.dtypes)
        ]
    )
    return counts.select(F.inline(rows))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Count per pair as a wide table of the given column values.

    Absent pairs are null, null keys dropped. Where the values are not known,
    point_counts has the same counts in long form.
    """
    pairs = df.na.drop(subset=[row, column]).groupBy(row, column).agg(F.count(F.lit(1)).alias("_n"))
    return pairs.groupBy(row).pivot(column, list(values)).agg(F.sum("_n"))


def point_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequency of each combination."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, bins: int = 30, derived: bool = False) -> DataFrame:
    """Equal-width bins from min to max; the last bin is closed.

    The values are read twice; `derived=True` writes them once first, for
    inputs that cost more than a column scan.
    """
    x = F.col(value).cast("double")
    if derived:
        df = via_parquet(df.select(x.alias(value)), "histogram-values")
    span = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    lo, hi = span["lo"], span["hi"]
    width = (hi - lo) / bins
    slot = F.when(hi > lo, F.least(F.floor((x - lo) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counted = df.filter(x.isNotNull()).groupBy(slot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin",
        (lo + F.col("bin") * width).alias("lower"),
        (lo + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def density_estimate(df: DataFrame, value: str, points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density on an even grid, Scott bandwidth.

    Each value adds to every grid point inside the partial aggregate, so the
    shuffle carries `points` rows per task.
    """
    x = F.col(value).cast("double")
    stats = df.agg(
        F.struct(
            F.count(x).alias("n"),
            F.min(x).alias("lo"),
            F.max(x).alias("hi"),
            (F.stddev_samp(x) * F.pow(F.count(x).cast("double"), F.lit(-0.2))).alias("bw"),
        )
    ).scalar()
    step = (stats["hi"] - stats["lo"] + 2 * cut * stats["bw"]) / (points - 1)
    at = stats["lo"] - cut * stats["bw"] + F.col("point") * step
    values = df.filter(x.isNotNull()).select(x.alias("_x"))
    spread = values.select("_x", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    z = (at - F.col("_x")) / stats["bw"]
    mass = spread.groupBy("point").agg(F.sum(F.exp(-0.5 * z * z)).alias("_k"))
    norm = stats["n"] * stats["bw"] * F.sqrt(F.lit(2.0) * F.pi())
    return mass.select("point", at.alias("x"), (F.col("_k") / norm).alias("density"))


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers inside the data, outliers per group."""
    x = F.col(value).cast("double")
    # read several times below: two narrow columns are cheaper to write than to derive again
    data = via_parquet(df.filter(F.col(value).isNotNull()).select(group, x.alias("_x")), "box-values")
    quart = exact_quantiles(data, [group], "_x", [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    joined = null_safe_join(data, inline_if_small(quart), [group], "inner")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("_x").between(F.col("q1") - reach, F.col("q3") + reach)
    return joined.groupBy(group, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.sum((~inside).cast("long")).alias("outliers"),
        F.count(F.lit(1)).alias("n"),
    )


# ---- terms -------------------------------------------------------------------


def _tokens(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    stop_words: Sequence[str] = (),
    only: Sequence[str] | None = None,
) -> DataFrame:
    tokens = tokenize_words(F.col(text))
    if only is not None:
        tokens = F.filter(tokens, lambda t: t.isin(list(only)))
    elif stop_words:
        tokens = remove_stop_words(tokens, list(stop_words))
    return df.select(*keys, F.explode(tokens).alias("term"))


def bag_of_words(df: DataFrame, text: str, stop_words: Sequence[str] = ()) -> DataFrame:
    """Corpus count per term; the partial aggregate absorbs frequent terms."""
    return _tokens(df, [], text, stop_words).groupBy("term").agg(F.count(F.lit(1)).alias("total"))


def doc_terms(
    df: DataFrame,
    doc: str,
    text: str,
    stop_words: Sequence[str] = (),
    only: Sequence[str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Count per (document, term), for all terms or only the listed ones.

    `keep` carries columns of the document along.
    """
    tokens = _tokens(df, [doc, *keep], text, stop_words, only)
    return tokens.groupBy(doc, *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def top_terms(totals: DataFrame, k: int = 20, by: str = "total") -> DataFrame:
    """k terms with the highest value, ties by term."""
    return totals.orderBy(F.desc(by), F.asc("term")).limit(k)


def vocabulary(df: DataFrame, text: str, max_features: int, stop_words: Sequence[str] = ()) -> list[str]:
    """The most frequent terms as a list; at most `max_features` rows reach the driver."""
    top = top_terms(bag_of_words(df, text, stop_words), max_features)
    return sorted(r["term"] for r in top.collect())


def tfidf(
    df: DataFrame,
    doc: str,
    text: str,
    stop_words: Sequence[str] = (),
    only: Sequence[str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(doc, term, tf, weight): tf * (ln((1+n)/(1+df)) + 1), L2-normed per document.

    Texts are counted in blocks of BLOCK_BYTES, so that the counts of a task fit
    its hash table whatever the files; rows that share a document id are counted
    where they lie and meet by (document, term), so that no id fills a task. The
    counts go to blocks of documents once. Each block sends its distinct terms
    to the total and gets their idf back: the counts are never sent to a term,
    and a frequent term is one row a block. The norm is a window over one
    document's distinct terms, inside its block.
    """
    rows = df.groupBy(doc).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.octet_length(text)).alias("_b"))
    size = rows.agg(F.sum("_n").alias("n"), F.max("_n").alias("most"), F.sum("_b").alias("bytes")).first()
    n, blocks = size["n"] or 0, _blocks(df, size["bytes"] or 0)
    texts = df.repartition(blocks, doc) if size["most"] == 1 else df
    counts = doc_terms(texts, doc, text, stop_words, only, keep)
    block = F.coalesce(F.pmod(F.hash(doc), F.lit(blocks)), F.lit(0))
    dealt = counts.withColumn("_block", block).repartitionById(blocks, F.col("_block"))
    # always true; reads what the join reads, so that both share the exchange of `dealt`
    here = (F.col("tf") > 0) & (F.col("_block") == block)
    seen = dealt.groupBy("_block", "term").agg(F.sum(here.cast("long")).alias("_seen"))
    total = F.sum("_seen").over(Window.partitionBy("term"))
    idf = seen.select("_block", "term", (F.log((1.0 + n) / (1.0 + total)) + 1.0).alias("_idf"))
    there = idf.repartitionById(blocks, F.col("_block")).hint("shuffle_hash")
    raw = dealt.join(there, ["_block", "term"]).withColumn("_w", F.col("tf") * F.col("_idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(doc, "_block")))
    return raw.select(doc, *keep, "term", "tf", (F.col("_w") / norm).alias("weight"))


def _blocks(df: DataFrame, size: int) -> int:
    """Blocks for `size` bytes of text, at least as many as there are shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))


def tfidf_totals(df: DataFrame, doc: str, text: str, stop_words: Sequence[str] = ()) -> DataFrame:
    """Sum of normalised TF-IDF per term."""
    return tfidf(df, doc, text, stop_words).groupBy("term").agg(F.sum("weight").alias("total"))


def tfidf_by_class(
    df: DataFrame,
    doc: str,
    text: str,
    label: str,
    stop_words: Sequence[str],
    max_features: int = 30,
) -> DataFrame:
    """Mean TF-IDF per class and term over the most frequent terms.

    Documents without a term count 0 in the mean (sum / class size).
    """
    terms = vocabulary(df, text, max_features, stop_words)
    weights = tfidf(df, doc, text, only=terms, keep=[label])
    sizes = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    sums = weights.groupBy(label, "term").agg(F.sum("weight").alias("_s"))
    cells = sizes.withColumn("term", F.explode(F.array(*[F.lit(t) for t in terms])))
    return cells.join(sums, [label, "term"], "left").select(
        label, "term", (F.coalesce("_s", F.lit(0.0)) / F.col("_n")).alias("mean_tfidf")
    )


def term_long_format(df: DataFrame, doc: str, text: str, terms: DataFrame) -> DataFrame:
    """(doc, term, count) for every document and listed term, zeros kept.

    The list is a small top-k; counting happens inside the document's row, so
    documents are neither joined nor shuffled.
    """
    wanted = terms.agg(F.sort_array(F.collect_list("term"))).scalar()
    listed = df.select(doc, tokenize_words(F.col(text)).alias("_t"), wanted.alias("_k"))
    relevant = listed.select(
        doc, "_k", F.filter("_t", lambda t: F.array_contains(F.col("_k"), t)).alias("_t")
    )
    return relevant.select(doc, F.explode("_k").alias("term"), "_t").select(
        doc,
        "term",
        F.size(F.filter("_t", lambda t: t == F.col("term"))).cast("long").alias("count"),
    )


def lexicon_sentiment(df: DataFrame, doc: str, text: str, lexicon: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Compound score s / sqrt(s^2 + 15) from a (term, valence) table; 0 without hits."""
    tokens = df.select(doc, *keep, F.explode_outer(tokenize_words(F.col(text))).alias("term"))
    hits = tokens.join(inline_if_small(lexicon.select("term", "valence")), "term", "left")
    s = F.sum(F.coalesce("valence", F.lit(0.0)))
    return hits.groupBy(doc, *keep).agg(s.alias("_s")).select(
        doc, *keep, compound(F.col("_s")).alias("compound")
    )


def compound(s: Column) -> Column:
    return s / F.sqrt(s * s + SENTIMENT_ALPHA)


def top_classes(df: DataFrame, label: str = "label", k: int = 5) -> DataFrame:
    """k classes with most rows, ties by class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(label)).limit(k)
