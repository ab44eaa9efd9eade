"""From documents to token ids, in five stages.

toxicity        documents that the ordinal model calls toxic go
line_dedup      lines that many documents share are cut out of the texts
near_dedup      of each class of near copies the document with the smallest id stays
decontaminate   documents with a passage of the benchmark go
bpe             token ids of what is left, with digests

Each stage works on all rows that its predecessor kept; its result is written to
the shared folder and read again. All but the last return the columns of
documents. A text that lost all its lines is empty and stays: it is a document
without a line of its own, and all such documents are one class of near copies.

Defined results: a null text counts as empty and stays null unless a later stage
drops the row. Rows without an id are judged by their text; rows with the same id and
text share each verdict, so repeated rows stay or go together. An empty table gives no
rows. Further columns of documents are carried through all stages but the last, whatever
their names; n_chars, where there is one, follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerlab.llm import decontaminate, line_dedup, order_minhash, prefix_bpe, toxicity
from layerlab.llm.common import documents
from layerlab.llm.queries import MIN_LINE_DOCS, table, tokenizer_path
from layerlab.plans.materialize import via_parquet

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _whole(docs: DataFrame) -> Column:
    """All columns of a row in one struct; names may hold dots."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("_row")


def _tagged(docs: DataFrame) -> DataFrame:
    """Whole rows in one struct, beside id and text hash as in common.documents.

    The columns of documents may have any name; those of the operators cannot meet them.
    """
    return docs.select(
        _whole(docs),
        docs["doc_id"].cast("long").alias("_doc"),
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("_th"),
    )


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of `docs` whose id and text hash are not in `gone` (doc, th)."""
    rows = _tagged(docs)
    same = rows["_doc"].eqNullSafe(gone["doc"]) & (rows["_th"] == gone["th"])
    return rows.join(gone, same, "left_anti").select("_row.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of documents that are not toxic, with a model fitted on the labels."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    graded = toxicity.graded(docs.select("doc_id", "text", _whole(docs)), model)
    return graded.filter(~F.col("toxicity.toxic")).select("_row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that `MIN_LINE_DOCS` documents or more have."""
    bitmaps = line_dedup.keep_bitmaps(documents(docs), MIN_LINE_DOCS)
    cut = line_dedup.apply_bitmaps(documents(docs), bitmaps.filter("n_dropped > 0"))
    cut = cut.groupBy(F.col("doc_id").alias("doc"), "th").agg(F.first("text").alias("cut"))
    rows = _tagged(docs)
    same = rows["_doc"].eqNullSafe(cut["doc"]) & (rows["_th"] == cut["th"])
    row = F.col("_row")
    text = F.coalesce("cut", row["text"])
    changed = {"text": text, "n_chars": F.when(text.isNotNull(), F.length(text).cast("long"))}
    return rows.join(cut, same, "left").select(*(changed.get(c, row.getField(c)).alias(c) for c in docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    verdicts = order_minhash.near_duplicates(docs)
    gone = verdicts.filter("NOT kept").select(F.col("doc_id").alias("doc"), "mark").distinct()
    rows = _tagged(docs)
    same = rows["_doc"].eqNullSafe(gone["doc"]) & (rows["_th"].bitwiseAND(0xFFFFFFFF) == gone["mark"])
    return rows.join(gone, same, "left_anti").select("_row.*")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    hits = decontaminate.contaminated_words(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, hits.filter(F.size("starts") > 0).select(F.col("doc_id").alias("doc"), "th").distinct())


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256)."""
    encoded = prefix_bpe.encode(docs, tokenizer_path())
    return prefix_bpe.encoded_digests(encoded, "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = via_parquet(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: No SQL: the first stage fits a model and the third follows links to their end.
ORACLE_SQL: str | None = None
