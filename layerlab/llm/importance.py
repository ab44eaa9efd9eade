"""13. Target-distribution importance resampling with an Aho-Corasick dictionary.

Features are runs of one to `n_max` consecutive words; a feature's bucket is the
CRC-32 of its words joined by one space. The dictionary holds distinct words, each
between two delimiters, with a payload: its CRC-32, its length in bytes and in
letters. One scan of a text by the automaton emits the payloads of its words; the
CRC-32 of a run comes from the payloads of the words in it and their lengths, without
looking at the letters again. Words that the dictionary does not know yet stand
between the matches: they are hashed on the spot and go into the dictionary for
the texts to come. A full dictionary is begun anew, which costs time only.

Each text is scanned once. What is kept of it is its bucket counts (of `buckets` at
most). These are summed over all documents and all target texts, the gain of each
bucket follows from the sums, and the kept counts are weighted with the gains. The
driver holds `buckets` sums. The draw (the highest scores, Gumbel noise included)
takes positions from a sort by ranges and the counts of the ranges.

Defined results: a null text has no words. A document without an id has the noise
of the empty id and comes last among equal scores. Repeated rows count each. An
empty target, or an empty table, has zero features. A draw of zero rows ranks none.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerlab.llm.common import as_bytes, documents, map_batches
from layerlab.plans.materialize import spread, via_parquet

BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
DICTIONARY_WORDS = 200_000
LONGEST_WORD = 255  # in bytes; longer ones are hashed on the spot each time
NEW_WORDS = 2_000  # at least so many, and a quarter of the dictionary, before it is built anew

#: all ASCII but digits and small letters are delimiters; capitals are lowered first
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def _matrix_times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


def _zero_operators(bits: int = 40) -> list[list[int]]:
    """[k]: matrix over GF(2) that a CRC-32 goes through when 2^k zero bytes follow."""
    one_bit = [0xEDB88320] + [1 << k for k in range(31)]
    for _ in range(3):  # one bit to one byte
        one_bit = [_matrix_times(one_bit, row) for row in one_bit]
    out = [one_bit]
    for _ in range(bits - 1):
        out.append([_matrix_times(out[-1], row) for row in out[-1]])
    return out


_ZEROS = _zero_operators()


def combined(first: np.ndarray, second: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings one after the other; the second has `n_bytes` bytes."""
    out = first.astype(np.uint64)
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        on = np.flatnonzero(n_bytes >> k & 1)
        values, moved = out[on], np.zeros(len(on), np.uint64)
        for bit, row in enumerate(_ZEROS[k]):
            moved ^= np.where(values >> np.uint64(bit) & np.uint64(1), np.uint64(row), np.uint64(0))
        out[on] = moved
    return out ^ second.astype(np.uint64)


class WordDictionary:
    """Delimited words with the payload crc | bytes << 32 | letters << 48."""

    def __init__(self, most: int = DICTIONARY_WORDS):
        self.most = most
        self.new: dict[str, int] = {}
        self._begin()

    def _begin(self) -> None:
        self.automaton, self.size = ahocorasick.Automaton(), 0

    def _learn(self) -> None:
        if len(self.new) < max(NEW_WORDS, self.size // 4):
            return
        if self.size + len(self.new) > self.most:
            self._begin()
        for word, payload in self.new.items():
            self.automaton.add_word(f" {word} ", payload)
        self.size += len(self.new)
        self.new = {}
        self.automaton.make_automaton()

    def _unknown(self, word: str) -> tuple[int, int]:
        raw = word.encode("utf-8", "surrogatepass")
        crc = zlib.crc32(raw)
        if len(raw) <= LONGEST_WORD:
            self.new[word] = crc | len(raw) << 32 | len(word) << 48
        return crc, len(raw)

    def scan(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(CRC-32, bytes) of each word of the text, in order."""
        self._learn()
        line = f" {text.translate(_FOLD).decode('utf-8', 'surrogatepass')} "
        hits = list(self.automaton.iter(line)) if self.size else []
        ends = np.fromiter((e for e, _ in hits), np.int64, len(hits))
        payload = np.fromiter((p for _, p in hits), np.uint64, len(hits))
        crc = payload & np.uint64(0xFFFFFFFF)
        n_bytes = (payload >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.int64)
        letters = (payload >> np.uint64(48)).astype(np.int64)
        if letters.sum() == len(line) - line.count(" "):
            return crc, n_bytes
        # between the delimiter that ends a match and the one that begins the next
        after = np.append(0, ends)
        before = np.append(ends - letters - 1, len(line) - 1)
        gaps = np.flatnonzero(before - after >= 2)
        more = [(k, *self._unknown(w)) for k in gaps.tolist() for w in line[after[k] : before[k]].split(" ") if w]
        if not more:
            return crc, n_bytes
        places, crcs, sizes = map(np.array, zip(*more))
        return np.insert(crc, places, crcs.astype(np.uint64)), np.insert(n_bytes, places, sizes)


def run_buckets(crc: np.ndarray, n_bytes: np.ndarray, n_max: int, buckets: int) -> np.ndarray:
    """Buckets of all runs of one to `n_max` words, from the payloads of the words."""
    out, so_far = [crc], crc
    space = np.uint64(zlib.crc32(b" "))
    for n in range(2, min(n_max, len(crc)) + 1):
        so_far = combined(so_far[:-1], np.full(len(so_far) - 1, space), np.ones(len(so_far) - 1, np.int64))
        so_far = combined(so_far, crc[n - 1 :], n_bytes[n - 1 :])
        out.append(so_far)
    return np.concatenate(out) % np.uint64(buckets)


_DICTIONARY = WordDictionary()  # of this worker, over all its tasks


def bucket_counts(docs: DataFrame, n_max: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, bucket, times): the buckets of each text and their counts."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts = batch.columns
        words, features, offsets, found, times = [], [], [0], [], []
        for text in as_bytes(texts):
            crc, n_bytes = _DICTIONARY.scan(text)
            b, n = np.unique(run_buckets(crc, n_bytes, n_max, buckets), return_counts=True)
            words.append(len(crc))
            features.append(int(n.sum()))
            offsets.append(offsets[-1] + len(b))
            found.append(b.astype(np.int32))
            times.append(n.astype(np.int32))
        lists = [
            pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(np.concatenate([*x, np.empty(0, np.int32)]))
            )
            for x in (found, times)
        ]
        columns = [ids, pa.array(words, pa.int64()), pa.array(features, pa.int64()), *lists]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "bucket", "times"])

    schema = "doc_id long, n_words long, n_features long, bucket array<int>, times array<int>"
    return map_batches(docs.select("doc_id", "text"), work, schema)


def bucket_totals(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows of bucket_counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            b, n = (np.asarray(c.flatten()) for c in batch.columns)
            sums += np.bincount(b, weights=n, minlength=buckets).astype(np.int64)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(sums[used])], names=["bucket", "n"]
        )

    parts = counts.select("bucket", "times").mapInArrow(work, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to source share, with one added to each bucket."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log(float((t + 1) * (s_all + k)) / float((s + 1) * (t_all + k))))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        np.int64,
    )


def weighted(counts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of bucket_counts."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, words, features, b, n = batch.columns
        value = gain[np.asarray(b.flatten())] * np.asarray(n.flatten()).astype(np.int64)
        sums = np.concatenate(([0], np.cumsum(value)))
        ends = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(b).to_numpy(zero_copy_only=False))))
        weight = pa.array((sums[ends[1:]] - sums[ends[:-1]]).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [ids, words, features, weight], names=["doc_id", "n_words", "n_features", "weight"]
        )

    return map_batches(counts, work, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int, doc_id: Column) -> Column:
    """Thousandths of Gumbel noise, from 32 bits of SHA-256."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def drawn(scored: DataFrame, share: tuple[int, int], min_words: int = MIN_WORDS) -> DataFrame:
    """`scored` with rank: 1, 2, ... for the highest scores of rows with `min_words` words.

    floor(share[0] N / share[1]) of the N such rows are drawn. They are sorted by
    ranges of (score, id); a row's rank is its place in its range after the rows
    of the ranges before.
    """
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    fit = F.col("n_words") >= min_words
    parted = via_parquet(
        scored.filter(fit).repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()),
        "importance-ranges",
    )
    sizes = {r.part: r.n for r in parted.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, n_all = {}, 0
    for part in sorted(sizes):  # as many as there are partitions
        before[part] = n_all
        n_all += sizes[part]
    most = share[0] * n_all // share[1]
    offsets = scored.sparkSession.createDataFrame(list(before.items()), "part int, before long")
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    places = parted.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + within)
    ranked = places.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).select(*scored.columns, "rank")
    return ranked.unionByName(scored.filter(~fit).withColumn("rank", F.lit(None).cast("long")))


def resampled(
    docs: DataFrame,
    target: DataFrame,
    n_max: int = 1,
    buckets: int = BUCKETS,
    share: tuple[int, int] = (10, 100),
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): every document of `docs`."""
    rows = spread(documents(docs, id_col, text_col), "doc_id", "th")
    counts = via_parquet(bucket_counts(rows, n_max, buckets), "importance-counts")
    like = target.select(F.lit(0).cast("long").alias("doc_id"), F.coalesce(F.col(target_col), F.lit("")).alias("text"))
    gain = gains(bucket_totals(counts, buckets), bucket_totals(bucket_counts(like, n_max, buckets), buckets))
    scored = weighted(counts, gain).withColumn("score", F.col("weight") + noise(seed, F.col("doc_id")))
    return drawn(via_parquet(scored, "importance-scores"), share, min_words)
