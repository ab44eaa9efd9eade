"""What the operators share: inputs, word hashes, windows and their minimisers.

Rows with equal ids are told apart by the hash of their text, so that an id that
is null or repeated never mixes two texts up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: [\x20\x09-\x0D], the only white space the operators know
BLANKS = " \t\n\x0b\x0c\r"
PIECE = 1 << 19  # positions that one numpy step works on
CACHED_WORDS = 400_000
LAST_ID = (1 << 63) - 1  # stands for a missing id
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, text): null texts are empty, th is the hash of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")
    )


def on_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition by row: id (null equals null) and text hash."""
    return (left["th"] == right["th"]) & left["doc_id"].eqNullSafe(right["doc_id"])


def sha(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


class WordHashes(dict):
    """64-bit hash of each word (bytes); forgets all when full, which costs time only."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads low entropy over all bits."""
    h = h ^ (h >> np.uint64(32))
    h *= MIX
    h ^= h >> np.uint64(32)
    h *= MIX
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k units from each position; as many as there are k-grams."""
    n = len(units) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # doubling: the hash of 2m units from two hashes of m; the parts make up k
    power, m, block, out, done = ODD, 1, units, None, 0
    while True:
        if k & m:
            part = block[done : done + n]
            out = part.copy() if out is None else out * power + part
            done += m
        if 2 * m > k:
            return mixed(out)
        block = block[:-m] * power + block[m:]
        power = np.uint64(int(power) ** 2 % (1 << 64))
        m *= 2


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values the position of its first smallest value.

    Values are compared by their upper 42 bits. Minima of the two parts that a
    window has in blocks of `width` values are running minima from either side.
    """
    n = len(values)
    if n >= 1 << 22:
        raise ValueError("at most 2^22 values at once")
    low = np.uint64((1 << 22) - 1)
    padded = np.full(-(-n // width) * width, np.uint64((1 << 64) - 1))
    padded[:n] = (values & ~low) | np.arange(n, dtype=np.uint64)
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & low).astype(np.int64)


def segments(units: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Windows grouped by their minimiser: (first window, end, anchor, gram hash).

    Equal windows choose the same k-gram at the same offset, whatever stands
    around them, so a window need only be compared with those of its gram.
    """
    grams = gram_hashes(units, k)
    if len(units) < window:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, np.empty(0, np.uint64)
    at = leftmost_minima(grams, window - k + 1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    end = np.append(first[1:], len(at))
    anchor = at[first]
    return first, end, anchor, grams[anchor]


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch | pa.Table]], schema: str
) -> DataFrame:
    """mapInArrow over the batches of `df`, one output table or batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in fn(batch):
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def numbered(docs: DataFrame) -> DataFrame:
    """`documents` with an id that is never null (`doc`) and 32 bits of th (`mark`)."""
    return docs.select(
        F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"),
        F.col("th").bitwiseAND(0xFFFFFFFF).alias("mark"),
        "text",
    )


def as_bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def union_length(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, ordered runs that cover the same positions; touching ones join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]
