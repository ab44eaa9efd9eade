"""9. Benchmark decontamination as a prefix-filtered set join.

A window is `window` consecutive words of an item, or the whole item if it has
fewer. Its shingles (three words, or the whole window if shorter) are put in
order of rarity, with counts over all documents. For containment of the whole
window one prefix token is enough: wherever the window stands its rarest shingle
stands too, at a known offset. So documents are joined with the rarest shingles
only; a candidate must lie inside the document (length and position) and is then
compared word by word over the size of the window.

The benchmark is joined in blocks of bounded size (`BLOCK_BYTES` of text), each
broadcast to one pass over the documents; a larger benchmark means more passes,
and the passes' hits are united by document.

Defined results: null texts have no words; items without words have no windows;
repeated items and windows count once. Words hit by an item without an id are
hit, but the item is not listed. Rows with the same id and text share a result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlab.llm.common import PIECE, as_bytes, documents, map_batches, on_row, union_length
from layerlab.plans.materialize import via_parquet

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 4 << 20
HITS_SCHEMA = "doc_id long, th long, n_words long, starts array<long>, ends array<long>, items array<string>"

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and code points above 127."""
    return text.translate(_WORD_BYTES).split()


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


@dataclass
class ItemBlock:
    """Windows and shingles of a block of items, in ids of the block's words."""

    ids: _Ids  # word -> 1, 2, ...; other words are 0
    windows: list[tuple[int, ...]]
    items: list[list[str]]  # of each window
    shingles: dict[int, np.ndarray]  # length -> sorted keys

    @classmethod
    def of(cls, rows: list[tuple[str | None, bytes]], window: int) -> ItemBlock:
        ids, items = _Ids(), defaultdict(set)
        for item, text in rows:
            words = [ids.setdefault(w, len(ids) + 1) for w in words_of(text)]
            n = min(window, len(words))
            for k in range(len(words) - n + 1 if n else 0):
                items[tuple(words[k : k + n])].add(item)
        windows = sorted(items)
        keys = defaultdict(set)
        block = cls(ids, windows, [sorted(x for x in items[w] if x is not None) for w in windows], {})
        for w in windows:
            n = min(SHINGLE, len(w))
            keys[n].update(block.key(w[k : k + n]) for k in range(len(w) - n + 1))
        block.shingles = {n: np.array(sorted(v), np.int64) for n, v in keys.items()}
        return block

    def key(self, words) -> int | np.ndarray:
        """One number for a shingle; exact, as a block has fewer than 2^21 words."""
        out = words[0]
        for w in words[1:]:
            out = (out << 21) | w
        return out

    def found(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, positions, shingle numbers) of the block's shingles in `ids`."""
        for n, keys in self.shingles.items():
            here = ids > 0
            for k in range(1, n):
                here[: len(ids) - k] &= ids[k:] > 0
                here[len(ids) - k :] = False
            at = np.flatnonzero(here)
            values = self.key([ids[at + k] for k in range(n)]) if len(at) else at
            number = np.searchsorted(keys, values)
            number[number == len(keys)] = 0
            same = keys[number] == values
            yield n, at[same], number[same]

    def prefixes(self, counts: dict[int, np.ndarray]) -> dict[int, list[list[tuple[int, int]]]]:
        """length -> for each shingle the (window, offset) it is the rarest of."""
        out = {n: [[] for _ in keys] for n, keys in self.shingles.items()}
        for number, w in enumerate(self.windows):
            n = min(SHINGLE, len(w))
            own = [self.key(w[k : k + n]) for k in range(len(w) - n + 1)]
            places = np.searchsorted(self.shingles[n], own)
            rarest = int(np.argmin(counts[n][places]))
            out[n][places[rarest]].append((number, rarest))
        return out


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Rows of a batch, about PIECE bytes of text at a time, with their words."""
    texts, first, size = as_bytes(batch.column("text")), 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= PIECE or k == len(texts) - 1:
            yield batch.slice(first, k + 1 - first), [words_of(x) for x in texts[first : k + 1]]
            first, size = k + 1, 0


def _numbered(ids: _Ids, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of all documents with a 0 after each, and where each begins."""
    lengths = np.array([len(d) for d in docs], np.int64)
    begins = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    out = np.zeros(int(lengths.sum()) + len(docs), np.int64)
    for b, d in zip(begins, docs):
        out[b : b + len(d)] = np.fromiter(map(ids.__getitem__, d), np.int64, len(d))
    return out, begins


def _shingle_counts(rows: DataFrame, shared) -> dict[int, np.ndarray]:
    """How often each shingle of the block stands in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        sums = {n: np.zeros(len(k), np.int64) for n, k in block.shingles.items()}
        for batch in batches:
            for _, docs in _chunks(batch):
                for n, _, number in block.found(_numbered(block.ids, docs)[0]):
                    sums[n] += np.bincount(number, minlength=len(sums[n]))
        for n, s in sums.items():
            at = np.flatnonzero(s)
            columns = [pa.array(np.full(len(at), n)), pa.array(at), pa.array(s[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["n", "number", "times"])

    found = rows.select("text").mapInArrow(count, "n long, number long, times long")
    sums = {n: np.zeros(len(k), np.int64) for n, k in shared.value.shingles.items()}
    for r in found.groupBy("n", "number").agg(F.sum("times").alias("times")).collect():
        sums[r["n"]][r["number"]] = r["times"]
    return sums


def _verified(
    block: ItemBlock, prefixes: dict, ids: np.ndarray
) -> Iterator[tuple[int, int, int]]:
    """(window, start, end) of every occurrence of a window in `ids`."""
    for n, at, number in block.found(ids):
        own = prefixes[n]
        for p, s in zip(at.tolist(), number.tolist()):
            for w, offset in own[s]:
                words, start = block.windows[w], p - offset
                end = start + len(words)
                if start >= 0 and end <= len(ids) and tuple(ids[start:end].tolist()) == words:
                    yield w, start, end


def _block_hits(rows: DataFrame, shared, shared_prefixes) -> DataFrame:
    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        block, prefixes = shared.value, shared_prefixes.value
        for part, docs in _chunks(batch):
            ids, begins = _numbered(block.ids, docs)
            spans, items = [[] for _ in docs], [set() for _ in docs]
            for w, start, end in _verified(block, prefixes, ids):
                d = int(np.searchsorted(begins, start, side="right")) - 1
                spans[d].append((start - int(begins[d]), end - int(begins[d])))
                items[d].update(block.items[w])
            runs = [union_length(*np.array(s or [(0, 0)], np.int64).T) if s else ((), ()) for s in spans]
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("th"),
                    pa.array([len(d) for d in docs], pa.int64()),
                    pa.array([list(map(int, r[0])) for r in runs], lists),
                    pa.array([list(map(int, r[1])) for r in runs], lists),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ],
                names=["doc_id", "th", "n_words", "starts", "ends", "items"],
            )

    return map_batches(rows, scan, HITS_SCHEMA)


def _united(passes: list[DataFrame]) -> DataFrame:
    """Hits of several blocks by document row; runs are still to be united."""
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    flat = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")]
    items = F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    hits = every.filter(F.size("starts") > 0).groupBy("doc_id", "th").agg(*flat, items)
    sizes = passes[0].select("doc_id", "th", "n_words")
    joined = sizes.join(hits, on_row(sizes, hits), "left").select(
        sizes["doc_id"], sizes["th"], "n_words", "starts", "ends", "items"
    )

    def unite(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        starts, ends = batch.column("starts").to_pylist(), batch.column("ends").to_pylist()
        runs = [
            union_length(np.array(s or [], np.int64), np.array(e or [], np.int64))
            for s, e in zip(starts, ends)
        ]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:3],
                *(pa.array([r[k].tolist() for r in runs], pa.list_(pa.int64())) for k in (0, 1)),
                pa.array([x or [] for x in batch.column("items").to_pylist()], pa.list_(pa.string())),
            ],
            names=batch.schema.names,
        )

    return map_batches(joined, unite, HITS_SCHEMA)


def contaminated_words(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, th, n_words, starts, ends, items): word runs hit by benchmark windows."""
    rows, context = documents(docs, id_col, text_col), docs.sparkSession.sparkContext
    items = benchmark.select(
        F.col(item_col).cast("string").alias("item"),
        F.coalesce(F.col(item_text_col), F.lit("")).alias("text"),
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    number = F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks))
    passes = []
    for k in range(n_blocks):
        own = [(r["item"], r["text"].encode()) for r in items.filter(number == k).collect()]
        block = ItemBlock.of(own, window)
        shared = context.broadcast(block)
        prefixes = context.broadcast(block.prefixes(_shingle_counts(rows, shared)))
        found = _block_hits(rows, shared, prefixes)
        passes.append(found if n_blocks == 1 else via_parquet(found, "benchmark-hits"))
    return passes[0] if n_blocks == 1 else _united(passes)


def hit_counts(hits: DataFrame) -> DataFrame:
    """`hits` with n_hit, n_items and contaminated."""
    lengths = F.zip_with("starts", "ends", lambda s, e: e - s)
    n_hit = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)
    return hits.select(
        "*",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        (n_hit > 0).alias("contaminated"),
    )
