"""7. Substring dedup by relative Lempel-Ziv parsing over words.

The reference of a document is every document with a smaller id. It is cut into
blocks by content: a window of `window` words belongs to the block of its
minimiser (the k words of smallest hash in it), so equal windows always meet in
one block, wherever they stand. A document is a run of segments, each with the
windows of one block. Within a block the segments are taken in the order of their
documents and factored greedily against the segments of earlier documents: from a
place whose window is indexed, the factor goes on as long as the reference does.
Where a factor ends, the windows that begin in it and end after it are looked up
on their own. All factors have `window` words at least and are duplicate spans.

Blocks are dealt by range of (block, document) and factored range by range. The
blocks at the ends of a range may go on in another one: a passage in a third of
all documents is in many. There, what an earlier document of the same range has is
settled in the range too; of each window only the first places are left, and these
few are compared between the ranges by a grouped minimum and a join.

Windows are compared by 64 bits of the block and 64 more of the window.

Defined results: null texts have no words. A row without an id comes after all
others and is no reference. Rows with the same id are no reference for each
other. Documents of fewer words than a window have no spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlab.llm.common import (
    LAST_ID,
    PIECE,
    WordHashes,
    as_bytes,
    documents,
    gram_hashes,
    map_batches,
    numbered,
    segments,
    union_length,
)
from layerlab.plans.materialize import via_parquet

WINDOW = 13
GRAM = 3
SEGMENT = "block long, doc long, place long, windows binary"


def document_segments(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(block, doc, place, windows): `place` is the first word << 32 | mark."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            blocks, ids, places, counts, hashed = (np.concatenate(x) for x in zip(*held))
            held.clear()
            ends = np.concatenate(([0], np.cumsum(8 * counts))).astype(np.int32)
            data = pa.Array.from_buffers(
                pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(hashed)]
            )
            columns = [pa.array(blocks.view(np.int64)), pa.array(ids), pa.array(places), data]
            return pa.RecordBatch.from_arrays(columns, names=["block", "doc", "place", "windows"])

        size = 0
        for batch in batches:
            marks = batch.column("mark").to_pylist()
            for doc, mark, text in zip(batch.column("doc").to_pylist(), marks, as_bytes(batch.column("text"))):
                words = text.split()
                for low in range(0, max(1, len(words) - window + 1), PIECE):
                    units = hashes.of(words[low : low + PIECE + window - 1])
                    first, end, _, block = segments(units, window, GRAM)
                    if not len(first):
                        continue
                    hashed = gram_hashes(units, window)
                    ids = np.full(len(first), doc, np.int64)
                    held.append((block, ids, (first + low) << 32 | mark, end - first, hashed))
                    size += len(units)
                    if size >= PIECE:
                        yield out()
                        size = 0
        if held:
            yield out()

    return numbered(docs).mapInArrow(cut, SEGMENT)


def factors(rows: list[tuple[int, list[int]]], misses: list | None = None) -> Iterator[tuple[int, int, int]]:
    """(row, first window, end) of greedy factors; rows of one block by document.

    `misses` gets the (row, window) that no earlier document has.
    """
    index: dict[int, tuple[int, int]] = {}
    new = 0  # rows from here on belong to the document at hand
    for row, (doc, own) in enumerate(rows):
        while rows[new][0] != doc:
            for k, w in enumerate(rows[new][1]):
                index.setdefault(w, (new, k))
            new += 1
        at = 0
        while at < len(own):
            found = index.get(own[at])
            if found is None:
                if misses is not None:
                    misses.append((row, at))
                at += 1
                continue
            other, k = rows[found[0]][1], found[1]
            end = at + 1
            while end < len(own) and k + end - at < len(other) and other[k + end - at] == own[end]:
                end += 1
            yield row, at, end
            at = end


def factored_ranges(window: int):
    """Pass over a range sorted by block and document.

    Yields spans (block null) and the unmatched windows of blocks that may be open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last block
        at_start = True  # the first block of the range has not ended yet

        def solved(rows: pa.RecordBatch, bounds: list[tuple[int, int, bool]]) -> pa.RecordBatch:
            docs, places = np.asarray(rows.column("doc")), np.asarray(rows.column("place"))
            windows, blocks = rows.column("windows"), rows.column("block")
            out: list[tuple] = []
            for low, high, is_open in bounds:
                own = [
                    (int(docs[i]), np.frombuffer(windows[i].as_buffer(), np.int64).tolist())
                    for i in range(low, high)
                ]
                misses: list[tuple[int, int]] | None = [] if is_open else None
                for row, first, end in factors(own, misses):
                    place = int(places[low + row])
                    out.append((None, own[row][0], place + (first << 32), None, (place >> 32) + end - 1 + window))
                for row, k in misses or ():
                    place = int(places[low + row]) + (k << 32)
                    out.append((blocks[low].as_py(), own[row][0], place, own[row][1][k], None))
            names = ["block", "doc", "place", "hashed", "end"]
            columns = zip(*out) if out else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            blocks = np.asarray(batch.column("block"))
            if blocks[-1] == held[0].column("block")[0].as_py():
                continue  # all of one block so far
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            blocks, docs = np.asarray(rows.column("block")), np.asarray(rows.column("doc"))
            starts = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1])))
            ends = starts[1:]
            several = docs[ends - 1] != docs[starts[:-1]]
            bounds = [(starts[k], ends[k], False) for k in np.flatnonzero(several)]
            if at_start:
                bounds = [(starts[0], ends[0], True)] + [b for b in bounds if b[0]]
                at_start = False
            yield solved(rows, bounds)
            held = [rows.slice(starts[-1])]
        if held:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield solved(rows, [(0, len(rows), True)])

    return run


def duplicate_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, mark, spans): word spans that begin in a document with a smaller id.

    `docs` as from common.documents; documents without spans have no row.
    """
    ranges = (
        document_segments(docs, window)
        .repartitionByRange("block", "doc")
        .sortWithinPartitions("block", "doc")
    )
    schema = "block long, doc long, place long, hashed long, end long"
    found = via_parquet(ranges.mapInArrow(factored_ranges(window), schema), "factors")
    closed = found.filter("block IS NULL").select("doc", "place", "end")
    one = found.filter("block IS NOT NULL").select("block", "hashed", "doc", "place")
    least = via_parquet(one.groupBy("block", "hashed").agg(F.min("doc").alias("least")), "open-windows")
    opened = (
        one.join(least, ["block", "hashed"])
        .filter("least < doc")
        .select("doc", "place", (F.shiftright("place", 32) + window).alias("end"))
    )
    return (
        closed.unionByName(opened)
        .select(
            "doc",
            F.col("place").bitwiseAND(0xFFFFFFFF).alias("mark"),
            F.struct(F.shiftright("place", 32).alias("start"), "end").alias("span"),
        )
        .groupBy("doc", "mark")
        .agg(F.collect_set("span").alias("spans"))
    )


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, starts, ends, kept): kept words joined by one space."""
    joined = numbered(docs).join(spans, ["doc", "mark"], "left")

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        ids, size, first = batch.column("doc"), 0, 0
        texts = as_bytes(batch.column("text"))
        for k, (text, found) in enumerate(zip(texts, batch.column("spans"))):
            words, own = text.split(), found.values if found.is_valid else None
            starts = ends = np.empty(0, np.int64)
            if own is not None and len(own):
                starts, ends = union_length(
                    own.field("start").to_numpy(zero_copy_only=False), own.field("end").to_numpy(zero_copy_only=False)
                )
            kept, at = [], 0
            for s, e in zip(starts.tolist(), ends.tolist()):
                kept.extend(words[at:s])
                at = e
            kept.extend(words[at:])
            out.append((len(words), int((ends - starts).sum()), starts, ends, b" ".join(kept)))
            size += len(text)
            if size >= 4 * PIECE or k == len(texts) - 1:
                n, gone, s, e, t = zip(*out)
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(out)), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                        pa.array(s, lists), pa.array(e, lists), pa.array(t, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc", "n_words", "n_removed", "starts", "ends", "kept"],
                )
                first, size, out = k + 1, 0, []

    schema = "doc long, n_words long, n_removed long, starts array<long>, ends array<long>, kept string"
    return map_batches(joined.select("doc", "text", "spans"), cut, schema).withColumn(
        "doc", F.when(F.col("doc") != LAST_ID, F.col("doc"))
    ).withColumnRenamed("doc", "doc_id")


def substring_dedup(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Texts without the words of windows that begin in an earlier document."""
    rows = documents(docs, id_col, text_col)
    return without_spans(rows, duplicate_spans(rows, window))
