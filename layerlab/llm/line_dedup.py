"""10. Line dedup: hashes in ranges, a secondary sort, one streaming pass.

Every line becomes (128-bit hash of its key, document, position). The rows are
dealt by range of (hash, document), so a line that many documents share is cut
into several ranges, and sorted within a range by hash, document and position.
One pass over each range counts the documents of a key and gives out the rows to
drop. Only the first and the last key of a range can go on in another one; their
counts are added up afterwards. The result is a compressed keep bitmap per
document; texts are not shuffled to find the lines.

Two modes: `min_docs=n` drops all lines of keys that n documents or more have;
`min_docs=None` keeps the first occurrence of each key and drops the later ones.

Defined results: a null or empty text is one empty line. Empty keys (shorter
than `min_chars`) are never dropped. Rows with the same id and text count as one
document. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlab.llm.common import BLANKS, documents, map_batches, on_row
from layerlab.plans.materialize import via_parquet

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STREAM_SCHEMA = "h1 long, h2 long, doc_id long, th long, pos int, n_docs long, edge boolean"
LINE = ("h1", "h2", "doc_id", "th", "pos")


def line_keys(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(h1, h2, doc_id, th, pos) of each line whose key has `min_chars` code points."""
    line = F.col("line")
    key = F.translate(F.trim(line, F.lit(BLANKS)), UPPER, UPPER.lower())
    return (
        docs.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("doc_id", "th", "pos", key.alias("key"))
        .filter(F.length("key") >= min_chars)
        .select(
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit("second"), "key").alias("h2"),
            "doc_id",
            "th",
            "pos",
        )
    )


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before, in any column."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


class Lines:
    """Line rows as columns; `null` marks rows whose document has no id."""

    def __init__(self, columns: list[np.ndarray]):
        self.columns = columns

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Lines:
        ids = batch.column("doc_id")
        return cls(
            [np.asarray(ids.fill_null(0) if n == "doc_id" else batch.column(n)) for n in LINE]
            + [np.asarray(ids.is_null())]
        )

    def __len__(self) -> int:
        return len(self.columns[0])

    def __getitem__(self, rows: slice | np.ndarray) -> Lines:
        return Lines([c[rows] for c in self.columns])

    def then(self, other: Lines) -> Lines:
        return Lines([np.concatenate(x) for x in zip(self.columns, other.columns)])

    def changes(self, *which: int) -> np.ndarray:
        """Where a row differs from the one before in one of the columns."""
        new = np.ones(len(self), bool)
        new[1:] = np.any([self.columns[k][1:] != self.columns[k][:-1] for k in which], axis=0)
        return new

    def new_keys(self) -> np.ndarray:
        return self.changes(0, 1)

    def new_documents(self) -> np.ndarray:
        return self.changes(0, 1, 2, 3, 5)

    def has_key(self, key: tuple) -> np.ndarray:
        return (self.columns[0] == key[0]) & (self.columns[1] == key[1])

    def key(self, row: int) -> tuple:
        return self.columns[0][row], self.columns[1][row]

    def batch(self, n_docs: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        h1, h2, doc, th, pos, null = self.columns
        arrays = [h1, h2, pa.array(doc, mask=null), th, pos, n_docs.astype(np.int64), edge]
        return pa.RecordBatch.from_arrays(
            [x if isinstance(x, pa.Array) else pa.array(x) for x in arrays],
            names=[*LINE, "n_docs", "edge"],
        )


def frequent_lines(min_docs: int) -> Callable:
    """Rows of keys that `min_docs` documents have, from one sorted range.

    A key that gets there inside the range is settled: its rows are final and go
    straight out. Others are forgotten at their end, but for the first and the
    last key of the range, whose rows come out as edges. n_docs is the number of
    documents seen, on one row of each key, and 0 on the others.
    """

    def on_first_rows(rows: Lines, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        out[starts] = counts
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Lines | None = None  # rows of the last key, not settled
        settled: tuple | None = None
        at_start = True  # the first key of the range has not ended yet
        for batch in batches:
            rows = Lines.of(batch)
            if settled is not None and len(rows):
                same = rows.has_key(settled)
                n = len(rows) if same.all() else int(np.argmin(same))
                if n:
                    yield rows[:n].batch(np.zeros(n, np.int64), np.zeros(n, bool))
                    rows = rows[n:]
                if len(rows):
                    settled = None
            rows = held.then(rows) if held is not None else rows
            if not len(rows):
                continue
            starts = np.flatnonzero(rows.new_keys())
            counts = np.add.reduceat(rows.new_documents().astype(np.int64), starts)
            sizes = np.diff(np.append(starts, len(rows)))
            final = counts >= min_docs
            edge = np.zeros(len(starts), bool)
            if at_start and (len(starts) > 1 or final[0]):
                edge[0], at_start = not final[0], False
            edge[-1] = False  # it may go on in the next batch
            out = np.repeat(final | edge, sizes)
            if out.any():
                n_docs = on_first_rows(rows, counts, starts)
                yield rows[out].batch(n_docs[out], np.repeat(edge, sizes)[out])
            settled = rows.key(-1) if final[-1] else None
            held = None if final[-1] else rows[starts[-1] :]
        if held is not None:
            n_docs = np.zeros(len(held), np.int64)
            n_docs[0] = held.new_documents().sum()
            yield held.batch(n_docs, np.ones(len(held), bool))

    return run


def later_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a sorted range but the first of each key; these are final.

    The first row of the range's first and last key come out as edges.
    """
    last: tuple | None = None
    first_row = last_row = None
    for batch in batches:
        rows = Lines.of(batch)
        if not len(rows):
            continue
        new = rows.new_keys()
        new[0] = last is None or rows.key(0) != last
        last = rows.key(-1)
        starts = np.flatnonzero(new)
        if len(starts):
            first_row = first_row or rows[starts[:1]]
            last_row = rows[starts[-1:]]
        again = rows[~new]
        yield again.batch(np.zeros(len(again), np.int64), np.zeros(len(again), bool))
    if first_row is not None:
        ends = first_row if first_row.key(0) == last_row.key(0) else first_row.then(last_row)
        yield ends.batch(np.ones(len(ends), np.int64), np.ones(len(ends), bool))


def dropped_lines(docs: DataFrame, min_docs: int | None, min_chars: int = 1) -> DataFrame:
    """(doc_id, th, pos) of the lines to drop; `docs` as from common.documents."""
    lines = via_parquet(line_keys(docs, min_chars), "lines")
    ranges = lines.repartitionByRange("h1", "h2", "doc_id", "th").sortWithinPartitions(*LINE)
    stream = later_lines if min_docs is None else frequent_lines(min_docs)
    found = via_parquet(ranges.mapInArrow(stream, STREAM_SCHEMA), "line-runs")
    edges = found.filter("edge")
    if min_docs is None:
        first = edges.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th", "pos")).alias("first"))
        more = edges.join(first, ["h1", "h2"]).filter(F.struct("doc_id", "th", "pos") != F.col("first"))
    else:
        totals = found.filter("n_docs > 0").groupBy("h1", "h2").agg(F.sum("n_docs").alias("total"))
        more = edges.join(totals.filter(F.col("total") >= min_docs), ["h1", "h2"], "left_semi")
    columns = ["doc_id", "th", "pos"]
    return found.filter("NOT edge").select(columns).unionByName(more.select(columns))


def packed(n_lines: int, drop: list[int] | None) -> bytes:
    """Keep bitmap: bit k is set when line k stays."""
    bits = np.ones(n_lines, np.uint8)
    if drop:
        bits[drop] = 0
    return zlib.compress(np.packbits(bits).tobytes())


def unpacked(bitmap: bytes, n_lines: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
    return bits[:n_lines].astype(bool)


def keep_bitmaps(docs: DataFrame, min_docs: int | None, min_chars: int = 1) -> DataFrame:
    """(doc_id, th, n_lines, n_dropped, keep) for each row of common.documents, once."""
    sizes = (
        docs.select("doc_id", "th", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
        .groupBy("doc_id", "th")
        .agg(F.first("n_lines").alias("n_lines"))
    )
    drops = (
        dropped_lines(docs, min_docs, min_chars)
        .groupBy("doc_id", "th")
        .agg(F.collect_set("pos").alias("drops"))
    )
    joined = sizes.join(drops, on_row(sizes, drops), "left").select(
        sizes["doc_id"], sizes["th"], "n_lines", "drops"
    )

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, th, n_lines, drops = batch.columns
        lists = drops.to_pylist()
        maps = [packed(n, d) for n, d in zip(n_lines.to_pylist(), lists)]
        n_dropped = pa.array([len(d or ()) for d in lists], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [ids, th, n_lines, n_dropped, pa.array(maps, pa.binary())],
            names=["doc_id", "th", "n_lines", "n_dropped", "keep"],
        )

    return map_batches(joined, pack, "doc_id long, th long, n_lines long, n_dropped long, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, th, n_lines, n_dropped, text): every row of `docs` with its kept lines."""
    joined = docs.join(bitmaps, on_row(docs, bitmaps)).select(
        docs["doc_id"], docs["th"], "n_lines", "n_dropped", "keep", "text"
    )

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, th, n_lines, n_dropped, keep, text = batch.columns
        kept = []
        for n, gone, bits, t in zip(n_lines.to_pylist(), n_dropped.to_pylist(), keep, text):
            t = t.as_py()
            if gone:
                stays = unpacked(bits.as_py(), n)
                t = "\n".join(x for x, s in zip(t.split("\n"), stays) if s)
            kept.append(t)
        yield pa.RecordBatch.from_arrays(
            [ids, th, n_lines, n_dropped, pa.array(kept, pa.string())],
            names=["doc_id", "th", "n_lines", "n_dropped", "text"],
        )

    return map_batches(joined, cut, "doc_id long, th long, n_lines long, n_dropped long, text string")


def line_dedup(
    docs: DataFrame, min_docs: int | None = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Texts without their repeated lines; see the module for the two modes."""
    rows = documents(docs, id_col, text_col)
    return apply_bitmaps(rows, keep_bitmaps(rows, min_docs, min_chars))
