"""4. Suffix-array dedup: maximal repeats from common-prefix interval trees.

A window of `window` bytes is known by its minimiser, the gram of `GRAM` bytes
with the smallest hash in it. Equal windows have equal grams at equal offsets, so
the suffixes that start at one gram, with what stands before them, hold all
repeats around it. That cuts the suffix array of the corpus into parts that are
built apart:

1. Grams that occur once are dropped; they are sorted as hashes, without texts.
2. For the others the bytes around each occurrence (the segment of all windows
   with that minimiser) are dealt by range of (gram, bytes, document) and sorted.
3. Equal segments are repeats as a whole. The distinct ones of a gram are put in
   suffix order from the gram on; a stack scan over the lengths of the common
   prefixes gives the intervals of the tree. In an interval of depth R the
   occurrences are put in order of the bytes before the gram: where two differ
   (left diversity) a group ends, and groups with a common left part of at least
   `window` - R bytes are maximal repeats. All occurrences of a group come out.
   A run of a short word (ruled lines, blanks, one letter) repeats itself: a window
   that equals the one a period before it is settled there, as part of the run, and
   only the first windows of the run, all that differ, go into the tree. All runs of
   one word are one group.
4. The grams at the ends of a range may go on in the next one, as a passage does
   that is in a third of all documents. Each of their windows then goes out once
   for each range, and a grouped count and a join tell those that other ranges
   have too.

Defined results: null texts have no bytes; texts shorter than a window have no
repeats. Equal texts under one id or none are copies of each other. Matches never
cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlab.llm.common import (
    LAST_ID,
    PIECE,
    as_bytes,
    documents,
    map_batches,
    mixed,
    numbered,
    segments,
    union_length,
)
from layerlab.plans.materialize import via_parquet

WINDOW = 200
GRAM = 64
#: Runs of words shorter than this are settled where they stand.
PERIOD = 64
_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))
SEGMENT = "gram long, bytes binary, at int, doc long, place long"


def self_repeats(
    data: np.ndarray, first: np.ndarray, end: np.ndarray, anchor: np.ndarray, grams: np.ndarray, window: int
) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, period, segment) of the runs of words below `PERIOD` bytes in `data`.

    In a run the same gram is the minimiser again a period later, so only segments
    that follow each other like this are compared byte by byte.
    """
    step = np.diff(anchor)
    step[(grams[1:] != grams[:-1]) | (step >= PERIOD)] = 0
    if not step.any():
        return
    edges = np.append(np.flatnonzero(np.concatenate(([True], step[1:] != step[:-1]))), len(step))
    for k, after in zip(edges[:-1].tolist(), edges[1:].tolist()):
        period = int(step[k])
        if not period:
            continue
        low = int(first[k])
        part = data[low : int(end[after]) - 1 + window]
        same = np.concatenate(([False], part[period:] == part[:-period], [False]))
        turns = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()):
            if b - a >= window:
                yield low + a, low + b + period, period, k


def _segments(text: bytes, window: int, gram: int) -> Iterator[tuple]:
    """(first window, end, anchor, gram, runs) of the segments, piece by piece.

    Runs are (start, end, word, gram), the word turned so that it is the smallest;
    windows of a run that equal one before them are in no segment.
    """
    data = np.frombuffer(text, np.uint8)
    for low in range(0, max(0, len(data) - window + 1), PIECE):
        piece = data[low : low + PIECE + window - 1]
        first, end, anchor, grams = segments(_BYTE_VALUES[piece], window, gram)
        runs, kept = [], None
        for a, b, period, k in self_repeats(piece, first, end, anchor, grams, window):
            word = piece[a : a + period].tobytes()
            word = min(word[j:] + word[:j] for j in range(period))
            runs.append((a + low, b + low, word, int(grams[k].view(np.int64))))
            kept = np.ones(int(end[-1]), bool) if kept is None else kept
            kept[a + period : b - window + 1] = False
        if kept is not None:
            at = np.flatnonzero(kept)
            owner = np.repeat(np.arange(len(first)), end - first)[at]
            new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (np.diff(at) > 1)))
            last = np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)
            first, end, anchor, grams = at[new], at[last] + 1, anchor[owner[new]], grams[owner[new]]
        yield first + low, end + low, anchor + low, grams.view(np.int64), runs


def repeated_grams(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc, mark, grams): the minimisers of each document that may occur again.

    Some of them may turn out to be alone (at the ends of a sorted range).
    """

    def all_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for k, text in enumerate(as_bytes(batch.column("text"))):
                doc, mark = batch.column("doc")[k].as_py(), batch.column("mark")[k].as_py()
                for _, _, _, grams, runs in _segments(text, window, gram):
                    if runs:  # the gram of a run is there again, in the windows left out
                        again = np.array([own for *_, own in runs for _ in range(2)], np.int64)
                        grams = np.concatenate((grams, again))
                    held.append((grams, np.full(len(grams), doc), np.full(len(grams), mark)))
                    size += len(grams)
                if size >= PIECE or (k == len(batch) - 1 and held):
                    columns = [pa.array(np.concatenate(x)) for x in zip(*held)]
                    yield pa.RecordBatch.from_arrays(columns, names=["gram", "doc", "mark"])
                    held, size = [], 0

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose gram is that of the row before or after, in and at the ends of a range."""
        last: pa.RecordBatch | None = None
        last_out, first = False, True
        for batch in batches:
            if not len(batch):
                continue
            grams = np.asarray(batch.column("gram"))
            same = grams[1:] == grams[:-1]
            out = np.concatenate((same, [False])) | np.concatenate(([False], same))
            if last is not None and last.column("gram")[0].as_py() == grams[0]:
                out[0] = True
                if not last_out:
                    yield last
            if first:
                out[0], first = True, False
            last, last_out = batch.slice(len(batch) - 1), bool(out[-1])
            yield batch.filter(pa.array(out))
        if last is not None and not last_out:
            yield last

    schema = "gram long, doc long, mark long"
    rows = numbered(docs).mapInArrow(all_grams, schema)
    ranges = rows.repartitionByRange("gram", "doc").sortWithinPartitions("gram", "doc")
    found = via_parquet(ranges.mapInArrow(several, schema), "repeated-grams")
    return found.groupBy("doc", "mark").agg(F.collect_set("gram").alias("grams"))


def segments_of(docs: DataFrame, grams: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(gram, bytes, at, doc, place): segments around the given grams.

    `at` is the place of the gram in the segment, `place` that of the segment in
    the document << 32 | mark. A run has its word in place of the bytes and its
    length, negative, as `at`.
    """

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        texts, size = as_bytes(batch.column("text")), 0
        for k, text in enumerate(texts):
            wanted = np.asarray(batch.column("grams")[k].values)
            doc, mark = batch.column("doc")[k].as_py(), batch.column("mark")[k].as_py()
            for first, end, anchor, own, runs in _segments(text, window, gram):
                rows += [(g, word, a - b, doc, a << 32 | mark) for a, b, word, g in runs]
                for j in np.flatnonzero(np.isin(own, wanted)).tolist():
                    low, high = int(first[j]), int(end[j]) - 1 + window
                    rows.append((int(own[j]), text[low:high], int(anchor[j]) - low, doc, low << 32 | mark))
                    size += high - low
            if size >= 4 * PIECE or (k == len(texts) - 1 and rows):
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), kinds)],
                    names=["gram", "bytes", "at", "doc", "place"],
                )
                rows, size = [], 0

    return map_batches(numbered(docs).join(grams, ["doc", "mark"]), cut, SEGMENT)


def common_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def lcp_intervals(suffixes: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the tree's inner nodes over sorted suffixes."""
    stack: list[tuple[int, int]] = []
    for k in range(1, len(suffixes) + 1):
        depth = common_prefix(suffixes[k - 1], suffixes[k]) if k < len(suffixes) else -1
        first = k - 1
        while stack and stack[-1][0] > depth:
            above, first = stack.pop()
            yield above, first, k - 1
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(members: list[tuple[bytes, int]], window: int) -> Iterator[tuple[int, int, int, int]]:
    """(member, start, end, repeat) of the repeats of distinct segments (bytes, at).

    `repeat` is a hash of the group's common string; start and end are those of the
    longest match of this member within the group.
    """
    right = [(b[at:], k) for k, (b, at) in enumerate(members)]
    right.sort()
    left = [b[:at][::-1] for b, at in members]
    for depth, first, last in lcp_intervals([r for r, _ in right]):
        need = window - depth
        order = sorted((left[k], k) for _, k in right[first : last + 1])
        common = [common_prefix(a, b) for (a, _), (b, _) in zip(order, order[1:])]
        begin = 0
        for k in range(1, len(order) + 1):
            if k < len(order) and common[k - 1] >= max(need, 0):
                continue
            if k - begin > 1:  # a group; the next occurrence has another left part
                shared = min(common[begin : k - 1])
                data, at = members[order[begin][1]]
                repeat = xxhash.xxh3_64_intdigest(data[at - shared : at + depth]) - (1 << 63)
                for j in range(begin, k):
                    longest = max(common[max(begin, j - 1) : min(j, k - 2) + 1])
                    member = order[j][1]
                    at = members[member][1]
                    yield member, at - longest, at + depth, repeat
            begin = k


def repeats_of_ranges(window: int, every: bool):
    """Pass over a range sorted by gram and bytes.

    Intervals come from the deepest up, so an occurrence covers bytes that the
    ones before it did not only if it starts earlier. Others are left out unless
    `every` asks for the whole groups.

    Yields occurrences (gram null) and, for the grams that may be open, every
    window of the range once: (gram, h1, h2) with the place where it still has to
    be looked up elsewhere, or none if it is known to be repeated.
    """
    names = ["gram", "h1", "h2", "doc", "place", "end", "repeat"]

    def occurrence(row: tuple, start: int, end: int, repeat: int) -> tuple:
        doc, place = row[3:5]
        return None, None, None, doc, place + (start << 32), (place >> 32) + end, repeat

    def solved(members: list[tuple], copied: list[bool], is_open: bool) -> Iterator[tuple]:
        covered = [[(0, len(m[1]))] if c else [] for m, c in zip(members, copied)]
        for k, start, end, repeat in maximal_repeats([(m[1], m[2]) for m in members], window):
            new = not covered[k] or start < covered[k][-1][0]
            if new or every:
                yield occurrence(members[k], start, end, repeat)
            if new:
                covered[k].append((start, end))
        if not is_open:
            return
        seen: set[bytes] = set()
        for row, spans in zip(members, covered):
            known = np.zeros(len(row[1]) - window + 1, bool)
            for start, end in spans:
                known[start : end - window + 1] = True
            for k, settled in enumerate(known.tolist()):
                digest = xxhash.xxh3_128_digest(row[1][k : k + window])
                if digest in seen:
                    continue
                seen.add(digest)
                h1, h2 = np.frombuffer(digest, np.int64).tolist()
                place = None if settled else row[4] + (k << 32)
                yield row[0], h1, h2, row[3], place, None, None

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        opening = None  # first gram of the range
        members: list[tuple] = []  # distinct segments of the gram at hand
        copied: list[bool] = []
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("gram", "bytes", "at", "doc", "place"))):
                opening = row[0] if opening is None else opening
                if row[2] < 0:  # a run
                    yield occurrence(row, 0, -row[2], xxhash.xxh3_64_intdigest(row[1]) - (1 << 63))
                    continue
                if members and members[-1][0] == row[0] and members[-1][1] == row[1]:
                    repeat = xxhash.xxh3_64_intdigest(row[1]) - (1 << 63)
                    if not copied[-1]:
                        copied[-1] = True
                        yield occurrence(members[-1], 0, len(row[1]), repeat)
                    yield occurrence(row, 0, len(row[1]), repeat)
                else:
                    if members and members[-1][0] != row[0]:
                        is_open = members[-1][0] == opening
                        if is_open or len(members) > 1:
                            yield from solved(members, copied, is_open)
                        members, copied = [], []
                    members.append(row)
                    copied.append(False)
        if members:
            yield from solved(members, copied, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = results(batches)
        while part := list(islice(rows, 8192)):
            columns = [pa.array(c, pa.int64()) for c in zip(*part)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def repeated_spans(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, every: bool = False
) -> DataFrame:
    """(doc, mark, start, end, repeat): occurrences of maximal repeats.

    `docs` as from common.documents. With `every` all occurrences of each group,
    otherwise those that cover bytes not covered by a longer match to the right.
    """
    rows = segments_of(docs, repeated_grams(docs, window, gram), window, gram)
    # the document is in the range key so that copies of one segment are dealt out too
    ranges = rows.repartitionByRange("gram", "bytes", "doc").sortWithinPartitions("gram", "bytes")
    schema = "gram long, h1 long, h2 long, doc long, place long, end long, repeat long"
    found = via_parquet(ranges.mapInArrow(repeats_of_ranges(window, every), schema), "repeats")
    mark = F.col("place").bitwiseAND(0xFFFFFFFF).alias("mark")
    start = F.shiftright("place", 32).alias("start")
    closed = found.filter("gram IS NULL").select("doc", mark, start, "end", "repeat")
    one, key = found.filter("gram IS NOT NULL"), ["gram", "h1", "h2"]
    again = one.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    opened = (
        one.filter("place IS NOT NULL")
        .join(via_parquet(again, "open-windows"), key)
        .select("doc", mark, start, (start + window).alias("end"), F.col("h1").alias("repeat"))
    )
    return closed.unionByName(opened)


def without_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, starts, ends, kept): the bytes outside all spans."""
    own = spans.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = numbered(docs).join(own, ["doc", "mark"], "left").select("doc", "text", "spans")

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        texts, size, first = as_bytes(batch.column("text")), 0, 0
        for k, text in enumerate(texts):
            found = batch.column("spans")[k]
            starts = ends = np.empty(0, np.int64)
            if found.is_valid:
                starts, ends = union_length(
                    *(found.values.field(n).to_numpy(zero_copy_only=False) for n in ("start", "end"))
                )
            edges = [0, *np.column_stack((starts, ends)).reshape(-1).tolist(), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((len(text), int((ends - starts).sum()), starts, ends, kept))
            size += len(text)
            if size >= 4 * PIECE or k == len(texts) - 1:
                n, gone, s, e, t = zip(*out)
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(first, len(out)), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                        pa.array(s, lists), pa.array(e, lists), pa.array(t, pa.binary()),
                    ],
                    names=["doc", "n_bytes", "n_removed", "starts", "ends", "kept"],
                )
                first, size, out = k + 1, 0, []

    schema = "doc long, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary"
    return map_batches(joined, cut, schema).select(
        F.when(F.col("doc") != LAST_ID, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "starts", "ends", "kept"
    )


def repeat_dedup(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Texts without the bytes of windows that start anywhere else too."""
    rows = documents(docs, id_col, text_col)
    return without_repeats(rows, repeated_spans(rows, window))
