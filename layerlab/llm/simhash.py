"""11. SimHash near-dedup by meeting in the middle of Hamming balls.

A text is lower-cased (A-Z) and cut into shingles of four words, repeats included;
fewer words are one shingle. Each bit of the 64-bit fingerprint is set if it is set
in over half of the shingles' XXH64 values. Two fingerprints link at `RADIUS` or
fewer differing bits; classes are connected components.

Fingerprints at distance 4 or less have a value in the middle that is at most 2 bits
from either. Every different fingerprint therefore emits all values within 2 bits,
its variants, and those that emit the same variant meet. Two that share a variant
are at most 4 bits apart, so one member of a variant's group leads it and is linked
with the others: no connection is lost, no pairs within a group are made, and a
variant has 2,081 emitters at most, whatever the number of copies.

A variant is an upper and a lower half. What goes over the network is one entry
for each variant of the upper half within 2 bits (529), packed in 64 bits; the
receiver adds the variants of the lower half with the bits that are left, but only
where upper halves met. Upper halves are dealt by a bijective hash. A group of
upper halves too large for a step is worked on in slices of its lower variants.

Defined results: a null text, or one without words, has fingerprint zero, and is
linked like any other. The component is named by its smallest id; rows without an
id do not count, and a component without ids is named null. Repeated rows come out
as often as they are there. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlab.llm.common import PIECE, as_bytes, documents, map_batches
from layerlab.llm.order_minhash import components
from layerlab.plans.materialize import spread, via_parquet

SHINGLE = 4
SEED = 42
RADIUS = 4
HALF = 32  # bits of either half of a fingerprint
BUCKET_BITS = 12
EMITTED_AT_ONCE = 2_000  # fingerprints whose entries are sorted together
ENTRIES_A_TASK = 1 << 22
VARIANTS_AT_ONCE = 1 << 22

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")
_ODD = np.uint64(0x9E3779B1)
_INVERSE = np.uint64(pow(0x9E3779B1, -1, 1 << HALF))
_LOW = np.uint64((1 << HALF) - 1)


def half_masks(radius: int) -> list[np.ndarray]:
    """Masks of a half with 0, 1, ... `radius` bits."""
    return [
        np.array([sum(1 << b for b in bits) for bits in combinations(range(HALF), k)], np.uint64)
        for k in range(radius + 1)
    ]


_MASKS = half_masks(RADIUS // 2)
_ALL_MASKS = np.concatenate(_MASKS)
_BITS = np.repeat(np.arange(len(_MASKS)), [len(m) for m in _MASKS])
#: masks that are left for the lower half when the upper one took so many bits
_WITHIN = [np.concatenate(_MASKS[: len(_MASKS) - k]) for k in range(len(_MASKS))]
_INDEX_BITS = (len(_ALL_MASKS) - 1).bit_length()


def fingerprint(text: bytes) -> int:
    """The 64 majority bits of the text's shingles."""
    words = b" ".join(text.translate(_FOLD).split())
    if not words:
        return 0
    gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(words))
    if len(starts) >= SHINGLE:
        starts, ends = starts[: len(starts) - SHINGLE + 1], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), PIECE):
        spans = zip(starts[k : k + PIECE].tolist(), ends[k : k + PIECE].tolist())
        values = np.array([digest(words[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    bits = np.packbits(2 * counts > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed long."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts = batch.columns
        values = np.array([fingerprint(t) for t in as_bytes(texts)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([ids, pa.array(values)], names=["doc_id", "fp"])

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, fp long")


def upper_entries(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Packed entries of the fingerprints of a batch, one row for each bucket.

    An entry is (hash of the upper variant, lower half, number of the upper mask);
    the first bits of the hash are the bucket.
    """
    every = np.asarray(batch.column(0)).view(np.uint64)
    rest = np.uint64(HALF - BUCKET_BITS)
    for k in range(0, len(every), EMITTED_AT_ONCE):
        fps = every[k : k + EMITTED_AT_ONCE, None]
        hashed = (((fps >> np.uint64(HALF)) ^ _ALL_MASKS) * _ODD) & _LOW
        # bucket and entry have 12 + 20 + 32 + 10 bits; the entry alone has 62
        entries = ((hashed << np.uint64(HALF)) | (fps & _LOW)).reshape(-1)
        bucket = (entries >> np.uint64(HALF) >> rest).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        number = (order % len(_ALL_MASKS)).astype(np.uint64)
        entries = (entries[order] << np.uint64(BUCKET_BITS) >> np.uint64(BUCKET_BITS - _INDEX_BITS)) | number
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        offsets = np.append(starts, len(entries)).astype(np.int32) * 8
        blobs = pa.BinaryArray.from_buffers(
            pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(entries.astype("<u8"))]
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[starts].astype(np.int32)), blobs], names=["bucket", "entries"]
        )


def _stars(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Links (first fingerprint of a key, other one), each once; both columns uint64."""
    order = np.argsort(keys)
    keys, fps = keys[order], fps[order]
    same = keys[1:] == keys[:-1]
    if not same.any():
        return np.empty((0, 2), np.uint64)
    met = np.append(same, False) | np.append(False, same)
    keys, fps = keys[met], fps[met]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    first = np.repeat(np.minimum.reduceat(fps, starts), np.diff(np.append(starts, len(keys))))
    a, b = first[first != fps], fps[first != fps]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.stack([a[new], b[new]], axis=1)


def _meetings(group: np.ndarray, fps: np.ndarray, bits: np.ndarray) -> Iterator[np.ndarray]:
    """Links of entries whose upper variants are the same within a group.

    `bits` is the number of bits that the upper variant took. Groups are worked on
    some at a time, and one that is too large in slices of its lower variants.
    """
    cost = np.array([len(m) for m in _WITHIN])[bits]
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sums = np.add.reduceat(cost, starts)
    ends = np.append(starts[1:], len(group))
    k = 0
    while k < len(starts):
        reach = np.cumsum(sums[k:])
        n = max(1, int(np.searchsorted(reach, VARIANTS_AT_ONCE, "right")))
        a, b = starts[k], ends[k + n - 1]
        slices = -(-int(reach[n - 1]) // VARIANTS_AT_ONCE)
        for s in range(slices):
            keys, found = [], []
            for used, masks in enumerate(_WITHIN):
                mine = np.flatnonzero(bits[a:b] == used) + a
                step = max(1, VARIANTS_AT_ONCE // len(masks))
                for m in range(0, len(mine), step):
                    rows = mine[m : m + step]
                    lower = (fps[rows, None] & _LOW) ^ masks
                    variant = (group[rows, None].astype(np.uint64) - np.uint64(group[a]) << np.uint64(HALF)) | lower
                    owner = np.broadcast_to(fps[rows, None], variant.shape)
                    if slices > 1:
                        here = (lower * _ODD & _LOW) % np.uint64(slices) == s
                        variant, owner = variant[here], owner[here]
                    keys.append(variant.reshape(-1))
                    found.append(owner.reshape(-1))
            yield _stars(np.concatenate(keys), np.concatenate(found))
        k += n


def bucket_links(bucket: int, entries: np.ndarray) -> Iterator[np.ndarray]:
    """Links between the fingerprints whose variants meet in a bucket."""
    entries = np.sort(entries)
    kept = np.uint64(HALF + _INDEX_BITS)
    hashed = entries >> kept
    same = hashed[1:] == hashed[:-1]
    met = np.append(same, False) | np.append(False, same)
    if not met.any():
        return
    entries, hashed = entries[met], hashed[met]
    group = np.cumsum(np.concatenate(([True], hashed[1:] != hashed[:-1])))
    number = (entries & np.uint64((1 << _INDEX_BITS) - 1)).astype(np.int64)
    whole = (np.uint64(bucket) << np.uint64(HALF - BUCKET_BITS)) | hashed
    upper = ((whole * _INVERSE) & _LOW) ^ _ALL_MASKS[number]
    fps = (upper << np.uint64(HALF)) | (entries >> np.uint64(_INDEX_BITS) & _LOW)
    yield from _meetings(group, fps, _BITS[number])


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): links that connect all of `nodes` (fp, each once) at RADIUS or less."""
    n = nodes.count()
    parts = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-n * len(_ALL_MASKS) // ENTRIES_A_TASK))
    entries = map_batches(spread(nodes.select("fp"), "fp"), upper_entries, "bucket int, entries binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(list)
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                held[bucket].append(np.frombuffer(blob.as_buffer(), "<u8"))
        while held:
            bucket, blobs = held.popitem()
            for found in bucket_links(bucket, np.concatenate(blobs)):
                close = np.bitwise_count(found[:, 0] ^ found[:, 1]) <= RADIUS
                ends = [pa.array(np.ascontiguousarray(found[close, k]).view(np.int64)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    met = entries.repartition(parts, "bucket").mapInArrow(work, "a long, b long")
    return met.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): every row with its fingerprint and component."""
    rows = spread(documents(docs, id_col, text_col), "doc_id", "th")
    marks = via_parquet(fingerprints(rows), "simhash")
    nodes = via_parquet(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    roots = components(via_parquet(links(nodes), "simhash-links"))
    linked = roots.join(nodes, roots["node"] == nodes["fp"]).select("fp", "root", "first_id")
    least = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = linked.join(least, "root").select("fp", "least_id")
    classes = nodes.join(named, "fp", "left").select(
        F.col("fp").alias("class_fp"), F.coalesce("least_id", "first_id").alias("component_id")
    )
    return marks.join(classes, marks["fp"] == classes["class_fp"]).select("doc_id", "fp", "component_id")
