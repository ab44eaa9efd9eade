"""2. Near-dedup by Order MinHash and banded alignment.

A text is its sequence of five-word shingles, each labelled with its occurrence,
so that no two of a text are equal. A sketch takes the `MINIMA` shingles with the
smallest hashes under one of `SKETCHES` hash functions, in the order they have in
the text; a text has `SKETCHES` of them. Texts that share a sketch are
candidates. Two texts of n and m shingles that can be aligned in k of them, in
order and within a band around the diagonal, have similarity k / (n + m - k): the
Jaccard similarity of the labelled shingles, less what is out of order. Links are
pairs of `SIMILARITY` or more, classes their connected components.

Equal word sequences are one text from the start. A sketch shared by many texts
is not compared pair by pair: one text leads it, the one that shares most
sketches altogether (the original, in a group of edited copies). Each text is
first compared with the leader of its largest group; then, in the groups that still
hold two classes, all others are compared with the leader. Texts that do not join its class are led by another in the
next round, up to `LED_ROUNDS` or a round that links fewer than `LEAST_YIELD` of its
pairs: such groups share a passage and are mostly not alike. What is left of groups
that still hold two classes is joined exactly by the rarest shingles of the texts,
so no pair of a group goes uncompared. A text leads or follows in `SKETCHES`
groups. With five minima and 32 sketches a pair of similarity 0.8
misses them all in 3 to 9 of 10^6 cases, but for short texts more often or always,
as fewer shingles share minima less. Texts of fewer than `EXACT_BELOW` shingles,
and those that may be similar to one, are therefore in the groups of their first
shingles by hash as well (`first_shingles`), of which similar texts share one.

Defined results: a null text has no words. Texts of fewer than five words have no
shingles and are linked to equal word sequences only; all texts without words are
equal. The class is named by its smallest id; rows without an id come last. Of
several texts with the smallest id, or of a class without ids, one is kept. Rows
with the same id and text share a verdict.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerlab.llm.common import (
    LAST_ID,
    MIX,
    ODD,
    PIECE,
    WordHashes,
    as_bytes,
    documents,
    gram_hashes,
    map_batches,
    mixed,
    numbered,
)
from layerlab.plans.materialize import via_parquet

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 32
MINIMA = 5
REMEMBERED_TEXTS = 2_000
LED_ROUNDS = 8
LEAST_YIELD = 0.1
EXACT_BELOW = 30

_SALTS = mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64) * ODD)
_FACTORS = mixed(_SALTS) | np.uint64(1)


def labelled_shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the shingles; the k-th occurrence of a shingle has a hash of its own."""
    base = gram_hashes(words, SHINGLE)
    order = np.argsort(base, kind="stable")
    ordered = base[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(base) else np.empty(0, bool)
    if new.all():
        return base
    run = np.maximum.accumulate(np.where(new, np.arange(len(base)), 0))
    number = np.empty(len(base), np.uint64)
    number[order] = np.arange(len(base)) - run
    return np.where(number > 0, mixed(base + number * ODD), base)


def sketches(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit value per hash function: its smallest shingles, in text order."""
    n, take = len(shingles), min(MINIMA, len(shingles))
    if not n:
        return np.empty(0, np.uint64)
    chosen = np.empty((SKETCHES, take), np.int64)
    step = max(1, PIECE // n)
    for k in range(0, SKETCHES, step):
        values = (shingles ^ _SALTS[k : k + step, None]) * _FACTORS[k : k + step, None]
        values ^= values >> np.uint64(29)
        values *= MIX
        chosen[k : k + step] = np.argpartition(values, take - 1, axis=1)[:, :take]
    chosen.sort(axis=1)
    picked, out = shingles[chosen], _SALTS.copy()
    for j in range(take):
        out = mixed(out * ODD + picked[:, j])
    return out


def first_shingles(shingles: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """The first n - least n + 1 of n shingles by hash, mixed; none of long texts.

    Texts of similarity `least` or more share one, for at least `least` n of the
    shingles of each are common and the first of these is followed by the others.
    """
    n = len(shingles)
    if not n or n * least >= EXACT_BELOW:
        return np.empty(0, np.uint64)
    take = n - int(np.ceil(n * least - 1e-9)) + 1
    return mixed(np.sort(shingles)[:take] + ODD)


def longest_increasing(values: list[int]) -> int:
    tails: list[int] = []
    for v in values:
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
        else:
            tails[k] = v
    return len(tails)


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two labelled shingle sequences if it is `least` or more, else 0.

    Shingles of an alignment that is good enough are off the diagonal by no more
    than the number of shingles left out, which is the width of the band.
    """
    total = len(a) + len(b)
    if not total:
        return 0.0
    need = int(np.ceil(least * total / (1 + least) - 1e-9))
    if min(len(a), len(b)) < need:
        return 0.0
    _, in_a, in_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(in_a - in_b) <= total - 2 * need
    in_a, in_b = in_a[near], in_b[near]
    if len(in_a) < need:
        return 0.0
    places = in_b[np.argsort(in_a)]
    k = len(places) if (places[1:] > places[:-1]).all() else longest_increasing(places.tolist())
    return k / (total - k) if k >= need else 0.0


def text_sketches(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc, mark, text_key, n, sketches) of every row; text_key names the word sequence.

    First shingles stand behind the sketches.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        known: dict[bytes, tuple[int, list[int]]] = {}
        for batch in batches:
            keys, found = [], []
            for text in as_bytes(batch.column("text")):
                words = text.split()
                key = xxhash.xxh3_128_digest(b" ".join(words))
                if key not in known:
                    if len(known) >= REMEMBERED_TEXTS:
                        known.clear()
                    shingles = labelled_shingles(hashes.of(words))
                    values = np.concatenate((sketches(shingles), first_shingles(shingles, least)))
                    known[key] = len(shingles), values.view(np.int64)
                keys.append(key)
                found.append(known[key])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"), batch.column("mark"), pa.array(keys, pa.binary()),
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([s for _, s in found], pa.list_(pa.int64())),
                ],
                names=["doc", "mark", "text_key", "n", "sketches"],
            )

    schema = "doc long, mark long, text_key binary, n long, sketches array<long>"
    return numbered(docs).mapInArrow(sketch, schema)


def _word_table(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(text_key, words): word hashes of the texts named by (doc, mark, text_key)."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [hashes.of(t.split()).tobytes() for t in as_bytes(batch.column("text"))]
            columns = [batch.column("text_key"), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["text_key", "words"])

    # a merge at any size: rows grow with the corpus, so a broadcast would not last
    joined = numbered(docs).join(rows.hint("merge"), ["doc", "mark"]).select("text_key", "text")
    return joined.dropDuplicates(["text_key"]).mapInArrow(words, "text_key binary, words binary")


def _links(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) with an alignment of `least` or more; b leads many pairs."""

    def verify(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.empty(0, np.uint64))
        scores = []
        for one, b, two in zip(batch.column("words_a"), batch.column("b"), batch.column("words_b")):
            if last[0] != b.as_py():
                last = b.as_py(), labelled_shingles(np.frombuffer(two.as_buffer(), np.uint64))
            own = labelled_shingles(np.frombuffer(one.as_buffer(), np.uint64))
            scores.append(aligned_similarity(own, last[1], least))
        good = pa.array([s > 0 for s in scores], pa.bool_())
        out = [batch.column("a"), batch.column("b"), pa.array(scores, pa.float64())]
        yield pa.RecordBatch.from_arrays(out, names=["a", "b", "similarity"]).filter(good)

    first = words.select(F.col("text_key").alias("a"), F.col("words").alias("words_a")).hint("merge")
    second = words.select(F.col("text_key").alias("b"), F.col("words").alias("words_b")).hint("merge")
    rows = pairs.join(first, "a").join(second, "b").select("a", "words_a", "b", "words_b")
    return map_batches(rows, verify, "a binary, b binary, similarity double")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A narrow table, written in one file for several shuffle partitions and read again.

    The rounds below make many such tables; one file for each partition would cost
    more than what is in them.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = max(2 * spark.sparkContext.defaultParallelism, partitions // 8)
    return via_parquet(df.coalesce(files), name)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes of undirected links (a, b); the root is the least node.

    Every node hooks to its least neighbour if that is smaller, chains of hooks are
    shortened by doubling, and links are drawn anew between the roots: the nodes
    that still have links at least halve with each turn.
    """
    edges = _kept(links.select("a", "b").filter("a <> b").distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = _kept(
            both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")),
            "hooks",
        )
        while True:
            next_hop = hooks.select(F.col("node").alias("root"), F.col("root").alias("far"))
            further = _kept(hooks.join(next_hop, "root").select("node", "root", "far"), "hooks")
            moved = further.filter("root <> far").limit(1).count()
            hooks = further.select("node", F.col("far").alias("root"))
            if not moved:
                break
        if roots is None:
            roots = hooks
        else:
            step = hooks.select(F.col("node").alias("root"), F.col("root").alias("far"))
            moved_roots = roots.join(step, "root", "left").select("node", F.coalesce("far", "root").alias("root"))
            roots = _kept(moved_roots, "roots")
        for side in ("a", "b"):
            to = hooks.select(F.col("node").alias(side), F.col("root").alias("to"))
            edges = edges.join(to, side).drop(side).withColumnRenamed("to", side)
        edges = _kept(edges.filter("a <> b").distinct(), "edges")
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    return roots


def prefix_pairs(texts: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of `texts` (text_key, n, root) that may have `least` or more.

    Exact for texts of different roots. Shingles are ordered from rare to frequent.
    The first shingle that two similar texts of n >= m share is among the first
    n - least n + 1 of the one and the first m - 2 least / (1 + least) m + 1 of the
    other, for so many must follow it. In each group of texts that share a shingle
    there, texts of the most frequent root are not paired with each other.
    """

    def exploded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for k, words_of in enumerate(batch.column("words")):
            own = labelled_shingles(np.frombuffer(words_of.as_buffer(), np.uint64))
            held.append((k, own))
            size += len(own)
            if size >= PIECE or k == len(batch) - 1:
                at = pa.array(np.repeat([j for j, _ in held], [len(x) for _, x in held]))
                columns = [batch.column(c).take(at) for c in ("text_key", "n", "root")]
                shingle = pa.array(np.concatenate([x for _, x in held]).view(np.int64))
                yield pa.RecordBatch.from_arrays([*columns, shingle], names=["text_key", "n", "root", "shingle"])
                held, size = [], 0

    rows = texts.join(words.hint("merge"), "text_key").select("text_key", "n", "root", "words")
    shingles = via_parquet(map_batches(rows, exploded, "text_key binary, n long, root binary, shingle long"), "shingles")
    # a shingle of one root only pairs nobody; such shingles come first in the order
    shared = (
        shingles.groupBy("shingle")
        .agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("r"), F.max("root").alias("s"))
        .filter("r <> s")
        .select("shingle", "df")
    )
    own = Window.partitionBy("text_key")
    place = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "shingle"))
    beyond = lambda share: F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1
    entries = (
        shingles.join(shared.hint("merge"), "shingle")
        .withColumn("place", place)
        .filter(F.col("place") <= beyond(least))
        .withColumn("short", F.col("place") <= beyond(2 * least / (1 + least)))
        .drop("df")
    )
    entries = _kept(entries, "prefixes")
    by_root = entries.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("texts"))
    major = by_root.groupBy("shingle").agg(F.max_by("root", F.struct("texts", "root")).alias("major"))
    one = (
        entries.join(major.hint("merge"), "shingle")
        .filter("root <> major")
        .select("shingle", *(F.col(c).alias(f"{c}_b") for c in ("text_key", "n", "root", "short", "place")))
    )
    # of the first shingle that two texts share, no more than those after it can follow
    after = 1 + F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b"))
    enough = after >= F.ceil((F.col("n") + F.col("n_b")) * (least / (1 + least)) - 1e-9)
    shorter = F.struct("n", "text_key") < F.struct(F.col("n_b").alias("n"), F.col("text_key_b").alias("text_key"))
    return (
        entries.join(one.hint("merge"), "shingle")
        .filter((F.col("root") != F.col("root_b")) & (F.least("n", "n_b") >= F.greatest("n", "n_b") * least))
        .filter(enough & F.when(shorter, F.col("short")).otherwise(F.col("short_b")))
        .select(F.least("text_key", "text_key_b").alias("a"), F.greatest("text_key", "text_key_b").alias("b"))
        .distinct()
    )


def _alike(least: float) -> Column:
    """Whether n and top_n shingles are near enough for a similarity of `least`."""
    return F.least("n", "top_n") >= F.greatest("n", "top_n") * least


def _named(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of sketch groups with the root of each text, its own key where it has no link."""
    rows = members.select("sketch", "text_key", "n", "weight")
    named = rows.join(roots.withColumnRenamed("node", "text_key"), "text_key", "left")
    return named.withColumn("root", F.coalesce("root", "text_key"))


def text_links(
    docs: DataFrame, rows: DataFrame, least: float = SIMILARITY
) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, similarity) between word sequences and their components, or none.

    `rows` as from text_sketches.
    """
    texts = rows.groupBy("text_key").agg(
        F.min(F.struct("doc", "mark")).alias("row"), F.first("n").alias("n"), F.first("sketches").alias("sketches")
    )
    groups = texts.select("text_key", "n", "row", F.explode("sketches").alias("sketch"))
    shared = groups.groupBy("sketch").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    active = via_parquet(groups.join(shared.hint("merge"), "sketch"), "sketch-groups")
    weight = active.groupBy("text_key").agg(
        F.sum("size").alias("weight"),
        F.max(F.struct("size", "sketch"))["sketch"].alias("home"),
        F.first("row").alias("row"),
        F.first("n").alias("n"),
    )
    weight = _kept(weight, "text-weights")
    words = via_parquet(_word_table(docs, weight.select("row.*", "text_key")), "words")
    active = via_parquet(
        active.join(weight.select("text_key", "weight"), "text_key").select("sketch", "text_key", "n", "weight"),
        "sketch-groups",
    )
    rank = F.struct("weight", "text_key")
    # at first each text follows in its largest group only, which settles most of the others
    heads = active.groupBy("sketch").agg(F.max_by("text_key", rank).alias("b"), F.max_by("n", rank).alias("top_n"))
    homes = weight.select(F.col("home").alias("sketch"), F.col("text_key").alias("a"), "n")
    first = homes.join(heads, "sketch").filter((F.col("a") != F.col("b")) & _alike(least)).select("a", "b")
    found = _kept(_links(_kept(first, "pairs"), words, least), "links")
    roots = components(found)
    active = _kept(_named(active, roots), "sketch-groups")
    # a group whose texts all have one root is settled: it gets no leader
    several_roots = F.min("root").alias("first_root"), F.max("root").alias("last_root")
    for _ in range(LED_ROUNDS):
        leaders = (
            active.groupBy("sketch")
            .agg(
                F.max(rank).alias("top"),
                F.max_by("root", rank).alias("top_root"),
                F.max_by("n", rank).alias("top_n"),
                *several_roots,
            )
            .filter("first_root <> last_root")
            .select("sketch", F.col("top.text_key").alias("b"), "top_root", "top_n")
        )
        leaders = _kept(leaders, "leaders")
        if leaders.isEmpty():
            return found, roots
        # each member beside its leader; the leaders themselves have been in their last round
        led = _kept(active.join(leaders, "sketch").filter("text_key <> b"), "led")
        pairs = (
            led.filter((F.col("root") != F.col("top_root")) & _alike(least))
            .select(F.col("text_key").alias("a"), "b")
            .distinct()
        )
        pairs = _kept(pairs, "pairs")
        new = _kept(_links(pairs, words, least), "links")
        n_new = new.count()
        if n_new:
            found = found.unionByName(new)
            roots = components(found)
        active = _kept(_named(led, roots), "sketch-groups")
        if n_new < LEAST_YIELD * pairs.count():
            break
    several = active.groupBy("sketch").agg(*several_roots).filter("first_root <> last_root").select("sketch")
    active = _kept(active.join(several, "sketch", "left_semi"), "sketch-groups")
    if active.isEmpty():
        return found, roots
    left = active.groupBy("text_key").agg(F.first("n").alias("n"), F.first("root").alias("root"))
    new = _kept(_links(_kept(prefix_pairs(left, words, least), "pairs"), words, least), "links")
    found = found.unionByName(new)
    return found, components(found)


def near_duplicates(
    docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, mark, class_id, class_size, n_links, kept) for every row.

    n_links counts the links found to other word sequences; class_size counts rows.
    """
    docs = documents(docs, id_col, text_col)
    rows = via_parquet(text_sketches(docs, least), "sketches")
    links, roots = text_links(docs, rows, least)
    ends = links.select(F.col("a").alias("text_key"), "b").unionByName(
        links.select(F.col("b").alias("text_key"), F.col("a").alias("b"))
    )
    degree = ends.groupBy("text_key").agg(F.countDistinct("b").alias("n_links"))
    texts = rows.groupBy("text_key").agg(F.min(F.struct("doc", "mark", "text_key")).alias("first"), F.count(F.lit(1)).alias("copies"))
    named = texts.join(roots.withColumnRenamed("node", "text_key"), "text_key", "left").join(degree, "text_key", "left")
    named = _kept(named.withColumn("root", F.coalesce("root", "text_key")), "classed-texts")
    classes = named.groupBy("root").agg(F.min("first").alias("first_row"), F.sum("copies").alias("class_size"))
    classes = _kept(classes, "classes")
    verdicts = named.join(classes, "root").select(
        "text_key", "first_row", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    verdicts = _kept(verdicts, "verdicts")
    known = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return rows.select("doc", "mark", "text_key").join(verdicts, "text_key").select(
        known("doc").alias("doc_id"),
        "mark",
        known("first_row.doc").alias("class_id"),
        "class_size",
        "n_links",
        (F.struct("doc", "mark", "text_key") == F.col("first_row")).alias("kept"),
    )
