"""12. Centroid clustering by progressive search in Walsh-Hadamard space.

A component x becomes the integer floor(1024 x). The transform of a vector is its
product with the 64 x 64 Walsh-Hadamard matrix, made of integer sums only; squared
distances of transforms are 64 times those of the vectors, exactly. Transforms are
written once. A round compares them with the transformed centroids coarse to fine:
coefficients in the order of their sequency, a block at a time. The nearest centroid
by the first block is measured in full; others leave as soon as what has been
accumulated is strictly more than the best full distance; all that stay are finished
to the 64th coefficient. Ties go to the smaller number.

Tasks return sums and counts by cluster, of which `CLUSTERS` rows are left after the
aggregate. The driver holds the centroids only; each new one is the exact floor of
its mean, from the inverse transform of the sums.

Defined results: vectors of another length, or with a null or non-finite component,
are left out. Components are held between -2^24 and 2^24 (16,384 as a float), so that
all distances fit 64 bits. Repeated rows count each. A vector without an id is
assigned, but does not start a centroid. Fewer vectors than clusters start as many
centroids as there are vectors with ids; without any, and for an empty table, no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlab.llm.common import map_batches
from layerlab.plans.materialize import via_parquet

WIDTH = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
BOUND = 1 << 24
ROWS_AT_ONCE = 1 << 14
BLOCKS = (0, 4, 8, 16, 32, 64)  # coefficients that a step of the search adds


def hadamard(values: np.ndarray) -> np.ndarray:
    """Rows times the Walsh-Hadamard matrix in natural order, by butterflies."""
    out = values.astype(np.int64)
    step = 1
    while step < out.shape[1]:
        pairs = out.reshape(len(out), -1, 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
        out = out.reshape(len(values), -1)
        step *= 2
    return out


def _sequency_order(width: int) -> np.ndarray:
    """Rows of the matrix by their number of sign changes: coarse to fine."""
    signs = hadamard(np.eye(width, dtype=np.int64))
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1), kind="stable")


ORDER = _sequency_order(WIDTH)


def transform(values: np.ndarray) -> np.ndarray:
    return hadamard(values)[:, ORDER]


def transform_sums_back(coefficients: list[int]) -> list[int]:
    """Sums of components from sums of coefficients; exact for any size."""
    natural = [0] * WIDTH
    for k, c in zip(ORDER.tolist(), coefficients):
        natural[k] = int(c)
    signs = hadamard(np.eye(WIDTH, dtype=np.int64)).tolist()
    return [sum(s * c for s, c in zip(row, natural)) // WIDTH for row in signs]


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid; transforms throughout."""
    n, k = len(rows), len(centroids)
    never = np.iinfo(np.int64).max

    def added(r: np.ndarray, c: np.ndarray, a: int, b: int) -> np.ndarray:
        gap = rows[r, a:b] - centroids[c, a:b]
        return np.einsum("ij,ij->i", gap, gap)

    first = rows[:, None, : BLOCKS[1]] - centroids[None, :, : BLOCKS[1]]
    partial = np.einsum("ijk,ijk->ij", first, first)
    guess = partial.argmin(axis=1)
    every = np.arange(n)
    best = partial[every, guess] + added(every, guess, BLOCKS[1], WIDTH)
    whole = np.full((n, k), never)
    whole[every, guess] = best
    partial[every, guess] = never  # measured already
    r, c = np.nonzero(partial <= best[:, None])
    gone = partial[r, c]
    for a, b in zip(BLOCKS[1:], BLOCKS[2:]):
        gone = gone + added(r, c, a, b)
        stays = gone <= best[r]
        r, c, gone = r[stays], c[stays], gone[stays]
    whole[r, c] = gone
    number = whole.argmin(axis=1)  # the first of equal ones
    return number, whole[every, number] // WIDTH


def _matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), WIDTH)


def _listed(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1), kind))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors of WIDTH finite components as integers, held within BOUND."""
    x = F.col(vector_col)
    whole = (F.size(x) == WIDTH) & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf"))
    )

    def scaled(e):
        floor = F.floor(F.greatest(F.least(e.cast("double"), F.lit(BOUND / SCALE)), F.lit(-BOUND / SCALE)) * SCALE)
        return floor.cast("int")

    return vectors.filter(whole).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, scaled).alias("v")
    )


def transformed(vectors: DataFrame) -> DataFrame:
    """(vec_id, w): the transforms of `usable`, which fit 32 bits."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(k, ROWS_AT_ONCE)
            values = transform(_matrix(part.column(1))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), _listed(values, pa.int32())], names=["vec_id", "w"]
            )

    return map_batches(vectors, work, "vec_id long, w array<int>")


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The `k` vectors with the smallest SHA-256 of `seed:vec_id`, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [list(r.v) for r in vectors.filter("vec_id IS NOT NULL").orderBy(h, "v").limit(k).collect()]


@dataclass(frozen=True)
class Clustering:
    """Rows (vec_id, cluster, distance) and the integer centroids they were assigned to."""

    rows: DataFrame
    centroids: list[list[int]]


def cluster_sums(vectors: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """{cluster: (count, exact sums of components)} of the non-empty clusters."""
    places = transform(np.array(centroids, np.int64))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(places), np.int64), np.zeros((len(places), WIDTH), np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                w = _matrix(batch.column(0).slice(k, ROWS_AT_ONCE)).astype(np.int64)
                number, _ = nearest(w, places)
                for c in np.unique(number):
                    mine = number == c
                    counts[c] += mine.sum()
                    sums[c] += w[mine].sum(axis=0)
        used = np.flatnonzero(counts)
        if len(used):
            # the count stands behind the sums
            values = np.concatenate([sums[used], counts[used, None]], axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(used, WIDTH + 1).astype(np.int32)),
                    pa.array(np.tile(np.arange(WIDTH + 1, dtype=np.int32), len(used))),
                    pa.array(values.reshape(-1)),
                ],
                names=["cluster", "place", "part"],
            )

    parts = vectors.select("w").mapInArrow(work, "cluster int, place int, part long")
    # a task's sums fit 64 bits, those of all tasks may not
    total = F.sum(F.col("part").cast("decimal(20,0)")).alias("total")
    found: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "place").agg(total).collect():  # CLUSTERS x 65 rows at most
        found.setdefault(r.cluster, [0] * (WIDTH + 1))[r.place] = int(r.total)
    return {c: (v[WIDTH], transform_sums_back(v[:WIDTH])) for c, v in found.items()}


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of each row."""
    places = transform(np.array(centroids, np.int64))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(k, ROWS_AT_ONCE)
            number, distance = nearest(_matrix(part.column(1)).astype(np.int64), places)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(number.astype(np.int32)), pa.array(distance)],
                names=["vec_id", "cluster", "distance"],
            )

    return map_batches(vectors, work, "vec_id long, cluster int, distance long")


def cluster(
    vectors: DataFrame,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> Clustering:
    """Exact integer k-means of `rounds` rounds, then one more assignment."""
    plain = usable(vectors, id_col, vector_col)
    centroids = first_centroids(plain, k, seed)
    table = via_parquet(transformed(plain), "hadamard")
    if not centroids:
        empty = table.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return Clustering(empty, [])
    for _ in range(rounds):
        for c, (n, sums) in cluster_sums(table, centroids).items():
            centroids[c] = [s // n for s in sums]
    return Clustering(via_parquet(assigned(table, centroids), "clusters"), centroids)


def with_inertia(found: Clustering) -> DataFrame:
    """Rows with the inertia of their cluster and of all, and their centroid's digest."""
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    by_cluster = found.rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertia = {r.cluster: r.cluster_inertia for r in by_cluster.collect()}  # one row a centroid
    per = F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(len(digests))] or [F.lit(0)])
    texts = F.array(*map(F.lit, digests or [""]))
    return found.rows.select(
        "vec_id",
        "cluster",
        "distance",
        F.element_at(per, F.col("cluster") + 1).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        F.element_at(texts, F.col("cluster") + 1).alias("centroid_sha256"),
    )
