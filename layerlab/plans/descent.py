"""Many linear heads trained at once: one pass over the rows an epoch, for all of them.

A head is a linear classifier with its own loss, learning rate and weight decay. All
heads of all layers share each pass: a task multiplies its blocks of vectors, dealt once
and kept, with the stacked weights of their layer, and returns sums of losses and
gradients, which Spark adds up. The driver holds the weights and makes the AdamW step, so an epoch is a
full-batch step and does not depend on how rows are dealt; batch size and dropout have
no counterpart. The passes of a whole tuning grid are as many as its longest trial's
epochs, not epochs times trials.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA, GAMMA = 0.25, 2.0  # of the focal loss
FLAT = 700.0  # e^700 is a number; log(1 + e^z) is z from there on
BETAS, EPSILON = (0.9, 0.999), 1e-8
ROWS_AT_ONCE, ROWS_IN_CACHE = 1 << 12, 1 << 9
COLLECTED = 32  # partials of a pass that the driver takes without a round between
LOG = "layer int, head int, epoch int, train_loss double, val_loss double, val_accuracy double, best boolean"


@dataclass(frozen=True)
class Head:
    """ce, focal or hinge for one class a row; bce or focal for many labels a row."""

    loss: str
    learning_rate: float = 1e-3
    weight_decay: float = 0.0


# In these `axis` is that of the classes: the last one, or the first one, where whole
# rows of numbers are added up and compared at once.


def cross_entropy(z: np.ndarray, bits: np.ndarray, axis: int = -1) -> tuple[np.ndarray, np.ndarray]:
    shifted = z - z.max(axis=axis, keepdims=True)
    own = (shifted * bits).sum(axis=axis)
    slope = np.exp(shifted, out=shifted)
    total = slope.sum(axis=axis, keepdims=True)
    slope /= total
    slope -= bits
    return np.log(total.squeeze(axis)) - own, slope


def _sides(z: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By element the probability of the wrong value, that of the right one, and minus its logarithm."""
    against = z * (1 - 2 * bits)
    wrong = np.exp(np.minimum(against, FLAT))
    total = wrong + 1
    bce = np.log(total)
    right = np.reciprocal(total, out=total)
    wrong *= right
    return wrong, right, np.maximum(bce, against, out=bce)


def binary_cross_entropy(z: np.ndarray, bits: np.ndarray, axis: int = -1) -> tuple[np.ndarray, np.ndarray]:
    wrong, _, bce = _sides(z, bits)
    wrong *= (1 - 2 * bits) / z.shape[axis]
    return bce.mean(axis=axis), wrong


def focal(z: np.ndarray, bits: np.ndarray, axis: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """alpha (1 - e^-bce)^gamma bce by element; its slope is a weight times that of bce."""
    wrong, right, bce = _sides(z, bits)
    right *= bce
    right *= GAMMA
    right += wrong
    bce *= wrong**GAMMA
    wrong **= GAMMA  # once by its weight, once by the slope of bce
    right *= wrong
    right *= (1 - 2 * bits) * (ALPHA / z.shape[axis])
    return ALPHA * bce.mean(axis=axis), right


def multi_margin(z: np.ndarray, bits: np.ndarray, axis: int = -1) -> tuple[np.ndarray, np.ndarray]:
    classes = z.shape[axis]
    gap = z + (1 - (z * bits).sum(axis=axis, keepdims=True))
    gap *= 1 - bits
    over = (gap > 0).astype(float)
    loss = np.maximum(gap, 0, out=gap).sum(axis=axis) / classes
    over -= bits * over.sum(axis=axis, keepdims=True)
    over /= classes
    return loss, over


#: by (loss, many labels): gives (loss by row and head, slope by row, head and class)
LOSSES: dict[tuple[str, bool], Callable] = {
    ("ce", False): cross_entropy,
    ("focal", False): focal,
    ("hinge", False): multi_margin,
    ("bce", True): binary_cross_entropy,
    ("focal", True): focal,
}


@dataclass
class Weights:
    """Of all heads of a layer: w (width, heads, classes), b (heads, classes)."""

    w: np.ndarray
    b: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tensordot(x, self.w, axes=1) + self.b

    def copy(self) -> Weights:
        return Weights(self.w.copy(), self.b.copy())


@dataclass
class Trained:
    """Log of all epochs, weights after the asked epochs, weights of the best epoch."""

    heads: list[Head]
    log: DataFrame
    after: dict[int, dict[int, Weights]]
    best: dict[int, Weights] = field(default_factory=dict)


def matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def target_bits(classes: int, labels: str | None = None) -> Column:
    """One-hot of `label`, or the bits of the list column `labels`."""
    ids = F.sequence(F.lit(0), F.lit(classes - 1))
    if labels is None:
        return F.transform(ids, lambda i: (i == F.col("label")).cast("double"))
    return F.transform(ids, lambda i: F.coalesce(F.array_contains(labels, i), F.lit(False)).cast("double"))


def by_layer(batch: pa.RecordBatch, layers: np.ndarray) -> Iterator[tuple[int, pa.RecordBatch]]:
    for layer in np.unique(layers):
        rows = batch.filter(pa.array(layers == layer))
        for k in range(0, rows.num_rows, ROWS_AT_ONCE):
            yield int(layer), rows.slice(k, ROWS_AT_ONCE)


def _right(z: np.ndarray, bits: np.ndarray, many: bool) -> np.ndarray:
    """Rows whose class, or whose every bit, is predicted, by head; classes come first."""
    if many:
        return ((z > 0) == (bits > 0.5)).all(axis=0)
    return np.take_along_axis(np.broadcast_to(bits, z.shape), z.argmax(axis=0)[None], axis=0)[0] > 0.5


def deal(rows: DataFrame, layers: Sequence[int]) -> RDD:
    """(layer, train, bits, vec) as blocks of rows, kept over the passes; all cores get as many.

    A partition has one layer, so that a task returns the sums of that one.
    """
    layers = sorted(layers)
    each = -(-rows.sparkSession.sparkContext.defaultParallelism // max(1, len(layers)))
    at = F.array_position(F.array(*[F.lit(k) for k in layers]), F.col("layer")) - 1
    part = (at * each + F.monotonically_increasing_id() % each).cast("int")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for layer, some in by_layer(batch, np.asarray(batch.column("layer"))):
                train = np.asarray(some.column("train").to_numpy(zero_copy_only=False))
                found = [train.tobytes(), matrix(some.column("bits")).tobytes(), matrix(some.column("vec")).tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([layer], pa.int32()), *[pa.array([x], pa.binary()) for x in found]],
                    names=["layer", "train", "bits", "vec"],
                )

    def block(row) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        train = np.frombuffer(row.train, bool)
        return row.layer, train, *[np.frombuffer(x).reshape(len(train), -1) for x in (row.bits, row.vec)]

    dealt = rows.repartitionById(max(1, len(layers)) * each, part).select("layer", "train", "bits", "vec")
    blocks = dealt.mapInArrow(work, "layer int, train binary, bits binary, vec binary")
    return blocks.rdd.map(block).persist(StorageLevel.MEMORY_AND_DISK)


def summed(parts: RDD) -> dict[int, np.ndarray]:
    """{layer: sums} of one such dict a partition."""

    def add(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        return a | {k: a[k] + v if k in a else v for k, v in b.items()}

    # few partials go to the driver at once; many are added up between the tasks first
    return parts.treeReduce(add, 1 if parts.getNumPartitions() <= COLLECTED else 2)


def _sums(
    here: Weights, losses: Sequence[Callable], x: np.ndarray, bits: np.ndarray, x_val: np.ndarray, bits_val: np.ndarray, many: bool
) -> np.ndarray:
    """Gradient of w and b, losses and right rows by head, row counts, over a block of one layer.

    Few rows at a time, as (classes, heads, rows), so that the numbers at work stay in the cache.
    """
    width, n, classes = here.w.shape
    grad_w, grad_b, train, val, right = np.zeros(here.w.shape), np.zeros(here.b.shape), *np.zeros((3, n))
    for fn in set(losses):
        mine = [k for k, f in enumerate(losses) if f is fn]
        w = np.ascontiguousarray(here.w[:, mine].transpose(2, 1, 0)).reshape(-1, width)
        b = here.b[mine].T.reshape(-1, 1)
        for rows, want, learned in ((x, bits, True), (x_val, bits_val, False)):
            for at in range(0, len(rows), ROWS_IN_CACHE):
                some, bit = rows[at : at + ROWS_IN_CACHE], np.ascontiguousarray(want[at : at + ROWS_IN_CACHE].T)[:, None]
                z = w @ some.T
                z += b
                z = z.reshape(classes, len(mine), -1)
                loss, slope = fn(z, bit, axis=0)
                if learned:
                    train[mine] += loss.sum(axis=1)
                    flat = slope.reshape(len(w), -1)
                    grad_w[:, mine] += (flat @ some).reshape(classes, len(mine), width).transpose(2, 1, 0)
                    grad_b[mine] += slope.sum(axis=2).T
                else:
                    val[mine] += loss.sum(axis=1)
                    right[mine] += _right(z, bit, many).sum(axis=1)
    return np.concatenate([grad_w.reshape(-1), grad_b.reshape(-1), train, val, right, [len(x), len(x_val)]])


def _pass(blocks: RDD, weights: dict[int, Weights], heads: Sequence[Head], many: bool) -> dict[int, np.ndarray]:
    """{layer: gradient of w and b, losses and right rows by head, row counts}, summed over all rows."""
    losses = [LOSSES[h.loss, many] for h in heads]
    shared = blocks.context.broadcast(weights)

    def work(rows: Iterator[tuple]) -> Iterator[dict[int, np.ndarray]]:
        sums: dict[int, np.ndarray] = {}
        for layer, train, bits, x in rows:
            here = shared.value[layer]
            found = _sums(here, losses, x[train], bits[train], x[~train], bits[~train], many)
            sums[layer] = sums.get(layer, 0) + found
        yield sums

    try:
        return summed(blocks.mapPartitions(work))
    finally:
        shared.destroy()


def train_heads(
    table: DataFrame,
    widths: dict[int, int],
    classes: int,
    heads: Sequence[Head],
    epochs: int,
    asked: Sequence[int] = (),
    patience: int | None = None,
    labels: str | None = None,
) -> Trained:
    """Train every head on every layer of `table` (layer, split, label, vec).

    `widths` are the layers with the width of their vectors. The log has the losses
    and the validation accuracy (all bits right, for many labels) after 0, 1, ...
    `epochs` steps; rows of the split `train` are learned, all others validate. With
    `patience`, a head stops after so many epochs without a lower validation loss.
    The best epoch is the first with the highest validation accuracy above 0.
    """
    many = labels is not None
    for h in heads:
        if (h.loss, many) not in LOSSES:
            raise ValueError(f"loss {h.loss!r} is not defined for {'many labels' if many else 'one class'} a row")
    heads = list(heads)
    rows = table.select(
        F.col("layer").cast("int"), (F.col("split") == "train").alias("train"), target_bits(classes, labels).alias("bits"), "vec"
    )
    blocks = deal(rows, list(widths))
    shape = len(heads), classes
    weights = {k: Weights(np.zeros((n, *shape)), np.zeros(shape)) for k, n in widths.items()}
    moments = {k: [np.zeros_like(a) for a in (v.w, v.b, v.w, v.b)] for k, v in weights.items()}
    rate = np.array([h.learning_rate for h in heads])[:, None]
    decay = np.array([h.weight_decay for h in heads])[:, None]
    going = {k: np.ones(len(heads), bool) for k in widths}
    lowest = {k: np.full(len(heads), np.inf) for k in widths}
    waited = {k: np.zeros(len(heads), int) for k in widths}
    highest = {k: np.zeros(len(heads)) for k in widths}
    best, best_epoch = {k: v.copy() for k, v in weights.items()}, {}
    log, after = [], {}
    for epoch in range(epochs + 1):
        sums = _pass(blocks, weights, heads, many)
        for k, here in weights.items():
            cuts = np.cumsum([here.w.size, here.b.size, *[len(heads)] * 3])
            grad_w, grad_b, train, val, right, counts = np.split(sums[k], cuts)
            n_train, n_val = np.maximum(counts, 1)
            train, val, right = train / n_train, val / n_val, right / n_val
            for i in np.flatnonzero(going[k]):
                log.append([k, int(i), epoch, float(train[i]), float(val[i]), float(right[i])])
                if right[i] > highest[k][i]:
                    highest[k][i], best_epoch[k, int(i)] = right[i], epoch
                    best[k].w[:, i], best[k].b[i] = here.w[:, i], here.b[i]
            lower = val < lowest[k]
            waited[k] = np.where(lower, 0, waited[k] + 1)
            lowest[k] = np.minimum(lowest[k], val)
            if patience is not None:
                going[k] &= waited[k] < patience
            if epoch in asked:
                after.setdefault(epoch, {})[k] = here.copy()
            step = epoch + 1
            for at, (value, slope) in enumerate(((here.w, grad_w.reshape(here.w.shape)), (here.b, grad_b.reshape(here.b.shape)))):
                slope = slope / n_train
                first, second = moments[k][at], moments[k][at + 2]
                first += (1 - BETAS[0]) * (slope - first)
                second += (1 - BETAS[1]) * (slope**2 - second)
                move = first / (1 - BETAS[0] ** step) / (np.sqrt(second / (1 - BETAS[1] ** step)) + EPSILON)
                value -= np.where(going[k][:, None], rate * (move + decay * value), 0)
        if not any(g.any() for g in going.values()):
            break
    blocks.unpersist()
    marked = [(*x, best_epoch.get((x[0], x[1])) == x[2]) for x in log]
    return Trained(heads, table.sparkSession.createDataFrame(marked, LOG), after, best)


def predict(table: DataFrame, weights: dict[int, Weights], classes: int, labels: str | None = None) -> DataFrame:
    """(layer, head, split, sample_id, y or bits, yhat or pred, logits) of every row and head."""
    n = next(iter(weights.values())).b.shape[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for layer, part in by_layer(batch, np.asarray(batch.column("layer"))):
                z = weights[layer].logits(matrix(part.column("vec"))).transpose(1, 0, 2)
                for k in range(n):
                    offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * classes)
                    logits = pa.ListArray.from_arrays(offsets, pa.array(z[k].reshape(-1)))
                    kept = [part.column(c) for c in ("layer", "split", "sample_id", "label", "bits")]
                    yield pa.RecordBatch.from_arrays(
                        [*kept, pa.array(np.full(part.num_rows, k, np.int32)), logits],
                        names=["layer", "split", "sample_id", "label", "bits", "head", "logits"],
                    )

    rows = table.select(
        F.col("layer").cast("int"), "split", F.col("sample_id").cast("long"), F.col("label").cast("int"),
        target_bits(classes, labels).alias("bits"), "vec",
    )
    schema = "layer int, split string, sample_id long, label int, bits array<double>, head int, logits array<double>"
    out = rows.mapInArrow(work, schema)
    if labels is None:
        top = F.array_position("logits", F.array_max("logits")) - 1
        seen = [F.col("label").alias("y"), top.cast("int").alias("yhat")]
    else:
        seen = [
            F.transform("bits", lambda x: x.cast("int")).alias("bits"),
            F.transform("logits", lambda x: (x > 0).cast("int")).alias("pred"),
        ]
    return out.select("layer", "head", "split", "sample_id", *seen, "logits")
