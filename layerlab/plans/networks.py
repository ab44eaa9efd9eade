"""Feed-forward networks of all layers fitted at once: one pass over the rows an evaluation.

A network has sigmoid units and a softmax over the classes; L-BFGS lowers the plain
mean cross-entropy of the training rows. The rows lie in blocks over the cores
(plans.descent); a task sums losses and gradients of its blocks, Spark adds them up, and
the driver makes the step. A pass serves the networks of all layers that still go on, so
that the cores are busy whatever the number of layers or files.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Generator, Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlab.plans.descent import by_layer, cross_entropy, deal, matrix, summed, target_bits

if TYPE_CHECKING:
    from layerlab.plans.probes import ProbeData

MEMORY, SEARCH_STEPS, VALUES_KEPT = 10, 20, 20  # steps that L-BFGS remembers; trials of a step; values compared
ROWS_AT_ONCE = 1 << 9
Evaluation = Generator[np.ndarray, tuple[float, np.ndarray], object]


def initial_weights(sizes: Sequence[int], seed: int) -> np.ndarray:
    """Weights and intercepts of each layer, uniform within 2.4 / sqrt(inputs)."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-2.4, 2.4, a * b + b) / np.sqrt(a) for a, b in zip(sizes, sizes[1:])])


def _parts(flat: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _forward(
    x: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], into: Sequence[np.ndarray | None] | None = None
) -> list[np.ndarray]:
    """The rows, the units of each hidden layer, and the logits; `into` are arrays for the last two."""
    out = [x]
    for i, (w, b) in enumerate(parts):
        z = np.matmul(out[-1], w, out=into[i] if into else None)
        z += b
        if i < len(parts) - 1:
            with np.errstate(over="ignore"):  # exp(-z) = inf is a unit of 0
                np.exp(np.negative(z, out=z), out=z)
            z += 1
            np.reciprocal(z, out=z)
        out.append(z)
    return out


def loss_and_slope(flat: np.ndarray, sizes: Sequence[int], x: np.ndarray, bits: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over the rows, in the precision of the weights."""
    parts, total = _parts(flat, sizes), np.zeros(len(flat))
    sums, loss = _parts(total, sizes), 0.0
    # all blocks of rows are worked on in the same arrays, so that they stay in the cache
    all_units, all_slopes = [[np.empty((min(ROWS_AT_ONCE, len(x)), n), flat.dtype) for n in sizes] for _ in range(2)]
    products = [np.empty_like(w) for w, _ in parts]
    for at in range(0, len(x), ROWS_AT_ONCE):
        want = bits[at : at + ROWS_AT_ONCE]
        units, slopes = [[a[: len(want)] for a in arrays] for arrays in (all_units, all_slopes)]
        units[0][:] = x[at : at + ROWS_AT_ONCE]
        _forward(units[0], parts, units[1:])
        by_row, slopes[-1][:] = cross_entropy(units[-1].astype(float), want)
        loss += by_row.sum()
        for i in range(len(parts) - 1, -1, -1):
            sums[i][0][:] += np.matmul(units[i].T, slopes[i + 1], out=products[i])
            sums[i][1][:] += slopes[i + 1].sum(axis=0)
            if i:
                np.matmul(slopes[i + 1], parts[i][0].T, out=slopes[i])
                slopes[i] *= units[i]
                slopes[i] *= np.subtract(1, units[i], out=units[i])
    return loss, total


def _pass(blocks: RDD, weights: dict[int, np.ndarray], sizes: dict[int, Sequence[int]]) -> dict[int, np.ndarray]:
    """{layer: gradient, and the loss at its end}, summed over all blocks."""
    shared = blocks.context.broadcast((weights, sizes))

    def work(rows: Iterator[tuple]) -> Iterator[dict[int, np.ndarray]]:
        flat, shape = shared.value
        sums: dict[int, np.ndarray] = {}
        for layer, _, bits, x in rows:
            if layer in flat:
                loss, slope = loss_and_slope(flat[layer], shape[layer], x, bits)
                sums[layer] = sums.get(layer, 0) + np.append(slope, loss)
        yield sums

    try:
        return summed(blocks.mapPartitions(work))
    finally:
        shared.destroy()


def _direction(slope: np.ndarray, steps: Sequence[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    out, shares = -slope, []
    for move, change, scale in reversed(steps):
        shares.append(scale * (move @ out))
        out -= shares[-1] * change
    if steps:
        move, change, scale = steps[-1]
        out /= scale * (change @ change)
    for (move, change, scale), share in zip(steps, reversed(shares)):
        out += (share - scale * (change @ out)) * move
    return out


def _search(at: np.ndarray, value: float, along: np.ndarray, fall: float, length: float) -> Evaluation:
    """A length with a lower value and a flatter slope: (length, value, slope); None if there is no lower value."""
    low, high, best = (0.0, value, fall), None, None
    for _ in range(SEARCH_STEPS):
        here, slope = yield at + length * along
        rise = float(slope @ along)
        if not np.isfinite(here) or here > value + 1e-4 * length * fall:
            high = (length, here, None)
        else:
            if best is None or here < best[1]:
                best = (length, here, slope)
            if abs(rise) <= 0.9 * abs(fall):
                return length, here, slope
            if rise > 0:
                high = (length, here, rise)
            else:
                low = (length, here, rise)
        if high is None:
            length *= 4
            continue
        width = high[0] - low[0]
        if not np.isfinite(high[1]):
            share = 0.1
        elif high[2] is not None:
            share = low[2] / (low[2] - high[2])
        else:
            curve = high[1] - low[1] - low[2] * width
            share = -low[2] * width / (2 * curve) if curve > 0 else 0.5
        length = low[0] + width * min(max(share, 0.1), 0.9)
    return best


def lbfgs(at: np.ndarray, max_iter: int, tol: float = 1e-6, seen: list[float] | None = None) -> Evaluation:
    """Asks for (value, slope) at the points that it yields; returns the last point.

    `seen` is filled with the value at the start and after each step.
    """
    value, slope = yield at
    steps: deque = deque(maxlen=MEMORY)
    seen = [] if seen is None else seen
    seen.append(value)
    for _ in range(max_iter):
        size = float(np.linalg.norm(slope))
        if not np.isfinite(value) or size <= max(tol * abs(value), 1e-8):
            break
        along = _direction(slope, steps)
        if not slope @ along < 0:
            steps.clear()
            along = -slope
        found = yield from _search(at, value, along, float(slope @ along), 1.0 if steps else min(1.0, 1 / size))
        if found is None:
            if not steps:
                break
            steps.clear()  # once more along the slope
            continue
        length, value, new = found
        move, change = length * along, new - slope
        if move @ change > 0:
            steps.append((move, change, 1.0 / float(move @ change)))
        at, slope = at + move, new
        seen.append(value)
        if len(seen) > VALUES_KEPT and max(seen[-VALUES_KEPT:]) - value <= tol * abs(seen[0]):
            break
    return at


def _in_turn(at: np.ndarray, max_iter: int, precisions: Sequence[type]) -> Evaluation:
    """L-BFGS in the first precision until it ends; the next one takes the iterations that are left."""
    for precision in precisions:
        seen: list[float] = []
        steps = lbfgs(at, max_iter, seen=seen)
        try:
            at = next(steps)
            while True:
                at = steps.send((yield at.astype(precision)))
        except StopIteration as end:
            at = end.value
        max_iter -= len(seen) - 1
        if max_iter <= 0:
            break
    return at


def train(
    blocks: RDD, weights: dict[int, np.ndarray], sizes: dict[int, Sequence[int]], rows: dict[int, int],
    max_iter: int, precisions: Sequence[type] = (np.float64,),
) -> dict[int, np.ndarray]:
    """The weights of each layer's network after at most `max_iter` iterations from the given ones.

    `precisions` are those of the products in tasks, one after the other: where the first
    finds no lower loss, the next goes on. Sums and steps are double.
    """
    going = {k: _in_turn(w, max_iter, precisions) for k, w in weights.items()}
    asked = {k: next(g) for k, g in going.items()}
    done = {}
    while asked:
        sums = _pass(blocks, asked, sizes)
        for k in list(asked):
            try:
                asked[k] = going[k].send((sums[k][-1] / rows[k], sums[k][:-1] / rows[k]))
            except StopIteration as end:
                done[k] = end.value
                del asked[k]
    return done


def unfit(data: ProbeData) -> dict[int, str]:
    """Why a layer has no network: training rows without a class or a finite vector, or vectors of other widths."""
    training = F.col("split") == "train"
    widths = F.create_map(*[F.lit(x) for k, (w, _) in data.shapes.items() for x in (k, w)])
    off = F.col("vec").isNull() | (F.size("vec") != F.element_at(widths, F.col("layer")))
    number = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))
    counts = data.table.groupBy("layer").agg(
        F.count(F.when(training & (F.col("label").isNull() | (F.col("label") < 0)), 1)).alias("no_class"),
        F.count(F.when(off | F.exists("vec", lambda x: x.isNull()), 1)).alias("off"),
        F.count(F.when(training & ~number, 1)).alias("no_number"),
    )
    out = {}
    for r in counts.collect():  # a row a layer
        if not data.shapes[r.layer][1]:
            out[r.layer] = "no training rows"
        elif r.no_class or r.off or r.no_number:
            out[r.layer] = (
                f"training rows without a class: {r.no_class}, vectors missing or of another width: {r.off}, "
                f"training vectors with a value that is not finite: {r.no_number}"
            )
    return out


def training_blocks(data: ProbeData, layers: Sequence[int]) -> RDD:
    rows = data.table.filter((F.col("split") == "train") & F.col("layer").isin(list(layers)))
    return deal(rows.select("layer", F.lit(True).alias("train"), target_bits(data.classes).alias("bits"), "vec"), layers)


def predict(data: ProbeData, weights: dict[int, np.ndarray], sizes: dict[int, Sequence[int]]) -> DataFrame:
    """(layer, split, sample_id, y, yhat, logits) of every row of the layers in `weights`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for layer, part in by_layer(batch, np.asarray(batch.column("layer"))):
                z = _forward(matrix(part.column("vec")), _parts(weights[layer], sizes[layer]))[-1]
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * z.shape[1])
                logits = pa.ListArray.from_arrays(offsets, pa.array(z.reshape(-1)))
                kept = ["layer", "split", "sample_id", "y"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], logits], names=[*kept, "logits"])

    rows = data.table.filter(F.col("layer").isin(list(weights))).select(
        F.col("layer").cast("int"), "split", F.col("sample_id").cast("long"), F.col("label").cast("int").alias("y"), "vec"
    )
    top = F.array_position("logits", F.array_max("logits")) - 1
    return rows.mapInArrow(work, "layer int, split string, sample_id long, y int, logits array<double>").select(
        "layer", "split", "sample_id", "y", top.cast("int").alias("yhat"), "logits"
    )
