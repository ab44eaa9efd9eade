"""Tuning grids and training logs.

Trials without hidden layers are linear heads, trained together (plans.descent):
loss, learning rate, weight decay and epochs act. Trials with hidden layers are networks
(plans.networks) with cross-entropy, fitted in chunks of iterations from the weights of the
last chunk: hidden layers and epochs act. Settings that act alike share one fit, and all
fits go on at the same time; what does not act is marked in each trial. A trial that
cannot be fitted has its reason.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerlab.functions.losses import nll_row
from layerlab.operators.evaluation import accuracy, confusion_counts, macro_f1, micro_f1, multilabel_metrics
from layerlab.plans import networks
from layerlab.plans.descent import LOSSES, Head, predict, train_heads
from layerlab.plans.materialize import via_parquet
from layerlab.plans.probes import ProbeData

LINEAR_ACTS = ("epochs", "hidden_layers", "learning_rate", "loss_function", "weight_decay")
NETWORK_ACTS = ("epochs", "hidden_layers")
TRIALS = (
    "layer int, trial_id long, params map<string,string>, acts array<string>, metrics map<string,double>, "
    "train_loss double, falls boolean, status string, error string"
)
EPOCH_LOG = "layer int, depth int, epoch int, train_loss double, val_loss double, val_accuracy double"


def network_blocks(data: ProbeData) -> RDD:
    """The training rows of all layers, dealt to the cores."""
    bad = networks.unfit(data)
    if bad:
        raise ValueError(f"layers that cannot be fitted: {bad}")
    return networks.training_blocks(data, data.layers)


def chunked_network(
    data: ProbeData,
    hidden: Sequence[int],
    epochs: int,
    chunk: int,
    patience: int | None = None,
    seed: int = 42,
    blocks: RDD | None = None,
    precisions: Sequence[type] = (np.float64,),
) -> DataFrame:
    """Predictions after each chunk of iterations: (layer, depth, epoch, split, sample_id, y, yhat, logits).

    A chunk starts from the weights of the one before. `patience` counts chunks
    without a lower validation loss. No hidden layer gives softmax regression.
    All layers are fitted together; the loss that is lowered is the plain mean
    over the training rows. `blocks` are those of `network_blocks`, if the caller has them.
    """
    own = network_blocks(data) if blocks is None else None
    sizes = {k: [w, *hidden, data.classes] for k, (w, _) in data.shapes.items()}
    rows = {k: n for k, (_, n) in data.shapes.items()}
    weights = {k: networks.initial_weights(s, seed) for k, s in sizes.items()}
    lowest, waited, out = dict.fromkeys(sizes, float("inf")), dict.fromkeys(sizes, 0), []
    try:
        for start in range(0, epochs, chunk):
            weights = networks.train(blocks or own, weights, sizes, rows, min(chunk, epochs - start), precisions)
            scored = networks.predict(data, weights, sizes).select(
                "layer", F.lit(len(hidden)).alias("depth"), F.lit(min(start + chunk, epochs)).alias("epoch"),
                "split", "sample_id", "y", "yhat", "logits",
            )
            out.append(via_parquet(scored, "chunk"))
            if patience is None:
                continue
            found = out[-1].filter("split <> 'train'").groupBy("layer").agg(F.avg(nll_row(F.col("logits"), F.col("y"))).alias("loss"))
            losses = {r.layer: r.loss for r in found.collect()}
            for k in list(weights):
                if losses.get(k) is not None and losses[k] < lowest[k]:
                    lowest[k], waited[k] = losses[k], 0
                else:
                    waited[k] += 1
                if waited[k] >= patience:
                    del weights[k]
            if not weights:
                break
    finally:
        if own:
            own.unpersist()
    return reduce(DataFrame.unionByName, out)


def epoch_log(predictions: DataFrame) -> DataFrame:
    """(layer, depth, epoch, train_loss, val_loss, val_accuracy) from the written logits."""
    loss = nll_row(F.col("logits"), F.col("y"))
    train = F.col("split") == "train"
    return predictions.groupBy("layer", "depth", "epoch").agg(
        F.avg(F.when(train, loss)).alias("train_loss"),
        F.avg(F.when(~train, loss)).alias("val_loss"),
        F.avg(F.when(~train, (F.col("y") == F.col("yhat")).cast("double"))).alias("val_accuracy"),
    )


def best_states(predictions: DataFrame, log: DataFrame) -> DataFrame:
    """The predictions of the first epoch with the highest validation accuracy, by layer and depth."""
    w = Window.partitionBy("layer", "depth").orderBy(F.desc("val_accuracy"), "epoch")
    best = log.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("layer", "depth", "epoch")
    return predictions.join(F.broadcast(best), ["layer", "depth", "epoch"], "left_semi")


def _metrics(scored: DataFrame, keys: Sequence[str], many: bool) -> DataFrame:
    """(keys, metrics map) over the rows that were not trained on."""
    test = scored.filter("split <> 'train'")

    def packed(names: dict[str, str]) -> Column:
        return F.create_map(*[x for new, old in names.items() for x in (F.lit(new), F.col(old).cast("double"))])

    if many:
        both = multilabel_metrics(test, keys).join(micro_f1(test, keys), list(keys))
        names = {"exact_acc": "exact_match", "hamming_loss": "hamming_loss", "f1": "micro_f1"}
        return both.select(*keys, packed(names).alias("metrics"))
    counts = confusion_counts(test, keys)
    both = accuracy(counts, keys).join(macro_f1(counts, keys), list(keys))
    return both.select(*keys, packed({"accuracy": "accuracy", "f1": "macro_f1"}).alias("metrics"))


def _reason(params: dict, many: bool) -> str | None:
    """Why a trial has no fit; None if it has one."""
    loss = params["loss_function"]
    if (loss, many) not in LOSSES:
        return f"loss {loss!r} is not defined for {'many labels' if many else 'one class'} a row"
    if params["hidden_layers"] and many:
        return "networks predict one class a row"
    if params["hidden_layers"] and loss != "ce":
        return f"networks have cross-entropy only, not {loss!r}"
    return None


def tune(
    data: ProbeData,
    grid: Sequence[dict],
    labels: str | None = None,
    classes: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """One row per layer and trial of the grid: params, what acts, test metrics, status.

    `train_loss` is the last one, `falls` whether each epoch (linear) or chunk
    (network) of the trial had a lower training loss than the one before.
    With `labels` (a list column) the trials have many labels a row.
    """
    many = labels is not None
    classes = classes or data.classes
    defaults = {"hidden_layers": [], "epochs": 50, "loss_function": "bce" if many else "ce", "learning_rate": 1e-3, "weight_decay": 0.0}
    full = [defaults | p for p in grid]
    reasons = [_reason(p, many) for p in full]
    plan: dict[tuple, list[int]] = {}  # numbers of epochs by hidden layers
    for p, r in zip(full, reasons):
        if not r:
            plan.setdefault(tuple(p["hidden_layers"]), []).append(p["epochs"])
    plan = {hidden: sorted(set(asked)) for hidden, asked in sorted(plan.items())}
    heads = sorted({(p["loss_function"], p["learning_rate"], p["weight_decay"]) for p, r in zip(full, reasons) if not r and not p["hidden_layers"]})
    rows, losses = {}, {}

    def fit_heads(asked: list[int]) -> None:
        widths = {k: w for k, (w, _) in data.shapes.items()}
        trained = train_heads(data.table, widths, classes, [Head(*h) for h in heads], asked[-1], asked, labels=labels)
        for r in trained.log.groupBy("layer", "head").agg(F.array_sort(F.collect_list(F.struct("epoch", "train_loss"))).alias("l")).collect():
            losses[r.layer, heads[r.head]] = [x.train_loss for x in r.l]
        held_out = data.table.filter("split <> 'train'")  # the metrics are theirs
        for epochs, weights in trained.after.items():
            found = _metrics(predict(held_out, weights, classes, labels), ["layer", "head"], many)
            for r in found.collect():  # a row a layer and head
                rows[r.layer, heads[r["head"]], epochs] = r.metrics

    def fit_network(hidden: tuple, asked: list[int], blocks: RDD) -> None:
        step = min(b - a for a, b in zip([0, *asked], asked))
        chunks = chunked_network(data, hidden, asked[-1], step, seed=seed, blocks=blocks, precisions=(np.float32, np.float64))
        log = epoch_log(chunks).collect()
        for r in _metrics(chunks, ["layer", "epoch"], many).collect():
            rows[r.layer, hidden, r.epoch] = r.metrics
        for r in sorted(log, key=lambda r: r.epoch):
            losses.setdefault((r.layer, hidden), []).append(r.train_loss)
        losses.update({(k, hidden, "step"): step for k in data.layers})

    # all fits at once: the cores have rows of one while the driver makes the step of another
    with ThreadPoolExecutor(max(1, len(plan))) as pool:
        linear = pool.submit(fit_heads, plan[()]) if heads else None
        nets, failed, blocks = {h: asked for h, asked in plan.items() if h}, {}, None
        try:
            blocks = network_blocks(data) if nets else None
            fits = {h: pool.submit(fit_network, h, asked, blocks) for h, asked in nets.items()}
            failed = {h: fit.exception() for h, fit in fits.items() if fit.exception()}
        except Exception as error:  # noqa: BLE001 - trials fail, the others go on
            failed = dict.fromkeys(nets, error)
        finally:
            if blocks:
                blocks.unpersist()
        if linear:
            linear.result()
    reasons = [r or (str(failed[h])[:200] if (h := tuple(p["hidden_layers"])) in failed else None) for p, r in zip(full, reasons)]
    out = []
    for layer in data.layers:
        for i, (params, reason) in enumerate(zip(full, reasons)):
            shown = {k: str(v) for k, v in params.items()}
            hidden = tuple(params["hidden_layers"])
            key = hidden or (params["loss_function"], params["learning_rate"], params["weight_decay"])
            metrics = None if reason else rows.get((layer, key, params["epochs"]))
            if metrics is None:
                out.append((layer, i, shown, None, None, None, None, "failed", reason or "no fit for this number of epochs"))
                continue
            upto = params["epochs"] // losses[layer, hidden, "step"] if hidden else params["epochs"] + 1
            seen = losses[layer, key][:upto]
            falls = all(b < a for a, b in zip(seen, seen[1:]))
            acts = NETWORK_ACTS if hidden else LINEAR_ACTS
            out.append((layer, i, shown, list(acts), metrics, seen[-1], falls, "done", None))
    return data.spark.createDataFrame(out, TRIALS)
