"""Losses as Column expressions over logits (array<double>) and targets.

Element losses are arrays; `*_row` forms give one number per row. Means over
the whole table are ordinary aggregates (see operators.evaluation.mean_loss).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from layerlab.functions.vectors import doubles


def bce_elements(logits: Column, bits: Column, pos_weight: Column | None = None) -> Column:
    """Binary cross entropy on logits by element, stable for large |x|.

    With weights w: (1 - y) x + (1 + (w - 1) y) (log1p(e^-|x|) + max(-x, 0)).
    """
    x, y = doubles(logits), doubles(bits)
    if pos_weight is None:
        return F.zip_with(
            x,
            y,
            lambda a, t: F.greatest(a, F.lit(0.0)) - a * t + F.log1p(F.exp(-F.abs(a))),
        )
    weight = F.zip_with(y, pos_weight, lambda t, w: 1.0 + (w - 1.0) * t)
    soft = F.transform(
        x, lambda a: F.log1p(F.exp(-F.abs(a))) + F.greatest(-a, F.lit(0.0))
    )
    pulled = F.zip_with(x, y, lambda a, t: (1.0 - t) * a)
    return F.zip_with(
        pulled, F.zip_with(weight, soft, lambda w, s: w * s), lambda p, q: p + q
    )


def focal_elements(
    logits: Column, bits: Column, alpha: float = 0.25, gamma: float = 2.0
) -> Column:
    """alpha (1 - e^-bce)^gamma bce by element."""
    return F.transform(
        bce_elements(logits, bits),
        lambda b: alpha * F.pow(1.0 - F.exp(-b), F.lit(gamma)) * b,
    )


def nll_row(logits: Column, target: Column) -> Column:
    """-log softmax of the target class."""
    x = doubles(logits)
    top = F.array_max(x)
    total = F.aggregate(
        x,
        F.struct(F.lit(0.0).alias("s"), top.alias("m")),
        lambda acc, v: F.struct(
            (acc["s"] + F.exp(v - acc["m"])).alias("s"), acc["m"].alias("m")
        ),
        lambda acc: F.log(acc["s"]) + acc["m"],
    )
    return total - F.get(x, target)


def multi_margin_row(logits: Column, target: Column) -> Column:
    """Sum over other classes of max(0, 1 - x_target + x_j), divided by C."""
    x = doubles(logits)
    own = F.get(x, target)
    hinge = F.zip_with(
        x,
        F.array_repeat(own, F.size(x)),
        lambda v, o: F.greatest(F.lit(0.0), 1.0 - o + v),
    )
    # the target's own term is max(0, 1) = 1 and does not count
    return (F.aggregate(hinge, F.lit(0.0), lambda a, v: a + v) - 1.0) / F.size(x)


def loss_by_name(name: str, multilabel: bool) -> Callable[..., Column]:
    """Loss for a tuning grid entry; hinge is not defined for multi-label rows."""
    known: dict[tuple[str, bool], Callable[..., Column]] = {
        ("bce", True): bce_elements,
        ("focal", True): focal_elements,
        ("ce", False): nll_row,
        ("focal", False): focal_elements,
        ("hinge", False): multi_margin_row,
    }
    if (name, multilabel) not in known:
        raise ValueError(f"loss {name!r} is not defined for multilabel={multilabel}")
    return known[(name, multilabel)]
