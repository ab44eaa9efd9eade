"""Vector expressions on array<float|double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def vector_from_text(text: Column) -> Column:
    """JSON text -> array<double>; null when it is no flat list of numbers."""
    return F.from_json(text, "array<double>")


def flatten_nested(vec: Column, levels: int = 1) -> Column:
    """Remove the given number of list levels."""
    for _ in range(levels):
        vec = F.flatten(vec)
    return vec


def pad_or_truncate(vec: Column, width: int) -> Column:
    """Cut to `width`, or pad with zeros on the right."""
    return F.slice(F.concat(doubles(vec), F.array_repeat(F.lit(0.0), width)), 1, width)


def pool_tokens(tokens: Column, which: str = "first") -> Column:
    """First or last token vector of a token matrix."""
    return F.element_at(tokens, 1 if which == "first" else -1)


def argmax(scores: Column) -> Column:
    """0-based index of the largest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def sigmoid(logits: Column) -> Column:
    return F.transform(doubles(logits), lambda x: 1.0 / (1.0 + F.exp(-x)))


def threshold(logits: Column, cut: float = 0.5) -> Column:
    """1 where sigmoid(logit) is strictly above the cut, else 0."""
    return F.transform(sigmoid(logits), lambda p: (p > cut).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def scale(vec: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / (std + 1e-8) by element."""
    centred = F.zip_with(doubles(vec), mean, lambda x, m: x - m)
    return F.zip_with(centred, std, lambda x, s: x / (s + 1e-8))


def row_moments(vec: Column) -> dict[str, Column]:
    """min, max, mean, population std and NaN flag of one vector."""
    v = doubles(vec)
    n = F.size(v)
    total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    mean = F.try_divide(total, n.cast("double"))
    centred = F.aggregate(
        v,
        F.struct(F.lit(0.0).alias("s"), mean.alias("m")),
        lambda acc, x: F.struct(
            (acc["s"] + (x - acc["m"]) * (x - acc["m"])).alias("s"), acc["m"].alias("m")
        ),
        lambda acc: acc["s"],
    )
    return {
        "v_min": F.array_min(v),
        "v_max": F.array_max(v),
        "v_mean": mean,
        "v_std": F.sqrt(F.try_divide(centred, n.cast("double"))),
        "has_nan": F.exists(v, F.isnan),
    }


def neg_log10(p: Column) -> Column:
    """-log10(p), infinite for p = 0 (Spark's log10 would give null)."""
    return F.when(p == 0, F.lit(float("inf"))).otherwise(-F.log10(p))


def round_display(x: Column, digits: int = 3) -> Column:
    """Number as text with a fixed count of decimals."""
    return F.regexp_replace(F.format_number(x, digits), ",", "")
