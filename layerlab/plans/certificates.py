"""Whether a penalised fit is at its optimum, from its predictions and coefficients.

At the optimum of sum(weight x loss) + penalty / 2 |coefficients|^2, with free
intercepts, the gradient is zero: for each class and dimension
sum(weight (p - y) x) + penalty x coefficient, and sum(weight (p - y)) for the
intercept. The sums are weighted vector sums, one pass for all layers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerlab.plans.probes import Coefficients

Parts = Callable[[int], tuple[Column, Column, Column]]


def gradient_rows(rows: DataFrame, models: dict[int, Coefficients], parts: Parts) -> DataFrame:
    """(layer, class, dim, gradient, p_sum, weight_sum, n) over all `rows` (layer, features).

    `parts(c)` gives (p, y, weight) of a class as columns. The penalty is the mean
    weight, as that of a fit with penalty 1/n on the mean loss. `p_sum` is the
    weighted sum of p, which the intercept makes equal to that of y.
    """
    spark = rows.sparkSession
    classes = len(next(iter(models.values())))
    marked = rows
    for c in range(classes):
        p, y, w = parts(c)
        marked = marked.withColumns({f"_p{c}": w * p, f"_y{c}": (w * y).cast("double"), f"_w{c}": w.cast("double")})
    each = [
        F.struct(
            F.lit(c).alias("class"),
            vector_to_array(Summarizer.sum(F.col("features"), F.col(f"_p{c}"))).alias("p"),
            vector_to_array(Summarizer.sum(F.col("features"), F.col(f"_y{c}"))).alias("y"),
            F.sum(f"_p{c}").alias("p_sum"),
            F.sum(f"_w{c}").alias("weight_sum"),
            F.count(F.lit(1)).alias("n"),
        )
        for c in range(classes)
    ]
    sums = marked.groupBy("layer").agg(F.array(*each).alias("each")).select("layer", F.inline("each"))
    cells = sums.select(
        "layer", "class", "p_sum", "weight_sum", "n", F.posexplode(F.zip_with("p", "y", lambda a, b: a - b)).alias("dim", "slope")
    )
    coefficients = spark.createDataFrame(
        [(k, c, d, float(v)) for k, m in models.items() for c, line in enumerate(m) for d, v in enumerate(line)],
        "layer int, class int, dim int, coefficient double",
    )
    penalty = F.col("weight_sum") / F.col("n") * F.col("coefficient")
    return cells.join(coefficients, ["layer", "class", "dim"]).select(
        "layer", "class", "dim", (F.col("slope") + penalty).alias("gradient"), "p_sum", "weight_sum", "n"
    )


def within(gradient: Column, weight: Column, tolerance: float = 1e-3) -> Column:
    """Zero if the gradient is, to `tolerance` of the rows' weight; else its share of that."""
    return F.when(F.abs(gradient) <= tolerance * weight, 0.0).otherwise(gradient / weight)
