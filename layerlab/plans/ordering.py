"""Ordered computations that never put an unbounded group into one task.

* `running_sums` / `dense_positions`: prefix sums over a unique long key by
  splitting the key into 20-bit digits; each window partition holds at most
  2^20 keys (2^23 digits at the top), whatever the size of the table or group.
* `smallest_k`: the exact k smallest rows per group by a hash order, found from
  a histogram whose bins are as fine as the table is long; only the rows of the
  boundary bin, at most some 2^20, are ever sorted.
* `exact_quantiles`: order statistics by radix selection on the bits of the values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerlab.plans.materialize import cut_lineage, inline_if_small, local_side, small_table, via_parquet

DIGIT_BITS = 20
# the bin of a hash histogram that is sorted may hold this many rows
BIN_ROWS = 1 << 20


def hash_digits(rows: int) -> int:
    """Hex digits of the histogram (3 or more), so that a bin of one group fits BIN_ROWS.

    Hashes are even, so half of BIN_ROWS is expected at most.
    """
    digits = 3
    while rows / 16**digits > BIN_ROWS / 2:
        digits += 1
    return digits


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which null keys match null keys; keeps the left key columns."""
    renamed = right.select(
        *[F.col(c).alias(f"_r_{c}") for c in on],
        *[c for c in right.columns if c not in on],
    )
    cond = reduce(
        lambda a, b: a & b,
        [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on],
    )
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in on])


def running_sums(
    df: DataFrame, key: str, values: dict[str, Column], group: Sequence[str] = (), first: Sequence[str] = ()
) -> DataFrame:
    """Add, for each `out: value`, the sum over the group's rows with a smaller key.

    `key` is a long that is unique within the group. Rows are ordered by the columns
    `first` before it; it need be unique within their values only. All sums share the same
    shuffle of the rows; the digit tables are aggregates.
    """
    outs = list(values)
    before = (Window.unboundedPreceding, -1)
    zero = F.lit(0)

    def sums(cols: dict[str, str], window=None) -> list[Column]:
        made = {to: F.sum(c) if window is None else F.sum(c).over(window) for to, c in cols.items()}
        return [c.alias(to) for to, c in made.items()]

    def digit(key_col: Column, level: int) -> Column:
        return F.shiftright(key_col.cast("long"), level * DIGIT_BITS).alias("d")

    # struct keys: equal also where a group column is null, and the window and
    # the join below share one partitioning of the rows
    keyed = df.withColumns({f"_v_{o}": c for o, c in values.items()}).withColumn(
        "_k1", F.struct(*group, *first, digit(F.col(key), 1))
    )
    low = keyed.groupBy("_k1").agg(*sums({f"_s_{o}": f"_v_{o}" for o in outs}))
    low = low.withColumn("_k2", F.struct(*[F.col(f"_k1.{g}").alias(g) for g in [*group, *first]], digit(F.col("_k1.d"), 1)))
    high = low.groupBy("_k2").agg(*sums({f"_t_{o}": f"_s_{o}" for o in outs}))
    whole = F.struct(*[F.col(f"_k2.{g}").alias(g) for g in group], F.lit(0).alias("one"))
    w_high = Window.partitionBy(whole).orderBy(*[f"_k2.{c}" for c in first], "_k2.d").rowsBetween(*before)
    high = high.select(F.col("_k2").alias("_j2"), *sums({f"_h_{o}": f"_t_{o}" for o in outs}, w_high))
    w_low = Window.partitionBy("_k2").orderBy("_k1.d").rowsBetween(*before)
    low = low.select("_k1", "_k2", *sums({f"_l_{o}": f"_s_{o}" for o in outs}, w_low))
    offsets = low.join(high, F.col("_k2") == F.col("_j2")).select(
        F.col("_k1").alias("_j1"),
        *[(F.coalesce(f"_l_{o}", zero) + F.coalesce(f"_h_{o}", zero)).alias(f"_o_{o}") for o in outs],
    )
    w_row = Window.partitionBy("_k1").orderBy(key).rowsBetween(*before)
    inner = keyed.select(*df.columns, "_k1", *sums({f"_i_{o}": f"_v_{o}" for o in outs}, w_row))
    return inner.join(offsets, F.col("_k1") == F.col("_j1")).select(
        *df.columns, *[(F.coalesce(f"_i_{o}", zero) + F.col(f"_o_{o}")).alias(o) for o in outs]
    )


def dense_positions(
    df: DataFrame, key: str, out: str, group: Sequence[str] = (), first: Sequence[str] = ()
) -> DataFrame:
    """Add `out`: 0-based position of the row by `first`, then `key`, within the group."""
    return running_sums(df, key, {out: F.lit(1).cast("long")}, group, first)


def hash_order(seed: int | str, key: Column) -> Column:
    """Pseudo-random order key, the same on every engine that has md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def _edge_bins(df: DataFrame, key: str, seed: int | str, k: Column, g: list[str], digits: int) -> DataFrame:
    """Per group: n, the histogram bin that holds the k-th row and its rank in there."""
    bin_ = F.substring(hash_order(seed, F.col(key)), 1, digits)
    bins = df.groupBy(*g, bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
    # at most 16^digits bins per group, a few times n / BIN_ROWS or 4,096
    whole = Window.partitionBy(*(g or [F.lit(0)]))
    return (
        bins.withColumn("n", F.sum("_c").over(whole))
        .withColumn("_upto", F.sum("_c").over(whole.orderBy("_bin")))
        .withColumn("_need", k - (F.col("_upto") - F.col("_c")))
        .filter((F.col("_need") > 0) & (F.col("_need") <= F.col("_c")))
        .select(*g, "n", "_bin", "_need")
    )


def smallest_k(
    df: DataFrame,
    key: str,
    seed: int | str,
    k: Column,
    out: str,
    group: Sequence[str] = (),
    smallest_group: int = 0,
) -> DataFrame:
    """Add boolean `out`: row is among the k first of its group in hash order.

    `k` is an expression over `n`, the group's row count. The cut (one row per
    group) is computed from (group, key) only, so wide columns are not
    shuffled when the cut is small enough to broadcast. If a group has fewer
    than `smallest_group` rows, groups are ignored.
    """
    g = list(group)
    digits = hash_digits(df.count())
    bins = _edge_bins(df, key, seed, k, g, digits)
    rows = small_table(bins)
    if g and smallest_group > 1:
        least = min(rows["n"].to_pylist(), default=0) if rows is not None else bins.agg(F.min("n")).first()[0]
        if least < smallest_group:
            return smallest_k(df, key, seed, k, out)
    edges = bins if rows is None else local_side(bins, rows)
    keyed = df.select(*g, key).withColumn("_h", hash_order(seed, F.col(key)))
    keyed = keyed.withColumn("_bin", F.substring("_h", 1, digits))
    edge = null_safe_join(keyed, edges.drop("n"), [*g, "_bin"], "inner")
    ranked = edge.withColumn(
        "_rn",
        F.row_number().over(Window.partitionBy(*g, "_bin").orderBy("_h", key)),
    )
    cut = ranked.filter(F.col("_rn") == F.col("_need")).select(
        *g, F.col("_h").alias("_cut_h"), F.col(key).alias("_cut_k")
    )
    if g:
        joined = null_safe_join(df, inline_if_small(cut), g, "left")
    else:
        row = cut.first()
        joined = df.withColumn("_cut_h", F.lit(row[0] if row else None)).withColumn(
            "_cut_k", F.lit(row[1] if row else None)
        )
    h = hash_order(seed, F.col(key))
    inside = (h < F.col("_cut_h")) | ((h == F.col("_cut_h")) & (F.col(key) <= F.col("_cut_k")))
    return joined.withColumn(out, F.coalesce(inside, F.lit(False))).drop("_cut_h", "_cut_k")


_MANTISSA = 1 << 52
_INFINITY, _NAN = 2047 << 52, (2047 << 52) + (1 << 51)


def ordered_bits(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add `out`: the 64 bits of a double as a long that orders like it; NaN is last, -0.0 is 0.0.

    Made of exact arithmetic, so that it stays in generated code: the exponent from
    a logarithm put right by one, the rest by dividing by a power of two.
    """
    x, size, e, power = (F.col(f"_{c}") for c in ("bits_x", "bits_a", "bits_e", "bits_p"))
    two = F.lit(2.0)
    first = df.withColumns({"_bits_x": F.col(value).cast("double"), "_bits_a": F.abs(F.col(value).cast("double"))})
    guess = first.withColumn("_bits_e", F.floor(F.log2(size)).cast("double"))
    close = guess.withColumn(
        "_bits_e", F.when(size < F.pow(two, e), e - 1).when(size >= F.pow(two, e + 1), e + 1).otherwise(e)
    )
    scaled = close.withColumn("_bits_e", F.greatest(e, F.lit(-1022.0))).withColumn("_bits_p", F.pow(two, e))
    plain = ((e + 1022) * _MANTISSA).cast("long") + (size / power * _MANTISSA).cast("long")
    bits = (
        F.when(F.isnan(x), F.lit(_NAN))
        .when(size == float("inf"), F.lit(_INFINITY))
        .when(size == 0, F.lit(0).cast("long"))
        .otherwise(plain)
    )
    key = F.when(x.isNotNull(), F.when(x < 0, -bits).otherwise(bits))
    return scaled.withColumn(out, key).drop("_bits_x", "_bits_a", "_bits_e", "_bits_p")


def double_of_bits(key: Column) -> Column:
    """The double that ordered_bits was made of."""
    bits = F.abs(key)
    e, rest = F.shiftright(bits, 52), bits.bitwiseAND(_MANTISSA - 1).cast("double")
    two = F.lit(2.0)
    size = (
        F.when(bits == _NAN, float("nan"))
        .when(bits == _INFINITY, float("inf"))
        .when(e == 0, rest * F.lit(5e-324))
        .otherwise((1 + rest / _MANTISSA) * F.pow(two, e - 1023))
    )
    return F.when(key < 0, -size).otherwise(size)


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Exact quantiles (linear interpolation) per group, by radix selection.

    A value is its order-preserving 64 bits. Each round counts, for all groups and
    ranks at once, the next bits (20, 22 and 22) of the values that share the bits
    found so far; three rounds always do, whatever the values. The first is a scan
    with a partial aggregate. Only values that share 20 bits with a wanted rank go on,
    each different one once with its count. No window sees more than 2^22 rows of a
    group or rank. Nulls do not count; a group without values, or an empty table,
    gives no row.
    """
    g = list(group) or ["_all"]
    source = df if group else df.withColumn("_all", F.lit(0))
    keyed = ordered_bits(source.filter(F.col(value).isNotNull()).select(*g, value), value, "_key")
    data = keyed.select(*g, "_key", F.lit(1).cast("long").alias("_n"))

    def bins(rows: DataFrame, known: list[str], shift: int) -> DataFrame:
        """Counted bins of the next bits, with the values before each among those that share `known`."""
        found = rows.groupBy(*g, *known, F.shiftright("_key", shift).alias("_bin")).agg(
            F.sum("_n").alias("_n"), F.min("_key").alias("_lo"), F.max("_key").alias("_hi")
        )
        order = Window.partitionBy(*g, *known).orderBy("_bin")
        return found.withColumn("_upto", F.sum("_n").over(order))

    def placed(found: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
        """Targets with the bin that their rank is in."""
        here = null_safe_join(found, targets, on, "inner").filter(
            (F.col("_rank") < F.col("_below") + F.col("_upto"))
            & (F.col("_rank") >= F.col("_below") + F.col("_upto") - F.col("_n"))
        )
        below = F.col("_below") + F.col("_upto") - F.col("_n")
        return evaluated(
            here.select(*g, "_rank", below.alias("_below"), F.col("_bin").alias("_known"), "_lo", "_hi", "_size")
        )

    def evaluated(rows: DataFrame) -> DataFrame:
        """A local, broadcast table if it is small, else a checkpoint."""
        table = small_table(rows)
        return cut_lineage(rows) if table is None else local_side(rows, table)

    at = [(F.col("_size") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.array(*[f(pos).cast("long") for pos in at for f in (F.floor, F.ceil)]))
    below = F.col("_upto") - F.col("_n")
    here = F.filter(ranks, lambda r: (r >= below) & (r < F.col("_upto")))
    first = bins(data, [], 44).withColumn("_size", F.sum("_n").over(Window.partitionBy(*g)))
    targets = evaluated(
        first.withColumn("_ranks", here)
        .filter(F.size("_ranks") > 0)
        .select(*g, F.explode("_ranks").alias("_rank"), below.alias("_below"), F.col("_bin").alias("_known"), "_lo", "_hi", "_size")
    )
    done, narrow = [], None
    for shift in (22, 0):
        left = targets.filter("_lo < _hi")
        done.append(targets.filter("_lo = _hi"))
        if left.isEmpty():
            break
        rows = (data if narrow is None else narrow.drop("_known")).withColumn("_known", F.shiftright("_key", shift + 22))
        narrow = null_safe_join(rows, left.select(*g, "_known"), [*g, "_known"], "left_semi")
        if shift == 22:
            counted = narrow.groupBy(*g, "_known", "_key").agg(F.sum("_n").alias("_n"))
            narrow = via_parquet(counted, "quantile-values")
        targets = placed(bins(narrow, ["_known"], shift), left.drop("_lo", "_hi"), [*g, "_known"])
    else:
        done.append(targets)
    found = reduce(lambda a, b: a.unionByName(b), done)
    picked = found.select(*g, "_size", "_rank", double_of_bits(F.col("_lo")).alias("_x"))
    cols = []
    for p, name in zip(probs, names, strict=True):
        pos = (F.col("_size") - 1) * F.lit(float(p))
        lo = F.max(F.when(F.col("_rank") == F.floor(pos), F.col("_x")))
        hi = F.max(F.when(F.col("_rank") == F.ceil(pos), F.col("_x")))
        part = F.max(pos - F.floor(pos))
        cols.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * part).alias(name))
    return picked.groupBy(*g).agg(*cols).select(*group, *names)
