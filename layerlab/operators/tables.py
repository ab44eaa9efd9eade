"""Row identity, set operations, de-duplication, slices and shape changes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerlab.plans.materialize import inline_if_small
from layerlab.plans.ordering import dense_positions, running_sums, smallest_k


# ---- projections and filters -------------------------------------------------


def keep_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Select the listed columns that exist."""
    return df.select(*[c for c in columns if c in df.columns])


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the listed columns; absent ones are no error."""
    return df.drop(*columns)


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Rows without a null in any listed column."""
    return df.na.drop(subset=list(subset))


def layer_columns(df: DataFrame, prefix: str = "layer_") -> list[str]:
    """Column names with the prefix, in schema order."""
    return [c for c in df.columns if c.startswith(prefix)]


def pack_layers(df: DataFrame, prefix: str = "layer_", out: str = "layers") -> DataFrame:
    """Wide layer columns -> one map column."""
    cols = layer_columns(df, prefix)
    packed = F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c))])
    return df.withColumn(out, packed).drop(*cols)


def layer_number(name: Column) -> Column:
    """`layer_12` -> 12; null for other names."""
    return F.regexp_extract(name, r"^layer_(\d+)$", 1).try_cast("int")


def melt_layers(df: DataFrame, layers: str = "layers") -> DataFrame:
    """Map of layers -> one row per (sample, layer) with the layer as int."""
    rest = [c for c in df.columns if c != layers]
    long = df.select(*rest, F.explode(layers).alias("_name", "vec"))
    return long.select(*rest, layer_number(F.col("_name")).alias("layer"), "vec")


def melt_layer_columns(df: DataFrame, prefix: str = "layer_") -> DataFrame:
    """Wide layer columns -> one row per (sample, layer)."""
    cols = layer_columns(df, prefix)
    rest = [c for c in df.columns if c not in cols]
    long = df.unpivot(rest, cols, "_name", "vec")
    return long.select(*rest, layer_number(F.col("_name")).alias("layer"), "vec")


def rows_of_class(df: DataFrame, label: str, value) -> DataFrame:
    """Rows of one class; the equality reaches the scan."""
    return df.filter(F.col(label) == value)


def head_slice(df: DataFrame, order_id: str, start: int, stop: int, group: Sequence[str] = ()) -> DataFrame:
    """Rows at positions start..stop-1 of the order (per group if given)."""
    placed = dense_positions(df, order_id, "_at", group)
    return placed.filter((F.col("_at") >= start) & (F.col("_at") < stop)).drop("_at")


def range_check(
    df: DataFrame, ranges: dict[str, tuple[float, float]], binary: Sequence[str] = ()
) -> DataFrame:
    """Rows checked and rows out of range per rule; nulls are not violations."""
    rules = {**ranges, **{c: (0, 1) for c in binary}}
    counts = df.agg(
        *[F.count(c).alias(f"{c}_n") for c in rules],
        *[
            F.coalesce(F.sum((~F.col(c).between(lo, hi)).cast("long")), F.lit(0)).alias(f"{c}_bad")
            for c, (lo, hi) in rules.items()
        ],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("rule"),
                F.lit(float(lo)).alias("lo"),
                F.lit(float(hi)).alias("hi"),
                F.col(f"{c}_n").alias("checked"),
                F.col(f"{c}_bad").alias("violations"),
            )
            for c, (lo, hi) in rules.items()
        ]
    )
    return counts.select(F.inline(rows))


def range_flags(
    df: DataFrame, ranges: dict[str, tuple[float, float]], binary: Sequence[str] = ()
) -> DataFrame:
    """Add `<column>_ok` flags for every rule."""
    rules = {**ranges, **{c: (0, 1) for c in binary}}
    return df.withColumns({f"{c}_ok": F.col(c).between(lo, hi) for c, (lo, hi) in rules.items()})


def guard_min_rows(
    labels: DataFrame, vectors: DataFrame, dataset: str = "dataset", minimum: int = 10
) -> DataFrame:
    """Per dataset: row counts of both sides and whether it is run or skipped."""
    a = labels.groupBy(dataset).agg(F.count(F.lit(1)).alias("n_labels"))
    b = vectors.groupBy(dataset).agg(F.count(F.lit(1)).alias("n_vectors"))
    both = a.join(b, dataset, "full_outer").select(
        dataset,
        F.coalesce("n_labels", F.lit(0)).alias("n_labels"),
        F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"),
    )
    least = F.least("n_labels", "n_vectors")
    return both.withColumn(
        "status",
        F.when(least == 0, "empty").when(least < minimum, "insufficient").otherwise("run"),
    )


def valid_rows(df: DataFrame, other: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Rows whose 0-based id is below the row count of both tables."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    m = other.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.withColumn("valid", F.col(sample) < F.least(n, m))


def skip_done_batches(
    df: DataFrame, start: int = 0, done: DataFrame | None = None, keys: Sequence[str] = ("batch_idx",)
) -> DataFrame:
    """Batches from `start` on that are not in the table of finished batches."""
    todo = df.filter(F.col("batch_idx") >= start)
    if done is None:
        return todo
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


# ---- set operations ----------------------------------------------------------


def assign_row_id(df: DataFrame, order_id: str, out: str = "row_id", group: Sequence[str] = ()) -> DataFrame:
    """0-based dense row id in the order of a unique long."""
    return dense_positions(df, order_id, out, group)


def union_splits(
    splits: dict[str, DataFrame], position: str, out: str = "row_id"
) -> DataFrame:
    """Bag union in dict order with a new dense row id over the whole union.

    One prefix sum over (split, position): the splits are read for its digits and
    for the rows.
    """
    parts = [
        df.withColumn("split", F.lit(name)).withColumn("_ord", F.lit(i))
        for i, (name, df) in enumerate(splits.items())
    ]
    union = reduce(lambda a, b: a.unionByName(b), parts)
    return dense_positions(union, position, out, first=["_ord"]).drop("_ord")


def dedup_rows(
    df: DataFrame, order_id: str = "row_id", within: Sequence[str] = (), ignore: Sequence[str] = ()
) -> DataFrame:
    """Keep the first of equal rows; equality is over all columns but the id.

    A grouped minimum, combined before the shuffle, so that a value with many
    copies does not end up in one task.
    """
    same = [c for c in df.columns if c != order_id and c not in ignore]
    keys = list(dict.fromkeys([*within, *same]))
    if not ignore:
        return df.groupBy(*keys).agg(F.min(order_id).alias(order_id)).select(*df.columns)
    rest = F.struct(*[F.col(c) for c in ignore])
    first = df.groupBy(*keys).agg(F.min(F.struct(F.col(order_id), rest.alias("r"))).alias("_f"))
    return first.select(
        *keys, F.col(f"_f.{order_id}").alias(order_id), *[F.col(f"_f.r.{c}").alias(c) for c in ignore]
    ).select(*df.columns)


def missing_values(requested: DataFrame, available: DataFrame) -> DataFrame:
    """Requested values that are not available (set difference)."""
    return requested.subtract(available)


def require_layers(requested: DataFrame, available: DataFrame) -> None:
    """Raise when a requested layer does not exist."""
    missing = [r[0] for r in missing_values(requested, available).collect()]
    if missing:
        raise ValueError(f"missing layers: {sorted(missing)}")


def restrict_layers(df: DataFrame, requested: DataFrame, layer: str = "layer") -> DataFrame:
    """Rows of the requested layers."""
    return df.join(requested.select(layer).distinct(), layer, "left_semi")


def union_experiments(results: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """Stack result tables under model and dataset columns."""
    parts = [
        df.withColumn("model", F.lit(m)).withColumn("dataset", F.lit(d))
        for (m, d), df in results.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# ---- batches and splits ------------------------------------------------------


def assign_batch(df: DataFrame, row_id: str = "row_id", size: int = 16) -> DataFrame:
    """Add batch_idx = row div size and pos = row mod size."""
    row = F.col(row_id).cast("long")
    return df.withColumn("batch_idx", F.floor(row / size)).withColumn("pos", row % size)


def batch_offsets(batches: DataFrame, group: Sequence[str] = (), size: str = "n_samples") -> DataFrame:
    """Start and end index of each batch from the batch sizes."""
    placed = running_sums(batches, "batch_idx", {"start_idx": F.col(size)}, group)
    return placed.withColumn("end_idx", F.col("start_idx") + F.col(size))


def random_split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Add split = train/test with exactly ceil(test * n) test rows."""
    k = F.ceil(F.lit(test) * F.col("n"))
    return _named(smallest_k(df, key, seed, k, "_test"))


def stratified_split(
    df: DataFrame, key: str, label: str = "label", test: float = 0.2, seed: int = 42
) -> DataFrame:
    """random_split within each class; plain random_split if a class has one row."""
    k = F.ceil(F.lit(test) * F.col("n"))
    return _named(smallest_k(df, key, seed, k, "_test", [label], smallest_group=2))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def sample_rows(
    df: DataFrame, key: str, n: int = 1000, seed: int = 42, group: Sequence[str] = ()
) -> DataFrame:
    """n rows without replacement per group; whole groups when they are smaller."""
    k = F.least(F.lit(n).cast("long"), F.col("n"))
    return smallest_k(df, key, seed, k, "_in", group).filter("_in").drop("_in")


def apply_split(df: DataFrame, split: DataFrame, key: str = "sample_id") -> DataFrame:
    """Attach the split of each sample."""
    return df.join(split.select(key, "split"), key, "inner")


def align_vectors_labels(vectors: DataFrame, labels: DataFrame, key: str = "sample_id") -> DataFrame:
    """Vectors with their labels by sample id."""
    return vectors.join(labels, key, "inner")


def align_batches(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """Vectors and labels by (batch, position); the longer side is truncated."""
    return vectors.join(labels, ["batch_idx", "pos"], "inner")


def batch_mismatch(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """Per batch: length of both sides, kept pairs and whether they differ."""
    a = vectors.groupBy("batch_idx").agg(F.count(F.lit(1)).alias("n_vectors"))
    b = labels.groupBy("batch_idx").agg(F.count(F.lit(1)).alias("n_labels"))
    zero = F.lit(0)
    return (
        a.join(b, "batch_idx", "full_outer")
        .select(
            "batch_idx",
            F.coalesce("n_vectors", zero).alias("n_vectors"),
            F.coalesce("n_labels", zero).alias("n_labels"),
        )
        .withColumn("kept", F.least("n_vectors", "n_labels"))
        .withColumn("mismatch", F.col("n_vectors") != F.col("n_labels"))
    )


def pad_labels_in_batch(df: DataFrame, labels: str = "labels", pad_value: int = 0) -> DataFrame:
    """Pad label lists to the longest of their batch."""
    longest = df.groupBy("batch_idx").agg(F.max(F.size(labels)).alias("_w"))
    fill = F.array_repeat(F.lit(pad_value), F.col("_w") - F.size(labels))
    return (
        df.join(longest, "batch_idx").withColumn(labels, F.concat(labels, fill)).drop("_w")
    )


# ---- code domains ------------------------------------------------------------


def domain_table(spark, domains: dict[str, dict[int, str]]) -> DataFrame:
    """Code dictionaries -> (domain, code, label)."""
    rows = [(d, c, v) for d, table in domains.items() for c, v in table.items()]
    return spark.createDataFrame(rows, "domain string, code int, label string")


def decode(code: Column, table: dict[int, str]) -> Column:
    """Code -> label by a literal map; unmapped codes give null."""
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.element_at(lookup, code.cast("int"))


def lookup_dimension(
    df: DataFrame, dim: DataFrame, domain: str, code_col: str, out: str
) -> DataFrame:
    """The same as a left join with a domain table."""
    side = dim.filter(F.col("domain") == domain).select(
        F.col("code").alias("_code"), F.col("label").alias(out)
    )
    small = inline_if_small(side)
    return df.join(small, F.col(code_col) == F.col("_code"), "left").drop("_code")


def class_codes(df: DataFrame, label: str, out: str = "code") -> DataFrame:
    """(label, code): dense code by alphabetical order of the classes that occur."""
    classes = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    # the window sees one row per class
    rank = F.row_number().over(Window.orderBy(label)) - 1
    return classes.select(label, rank.alias(out))


def encode_labels(df: DataFrame, label: str, out: str = "code") -> DataFrame:
    """Attach the class code; null labels get a null code."""
    return df.join(inline_if_small(class_codes(df, label, out)), label, "left")


def decode_labels(codes: DataFrame, source: DataFrame, label: str, code: str = "code") -> DataFrame:
    """Inverse of encode_labels; the classes are those of `source`."""
    return codes.join(inline_if_small(class_codes(source, label, code)), code, "left")
