"""Label expressions: parsing, multi-hot, groups, dominant class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from layerlab.functions.fixed_values import AMBIGUOUS, BLANKS, NEGATIVE, POSITIVE


def parse_label_list(text: Column) -> Column:
    """'[6 7]' or '[6, 7]' -> array<int>; a token that is no number gives null."""
    bare = F.replace(F.regexp_replace(text, r"^[\[\]]+|[\[\]]+$", ""), F.lit(","), F.lit(""))
    tokens = F.filter(F.split(bare, f"[{BLANKS}]+"), lambda t: t != "")
    return F.transform(tokens, lambda t: t.try_cast("int"))


def format_label_list(labels: Column) -> Column:
    """array<int> -> '[6, 7]'."""
    return F.concat(
        F.lit("["), F.array_join(F.transform(labels, lambda x: x.cast("string")), ", "), F.lit("]")
    )


def has_bad_label(labels: Column) -> Column:
    """True where parsing left a null in the list."""
    return F.exists(labels, lambda x: x.isNull())


def label_arity_ok(labels: Column, lo: int = 1, hi: int = 5) -> Column:
    """True where the list holds lo..hi labels; false for null."""
    return F.coalesce(F.size(labels).between(lo, hi) & labels.isNotNull(), F.lit(False))


def sentiment_group(names: Column) -> Column:
    """positive before negative before ambiguous, else neutral."""

    def any_of(group: list[str]) -> Column:
        return F.coalesce(F.exists(names, lambda n: n.isin(group)), F.lit(False))

    return (
        F.when(any_of(POSITIVE), "positive")
        .when(any_of(NEGATIVE), "negative")
        .when(any_of(AMBIGUOUS), "ambiguous")
        .otherwise("neutral")
    )


def label_names(labels: Column, names: list[str]) -> Column:
    """List of ids -> list of names in the same order; unknown ids give null."""
    table = F.array(*[F.lit(n) for n in names])
    return F.transform(
        labels,
        lambda i: F.when(i.between(0, len(names) - 1), F.element_at(table, i + 1)),
    )


def multi_hot(labels: Column, classes: int = 28) -> Column:
    """List of ids -> 0/1 array of fixed length; ids beyond the end are ignored."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)),
        lambda i: F.coalesce(F.array_contains(labels, i), F.lit(False)).cast("int"),
    )


def multi_hot_columns(labels: Column, names: list[str]) -> list[Column]:
    """One 0/1 column per class name."""
    return [
        F.coalesce(F.array_contains(labels, i), F.lit(False)).cast("int").alias(n)
        for i, n in enumerate(names)
    ]


def flags_to_labels(flags: Column) -> Column:
    """0/1 array -> list of ids that are set."""
    return F.filter(
        F.sequence(F.lit(0), F.size(flags) - 1), lambda i: F.get(flags, i) == 1
    )


def dominant_label(labels: Column) -> Column:
    """Lowest id of the list; an empty or missing list counts as class 0."""
    return F.coalesce(F.array_min(labels), F.lit(0))


def zero_index_label(label: Column) -> Column:
    """1-based label (number or text) -> 0-based int."""
    return F.trim(label.cast("string")).cast("int") - 1
