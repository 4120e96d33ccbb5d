"""Column functions on label sets (arrays) – no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_labels(s: Column, delim: str = ",") -> Column:
    """Delimited string -> label array, empty pieces dropped (literal delimiter)."""
    return F.filter(F.split(s, "\\Q" + delim + "\\E"), lambda x: x != "")


def canon(labels: Column) -> Column:
    """Set semantics: distinct and sorted by code point."""
    return F.array_sort(F.array_distinct(labels))


def multi_hot(labels: Column, classes: list[str]) -> Column:
    """Label array -> 0/1 array in the given (bounded) class order."""
    return F.array(*[F.array_contains(labels, F.lit(c)).cast("int") for c in classes])


def multi_hot_decode(hot: Column, classes: list[str]) -> Column:
    """0/1 array -> label array in class order."""
    return F.filter(F.array(*[F.lit(c) for c in classes]), lambda c, i: F.element_at(hot, i + 1) == 1)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logits_to_hot(logits: Column, threshold: float = 0.5, inclusive: bool = True) -> Column:
    """Logits -> sigmoid -> threshold -> 0/1 array."""
    if inclusive:
        return F.transform(logits, lambda x: (sigmoid(x) >= threshold).cast("int"))
    return F.transform(logits, lambda x: (sigmoid(x) > threshold).cast("int"))


def any_label(labels: Column) -> Column:
    """E5: at least one label predicted."""
    return F.size(labels) > 0


def onehot_to_list(cols: list[str]) -> Column:
    """Wide 0/1 columns -> list of the column names set to 1, in column order (no shuffle)."""
    return F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in cols]))


def flags_to_labels(flags: dict[str, Column]) -> Column:
    """Conditional label assignment, one label per true flag."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(lab)) for lab, cond in flags.items()]))


def drop_labels(labels: Column, excluded: Column) -> Column:
    """E10 (array form): remove every label contained in ``excluded``."""
    return F.filter(labels, lambda x: ~F.array_contains(excluded, x))
