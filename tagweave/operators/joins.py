"""Join operators (C1-C7).  The reference writes these as dict lookups,
positional zips and index arithmetic; here every one is a key join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.labels import canon
from tagweave.operators.clean import dedupe_last


def gold_pred_join(gold: DataFrame, pred: DataFrame, id_col: str = "id", labels_col: str = "labels",
                   order_col: str | None = None) -> DataFrame:
    """Gold ⋈ predictions on id; a duplicated prediction id keeps its last record.

    ``order_col`` gives the record order (file position); the dedupe is a
    skew-safe ``max_by`` aggregate.  Output: id, gold, pred (canonical sets)."""
    p = pred.select(id_col, labels_col, *([order_col] if order_col else []))
    if order_col:
        p = dedupe_last(p, [id_col], [order_col]).drop(order_col)
    g = gold.select(id_col, canon(F.col(labels_col)).alias("gold"))
    return g.join(p.select(id_col, canon(F.col(labels_col)).alias("pred")), id_col, "inner")


def id_mismatch(gold: DataFrame, pred: DataFrame, id_col: str = "id") -> DataFrame:
    """Violation table (kind, id) of ids missing from or extra in the predictions."""
    g = gold.select(id_col).distinct()
    p = pred.select(id_col).distinct()
    missing = g.join(p, id_col, "left_anti").withColumn("kind", F.lit("missing_id"))
    extra = p.join(g, id_col, "left_anti").withColumn("kind", F.lit("extra_id"))
    return missing.unionByName(extra).select("kind", id_col)


def raise_on_mismatch(violations: DataFrame) -> None:
    """Raise with a few examples when the violation table is not empty."""
    rows = violations.limit(5).collect()
    if rows:
        raise ValueError("prediction ids do not match gold ids, e.g. " + ", ".join(map(str, rows)))


def categorize(labels: Column, mapping: list[tuple[str, str]], sep: str = "_") -> Column:
    """Label list -> categories joined by ``sep``, in label order; a label in
    several categories contributes each (in mapping order); unknown labels are
    skipped.  The mapping is a bounded dimension, applied as a literal map –
    no join, no shuffle."""
    by_label: dict[str, list[str]] = {}
    for lab, cat in mapping:
        by_label.setdefault(lab, []).append(cat)
    m = F.create_map(*[x for lab, cats in by_label.items() for x in (F.lit(lab), F.array(*[F.lit(c) for c in cats]))])
    cats = F.flatten(F.transform(labels, lambda x: F.coalesce(F.element_at(m, x), F.array().cast("array<string>"))))
    return F.array_join(cats, sep)


def attach(left: DataFrame, right: DataFrame, id_col: str = "id", how: str = "inner") -> DataFrame:
    """Attach rows of another table by id (never by position)."""
    return left.join(right, id_col, how)


def error_table(texts: DataFrame, sets: DataFrame, id_col: str = "id", text_col: str = "text",
                gold_col: str = "gold", pred_col: str = "pred") -> DataFrame:
    """Rows whose sets differ, with text, actual, predicted, missed and spurious labels."""
    j = sets.join(texts.select(id_col, text_col), id_col)
    g, p = canon(F.col(gold_col)), canon(F.col(pred_col))
    return j.filter(~(g == p)).select(
        id_col, text_col, g.alias("actual"), p.alias("predicted"),
        F.array_except(g, p).alias("missed"), F.array_except(p, g).alias("spurious"))
