"""Set operations over splits and label vocabularies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.session import sized_broadcast


def union_splits(parts: dict[str, DataFrame], split_col: str = "split") -> DataFrame:
    """Union by name, missing columns null, provenance in ``split_col``."""
    frames = [df.withColumn(split_col, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def label_vocab(df: DataFrame, array_cols: list[str], label_col: str = "label") -> DataFrame:
    """D3: distinct labels over one or more array columns (explode + distinct,
    partial aggregation before the shuffle); sorted by code point."""
    parts = [df.select(F.explode(c).alias(label_col)) for c in array_cols]
    return reduce(lambda a, b: a.union(b), parts).distinct().orderBy(label_col)


def vocab_minus(vocab: DataFrame, remove: list[str], label_col: str = "label") -> DataFrame:
    """Set difference with a list of labels."""
    return vocab.filter(~F.col(label_col).isin(remove))


def unknown_labels(long: DataFrame, vocab: DataFrame, label_col: str = "label") -> DataFrame:
    """Labels outside the vocabulary with their row counts."""
    unk = long.join(sized_broadcast(vocab.select(label_col).distinct()), label_col, "left_anti")
    return unk.groupBy(label_col).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


def known_only(long: DataFrame, vocab: DataFrame, label_col: str = "label") -> DataFrame:
    """Keep labels inside the vocabulary."""
    return long.join(sized_broadcast(vocab.select(label_col).distinct()), label_col, "left_semi")
