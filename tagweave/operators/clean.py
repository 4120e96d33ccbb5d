"""Row cleaning, projection, sampling and ordering operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.functions.seeded import seeded_int
from tagweave.session import cut_lineage


def drop_null_rows(df: DataFrame, subset: list[str]) -> DataFrame:
    """B1."""
    return df.dropna(subset=subset)


def project(df: DataFrame, cols: list[str]) -> DataFrame:
    """B2: keep only ``cols`` (pruned at the scan by the optimizer)."""
    return df.select(*cols)


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row per key in ``order`` (file order = a position column).

    Written as ``min_by`` in a hash aggregate rather than a window: partial
    aggregation collapses a hot key to one row per map task before the
    shuffle, so a key holding a third of all rows never lands whole in one
    task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def dedupe_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """C1 helper: keep the last row per key (duplicate id -> last record wins)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def dup_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that repeat an earlier key (all but the first per key)."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"),
                   F.count(F.lit(1)).cast("bigint").alias("n_distinct"))


def null_audit(df: DataFrame, col: str) -> DataFrame:
    """B5."""
    return df.filter(F.col(col).isNull())


def fill_none(df: DataFrame, cols: list[str], value: str = "None") -> DataFrame:
    """B6."""
    return df.na.fill(value, cols)


def any_col_contains(df: DataFrame, needle: str, cols: list[str] | None = None) -> DataFrame:
    """Rows where any column, as text, contains ``needle`` literally."""
    cols = cols or df.columns
    cond = None
    for c in cols:
        x = F.coalesce(F.col(c).cast("string").contains(needle), F.lit(False))
        cond = x if cond is None else (cond | x)
    return df.filter(cond)


def label_rows(df: DataFrame, labels_col: str, needle: str, exact: bool = False) -> DataFrame:
    """Rows whose label list contains ``needle`` (substring of the comma-join, or exact member)."""
    if exact:
        return df.filter(F.array_contains(labels_col, needle))
    return df.filter(F.array_join(labels_col, ",").contains(needle))


def row_feature(df: DataFrame, name: str, fn: Callable[..., Column], cols: list[str]) -> DataFrame:
    """Derive a column with a user callback over Columns (stays JVM-side).

    For logic that is not expressible as Columns pass a ``pandas_udf``; it is
    applied the same way, batch-wise through Arrow."""
    return df.withColumn(name, fn(*[F.col(c) for c in cols]))


def with_row_index(df: DataFrame, order: list[str], name: str = "row_id", offset: int = 0) -> DataFrame:
    """Dense 0-based position in ``order`` plus ``offset``, computed distributed.

    Range-partition + sort, written once to the checkpoint folder so both
    passes see identical partitions; per-partition counts (one row per
    partition) give each partition its start; the id is start + position in
    partition.  No single-partition global window over the data."""
    s = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order))
    s = s.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    j = s.join(F.broadcast(starts), "_pid")
    idx = F.col("_start") + (F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)) + F.lit(offset)
    return j.withColumn(name, idx.cast("bigint")).drop("_pid", "_mid", "_start")


def with_running_total(df: DataFrame, order: list[str], weight: str, name: str = "running") -> DataFrame:
    """Inclusive running sum of ``weight`` in ``order`` over the whole frame, distributed.

    Same scheme as ``with_row_index``: range-partitioned sort written once to
    the checkpoint folder, per-partition totals (one row per partition) give
    each partition its start, and the running sum inside a partition is a
    window over that partition's own rows (bounded by the range partition
    size, never by a key)."""
    s = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order))
    s = s.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    totals = s.groupBy("_pid").agg(F.sum(weight).alias("_t"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_pid", F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = s.join(F.broadcast(starts), "_pid")
    return j.withColumn(name, F.col("_start") + F.sum(weight).over(inner)).drop("_pid", "_mid", "_start")


def holdout_split(df: DataFrame, id_col: str, test_pct: int = 10, seed: int = 42) -> DataFrame:
    """Stable train / validation split by an arithmetic bucket of the id.

    Independent of partitioning and reproducible in any engine."""
    bucket = F.pmod(F.col(id_col) * 7919 + seed, F.lit(100))
    return df.withColumn("holdout", F.when(bucket < 100 - test_pct, "train").otherwise("validation"))


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = 42, pos_col: str | None = None) -> DataFrame:
    """Deterministic pseudo-random order (distributed range sort on a
    seeded hash of the id, ties by id).  With ``pos_col`` every row also gets
    its 0-based position in that order (the permutation, computed
    distributed by ``with_row_index``)."""
    h = seeded_int(F.col(id_col), seed=seed)
    if pos_col:
        return with_row_index(df.withColumn("_h", h), ["_h", id_col], pos_col).drop("_h")
    return df.withColumn("_h", h).orderBy("_h", id_col).drop("_h")


def head_n(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First n rows in ``order`` (top-k plan: per-partition top-n, then merge)."""
    return df.orderBy(*order).limit(n)


def split_counts(df: DataFrame, split_col: str = "split") -> DataFrame:
    """B18."""
    return df.groupBy(split_col).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
