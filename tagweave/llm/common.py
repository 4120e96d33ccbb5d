"""Shared helpers: materialised steps, clash-free column names, row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.session import payload_bytes, read_table, scratch_path, sized_broadcast

__all__ = ["read_table", "materialize", "narrow", "positions", "same_keys", "shuffle_tasks", "small_enough", "stable_rank"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Upper bounds of anything that is sent to every task: rows, and their payload.
SMALL_ROWS = 500_000
SMALL_BYTES = 32 << 20


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and
    values that depend on task layout (partition ids, sampled ranges) are fixed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Select ``new_name=source_column`` pairs only, so that further columns of
    the input can never clash with the names an operator works with."""
    return df.select(*[F.col(f"`{src}`").alias(new) for new, src in columns.items()])


def shuffle_tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_enough(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> bool:
    """Whether a materialised frame may be sent to every task: at most ``max_rows`` rows
    and ``max_bytes`` of payload.

    The count comes from Parquet footers; the bytes of fixed-width rows follow from it, those of
    strings and arrays are summed in the tasks.
    """
    rows = df.count()
    if rows > max_rows:
        return False
    fixed = not any(isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)) for f in df.schema)
    return rows * 8 * len(df.columns) <= max_bytes if fixed else payload_bytes(df) <= max_bytes


def stable_rank(seed: str, *cols):
    """A hash-random sort key, the same in every run and in every SQL engine."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols]))


def same_keys(left: str, right: str, names: list[str]) -> Column:
    """Null-safe equality of the named columns of two aliased frames."""
    same = F.lit(True)
    for c in names:
        same = same & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return same


def positions(df: DataFrame, group: list[str], order: list[str], name: str, weight: str | None = None) -> DataFrame:
    """Adds ``pos``: the row's place from 0 within its group by ``order`` (nulls first),
    or, with a ``weight`` column, the sum of the weights before it.

    Rows are range-sorted by (group, order), so a large group spans as many tasks
    as its rows need.  The places inside a task come from the written row order
    (weights: from a window over one task's rows of one group), those before it
    from one count per task and group, at most tasks + groups rows.
    """
    keys = [*group, *order]
    ranged = df.repartitionByRange(shuffle_tasks(df.sparkSession), *keys).sortWithinPartitions(*keys)
    ranged = materialize(ranged.withColumn("__row", F.monotonically_increasing_id()), name)
    ranged = ranged.withColumn("__part", F.shiftrightunsigned("__row", 33))
    parts = ranged.groupBy("__part", *group).agg(
        F.min("__row").alias("__first"), F.sum(weight if weight else F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = materialize(parts.withColumn("__before", F.coalesce(before, F.lit(0))), f"{name}-parts")
    if weight:
        inside = Window.partitionBy("__part", *group).orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
        ranged = ranged.withColumn("__inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    else:
        ranged = ranged.withColumn("__inside", F.col("__row"))
    r, p = ranged.alias("r"), sized_broadcast(parts, SMALL_ROWS, SMALL_BYTES).alias("p")
    pos = F.col("p.__before") + F.col("r.__inside") - (F.lit(0) if weight else F.col("p.__first"))
    out = r.join(p, same_keys("r", "p", ["__part", *group]))
    return out.select(*[F.col(f"r.{c}") for c in df.columns], pos.cast("long").alias("pos"))
