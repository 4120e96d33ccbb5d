"""Session helpers: building a session, the shared scratch folder, and
size-checked broadcasting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sides below this many rows are broadcast; anything larger falls back to a
# shuffle join chosen by the optimizer (AQE may still convert it at runtime).
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 256 << 20


def build_session(master: str = "local[*]", partitions: int = 8, app: str = "tagweave") -> SparkSession:
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # coalesce shuffle partitions to the advisory size (64 MiB), not to the
        # default parallelism: no near-empty tasks on small stages, right-sized
        # partitions on large ones
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TAGWEAVE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and is only read here.  Only
    when it is unset on a local master (tests) a private folder is created and
    set; on any other master a folder of one machine would lose rows, so it raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not current:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
            current = tempfile.mkdtemp(prefix="tagweave-ckpt-")
        sc.setCheckpointDir(current)
        current = sc.getCheckpointDir() or current
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tagweave/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared folder; survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _row_bytes(df: DataFrame) -> Column:
    """Upper estimate of a row's payload: string / binary bytes, 8 bytes per
    array element (plus the element bytes for string arrays), 8 per scalar."""
    parts = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif isinstance(t, T.ArrayType):
            b = F.size(c) * 8
            if isinstance(t.elementType, T.StringType):
                b = b + F.coalesce(F.octet_length(F.array_join(c, "")), F.lit(0))
            parts.append(F.greatest(b, F.lit(0)))
        else:
            parts.append(F.lit(8))
    total = F.lit(0).cast("bigint")
    for b in parts:
        total = total + b.cast("bigint")
    return total


def payload_bytes(df: DataFrame) -> int:
    """Upper estimate of the rows' payload, summed in the tasks.  Structs and maps count by
    the length of their text form."""
    flat = df.select(*[F.to_json(F.struct(F.col(f"`{f.name}`"))).alias(f.name)
                       if isinstance(f.dataType, (T.StructType, T.MapType))
                       or (isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.StructType, T.ArrayType, T.MapType)))
                       else F.col(f"`{f.name}`") for f in df.schema])
    return flat.agg(F.coalesce(F.sum(_row_bytes(flat)), F.lit(0))).first()[0]


def sized_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only if it is proven small: at most ``max_rows`` rows
    and at most ``max_bytes`` payload bytes, both summed by one probe job in
    which every task hands on one row.  Beyond either bound the frame is
    returned unchanged, so the join becomes a shuffle join (sort-merge or
    shuffled hash, AQE decides; skew join splitting is on).

    The verdict is remembered on the frame object, so a long-lived dimension
    frame (the checkpointed taxonomy tables) is probed once per application;
    the hint survives later projections and filters of that frame.
    """
    key = (max_rows, max_bytes)
    seen = getattr(df, "_tagweave_small", None)
    if seen is None or seen[0] != key:
        n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).first()
        seen = (key, n <= max_rows and size <= max_bytes)
        df._tagweave_small = seen
    return F.broadcast(df) if seen[1] else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
