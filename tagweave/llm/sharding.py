"""Sharding by a k-d tree over the documents' metadata, with DataFrame functions only.

A node of the tree stands for some of the shards and splits in two: its widest
metadata dimension (extent over the extent in the whole table) is cut at the weighted
median, or, where the shards don't halve evenly, at the quantile of the smaller half's
shards.  Leaves are reached when a node stands for one shard, so each holds about
total / shards bytes.  All nodes of a depth split at once.

Medians are distributed: points are range-sorted by (node, value), sums per task and
node say which task holds a node's median, and only that task's rows of the node get
running sums.  Node tables have at most one row per shard.

Equal texts are one point, at the metadata of their first row, as long as they are
light; heavy groups (a third of all rows, say) are cut into pieces of a small share of
a shard by a distributed running sum.  Pieces of a group stand next to each other in
every dimension, so a cut goes through a group only where a median falls into it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.common import materialize, positions, same_keys, shuffle_tasks
from tagweave.session import sized_broadcast

#: Bytes that a document takes besides its text.
OVERHEAD = 16
#: Heaviest piece of a group, as parts of a shard: one 64th, or as much as the largest
#: document (cuts can't be finer anyway) if that is under one 16th.
PIECE_PARTS, LARGEST_PIECE_PARTS = 64, 16
#: Sums times shards: wider than 64 bits.
BIG = "decimal(38,0)"


def measured(docs: DataFrame, id_col: str, text_col: str, dims: list[str]) -> DataFrame:
    """``doc_id, size, text_crc32, grp`` (digest of the text) and ``dim_0 ..``: the metadata,
    strings as they are, other types as long (null: one below zero)."""
    cols = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")]
    for i, d in enumerate(dims):
        c = F.col(f"`{d}`")
        text = isinstance(docs.schema[d].dataType, T.StringType)
        cols.append((c if text else F.coalesce(c.cast("long"), F.lit(-1))).alias(f"dim_{i}"))
    rows = docs.select(*cols)
    return rows.select("doc_id", (F.octet_length("text") + OVERHEAD).cast("long").alias("size"),
                       F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.unhex(F.sha2("text", 256)).alias("grp"),
                       *[f"dim_{i}" for i in range(len(dims))])


def ranked(points: DataFrame, dim: str) -> DataFrame:
    """The string column ``dim`` replaced by its place among the distinct values, null first."""
    places = positions(points.select(dim).distinct(), [], [dim], "shard-values")
    p, v = points.alias("p"), sized_broadcast(places).alias("v")
    joined = p.join(v, same_keys("p", "v", [dim]))
    return joined.select(*[F.col(f"p.{c}") for c in points.columns if c != dim], F.col("v.pos").alias(dim))


def point_table(rows: DataFrame, piece_bytes: int, dims: int) -> tuple[DataFrame, DataFrame]:
    """(rows with ``piece``, points): a point is a light group, or a piece of a heavy one."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *[f"dim_{i}" for i in range(dims)])).alias("first")
    groups = materialize(rows.groupBy("grp").agg(F.sum("size").alias("weight"), first), "shard-groups")
    heavy = groups.filter(F.col("weight") > piece_bytes).select("grp")  # at most total / piece_bytes
    heavy = F.broadcast(heavy)
    cut = positions(rows.join(heavy, "grp", "left_semi"), ["grp"], ["doc_id"], "shard-heavy", weight="size")
    cut = cut.withColumn("piece", F.expr(f"pos div {piece_bytes}")).drop("pos")
    light = rows.join(heavy, "grp", "left_anti").withColumn("piece", F.lit(0).cast("long"))
    place = [F.col(f"first.dim_{i}").alias(f"dim_{i}") for i in range(dims)]
    pieces = cut.groupBy("grp", "piece").agg(F.sum("size").alias("weight"))
    heavy_points = pieces.join(F.broadcast(groups.filter(F.col("weight") > piece_bytes).select("grp", "first")), "grp")
    light_points = groups.filter(F.col("weight") <= piece_bytes).withColumn("piece", F.lit(0).cast("long"))
    points = light_points.select("grp", "piece", "weight", *place).unionByName(
        heavy_points.select("grp", "piece", "weight", *place))
    return light.unionByName(cut), points


def split(points: DataFrame, dims: int, spans: list[int]) -> DataFrame:
    """One depth of the tree: points with ``node, shards, first`` (number of the first shard) anew."""
    here = points.filter("shards > 1")
    extents = [F.struct(((F.max(f"dim_{i}") - F.min(f"dim_{i}")).cast("double") / F.lit(float(max(1, spans[i])))).alias("wide"),
                        F.lit(-i).alias("minus_dim")) for i in range(dims)]  # of equal extents the first dimension
    nodes = here.groupBy("node", "shards").agg(F.array_max(F.array(*extents))["minus_dim"].alias("minus_dim"),
                                               F.sum("weight").alias("total"))
    nodes = F.broadcast(materialize(nodes, "shard-nodes"))  # at most one row a shard
    value = F.element_at(F.array(*[F.col(f"dim_{i}") for i in range(dims)]), 1 - F.col("minus_dim"))
    order = ["node", "value", "grp", "piece"]
    ranged = here.join(nodes.select("node", "minus_dim"), "node").withColumn("value", value).drop("minus_dim")
    ranged = materialize(ranged.repartitionByRange(shuffle_tasks(points.sparkSession), *order)
                         .withColumn("part", F.spark_partition_id()), "shard-ranged")

    # the task that holds each node's median, and the running sums of that task's points of the node
    sums = ranged.groupBy("node", "part").agg(F.sum("weight").alias("inside"))
    before = F.sum("inside").over(Window.partitionBy("node").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("before", F.coalesce(before, F.lit(0))).join(nodes.select("node", "shards", "total"), "node")
    goal = F.col("total").cast(BIG) * F.expr("shards div 2")  # against sums times shards: whole numbers throughout
    times = F.col("shards").cast(BIG)
    at = (F.col("before") * times < goal) & ((F.col("before") + F.col("inside")) * times >= goal)
    medians = F.broadcast(materialize(sums.filter(at).select("node", "part", "before", "total"), "shard-medians"))
    upto = F.col("before") + F.sum("weight").over(
        Window.partitionBy("node").orderBy("value", "grp", "piece").rowsBetween(Window.unboundedPreceding, 0))
    near = ranged.join(medians, ["node", "part"]).withColumn("upto", upto)
    # left are the points whose middle lies at the goal or before it: the nearest border is cut
    low = (F.col("upto") * 2 - F.col("weight")) * times <= goal * 2
    cuts = near.filter(low).groupBy("node").agg(F.max(F.struct("value", "grp", "piece")).alias("cut"))
    cuts = medians.select("node", F.col("part").alias("cut_part")).join(cuts, "node", "left")
    cuts = F.broadcast(materialize(cuts, "shard-cuts"))

    left = (F.col("part") < F.col("cut_part")) | ((F.col("part") == F.col("cut_part"))
                                                  & F.coalesce(F.struct("value", "grp", "piece") <= F.col("cut"), F.lit(False)))
    half = F.expr("shards div 2")
    keep = ["grp", "piece", "weight", *[f"dim_{i}" for i in range(dims)]]
    moved = ranged.join(cuts, "node").withColumn("left", left).select(
        *keep, (F.col("node") * 2 + F.when(F.col("left"), 0).otherwise(1)).alias("node"),
        F.when(F.col("left"), half).otherwise(F.col("shards") - half).alias("shards"),
        F.when(F.col("left"), F.col("first")).otherwise(F.col("first") + half).alias("first"))
    done = points.filter("shards = 1").select(*keep, (F.col("node") * 2).alias("node"), "shards", "first")
    return materialize(moved.unionByName(done), "shard-split")


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
                    dims: tuple[str, ...] = ("source", "lang", "n_chars")) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, shard, slot``.

    ``size`` is the text's UTF-8 bytes (null: none) plus 16, ``text_crc32`` the unsigned
    CRC-32 of these bytes.  The shards' bytes are as near to equal as the cuts' borders
    allow: a point weighs at most a 64th of a shard, a 16th where single documents are as
    heavy, or one document.  ``slot`` counts a shard's documents from 0 by id.

    A group of equal texts (null and empty ones are equal) that weighs no more than a
    point stays in one shard, a heavier one in as few as its weight and one median need.
    A null id sorts first and has its slot; null metadata sorts before other values.  Rows
    that repeat in every column have a slot each.  With fewer points than shards some
    shards are empty; an empty table gives an empty result.  Further columns are ignored.
    """
    rows = materialize(measured(docs, id_col, text_col, list(dims)), "shard-rows")
    total, largest = rows.agg(F.sum("size"), F.max("size")).first()
    target = (total or 0) // shards
    piece_bytes = max(1, target // PIECE_PARTS, min(largest or 0, target // LARGEST_PIECE_PARTS))
    rows, points = point_table(rows, piece_bytes, len(dims))
    for i, t in enumerate(dims):
        if isinstance(docs.schema[t].dataType, T.StringType):
            points = ranked(points, f"dim_{i}")
    start = {"node": 0, "shards": shards, "first": 0}
    points = materialize(points.withColumns({k: F.lit(v).cast("long") for k, v in start.items()}), "shard-points")
    extents = points.agg(*[F.coalesce(F.max(f"dim_{i}") - F.min(f"dim_{i}"), F.lit(0)) for i in range(len(dims))]).first()
    depth = (shards - 1).bit_length()
    for _ in range(depth):
        points = split(points, len(dims), list(extents))
    placed = rows.join(points.select("grp", "piece", F.col("first").alias("shard")), ["grp", "piece"])
    placed = placed.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"))
    return positions(placed, ["shard"], ["doc_id", "text_crc32", "size"], "shard-slots").withColumnRenamed("pos", "slot")
