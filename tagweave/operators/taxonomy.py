"""Label-DAG operators over an edge table ``(parent string, child string)``.

The taxonomy is an input DataFrame of any size and depth.  The closure is built
by joining the paths found so far with themselves, so that their length doubles
each round and the number of rounds follows the logarithm of the DAG's depth.  Label tables are joined to
the closure with a size-checked broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.fixed import ROOT
from tagweave.session import cut_lineage, sized_broadcast


def nodes(edges: DataFrame, root: str = ROOT) -> DataFrame:
    """All nodes except the root."""
    both = edges.select(F.col("parent").alias("node")).union(edges.select(F.col("child").alias("node")))
    return both.filter(F.col("node") != root).distinct()


def leaves(edges: DataFrame) -> DataFrame:
    """Nodes without children (F2), each once."""
    kids = edges.select(F.col("child").alias("node")).distinct()
    return kids.join(edges.select(F.col("parent").alias("node")), "node", "left_anti")


def internal_nodes(edges: DataFrame) -> DataFrame:
    """Nodes with children, root included."""
    return edges.select(F.col("parent").alias("node")).distinct()


def ancestor_pairs(edges: DataFrame, root: str = ROOT, keep_root: bool = False) -> DataFrame:
    """All (node, ancestor, distance) pairs, root excluded, distance = shortest path.

    After round r every shortest path of up to 2^r edges is known; a round that
    changes nothing ends it.  A cycle shows as a node that reaches itself and raises.
    """
    found = cut_lineage(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"),
                                     F.lit(1).cast("bigint").alias("distance")).distinct())
    state = None
    while True:
        now = found.agg(F.count(F.lit(1)), F.sum("distance"), F.max(F.col("node") == F.col("ancestor"))).first()
        if now[2]:
            raise ValueError("taxonomy has a cycle")
        if tuple(now) == state:
            break
        state = tuple(now)
        a, b = found.alias("a"), found.alias("b")
        longer = a.join(b, F.col("a.ancestor") == F.col("b.node")).select(
            "a.node", "b.ancestor", (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        found = cut_lineage(found.unionByName(longer).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")))
    found = found.withColumn("distance", F.col("distance").cast("int"))
    return found if keep_root else found.filter(F.col("ancestor") != root)


def closure(edges: DataFrame, root: str = ROOT, pairs: DataFrame | None = None) -> DataFrame:
    """Ancestor-or-self pairs (node, ancestor), root excluded (the fill of F9).

    ``pairs`` may pass already computed ancestor pairs (root excluded)."""
    pairs = ancestor_pairs(edges, root) if pairs is None else pairs
    selfs = nodes(edges, root).select("node", F.col("node").alias("ancestor"))
    return selfs.unionByName(pairs.select("node", "ancestor")).distinct()


def expand_long(labels: DataFrame, clo: DataFrame, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """Long label table -> distinct (id, node) rows of its ancestor-or-self closure.

    Labels outside the taxonomy keep only themselves (they have no closure row).
    """
    clo = sized_broadcast(clo).select(F.col("node").alias("_n"), F.col("ancestor").alias("_a"))
    j = labels.select(id_col, label_col).join(clo, F.col(label_col) == F.col("_n"), "left")
    return j.select(id_col, F.coalesce("_a", label_col).alias(label_col)).distinct()


def add_ancestors(labels: DataFrame, pairs: DataFrame, id_col: str = "id", label_col: str = "label",
                  only: list[str] | None = None) -> DataFrame:
    """Labels plus (a subset of) their proper ancestors, distinct (F7 / F8 long form)."""
    p = sized_broadcast(pairs).select(F.col("node").alias("_n"), F.col("ancestor").alias("_a"))
    if only is not None:
        p = p.filter(F.col("_a").isin(only))
    extra = labels.select(id_col, label_col).join(p, F.col(label_col) == F.col("_n")).select(
        id_col, F.col("_a").alias(label_col))
    return labels.select(id_col, label_col).unionByName(extra).distinct()


def add_parents(labels: DataFrame, edges: DataFrame, id_col: str = "id", label_col: str = "label",
                root: str = ROOT) -> DataFrame:
    """Labels plus their immediate parents, root excluded."""
    e = sized_broadcast(edges).filter(F.col("parent") != root).select(
        F.col("child").alias("_c"), F.col("parent").alias("_p"))
    extra = labels.select(id_col, label_col).join(e, F.col(label_col) == F.col("_c")).select(
        id_col, F.col("_p").alias(label_col))
    return labels.select(id_col, label_col).unionByName(extra).distinct()


def direct_parents(labels: DataFrame, edges: DataFrame, label_col: str = "label") -> DataFrame:
    """Each label row joined to its immediate parents, root included."""
    e = sized_broadcast(edges).select(F.col("child").alias("_c"), F.col("parent"))
    return labels.join(e, F.col(label_col) == F.col("_c")).drop("_c")


def leaf_only(labels: DataFrame, edges: DataFrame, label_col: str = "label") -> DataFrame:
    """Drop internal-node labels from a long label table."""
    inner = sized_broadcast(internal_nodes(edges).withColumnRenamed("node", "_i"))
    return labels.join(inner, F.col(label_col) == F.col("_i"), "left_anti")
