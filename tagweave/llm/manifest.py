"""Merkle manifest of a dataset by slot pivots.

Every document is a leaf: the digest of its fields.  The leaves of one subtree key
(``lang``) stand in id order.  A level of the tree is one aggregation: grouped by
(tree, position div fanout), one conditional aggregate a slot spreads a parent's
children into ``fanout`` columns.  Concatenated, the columns hash to the parent;
without the child's own column they are the child's siblings.  The subroots are
the leaves of one more tree of the same kind, whose root stands for the dataset.

Proofs go down the written levels: a child's path is its own step (siblings left
and right of it) before its parent's path.  The lowest level's slots carry the
documents, so documents themselves are never joined with their parents.

A group of an aggregation has at most ``fanout`` rows, and keys of joins occur once
a side, so no key is hot, however large a subtree is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import LOWER, UPPER, materialize, narrow, positions, same_keys
from tagweave.session import sized_broadcast

FANOUT = 8
#: A tree of this many levels holds any number of rows that a 64-bit id can count.
MAX_HEIGHT = 21


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after the other; null parts are left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def height_of(n: Column, fanout: int) -> Column:
    """Levels above ``n`` leaves: the least h with fanout ** h >= n."""
    powers = [fanout**k for k in range(MAX_HEIGHT) if fanout**k < 1 << 63]
    return F.size(F.filter(F.array(*[F.lit(p) for p in powers]), lambda p: p < n))


@dataclass
class Forest:
    """Trees of one manifest.  ``nodes``: the leaves, ``tree, height, pos, node`` (a struct
    that holds ``digest``).  ``levels``: from the lowest up, ``tree, height, pos,
    slot_0 .. slot_7, digest``; a slot is a child's ``node``.  ``roots``: ``tree, digest``."""

    nodes: DataFrame
    levels: list[DataFrame]
    roots: DataFrame
    fanout: int


def grow(nodes: DataFrame, fanout: int = FANOUT) -> Forest:
    """All levels of all trees; ``nodes`` has ``tree, height, pos, node``, written already."""
    highest = nodes.agg(F.max("height")).first()[0] or 0
    levels, below = [], nodes
    roots = nodes.filter("height = 0").select("tree", F.col("node.digest").alias("digest"))
    slots = [F.expr(f"max(CASE WHEN pos % {fanout} = {j} THEN node END) AS slot_{j}") for j in range(fanout)]
    parent = F.expr(f"pos div {fanout} AS parent")
    kids = ", ".join(f"slot_{j}.digest" for j in range(fanout))
    for k in range(1, highest + 1):
        level = below.filter(f"height >= {k}").groupBy("tree", "height", parent).agg(*slots)
        level = level.withColumnRenamed("parent", "pos").selectExpr("*", f"sha2(concat_ws('', {kids}), 256) AS digest")
        level = materialize(level, f"manifest-level-{k}")
        levels.append(level)
        roots = roots.unionByName(level.filter(F.col("height") == k).select("tree", "digest"))
        below = level.select("tree", "height", "pos", F.struct("digest").alias("node"))
    return Forest(nodes, levels, roots, fanout)


def paths(forest: Forest, top: DataFrame) -> DataFrame:
    """``tree, pos, node, path`` of every leaf: ``path`` lists the steps to the root as
    ``left, right`` (concatenated digests of the siblings on either side), lowest first,
    followed by the tree's own path in ``top`` (``tree, path``), which goes on from its root."""
    def joined(which):
        return "concat_ws('', " + ", ".join(["''", *(f"slot_{i}.digest" for i in which)]) + ")"

    n, above = forest.fanout, None
    cells = ", ".join(f"named_struct('pos', pos * {n} + {j}, 'node', slot_{j}, 'left', {joined(range(j))}, "
                      f"'right', {joined(range(j + 1, n))})" for j in range(n))
    for k in range(len(forest.levels), 0, -1):
        level = forest.levels[k - 1]
        rooted = level.filter(F.col("height") == k).join(top, "tree")
        if above is not None:
            rooted = rooted.unionByName(level.filter(F.col("height") > k).join(above.select("tree", "pos", "path"), ["tree", "pos"]))
        children = rooted.select("tree", "height", "path", F.expr(f"explode(array({cells})) AS c")).filter("c.node is not null")
        above = children.select("tree", "height", F.col("c.pos").alias("pos"), F.col("c.node").alias("node"),
                                F.concat(F.array(F.struct("c.left", "c.right")), F.col("path")).alias("path"))
        if k > 1:
            above = materialize(above.drop("node"), f"manifest-paths-{k}")
    single = forest.nodes.filter("height = 0").join(top, "tree").select("tree", "pos", "node", "path")
    return single if above is None else single.unionByName(above.select("tree", "pos", "node", "path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def siblings(path: Column) -> Column:
    """All siblings' digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


@dataclass
class Manifest:
    """``leaves``: ``doc_id, leaf, altered, subroot, path`` of every document;
    ``subroots``: ``tree`` key, its number and digest; ``root``: the dataset's digest
    (null for an empty table)."""

    leaves: DataFrame
    subroots: DataFrame
    root: str | None


def build_manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", tree_col: str = "lang",
                   altered: dict[str, Column] | None = None, fanout: int = FANOUT) -> Manifest:
    """The manifest over ``fields`` of every row.

    Leaves stand by id within their ``tree_col`` value, rows that repeat an id by their
    digest, null ids first; a null ``tree_col`` is a tree of its own, before the others.
    Rows equal in all fields are leaves of their own.  ``altered`` gives other
    expressions for some fields: their leaf is kept as ``altered``, as a reader would
    compute it from changed data.  An empty table has no root and no leaves.  Columns
    not named are ignored, whatever their names.
    """
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{tree_col}`").alias("key"),
                         digest(*[field(F.col(f"`{c}`")) for c in fields]).alias("leaf"),
                         digest(*[field((altered or {}).get(c, F.col(f"`{c}`"))) for c in fields]).alias("altered"))
    leaves = positions(picked, ["key"], ["doc_id", "leaf"], "manifest-leaves")
    trees = materialize(leaves.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "manifest-keys")
    trees = positions(trees, [], ["key"], "manifest-trees")
    trees = materialize(trees.select("key", F.col("pos").alias("tree"), "n", height_of(F.col("n"), fanout).alias("height")), "manifest-heights")
    l, t = leaves.alias("l"), sized_broadcast(trees).alias("t")
    nodes = l.join(t, same_keys("l", "t", ["key"])).select(
        "t.tree", "t.height", "l.pos", F.struct(F.col("leaf").alias("digest"), "doc_id", "altered").alias("node"))
    lower = grow(materialize(nodes, "manifest-nodes"), fanout)
    subroots = materialize(trees.select("tree", "key").join(lower.roots, "tree"), "manifest-subroots")
    count = subroots.count()
    upper = grow(subroots.select(F.lit(0).cast("long").alias("tree"), height_of(F.lit(count), fanout).alias("height"),
                                 F.col("tree").alias("pos"), F.struct("digest").alias("node")), fanout)
    root = upper.roots.first()
    ends = F.array().cast("array<struct<left:string,right:string>>")
    top = paths(upper, subroots.limit(1).select(F.lit(0).cast("long").alias("tree"), ends.alias("path")))
    top = materialize(top.select(F.col("pos").alias("tree"), F.col("node.digest").alias("subroot"), "path"), "manifest-top")
    found = paths(lower, top.select("tree", "path"))
    out = found.join(sized_broadcast(top.select("tree", "subroot")), "tree").select(
        "node.doc_id", F.col("node.digest").alias("leaf"), "node.altered", "subroot", "path")
    return Manifest(out, subroots, root["digest"] if root else None)


def verify_documents(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source",
                     chars_col: str = "n_chars", text_col: str = "text", tamper_mod: int = 3) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Where ``tamper_mod`` divides the unsigned CRC-32 of the decimal id, the reader's copy
    of the text has A-Z in lower case; ``folded_root`` is what that copy and the original
    siblings lead to, ``verified`` whether this is the root.  A null id is never tampered
    with, a null text has nothing to change.  An empty table gives an empty result.
    """
    plain = narrow(docs, doc_id=id_col, source=source_col, lang=lang_col, n_chars=chars_col, text=text_col)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % tamper_mod == 0, F.lit(False))
    changed = {"text": F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))}
    m = build_manifest(plain, ["doc_id", "source", "lang", "n_chars", "text"], altered=changed)
    rows = m.leaves.withColumn("root", F.lit(m.root).cast("string")).withColumn("folded_root", fold(F.col("altered"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
