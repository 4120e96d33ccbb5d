"""Taxonomy queries (F1-F11), each applied to the derived label tables so the
work grows with the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.fixed import ROOT, SELECTED_INTERNALS
from tagweave.operators import taxonomy as tx
from tagweave.plans import fixtures as fx
from tagweave.plans.registry import register
from tagweave.plans.sqlbase import q, sql
from tagweave.session import sized_broadcast


@register("dag_nodes", sql(None, """
SELECT n.node, count(DISTINCT gc.doc_id) AS n_docs FROM nodes n LEFT JOIN goldc gc ON gc.label = n.node
GROUP BY n.node"""))
def dag_nodes(spark, sf_dir):
    t = fx.taxonomy(spark)
    gc = tx.expand_long(fx.gold_long(spark, sf_dir), t["closure"], "doc_id")
    used = gc.groupBy(F.col("label").alias("node")).agg(F.countDistinct("doc_id").alias("n_docs"))
    return tx.nodes(t["edges"]).join(used, "node", "left").select(
        "node", F.coalesce("n_docs", F.lit(0)).cast("bigint").alias("n_docs"))


@register("dag_leaves", sql(None, """
SELECT lf.leaf, count(g.doc_id) AS n_gold
FROM (SELECT DISTINCT child AS leaf FROM edges WHERE child NOT IN (SELECT parent FROM edges)) lf
LEFT JOIN gold g ON g.label = lf.leaf GROUP BY lf.leaf"""))
def dag_leaves(spark, sf_dir):
    t = fx.taxonomy(spark)
    g = fx.gold_long(spark, sf_dir).groupBy(F.col("label").alias("leaf")).agg(F.count(F.lit(1)).alias("n_gold"))
    lv = tx.leaves(t["edges"]).select(F.col("node").alias("leaf"))
    return lv.join(g, "leaf", "left").select("leaf", F.coalesce("n_gold", F.lit(0)).cast("bigint").alias("n_gold"))


@register("dag_parents", sql(None, """
SELECT i.node, (SELECT count(*) FROM edges e WHERE e.parent = i.node) AS n_children,
       count(g.doc_id) AS n_gold_below
FROM (SELECT DISTINCT parent AS node FROM edges) i
LEFT JOIN ancall a ON a.ancestor = i.node
LEFT JOIN gold g ON g.label = a.node
GROUP BY i.node"""))
def dag_parents(spark, sf_dir):
    t = fx.taxonomy(spark)
    kids = t["edges"].groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).cast("bigint").alias("n_children"))
    anc = sized_broadcast(t["anc_all"]).select(F.col("node").alias("label"), F.col("ancestor"))
    below = fx.gold_long(spark, sf_dir).join(anc, "label").groupBy(F.col("ancestor").alias("node")).agg(
        F.count(F.lit(1)).alias("n_gold_below"))
    return kids.join(below, "node", "left").select(
        "node", "n_children", F.coalesce("n_gold_below", F.lit(0)).cast("bigint").alias("n_gold_below"))


@register("direct_parents", sql(None, """
SELECT g.doc_id, g.label, e.parent FROM gold g JOIN edges e ON e.child = g.label"""))
def direct_parents(spark, sf_dir):
    t = fx.taxonomy(spark)
    return tx.direct_parents(fx.gold_long(spark, sf_dir), t["edges"]).select("doc_id", "label", "parent")


@register("dag_ancestors", sql(None, """
SELECT g.doc_id, g.label, a.ancestor FROM gold g JOIN ancpairs a ON a.node = g.label"""))
def dag_ancestors(spark, sf_dir):
    t = fx.taxonomy(spark)
    anc = sized_broadcast(t["anc"]).select(F.col("node").alias("label"), "ancestor")
    return fx.gold_long(spark, sf_dir).join(anc, "label").select("doc_id", "label", "ancestor")


_SEL = ", ".join(q(x) for x in SELECTED_INTERNALS)


@register("expand_selected", sql(None, f"""
SELECT doc_id, label FROM gold UNION
SELECT g.doc_id, a.ancestor FROM gold g JOIN ancpairs a ON a.node = g.label WHERE a.ancestor IN ({_SEL})"""))
def expand_selected(spark, sf_dir):
    t = fx.taxonomy(spark)
    return tx.add_ancestors(fx.gold_long(spark, sf_dir), t["anc"], "doc_id", only=SELECTED_INTERNALS)


@register("expand_ancestors", sql(None, """
SELECT doc_id, string_agg(label, '|' ORDER BY label) AS labels, count(*) AS n_labels
FROM (SELECT doc_id, label FROM pred UNION SELECT p.doc_id, a.ancestor FROM pred p JOIN ancpairs a ON a.node = p.label)
GROUP BY doc_id"""))
def expand_ancestors(spark, sf_dir):
    t = fx.taxonomy(spark)
    long = tx.add_ancestors(fx.pred_long(spark, sf_dir), t["anc"], "doc_id")
    return long.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_list("label")), "|").alias("labels"),
        F.count(F.lit(1)).cast("bigint").alias("n_labels"))


@register("closure_fill", sql(None, "SELECT doc_id, label FROM predc"))
def closure_fill(spark, sf_dir):
    t = fx.taxonomy(spark)
    return tx.expand_long(fx.pred_long(spark, sf_dir), t["closure"], "doc_id")


@register("with_parents", sql(None, f"""
SELECT doc_id, label FROM gold UNION
SELECT g.doc_id, e.parent FROM gold g JOIN edges e ON e.child = g.label WHERE e.parent <> {q(ROOT)}"""))
def with_parents(spark, sf_dir):
    t = fx.taxonomy(spark)
    return tx.add_parents(fx.gold_long(spark, sf_dir), t["edges"], "doc_id")


@register("dag_distance", sql(None, """
SELECT a.ancestor, CAST(a.distance AS BIGINT) AS distance, count(*) AS n_rows FROM gold g JOIN ancall a ON a.node = g.label
GROUP BY a.ancestor, a.distance"""))
def dag_distance(spark, sf_dir):
    t = fx.taxonomy(spark)
    anc = sized_broadcast(t["anc_all"]).select(F.col("node").alias("label"), "ancestor", "distance")
    return fx.gold_long(spark, sf_dir).join(anc, "label").groupBy("ancestor", F.col("distance").cast("bigint").alias("distance")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"))


@register("leaf_only", sql(None, """
SELECT doc_id, label FROM (SELECT doc_id, label FROM gold UNION
  SELECT g.doc_id, a.ancestor FROM gold g JOIN ancpairs a ON a.node = g.label)
WHERE label NOT IN (SELECT parent FROM edges)"""))
def leaf_only(spark, sf_dir):
    """Expand to the full closure, then drop every internal node again."""
    t = fx.taxonomy(spark)
    full = tx.add_ancestors(fx.gold_long(spark, sf_dir), t["anc"], "doc_id")
    return tx.leaf_only(full, t["edges"]).select("doc_id", "label")
