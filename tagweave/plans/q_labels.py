"""Set-operation and label-reshaping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.fixed import EVENT_TYPES, LEAVES
from tagweave.functions import labels as lf
from tagweave.operators import setops as so
from tagweave.plans import fixtures as fx
from tagweave.plans.registry import register
from tagweave.plans.sqlbase import q, sql

CLASSES = sorted(LEAVES)


@register("union_splits", sql(None, """
SELECT doc_id, split, CASE WHEN split = 'dev' THEN NULL ELSE lang END AS lang, source FROM dsplit"""))
def union_splits(spark, sf_dir):
    """Per-split frames with different columns, unioned by name with provenance."""
    d = fx.doc_splits(spark, sf_dir)
    parts = {
        "train": d.filter(F.col("split") == "train").select("doc_id", "lang", "source"),
        "validation": d.filter(F.col("split") == "validation").select("doc_id", "lang", "source"),
        "dev": d.filter(F.col("split") == "dev").select("doc_id", "source"),
    }
    return so.union_splits(parts).select("doc_id", "split", "lang", "source")


@register("label_vocab", sql(None, "SELECT label FROM gold UNION SELECT label FROM pred"))
def label_vocab(spark, sf_dir):
    """Union of all label sets, distinct, sorted."""
    s = fx.doc_label_sets(spark, sf_dir)
    return so.label_vocab(s, ["gold", "pred"])


@register("vocab_minus_none", sql(None, """
SELECT DISTINCT x AS label FROM (SELECT unnest(string_split(coalesce(label, 'None'), ',')) AS x FROM corpus)
WHERE x <> '' AND x <> 'None'"""))
def vocab_minus_none(spark, sf_dir):
    """D4 with B6: null labels filled with 'None', vocabulary built, 'None' removed."""
    c = fx.corpus(spark, sf_dir).na.fill("None", ["label"])
    v = so.label_vocab(c.select(lf.split_labels(F.col("label")).alias("labels")), ["labels"])
    return so.vocab_minus(v, ["None"])


@register("distinct_labels", sql(None, "SELECT DISTINCT lab AS label FROM featlab"))
def distinct_labels(spark, sf_dir):
    """D6."""
    return fx.features(spark, sf_dir).select(F.explode("labels").alias("label")).distinct()


@register("unknown_labels", sql(None, """
SELECT label, count(*) AS n_rows FROM sub_long WHERE label NOT IN (SELECT node FROM nodes) GROUP BY label"""))
def unknown_labels(spark, sf_dir):
    """Labels outside the fitted vocabulary (the taxonomy) are dropped and counted."""
    sub = fx.submission(spark, sf_dir).select("doc_id", F.explode("labels").alias("label"))
    vocab = fx.taxonomy(spark)["closure"].select(F.col("node").alias("label")).distinct()
    return so.unknown_labels(sub, vocab)


@register("split_labels", sql(None, """
SELECT doc_id, x AS label FROM (SELECT doc_id, unnest(string_split(label, ',')) AS x FROM corpus
WHERE label IS NOT NULL) WHERE x <> ''"""))
def split_labels(spark, sf_dir):
    """E1."""
    c = fx.corpus(spark, sf_dir).filter(F.col("label").isNotNull())
    return c.select("doc_id", F.explode(lf.split_labels(F.col("label"))).alias("label"))


_CLASSES_SQL = "cls(pos, label) AS (VALUES " + ", ".join(f"({i}, {q(x)})" for i, x in enumerate(CLASSES)) + ")"


@register("multi_hot", sql(_CLASSES_SQL, """
SELECT d.doc_id, string_agg(CASE WHEN g.doc_id IS NULL THEN '0' ELSE '1' END, '' ORDER BY c.pos) AS hot
FROM documents d CROSS JOIN cls c LEFT JOIN gold g ON g.doc_id = d.doc_id AND g.label = c.label GROUP BY d.doc_id"""))
def multi_hot(spark, sf_dir):
    """Fixed class order (code point), one 0/1 per class."""
    s = fx.doc_label_sets(spark, sf_dir)
    return s.select("doc_id", F.array_join(lf.multi_hot(F.col("gold"), CLASSES).cast("array<string>"), "").alias("hot"))


@register("multi_hot_decode", sql(None, "SELECT doc_id, gold AS labels FROM gsets"))
def multi_hot_decode(spark, sf_dir):
    """decode(encode(x)) = sorted distinct x."""
    s = fx.doc_label_sets(spark, sf_dir)
    hot = lf.multi_hot(F.col("gold"), CLASSES)
    return s.select("doc_id", F.array_join(lf.multi_hot_decode(hot, CLASSES), "|").alias("labels"))


@register("logits_to_labels", sql("""
lp AS (SELECT vec_id, i, CASE WHEN 1.0 / (1.0 + exp(-10.0 * CAST(embedding[i + 1] AS DOUBLE))) >= 0.6
       THEN 1 ELSE 0 END AS h FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings))""", """
SELECT vec_id, CAST(sum(h) AS BIGINT) AS n_pos, string_agg(CAST(h AS VARCHAR), '' ORDER BY i) AS hot
FROM lp GROUP BY vec_id"""))
def logits_to_labels(spark, sf_dir):
    """Sigmoid, threshold 0.6 inclusive."""
    lg = fx.logits(spark, sf_dir)
    hot = lf.logits_to_hot(F.col("logits"), 0.6, inclusive=True)
    return lg.select("vec_id", F.aggregate(hot, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_pos"),
                     F.array_join(hot.cast("array<string>"), "").alias("hot"))


@register("multi_label_rows", sql(None, """
SELECT vec_id, count(*) AS n_labels FROM featlab GROUP BY vec_id HAVING count(*) > 1"""))
def multi_label_rows(spark, sf_dir):
    """E6."""
    f = fx.features(spark, sf_dir)
    return f.filter(F.size("labels") > 1).select("vec_id", F.size("labels").cast("bigint").alias("n_labels"))


@register("onehot_to_list", sql(None, "SELECT user_id, concat_ws(',', "
                                + ", ".join(f"CASE WHEN {t} = 1 THEN '{t}' END" for t in EVENT_TYPES)
                                + ") AS labels FROM onehot WHERE " + " OR ".join(f"{t} = 1" for t in EVENT_TYPES)))
def onehot_to_list(spark, sf_dir):
    """Explicit label-column list, column order kept, no shuffle."""
    oh = fx.onehot(spark, sf_dir)
    lst = lf.onehot_to_list(EVENT_TYPES)
    return oh.select("user_id", lst.alias("l")).filter(F.size("l") > 0).select(
        "user_id", F.array_join("l", ",").alias("labels"))
