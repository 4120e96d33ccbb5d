"""Cleaning / projection / sampling queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tagweave.fixed import EVENT_TYPES
from tagweave.functions.labels import flags_to_labels
from tagweave.functions.seeded import seeded_int_sql
from tagweave.operators import clean as c
from tagweave.plans import fixtures as fx
from tagweave.plans.registry import register
from tagweave.plans.sqlbase import sql
from tagweave.session import read_table


@register("drop_null_rows", sql(None, "SELECT doc_id FROM corpus WHERE text IS NOT NULL AND label IS NOT NULL"))
def drop_null_rows(spark, sf_dir):
    return c.drop_null_rows(fx.corpus(spark, sf_dir), ["text", "label"]).select("doc_id")


@register("project_cols", sql(None, "SELECT doc_id, label FROM corpus"))
def project_cols(spark, sf_dir):
    return c.project(fx.corpus(spark, sf_dir), ["doc_id", "label"])


@register("dedupe_first", sql(None, """
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1"""))
def dedupe_first(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return c.dedupe_first(d, ["text"], ["doc_id"]).select("doc_id")


@register("dup_count", sql(None, """
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates, count(*) AS n_distinct
FROM (SELECT text, count(*) AS n FROM corpus GROUP BY text)"""))
def dup_count(spark, sf_dir):
    return c.dup_count(fx.corpus(spark, sf_dir), ["text"])


@register("null_audit", sql(None, "SELECT doc_id, label FROM corpus WHERE text IS NULL"))
def null_audit(spark, sf_dir):
    return c.null_audit(fx.corpus(spark, sf_dir), "text").select("doc_id", "label")


@register("fill_none", sql(None, "SELECT doc_id, coalesce(label, 'None') AS label FROM corpus"))
def fill_none(spark, sf_dir):
    return c.fill_none(fx.corpus(spark, sf_dir), ["label"]).select("doc_id", "label")


@register("filter_eq", sql(None, "SELECT user_id FROM onehot WHERE purchase = 1"))
def filter_eq(spark, sf_dir):
    return fx.onehot(spark, sf_dir).filter(F.col("purchase") == 1).select("user_id")


@register("any_col_contains", sql(None, """
SELECT conv_id, turn FROM conversations
WHERE contains(CAST(conv_id AS VARCHAR), '17') OR contains(CAST(turn AS VARCHAR), '17')
   OR coalesce(contains(role, '17'), false) OR coalesce(contains(text, '17'), false)"""))
def any_col_contains(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    return c.any_col_contains(conv, "17").select("conv_id", "turn")


@register("label_rows", sql(None, """
SELECT doc_id FROM (SELECT doc_id, string_agg(label, ',' ORDER BY j) AS s FROM gold GROUP BY doc_id)
WHERE contains(s, 'Appeal')"""))
def label_rows(spark, sf_dir):
    return c.label_rows(fx.doc_label_sets(spark, sf_dir), "gold", "Appeal").select("doc_id")


@register("row_feature", sql(None, """
SELECT user_id, click + error + purchase + signup + view AS total FROM onehot"""))
def row_feature(spark, sf_dir):
    def total(*cols):
        return reduce(lambda a, b: a + b, cols)

    return c.row_feature(fx.onehot(spark, sf_dir), "total", total, EVENT_TYPES).select("user_id", "total")


@register("offset_ids", sql(None, """
SELECT user_id, CAST(1000000 + row_number() OVER (ORDER BY user_id) - 1 AS BIGINT) AS new_id FROM onehot"""))
def offset_ids(spark, sf_dir):
    return c.with_row_index(fx.onehot(spark, sf_dir), ["user_id"], "new_id", 1000000).select("user_id", "new_id")


@register("flag_to_labels", sql(None, """
SELECT user_id, concat_ws(',', CASE WHEN purchase = 1 THEN 'buyer' END, CASE WHEN signup = 1 THEN 'member' END)
       AS labels FROM onehot"""))
def flag_to_labels(spark, sf_dir):
    oh = fx.onehot(spark, sf_dir)
    labs = flags_to_labels({"buyer": F.col("purchase") == 1, "member": F.col("signup") == 1})
    return oh.select("user_id", F.array_join(labs, ",").alias("labels"))


@register("holdout_split", sql(None, """
SELECT doc_id, CASE WHEN (doc_id * 7919 + 42) % 100 < 90 THEN 'train' ELSE 'validation' END AS holdout
FROM documents"""))
def holdout_split(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    return c.holdout_split(d, "doc_id", 10, 42)


@register("seeded_shuffle", sql(None, f"""
SELECT doc_id, lang, row_number() OVER (ORDER BY {seeded_int_sql(["doc_id"], 42)}, doc_id) - 1 AS pos
FROM documents"""))
def seeded_shuffle(spark, sf_dir):
    """The seeded permutation of all documents, as a position per row."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return c.seeded_shuffle(d, "doc_id", 42, pos_col="pos")


@register("head_n", sql(None, "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50"))
def head_n(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return c.head_n(d, 50, ["doc_id"])


@register("split_counts", sql(None, "SELECT split, count(*) AS n_rows FROM dsplit GROUP BY split"))
def split_counts(spark, sf_dir):
    return c.split_counts(fx.doc_splits(spark, sf_dir))
