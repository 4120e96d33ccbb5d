"""Pooling and featurisation queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions import text as tf
from tagweave.operators import pooling as pl
from tagweave.plans import fixtures as fx
from tagweave.plans.registry import register
from tagweave.plans.sqlbase import sql
from tagweave.session import cut_lineage, scratch_path
from tagweave.sources import io


def _long(df: DataFrame, id_col: str = "vec_id", vec_col: str = "vec") -> DataFrame:
    return df.select(id_col, F.posexplode(vec_col).alias("dim", "value")).select(
        id_col, F.col("dim").cast("bigint").alias("dim"), F.round(F.col("value").cast("double"), 6).alias("value"))


@register("pool_cls", sql(None, """
SELECT vec_id, CAST(dim AS BIGINT) AS dim, round(x, 6) AS value FROM hidden_long WHERE layer = 1 AND token = 0"""))
def pool_cls(spark, sf_dir):
    """I1."""
    return _long(pl.pool_cls(fx.hidden_states(spark, sf_dir), "vec_id"))


@register("pool_layers_avg", sql(None, """
SELECT vec_id, CAST(dim AS BIGINT) AS dim, round(avg(m), 6) AS value
FROM (SELECT vec_id, layer, dim, avg(x) AS m FROM hidden_long WHERE layer IN (0, 1) GROUP BY vec_id, layer, dim)
GROUP BY vec_id, dim"""))
def pool_layers_avg(spark, sf_dir):
    """Layers 0 and 1, mean over all tokens per layer, then over layers."""
    return _long(pl.pool_layers(fx.hidden_states(spark, sf_dir), [0, 1], "avg", "vec_id"))


@register("pool_layers_concat", sql(None, """
SELECT vec_id, CAST(CASE WHEN layer = 1 THEN 0 ELSE 8 END + dim AS BIGINT) AS dim, round(avg(x), 6) AS value
FROM hidden_long WHERE layer IN (0, 1) GROUP BY vec_id, layer, dim"""))
def pool_layers_concat(spark, sf_dir):
    """Layer means concatenated in the requested order [1, 0]."""
    return _long(pl.pool_layers(fx.hidden_states(spark, sf_dir), [1, 0], "concatenate", "vec_id"))


@register("pool_masked_mean", sql(None, """
SELECT vec_id, CAST(dim AS BIGINT) AS dim, round(avg(x), 6) AS value
FROM hidden_long WHERE layer = 1 AND mask = 1 GROUP BY vec_id, dim"""))
def pool_masked_mean(spark, sf_dir):
    """I4: mask-aware mean over the last layer's tokens."""
    return _long(pl.pool_masked_mean(fx.hidden_states(spark, sf_dir), "vec_id"))


# --- the extraction job (I5 / I6) ---------------------------------------------------
# A token's id follows from its length and its first and last character, so that SQL can look
# up the same embedding; the weights follow from a rule and are written to a file first.

IDS, UNITS, MAX_LEN = 997, 8, 32
SCALE, MIXING = [0.75, -0.5], [0.5, 1.25]
METHODS = ["cls", "avg", "concatenate", "masked_mean"]


def _table() -> np.ndarray:
    v, u = np.arange(IDS)[:, None], np.arange(UNITS)[None]
    return (v * 31 + u * 17) % 101 / 101 - 0.5


def encode_documents(spark, sf_dir) -> DataFrame:
    """``id, split, input_ids, attention_mask`` of the first ``MAX_LEN`` tokens, filled up with id 0."""
    docs = fx.doc_splits(spark, sf_dir).select(F.col("doc_id").alias("id"), "split", F.coalesce("text", F.lit("")).alias("text"))
    cut = docs.withColumn("t", F.slice(tf.tokens(F.col("text")), 1, MAX_LEN))
    ids = F.transform("t", lambda x: (F.length(x) * 131 + F.ascii(x) * 31 + F.ascii(F.substring(x, -1, 1)) * 7) % IDS)
    fill = F.array_repeat(F.lit(0), MAX_LEN - F.size("t"))
    return cut.select("id", "split", F.concat(ids, fill).alias("input_ids"),
                      F.concat(F.array_repeat(F.lit(1), F.size("t")), fill).alias("attention_mask"))


def extract_features(spark, sf_dir, path: str) -> None:
    """The whole job: encode every split, run the model from its weight file, pool the states in
    four ways, write vectors and manifest columns."""
    weights_path = scratch_path(spark, "weights")
    pl.store_weights(spark, weights_path, table=_table(), scale=np.array(SCALE), mixing=np.array(MIXING))
    encoded = encode_documents(spark, sf_dir)
    states = cut_lineage(pl.hidden_states(encoded, pl.load_weights(spark, weights_path), pl.TokenMixer, MAX_LEN, 1 + len(SCALE)))
    pooled = {"cls": pl.pool_cls(states), "avg": pl.pool_layers(states, [0, 1, 2], "avg"),
              "concatenate": pl.pool_layers(states, [2, 0], "concatenate"), "masked_mean": pl.pool_masked_mean(states)}
    layers = {"cls": "2", "avg": "0,1,2", "concatenate": "2,0", "masked_mean": "2"}
    splits = encoded.select("id", "split")
    for method, vectors in pooled.items():
        rows = vectors.join(splits, "id").select(
            "id", "split", F.col("vec").alias("features"), F.lit("token-mixer").alias("model"), F.lit(method).alias("extraction_method"),
            F.lit(layers[method]).alias("layers"), F.lit(method if method in ("avg", "concatenate") else "").alias("layers_aggregation_method"),
            F.lit("documents").alias("dataset"))
        io.write_features(rows, path, ("model", "extraction_method", "split"))


@register("embed_corpus", sql(f"""
tk AS MATERIALIZED (SELECT doc_id, split, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')[1:{MAX_LEN}] AS t FROM dsplit),
pos AS MATERIALIZED (SELECT doc_id, split, len(t) AS n, p - 1 AS token, CASE WHEN p <= len(t) THEN 1 ELSE 0 END AS mask,
               CASE WHEN p <= len(t) THEN (length(t[p]) * 131 + unicode(t[p]) * 31 + unicode(right(t[p], 1)) * 7) % {IDS} ELSE 0 END AS id
        FROM (SELECT *, unnest(range(1, {MAX_LEN + 1})) AS p FROM tk)),
h0 AS MATERIALIZED (SELECT *, mask * (((id * 31 + u * 17) % 101) / 101.0::DOUBLE - 0.5) AS h FROM (SELECT *, unnest(range(0, {UNITS})) AS u FROM pos)),
m0 AS (SELECT doc_id, u, sum(h) / greatest(sum(mask), 1e-9) AS m FROM h0 GROUP BY doc_id, u),
h1 AS MATERIALIZED (SELECT h0.* EXCLUDE (h), (h * {SCALE[0]}::DOUBLE + m * {MIXING[0]}::DOUBLE) * mask AS h FROM h0 JOIN m0 USING (doc_id, u)),
m1 AS (SELECT doc_id, u, sum(h) / greatest(sum(mask), 1e-9) AS m FROM h1 GROUP BY doc_id, u),
h2 AS MATERIALIZED (SELECT h1.* EXCLUDE (h), (h * ({SCALE[1]})::DOUBLE + m * {MIXING[1]}::DOUBLE) * mask AS h FROM h1 JOIN m1 USING (doc_id, u)),
lay AS (SELECT 0 AS layer, * FROM h0 UNION ALL SELECT 1, * FROM h1 UNION ALL SELECT 2, * FROM h2),
mean AS MATERIALIZED (SELECT doc_id, split, layer, u, avg(h) AS x FROM lay GROUP BY ALL),
vecs AS (SELECT doc_id, split, 'cls' AS method, '2' AS layers, u AS dim, h AS x FROM h2 WHERE token = 0
         UNION ALL SELECT doc_id, split, 'avg', '0,1,2', u, avg(x) FROM mean GROUP BY doc_id, split, u
         UNION ALL SELECT doc_id, split, 'concatenate', '2,0', CASE WHEN layer = 2 THEN 0 ELSE {UNITS} END + u, x FROM mean WHERE layer IN (0, 2)
         UNION ALL SELECT doc_id, split, 'masked_mean', '2', u, coalesce(sum(h) / nullif(sum(mask), 0), 0) FROM h2 GROUP BY doc_id, split, u)""", """
SELECT doc_id, split, 'token-mixer' AS model, method AS extraction_method, layers, CAST(dim AS BIGINT) AS dim, round(x, 6) + 0 AS value FROM vecs"""))
def embed_corpus(spark, sf_dir):
    """A model from a weight file run over all splits into layers and tokens, pooled by I1-I4,
    written with manifest columns partitioned by (model, method, split) and read back: whole vectors."""
    path = scratch_path(spark, "embed")
    extract_features(spark, sf_dir, path)
    back = io.read_features(spark, path)
    return back.select(F.col("id").alias("doc_id"), "split", "model", "extraction_method", "layers", F.posexplode("features").alias("dim", "value")).select(
        "doc_id", "split", "model", "extraction_method", "layers", F.col("dim").cast("bigint").alias("dim"),
        (F.round("value", 6) + 0.0).alias("value"))
