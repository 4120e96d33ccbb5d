"""Hidden-state pooling (I1-I4) and batched featurisation.

Hidden states are a long table ``(id, layer, token, mask, vec array<float>)``.
Means are taken with ``Summarizer`` (a JVM vector aggregate with partial
aggregation), so a d-wide vector never explodes into d rows."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.session import cut_lineage


def _mean_by(df: DataFrame, keys: list[str], vec_col: str) -> DataFrame:
    v = df.select(*keys, array_to_vector(F.col(vec_col)).alias("_v"))
    return v.groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_m")).select(
        *keys, vector_to_array("_m").alias(vec_col))


def _last_layer(hidden: DataFrame, layer_col: str) -> int:
    return hidden.agg(F.max(layer_col)).first()[0]


def pool_cls(hidden: DataFrame, id_col: str = "id", layer_col: str = "layer", token_col: str = "token",
             vec_col: str = "vec", layer: int | None = None) -> DataFrame:
    """First-token vector of the last layer (a filter, no shuffle)."""
    layer = _last_layer(hidden, layer_col) if layer is None else layer
    return hidden.filter((F.col(layer_col) == layer) & (F.col(token_col) == 0)).select(
        id_col, F.transform(vec_col, lambda x: x.cast("double")).alias(vec_col))


def pool_layers(hidden: DataFrame, layers: list[int], method: str = "avg", id_col: str = "id",
                layer_col: str = "layer", vec_col: str = "vec") -> DataFrame:
    """Per selected layer the mean over ALL tokens (padding included),
    then the mean over layers (``avg``) or the layer means concatenated in the
    requested layer order (``concatenate``)."""
    if method not in ("avg", "concatenate"):
        raise ValueError("method must be 'avg' or 'concatenate'")
    if not layers:
        raise ValueError("at least one layer is required")
    sel = hidden.filter(F.col(layer_col).isin(layers))
    per_layer = _mean_by(sel, [id_col, layer_col], vec_col)
    if method == "avg":
        return _mean_by(per_layer, [id_col], vec_col)
    order = F.create_map(*[x for i, lay in enumerate(layers) for x in (F.lit(lay), F.lit(i))])
    per_layer = per_layer.withColumn("_o", F.element_at(order, F.col(layer_col)))
    # one short struct per selected layer and id: bounded by len(layers)
    return per_layer.groupBy(id_col).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_o", vec_col))), lambda s: s[vec_col]))
        .alias(vec_col))


def pool_masked_mean(hidden: DataFrame, id_col: str = "id", layer_col: str = "layer", mask_col: str = "mask",
                     vec_col: str = "vec", layer: int | None = None) -> DataFrame:
    """I4: Σ(vec·mask) / max(Σmask, ε) over tokens of one layer (default: the
    last); an id without any valid token gets the zero vector."""
    layer = _last_layer(hidden, layer_col) if layer is None else layer
    lay = hidden.filter(F.col(layer_col) == layer)
    valid = _mean_by(lay.filter(F.col(mask_col) == 1), [id_col], vec_col)
    ids = lay.groupBy(id_col).agg(F.max(F.size(vec_col)).alias("_d"))
    j = ids.join(valid, id_col, "left")
    zero = F.array_repeat(F.lit(0.0), F.col("_d"))
    return j.select(id_col, F.coalesce(F.col(vec_col), zero).alias(vec_col))


def embed_with_model(df: DataFrame, make_predict_fn: Callable[[], Callable[[np.ndarray], np.ndarray]],
                     input_col: str, input_dim: int, batch_size: int = 64, out_col: str = "features") -> DataFrame:
    """Batched inference with a pluggable model.

    ``make_predict_fn`` is called once per Python worker (model loaded once)
    and returns a function from a (batch, input_dim) array to a (batch, dim)
    array.  Rows travel as Arrow batches of ``batch_size``."""
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size,
                            input_tensor_shapes=[[input_dim]])
    return df.withColumn(out_col, udf(F.col(input_col)))


def store_weights(spark, path: str, **arrays: np.ndarray) -> None:
    """Write a model's arrays as one file of the shared storage (one row of bytes)."""
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    spark.createDataFrame([(bytearray(buffer.getvalue()),)], "weights binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark, path: str):
    """The stored arrays, read once and sent to every worker (the size of the model)."""
    return spark.sparkContext.broadcast(bytes(spark.read.parquet(path).first()["weights"]))


class TokenMixer:
    """A small encoder over token ids: layer 0 are the tokens' embeddings; layer l adds a share of
    the valid tokens' mean to scaled units of the layer below, h * scale[l] + mean(h) * mixing[l].

    The stand-in of this library for any encoder: what matters to the job is that it maps a batch
    of ids and masks to (batch, layers, tokens, units)."""

    def __init__(self, weights: bytes):
        with np.load(io.BytesIO(weights)) as f:
            self.table, self.scale, self.mixing = f["table"], f["scale"], f["mixing"]

    def __call__(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        m = mask[..., None].astype(np.float64)
        h = self.table[ids] * m
        layers = [h]
        for scale, mixing in zip(self.scale, self.mixing):
            mean = h.sum(axis=1, keepdims=True) / np.maximum(m.sum(axis=1, keepdims=True), 1e-9)
            h = (h * scale + mean * mixing) * m
            layers.append(h)
        return np.stack(layers, axis=1)


def hidden_states(encoded: DataFrame, weights, make_model: Callable, max_len: int, layers: int, batch_size: int = 64,
                  id_col: str = "id") -> DataFrame:
    """``id, layer, token, mask, vec`` of a model run over ``id, input_ids, attention_mask``
    (arrays of ``max_len``).

    ``weights`` is the broadcast of ``load_weights``; ``make_model`` builds the model from its
    bytes, once per Python worker, and the model maps (ids, mask) of a batch to (batch,
    ``layers``, tokens, units).  The model's output is written once before it is taken apart."""
    def make_predict_fn():
        model = make_model(weights.value)

        def predict(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
            return model(ids.astype(np.int64), mask.astype(np.int64)).reshape(len(ids), -1).astype(np.float64)

        return predict

    run = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
                            input_tensor_shapes=[[max_len], [max_len]])
    out = cut_lineage(encoded.select(F.col(id_col).alias("id"), F.col("attention_mask").alias("m"), run("input_ids", "attention_mask").alias("s")))
    units = f"cast(size(s) / {layers * max_len} as int)"
    cells = F.expr(f"inline(transform(sequence(0, {layers * max_len - 1}), i -> named_struct('layer', cast(i div {max_len} as int), "
                   f"'token', cast(i % {max_len} as int), 'mask', m[i % {max_len}], 'vec', slice(s, i * {units} + 1, {units}))))")
    return out.select("id", cells)
