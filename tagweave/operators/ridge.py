"""Ridge with its penalty chosen by closed-form leave-one-out errors.

Two passes over the rows.  The first sums the Gram matrix of features and targets of all
labels; its eigenvectors give the solutions for every penalty.  The second adds up
every row's leave-one-out error, residual / (1 - leverage), for all penalties and labels at
once.  Matrices are the square of the features wide; they are summed within the
tasks, then in groups, so the driver adds a few of them only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.session import scratch_path

ALPHAS = (0.1, 1.0, 10.0)


def summed(rows: DataFrame, of_batch) -> np.ndarray:
    """Sum of ``of_batch(x, y)`` (a flat array) over all batches of ``x``, ``y`` rows."""
    def partial(batches):
        total = None
        for batch in batches:
            if len(batch):
                x, y = (np.asarray(batch.column(i).flatten(), dtype=np.float64).reshape(len(batch), -1) for i in (0, 1))
                one = of_batch(x, y)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_pylist([{"total": total.tobytes()}], schema=pa.schema([("total", pa.binary())]))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"total": [sum(np.frombuffer(b) for b in pdf["total"]).tobytes()]})

    groups = max(1, round(math.sqrt(rows.rdd.getNumPartitions())))
    parts = rows.select("x", "y").mapInArrow(partial, "total binary")
    if groups > 2:
        parts = parts.withColumn("to", F.spark_partition_id() % groups).groupBy("to").applyInPandas(
            lambda pdf: add(pdf), "total binary")
    return sum(np.frombuffer(bytes(r.total)) for r in parts.collect())


@dataclass
class RidgeModel:
    """``errors``: mean squared leave-one-out error of every penalty, over rows and labels;
    ``label_errors``: the same per label (penalty x label)."""

    labels: list[str]
    alpha: float
    alphas: tuple[float, ...]
    errors: np.ndarray
    label_errors: np.ndarray
    weights: np.ndarray
    intercepts: np.ndarray

    def transform(self, df: DataFrame, features_col: str = "features", out_col: str = "pred_labels") -> DataFrame:
        """Adds ``scores`` (decision values) and the labels above zero, as plain column expressions."""
        x = F.col(features_col).cast("array<double>")
        scores = [F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in self.weights[:, j]]), lambda a, b: a * b),
                              F.lit(float(b)), lambda s, v: s + v) for j, b in enumerate(self.intercepts)]
        out = df.withColumn("scores", F.array(*scores))
        hits = [F.when(F.col("scores")[j] > 0, F.lit(v)) for j, v in enumerate(self.labels)]
        return out.withColumn(out_col, F.array_compact(F.array(*hits)))


def fit_ridge(df: DataFrame, labels: list[str], alphas: tuple[float, ...] = ALPHAS, features_col: str = "features",
              labels_col: str = "labels") -> RidgeModel:
    """Ridge on targets +1 and -1 with a free intercept; the penalty with the least mean
    leave-one-out error wins, the smaller one of equals.  Rows with null features or labels take no part.

    With an unpenalised intercept, row i has the leverage 1/n + c' (X'X + alpha)^-1 c
    for its centred features c, and its error without itself is residual / (1 - leverage).
    """
    spark = df.sparkSession
    y = F.array(*[F.when(F.array_contains(labels_col, v), 1.0).otherwise(-1.0) for v in labels])
    path = scratch_path(spark, "ridge-rows")
    df.filter(F.col(features_col).isNotNull() & F.col(labels_col).isNotNull()).select(
        F.col(features_col).cast("array<double>").alias("x"), y.alias("y")).write.parquet(path)
    rows = spark.read.parquet(path)
    d, k = rows.agg(F.max(F.size("x"))).first()[0], len(labels)
    if d is None:
        raise ValueError("no training rows")

    def gram(x, t):
        z = np.concatenate([np.ones((len(x), 1)), x, t], axis=1)
        return (z.T @ z).ravel()

    g = summed(rows, gram).reshape(1 + d + k, 1 + d + k)
    n = g[0, 0]
    mean_x, mean_y = g[0, 1:1 + d] / n, g[0, 1 + d:] / n
    xx = g[1:1 + d, 1:1 + d] - n * np.outer(mean_x, mean_x)
    xy = g[1:1 + d, 1 + d:] - n * np.outer(mean_x, mean_y)
    values, vectors = np.linalg.eigh(xx)
    values = np.maximum(values, 0.0)
    weights = [vectors @ ((vectors.T @ xy) / (values + a)[:, None]) for a in alphas]

    def left_out(x, t):
        c = x - mean_x
        spread = (c @ vectors) ** 2
        sums = []
        for a, w in zip(alphas, weights):
            residual = (t - mean_y) - c @ w
            leverage = 1.0 / n + spread @ (1.0 / (values + a))
            sums.append(((residual / (1.0 - leverage)[:, None]) ** 2).sum(axis=0))
        return np.concatenate(sums)

    label_errors = summed(rows, left_out).reshape(len(alphas), k) / n
    errors = label_errors.mean(axis=1)
    best = min(range(len(alphas)), key=lambda i: (errors[i], alphas[i]))
    return RidgeModel(labels, alphas[best], alphas, errors, label_errors, weights[best], mean_y - mean_x @ weights[best])
