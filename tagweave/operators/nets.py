"""One net for all labels (K6) and its loss curve (K14), trained on Spark.

The training rows are shuffled once into blocks, the mini-batches, which are
packed and written as partition folders; an epoch visits the blocks in a seeded order.  Steps follow
each other by nature, so one task takes a run of steps: it reads the blocks of the run, up
to ``RUN_BYTES`` of rows sorted by their place in the order, and hands weights and Adam
moments on to the next run.

A block that is too large for one task is a step of its own.  Each task of such a step
turns its rows into one partial gradient, partial gradients are summed in groups of about
the square root of their number, and the driver adds those few sums.

Nothing of the data reaches the driver; what goes back and forth, once a run, is the size
of the net.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.seeded import seeded_int
from tagweave.session import scratch_path

#: Blocks of a training table at most: folders, and steps of an epoch.
MAX_BLOCKS = 1000
#: Partial gradients that the driver adds without a round of sums in tasks.
FAN_IN = 8
#: Rows of a block that one task writes and reads.
TASK_ROWS = 100_000
#: Bytes of rows that one task steps through before it hands the net on; bytes of small
#: blocks that share a folder.  A run reads the folders of its blocks, so an epoch reads each
#: folder once per run, but never more often than it holds blocks.
RUN_BYTES = 256 << 20
FOLDER_BYTES = 4 << 20
RUN_SCHEMA = "theta binary, m binary, v binary, t long, loss double, cells long"
GRADIENT_SCHEMA = "task long, gradient binary, loss double, hits long, n long, cells long"
#: Probabilities are kept this far from 0 and 1 in losses.
EPS = 1e-12


def init_weights(sizes: list[int], seed: int) -> np.ndarray:
    """Uniform weights within sqrt(6 / (fan in + fan out)), biases alike, as one vector."""
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in zip(sizes, sizes[1:]):
        bound = math.sqrt(6.0 / (a + b))
        parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
    return np.concatenate(parts)


def layers_of(theta: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, biases) of each layer, views into the vector."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((theta[at:at + a * b].reshape(a, b), theta[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def forward(theta: np.ndarray, sizes: list[int], x: np.ndarray) -> list[np.ndarray]:
    """Activations of every layer: rectified hidden units, one sigmoid per label."""
    acts = [x]
    for i, (w, b) in enumerate(layers_of(theta, sizes)):
        z = acts[-1] @ w + b
        acts.append(np.maximum(z, 0.0) if i < len(sizes) - 2 else 0.5 * (1.0 + np.tanh(0.5 * z)))
    return acts


def losses(p: np.ndarray, y: np.ndarray) -> float:
    """Binary cross-entropy summed over the known cells; NaN marks a cell that doesn't count."""
    p = np.clip(p, EPS, 1 - EPS)
    return float(-np.nansum(y * np.log(p) + (1 - y) * np.log(1 - p)))


def gradient(theta: np.ndarray, sizes: list[int], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient and value of the cross-entropy summed over rows and labels."""
    acts = forward(theta, sizes, x)
    delta, grads = np.nan_to_num(acts[-1] - y), []
    for i in range(len(sizes) - 2, -1, -1):
        w, _ = layers_of(theta, sizes)[i]
        grads.append((acts[i].T @ delta, delta.sum(axis=0)))
        if i:
            delta = (delta @ w.T) * (acts[i] > 0)
    flat = [part.ravel() for wg, bg in reversed(grads) for part in (wg, bg)]
    return np.concatenate(flat), losses(acts[-1], y)


def _matrices(batch: pa.RecordBatch, width: int, labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and targets of rows, or of packed rows one below the other."""
    def matrix(col, cols):
        if pa.types.is_binary(col.type):
            return np.concatenate([np.frombuffer(v.as_buffer()) for v in col]).reshape(-1, cols)
        return np.asarray(col.flatten(), dtype=np.float64).reshape(len(batch), cols)

    return matrix(batch.column(0), width), matrix(batch.column(1), labels)


def packed(rows: DataFrame, width: int, labels: int) -> DataFrame:
    """``block, x, y``: the neighbouring rows of a block put together, a batch's rows at most, as bytes."""
    schema = pa.schema([("block", pa.int32()), ("x", pa.binary()), ("y", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = _matrices(batch, width, labels)
                block = np.asarray(batch.column(2))
                cuts = np.flatnonzero(np.diff(block)) + 1
                firsts = block[np.r_[0, cuts]]
                yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int32()), *(
                    pa.array([part.tobytes() for part in np.split(m, cuts)], pa.binary()) for m in (x, y))], schema=schema)

    return rows.select("x", "y", "block").mapInArrow(pack, "block int, x binary, y binary")


@dataclass
class Adam:
    """Moments of the optimiser; ``step`` returns what to subtract."""

    rate: float
    beta1: float = 0.9
    beta2: float = 0.999
    t: int = 0
    m: np.ndarray | float = 0.0
    v: np.ndarray | float = 0.0

    def state(self, width: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Moments as vectors, and the number of steps so far."""
        return np.zeros(width) + self.m, np.zeros(width) + self.v, self.t

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = self.beta1 * self.m + (1 - self.beta1) * g
        self.v = self.beta2 * self.v + (1 - self.beta2) * g * g
        rate = self.rate * math.sqrt(1 - self.beta2**self.t) / (1 - self.beta1**self.t)
        return rate * self.m / (np.sqrt(self.v) + 1e-8)


def batch_totals(rows: DataFrame, theta: np.ndarray, sizes: list[int], with_gradient: bool,
                 tasks: int) -> tuple[np.ndarray | None, float, int, int, int]:
    """(gradient, loss, rows right in every known label, rows, known cells) over ``rows`` (``x``, ``y`` arrays), read by ``tasks`` tasks."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(theta)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        w = shared.value
        g, loss, hits, n, cells = np.zeros(len(w) if with_gradient else 0), 0.0, 0, 0, 0
        for batch in batches:
            if not len(batch):
                continue
            x, y = _matrices(batch, sizes[0], sizes[-1])
            if with_gradient:
                one, value = gradient(w, sizes, x, y)
                g += one
            else:
                p = forward(w, sizes, x)[-1]
                value = losses(p, y)
                hits += int((((p >= 0.5) == (y >= 0.5)) | np.isnan(y)).all(axis=1).sum())
            loss, n, cells = loss + value, n + len(x), cells + int((~np.isnan(y)).sum())
        if n:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist([dict(task=task, gradient=g.tobytes(), loss=loss, hits=hits, n=n, cells=cells)], schema=pa.schema(
                [("task", pa.int64()), ("gradient", pa.binary()), ("loss", pa.float64()), ("hits", pa.int64()), ("n", pa.int64()),
                 ("cells", pa.int64())]))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros(len(pdf["gradient"].iloc[0]) // 8)
        for one in pdf.sort_values("task")["gradient"]:
            g += np.frombuffer(one)
        return pd.DataFrame([dict(task=pdf["task"].min(), gradient=g.tobytes(),
                                  **{c: pdf[c].sum() for c in ("loss", "hits", "n", "cells")})])

    parts = rows.select("x", "y").mapInArrow(partial, GRADIENT_SCHEMA)
    if tasks > FAN_IN:
        groups = round(math.sqrt(tasks))
        parts = parts.withColumn("to", F.col("task") % groups).groupBy("to").applyInPandas(
            lambda pdf: add(pdf.drop(columns="to")), GRADIENT_SCHEMA)
    try:
        found = sorted(parts.collect(), key=lambda r: r.task)
    finally:
        shared.destroy()
    g = np.zeros(len(theta)) if with_gradient else None
    for r in found:
        if with_gradient:
            g += np.frombuffer(bytes(r.gradient))
    return g, sum(r.loss for r in found), sum(r.hits for r in found), sum(r.n for r in found), sum(r.cells for r in found)


def run_steps(rows: DataFrame, blocks: list[int], theta: np.ndarray, adam: Adam, sizes: list[int],
              penalty: np.ndarray) -> tuple[np.ndarray, Adam, float, int]:
    """(weights, optimiser, loss, known cells) after one step per block, in the order of ``blocks``, over
    packed ``rows`` (``block``, ``x``, ``y``; other blocks are left out); a block without rows is no step.
    One task does them."""
    shared = rows.sparkSession.sparkContext.broadcast((theta, adam, penalty))
    schema = pa.schema([("theta", pa.binary()), ("m", pa.binary()), ("v", pa.binary()), ("t", pa.int64()), ("loss", pa.float64()),
                        ("cells", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, opt, penal = shared.value
        opt = replace(opt)  # a worker may keep the broadcast value for another attempt
        g, n, at, loss, cells = 0.0, 0, None, 0.0, 0
        for batch in batches:
            if not len(batch):
                continue
            for i, place in enumerate(batch.column(2).to_pylist()):
                if n and place != at:
                    w, g, n = w - opt.step((g + penal * w) / n), 0.0, 0
                x, y = _matrices(batch.slice(i, 1), sizes[0], sizes[-1])
                one, value = gradient(w, sizes, x, y)
                at, g, n, loss, cells = place, g + one, n + len(x), loss + value, cells + int((~np.isnan(y)).sum())
        if n:
            w = w - opt.step((g + penal * w) / n)
        m, v, t = opt.state(len(w))
        yield pa.RecordBatch.from_pylist([dict(theta=w.tobytes(), m=m.tobytes(), v=v.tobytes(), t=t, loss=loss, cells=cells)], schema=schema)

    places = [-1] * (max(blocks) + 1)
    for i, b in enumerate(blocks):
        places[b] = i
    place = F.expr(f"get(array({', '.join(map(str, places))}), block)").alias("place")
    try:
        found = rows.select("x", "y", place).filter("place >= 0").coalesce(1).sortWithinPartitions("place").mapInArrow(run, RUN_SCHEMA).collect()
    finally:
        shared.destroy()
    if not found:  # no row, no task
        return theta, adam, 0.0, 0
    r = found[0]
    theta, m, v = (np.frombuffer(bytes(b)) for b in (r.theta, r.m, r.v))
    return theta, replace(adam, t=r.t, m=m, v=v), r.loss, r.cells


@dataclass
class JointNetModel:
    """Fitted net; ``curve`` has one row per epoch: ``epoch, train_loss, validation_loss,
    validation_accuracy`` (mean loss per row and label, share of rows right in every label)."""

    labels: list[str]
    sizes: list[int]
    theta: np.ndarray
    curve: list[tuple[int, float, float, float]] = field(default_factory=list)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return forward(self.theta, self.sizes, x)[-1]

    def scores(self, features: Column, spark) -> Column:
        """Probabilities of all labels, in the order of ``labels``; null features give null."""
        shared, sizes = spark.sparkContext.broadcast(self.theta), self.sizes

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                known = s.notna()
                out = pd.Series([None] * len(s), dtype=object)
                if known.any():
                    p = forward(shared.value, sizes, np.array([np.asarray(v, dtype=np.float64) for v in s[known]]))[-1]
                    out[known.to_numpy()] = pd.Series(list(p), index=out.index[known.to_numpy()])
                yield out

        return run(features.cast("array<double>"))

    def transform(self, df: DataFrame, features_col: str = "features", out_col: str = "pred_labels",
                  threshold: float = 0.5) -> DataFrame:
        """Adds ``scores`` and the labels with a score of ``threshold`` or more."""
        x = df.withColumn("scores", self.scores(F.col(features_col), df.sparkSession))
        hits = F.transform(F.arrays_zip("scores", F.array(*[F.lit(v) for v in self.labels]).alias("label")),
                           lambda z: F.when(z["scores"] >= threshold, z["label"]))
        return x.withColumn(out_col, F.array_compact(hits))

    def curve_table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.curve, "epoch long, train_loss double, validation_loss double, validation_accuracy double")


class JointNet:
    """One net with a sigmoid per label (K6): Adam on mini-batches, L2 penalty ``alpha``,
    early stop on a held-out share of the rows.  ``hidden=()`` is the single linear layer
    of K14.

    ``validation`` rows, if given, take the place of the held-out share.  Training
    stops when the share of held-out rows right in every label (``stop_on="accuracy"``)
    or their loss (``"loss"``) hasn't bettered its best by more than ``tol`` for ``patience``
    epochs, and the best epoch's weights are kept; ``stop_on=None`` runs all epochs.
    Rows with null features or labels take no part.  A row's block and share follow from a
    seeded hash of its id, so two fits agree up to the rounding of sums.
    """

    def __init__(self, labels: list[str], hidden: tuple[int, ...] = (768,), alpha: float = 1e-4, rate: float = 1e-3,
                 batch_size: int = 200, max_epochs: int = 200, held_out: float = 0.1, patience: int = 10,
                 tol: float = 1e-4, stop_on: str | None = "accuracy", seed: int = 42):
        self.labels, self.hidden, self.alpha, self.rate = labels, hidden, alpha, rate
        self.batch_size, self.max_epochs, self.held_out, self.patience = batch_size, max_epochs, held_out, patience
        self.tol, self.stop_on, self.seed = tol, stop_on, seed

    def _rows(self, df: DataFrame, features_col: str, labels_col: str, id_col: str) -> DataFrame:
        known = df.filter(F.col(features_col).isNotNull() & F.col(labels_col).isNotNull())
        y = F.array(*[F.coalesce(self.target(v, F.col(labels_col)), F.lit(float("nan"))) for v in self.labels])
        whole = isinstance(df.schema[id_col].dataType, T.IntegralType)
        return known.select((F.col(id_col) if whole else F.xxhash64(id_col)).alias("id"), F.col(features_col).cast("array<double>").alias("x"), y.alias("y"))

    def target(self, label: str, labels: Column) -> Column:
        """1, 0 or null (doesn't count for this row) for one output of the net."""
        return F.array_contains(labels, label).cast("double")

    def block_order(self, epoch: int, blocks: int) -> list[int]:
        """The order in which an epoch visits the blocks."""
        return np.random.default_rng([self.seed, epoch]).permutation(blocks).tolist()

    def fit(self, df: DataFrame, features_col: str = "features", labels_col: str = "labels", id_col: str = "id",
            validation: DataFrame | None = None) -> JointNetModel:
        spark = df.sparkSession
        rows = self._rows(df, features_col, labels_col, id_col)
        share = F.lit(1000) if validation is not None else seeded_int(F.col("id"), seed=self.seed) % 1000
        train = rows.filter(share >= int(1000 * self.held_out))
        stats = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("w")).first()
        if not stats["n"]:
            raise ValueError("no training rows")
        blocks = max(1, min(MAX_BLOCKS, round(stats["n"] / self.batch_size)))
        path = scratch_path(spark, "net-blocks")
        spread = math.ceil(stats["n"] / blocks / TASK_ROWS)
        place = seeded_int(F.col("id"), seed=self.seed + 1)
        train = train.withColumn("block", (place % blocks).cast("int")).withColumn("_file", F.expr(f"id div {blocks} % {spread}"))
        block_bytes = 8 * (stats["w"] + len(self.labels)) * stats["n"] / blocks
        together = max(1, int(FOLDER_BYTES / block_bytes))  # blocks of a folder
        folder = F.expr(f"cast(block div {together} AS int)").alias("folder")
        train = train.repartition(folder, "_file").sortWithinPartitions("block", "id")
        packed(train, stats["w"], len(self.labels)).select("*", folder).write.partitionBy("folder").parquet(path)
        train = spark.read.parquet(path)
        held = (rows.filter(share < int(1000 * self.held_out)) if validation is None
                else self._rows(validation, features_col, labels_col, id_col))
        held_path = scratch_path(spark, "net-held-out")
        held.write.parquet(held_path)
        held = spark.read.parquet(held_path)
        held_tasks = held.rdd.getNumPartitions()

        sizes = [stats["w"], *self.hidden, len(self.labels)]
        weights = np.concatenate([np.r_[np.ones(a * b), np.zeros(b)] for a, b in zip(sizes, sizes[1:])])
        theta, adam = init_weights(sizes, self.seed), Adam(self.rate)
        best, kept, waited, curve = -math.inf, theta, 0, []
        # steps of a run: blocks of a task's bytes, if a task takes whole blocks
        steps = max(1, int(RUN_BYTES / block_bytes)) if spread == 1 else 0
        for epoch in range(1, self.max_epochs + 1):
            total, seen = 0.0, 0  # loss and cells
            order = self.block_order(epoch, blocks)
            if steps:
                for at in range(0, blocks, steps):
                    run = order[at:at + steps]
                    own = train.filter(f"folder IN ({', '.join(map(str, sorted({b // together for b in run})))})") if len(run) < blocks else train
                    theta, adam, loss, cells = run_steps(own, run, theta, adam, sizes, self.alpha * weights)
                    total, seen = total + loss, seen + cells
            else:
                for b in order:
                    g, loss, _, n, cells = batch_totals(train.filter(f"folder = {b // together} AND block = {b}"), theta, sizes, True, spread)
                    if n:
                        theta = theta - adam.step((g + self.alpha * weights * theta) / n)
                        total, seen = total + loss, seen + cells
            _, held_loss, hits, m, cells = batch_totals(held, theta, sizes, False, held_tasks)
            curve.append((epoch, total / max(1, seen), held_loss / max(1, cells), hits / max(1, m)))
            if self.stop_on and m:
                now = hits / m if self.stop_on == "accuracy" else -held_loss / max(1, cells)
                waited = 0 if now > best + self.tol else waited + 1
                if now > best:
                    best, kept = now, theta
                if waited >= self.patience:
                    break
            else:
                kept = theta
        return JointNetModel(self.labels, sizes, kept, curve)
