"""Multi-output trees (K8, K9): one tree for all labels, grown level by level.

A node's split lowers the Gini impurity summed over the labels.  The candidate cuts of
a (node, feature) lie between its least and greatest value in the node, found over all
partitions: evenly spaced for an exact-style tree, one uniform draw for an extremely
randomised one.  A level is two aggregates (extents, then counts left of the candidates)
over one scan for all open nodes of all trees; rows keep no state, each task sends them
through the trees grown so far.  Nodes of few rows are finished each in one task.  Draws
depend on (seed, tree, node) only, so where a node is grown doesn't change the tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.session import scratch_path

NODE_SCHEMA = "tree int, node long, feature int, cut double, value binary"


@dataclass
class Tree:
    """Splits by node number (root 1, children 2i and 2i + 1) and the leaves' label shares."""

    nodes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    leaves: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    values: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def route(self, x: np.ndarray) -> np.ndarray:
        """The node at which each row ends."""
        at = np.ones(len(x), dtype=np.int64)
        moving = np.arange(len(x))
        while len(moving) and len(self.nodes):
            i = np.searchsorted(self.nodes, at[moving])
            i[i == len(self.nodes)] = 0
            inner = self.nodes[i] == at[moving]
            moving, i = moving[inner], i[inner]
            at[moving] = 2 * at[moving] + (x[moving, self.features[i]] > self.cuts[i])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.values[np.searchsorted(self.leaves, self.route(x))]


def tree_of(rows: list[tuple[int, int, float, np.ndarray | None]]) -> Tree:
    """A tree from (node, feature, cut, value) rows; leaves have a value."""
    inner = sorted((r for r in rows if r[3] is None), key=lambda r: r[0])
    leaves = sorted((r for r in rows if r[3] is not None), key=lambda r: r[0])
    return Tree(np.array([r[0] for r in inner], np.int64), np.array([r[1] for r in inner], np.int64),
                np.array([r[2] for r in inner], float), np.array([r[0] for r in leaves], np.int64),
                np.array([r[3] for r in leaves], float))


@dataclass(frozen=True)
class Growth:
    """``cuts``: evenly spaced candidates a feature, or 0 for one random draw; ``features``:
    features tried a node (those that vary, in random order), 0 for all of them."""

    cuts: int = 31
    features: int = 0
    max_depth: int = 30
    seed: int = 42

    def candidates(self, tree: int, node: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features to try, ascending; cuts as feature x candidate)."""
        rng = np.random.default_rng([self.seed, tree, node])
        order, draws = rng.permutation(len(low)), rng.random(len(low))
        order = order[high[order] > low[order]]
        tried = np.sort(order[:self.features] if self.features else order)
        share = draws[tried, None] if not self.cuts else np.arange(1, self.cuts + 1)[None] / (self.cuts + 1)
        lo, hi = low[tried, None], high[tried, None]
        # a draw may round up to the greatest value, which would leave no row to the right
        return tried, np.minimum(lo + share * (hi - lo), np.nextafter(hi, lo))

    def closed(self, node: int, n: int, y_sum: np.ndarray) -> bool:
        pure = bool(((y_sum == 0) | (y_sum == n)).all())
        return pure or n < 2 or int(node).bit_length() > self.max_depth


def left_counts(x: np.ndarray, y: np.ndarray, tried: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Rows and positives of each label at or below each cut: feature x cut x (1 + labels)."""
    out = np.zeros((len(tried), cuts.shape[1] + 1, 1 + y.shape[1]))
    for k, f in enumerate(tried):
        bin_ = np.searchsorted(cuts[k], x[:, f], side="left")  # cuts below the value
        out[k, :, 0] = np.bincount(bin_, minlength=cuts.shape[1] + 1)
        for j in range(y.shape[1]):
            out[k, :, 1 + j] = np.bincount(bin_, weights=y[:, j], minlength=cuts.shape[1] + 1)
    return out.cumsum(axis=1)[:, :-1]


def best_split(left: np.ndarray, n: int, y_sum: np.ndarray) -> tuple[int, int] | None:
    """(feature, cut) indices of the least impurity summed over labels; the first of equals."""
    nl, pl = left[..., 0], left[..., 1:]
    nr, pr = n - nl, y_sum - pl
    with np.errstate(divide="ignore", invalid="ignore"):
        cost = (pl * (nl[..., None] - pl) / nl[..., None]).sum(-1) + (pr * (nr[..., None] - pr) / nr[..., None]).sum(-1)
    cost = np.where((nl > 0) & (nr > 0), cost, np.inf)
    if not cost.size or not np.isfinite(cost).any():
        return None
    # integers below 2^53 in, so equal costs differ by rounding only
    k, c = np.unravel_index(int(np.argmin(np.round(cost, 9))), cost.shape)
    return int(k), int(c)


def grow_here(tree: int, node: int, x: np.ndarray, y: np.ndarray, how: Growth) -> list[tuple]:
    """The subtree below ``node`` of the rows, as (node, feature, cut, value)."""
    out, todo = [], [(node, np.arange(len(x)))]
    while todo:
        node, at = todo.pop()
        xs, ys = x[at], y[at]
        y_sum, split = ys.sum(axis=0), None
        if not how.closed(node, len(at), y_sum):
            tried, cuts = how.candidates(tree, node, xs.min(axis=0), xs.max(axis=0))
            split = best_split(left_counts(xs, ys, tried, cuts), len(at), y_sum) if len(tried) else None
        if split is None:
            out.append((node, -1, 0.0, y_sum / len(at)))
            continue
        f, cut = int(tried[split[0]]), float(cuts[split])
        out.append((node, f, cut, None))
        right = xs[:, f] > cut
        todo += [(2 * node, at[~right]), (2 * node + 1, at[right])]
    return out


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(rows, -1)


def _open_rows(batches: Iterator[pa.RecordBatch], trees: list[Tree], open_: list[set[int]]):
    """(tree, node, x, y) for the rows of every batch at the open nodes."""
    for batch in batches:
        if not len(batch):
            continue
        x, y = _matrix(batch.column(0), len(batch)), _matrix(batch.column(1), len(batch))
        for t, tree in enumerate(trees):
            if open_[t]:
                at = tree.route(x)
                for node in open_[t].intersection(np.unique(at).tolist()):
                    here = at == node
                    yield t, node, x[here], y[here]


def _as_bytes(**arrays) -> dict:
    return {k: np.ascontiguousarray(v, dtype=np.float64).tobytes() for k, v in arrays.items()}


@dataclass
class MultiOutputTreesModel:
    labels: list[str]
    trees: list[Tree]

    def scores(self, features: Column, spark) -> Column:
        """Mean label shares over the trees, in the order of ``labels``; null features give null."""
        shared = spark.sparkContext.broadcast(self.trees)

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                known = s.notna().to_numpy()
                out = pd.Series([None] * len(s), index=s.index, dtype=object)
                if known.any():
                    x = np.array([np.asarray(v, dtype=np.float64) for v in s[known]])
                    out[known] = pd.Series(list(sum(t.predict(x) for t in shared.value) / len(shared.value)), index=s.index[known])
                yield out

        return run(features.cast("array<double>"))

    def transform(self, df: DataFrame, features_col: str = "features", out_col: str = "pred_labels") -> DataFrame:
        """Adds ``scores`` and the labels with a share above one half."""
        x = df.withColumn("scores", self.scores(F.col(features_col), df.sparkSession))
        hits = F.transform(F.arrays_zip("scores", F.array(*[F.lit(v) for v in self.labels]).alias("label")),
                           lambda z: F.when(z["scores"] > 0.5, z["label"]))
        return x.withColumn(out_col, F.array_compact(hits))


class MultiOutputTrees:
    """``trees`` trees for all labels together.

    ``kind``: ``"tree"`` tries all features with evenly spaced cuts, ``"extra"`` the square
    root of them with one random cut each (the extremely randomised tree; many of them are
    the extra trees of K9).  Nodes of at most ``local_rows`` rows are finished in one task
    each, larger ones by aggregates.  Rows with null features or labels take no part.
    """

    def __init__(self, labels: list[str], kind: str = "extra", trees: int = 1, max_depth: int = 30, seed: int = 42,
                 local_rows: int = 10_000, cuts: int = 31):
        if kind not in ("tree", "extra"):
            raise ValueError(f"unknown kind {kind!r}")
        self.labels, self.kind, self.trees, self.max_depth = labels, kind, trees, max_depth
        self.seed, self.local_rows, self.cuts = seed, local_rows, cuts

    def growth(self, width: int) -> Growth:
        extra = self.kind == "extra"
        return Growth(0 if extra else self.cuts, max(1, int(width**0.5)) if extra else 0, self.max_depth, self.seed)

    def fit(self, df: DataFrame, features_col: str = "features", labels_col: str = "labels") -> MultiOutputTreesModel:
        spark = df.sparkSession
        y = F.array(*[F.array_contains(labels_col, v).cast("double") for v in self.labels])
        path = scratch_path(spark, "tree-rows")
        df.filter(F.col(features_col).isNotNull() & F.col(labels_col).isNotNull()).select(
            F.col(features_col).cast("array<double>").alias("x"), y.alias("y")).write.parquet(path)
        rows = spark.read.parquet(path)
        n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
        if not n:
            raise ValueError("no training rows")
        how = self.growth(width)
        grown: list[list[tuple]] = [[] for _ in range(self.trees)]
        # open nodes with their row counts; large ones are split by aggregates, small ones later in tasks
        large = {(t, 1): n for t in range(self.trees)} if n > self.local_rows else {}
        small = {(t, 1) for t in range(self.trees)} if n <= self.local_rows else set()
        while large:
            found = self._split_level(rows, [tree_of(g) for g in grown], large, how)
            large = {}
            for (t, node), (f, cut, value, n_left, n_all) in found.items():
                grown[t].append((node, f, cut, value))
                if value is None:
                    for child, m in ((2 * node, n_left), (2 * node + 1, n_all - n_left)):
                        if m > self.local_rows:
                            large[t, child] = m
                        else:
                            small.add((t, child))
        for t, rows_of in self._finish(rows, [tree_of(g) for g in grown], small, how).items():
            grown[t] += rows_of
        return MultiOutputTreesModel(self.labels, [tree_of(g) for g in grown])

    def _by_tree(self, nodes) -> list[set[int]]:
        out: list[set[int]] = [set() for _ in range(self.trees)]
        for t, node in nodes:
            out[t].add(node)
        return out

    def _split_level(self, rows: DataFrame, trees: list[Tree], large, how: Growth) -> dict:
        """(feature, cut, value, rows left, rows) of every open node; leaves have a value."""
        spark = rows.sparkSession
        state = spark.sparkContext.broadcast((trees, self._by_tree(large)))

        def extents(batches):
            seen: dict = {}
            for t, node, x, y in _open_rows(batches, *state.value):
                got = [len(x), y.sum(axis=0), x.min(axis=0), x.max(axis=0)]
                old = seen.get((t, node))
                seen[t, node] = got if old is None else [old[0] + got[0], old[1] + got[1], np.minimum(old[2], got[2]), np.maximum(old[3], got[3])]
            for (t, node), (m, ys, lo, hi) in seen.items():
                yield pa.RecordBatch.from_pylist([dict(tree=t, node=node, n=m, **_as_bytes(y=ys, low=lo, high=hi))], schema=pa.schema(
                    [("tree", pa.int32()), ("node", pa.int64()), ("n", pa.int64()), ("y", pa.binary()), ("low", pa.binary()), ("high", pa.binary())]))

        def widest(pdf: pd.DataFrame) -> pd.DataFrame:
            def stack(c):
                return np.array([np.frombuffer(b) for b in pdf[c]])

            return pd.DataFrame([dict(tree=pdf["tree"].iloc[0], node=pdf["node"].iloc[0], n=pdf["n"].sum(),
                                      **_as_bytes(y=stack("y").sum(0), low=stack("low").min(0), high=stack("high").max(0)))])

        schema = "tree int, node long, n long, y binary, low binary, high binary"
        spans = rows.mapInArrow(extents, schema).groupBy("tree", "node").applyInPandas(widest, schema).collect()
        totals, plans, done = {}, {}, {}
        for r in spans:
            y_sum, low, high = (np.frombuffer(bytes(b)) for b in (r.y, r.low, r.high))
            totals[r.tree, r.node] = (r.n, y_sum)
            tried, cuts = how.candidates(r.tree, r.node, low, high)
            if how.closed(r.node, r.n, y_sum) or not len(tried):
                done[r.tree, r.node] = (-1, 0.0, y_sum / r.n, 0, r.n)
            else:
                plans[r.tree, r.node] = (tried, cuts)
        state.destroy()
        if not plans:
            return done
        state = spark.sparkContext.broadcast((trees, self._by_tree(plans)))
        shared = spark.sparkContext.broadcast((plans, {k: totals[k] for k in plans}))

        def below(batches):
            seen: dict = {}
            for t, node, x, y in _open_rows(batches, *state.value):
                got = left_counts(x, y, *shared.value[0][t, node])
                seen[t, node] = seen[t, node] + got if (t, node) in seen else got
            for (t, node), counts in seen.items():
                yield pa.RecordBatch.from_pylist([dict(tree=t, node=node, **_as_bytes(counts=counts))], schema=pa.schema(
                    [("tree", pa.int32()), ("node", pa.int64()), ("counts", pa.binary())]))

        def choose(pdf: pd.DataFrame) -> pd.DataFrame:
            t, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
            (tried, cuts), (m, y_sum) = shared.value[0][t, node], shared.value[1][t, node]
            counts = sum(np.frombuffer(b) for b in pdf["counts"]).reshape(len(tried), cuts.shape[1], -1)
            split = best_split(counts, m, y_sum)
            f, cut, left = (-1, 0.0, 0) if split is None else (int(tried[split[0]]), float(cuts[split]), int(counts[split][0]))
            return pd.DataFrame([(t, node, f, cut, left)], columns=["tree", "node", "feature", "cut", "rows_left"])

        picks = rows.mapInArrow(below, "tree int, node long, counts binary").groupBy("tree", "node").applyInPandas(
            choose, "tree int, node long, feature int, cut double, rows_left long").collect()
        state.destroy()
        shared.destroy()
        for r in picks:
            m, y_sum = totals[r.tree, r.node]
            done[r.tree, r.node] = (r.feature, r.cut, None if r.feature >= 0 else y_sum / m, r.rows_left, m)
        return done

    def _finish(self, rows: DataFrame, trees: list[Tree], small, how: Growth) -> dict[int, list[tuple]]:
        """The subtrees of the small nodes, each grown in one task from its own rows."""
        if not small:
            return {}
        state = rows.sparkSession.sparkContext.broadcast((trees, self._by_tree(small)))
        schema = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("n", pa.int64())])

        def deal(batches):
            for t, node, x, y in _open_rows(batches, *state.value):
                yield pa.RecordBatch.from_pylist([dict(tree=t, node=node, n=len(x), **_as_bytes(x=x, y=y))], schema=schema)

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            t, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
            x = np.concatenate([np.frombuffer(b).reshape(n, -1) for b, n in zip(pdf["x"], pdf["n"])])
            y = np.concatenate([np.frombuffer(b).reshape(n, -1) for b, n in zip(pdf["y"], pdf["n"])])
            out = grow_here(t, node, x, y, how)
            return pd.DataFrame([(t, i, f, c, None if v is None else v.tobytes()) for i, f, c, v in out],
                                columns=["tree", "node", "feature", "cut", "value"])

        found = rows.mapInArrow(deal, "tree int, node long, x binary, y binary, n long").groupBy("tree", "node").applyInPandas(grow, NODE_SCHEMA)
        out: dict[int, list[tuple]] = {}
        for r in found.toLocalIterator():
            out.setdefault(r.tree, []).append((r.node, r.feature, r.cut, None if r.value is None else np.frombuffer(bytes(r.value))))
        return out
