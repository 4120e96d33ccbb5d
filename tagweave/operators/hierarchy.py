"""Hierarchical learner by path probabilities over a label DAG (K7).

Every edge (parent, child) has a local probability: that of the child for rows that
hold the parent.  All local models are the outputs of one net that is trained at once; a
row counts for an edge only if its labels hold the parent.  A label's probability is
the best product of local probabilities over all its paths from the root, which a
best-first descent finds and which one pass in topological order computes for whole
batches (a child is never likelier than its best parent).

Prediction keeps what reaches the threshold.  It goes down to leaves: where none of a
kept node's children reaches it, the node's likeliest child is kept as well, and so on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.operators.nets import JointNet, JointNetModel

ROOT = "__root__"


def topological(edges: list[tuple[str, str]], root: str = ROOT) -> list[str]:
    """Nodes reachable from the root, parents before children; raises on a cycle."""
    kids: dict[str, list[str]] = {}
    for p, c in edges:
        kids.setdefault(p, []).append(c)
    order, state = [], {}

    def visit(node):
        if state.get(node) == 1:
            raise ValueError(f"cycle at {node!r}")
        if node not in state:
            state[node] = 1
            for k in sorted(kids.get(node, [])):
                visit(k)
            state[node] = 2
            order.append(node)

    visit(root)
    return order[::-1]


def descend(local: np.ndarray, edges: list[tuple[str, str]], order: list[str], threshold: float,
            root: str = ROOT) -> tuple[np.ndarray, np.ndarray]:
    """(path probability, kept) of every row and node of ``order``; ``local`` is row x edge."""
    at = {node: i for i, node in enumerate(order)}
    path, kept = np.zeros((len(local), len(order))), np.zeros((len(local), len(order)), dtype=bool)
    path[:, at[root]], kept[:, at[root]] = 1.0, True
    out: dict[str, list[int]] = {}
    for e, (p, _) in enumerate(edges):
        out.setdefault(p, []).append(e)
    for node in order:
        for e in out.get(node, ()):
            c = at[edges[e][1]]
            path[:, c] = np.maximum(path[:, c], path[:, at[node]] * local[:, e])
    for node in order:
        if node not in out:
            continue
        kids = np.array([at[edges[e][1]] for e in out[node]])
        reached = path[:, kids] >= threshold
        best = np.argmax(local[:, out[node]], axis=1)
        forced = ~reached.any(axis=1)
        pick = reached | (forced[:, None] & (np.arange(len(kids)) == best[:, None]))
        kept[:, kids] |= kept[:, [at[node]]] & pick
    return path, kept


class EdgeNet(JointNet):
    """A net with one output per edge; rows without the parent don't count for it."""

    def __init__(self, edges: list[tuple[str, str]], root: str = ROOT, **settings):
        self.edges = {f"{i}": e for i, e in enumerate(edges)}
        self.root = root
        super().__init__(list(self.edges), **settings)

    def target(self, label: str, labels: Column) -> Column:
        parent, child = self.edges[label]
        held = F.lit(True) if parent == self.root else F.array_contains(labels, parent)
        return F.when(held, F.array_contains(labels, child).cast("double"))


class PathDescentModel:
    """``net`` gives the local probabilities of ``edges``."""

    def __init__(self, net: JointNetModel, edges: list[tuple[str, str]], threshold: float, root: str = ROOT):
        self.net, self.edges, self.threshold, self.root = net, edges, threshold, root
        self.order = topological(edges, root)

    def transform(self, df: DataFrame, features_col: str = "features", out_col: str = "pred_labels") -> DataFrame:
        """Adds the kept labels, ancestors included, in topological order, and ``path_scores``,
        the probabilities of all labels in that order; null features give null."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("labels array<string>, scores array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            m = shared.value
            for s in batches:
                known = s.notna().to_numpy()
                out = pd.DataFrame({"labels": [None] * len(s), "scores": [None] * len(s)}, index=s.index, dtype=object)
                if known.any():
                    x = np.array([np.asarray(v, dtype=np.float64) for v in s[known]])
                    path, kept = descend(m.net.probabilities(x), m.edges, m.order, m.threshold, m.root)
                    names = np.array(m.order[1:], dtype=object)
                    out.loc[known, "labels"] = pd.Series([names[k].tolist() for k in kept[:, 1:]], index=s.index[known])
                    out.loc[known, "scores"] = pd.Series([p.tolist() for p in path[:, 1:]], index=s.index[known])
                yield out

        x = df.withColumn("_down", run(F.col(features_col).cast("array<double>")))
        return x.withColumn(out_col, F.col("_down.labels")).withColumn("path_scores", F.col("_down.scores")).drop("_down")


class PathDescent:
    """K7: local models for all edges, then the descent.  ``labels`` of the training rows are
    closed under ancestors.  Settings other than the threshold are those of ``JointNet``."""

    def __init__(self, edges: list[tuple[str, str]], threshold: float = 0.35, root: str = ROOT, **settings):
        self.edges, self.threshold, self.root, self.settings = sorted(set(edges)), threshold, root, settings

    def fit(self, df: DataFrame, features_col: str = "features", labels_col: str = "labels", id_col: str = "id") -> PathDescentModel:
        net = EdgeNet(self.edges, self.root, **self.settings).fit(df, features_col, labels_col, id_col)
        return PathDescentModel(net, self.edges, self.threshold, self.root)
