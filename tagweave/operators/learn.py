"""Multi-label learners on Spark ML.

All learners take a DataFrame with an ``array<float>`` feature column and an
``array<string>`` label column.  The training table is cached once; one
Spark ML model is fitted per label (or per taxonomy edge), several at a time
from a bounded thread pool (Spark schedules the concurrent jobs), like
``OneVsRest(parallelism=..)``.  Prediction is a chain of model transforms on
the same rows – no collect, no driver loop over data.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.operators.resample import oversample_random, smote


# Partition size for training tables of iterative fits: every optimiser
# iteration is one Spark job with one task per partition, so a small table
# spread over many partitions pays task overhead on every iteration.
ITER_PARTITION_BYTES = 64 << 20


def cache_for_iterations(df: DataFrame, features_col: str) -> DataFrame:
    """Cache a training table with partitions sized to its estimated bytes
    (rows x 8-byte features plus row overhead, ``ITER_PARTITION_BYTES`` per
    partition); never more partitions than it has (``coalesce``, no shuffle).
    Measured on the per-edge logistic fits of ``TopDown``: ~3.5x faster on a
    small table; a large table keeps one task per 64 MiB."""
    st = df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(features_col)).alias("w")).first()
    est = (st["n"] or 0) * (8 * (st["w"] or 0) + 64)
    return df.coalesce(max(1, math.ceil(est / ITER_PARTITION_BYTES))).cache()


def make_estimator(kind: str, n_features: int, seed: int = 42, **kw):
    """Factory for the base learners the reference offers."""
    if kind == "logreg":
        return LogisticRegression(maxIter=kw.get("max_iter", 600), regParam=kw.get("reg", 0.01),
                                  tol=kw.get("tol", 1e-6))
    if kind == "mlp":
        return MultilayerPerceptronClassifier(layers=[n_features, kw.get("hidden", 100), 2],
                                              maxIter=kw.get("max_iter", 400), seed=seed)
    if kind == "gbt":
        return GBTClassifier(maxIter=kw.get("max_iter", 100), maxDepth=kw.get("depth", 3), seed=seed)
    if kind == "tree":
        return DecisionTreeClassifier(maxDepth=kw.get("depth", 30), seed=seed)
    if kind == "forest":
        return RandomForestClassifier(numTrees=kw.get("trees", 100), maxDepth=kw.get("depth", 30),
                                      featureSubsetStrategy="sqrt", seed=seed)
    if kind == "extra_trees":
        return RandomForestClassifier(numTrees=kw.get("trees", 100), maxDepth=kw.get("depth", 30), bootstrap=False,
                                      featureSubsetStrategy="sqrt", seed=seed)
    if kind == "ridge":
        # regParam holds alpha here; fit() turns it into Spark's form (see ridge_penalty)
        return LinearRegression(regParam=kw.get("reg", 1.0), elasticNetParam=0.0, standardization=False)
    raise ValueError(f"unknown estimator {kind!r}")


def ridge_penalty(alpha: float, n: int, positives: int) -> float:
    """Spark's ``regParam`` for ridge's alpha * |w|^2 beside the summed squared error.

    Spark averages the error over the n rows and scales the penalty by the
    target's standard deviation (targets are +1 and -1 here)."""
    mean = (2 * positives - n) / n
    return alpha * math.sqrt(1 - mean * mean) / n


class ConstantModel:
    """Model of a label that all training rows have, or none (or no row at all)."""

    def __init__(self, i: int, value: float, regressor: bool):
        self.i, self.value, self.regressor = i, value, regressor

    def transform(self, df: DataFrame) -> DataFrame:
        if self.regressor:
            return df.withColumn(f"_p{self.i}", F.lit(2 * self.value - 1))
        prob = array_to_vector(F.array(F.lit(1 - self.value), F.lit(self.value)))
        return df.withColumn(f"_p{self.i}", F.lit(self.value)).withColumn(f"_prob{self.i}", prob)


def _is_regressor(est) -> bool:
    return isinstance(est, LinearRegression)


def _binary_target(labels_col: str, label: str, regressor: bool):
    y = F.array_contains(F.col(labels_col), label).cast("double")
    return (y * 2 - 1) if regressor else y


class BinaryRelevanceModel:
    def __init__(self, labels: list[str], models: list, features_col: str, regressor: bool):
        self.labels, self.models, self.features_col, self.regressor = labels, models, features_col, regressor

    def transform(self, df: DataFrame, out_col: str = "pred_labels") -> DataFrame:
        x = df.withColumn("_fv", array_to_vector(F.col(self.features_col)))
        for i, m in enumerate(self.models):
            x = m.transform(x)
        hits = []
        for i, lab in enumerate(self.labels):
            p = F.col(f"_p{i}")
            hits.append(F.when(p > 0 if self.regressor else p == 1, F.lit(lab)))
        x = x.withColumn(out_col, F.array_compact(F.array(*hits)))
        if not self.regressor:
            x = x.withColumn("scores", F.array(*[F.coalesce(F.get(vector_to_array(F.col(f"_prob{i}")), F.lit(1)), F.lit(0.0))
                                              for i in range(len(self.labels))]))
        tmp = [c for c in x.columns if c.startswith(("_p", "_prob", "_raw")) or c == "_fv"]
        return x.drop(*tmp)


class BinaryRelevance:
    """K1: one independent model per label.  ``samplers`` maps a label to
    (method, ratio) for per-label resampling before that label's fit (J4);
    a single (method, ratio) applies to every label."""

    def __init__(self, make: Callable[[], object], labels: list[str],
                 samplers: dict[str, tuple[str | None, float | None]] | tuple[str, float] | None = None,
                 parallelism: int = 8, seed: int = 42):
        self.make, self.labels, self.samplers, self.parallelism, self.seed = make, labels, samplers, parallelism, seed

    def _sampler(self, label: str):
        if self.samplers is None:
            return None, None
        if isinstance(self.samplers, tuple):
            return self.samplers
        return self.samplers.get(label, (None, None))

    def fit(self, df: DataFrame, features_col: str = "features", labels_col: str = "labels",
            id_col: str = "id") -> BinaryRelevanceModel:
        # a frame that the caller has cached is used as it is, not cached a second time
        own = df.storageLevel.useMemory is False
        base = cache_for_iterations(df.select(id_col, features_col, labels_col), features_col) if own else df
        regressor = _is_regressor(self.make())
        has = [F.coalesce(F.sum(F.array_contains(labels_col, lab).cast("long")), F.lit(0)) for lab in self.labels]
        n, *positives = base.agg(F.count(F.lit(1)), *has).first()

        def fit_one(i_lab):
            i, lab = i_lab
            if positives[i] in (0, n):
                return ConstantModel(i, float(positives[i] > 0), regressor)
            d = base.withColumn("_y", _binary_target(labels_col, lab, regressor))
            method, ratio = self._sampler(lab)
            if method:
                d = d.withColumn("_yb", F.array_contains(labels_col, lab).cast("int"))
                d = (oversample_random(d, "_yb", ratio, id_col, self.seed, on_reached="skip") if method == "random" else
                     smote(d, "_yb", features_col, ratio, id_col, self.seed, on_reached="skip"))
                # synthetic rows have no label list; the sampled class decides
                d = d.withColumn("_y", F.col("_yb") * 2.0 - 1.0 if regressor else F.col("_yb").cast("double"))
            d = d.withColumn("_fv", array_to_vector(F.col(features_col)))
            est = self.make().setFeaturesCol("_fv").setLabelCol("_y").setPredictionCol(f"_p{i}")
            if regressor:
                rows, pos = (n, positives[i]) if not method else d.agg(
                    F.count(F.lit(1)), F.sum((F.col("_y") > 0).cast("long"))).first()
                est = est.setRegParam(ridge_penalty(est.getRegParam(), rows, pos))
            else:
                est = est.setProbabilityCol(f"_prob{i}").setRawPredictionCol(f"_raw{i}")
            return est.fit(d)

        try:
            with ThreadPoolExecutor(max_workers=self.parallelism) as pool:
                models = list(pool.map(fit_one, enumerate(self.labels)))
        finally:
            if own:
                base.unpersist()
        return BinaryRelevanceModel(self.labels, models, features_col, regressor)


class ClassifierChainModel:
    def __init__(self, labels, models, features_col):
        self.labels, self.models, self.features_col = labels, models, features_col

    def transform(self, df: DataFrame, out_col: str = "pred_labels") -> DataFrame:
        x = df.withColumn("_fv0", array_to_vector(F.col(self.features_col)))
        for i, m in enumerate(self.models):
            x = m["asm"].transform(x) if m["asm"] is not None else x.withColumn(f"_fv{i}_in", F.col("_fv0"))
            x = m["model"].transform(x).withColumn(f"_y{i}", F.col(f"_p{i}"))
        hits = [F.when(F.col(f"_y{i}") == 1, F.lit(lab)) for i, lab in enumerate(self.labels)]
        x = x.withColumn(out_col, F.array_compact(F.array(*hits)))
        return x.drop(*[c for c in x.columns if c.startswith(("_p", "_prob", "_raw", "_fv", "_y"))])


class ClassifierChain:
    """K5: label j is fitted on the features plus the TRUE labels 0..j-1 and
    predicted on the features plus the PREDICTED labels 0..j-1."""

    def __init__(self, make: Callable[[], object], labels: list[str]):
        self.make, self.labels = make, labels

    def fit(self, df: DataFrame, features_col: str = "features", labels_col: str = "labels") -> ClassifierChainModel:
        base = df.withColumn("_fv0", array_to_vector(F.col(features_col)))
        for i, lab in enumerate(self.labels):
            base = base.withColumn(f"_y{i}", F.array_contains(labels_col, lab).cast("double"))
        base = base.cache()
        out = []
        for i, _ in enumerate(self.labels):
            asm = None
            if i > 0:
                asm = VectorAssembler(inputCols=["_fv0"] + [f"_y{j}" for j in range(i)], outputCol=f"_fv{i}_in")
                d = asm.transform(base)
            else:
                d = base.withColumn(f"_fv{i}_in", F.col("_fv0"))
            est = (self.make().setFeaturesCol(f"_fv{i}_in").setLabelCol(f"_y{i}").setPredictionCol(f"_p{i}")
                   .setProbabilityCol(f"_prob{i}").setRawPredictionCol(f"_raw{i}"))
            out.append({"asm": asm, "model": est.fit(d)})
        base.unpersist()
        return ClassifierChainModel(self.labels, out, features_col)


class TopDownModel:
    def __init__(self, order, children, models, threshold, features_col):
        self.order, self.children, self.models = order, children, models
        self.threshold, self.features_col = threshold, features_col

    def transform(self, df: DataFrame, out_col: str = "pred_labels", root: str = "__root__") -> DataFrame:
        x = df.withColumn(out_col, F.array().cast("array<string>"))
        for node in self.order:
            kids = self.children[node]
            scored = self.models[node].transform(x)
            probs = F.col("scores")
            chosen = F.filter(F.array(*[F.when(probs[i] >= self.threshold, F.lit(k)) for i, k in enumerate(kids)]),
                              lambda v: v.isNotNull())
            best = F.element_at(F.array(*[F.lit(k) for k in kids]),
                                F.array_position(probs, F.array_max(probs)).cast("int"))
            pick = F.when(F.size(chosen) > 0, chosen).otherwise(F.array(best))
            active = F.lit(True) if node == root else F.array_contains(out_col, node)
            x = scored.withColumn(out_col, F.when(active, F.array_union(out_col, pick)).otherwise(F.col(out_col)))
            x = x.drop("scores", "pred_labels_" + node.replace(" ", "_"))
        return x


class TopDown:
    """K7: hierarchical top-down learner over a taxonomy.  Per internal node a
    binary-relevance model over its children, trained on the rows whose
    closure holds the node (all rows for the root).  Prediction descends
    from the root in topological order, keeps children with p >= threshold,
    and follows the arg-max child when none passes (mandatory leaf)."""

    def __init__(self, make: Callable[[], object], edges: list[tuple[str, str]], threshold: float = 0.35,
                 root: str = "__root__", parallelism: int = 8):
        self.make, self.threshold, self.root, self.parallelism = make, threshold, root, parallelism
        self.children: dict[str, list[str]] = {}
        for p, c in edges:
            self.children.setdefault(p, []).append(c)
        for p in self.children:
            self.children[p] = sorted(set(self.children[p]))
        # topological order: a child has strictly more ancestors than its parents
        parents: dict[str, set[str]] = {}
        for p, c in edges:
            parents.setdefault(c, set()).add(p)

        def n_anc(n, seen=None):
            seen = set() if seen is None else seen
            for p in parents.get(n, ()):
                if p not in seen:
                    seen.add(p)
                    n_anc(p, seen)
            return len(seen)

        self.order = sorted(self.children, key=lambda n: (n_anc(n), n))

    def fit(self, df: DataFrame, features_col: str = "features", closure_col: str = "labels",
            id_col: str = "id") -> TopDownModel:
        base = cache_for_iterations(df.select(id_col, features_col, closure_col), features_col)

        def fit_node(node):
            # one node after the other, its rows cached while its children are fitted; a node
            # without rows gives constant models, which predict nothing below it
            rows = base if node == self.root else cache_for_iterations(
                base.filter(F.array_contains(closure_col, node)), features_col)
            try:
                br = BinaryRelevance(self.make, self.children[node], parallelism=self.parallelism)
                return br.fit(rows, features_col, closure_col, id_col)
            finally:
                if node != self.root:
                    rows.unpersist()

        try:
            models = {node: fit_node(node) for node in self.order}
        finally:
            base.unpersist()
        return TopDownModel(self.order, self.children, _ScoresOnly(models), self.threshold, features_col)


class _ScoresOnly:
    """Adapter: a node's BR model that only adds its ``scores`` column."""

    def __init__(self, models):
        self.models = models

    def __getitem__(self, node):
        m = self.models[node]

        class _T:
            @staticmethod
            def transform(df):
                return m.transform(df, out_col="pred_labels_" + node.replace(" ", "_"))

        return _T
