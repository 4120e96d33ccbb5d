"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are range-sorted by length, longest first, and read in buckets of similar
length.  For a query q whose k-th best score so far is s, a bucket with longest
vector l has the local cosine threshold t = s / (|q| l):

* t > 1: no vector of the bucket, nor of any later one, can reach s; it is skipped.
* t high: coordinate pruning.  A vector within the angle of t has, in the query's
  largest coordinates, values in a small interval; only such vectors are verified.
* else: length pruning.  Vectors shorter than s / |q| are left out.

What is left is verified by exact integer products.  Queries are taken in
blocks of bounded size that go to all tasks; a task keeps k rows a query.
Thresholds start from the scores among the longest vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.common import materialize, narrow, shuffle_tasks
from tagweave.session import scratch_path

QUERY_BLOCK = 4096
BUCKET_ROWS, BUCKET_RATIO = 2048, 0.9
#: From this local cosine on coordinates prune better than lengths.
COORDINATE_COSINE = 0.7
FOCUS = 4
#: Relative slack of the pruning bounds against rounding.
SLACK = 1e-9


def quantized(vec: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double; null unless all are finite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(vec.isNotNull() & finite, F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def matrix(rows, dims: int) -> np.ndarray:
    """Rows of components, missing ones as 0."""
    out = np.zeros((len(rows), dims), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


class Best:
    """The k best (score, id) of each query: higher scores first, of equal ones the smaller id."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.n, self.k, self.floor = n, k, floor.copy()
        self.q = np.zeros(0, np.int64)
        self.id, self.score = self.q.copy(), self.q.copy()

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(q):
            return
        q, ids, score = (np.concatenate(x) for x in ((self.q, q), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        start = np.searchsorted(q, q, side="left")
        rank = np.arange(len(q)) - start
        kth = rank == self.k - 1
        self.floor[q[kth]] = np.maximum(self.floor[q[kth]], score[kth])
        keep = rank < self.k
        self.q, self.id, self.score = q[keep], ids[keep], score[keep]


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer products; through floating point where that is exact."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    if top < 2.0 ** 53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


class Search:
    """One task's search of buckets that come longest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.vectors = ids, vectors
        as_float = vectors.astype(np.float64)
        self.norms = np.sqrt((as_float ** 2).sum(1))
        self.unit = as_float / np.where(self.norms > 0, self.norms, 1)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1)[:, :FOCUS]
        self.best = Best(len(ids), k, floor)

    def bucket(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        as_float = vectors.astype(np.float64)
        norms = np.sqrt((as_float ** 2).sum(1))
        floor, longest = self.best.floor.astype(np.float64), norms.max(initial=0)
        reach = self.norms * longest
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(reach > 0, floor / reach, np.where(floor > 0, np.inf, -1))
        live = local <= 1 + SLACK
        by_coordinate = np.flatnonzero(live & (local >= COORDINATE_COSINE))
        by_length = np.flatnonzero(live & (local < COORDINATE_COSINE))
        if len(by_coordinate):
            unit = as_float / np.where(norms > 0, norms, 1)[:, None]
            for q in by_coordinate:
                self._verify(np.array([q]), self._near(q, min(1.0, local[q]), unit), ids, vectors)
        if len(by_length):
            # bucket rows stand longest first: the shortest length any query needs ends them
            need = np.where(self.norms[by_length] > 0, floor[by_length] / np.maximum(self.norms[by_length], SLACK), -1)
            self._verify(by_length, np.flatnonzero(norms >= need.min() * (1 - SLACK) - SLACK if need.min() > 0
                                                   else np.ones(len(norms), bool)), ids, vectors)

    def _near(self, q: int, t: float, unit: np.ndarray) -> np.ndarray:
        """Rows that lie, in the focus coordinates, where a cosine of t or more needs them."""
        rows = np.arange(len(unit))
        for f in self.focus[q]:
            c = self.unit[q, f]
            spread = np.sqrt(max(0.0, (1 - t * t) * (1 - c * c)))
            low = c * t - spread if c > -t else -1.0
            high = c * t + spread if c < t else 1.0
            x = unit[rows, f]
            rows = rows[(x >= low - 1e-7) & (x <= high + 1e-7)]
        return rows

    def _verify(self, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(rows):
            return
        scores = products(self.vectors[q], vectors[rows])
        at_least = self.best.floor[q]
        own = self.ids[q][:, None] == ids[rows][None, :]
        if len(rows) > self.best.k:
            # the k-th best of this bucket (its own row aside) is a floor as well
            ranked = np.where(own, np.iinfo(np.int64).min, scores)
            at_least = np.maximum(at_least, np.partition(ranked, -self.best.k, axis=1)[:, -self.best.k])
        i, j = np.nonzero((scores >= at_least[:, None]) & ~own)
        self.best.add(q[i], ids[rows][j], scores[i, j])


def _buckets(frames: Iterator[pd.DataFrame], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of rows in order, at most BUCKET_ROWS long and of similar lengths."""
    for pdf in frames:
        n2 = pdf["n2"].to_numpy()
        at = 0
        while at < len(pdf):
            end = min(at + BUCKET_ROWS, len(pdf))
            short = np.flatnonzero(n2[at:end] < n2[at] * BUCKET_RATIO ** 2)
            end = at + int(short[0]) if len(short) and short[0] else end
            part = pdf.iloc[at:end]
            yield part["vec_id"].to_numpy(np.int64), matrix(part["v"], dims)
            at = end


def _search(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, k: int) -> DataFrame:
    """k best rows of each task for one block of queries, all at or above ``floor``."""
    block = rows.sparkSession.sparkContext.broadcast((ids, vectors.astype(np.int64), floor))
    dims = vectors.shape[1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Search(*block.value, k)
        for bucket_ids, bucket in _buckets(frames, dims):
            search.bucket(bucket_ids, bucket)
        best = search.best
        yield pd.DataFrame({"query": best.q, "query_id": search.ids[best.q], "vec_id": best.id, "score": best.score})

    return rows.select("vec_id", "v", "n2").mapInPandas(run, "query long, query_id long, vec_id long, score long")


def top_products(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding",
                 scale: int = 256, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest inner products.

    Queries are the rows whose id is divisible by ``every``, candidates all rows
    but the query's own id; components are floor(scale * x).  Ties go to the
    smaller id.  Vectors that are null or hold null or non-finite components take
    no part, nor do null ids; shorter vectors count as filled up with zeros; rows
    that repeat id and vector count once.  Scores are 64-bit integers: components so large
    that a product could exceed them raise a ``ValueError``.  Fewer candidates than k give all of
    them; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    src = narrow(vectors, vec_id=id_col, vec=vec_col).select(F.col("vec_id").cast("long"), quantized(F.col("vec"), scale).alias("v"))
    src = src.filter("vec_id is not null and v is not null").distinct()
    n2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = (src.withColumn("n2", n2).repartitionByRange(shuffle_tasks(spark), F.desc("n2"), "vec_id")
            .withColumn("part", F.spark_partition_id()).sortWithinPartitions(F.desc("n2"), "vec_id"))
    rows = materialize(rows, "vectors-by-norm")
    dims, first = rows.agg(F.max(F.size("v")), F.min("part")).first()
    largest = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.greatest(x, -x))))).first()[0] or 0
    if largest * largest * (dims or 0) >= 1 << 63:
        raise ValueError(f"components up to {largest} in {dims} dimensions have products beyond 64 bits")
    asked = rows.filter(F.col("vec_id") % every == 0)
    n_blocks = max(1, -(-asked.count() // query_block))
    asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))), "queries")
    found = scratch_path(spark, "top-of-tasks")
    schema = "query_id long, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(found)
    for b in range(n_blocks):
        # a block of about query_block rows: the only queries the driver holds
        block = asked.filter(F.col("block") == b).select("vec_id", "v").toPandas()
        if block.empty:
            continue
        ids, q = block["vec_id"].to_numpy(np.int64), matrix(block["v"], max(1, dims))
        floor = np.full(len(ids), np.iinfo(np.int64).min // 2)
        seed = _search(rows.filter(F.col("part") == first), ids, q, floor, k)
        kth = seed.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
        for r in kth.filter(F.col("r") == k).select("query", "score").collect():
            floor[r.query] = r.score
        _search(rows, ids, q, floor, k).select("query_id", "vec_id", "score").write.mode("append").parquet(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (spark.read.schema(schema).parquet(found).distinct().withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
