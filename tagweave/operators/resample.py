"""Rebalancing (J1-J4): random oversampling and SMOTE with exact target
counts, deterministic per seed, never dropping an original row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.seeded import MODULUS, seeded_int, seeded_int_sql, seeded_unit
from tagweave.operators.clean import with_row_index
from tagweave.operators.neighbours import knn_join


class RatioReached(ValueError):
    """The minority class already reaches the requested ratio."""


class TooFewRows(ValueError):
    """The minority class has fewer rows than the method needs."""


def plan_counts(n_pos: int, n_neg: int, ratio: float) -> tuple[int, int]:
    """(minority target, rows to add) for ratio = n_minority_after / n_majority."""
    n_min, n_maj = min(n_pos, n_neg), max(n_pos, n_neg)
    target = int(ratio * n_maj)
    if target < n_min:
        raise RatioReached(f"ratio {ratio} asks for {target} minority rows, {n_min} exist")
    return target, target - n_min


def _class_counts(df: DataFrame, y_col: str) -> tuple[int, int]:
    row = df.agg(F.sum(F.col(y_col).cast("long")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    pos = int(row["p"] or 0)
    return pos, int(row["n"]) - pos


def _seed_key(df: DataFrame, col: str) -> Column:
    """An integer to seed from: the id itself, or 60 bits of a string id's md5 (portable)."""
    if isinstance(df.schema[col].dataType, T.StringType):
        return F.conv(F.substring(F.md5(F.col(col)), 1, 15), 16, 10).cast("bigint")
    return F.col(col)


def _copies_per_row(mino: DataFrame, n_add: int, n_min: int, id_col: str, seed: int) -> DataFrame:
    """Each minority row gets floor(n_add / n_min) copies; the remainder goes to
    the rows first in a seeded hash order (exact total, distributed ranking)."""
    base, extra = divmod(n_add, n_min)
    ranked = with_row_index(mino.withColumn("_h", seeded_int(_seed_key(mino, id_col), seed=seed)), ["_h", id_col], "_rk")
    return ranked.withColumn("_copies", F.lit(base) + (F.col("_rk") < extra).cast("int")).drop("_h", "_rk")


#: Draws that one generated row stands for before it is exploded.
DRAW_CHUNK = 1 << 16


def drawn_counts(plan: DataFrame, keys: list[str]) -> DataFrame:
    """Draws with replacement: ``keys, rank, copies`` for every rank drawn at least once.

    ``plan`` has ``keys`` and ``n_add`` (draws), ``n_min`` (ranks 0 .. n_min - 1), ``seed``.
    Draw i takes the rank of a seeded hash of i, so the draws of a plan row are exactly
    ``n_add`` and are made and counted wherever the generated rows lie; nothing is ranked or
    collected.  The hash has 62 bits, so the ranks are uniform up to 2^-30."""
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_add - 1) div {DRAW_CHUNK}"))).alias("_chunk")
    rows = plan.filter("n_add > 0").select(*keys, "n_add", "n_min", "seed", chunk)
    last = F.least(F.col("n_add"), (F.col("_chunk") + 1) * DRAW_CHUNK) - 1
    rows = rows.select(*keys, "n_min", "seed", F.explode(F.sequence(F.col("_chunk") * DRAW_CHUNK, last)).alias("_i"))
    high, low = (seeded_int(F.col("seed"), F.col("_i"), seed=k) for k in (1, 2))
    rank = (high * MODULUS + low) % F.col("n_min")
    return rows.select(*keys, rank.alias("rank")).groupBy(*keys, "rank").agg(F.count(F.lit(1)).alias("copies"))


def drawn_rank_sql(i: str, n_min: str, seed: str) -> str:
    """The rank of draw ``i`` as SQL text."""
    return f"(({seeded_int_sql([seed, i], 1)} * {MODULUS} + {seeded_int_sql([seed, i], 2)}) % {n_min})"


def oversample_random(df: DataFrame, y_col: str, ratio: float, id_col: str = "id", seed: int = 42,
                      on_reached: str = "raise") -> DataFrame:
    """Random oversampling of the minority class (y = 1 or y = 0, whichever
    is rarer) to n_min_after = floor(ratio * n_majority), by draws with replacement
    from its rows in id order.

    Output: all original rows (copy = 0) plus copies (copy = 1, 2, ...).  A class
    without any row can't be copied: ``TooFewRows``, or unsampled with ``skip``."""
    pos, neg = _class_counts(df, y_col)
    try:
        if min(pos, neg) == 0:
            raise TooFewRows("the minority class has no row to copy")
        _, n_add = plan_counts(pos, neg, ratio)
    except (RatioReached, TooFewRows):
        if on_reached == "skip":
            return df.withColumn("copy", F.lit(0))
        raise
    minority = 1 if pos <= neg else 0
    out = df.withColumn("copy", F.lit(0))
    if n_add == 0:
        return out
    plan = df.sparkSession.range(1).select(F.lit(n_add).cast("long").alias("n_add"), F.lit(min(pos, neg)).cast("long").alias("n_min"),
                                           F.lit(seed).cast("long").alias("seed"))
    ranked = with_row_index(df.filter(F.col(y_col) == minority), [id_col], "_rk")
    c = ranked.join(drawn_counts(plan, []).select(F.col("rank").alias("_rk"), "copies"), "_rk")
    copies = c.select(*df.columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.unionByName(copies)


def smote(df: DataFrame, y_col: str, vec_col: str, ratio: float, id_col: str = "id", seed: int = 42, k: int = 5,
          on_reached: str = "raise", block_rows: int = 4096) -> DataFrame:
    """SMOTE.  Synthetic minority rows x + u * (nn - x) where nn is one of
    the k nearest minority neighbours of x (exact kNN inside the minority
    class only) and u in [0, 1); both drawn from seeded hashes.

    Output: originals (synthetic = false) plus synthetic rows that keep the
    source id in ``source_id`` and the neighbour used in ``neighbor_id``.  With
    k minority rows or fewer there are no k neighbours: ``TooFewRows``, or
    unsampled with ``skip``."""
    pos, neg = _class_counts(df, y_col)
    base = (df.withColumn("synthetic", F.lit(False)).withColumn("source_id", F.col(id_col)).withColumn("copy", F.lit(0))
            .withColumn("neighbor_id", F.lit(None).cast(df.schema[id_col].dataType)))
    try:
        _, n_add = plan_counts(pos, neg, ratio)
        if n_add and min(pos, neg) <= k:
            raise TooFewRows(f"{min(pos, neg)} minority rows have no {k} neighbours each")
    except (RatioReached, TooFewRows):
        if on_reached == "skip":
            return base
        raise
    minority = 1 if pos <= neg else 0
    n_min = min(pos, neg)
    if n_add == 0:
        return base
    mino = df.filter(F.col(y_col) == minority)
    # the neighbours' vectors travel with the join (a neighbour of many rows is
    # never a join key); each minority row gathers its k of them in rank order
    nbrs = knn_join(mino, mino.withColumn("_n", F.col(vec_col)), k, id_col, vec_col, exclude_self=True,
                    block_rows=block_rows, carry=["_n"])
    near = nbrs.groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("r"), "nid", "_n"))),
                    lambda s: F.struct(s["nid"].alias("nid"), s["_n"].alias("_n"))).alias("_nn"))
    # copies are exploded last, so a row that must be copied many times never meets a shuffle
    c = _copies_per_row(mino, n_add, n_min, id_col, seed).filter(F.col("_copies") > 0)
    rows = c.withColumn("qid", F.col(id_col)).join(near, "qid")
    others = [c_ for c_ in df.columns if c_ not in (id_col, vec_col, y_col)]
    draws = rows.select("qid", vec_col, "_nn", *others,
                        F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy"))
    pick = (F.pmod(seeded_int(_seed_key(draws, "qid"), F.col("copy"), seed=seed), F.lit(k)) + 1).cast("int")
    u = seeded_unit(_seed_key(draws, "qid"), F.col("copy"), F.lit(7), seed=seed)
    chosen = F.element_at("_nn", pick)
    new = F.zip_with(vec_col, chosen["_n"], lambda a, b: (a + u * (b - a)).cast("float"))
    syn = draws.select(
        F.lit(None).cast(df.schema[id_col].dataType).alias(id_col), F.lit(minority).cast(df.schema[y_col].dataType)
        .alias(y_col), new.cast(T.ArrayType(df.schema[vec_col].dataType.elementType)).alias(vec_col), *others,
        F.lit(True).alias("synthetic"), F.col("qid").alias("source_id"), "copy",
        chosen["nid"].alias("neighbor_id"))
    return base.unionByName(syn.select(*base.columns))


def sampler_table(spark, entries: list[tuple[str, str | None, float | None]]) -> DataFrame:
    """(label, method, ratio) table; a label listed twice is rejected."""
    seen: set[str] = set()
    for lab, method, _ in entries:
        if lab in seen:
            raise ValueError(f"label {lab!r} listed twice in the sampler table")
        if method not in (None, "random", "smote"):
            raise ValueError(f"unknown method {method!r}")
        seen.add(lab)
    return spark.createDataFrame(entries, "label string, method string, ratio double")
