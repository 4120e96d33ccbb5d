"""Mixing sources to target weights, with DataFrame functions only.

Sizes are counted once.  Targets share the total by weight, capped at
``max_epochs`` times a source's size; what a cap cuts off is shared again among
the others until none is above.  Within a source, documents stand in the order
of a hash-random key: the rows are range-sorted by (source, key), sums per
(partition, source) give each partition its offset, and a running sum within
the partition gives each document the words before it.  A source takes whole
epochs while its budget lasts and cuts the last one exactly.

No source is gathered in one task: range sorting splits a large source over as
many tasks as its rows need, and the running sums are per (partition, source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.common import materialize, narrow, shuffle_tasks, small_enough, stable_rank

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_table(sized: DataFrame, weights=WEIGHTS) -> DataFrame:
    """One row per source: ``source, source_size, weight``.  Weights repeat over
    the sources in code-point order, null last."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # position in the order: range-sorted partitions, counted, then numbered inside
    n = shuffle_tasks(sized.sparkSession)
    ranged = materialize(totals.withColumn("last", F.col("source").isNull())
                         .repartitionByRange(n, "last", "source").withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("last", "source"))
    position = F.col("before") + inside - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (position % len(weights) + 1).cast("int"))
    return ranged.join(before, "part").select("source", "source_size", weight.cast("long").alias("weight"))


def targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target``: a weight's share of all sizes, at most ``max_epochs`` times
    the source's size, the excess shared again by weight until none is above.

    Exact in integers: a round keeps the words left and the weights left, and a
    source is above its cap when weight * words > cap * weights.
    """
    spark = sources.sparkSession
    table = materialize(sources.withColumn("cap", F.col("source_size") * max_epochs), "mix-weights")
    words = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    total = words
    big = "decimal(38,0)"
    table = table.withColumn("capped", F.lit(False))
    while True:
        capped, weights = table.agg(F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0)),
                                    F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))), F.lit(0))).first()
        words = total - capped
        above = ~F.col("capped") & (F.col("weight").cast(big) * F.lit(words).cast(big)
                                    > F.col("cap").cast(big) * F.lit(weights).cast(big))
        table = materialize(table.withColumn("above", above).withColumn("capped", F.col("capped") | F.col("above")), "mix-round")
        if table.filter("above").isEmpty():
            break
        table = table.drop("above")
    share = F.col("weight") * F.lit(words).cast("long") / F.lit(max(1, weights)).cast("double")
    return table.select("source", "source_size",
                        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def placed_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights=WEIGHTS,
                     max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``mix`` with the rows' ``source`` and ``text_hash``."""
    spark = docs.sparkSession
    sized = narrow(docs, doc_id=id_col, text=text_col, source=source_col).select(
        F.col("doc_id").cast("long"), word_count(F.col("text").cast("string")).alias("size"),
        F.col("source").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    sized = materialize(sized.withColumn("key", stable_rank(seed, F.col("doc_id"))), "mix-sizes")
    budget = targets(source_table(sized, weights), max_epochs)

    order = ["key", "doc_id", "size", "text_hash"]
    ranged = materialize(sized.repartitionByRange(shuffle_tasks(spark), "source", *order)
                         .withColumn("part", F.spark_partition_id()), "mix-ranged")
    # words of the source in earlier partitions; one row per partition and source
    sums = ranged.groupBy("part", "source").agg(F.sum("size").alias("n"))
    sums = sums.select("part", "source", (F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n"))
                       .alias("offset"))
    s, b = sums.alias("s"), budget.alias("b")
    sums = s.join(b, F.col("s.source").eqNullSafe(F.col("b.source"))).select("s.*", "source_size", "target")

    inside = F.sum("size").over(Window.partitionBy("part", "source").orderBy(*order)
                                .rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn("inside", F.coalesce(inside, F.lit(0))).alias("r")
    s = sums.alias("s")
    out = placed.join(s, (F.col("r.part") == F.col("s.part")) & F.col("r.source").eqNullSafe(F.col("s.source")))
    budget_words = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(F.lit(0))
    left = budget_words - whole * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("offset") - F.col("inside")))
    return out.select("r.doc_id", "r.source", "text_hash", "size", "source_size", "target",
                      (F.col("size") * whole + cut).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``.

    ``size`` is the text's number of words (0 for null or empty text), ``target``
    its source's budget and ``taken`` the words that the mix takes of it: its size
    times the whole epochs, plus what the last, cut epoch takes.  Taken words of a
    source add up to its target rounded to a whole word.  The order is a hash of
    the id, ties (repeated ids) by size and a hash of the text, so reruns agree; rows that repeat in every column
    are taken separately.  A null source is a source of its own; a null id has a
    place of its own.  Sources without any word have target 0.  An empty table
    gives an empty result.  Further columns are ignored.
    """
    return placed_documents(docs, id_col, text_col, source_col, weights, max_epochs, seed).select(
        "doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    **settings) -> DataFrame:
    """The mix itself: the documents with all their columns, each as often as the mix
    takes it.  A document is never cut: the one at a budget's end is taken once
    more if the mix takes half of it or more.  Documents without words have no share.

    Rows that agree in id, source and text share what the mix takes of them as evenly as
    whole rows allow, the rest going to those with the least hash of all columns.  Null ids and
    sources are as in ``mix``; an empty table gives an empty result.
    """
    plan = placed_documents(docs, id_col, text_col, source_col, **settings).filter("size > 0")
    times = plan.groupBy("doc_id", "source", "text_hash").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("taken") / F.col("size") + 0.5).cast("long")).alias("times"))
    times = materialize(times.filter("times > 0"), "mix-times")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # no name can clash

    def taken(times: DataFrame) -> DataFrame:
        t = (F.broadcast(times) if small_enough(times) else times).alias("t")
        same = (F.col(f"row.`{id_col}`").cast("long").eqNullSafe(F.col("t.doc_id"))
                & F.col(f"row.`{source_col}`").cast("string").eqNullSafe(F.col("t.source"))
                & (F.xxhash64(F.col(f"row.`{text_col}`").cast("string")) == F.col("t.text_hash")))
        return row.join(t, same)

    out = taken(times.filter("n = 1")).select("row", F.col("t.times").alias("times"))
    repeats = materialize(times.filter("n > 1"), "mix-repeats")
    if not repeats.isEmpty():
        rank = F.row_number().over(Window.partitionBy("t.doc_id", "t.source", "t.text_hash").orderBy(F.xxhash64("row")))
        share = F.expr("t.times div t.n") + (F.col("rank") <= F.expr("t.times % t.n")).cast("long")
        out = out.unionByName(taken(repeats).withColumn("rank", rank).select("row", share.alias("times")).filter("times > 0"))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
