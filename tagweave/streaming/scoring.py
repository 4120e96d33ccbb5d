"""Hierarchical scoring (G4) of prediction files as they arrive.

The reference scores finished prediction files; this is the same operator fed
by Structured Streaming's file source: each micro-batch of ``{id, labels}``
records is expanded over the taxonomy closure, matched against the static gold
closure of the same ids, and its counts (tp, n_pred, n_gold) are appended to a
results table through ``foreachBatch`` (idempotent per batch id).  Cumulative
precision / recall / F1 are a plain aggregate over that table.

Contract: an id is scored in the batch where it first arrives; files are
never rewritten (the file source's exactly-once bookkeeping lives in the
checkpoint folder, which must be on shared storage)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagweave.operators import metrics as m
from tagweave.operators.taxonomy import expand_long
from tagweave.session import cut_lineage, sized_broadcast
from tagweave.sources import io


def start_scoring(spark: SparkSession, pred_dir: str, gold_long: DataFrame, closure: DataFrame, out_path: str,
                  checkpoint: str, id_col: str = "id", label_col: str = "label",
                  trigger_once: bool = False, max_files_per_trigger: int = 16) -> StreamingQuery:
    """Start the streaming scorer; returns the running query.  Every id must
    arrive with a record (an empty label list included): gold is counted
    for the ids of each batch."""
    stream = (spark.readStream.schema(io.PREDICTION_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
              .json(pred_dir))
    # the static side is expanded once and written to the checkpoint folder;
    # each batch then only scans it and filters it map-side by the batch's ids
    gold_c = cut_lineage(expand_long(
        gold_long.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).alias("label")),
        closure, "id", "label"))

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        pred = batch.select("id", F.explode("labels").alias("label"))
        ids = batch.select("id").distinct()  # bounded by the batch size (maxFilesPerTrigger)
        g = gold_c.join(sized_broadcast(ids), "id", "left_semi")
        counts = m.hier_counts(g, pred, closure, "id", "label")
        out = counts.select(F.lit(batch_id).cast("long").alias("batch_id"), "tp", "n_pred", "n_gold")
        # idempotent replays: a batch id already written is skipped
        done = io.read_table_or_empty(spark, out_path, out.schema)
        if done.filter(F.col("batch_id") == batch_id).isEmpty():
            io.append_table(out, out_path)

    w = stream.writeStream.foreachBatch(score_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()


def cumulative_scores(spark: SparkSession, out_path: str) -> DataFrame:
    """Precision / recall / F1 over every batch scored so far."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("tp", T.LongType()),
                           T.StructField("n_pred", T.LongType()), T.StructField("n_gold", T.LongType())])
    t = io.read_table_or_empty(spark, out_path, schema)
    tot = t.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("tp", "n_pred", "n_gold")])
    return m.with_prf(tot)
