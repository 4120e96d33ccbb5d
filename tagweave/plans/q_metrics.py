"""Evaluation queries (G1-G21) over the derived gold / prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.functions.text import token_count
from tagweave.operators import metrics as m
from tagweave.plans import fixtures as fx
from tagweave.plans.registry import register
from tagweave.plans.sqlbase import sql
from tagweave.session import read_table, scratch_path

PRF_SQL = """
SELECT tp, n_pred, n_gold, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1
FROM (SELECT tp, n_pred, n_gold,
        CASE WHEN n_pred = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / n_pred END AS precision,
        CASE WHEN n_gold = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / n_gold END AS recall FROM hc)"""


@register("hier_scores", sql("""
hc AS (SELECT CAST(count(*) FILTER (WHERE p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS BIGINT) AS tp,
              CAST(count(p.doc_id) AS BIGINT) AS n_pred, CAST(count(g.doc_id) AS BIGINT) AS n_gold
       FROM goldc g FULL OUTER JOIN predc p ON g.doc_id = p.doc_id AND g.label = p.label)""", PRF_SQL))
def hier_scores(spark, sf_dir):
    """G1-G4 flagship: hierarchical P / R / F1 of predictions against gold."""
    clo = fx.taxonomy(spark)["closure"]
    return m.hier_scores(fx.gold_long(spark, sf_dir), fx.pred_long(spark, sf_dir), clo, "doc_id")


@register("stream_hier_scores", sql("""
hc AS (SELECT CAST(count(*) FILTER (WHERE p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS BIGINT) AS tp,
              CAST(count(p.doc_id) AS BIGINT) AS n_pred, CAST(count(g.doc_id) AS BIGINT) AS n_gold
       FROM goldc g FULL OUTER JOIN predc p ON g.doc_id = p.doc_id AND g.label = p.label)""", PRF_SQL))
def stream_hier_scores(spark, sf_dir):
    """G4 on a stream: the prediction submission (one record per document,
    empty lists included) arrives as JSON files; Structured Streaming scores
    it micro-batch by micro-batch (``foreachBatch``, a quarter of the files
    per trigger) and the cumulative scores equal the batch flagship."""
    from tagweave.streaming.scoring import cumulative_scores, start_scoring

    base = scratch_path(spark, "stream-scores")
    sets = fx.doc_label_sets(spark, sf_dir)
    preds = sets.select(F.col("doc_id").cast("string").alias("id"), F.col("pred").alias("labels"))
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    preds.repartition(files, "id").write.json(f"{base}/in")
    gold = fx.gold_long(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "label")
    q = start_scoring(spark, f"{base}/in", gold, fx.taxonomy(spark)["closure"], f"{base}/out", f"{base}/ckpt",
                      trigger_once=True, max_files_per_trigger=max(1, files // 4))
    q.awaitTermination()  # to the end, however long; a failed query raises here
    return cumulative_scores(spark, f"{base}/out")


@register("hier_scores_empty", sql("""
pe AS (SELECT p.doc_id, p.label FROM pred p JOIN documents d ON d.doc_id = p.doc_id WHERE d.lang = 'en'),
pec AS (SELECT DISTINCT p.doc_id, c.ancestor AS label FROM pe p JOIN clo c ON c.node = p.label),
gl AS (SELECT d.lang, g.doc_id, g.label FROM goldc g JOIN documents d ON d.doc_id = g.doc_id),
pl AS (SELECT d.lang, p.doc_id, p.label FROM pec p JOIN documents d ON d.doc_id = p.doc_id),
hcl AS (SELECT coalesce(g.lang, p.lang) AS lang,
              CAST(count(*) FILTER (WHERE p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS BIGINT) AS tp,
              CAST(count(p.doc_id) AS BIGINT) AS n_pred, CAST(count(g.doc_id) AS BIGINT) AS n_gold
       FROM gl g FULL OUTER JOIN pl p ON g.doc_id = p.doc_id AND g.label = p.label GROUP BY 1),
hc AS (SELECT * FROM hcl)""", PRF_SQL.replace("SELECT tp,", "SELECT lang, tp,", 1).replace(
    "FROM (SELECT tp,", "FROM (SELECT lang, tp,")))
def hier_scores_empty(spark, sf_dir):
    """Per-language hierarchical scores where only English rows carry
    predictions; every other language exercises the zero-prediction guard."""
    clo = fx.taxonomy(spark)["closure"]
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    g = fx.gold_long(spark, sf_dir).join(docs, "doc_id")
    p = fx.pred_long(spark, sf_dir).join(docs.filter(F.col("lang") == "en"), "doc_id")
    return m.hier_scores(g, p, clo, "doc_id", by=["lang"])


def _flat(spark, sf_dir):
    return fx.gold_long(spark, sf_dir), fx.pred_long(spark, sf_dir)


def _conf(spark, sf_dir):
    g, p = _flat(spark, sf_dir)
    # row count as a scalar subquery inside the plan (no eager driver job)
    n = read_table(spark, sf_dir, "documents").agg(F.count(F.lit(1))).scalar()
    vocab = spark.createDataFrame([(x,) for x in fx.LEAVES], "label string")
    return m.label_confusion(g, p, n, vocab, "doc_id")


@register("label_confusion", sql(None, "SELECT label, tn, fp, fn, tp FROM conf"))
def label_confusion(spark, sf_dir):
    """Per-label 2x2 counts without materialising rows x labels."""
    return _conf(spark, sf_dir)


@register("micro_scores", sql(None, """
SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1
FROM (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
        CASE WHEN sum(tp) + sum(fp) = 0 THEN 0.0 ELSE sum(tp) / CAST(sum(tp) + sum(fp) AS DOUBLE) END AS p,
        CASE WHEN sum(tp) + sum(fn) = 0 THEN 0.0 ELSE sum(tp) / CAST(sum(tp) + sum(fn) AS DOUBLE) END AS r FROM conf)"""))
def micro_scores(spark, sf_dir):
    """G5."""
    return m.micro_scores(_conf(spark, sf_dir))


PER_LABEL_SQL = """
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1
FROM (SELECT label, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS p,
             CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS r FROM conf)"""


@register("per_label_scores", sql(None, PER_LABEL_SQL))
def per_label_scores(spark, sf_dir):
    """G8."""
    return m.per_label_scores(_conf(spark, sf_dir))


@register("subset_accuracy", sql(None, """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE b.doc_id IS NULL) AS BIGINT) AS n_exact,
       round(count(*) FILTER (WHERE b.doc_id IS NULL) / CAST(count(*) AS DOUBLE), 6) AS accuracy
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM pairs WHERE g <> p) b ON b.doc_id = d.doc_id"""))
def subset_accuracy(spark, sf_dir):
    """G6."""
    g, p = _flat(spark, sf_dir)
    return m.subset_accuracy(read_table(spark, sf_dir, "documents"), g, p, "doc_id")


@register("confusion_to_text", sql(None, """
SELECT string_agg(label || chr(9) || tn || chr(9) || fp || chr(9) || fn || chr(9) || tp || chr(9), ''
                  ORDER BY label) AS confusion FROM conf"""))
def confusion_to_text(spark, sf_dir):
    """G9."""
    return m.confusion_to_text(_conf(spark, sf_dir))


@register("confusion_from_text", sql(None, "SELECT label, tn, fp, fn, tp FROM conf"))
def confusion_from_text(spark, sf_dir):
    """Write the matrices as the tab string, parse them back."""
    return m.confusion_from_text(m.confusion_to_text(_conf(spark, sf_dir)))


@register("classification_report", sql("""
pl AS (SELECT label, tp, fp, fn, tp + fn AS support,
              CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS p,
              CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS r FROM conf),
pl2 AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f FROM pl),
tot AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(support) AS support, avg(p) AS mp, avg(r) AS mr,
               avg(f) AS mf, sum(p * support) AS wp, sum(r * support) AS wr, sum(f * support) AS wf FROM pl2),
mic AS (SELECT CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS p,
               CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS r, support FROM tot),
rowc AS (SELECT d.doc_id, coalesce(sum(g * p), 0) AS i, coalesce(sum(g), 0) AS ng, coalesce(sum(p), 0) AS np
         FROM documents d LEFT JOIN pairs x ON x.doc_id = d.doc_id GROUP BY d.doc_id),
samp AS (SELECT avg(CASE WHEN np = 0 THEN 0.0 ELSE i / CAST(np AS DOUBLE) END) AS sp,
                avg(CASE WHEN ng = 0 THEN 0.0 ELSE i / CAST(ng AS DOUBLE) END) AS sr,
                avg(CASE WHEN ng + np = 0 THEN 0.0 ELSE 2 * i / CAST(ng + np AS DOUBLE) END) AS sf FROM rowc)""", """
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(support AS BIGINT) AS support
FROM pl2
UNION ALL SELECT 'micro avg', round(p, 6), round(r, 6),
  round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6), CAST(support AS BIGINT) FROM mic
UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), CAST(support AS BIGINT) FROM tot
UNION ALL SELECT 'weighted avg', round(wp / support, 6), round(wr / support, 6), round(wf / support, 6),
  CAST(support AS BIGINT) FROM tot
UNION ALL SELECT 'samples avg', round(sp, 6), round(sr, 6), round(sf, 6), CAST(support AS BIGINT) FROM samp, tot"""))
def classification_report(spark, sf_dir):
    """G11."""
    g, p = _flat(spark, sf_dir)
    return m.classification_report(_conf(spark, sf_dir), read_table(spark, sf_dir, "documents"), g, p, "doc_id")


@register("mlcm", sql("""
sets AS (SELECT d.doc_id,
           coalesce((SELECT list(label) FROM gold g WHERE g.doc_id = d.doc_id), []) AS t,
           coalesce((SELECT list(label) FROM pred p WHERE p.doc_id = d.doc_id), []) AS pr FROM documents d),
sx AS (SELECT doc_id, t, pr, list_transform(list_intersect(t, pr), lambda x: {'t': x, 'p': x}) AS diag,
         list_filter(t, lambda x: NOT list_contains(pr, x)) AS miss,
         list_filter(pr, lambda x: NOT list_contains(t, x)) AS extra FROM sets),
cells AS (SELECT unnest(CASE
   WHEN len(t) = 0 AND len(pr) = 0 THEN [{'t': '<no true label>', 'p': '<no predicted label>'}]
   WHEN len(t) = 0 THEN list_transform(pr, lambda y: {'t': '<no true label>', 'p': y})
   WHEN len(miss) > 0 AND len(extra) > 0 THEN list_concat(diag,
        flatten(list_transform(miss, lambda x: list_transform(extra, lambda y: {'t': x, 'p': y}))))
   WHEN len(miss) > 0 THEN list_concat(diag, list_transform(miss, lambda x: {'t': x, 'p': '<no predicted label>'}))
   WHEN len(extra) > 0 THEN list_concat(diag,
        flatten(list_transform(t, lambda x: list_transform(extra, lambda y: {'t': x, 'p': y}))))
   ELSE diag END) AS c FROM sx),
cnt AS (SELECT c.t AS true_label, c.p AS pred_label, count(*) AS n FROM cells GROUP BY 1, 2)""", """
SELECT true_label, pred_label, CAST(n AS BIGINT) AS n,
       round(n * 100.0 / sum(n) OVER (PARTITION BY true_label), 6) AS row_pct FROM cnt"""))
def mlcm(spark, sf_dir):
    """Multi-label confusion matrix, raw and row-normalised."""
    return m.mlcm(fx.doc_label_sets(spark, sf_dir))


@register("label_counts", sql(None, """
SELECT label, count(*) AS n FROM corpus WHERE label IS NOT NULL GROUP BY label"""))
def label_counts(spark, sf_dir):
    """Value counts of the flat label column (nulls excluded), most frequent first."""
    c = fx.corpus(spark, sf_dir).filter(F.col("label").isNotNull())
    return c.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


@register("describe_cat", sql(None, """
SELECT (SELECT count(label) FROM corpus) AS count, (SELECT count(DISTINCT label) FROM corpus) AS "unique",
       label AS top, n AS freq
FROM (SELECT label, count(*) AS n FROM corpus WHERE label IS NOT NULL GROUP BY label ORDER BY n DESC, label LIMIT 1)"""))
def describe_cat(spark, sf_dir):
    """Count, unique, top, freq of a categorical column; ties on top -> smallest value."""
    c = fx.corpus(spark, sf_dir).filter(F.col("label").isNotNull())
    vc = c.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return vc.agg(
        F.sum("n").cast("bigint").alias("count"),
        F.count(F.lit(1)).cast("bigint").alias("unique"),
        F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("top"),
        F.max("n").cast("bigint").alias("freq"),
    )


@register("describe_num", sql("""
lens AS (SELECT length(text) AS n_chars,
   len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS n_tokens
   FROM corpus WHERE text IS NOT NULL),
lv AS (SELECT 'n_chars' AS metric, CAST(n_chars AS DOUBLE) AS v FROM lens
       UNION ALL SELECT 'n_tokens', CAST(n_tokens AS DOUBLE) FROM lens)""", """
SELECT metric, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min,
  round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50,
  round(quantile_cont(v, 0.75), 6) AS q75, max(v) AS max FROM lv GROUP BY metric"""))
def describe_num(spark, sf_dir):
    """Numeric describe of text lengths and whitespace token counts (exact quartiles)."""
    c = fx.corpus(spark, sf_dir).filter(F.col("text").isNotNull())
    lv = c.select(F.length("text").cast("double").alias("n_chars"), token_count(F.col("text")).cast("double").alias("n_tokens"))
    lv = lv.select(F.explode(F.array(
        F.struct(F.lit("n_chars").alias("metric"), F.col("n_chars").alias("v")),
        F.struct(F.lit("n_tokens").alias("metric"), F.col("n_tokens").alias("v")))).alias("x")).select("x.*")
    return m.describe_numeric(lv, "metric", "v")


@register("quantile_sketch")
def quantile_sketch(spark, sf_dir):
    """G16 at scale: quantiles of text lengths and token counts from a mergeable sketch, beside the
    exact ones and the share of rows by which a sketched value misses its rank."""
    c = fx.corpus(spark, sf_dir).filter(F.col("text").isNotNull())
    lv = c.select(F.explode(F.array(
        F.struct(F.lit("n_chars").alias("metric"), F.length("text").cast("double").alias("v")),
        F.struct(F.lit("n_tokens").alias("metric"), token_count(F.col("text")).cast("double").alias("v")))).alias("x")).select("x.*")
    probs = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
    sketched = m.sketch_quantiles(lv, "v", probs, ["metric"])
    ranks = m.rank_errors(lv, sketched, "v", ["metric"])
    return ranks.join(m.exact_quantiles(lv, "v", probs, ["metric"]).withColumnRenamed("q", "exact"), ["metric", "p"]).select(
        "metric", "p", "q", m.r6(F.col("exact")).alias("exact"), m.r6(F.col("rank_error")).alias("rank_error"))


@register("bce_loss", sql("""
el AS (SELECT f.vec_id, f.split, i,
         least(greatest(1.0 / (1.0 + exp(-10.0 * CAST(f.embedding[i + 1] AS DOUBLE))), 1e-7), 1 - 1e-7) AS prob,
         CASE WHEN EXISTS (SELECT 1 FROM featlab l WHERE l.vec_id = f.vec_id AND l.lab = CAST(i AS VARCHAR))
              THEN 1.0 ELSE 0.0 END AS y
       FROM (SELECT *, unnest(range(0, 64)) AS i FROM feat) f)""", """
SELECT split, round(avg(-(y * ln(prob) + (1 - y) * ln(1 - prob))), 6) AS loss, count(*) AS n_elements
FROM el GROUP BY split"""))
def bce_loss(spark, sf_dir):
    """Mean BCE per split of sigmoid(logits) against multi-hot targets (64 classes, ten of which occur)."""
    f = fx.features(spark, sf_dir)
    lg = F.transform("embedding", lambda x: x.cast("double") * 10)
    long = f.select("vec_id", "split", "labels", F.posexplode(lg).alias("i", "logit"))
    long = long.select("split", (1 / (1 + F.exp(-F.col("logit")))).alias("prob"),
                       F.array_contains("labels", F.col("i").cast("string")).cast("int").alias("y"))
    return m.bce_loss(long, by=["split"])


@register("next_experiment", sql(None, "SELECT CAST(coalesce(max(experiment), 0) + 1 AS BIGINT) AS next_experiment FROM runs"))
def next_experiment(spark, sf_dir):
    """G18."""
    return m.next_experiment(fx.runs(spark, sf_dir))


@register("best_per_label", sql(None, """
SELECT label, experiment, f1 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, experiment) AS rn
FROM runs) WHERE rn = 1"""))
def best_per_label(spark, sf_dir):
    """Ties go to the lowest experiment id."""
    return m.best_per_label(fx.runs(spark, sf_dir))


@register("leaderboard", sql(None, """
SELECT experiment, mean_f1, n_labels, CAST(rank() OVER (ORDER BY mean_f1 DESC) AS BIGINT) AS rank
FROM (SELECT experiment, round(avg(f1), 6) AS mean_f1, count(*) AS n_labels FROM runs GROUP BY experiment)"""))
def leaderboard(spark, sf_dir):
    """G21."""
    return m.leaderboard(fx.runs(spark, sf_dir))


@register("perplexity", sql(None, "SELECT round(avg(loss), 6) AS mean_loss, round(exp(avg(loss)), 6) AS perplexity FROM losses"))
def perplexity(spark, sf_dir):
    """G20."""
    return m.perplexity(fx.losses(spark, sf_dir))
