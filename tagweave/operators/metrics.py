"""Evaluation operators: hierarchical, micro, per-label, sample-based scores,
confusion tables and experiment-table queries.

Design rules for scale:
* label sets are long tables ``(id, label)``; rows x labels is never built –
  true negatives are derived as ``n - tp - fp - fn``;
* gold and predicted closures are combined with ONE shuffle: a flagged union
  grouped by ``(id, label)`` (map-side partial aggregation removes duplicates
  before the exchange), then a global aggregate of three sums;
* every 0/0 is 0.0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.operators.clean import with_running_total
from tagweave.operators.taxonomy import expand_long
from tagweave.session import cut_lineage, sized_broadcast


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def fbeta(p: Column, r: Column, beta: float = 1.0) -> Column:
    b2 = beta * beta
    return safe_div((1 + b2) * p * r, b2 * p + r)


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def flagged_pairs(gold: DataFrame, pred: DataFrame, id_col: str = "id", label_col: str = "label",
                  by: list[str] | None = None) -> DataFrame:
    """Distinct (id, label) pairs of gold ∪ pred with 0/1 flags g and p (one shuffle)."""
    by = by or []
    keys = by + [id_col, label_col]
    g = gold.select(*keys, F.lit(1).alias("g"), F.lit(0).alias("p"))
    p = pred.select(*keys, F.lit(0).alias("g"), F.lit(1).alias("p"))
    return g.unionByName(p).groupBy(*keys).agg(F.max("g").alias("g"), F.max("p").alias("p"))


def hier_counts(gold: DataFrame, pred: DataFrame, clo: DataFrame, id_col: str = "id", label_col: str = "label",
                by: list[str] | None = None) -> DataFrame:
    """tp, n_pred, n_gold over ancestor-or-self closures (G1/G2 counts)."""
    by = by or []
    gc = expand_long(gold.select(*by, id_col, label_col), clo, id_col, label_col) if not by else \
        _expand_by(gold, clo, id_col, label_col, by)
    pc = expand_long(pred.select(*by, id_col, label_col), clo, id_col, label_col) if not by else \
        _expand_by(pred, clo, id_col, label_col, by)
    pairs = flagged_pairs(gc, pc, id_col, label_col, by)
    aggs = [
        F.coalesce(F.sum(F.col("g") * F.col("p")), F.lit(0)).cast("bigint").alias("tp"),
        F.coalesce(F.sum("p"), F.lit(0)).cast("bigint").alias("n_pred"),
        F.coalesce(F.sum("g"), F.lit(0)).cast("bigint").alias("n_gold"),
    ]
    return pairs.groupBy(*by).agg(*aggs)


def _expand_by(labels: DataFrame, clo: DataFrame, id_col: str, label_col: str, by: list[str]) -> DataFrame:
    tmp = labels.select(F.struct(*by, id_col).alias("_k"), label_col)
    out = expand_long(tmp, clo, "_k", label_col)
    return out.select(*[F.col(f"_k.{c}").alias(c) for c in by], F.col(f"_k.{id_col}").alias(id_col), label_col)


def with_prf(counts: DataFrame, beta: float = 1.0) -> DataFrame:
    """Add precision, recall, f-beta (rounded to 6 digits) to tp / n_pred / n_gold counts."""
    p = safe_div(F.col("tp"), F.col("n_pred"))
    r = safe_div(F.col("tp"), F.col("n_gold"))
    return counts.select("*", r6(p).alias("precision"), r6(r).alias("recall"), r6(fbeta(p, r, beta)).alias("f1"))


def hier_scores(gold: DataFrame, pred: DataFrame, clo: DataFrame, id_col: str = "id", label_col: str = "label",
                by: list[str] | None = None, beta: float = 1.0) -> DataFrame:
    """Hierarchical precision / recall / F-beta (G4), optionally per group."""
    return with_prf(hier_counts(gold, pred, clo, id_col, label_col, by), beta)


def label_counts(gold: DataFrame, pred: DataFrame, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """Per-label tp, fp, fn from long gold / pred tables (shared core of G5-G11)."""
    pairs = flagged_pairs(gold, pred, id_col, label_col)
    return pairs.groupBy(label_col).agg(
        F.sum(F.col("g") * F.col("p")).cast("bigint").alias("tp"),
        F.sum((1 - F.col("g")) * F.col("p")).cast("bigint").alias("fp"),
        F.sum(F.col("g") * (1 - F.col("p"))).cast("bigint").alias("fn"),
    )


def label_confusion(gold: DataFrame, pred: DataFrame, n_rows: Column | int, vocab: DataFrame,
                    id_col: str = "id", label_col: str = "label") -> DataFrame:
    """Per-label 2x2 counts (label, tn, fp, fn, tp) for every vocabulary label.

    ``vocab`` is a one-column (label) table; ``n_rows`` the number of rows
    (a literal or a scalar-subquery column)."""
    c = label_counts(gold, pred, id_col, label_col)
    v = vocab.select(F.col(vocab.columns[0]).alias(label_col))
    j = v.join(c, label_col, "left").na.fill(0, ["tp", "fp", "fn"])
    n = n_rows if isinstance(n_rows, Column) else F.lit(n_rows)
    return j.select(label_col, (n - F.col("tp") - F.col("fp") - F.col("fn")).cast("bigint").alias("tn"),
                    "fp", "fn", "tp")


def per_label_scores(conf: DataFrame, label_col: str = "label") -> DataFrame:
    """Precision / recall / F1 per label from 2x2 counts, 0 when undefined."""
    p = safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    r = safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return conf.select(label_col, r6(p).alias("precision"), r6(r).alias("recall"), r6(fbeta(p, r)).alias("f1"))


def micro_scores(conf: DataFrame) -> DataFrame:
    """Micro precision / recall / F1 over per-label counts."""
    s = conf.agg(F.sum("tp").cast("bigint").alias("tp"), F.sum("fp").cast("bigint").alias("fp"),
                 F.sum("fn").cast("bigint").alias("fn"))
    p = safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    r = safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.select("tp", "fp", "fn", r6(p).alias("precision"), r6(r).alias("recall"), r6(fbeta(p, r)).alias("f1"))


def subset_accuracy(rows: DataFrame, gold: DataFrame, pred: DataFrame, id_col: str = "id",
                    label_col: str = "label") -> DataFrame:
    """Share of rows whose gold and predicted sets are equal (G6); rows with two empty sets count as exact."""
    pairs = flagged_pairs(gold, pred, id_col, label_col)
    bad = pairs.filter(F.col("g") != F.col("p")).select(id_col).distinct().withColumn("_bad", F.lit(1))
    j = rows.select(id_col).join(bad, id_col, "left")
    return j.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.sum(F.when(F.col("_bad").isNull(), 1).otherwise(0)).cast("bigint").alias("n_exact"),
    ).select("n_rows", "n_exact", r6(safe_div(F.col("n_exact"), F.col("n_rows"))).alias("accuracy"))


def confusion_to_text(conf: DataFrame, label_col: str = "label") -> DataFrame:
    """One string 'label\\ttn\\tfp\\tfn\\ttp\\t...' in code-point label order.

    Collects one short struct per label: bounded by the vocabulary."""
    item = F.concat_ws("\t", F.col(label_col), *[F.col(c).cast("string") for c in ("tn", "fp", "fn", "tp")])
    parts = conf.select(F.struct(F.col(label_col).alias("k"), F.concat(item, F.lit("\t")).alias("s")).alias("x"))
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "")
                     .alias("confusion"))


def confusion_from_text(text: DataFrame, col: str = "confusion", label_col: str = "label") -> DataFrame:
    """Parse the tab string back to (label, tn, fp, fn, tp) rows."""
    f = F.split(F.regexp_replace(F.col(col), "\t$", ""), "\t")
    x = text.select(f.alias("f")).select("f", F.explode(F.sequence(F.lit(0), F.size("f") - 1, F.lit(5))).alias("i"))
    el = lambda k: F.element_at("f", F.col("i") + k + 1)
    return x.select(el(0).alias(label_col), *[el(k).cast("bigint").alias(n)
                                              for k, n in zip(range(1, 5), ("tn", "fp", "fn", "tp"))])


def classification_report(conf: DataFrame, rows: DataFrame, gold: DataFrame, pred: DataFrame,
                          id_col: str = "id", label_col: str = "label") -> DataFrame:
    """Per-label precision / recall / f1 / support plus micro, macro, weighted and samples averages."""
    p = safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    r = safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    # one row per label, written once: the label rows and three averages come from it
    per = cut_lineage(conf.select(label_col, "tp", "fp", "fn", p.alias("p"), r.alias("r"), fbeta(p, r).alias("f"),
                                  (F.col("tp") + F.col("fn")).alias("support")))
    out_cols = lambda lab, pp, rr, ff, ss: [F.lit(lab).alias(label_col) if isinstance(lab, str) else lab,
                                            r6(pp).alias("precision"), r6(rr).alias("recall"),
                                            r6(ff).alias("f1"), ss.cast("bigint").alias("support")]
    labels_part = per.select(*out_cols(F.col(label_col), F.col("p"), F.col("r"), F.col("f"), F.col("support")))
    tot = per.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
                  F.avg("p").alias("mp"), F.avg("r").alias("mr"), F.avg("f").alias("mf"),
                  F.sum("support").alias("support"),
                  F.sum(F.col("p") * F.col("support")).alias("wp"), F.sum(F.col("r") * F.col("support")).alias("wr"),
                  F.sum(F.col("f") * F.col("support")).alias("wf"))
    mp = safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    mr = safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    micro = tot.select(*out_cols("micro avg", mp, mr, fbeta(mp, mr), F.col("support")))
    macro = tot.select(*out_cols("macro avg", F.col("mp"), F.col("mr"), F.col("mf"), F.col("support")))
    weighted = tot.select(*out_cols("weighted avg", safe_div(F.col("wp"), F.col("support")),
                                    safe_div(F.col("wr"), F.col("support")),
                                    safe_div(F.col("wf"), F.col("support")), F.col("support")))
    samples = sample_scores(rows, gold, pred, id_col, label_col).select(
        *out_cols("samples avg", F.col("sp"), F.col("sr"), F.col("sf"), F.col("support")))
    return labels_part.unionByName(micro).unionByName(macro).unionByName(weighted).unionByName(samples)


def sample_scores(rows: DataFrame, gold: DataFrame, pred: DataFrame, id_col: str = "id",
                  label_col: str = "label") -> DataFrame:
    """Mean over rows of per-row precision, recall, F1 (rows with empty sets included, 0/0 = 0)."""
    pairs = flagged_pairs(gold, pred, id_col, label_col)
    per_row = pairs.groupBy(id_col).agg(F.sum(F.col("g") * F.col("p")).alias("i"), F.sum("g").alias("ng"),
                                        F.sum("p").alias("np"))
    j = rows.select(id_col).join(per_row, id_col, "left").na.fill(0, ["i", "ng", "np"])
    return j.agg(F.avg(safe_div(F.col("i"), F.col("np"))).alias("sp"),
                 F.avg(safe_div(F.col("i"), F.col("ng"))).alias("sr"),
                 F.avg(safe_div(2 * F.col("i"), F.col("ng") + F.col("np"))).alias("sf"),
                 F.sum("ng").alias("support"))


NO_TRUE = "<no true label>"
NO_PRED = "<no predicted label>"


def mlcm(sets: DataFrame, gold_col: str = "gold", pred_col: str = "pred", no_true: str = NO_TRUE,
         no_pred: str = NO_PRED) -> DataFrame:
    """Multi-label confusion matrix (G12), raw counts and row share in percent.

    Per row (T = gold set, P = predicted set): every hit t in T∩P adds (t, t);
    if both T\\P and P\\T are non-empty every pair of the two differences adds
    (t, p); only misses add (t, no_pred); only extras add (t, p) for every
    t in T and extra p; an empty T adds (no_true, p) per p, or
    (no_true, no_pred) when P is empty too.  Pairs are formed inside one row
    from its own (vocabulary-bounded) sets and partially aggregated before the
    shuffle.
    """
    t, p = F.col(gold_col), F.col(pred_col)
    hits = F.array_intersect(t, p)
    miss = F.array_except(t, p)
    extra = F.array_except(p, t)

    def pairs(a: Column, b: Column) -> Column:
        return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(x.alias("t"), y.alias("p")))))

    diag = F.transform(hits, lambda x: F.struct(x.alias("t"), x.alias("p")))
    cells = (
        F.when(F.size(t) == 0,
               F.when(F.size(p) == 0, F.array(F.struct(F.lit(no_true).alias("t"), F.lit(no_pred).alias("p"))))
               .otherwise(F.transform(p, lambda y: F.struct(F.lit(no_true).alias("t"), y.alias("p")))))
        .when((F.size(miss) > 0) & (F.size(extra) > 0), F.concat(diag, pairs(miss, extra)))
        .when(F.size(miss) > 0, F.concat(diag, F.transform(miss, lambda x: F.struct(x.alias("t"), F.lit(no_pred).alias("p")))))
        .when(F.size(extra) > 0, F.concat(diag, pairs(t, extra)))
        .otherwise(diag)
    )
    counts = sets.select(F.explode(cells).alias("c")).groupBy(
        F.col("c.t").alias("true_label"), F.col("c.p").alias("pred_label")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("true_label")
    return counts.select("true_label", "pred_label", F.col("n").cast("bigint").alias("n"),
                         r6(F.col("n") * 100.0 / F.sum("n").over(w)).alias("row_pct"))


def value_runs(df: DataFrame, value_col: str, by: list[str] | None = None) -> DataFrame:
    """Distinct values per group with their count ``_c`` and the inclusive
    running total ``_cum`` in (group, value) order: value counts first (a hot
    value collapses map-side to one row per task), then a range-partitioned
    running total written once to the checkpoint folder."""
    by = by or []
    vc = df.filter(F.col(value_col).isNotNull()).groupBy(*by, value_col).agg(F.count(F.lit(1)).alias("_c"))
    return with_running_total(vc, [*by, value_col], "_c", "_cum")


def quantiles_from_runs(r: DataFrame, value_col: str, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """Quantiles from ``value_runs``: the few target positions (2 per group and
    probability) are looked up by a broadcast range condition and
    interpolated linearly.  Output: (by..., p, q)."""
    by = by or []
    g = r.groupBy(*by).agg(F.min(F.col("_cum") - F.col("_c")).alias("_g0"), F.sum("_c").alias("_n"))
    h = (F.col("_n") - 1) * F.col("_p")
    tg = g.select(*by, "_g0", "_n", F.explode(F.array(*[F.lit(float(x)) for x in probs])).alias("_p"))
    tg = tg.select(*[F.col(b).alias(f"_t_{b}") for b in by], "_p", (h - F.floor(h)).alias("_frac"),
                   F.explode(F.array(F.struct(F.lit(0).alias("k"), (F.col("_g0") + F.floor(h)).cast("bigint").alias("pos")),
                                     F.struct(F.lit(1).alias("k"), (F.col("_g0") + F.ceil(h)).cast("bigint").alias("pos"))))
                   .alias("_t")).select("*", "_t.k", "_t.pos").drop("_t")
    cond = [F.col(b) == F.col(f"_t_{b}") for b in by]
    cond += [F.col("_cum") - F.col("_c") <= F.col("pos"), F.col("pos") < F.col("_cum")]
    hit = r.join(sized_broadcast(tg), cond)
    out = hit.groupBy(*by, "_p").agg(F.max(F.when(F.col("k") == 0, F.col(value_col))).alias("_lo"),
                                     F.max(F.when(F.col("k") == 1, F.col(value_col))).alias("_hi"),
                                     F.max("_frac").alias("_frac"))
    q = F.col("_lo").cast("double") + F.col("_frac") * (F.col("_hi").cast("double") - F.col("_lo").cast("double"))
    return out.select(*by, F.col("_p").alias("p"), q.alias("q"))


def exact_quantiles(df: DataFrame, value_col: str, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles per group, linear interpolation between the order
    statistics at position (n - 1) * p (the usual "linear" definition).
    Output: (by..., p, q).  No group of values is ever gathered in one task
    (see ``value_runs`` / ``quantiles_from_runs``)."""
    return quantiles_from_runs(value_runs(df, value_col, by), value_col, probs, by)


#: Size of a quantile sketch, and the error of a single rank that it keeps with
#: probability 0.99 (share of all rows).
SKETCH_K, SKETCH_ERROR = 200, 0.0133


def sketch_quantiles(df: DataFrame, value_col: str, probs: list[float], by: list[str] | None = None, k: int = SKETCH_K) -> DataFrame:
    """Approximate quantiles (by..., p, q) from one KLL sketch a group, for tables whose distinct
    values are too many to count: a partial aggregate of a few kilobytes per task and
    group, merged after one shuffle.  With the default ``k`` a value's rank is wrong by at most
    ``SKETCH_ERROR`` of the rows with probability 0.99; groups of up to about ``k`` rows are
    exact.  Nulls don't count; a group of nulls only has no row."""
    by = by or []
    v = F.col(value_col).cast("double")
    sketch = df.filter(v.isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(v, F.lit(k)).alias("_s"))
    p = F.array(*[F.lit(float(x)) for x in probs])
    pairs = F.arrays_zip(p.alias("p"), F.kll_sketch_get_quantile_double("_s", p).alias("q"))
    return sketch.select(*by, F.inline(pairs))


def rank_errors(df: DataFrame, quantiles: DataFrame, value_col: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``rank_error`` to (by..., p, q) rows: how far p lies outside the ranks that the
    value q really has (shares of rows below it and up to it), 0 inside them."""
    by = by or []
    asked = quantiles.groupBy(*by).agg(F.collect_list(F.struct("p", "q")).alias("_a"))  # one row a group and probability
    x = df.filter(F.col(value_col).isNotNull()).groupBy(*by, value_col).agg(F.count(F.lit(1)).alias("_c"))
    x = x.join(sized_broadcast(asked), by) if by else x.crossJoin(F.broadcast(asked))
    x = x.select(*by, value_col, "_c", F.explode("_a").alias("_a")).select(*by, value_col, "_c", "_a.*")
    r = x.groupBy(*by, "p", "q").agg(
        (F.sum(F.when(F.col(value_col) < F.col("q"), F.col("_c")).otherwise(0)) / F.sum("_c")).alias("_low"),
        (F.sum(F.when(F.col(value_col) <= F.col("q"), F.col("_c")).otherwise(0)) / F.sum("_c")).alias("_high"))
    return r.select(*by, "p", "q", F.greatest(F.lit(0.0), F.col("_low") - F.col("p"), F.col("p") - F.col("_high")).alias("rank_error"))


def describe_numeric(long: DataFrame, metric_col: str = "metric", value_col: str = "v") -> DataFrame:
    """Count, mean, std (sample), min, quartiles, max per metric of a long
    (metric, value) table.  The raw rows are read once: every statistic comes
    from the checkpointed distinct-value table of ``value_runs`` (mean first,
    then the centred sum of squares, which is numerically stable)."""
    r = value_runs(long, value_col, [metric_col])
    v, c = F.col(value_col).cast("double"), F.col("_c")
    s1 = r.groupBy(metric_col).agg(F.sum(c).alias("count"), (F.sum(c * v) / F.sum(c)).alias("_mean"),
                                   F.min(value_col).alias("min"), F.max(value_col).alias("max"))
    ss = r.join(sized_broadcast(s1.select(metric_col, "_mean")), metric_col).groupBy(metric_col).agg(
        F.sum(c * (v - F.col("_mean")) * (v - F.col("_mean"))).alias("_ss"))
    std = F.when(F.col("count") > 1, F.sqrt(F.col("_ss") / (F.col("count") - 1)))
    qs = quantiles_from_runs(r, value_col, [0.25, 0.5, 0.75], [metric_col]).groupBy(metric_col).agg(
        *[r6(F.max(F.when(F.col("p") == p, F.col("q")))).alias(name)
          for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    out = s1.join(ss, metric_col).join(qs, metric_col, "left")
    return out.select(metric_col, F.col("count").cast("bigint").alias("count"), r6(F.col("_mean")).alias("mean"),
                      r6(std).alias("std"), "min", "q25", "q50", "q75", "max")


def bce_loss(long: DataFrame, y_col: str = "y", p_col: str = "prob", eps: float = 1e-7,
             by: list[str] | None = None) -> DataFrame:
    """Mean binary cross-entropy over every (row, class) element, probabilities clipped."""
    p = F.least(F.greatest(F.col(p_col), F.lit(eps)), F.lit(1 - eps))
    y = F.col(y_col).cast("double")
    loss = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    return long.groupBy(*(by or [])).agg(r6(F.avg(loss)).alias("loss"), F.count(F.lit(1)).alias("n_elements"))


def next_experiment(results: DataFrame, col: str = "experiment") -> DataFrame:
    """max + 1, or 1 for an empty table."""
    return results.agg((F.coalesce(F.max(col), F.lit(0)) + 1).cast("bigint").alias("next_experiment"))


def best_per_label(results: DataFrame, label_col: str = "label", score_col: str = "f1",
                   run_col: str = "experiment") -> DataFrame:
    """Best run per label by score; ties go to the lowest run id."""
    best = F.min_by(F.struct(F.col(score_col), F.col(run_col)),
                    F.struct(-F.col(score_col), F.col(run_col)))
    return results.groupBy(label_col).agg(best.alias("b")).select(
        label_col, F.col("b")[run_col].alias(run_col), F.col("b")[score_col].alias(score_col))


def leaderboard(results: DataFrame, run_col: str = "experiment", score_col: str = "f1") -> DataFrame:
    """Mean score per run ranked best first (G21), ties alike.

    Distinct scores are counted and range-sorted with a distributed running
    total: a run's rank is one more than the number of runs above its score."""
    per = results.groupBy(run_col).agg(r6(F.avg(score_col)).alias("mean_f1"),
                                       F.count(F.lit(1)).cast("bigint").alias("n_labels"))
    per = cut_lineage(per)
    scores = per.groupBy("mean_f1").agg(F.count(F.lit(1)).alias("_c"))
    scores = with_running_total(scores, [F.desc("mean_f1")], "_c", "_upto")
    return per.join(scores, "mean_f1").select(run_col, "mean_f1", "n_labels",
                                              (F.col("_upto") - F.col("_c") + 1).cast("bigint").alias("rank"))


def perplexity(losses: DataFrame, col: str = "loss") -> DataFrame:
    """exp(mean loss)."""
    return losses.agg(r6(F.avg(col)).alias("mean_loss"), r6(F.exp(F.avg(col))).alias("perplexity"))
