"""Derived inputs built from the test-data tables with integer arithmetic.

Every fixture is a pure per-row derivation (or one grouped count) of a given
table, so its size grows with the table; no join against made-up data.  The
same rules are written as SQL in ``tagweave.plans.oracle_sql`` so DuckDB
builds identical rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.fixed import EVENT_TYPES, LEAVES, ROOT, TAXONOMY_EDGES
from tagweave.functions.seeded import seeded_int
from tagweave.session import read_table

N_LEAVES = len(LEAVES)


def taxonomy_edges(spark: SparkSession) -> DataFrame:
    """The label DAG as an edge table (parent, child)."""
    return spark.createDataFrame(TAXONOMY_EDGES, "parent string, child string")


_TAXO: dict[str, dict[str, DataFrame]] = {}


def taxonomy(spark: SparkSession) -> dict[str, DataFrame]:
    """Edges, ancestor pairs (with and without root) and closure of the fixed
    taxonomy, computed once per application and written to the checkpoint
    folder (a small dimension table reused by every label query)."""
    from tagweave.operators import taxonomy as tx
    from tagweave.session import cut_lineage

    key = spark.sparkContext.applicationId
    if key not in _TAXO:
        edges = cut_lineage(taxonomy_edges(spark))
        anc_all = cut_lineage(tx.ancestor_pairs(edges, keep_root=True))
        anc = anc_all.filter(F.col("ancestor") != ROOT)
        clo = cut_lineage(tx.closure(edges, pairs=anc))
        _TAXO[key] = {"edges": edges, "anc_all": anc_all, "anc": anc, "closure": clo}
    return _TAXO[key]


def _leaf_name(j: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEAVES]), j + 1)


def _gold_rule(doc_id: Column, j: Column) -> Column:
    return (doc_id * (j * 2 + 3) + j * j) % 11 == 0


def _pred_rule(doc_id: Column, j: Column) -> Column:
    return (_gold_rule(doc_id, j) & ((doc_id + j) % 4 != 0)) | ((doc_id * (j + 5) + j * 2) % 23 == 0)


def _leaf_numbers(doc_id: Column, rule) -> Column:
    """Per-row array of the leaf numbers j that satisfy ``rule`` (no shuffle)."""
    return F.filter(F.sequence(F.lit(0), F.lit(N_LEAVES - 1)), lambda j: rule(doc_id, j))


def doc_label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX1 in array form: one row per document, gold and predicted label arrays.

    ``gold``/``pred`` are sorted by leaf number; documents without labels keep
    an empty array (they count for subset accuracy and sample averages).
    """
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    g = _leaf_numbers(F.col("doc_id"), _gold_rule)
    p = _leaf_numbers(F.col("doc_id"), _pred_rule)
    return d.select(
        "doc_id",
        F.transform(g, _leaf_name).alias("gold"),
        F.transform(p, _leaf_name).alias("pred"),
        g.alias("gold_j"),
        p.alias("pred_j"),
    )


def gold_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX1 gold as a long table (doc_id, j, label)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    return (
        d.select("doc_id", F.explode(_leaf_numbers(F.col("doc_id"), _gold_rule)).alias("j"))
        .select("doc_id", "j", _leaf_name(F.col("j")).alias("label"))
    )


def pred_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX1 predictions as a long table (doc_id, j, label)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    return (
        d.select("doc_id", F.explode(_leaf_numbers(F.col("doc_id"), _pred_rule)).alias("j"))
        .select("doc_id", "j", _leaf_name(F.col("j")).alias("label"))
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX2: feature rows (vec_id, split, embedding, labels array<string>)."""
    e = read_table(spark, sf_dir, "embeddings")
    split = (
        F.when(F.col("vec_id") % 10 < 8, "train")
        .when(F.col("vec_id") % 10 == 8, "dev")
        .otherwise("test")
    )
    lab = F.col("label").cast("string")
    nxt = ((F.col("label") + 1) % 10).cast("string")
    labels = F.when(F.col("vec_id") % 3 == 0, F.array(lab, nxt)).otherwise(F.array(lab))
    return e.select("vec_id", split.alias("split"), "embedding", F.array_sort(F.array_distinct(labels)).alias("labels"))


def hidden_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX3: (vec_id, layer, token, mask, vec[8]); 2 layers x 4 tokens x 8 units."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    lt = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("lt")
    x = e.select("vec_id", "embedding", lt)
    layer = (F.col("lt") / 4).cast("int")
    token = F.col("lt") % 4
    return x.select(
        "vec_id",
        layer.alias("layer"),
        token.alias("token"),
        (token < F.col("vec_id") % 4 + 1).cast("int").alias("mask"),
        F.slice("embedding", F.col("lt") * 8 + 1, 8).alias("vec"),
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX4: (vec_id, logits array<double>[64]) = 10 * embedding."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 10).alias("logits"))


def onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX5: wide one-hot table per user (user_id, click, error, purchase, signup, view)."""
    ev = read_table(spark, sf_dir, "events").select("user_id", "event_type")
    return (
        ev.groupBy("user_id")
        .pivot("event_type", EVENT_TYPES)
        .agg((F.count(F.lit(1)) % 3 == 0).cast("int"))
        .na.fill(0, EVENT_TYPES)
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX6: per-label experiment results (experiment, label, f1)."""
    ev = read_table(spark, sf_dir, "events").select("user_id", "event_type")
    return (
        ev.groupBy((F.col("user_id") % 12).alias("experiment"), F.col("event_type").alias("label"))
        .agg(((F.count(F.lit(1)) % 5) / F.lit(5.0)).alias("f1"))
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX7: flat labelled corpus (doc_id, text, label) with nulls and duplicates."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    g = _leaf_numbers(F.col("doc_id"), _gold_rule)
    return d.select(
        "doc_id",
        F.when(F.col("doc_id") % 41 == 0, F.lit(None).cast("string")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 37 == 0, F.lit(None).cast("string"))
        .otherwise(F.array_join(F.transform(g, lambda j: j.cast("string")), ","))
        .alias("label"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX9: conversation turns, every even turn signed '— role'."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select(
        "conv_id",
        "turn",
        F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" — "), "role")).otherwise(F.col("text")).alias("text"),
    )


def submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX10: a prediction submission (doc_id, labels) with missing, extra and unknown entries."""
    s = doc_label_sets(spark, sf_dir).select("doc_id", "pred")
    kept = s.filter(F.col("doc_id") % 97 != 0)
    extra = s.filter(F.col("doc_id") % 89 == 0).select((F.col("doc_id") + 1000000).alias("doc_id"), "pred")
    both = kept.unionByName(extra)
    labels = F.when(F.col("doc_id") % 50 == 0, F.concat("pred", F.array(F.lit("Unknown")))).otherwise(F.col("pred"))
    return both.select("doc_id", labels.alias("labels"))


def social(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX11: social-media style text with handles, links and curly punctuation."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select(
        "conv_id",
        "turn",
        F.concat(
            "text", F.lit(" @user"), F.col("conv_id").cast("string"), F.lit(" https://x.example/"),
            F.col("turn").cast("string"), F.lit(" can’t …"),
        ).alias("text"),
    )


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX12: per-example loss (vec_id, loss): 3 times the mean absolute value of its vector."""
    e = read_table(spark, sf_dir, "embeddings")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    return e.select("vec_id", (total / F.size("embedding") * 3).alias("loss"))


def doc_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX13: split column for documents (train / validation / dev)."""
    d = read_table(spark, sf_dir, "documents")
    m = F.col("doc_id") % 10
    return d.withColumn("split", F.when(m < 7, "train").when(m < 9, "validation").otherwise("dev"))


N_PLANTED = 10


def planted_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX14: labels that can be learned.  (vec_id, split, features: all 64 numbers of the
    embedding, number k moved up by 1 if the row has leaf k % 10, else down by 1; labels).
    Leaf j < 10 belongs to a row by a seeded hash (3 in 10) or if (vec_id div 10) % 10 = j.
    The labels of dev rows are noisy: one in ten is flipped after the features are made."""
    f = features(spark, sf_dir).select("vec_id", "split", "embedding")
    has = [(seeded_int(F.col("vec_id"), F.lit(j), seed=14) % 10 < 3) | (F.expr("vec_id div 10") % 10 == j)
           for j in range(N_PLANTED)]
    noisy = [h != ((F.col("split") == "dev") & (seeded_int(F.col("vec_id"), F.lit(j), seed=15) % 10 == 0))
             for j, h in enumerate(has)]
    # the shifts, repeated over the vector, are an argument, so that a row takes its hashes once, not once a number
    shifts, width = F.array(*[F.when(h, 1.0).otherwise(-1.0) for h in has]), F.greatest(F.size("embedding"), F.lit(0))
    repeated = F.slice(F.flatten(F.array_repeat(shifts, F.ceil(width / N_PLANTED).cast("int"))), F.lit(1), width)
    moved = F.zip_with("embedding", repeated, lambda x, s: x.cast("double") + s)
    return f.select("vec_id", "split", moved.alias("features"),
                    F.array_sort(F.array_compact(F.array(*[F.when(h, F.lit(LEAVES[j])) for j, h in enumerate(noisy)]))).alias("labels"))
