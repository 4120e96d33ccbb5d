"""Source / sink queries (A1-A11): each writes a derived table with the sink
under test into a fresh folder below the shared checkpoint folder, reads it
back with the matching reader and returns what was read."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.fixed import CSV_FILES, DATASETS, JSON_FILES, UNLABELLED_FILES
from tagweave.operators import metrics as m
from tagweave.plans import fixtures as fx
from tagweave.plans.q_metrics import PER_LABEL_SQL, _conf
from tagweave.plans.registry import register
from tagweave.plans.sqlbase import q, sql
from tagweave.session import read_table, scratch_path
from tagweave.sources import io
from tagweave.sources.catalog import Catalog, Recipe, dataset_catalog


@register("read_json_roundtrip", sql(None, """
SELECT CAST(d.doc_id AS VARCHAR) AS id, md5(d.text) AS text_md5,
       CASE WHEN d.doc_id % 10 = 9 THEN NULL ELSE gs.gold END AS labels
FROM documents d JOIN gsets gs ON gs.doc_id = d.doc_id"""))
def read_json_roundtrip(spark, sf_dir):
    """A1 / A10: labelled records (test split unlabelled: no ``labels`` key) as JSON lines and back."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    s = fx.doc_label_sets(spark, sf_dir).select("doc_id", "gold")
    rec = docs.join(s, "doc_id").select(
        F.col("doc_id").cast("string").alias("id"), "text",
        F.when(F.col("doc_id") % 10 == 9, F.lit(None)).otherwise(F.col("gold")).alias("labels"))
    path = scratch_path(spark, "json")
    io.write_json_records(rec, path)
    back = io.read_json_records(spark, path, io.LABELLED_SCHEMA, multiline=False)
    return back.select("id", F.md5("text").alias("text_md5"), F.array_join(F.array_sort("labels"), "|").alias("labels"))


@register("read_json_array", sql(None, """
SELECT CAST(d.doc_id AS VARCHAR) AS id, md5(d.text) AS text_md5, gs.gold AS labels
FROM documents d JOIN gsets gs ON gs.doc_id = d.doc_id"""))
def read_json_array(spark, sf_dir):
    """A1: files that each hold one JSON array of records over several lines, one file a task."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rec = docs.join(fx.doc_label_sets(spark, sf_dir).select("doc_id", "gold"), "doc_id").select(
        F.col("doc_id").cast("string").alias("id"), "text", F.col("gold").alias("labels"))
    path = scratch_path(spark, "json-array")
    io.write_json_array(rec, path)
    back = io.read_json_records(spark, path, io.LABELLED_SCHEMA)
    return back.select("id", F.md5("text").alias("text_md5"), F.array_join(F.array_sort("labels"), "|").alias("labels"))


@register("read_onehot_csv", sql(None, "SELECT * FROM onehot"))
def read_onehot_csv(spark, sf_dir):
    """A3: ``,`` CSV with one 0/1 column per label, and back."""
    table = fx.onehot(spark, sf_dir)
    path = scratch_path(spark, "onehot")
    io.write_delimited(table, path, ",")
    return io.read_delimited(spark, path, table.schema, ",")


@register("read_csv_roundtrip", sql(None, "SELECT doc_id, md5(text) AS text_md5, label FROM corpus"))
def read_csv_roundtrip(spark, sf_dir):
    """A2 / A10: ``;`` CSV with quoted multi-line text, nulls and empty labels, and back."""
    path = scratch_path(spark, "csv")
    io.write_delimited(fx.corpus(spark, sf_dir), path, ";")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("label", T.StringType())])
    back = io.read_delimited(spark, path, schema, ";")
    return back.select("doc_id", F.md5("text").alias("text_md5"), "label")


@register("load_splits", sql("""
sp AS (SELECT split, n_chars FROM dsplit UNION ALL
       SELECT 'train_all', n_chars FROM dsplit WHERE split IN ('train', 'validation'))""", """
SELECT split, count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM sp GROUP BY split"""))
def load_splits(spark, sf_dir):
    """Catalogue recipe of files per split, incl. a union split; one frame with ``split``."""
    base = scratch_path(spark, "splits")
    d = fx.doc_splits(spark, sf_dir).select("doc_id", "n_chars", "split")
    d.write.partitionBy("split").parquet(base)
    cat = Catalog()
    cat.register("docs", Recipe("parquet", {
        "train": [f"{base}/split=train"], "validation": [f"{base}/split=validation"], "dev": [f"{base}/split=dev"],
        "train_all": [f"{base}/split=train", f"{base}/split=validation"]}))
    df = cat.load(spark, "docs")
    return df.groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                                   F.sum("n_chars").cast("bigint").alias("n_chars"))


# Which files the rows of FX13 / FX7 go to: by doc_id % 8 the JSON files, by doc_id % 3 the CSV files.
CATALOG_FILES = {path: i for i, path in enumerate(JSON_FILES)}
CATALOG_CSV = {path: i for i, path in enumerate(CSV_FILES)}


def _catalog_sql() -> str:
    parts = []
    for name, splits in DATASETS.items():
        for split, files in splits.items():
            if all(f in CATALOG_CSV for f in files):
                keep = ", ".join(str(CATALOG_CSV[f]) for f in files)
                parts.append(f"SELECT {q(name)} AS dataset, {q(split)} AS split, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars, "
                             "CAST(sum(len(string_split(label, ','))) AS BIGINT) AS n_labels FROM (SELECT text, label, row_number() OVER "
                             f"(PARTITION BY doc_id % 3, text ORDER BY doc_id) AS n, doc_id FROM corpus WHERE text IS NOT NULL AND label IS NOT NULL) "
                             f"WHERE n = 1 AND doc_id % 3 IN ({keep})")
            else:
                keep = ", ".join(str(CATALOG_FILES[f]) for f in files)
                parts.append(f"SELECT {q(name)} AS dataset, {q(split)} AS split, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars, "
                             "CAST(coalesce(sum(k), 0) AS BIGINT) AS n_labels FROM (SELECT d.doc_id, d.text, (SELECT count(*) FROM gold g WHERE g.doc_id = d.doc_id "
                             f"AND d.doc_id % 8 NOT IN ({', '.join(str(CATALOG_FILES[f]) for f in UNLABELLED_FILES)})) AS k FROM documents d) WHERE doc_id % 8 IN ({keep})")
    return "res AS (" + " UNION ALL ".join(parts) + ")"


def write_catalog_files(spark, sf_dir, root: str) -> None:
    """The files of all recipes, made of the documents: JSON arrays (unlabelled ones without
    labels) and ``;`` CSV with null texts and labels and repeated texts."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rec = docs.join(fx.doc_label_sets(spark, sf_dir).select("doc_id", "gold"), "doc_id")
    for path, i in CATALOG_FILES.items():
        cols = [F.col("doc_id").cast("string").alias("id"), "text"] + ([] if path in UNLABELLED_FILES else [F.col("gold").alias("labels")])
        io.write_json_array(rec.filter(F.col("doc_id") % 8 == i).select(*cols), f"{root}/{path}")
    for path, i in CATALOG_CSV.items():
        part = fx.corpus(spark, sf_dir).filter(F.col("doc_id") % 3 == i)
        io.write_delimited(part.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").select("text", "label"), f"{root}/{path}", ";")


@register("load_catalog", sql(_catalog_sql(), "SELECT * FROM res"))
def load_catalog(spark, sf_dir):
    """A4: the nine datasets by name: JSON-array and ``;`` CSV recipes, unions of files; rows,
    characters and labels of every split."""
    root = scratch_path(spark, "datasets")
    write_catalog_files(spark, sf_dir, root)
    cat, out = dataset_catalog(root), None
    for name in cat.names():
        df = cat.load(spark, name).groupBy("split").agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).cast("bigint").alias("n_chars"),
            F.sum(F.coalesce(F.size("labels"), F.lit(0))).cast("bigint").alias("n_labels")).select(F.lit(name).alias("dataset"), "*")
        out = df if out is None else out.unionByName(df)
    return out


@register("read_classes", sql(None, "SELECT DISTINCT label FROM gold"))
def read_classes(spark, sf_dir):
    """A5: class list file with padding and blank lines, read back trimmed."""
    labels = fx.gold_long(spark, sf_dir).select("label").distinct()
    lines = labels.select(F.concat(F.lit("  "), "label", F.lit(" ")).alias("value")).union(
        labels.limit(1).select(F.lit("   ").alias("value")))
    path = scratch_path(spark, "classes")
    lines.write.text(path)
    return io.read_classes(spark, path).distinct()


@register("features_roundtrip", sql(None, """
SELECT vec_id, split, 'fx' AS model, CAST(len(embedding) AS BIGINT) AS n_dims,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS x_sum
FROM feat"""))
def features_roundtrip(spark, sf_dir):
    """Feature table + manifest columns partitioned by (model, split), every split read
    back by a filter that prunes the others' partitions."""
    f = fx.features(spark, sf_dir).select(
        "vec_id", "split", "embedding", F.lit("fx").alias("model"), F.lit("cls").alias("extraction_method"),
        F.lit("-1").alias("layers"), F.lit("none").alias("layers_aggregation_method"),
        F.lit("embeddings").alias("dataset"))
    path = scratch_path(spark, "features")
    io.write_features(f, path)
    parts = [io.read_features(spark, path).filter(F.col("split") == s) for s in ("train", "dev", "test")]
    back = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return back.select("vec_id", "split", "model", F.size("embedding").cast("bigint").alias("n_dims"),
                       m.r6(F.aggregate("embedding", F.lit(0.0).cast("double"),
                                        lambda a, x: a + x.cast("double"))).alias("x_sum"))


@register("write_predictions", sql(None, "SELECT CAST(doc_id AS VARCHAR) AS id, pred AS labels FROM psets"))
def write_predictions(spark, sf_dir):
    """Predictions attached by id (rows without predictions get an empty list)."""
    rows = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    p = fx.pred_long(spark, sf_dir).groupBy(F.col("doc_id").alias("id")).agg(
        F.array_sort(F.collect_list("label")).alias("labels"))
    path = scratch_path(spark, "predictions")
    io.write_predictions(rows, p, path)
    back = io.read_json_records(spark, path, io.PREDICTION_SCHEMA, multiline=False)
    return back.select("id", F.array_join("labels", "|").alias("labels"))


RUN_SCHEMA = T.StructType([T.StructField("experiment", T.LongType()), T.StructField("label", T.StringType()),
                           T.StructField("f1", T.DoubleType())])


@register("append_results", sql(None, "SELECT experiment, label, f1 FROM runs"))
def append_results(spark, sf_dir):
    """Two appends to a results table that does not exist yet, then read back."""
    path = scratch_path(spark, "results")
    runs = fx.runs(spark, sf_dir).select(F.col("experiment").cast("bigint"), "label", "f1")
    io.append_table(runs.filter(F.col("experiment") < 6), path)
    io.append_table(runs.filter(F.col("experiment") >= 6), path)
    return io.read_table_or_empty(spark, path, RUN_SCHEMA)


@register("append_per_label", sql(f"plab AS ({PER_LABEL_SQL})", """
SELECT CAST(e AS BIGINT) AS experiment, label, precision, recall, f1 FROM plab, (VALUES (1), (2)) v(e)"""))
def append_per_label(spark, sf_dir):
    """A9 + G18: per-label scores appended twice, each stamped with the next experiment id."""
    path = scratch_path(spark, "per_label")
    scores = m.per_label_scores(_conf(spark, sf_dir))
    io.append_with_next_experiment(spark, scores, path)
    io.append_with_next_experiment(spark, scores, path)
    return io.read_table_or_empty(spark, path, io.PER_LABEL_SCHEMA)
