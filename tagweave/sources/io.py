"""Readers and writers (A1-A11).  Schemas are always declared (no inference);
row formats (JSON, CSV) are converted once and Parquet is used afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELLED_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("labels", T.ArrayType(T.StringType())),
])

FLAT_SCHEMA = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("label", T.StringType()),
])

PREDICTION_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("labels", T.ArrayType(T.StringType())),
])

PER_LABEL_SCHEMA = T.StructType([
    T.StructField("experiment", T.LongType()),
    T.StructField("label", T.StringType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1", T.DoubleType()),
])

# Nulls are written as \N so they stay distinct from empty strings on read-back.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "nullValue": "\\N"}


def read_json_records(spark: SparkSession, path: str | list[str], schema: T.StructType = LABELLED_SCHEMA,
                      multiline: bool = True, corrupt_col: str | None = None) -> DataFrame:
    """A1: JSON array files (multiLine) or JSON lines; a missing key becomes null.

    With ``corrupt_col`` malformed records are kept (PERMISSIVE) and the raw
    text lands in that column (H8)."""
    r = spark.read.schema(schema if corrupt_col is None else
                          T.StructType(schema.fields + [T.StructField(corrupt_col, T.StringType())]))
    r = r.option("multiLine", str(multiline).lower()).option("mode", "PERMISSIVE")
    if corrupt_col:
        r = r.option("columnNameOfCorruptRecord", corrupt_col)
    return r.json(path)


def write_json_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A10: JSON lines, one file per partition (the scalable form of a JSON array)."""
    df.write.mode(mode).json(path)


def write_json_array(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A1: one JSON array of records per file and task, over several lines; null fields are left out.

    Records stream through, so a file has no size that must fit a task."""
    def array(batches):
        import pyarrow as pa

        opening = "["
        for batch in batches:
            lines = [opening + batch.column(0)[0].as_py()] if len(batch) else []
            lines += ["," + v.as_py() for v in batch.column(0)[1:]]
            if lines:
                opening = ","
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if opening == "[" else "]"], pa.string())], names=["value"])

    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))
    rows.mapInArrow(array, "value string").write.mode(mode).text(path)


def read_delimited(spark: SparkSession, path: str | list[str], schema: T.StructType = FLAT_SCHEMA,
                   sep: str = ";") -> DataFrame:
    """A2 / A3: delimited text with header, RFC-4180 quoting, embedded newlines."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).option("sep", sep).csv(path)


def write_delimited(df: DataFrame, path: str, sep: str = ";", mode: str = "overwrite") -> None:
    """A10: ``;``-separated CSV with header; quotes doubled inside quoted fields."""
    df.write.mode(mode).options(**CSV_OPTIONS).option("sep", sep).option("quoteAll", "false").csv(path)


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """A5: one class per line, trimmed, blanks dropped."""
    return spark.read.text(path).select(F.trim("value").alias("label")).filter(F.col("label") != "")


def write_features(df: DataFrame, path: str, partition_cols: tuple[str, ...] = ("model", "split"),
                   mode: str = "append") -> None:
    """Feature table with manifest columns, partitioned so readers prune by model / split."""
    df.write.mode(mode).partitionBy(*partition_cols).parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_predictions(rows: DataFrame, preds: DataFrame, path: str, id_col: str = "id",
                      labels_col: str = "labels") -> DataFrame:
    """Attach predictions to their rows by id (never by position) and
    write ``{id, labels}`` JSON lines.  Returns the written frame."""
    out = rows.select(id_col).join(preds.select(id_col, labels_col), id_col, "left").select(
        F.col(id_col).cast("string").alias("id"),
        F.coalesce(F.col(labels_col), F.array().cast("array<string>")).alias("labels"))
    out.write.mode("overwrite").json(path)
    return out


def append_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append rows to a results table, created on first write."""
    df.write.mode("append").format(fmt).save(path)


def read_table_or_empty(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Read a results table back; an absent table reads as empty."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except Exception as e:  # noqa: BLE001 - path-not-found surfaces as AnalysisException
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise


def append_with_next_experiment(spark: SparkSession, rows: DataFrame, path: str,
                                schema: T.StructType = PER_LABEL_SCHEMA) -> int:
    """A9 + G18: stamp rows with max(experiment)+1 of the table (1 when empty) and append."""
    current = read_table_or_empty(spark, path, schema)
    nxt = current.agg((F.coalesce(F.max("experiment"), F.lit(0)) + 1).alias("n")).first()["n"]
    append_table(rows.select(F.lit(nxt).cast("bigint").alias("experiment"), *[c for c in rows.columns]), path)
    return int(nxt)
