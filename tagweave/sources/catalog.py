"""Dataset catalogue (A4): a name maps to a recipe of files per split; loading
returns ONE DataFrame with a ``split`` column (never positional tuples), so
any number of splits and split unions are expressed by the recipe.

A split is a literal beside its files' rows, so a filter on ``split`` removes the other
splits' scans from the plan before anything is read."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.fixed import CSV_FILES, DATASETS
from tagweave.sources import io


@dataclass
class Recipe:
    """``fmt``: "json" (arrays of records), "csv", "onehot" (0/1 columns named by
    ``schema``) or "parquet".  ``labelled_text`` makes rows of (text, comma-joined label):
    rows without either go, of equal texts of a split the first stays, labels become a list."""

    fmt: str
    splits: dict[str, list[str]]
    schema: T.StructType | None = None
    options: dict[str, str] = field(default_factory=dict)
    labelled_text: bool = False


def _first_texts(df: DataFrame) -> DataFrame:
    df = df.select("text", "label").dropna(subset=["text", "label"])
    # the order of rows in the files; of equal texts the first stays
    rows = df.withColumn("_at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    rows = rows.groupBy("text").agg(F.min_by("label", "_at").alias("label"))
    return rows.select("text", F.split("label", ",").alias("labels"))


def _onehot_labels(df: DataFrame) -> DataFrame:
    names = [c for c in df.columns if c != "text"]
    hits = F.array_compact(F.array(*[F.when(F.col(f"`{c}`") == 1, F.lit(c)) for c in names]))
    return df.select("text", hits.alias("labels"))


class Catalog:
    def __init__(self) -> None:
        self._recipes: dict[str, Recipe] = {}

    def register(self, name: str, recipe: Recipe) -> None:
        if name in self._recipes:
            raise ValueError(f"dataset {name!r} already registered")
        self._recipes[name] = recipe

    def names(self) -> list[str]:
        return sorted(self._recipes)

    def _read(self, spark: SparkSession, r: Recipe, paths: list[str]) -> DataFrame:
        if r.fmt == "json":
            return io.read_json_records(spark, paths, r.schema or io.LABELLED_SCHEMA)
        if r.fmt == "csv":
            return io.read_delimited(spark, paths, r.schema or io.FLAT_SCHEMA, r.options.get("sep", ";"))
        if r.fmt == "onehot":
            if r.schema is None:
                raise ValueError("a one-hot recipe names its columns in the schema")
            return _onehot_labels(io.read_delimited(spark, paths, r.schema, r.options.get("sep", ",")))
        if r.fmt == "parquet":
            return spark.read.parquet(*paths)
        raise ValueError(f"unknown format {r.fmt}")

    def load(self, spark: SparkSession, name: str, splits: list[str] | None = None) -> DataFrame:
        if name not in self._recipes:
            raise KeyError(f"unknown dataset {name!r}; known: {self.names()}")
        r = self._recipes[name]
        out = None
        for s in splits or list(r.splits):
            df = self._read(spark, r, r.splits[s])
            df = (_first_texts(df) if r.labelled_text else df).withColumn("split", F.lit(s))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out


def dataset_catalog(root: str) -> Catalog:
    """The fixed datasets, their files below ``root``."""
    cat = Catalog()
    for name, splits in DATASETS.items():
        csv = all(f in CSV_FILES for files in splits.values() for f in files)
        paths = {s: [f"{root}/{f}" for f in files] for s, files in splits.items()}
        cat.register(name, Recipe("csv" if csv else "json", paths, labelled_text=csv))
    return cat
