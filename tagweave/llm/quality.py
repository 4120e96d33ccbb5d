"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow random-forest trees propose rules: every path from a root to a node is a
conjunction of conditions on statistics.  A lasso logistic regression weighs the
rules and drops most of them.  The rest is compiled into one Column expression,
so that scoring is a plain projection.  Trees and weights are fitted by Spark ML on a bounded,
hash-chosen sample of labelled rows; statistics always cover whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import materialize, narrow

#: Labelled rows that a fit uses at most (expected number; chosen by a hash of the id).
MAX_FIT_ROWS = 20_000
TREES, DEPTH, LASSO, SEED = 24, 3, 0.002, 17
THRESHOLD = 0.3
SPACE = r"[\x20\x09-\x0D]+"


def with_statistics(rows: DataFrame) -> DataFrame:
    """Adds the statistics of the whole ``text`` (null: empty); ratios over nothing are 0.

    Texts are split in a projection of their own, so that every statistic takes the same pieces.
    """
    names = rows.columns
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    split = rows.select("*", F.split("text", SPACE).alias("_tokens"), F.split("text", "\n").alias("_all_lines"))
    pieces = split.select(*names, F.array_remove("_tokens", "").alias("_words"), F.array_remove("_all_lines", "").alias("_lines"),
                          F.length("text").alias("_chars"))
    text, chars, words, lines = F.col("text"), F.col("_chars"), F.size("_words"), F.size("_lines")

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    stats = {
        "chars": chars.cast("double"),
        "words": words.cast("double"),
        "lines": lines.cast("double"),
        "letters": _ratio(F.length(F.regexp_replace(text, r"[^\p{L}]+", "")), chars),
        "capitals": _ratio(count(r"\p{Lu}"), chars),
        "digits": _ratio(count(r"\p{Nd}"), chars),
        "symbols": _ratio(count(r"[^\p{L}\p{N}\s.,]"), chars),
        "stops": _ratio(count(r"[.,]"), words),
        "symbol_words": _ratio(count(r"(?<!\S)[^\s\p{L}\p{N}]+(?!\S)"), words),
        "word_length": _ratio(chars, words + 1),
        "distinct_words": _ratio(F.size(F.array_distinct("_words")), words),
        "distinct_lines": _ratio(F.size(F.array_distinct("_lines")), lines),
        "stutter": _ratio(count(r"(?<!\S)(\S{1,64})(?=\s+\1(?!\S))"), words),
    }
    return pieces.select(*names, *[stats[n].alias(n) for n in NAMES])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


NAMES = ["chars", "words", "lines", "letters", "capitals", "digits", "symbols", "stops", "symbol_words", "word_length",
         "distinct_words", "distinct_lines", "stutter"]
Condition = tuple[str, bool, float]  # statistic, whether above, bound


@dataclass
class RuleModel:
    """Logistic model over rules; a rule is a conjunction of conditions."""

    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]]

    def score(self) -> Column:
        """Probability of label 1, as one expression over the statistics' columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule, F.col), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def holds(rule: tuple[Condition, ...], stat) -> Column:
    test = F.lit(True)
    for name, above, bound in rule:
        test = test & (stat(name) > bound if above else stat(name) <= bound)
    return test


def tree_rules(debug: str, names: list[str]) -> list[tuple[Condition, ...]]:
    """All root-to-node paths of a forest, read from its printed form, simplified
    to one bound a side and statistic; each rule once."""
    rules: dict[tuple[Condition, ...], None] = {}
    path: list[Condition] = []
    for line in debug.splitlines():
        found = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if re.match(r" *Tree \d+", line):
            path, base = [], None
        elif found:
            indent = len(found[1])
            base = indent if base is None else base
            del path[indent - base:]
            path.append((names[int(found[3])], found[4] == ">", float(found[5])))
            tightest: dict[tuple[str, bool], float] = {}
            for name, above, bound in path:
                old = tightest.get((name, above), bound)
                tightest[name, above] = max(old, bound) if above else min(old, bound)
            rules[tuple(sorted((n, a, b) for (n, a), b in tightest.items()))] = None
    return list(rules)


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int, label_col: str = "quality", id_col: str = "doc_id",
             text_col: str = "text", held_out_mod: int = 5) -> DataFrame:
    """``label`` and the statistics of at most about ``max_rows`` labelled documents
    outside the held-out part; a document with several labels counts as its least."""
    known = narrow(labels, doc_id=id_col, label=label_col).filter("doc_id is not null and label is not null")
    known = known.filter(~held_out(F.col("doc_id"), held_out_mod)).groupBy("doc_id").agg(F.min("label").alias("label"))
    known = materialize(known, "quality-labels")
    share = min(1.0, max_rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # at most about max_rows pairs of id and label: small enough for every task
    rows = texts.join(F.broadcast(chosen), "doc_id")
    return with_statistics(rows.select(F.col("label").cast("double"), "text")).drop("text")


def held_out(doc_id: Column, mod: int, rest: int = 0) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == rest


def fit_rules(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    """Rule model of a bounded table with ``label`` (0 or 1) and the statistics.

    One label only gives a constant model; no row at all gives score 1 (keep).
    """
    rows = materialize(rows, "quality-fit").repartition(4).cache()
    try:
        n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
        if not n or ones in (0, n):
            return RuleModel(100.0 if not n or ones else -100.0, [])
        features = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows)
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="0.5", maxBins=64,
                                        minInstancesPerNode=5, seed=SEED, labelCol="label").fit(features)
        rules = tree_rules(forest.toDebugString, NAMES)
        if not rules:
            share = float(ones / n)
            return RuleModel(_logit(share), [])
        marks = F.array(*[F.when(holds(r, F.col), 1.0).otherwise(0.0) for r in rules])
        design = rows.select("label", array_to_vector(marks).alias("features")).cache()
        try:
            model = LogisticRegression(labelCol="label", regParam=lasso, elasticNetParam=1.0, maxIter=60).fit(design)
        finally:
            design.unpersist()
        weights = model.coefficients.toArray()
        return RuleModel(float(model.intercept), [(r, float(w)) for r, w in zip(rules, weights) if w])
    finally:
        rows.unpersist()


def _logit(p: float) -> float:
    import math

    return math.log(p / (1 - p))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS, **columns: str) -> RuleModel:
    return fit_rules(labelled(docs, labels, max_rows, **columns))


def score_quality(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text.

    Null and empty texts are scored like any other (all statistics 0); repeated
    rows score alike; a null id is never held out unless the empty string's crc32
    says so; an empty table gives an empty result.  Further columns are ignored.
    """
    src = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = with_statistics(src).select("doc_id", model.score().alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: RuleModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model doesn't reject, with all their columns.

    Null and empty texts are judged like any other, their ids play no part; repeated rows
    stay or go together; an empty table gives an empty result."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),  # no name can clash
                      F.col(f"`{text_col}`").cast("string").alias("text"))
    # the score is a generated column: a filter on a projected one is pushed below the projection,
    # where every condition of every rule computes its statistic from the text again
    scored = with_statistics(row).select("row", F.explode(F.array(model.score())).alias("score"))
    return scored.filter(F.col("score") >= threshold).select("row.*")
