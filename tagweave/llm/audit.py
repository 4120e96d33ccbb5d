"""Interaction audit of document filters in every order, by wide packed counters.

A document's fate under all orders follows from its mask, the set of filters that it
fails.  Each of the 2**k masks has one big integer: a field of 64 bits for every
(order, step, outcome), holding 1 where the outcome befalls such a document.  The sum
of the integers of a part's documents is the whole audit of the part: 120 orders x 5
steps = 600 steps of four outcomes for five filters.  A field counts documents, so 64
bits can't overflow into the next one.  Documents removed that are labelled good or
toxic are the same sums over those documents only.

Equal (part, mask, labels) are counted before the shuffle, so a part comes to its task
as at most 4 * 2**k rows of masks and counts, however many documents it has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import materialize, narrow

#: Filters of ``failed_filters``, bit 0 first.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT = 50, 65, 5
MARKS = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes of UTF-8 that don't start a code point.
CONTINUATION = bytes(range(0x80, 0xC0))

FIELD_BITS = 64
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")
AUDIT_SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
                "good_lost long, toxic_lost long, shapley long")


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that the UTF-8 text fails."""
    words = text.split()  # of bytes: at 0x20 and 0x09 to 0x0D only
    points = len(text.translate(None, CONTINUATION))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return ((len(words) < MIN_WORDS)
            | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
            | (100 * capitals > MAX_CAPITALS_PERCENT * points) << 2
            | (len(text.translate(None, MARKS)) < len(text)) << 3)


def failed_filters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per document: ``doc_id, part, mask``.

    Words are maximal runs without 0x20 and 0x09-0x0D, case-sensitive.  A fails with
    under 50 words, B if 100 * distinct words < 65 * words, C if 100 * [A-Z] > 5 * code
    points, D if any of ``#$%&*|`` occurs, E if a smaller id anywhere in the table has the
    same text (SHA-256 of the whole text).  Null texts count as empty and equal to empty
    ones, a null part is the empty string.  Rows that repeat an id and text don't fail E
    by each other; a null id is never smaller nor larger, so such a row fails E never
    and makes no other row fail it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, shas = [], []
            for value in batch.column(2):
                text = value.as_py() or b""
                masks.append(text_mask(text))
                shas.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(shas, pa.binary())],
                names=["doc_id", "part", "mask", "sha"])

    src = narrow(docs, doc_id=id_col, part=part_col, text=text_col).select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"),
        F.col("text").cast("string").cast("binary"))
    rows = materialize(src.mapInArrow(run, "doc_id long, part string, mask int, sha binary"), "op11-masks")
    # the first of each text, joined on (text, id): copies of one text meet it under different keys
    firsts = rows.groupBy("sha").agg(F.min("doc_id").alias("first")).filter("first is not null")
    r, f = rows.alias("r"), firsts.alias("f")
    seen = r.join(f, (F.col("r.sha") == F.col("f.sha")) & (F.col("r.doc_id") == F.col("f.first")), "left")
    copy = F.col("f.first").isNull() & F.col("r.doc_id").isNotNull()
    return seen.select("r.doc_id", "r.part", (F.col("r.mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


@lru_cache(maxsize=None)
def packed_outcomes(mask: int, names: str = FILTERS) -> int:
    """The big integer of a mask: field (order, step, outcome) is 1 if the outcome befalls it."""
    fields = []
    for order in permutations(range(len(names))):
        before = 0
        for f in order:
            bit, gone = 1 << f, bool(mask & before)
            fails = bool(mask & bit)
            fields += [not gone and not fails, fails and not gone, fails and gone, mask == bit]
            before |= bit
    return int.from_bytes(np.asarray(fields, dtype="<u8").tobytes(), "little")


def unpack(total: int, names: str = FILTERS) -> np.ndarray:
    """Fields of a sum as (step of every order, outcome)."""
    steps = len(list(permutations(names))) * len(names)
    raw = total.to_bytes(steps * len(OUTCOMES) * FIELD_BITS // 8, "little")
    return np.frombuffer(raw, dtype="<u8").astype(np.int64).reshape(steps, len(OUTCOMES))


def audit_orders(rows: DataFrame, names: str = FILTERS) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley`` for every part, order and step.

    ``rows`` has ``part, mask, good, toxic``, one per document.  Parts without a document
    don't occur, steps without an effect do, with zeros.
    """
    orders = ["".join(o) for o in permutations(names)]
    step_filters = np.array([names.index(c) for o in orders for c in o])
    labels = pd.DataFrame({"filter_order": np.repeat(orders, len(names)),
                           "step": np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(orders))})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total = good = toxic = 0
        for r in pdf.itertuples(index=False):
            wide = r.n * packed_outcomes(r.mask, names)
            total += wide
            good += wide if r.good else 0
            toxic += wide if r.toxic else 0
        counts = unpack(total, names)
        out = labels.assign(part=pdf["part"].iloc[0], **{name: counts[:, i] for i, name in enumerate(OUTCOMES)})
        out["good_lost"], out["toxic_lost"] = unpack(good, names)[:, 1], unpack(toxic, names)[:, 1]
        shapley = np.zeros(len(names), dtype=np.int64)
        np.add.at(shapley, step_filters, counts[:, 1])
        out["shapley"] = shapley[step_filters]
        return out[["part", *labels.columns, *OUTCOMES, "good_lost", "toxic_lost", "shapley"]]

    counted = rows.groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("part").applyInPandas(run, AUDIT_SCHEMA)


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "source") -> DataFrame:
    """``audit_orders`` of the five filters, with labels of ``labels`` (``doc_id, quality, toxic``).

    A document without a label row, or with null labels or a null id, counts as neither
    good nor toxic; of repeated label rows one saying 1 is enough.  An empty table of
    documents gives an empty result.  Further columns are ignored, whatever their names.
    """
    failed = failed_filters(docs, id_col, text_col, part_col).alias("d")
    marks = narrow(labels, doc_id="doc_id", quality="quality", toxic="toxic").groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).alias("m")
    both = failed.join(marks, F.col("d.doc_id") == F.col("m.doc_id"), "left")
    return audit_orders(both.select("d.part", "d.mask", F.coalesce("m.good", F.lit(False)).alias("good"),
                                    F.coalesce("m.toxic", F.lit(False)).alias("toxic")))
