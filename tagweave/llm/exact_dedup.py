"""Exact dedup over counting quotient filters.

Every partition builds a counting quotient filter of its rows' 64-bit
fingerprints.  The filter is cut into blocks by the leading bits; blocks of the
same range meet in one group and merge losslessly, because a filter is nothing
but quotients in order with sorted remainders and counts.  Fingerprints whose
merged count is above one are the only ones that can belong to equal texts:
their rows are routed to a comparison of the whole texts, all others stay.

Layout of a block (``quotient_bits`` q, remainders of 64 - q bits):
``occupied``   one bit per quotient of the block's range, set if any entry has it
``run_ends``   one bit per entry, set on the last entry of each quotient's run
``remainders`` the entries' remainders, little-endian u64, sorted within runs
``counts``     the entries' counts, little-endian u64
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import materialize, narrow, shuffle_tasks, small_enough

#: Largest q: a block's ``occupied`` bits stay small against its entries.
MAX_QUOTIENT_BITS = 40
BLOCK_SCHEMA = "block long, occupied binary, run_ends binary, remainders binary, counts binary"


def normalize(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z in lower case and nothing else changed; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fp_bits: int = 64,
                 with_text: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (64-bit fingerprint as long), ``sha``
    (SHA-256 of the normalised text) and, if asked for, the text itself as ``norm``.

    ``fp_bits`` < 64 keeps only the leading bits, which forces collisions (tests).
    """
    mask = ((1 << 64) - 1) ^ ((1 << (64 - fp_bits)) - 1)
    schema = "doc_id long, fp long, sha binary" + (", norm binary" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = [normalize(t) for t in batch.column(1).to_pylist()]
            shas = [hashlib.sha256(b).digest() for b in norms]
            fps = np.frombuffer(b"".join(s[:8] for s in shas), dtype=">u8").astype(np.uint64) & np.uint64(mask)
            cols = [batch.column(0), pa.array(fps.view(np.int64)), pa.array(shas, pa.binary())]
            if with_text:
                cols.append(pa.array(norms, pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "fp", "sha", "norm"][:len(cols)])

    src = narrow(docs, doc_id=id_col, text=text_col)
    return src.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def encode_block(block: int, values: np.ndarray, counts: np.ndarray, quotient_bits: int, block_bits: int) -> tuple:
    """Filter block of sorted distinct fingerprints that share their leading ``block_bits`` bits."""
    r = np.uint64(64 - quotient_bits)
    local = (values >> r) & np.uint64((1 << (quotient_bits - block_bits)) - 1)
    occupied = np.zeros(1 << (quotient_bits - block_bits), dtype=bool)
    occupied[local.astype(np.int64)] = True
    run_ends = np.append(local[1:] != local[:-1], True)
    remainders = values & np.uint64((1 << (64 - quotient_bits)) - 1)
    return (block, np.packbits(occupied).tobytes(), np.packbits(run_ends).tobytes(),
            remainders.astype("<u8").tobytes(), counts.astype("<u8").tobytes())


def decode_block(row, quotient_bits: int, block_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's sorted fingerprints and their counts, exactly as they were put in."""
    remainders = np.frombuffer(row.remainders, dtype="<u8").astype(np.uint64)
    n, width = len(remainders), quotient_bits - block_bits
    quotients = np.flatnonzero(np.unpackbits(np.frombuffer(row.occupied, dtype=np.uint8), count=1 << width))
    ends = np.unpackbits(np.frombuffer(row.run_ends, dtype=np.uint8), count=n)
    run = np.cumsum(ends) - ends
    high = (np.uint64(row.block) << np.uint64(width)) | quotients[run].astype(np.uint64)
    return (high << np.uint64(64 - quotient_bits)) | remainders, np.frombuffer(row.counts, dtype="<u8").astype(np.int64)


def build_filters(fps: DataFrame, quotient_bits: int, block_bits: int) -> DataFrame:
    """One counting quotient filter per partition, as blocks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f["fp"].to_numpy(np.int64).view(np.uint64) for f in frames if len(f)]
        if not parts:
            return
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        blocks = (values >> np.uint64(64 - block_bits)).astype(np.int64)
        starts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
        rows = [encode_block(int(blocks[s]), values[s:e], counts[s:e], quotient_bits, block_bits)
                for s, e in zip(starts, [*starts[1:], len(values)])]
        yield pd.DataFrame(rows, columns=["block", "occupied", "run_ends", "remainders", "counts"])

    return fps.select("fp").mapInPandas(run, BLOCK_SCHEMA)


def merge_filters(blocks: DataFrame, quotient_bits: int, block_bits: int) -> DataFrame:
    """Lossless merge: the blocks of one range become one block with added counts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [decode_block(row, quotient_bits, block_bits) for row in pdf.itertuples(index=False)]
        values = np.concatenate([p[0] for p in parts])
        order = np.argsort(values, kind="stable")
        values, counts = values[order], np.concatenate([p[1] for p in parts])[order]
        starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        row = encode_block(int(pdf["block"].iloc[0]), values[starts], np.add.reduceat(counts, starts),
                           quotient_bits, block_bits)
        return pd.DataFrame([row], columns=list(pdf.columns))

    return blocks.groupBy("block").applyInPandas(run, BLOCK_SCHEMA)


def repeated(blocks: DataFrame, quotient_bits: int, block_bits: int) -> DataFrame:
    """The fingerprints with a count above one: ``fp``, ``copies``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                values, counts = decode_block(row, quotient_bits, block_bits)
                more = counts > 1
                yield pd.DataFrame({"fp": values[more].view(np.int64), "copies": counts[more]})

    return blocks.mapInPandas(run, "fp long, copies long")


def filter_shape(rows: int, partitions: int, tasks: int) -> tuple[int, int]:
    """(quotient bits, block bits): about one quotient per row of a partition,
    and about four blocks per merging task."""
    block_bits = max(1, math.ceil(math.log2(4 * tasks)))
    quotient_bits = max(block_bits, math.ceil(math.log2(max(2, rows / max(1, partitions)))))
    return min(MAX_QUOTIENT_BITS, quotient_bits), min(MAX_QUOTIENT_BITS, block_bits)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fp_bits: int = 64) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if identical after lower-casing A-Z.  Of equal texts the
    largest ``doc_id`` stays.  Null and empty texts are equal to each other; a
    null id never stays while another row of its group has an id, and a group of
    null ids only has a null ``keep_id`` with all rows kept.  Rows that repeat
    an id and text are one document: each is marked kept.  An empty table gives
    an empty result.  Further columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = materialize(fingerprints(docs, id_col, text_col, fp_bits), "op10-fingerprints")
    q, b = filter_shape(rows.count(), rows.rdd.getNumPartitions(), shuffle_tasks(spark))
    twice = materialize(repeated(merge_filters(build_filters(rows, q, b), q, b), q, b).select("fp"), "op10-repeated")
    # byte verification of the routed rows: equal texts meet as grouping keys,
    # pre-aggregated before the shuffle, so a large group is one row per task
    routed = fingerprints(docs, id_col, text_col, fp_bits, with_text=True).join(
        F.broadcast(twice) if small_enough(twice) else twice, "fp", "left_semi")
    groups = routed.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups.select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"), "op10-groups")
    out = rows.join(groups, "sha", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
