"""Fuzzy line dedup by MinHash over character shingles.

Lines of at least ``min_chars`` characters (lower case, blanks collapsed) are
compared by their sets of ``SHINGLE``-character shingles; the query and the pipeline
compare every line that has a shingle.  ``BANDS`` bands of
``ROWS`` minhashes give candidates: lines of similarity 0.8 share a band with
probability 1 - (1 - 0.8^4)^12 = 0.998.  Candidates are verified by exact
Jaccard similarity on whole lines, links form components by distributed
union-find, and of every component the first line (least doc_id, then line
number) stays.  Equal lines are one item from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.arrow import map_arrow, texts
from tagweave.llm.common import materialize, narrow, small_enough
from tagweave.llm.links import near_components
from tagweave.llm.near_dedup import MinHash, folded, mix, mix_high, powers, similar
from tagweave.session import sized_broadcast

MIN_CHARS, SHINGLE = 24, 8
BANDS, ROWS = 12, 4
PERCENT = 80
#: Characters whose signatures are computed at once; equal lines of a task that get one signature.
BLOCK_CHARS, SEEN_LINES = 1 << 17, 200_000
_U = np.uint64
_FIRST = np.ones(1, bool)
#: Hashes of the first code points.
_CODES = mix(np.arange(1, 0x251, dtype=_U))
_LOWER = bytes(ord(chr(c).lower()) for c in range(256))
_ODD_BLANKS = bytes(c for c in range(256) if chr(c).isspace() and chr(c) not in " \n")


def normalized(line: str) -> str:
    return " ".join(line.lower().split())


def lowered(text: str) -> str | None:
    """The text in lower case if that is all that ``normalized`` would change in its lines, else None.

    It is so for code points below U+0100 without blanks to collapse."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    if (len(data.translate(None, _ODD_BLANKS)) < len(data) or b"  " in data or b" \n" in data or b"\n " in data
            or data.startswith(b" ") or data.endswith(b" ")):
        return None
    return data.translate(_LOWER).decode("latin-1")


def _windows(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, yet to be mixed, of every window of a shingle's length over all lines in a row; which
    windows lie inside a line; where each line's begin among those.

    A line shorter than a shingle must not be given.
    """
    text = "".join(lines)
    try:
        codes = np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(s) for s in lines])
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, _U)
    hashes = _CODES[codes] if codes.max(initial=0) < len(_CODES) else mix(codes.astype(_U) + _U(1))
    hashes *= up[:len(codes)]
    np.cumsum(hashes, out=sums[1:])
    windows = sums[SHINGLE:] - sums[:-SHINGLE]
    windows *= down[:len(windows)]
    inside = np.ones(len(codes), bool)
    ends = np.cumsum(size)
    for j in range(1, SHINGLE):  # windows that would reach into the next line
        inside[ends - j] = False
    counts = size - SHINGLE + 1
    return windows, inside[:len(windows)], np.concatenate([[0], np.cumsum(counts)[:-1]])


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of all lines in a row, and where each line's begin.

    A line shorter than a shingle must not be given.
    """
    windows, inside, starts = _windows(lines)
    return mix(windows[inside]), starts


def line_sets(lines: list[str]) -> list[np.ndarray]:
    """Sorted hashes of each line's distinct shingles; a line shorter than one is a single shingle."""
    if not lines:
        return []
    found, starts = shingle_hashes([normalized(s).ljust(SHINGLE) for s in lines])
    sets = []
    starts = [*starts.tolist(), len(found)]
    for start, end in zip(starts, starts[1:]):
        one = found[start:end]
        one.sort()
        new = one[1:] != one[:-1]
        sets.append(one if new.all() else one[np.concatenate([_FIRST, new])])
    return sets


def band_keys(lines: list[str], minhash: MinHash) -> np.ndarray:
    """Lines by bands: 64-bit keys."""
    windows, inside, starts = _windows(lines)
    x = mix_high(windows)[inside]  # of the hashes, minhashes take the upper half only
    low, y = np.empty((BANDS * ROWS, len(lines)), np.uint32), np.empty_like(x)
    for k, (mask, factor) in enumerate(zip(minhash.masks[:, 0], minhash.factors[:, 0])):
        np.bitwise_xor(x, mask, out=y)
        np.multiply(y, factor, out=y)
        np.minimum.reduceat(y, starts, out=low[k])
    keys = folded(low.T, ROWS).reshape(len(lines), BANDS)
    return mix(keys + np.arange(1, BANDS + 1, dtype=_U))


def line_table(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row per line that counts: its document (id and a hash of the text), number,
    128-bit identity ``item, more``, and its band keys (8 bytes each in a row) once per item and task (about)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("line", pa.int32()), ("item", pa.int64()),
                        ("more", pa.int64()), ("keys", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash, seen, rows, new, chars = MinHash(BANDS * ROWS), set(), [], [], 0

        def flush() -> pa.RecordBatch:
            *cols, digests, has = zip(*rows)
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            keys = iter(band_keys(new, minhash).view(f"V{8 * BANDS}")[:, 0].tolist() if new else ())
            cols = [*cols, halves[:, 0], halves[:, 1], [next(keys) if x else None for x in has]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, text_hash, text in zip(ids, hashes, texts(batch.column(2))):
                low = lowered(text)
                for number, line in enumerate((text if low is None else low).split("\n")):
                    if len(line) < min_chars:
                        continue
                    if low is None:
                        line = normalized(line)
                        if len(line) < min_chars:
                            continue
                    digest = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
                    fresh = digest not in seen
                    if fresh:
                        if len(seen) >= SEEN_LINES:
                            seen.clear()
                        seen.add(digest)
                        new.append(line)
                        chars += len(line)
                    rows.append((doc_id, text_hash, number, digest, fresh))
                    if chars >= BLOCK_CHARS or len(rows) >= 20_000:
                        yield flush()
                        rows, new, chars = [], [], 0
        if rows:
            yield flush()

    src = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(
        src.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), run,
        "doc_id long, text_hash long, line int, item long, more long, keys binary")


def line_items(table: DataFrame) -> DataFrame:
    """One row per ``item``: its first line, its lines' number, and the least and greatest of
    their other 64 bits, which differ if the item stands for several lines."""
    return materialize(table.groupBy("item").agg(
        F.min(F.struct("doc_id", "line", "text_hash")).alias("first"), F.count(F.lit(1)).alias("n"),
        F.min("more").alias("more"), F.max("more").alias("more_too")), "line-items")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                   percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_hash, lines``: the numbers (from 0) of the lines to remove, for documents that have any."""
    table = materialize(line_table(docs, id_col, text_col, min_chars), "lines")
    firsts = line_items(table)
    clash = firsts.filter("more <> more_too").select("item")
    if not clash.isEmpty():  # different lines under one 64-bit number: it takes the other half in as well
        clash = materialize(clash, "line-clashes").withColumn("clash", F.lit(True))
        table = table.join(sized_broadcast(clash), "item", "left").withColumn(
            "item", F.when(F.col("clash"), F.xxhash64("item", "more")).otherwise(F.col("item"))).drop("clash")
        table = materialize(table, "lines")
        firsts = line_items(table)

    def fetch(wanted: DataFrame) -> DataFrame:
        """Lines of items, each from its first document."""
        where = firsts.join(wanted, "item").select("first.doc_id", "first.text_hash", F.struct("first.line", "item").alias("at"))
        where = materialize(where.groupBy("doc_id", "text_hash").agg(F.collect_list("at").alias("at")), "wanted-lines")
        lines = _with_lines(docs, where, id_col, text_col).select("lines", F.explode("at").alias("at"))
        return lines.select("at.item", F.get("lines", F.col("at.line")).alias("text"))

    each = F.array(*[F.xxhash64(F.substring("keys", 8 * band + 1, 8)) for band in range(BANDS)])
    keys = table.filter("keys is not null").select(F.explode(each).alias("key"), "item")
    roots = near_components(keys, fetch, line_sets, lambda a, b: similar(a, b, percent), percent)
    linked = firsts.join(roots, "item").select("item", "first", "root")
    linked = linked.join(linked.groupBy("root").agg(F.min("first").alias("least")), "root").select("item", "least")
    kept = firsts.join(linked, "item", "left").filter("n > 1 or least is not null").select(
        "item", F.coalesce("least", "first").alias("kept"))
    kept = materialize(kept.select("item", "kept.*").withColumnsRenamed(
        {"doc_id": "kept_id", "line": "kept_line", "text_hash": "kept_hash"}), "kept-lines")
    again = table.select("doc_id", "text_hash", "line", "item").join(
        F.broadcast(kept) if small_enough(kept, 250_000) else kept, "item")
    again = again.filter(~(F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash"))
                           & (F.col("line") == F.col("kept_line"))))
    return materialize(again.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("lines")), "removed-lines")


def _with_lines(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, how: str = "inner") -> DataFrame:
    """The documents' lines beside the row of ``found`` with their id and text hash."""
    src = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _beside(src, found, how).withColumn("lines", F.split("text", "\n")).drop("text")


def _beside(src: DataFrame, found: DataFrame, how: str) -> DataFrame:
    names = [c for c in found.columns if c not in ("doc_id", "text_hash")]
    found = (F.broadcast(found) if small_enough(found, 250_000) else found).alias("f")
    src = src.withColumn("text_hash", F.xxhash64("text")).alias("s")
    same = F.col("s.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("s.text_hash") == F.col("f.text_hash"))
    return src.join(found, same, how).select("s.doc_id", "s.text", *[F.col(f"f.{c}").alias(c) for c in names])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_kept, text`` with the repeated lines taken out.

    Lines end at U+000A.  Shorter lines than ``min_chars`` always stay.  Null texts
    are empty and have no line; a text whose lines all repeat becomes empty.
    Within a document the first of its equal lines stays.  Null ids come first in
    the order; rows that repeat an id and text are one document and keep the same lines.
    An empty table gives an empty result.  Further columns are ignored, whatever
    their names.
    """
    removed = repeated_lines(docs, id_col, text_col, min_chars, percent).withColumnRenamed("lines", "removed")
    src = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = _beside(src, removed, "left")
    text = F.coalesce("text", F.lit(""))
    n_lines = F.when(F.octet_length(text) > 0, F.size(F.split(text, "\n"))).otherwise(0)
    n_removed = F.coalesce(F.size("removed"), F.lit(0))
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("removed", i))
    return rows.select("doc_id", n_lines.cast("long").alias("n_lines"), (n_lines - n_removed).cast("long").alias("n_kept"),
                       F.when(n_removed > 0, F.array_join(left, "\n")).otherwise(text).alias("text"))


def line_digests(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, n_lines, n_kept, text_sha256`` (of the text that is left, in UTF-8)."""
    return dedup_lines(docs, min_chars=min_chars).select("doc_id", "n_lines", "n_kept", F.sha2("text", 256).alias("text_sha256"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        length_col: str | None = "n_chars", min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with all their columns and without repeated lines.

    Documents of which no line is left go; documents that were empty or null before stay.
    Null and repeated ids are as in ``dedup_lines``; an empty table gives an empty result.
    ``length_col``, if the input has it, becomes the new text's length.
    """
    removed = repeated_lines(docs, id_col, text_col, min_chars).withColumnRenamed("lines", "removed")
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))  # no name can clash
    row = row.select("row", F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), F.col(f"row.`{text_col}`").cast("string").alias("text"))
    found = (F.broadcast(removed) if small_enough(removed, 250_000) else removed).alias("f")
    row = row.withColumn("text_hash", F.xxhash64("text")).alias("s")
    same = F.col("s.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("s.text_hash") == F.col("f.text_hash"))
    left = F.filter(F.split("s.text", "\n"), lambda x, i: ~F.array_contains("f.removed", i))
    rows = row.join(found, same, "left").select(
        "row", F.col("f.removed").isNotNull().alias("changed"),
        F.when(F.col("f.removed").isNull(), F.col("s.text")).otherwise(F.array_join(left, "\n")).alias("left"))
    rows = rows.filter(~F.col("changed") | (F.octet_length("left") > 0))

    def column(c: str):
        if c == text_col:
            return F.col("left").alias(c)
        if c == length_col:
            kind = docs.schema[c].dataType
            return F.when(F.col("changed"), F.length("left")).otherwise(F.col(f"row.`{c}`")).cast(kind).alias(c)
        return F.col(f"row.`{c}`").alias(c)

    return rows.select(*[column(c) for c in names])
