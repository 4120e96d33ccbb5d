"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``SIDE`` half keys, each of ``ROWS`` minhashes, are combined to
SIDE * SIDE table keys (every left with every right half), so that
2 * SIDE * ROWS minhashes serve as many tables as SIDE * SIDE * 2 * ROWS would
with separate bands.  Two documents of similarity s share a table with probability
(1 - (1 - s^ROWS)^SIDE)^2, which at s = 0.8 is above 0.999.  Candidates are
verified on full shingle sets, then linked documents form components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.arrow import Batches, map_arrow
from tagweave.llm.common import materialize, narrow, small_enough
from tagweave.llm.links import near_components, with_shared_keys

SIDE, ROWS = 11, 3
WORDS = 2
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
SEED = 20_011

_U = np.uint64
_RNG = np.random.default_rng(SEED)
_BYTE = _RNG.integers(1 << 63, size=256, dtype=_U) * _U(2) + _U(1)
_STEP = _U(int(_RNG.integers(1 << 62)) * 4 + 1)
_STEP_BACK = _U(pow(int(_STEP), -1, 1 << 64))
_MIX = _RNG.integers(1 << 63, size=8, dtype=_U) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at once; words are never cut.
PIECE = 1 << 20
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the step and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        n = 1 << (n - 1).bit_length()
        for i, step in enumerate((_STEP, _STEP_BACK)):
            factors = np.full(n, step, _U)
            factors[0] = 1
            _POWERS[i] = np.cumprod(factors, dtype=_U)
    return _POWERS[0], _POWERS[1]


def _mixed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``mix`` but for its last step, and an array to use again."""
    y = x >> _U(31)
    y ^= x
    y *= _MIX[0]
    z = y >> _U(29)
    y ^= z
    y *= _MIX[1]
    return y, z


def mix(x: np.ndarray) -> np.ndarray:
    y, z = _mixed(x)
    np.right_shift(y, _U(32), out=z)
    y ^= z
    return y


def mix_high(x: np.ndarray) -> np.ndarray:
    """The upper 32 bits of ``mix``: its last step leaves them as they are."""
    return _mixed(x)[0].astype("<u8", copy=False).view("<u4")[1::2]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case."""
    data = text.encode("utf-8", "surrogatepass").lower()
    found, at = [], 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):  # go on to the end of the word
            while end < len(data) and not _SPACE[data[end]]:
                end += 1
        piece = np.frombuffer(data, np.uint8, min(end, len(data)) - at, at)
        inside = ~_SPACE[piece]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
        start, stop = edges[::2], edges[1::2]
        up, down = powers(len(piece) + 1)
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[piece] * up[:len(piece)], dtype=_U)])
        found.append(mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(_U)))
        at = end
    return np.concatenate(found) if found else np.zeros(0, _U)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; of fewer words, the sequence as one."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    n = min(n, len(words))
    total = np.zeros(len(words) - n + 1, _U)
    for i in range(n):
        total = mix(total * _MIX[3] + words[i:len(words) - n + 1 + i])
    return np.unique(total + _U(n))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = overlap(a, b)
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


class MinHash:
    """``count`` minhashes of a set, from 32-bit permutations."""

    def __init__(self, count: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.factors = (rng.integers(1 << 31, size=count, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.masks = rng.integers(1 << 32, size=count, dtype=np.uint32)[:, None]

    def __call__(self, items: np.ndarray, width: int = 2048) -> np.ndarray:
        low = np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        x = (items >> _U(32)).astype(np.uint32)
        for at in range(0, len(x), width):
            low = np.minimum(low, ((x[None, at:at + width] ^ self.masks) * self.factors).min(axis=1))
        return low


def folded(hashes: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for every ``rows`` minhashes."""
    grouped = hashes.reshape(-1, rows).astype(_U)
    key = np.zeros(len(grouped), _U)
    for i in range(rows):
        key = mix(key * _MIX[4] + grouped[:, i] + _U(i + 1))
    return key


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, side: int, rows: int) -> DataFrame:
    """Per document: id, a hash of its text, its set's digest and size, left and right half keys."""
    keys = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.binary()),
                        ("n_shingles", pa.int64()), ("left", keys), ("right", keys)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash, out = MinHash(2 * side * rows), Batches(schema)
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, text_hash, text in zip(ids, hashes, batch.column(2)):
                found = shingles(text.as_py(), n)
                if not len(found):
                    yield from out.add(doc_id, text_hash, None, 0, None, None, size=40)
                    continue
                half = folded(minhash(found), rows).view(np.int64)
                node = xxhash.xxh3_128_digest(found.tobytes())
                yield from out.add(doc_id, text_hash, node, len(found), half[:side], half[side:], size=60 + 16 * side)
        yield from out.flush()

    src = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(
        src.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), run,
        "doc_id long, text_hash long, node binary, n_shingles long, left array<long>, right array<long>")


def table_keys(items: DataFrame, side: int) -> DataFrame:
    """``key, item``: the keys of every left with every right half that other items have as well.

    Items meet in a table only if they share both of its halves.  Halves that one item has alone
    are taken out first: 2 * side rows an item are shuffled for that, not side * side.
    """
    halves = items.select("item", F.posexplode(F.concat("left", "right")).alias("at", "half")).select(
        "item", (F.col("at") < side).alias("on_left"), F.xxhash64("at", "half").alias("key"))
    shared = with_shared_keys(halves).groupBy("item").agg(
        F.collect_list(F.when(F.col("on_left"), F.col("key"))).alias("left"),
        F.collect_list(F.when(~F.col("on_left"), F.col("key"))).alias("right"))  # at most side keys each
    shared = materialize(shared.filter((F.size("left") > 0) & (F.size("right") > 0)), "near-halves")
    tables = F.flatten(F.transform("left", lambda x: F.transform("right", lambda y: F.xxhash64(x, y))))
    return shared.select(F.explode(tables).alias("key"), "item")


def judged_documents(docs: DataFrame, id_col: str, text_col: str, n: int = WORDS, percent: int = PERCENT, side: int = SIDE,
                     rows: int = ROWS) -> DataFrame:
    """``near_duplicates`` with ``best_id, best_hash``: id and text hash of the document that
    stands for the component (least id, null ids last, then least hash); the hash is null
    for documents without shingles."""
    table = materialize(signatures(docs, id_col, text_col, n, side, rows), "near-signatures")
    # equal sets are one item, however many documents hold them
    pair = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    items = table.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("least_id"), F.min(pair).alias("least"),
        F.min(F.struct("doc_id", "text_hash", "left", "right")).alias("first"))
    items = materialize(items.select(F.monotonically_increasing_id().alias("item"), "node", "least_id", "least", "first.*"), "near-items")

    def fetch(wanted: DataFrame) -> DataFrame:
        """Texts of items, from the first document that holds each."""
        where = materialize(items.select("item", "doc_id", "text_hash").join(wanted, "item"), "near-wanted")
        src = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        src = src.withColumn("text_hash", F.xxhash64("text")).alias("d")
        w = (F.broadcast(where) if small_enough(where) else where).alias("w")
        same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash"))
        return src.join(w, same).groupBy("item").agg(F.first("text").alias("text"))

    roots = near_components(table_keys(items, side), fetch,
                            lambda found: [shingles(t, n) for t in found], lambda a, b: similar(a, b, percent), percent)
    named = items.select("item", "node", "least_id", "least").join(roots, "item", "left").withColumn("root", F.coalesce("root", "item"))
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min("least").alias("best"))
    named = named.drop("least").join(names, "root").select("node", "component_id", F.col("best.doc_id").alias("best_id"),
                                                           F.col("best.text_hash").alias("best_hash"))
    named = materialize(named, "near-components")
    out = table.select("doc_id", "text_hash", "node", "n_shingles").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", "best_id", "best_hash")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS,
                    percent: int = PERCENT, side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept, text_hash``.

    Documents are linked if 100 * intersection >= percent * union of their sets
    of n-word shingles; a component's id is its smallest ``doc_id`` and that
    document is kept.  Null, empty and blank texts have an empty set, no link and
    a component of their own.  Rows that repeat an id and text are one document.
    A null id never names a component that has an id; a component of null ids
    only has a null id and is kept.  An empty table gives an empty result.
    Further columns are ignored, whatever their names.
    """
    return judged_documents(docs, id_col, text_col, n, percent, side, rows).drop("best_id", "best_hash")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents with all their columns, one row of each component.

    It is the row with the least id, null ids last, of equal ids the one with the least text
    hash; of rows that repeat id and text the one with the least hash of all columns.  Null, empty and
    blank texts are no duplicates: all their rows stay.  An empty table gives an empty result.
    """
    judged = materialize(judged_documents(docs, id_col, text_col, **settings).filter("best_hash is not null").select(
        "doc_id", "text_hash", (F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("text_hash") == F.col("best_hash"))).alias("best")),
        "near-judged")
    gone = materialize(judged.filter(~F.col("best")).select("doc_id", "text_hash").distinct(), "near-gone")
    twice = judged.filter("best").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    twice = materialize(twice.select("doc_id", "text_hash"), "near-twice")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # no name can clash

    def same(right: str):
        return F.col(f"row.`{id_col}`").cast("long").eqNullSafe(F.col(f"{right}.doc_id")) & (
            F.xxhash64(F.col(f"row.`{text_col}`").cast("string")) == F.col(f"{right}.text_hash"))

    def small(df: DataFrame, name: str) -> DataFrame:
        return (F.broadcast(df) if small_enough(df) else df).alias(name)

    left = row.join(small(gone, "g"), same("g"), "left_anti")
    if not twice.isEmpty():
        repeats = left.join(small(twice, "t"), same("t")).groupBy("t.doc_id", "t.text_hash").agg(
            F.min_by("row", F.xxhash64("row")).alias("row"))
        left = left.join(small(twice, "t"), same("t"), "left_anti").unionByName(repeats.select("row"))
    return left.select("row.*")
