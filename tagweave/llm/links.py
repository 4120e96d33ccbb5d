"""From band keys to components: candidate buckets, exact verification, union-find.

Items have an ``item`` id (long) and band keys; items that share a key are a
bucket.  Buckets are resolved in two steps, and no step emits all pairs of one:

1. Star: every item is compared with the least item of its bucket.  Copies of
   one text are one item already, and a large group of near copies mostly hangs
   together after this.
2. Rest: the least item is done with.  In buckets whose other items still are of several
   components, each of those outside the largest component is compared with all of
   them, in blocks; a bucket of two items has nothing left.  Buckets of one least item
   overlap mostly, so they are one unit, in which an item stands once, however many of
   them it is in; only items that share a bucket are compared.

A comparison unit is a block of at most about ``BLOCK`` (``REST_BLOCK``) items and
the items that ask about them; units are sorted streams, so a task holds the
asking side of one unit at a time.  Comparisons inside a component are skipped, and a unit
emits links of a spanning forest only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.arrow import map_arrow
from tagweave.llm.common import materialize, shuffle_tasks, small_enough

#: Items of a comparison unit, around a star and in what is left.
BLOCK, REST_BLOCK = 64, 512
#: Words of the bitmap by which a pair is ruled out before its sets are compared.
BITMAP_WORDS = 64
#: Asking items up to which every pair is tested at once.
FEW = 6
#: Characters whose sets are made at once.
BLOCK_CHARS = 1 << 16
#: Roles in a unit: is only compared with those that ask, only asks, or both.
ABOUT, ASKS, BOTH = 0, 1, 2


def with_shared_keys(keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` several items have, with the key's ``least`` item (input: ``key, item`` and more)."""
    shared = keys.groupBy("key").agg(F.min("item").alias("least"), F.max("item").alias("greatest"))
    shared = materialize(shared.filter("least < greatest").select("key", "least"), "shared-keys")
    return keys.join(F.broadcast(shared) if small_enough(shared) else shared, "key")


def buckets(keys: DataFrame) -> DataFrame:
    """``key, item, least`` of the keys that several items share (input: ``key, item``)."""
    return materialize(with_shared_keys(keys).distinct(), "buckets")


def star_units(members: DataFrame) -> DataFrame:
    """Units that ask each bucket's least item about the others."""
    pairs = materialize(members.filter("item <> least").select("least", "item").distinct(), "star-pairs")
    blocks = pairs.groupBy("least").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    about = pairs.join(blocks, "least").select(
        _unit("least", _slot("item", "blocks")).alias("unit"), "item", F.lit(ABOUT).alias("role"), F.col("item").alias("root"))
    asks = blocks.select("least", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("slot")).select(
        _unit("least", F.col("slot")).alias("unit"), F.col("least").alias("item"), F.lit(ASKS).alias("role"),
        F.col("least").alias("root"))
    return about.unionByName(asks).withColumn("keys", F.lit(None).cast("array<long>"))


def _slot(item: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(item, F.lit("slot")), F.col(blocks))


def _unit(*cols) -> Column:
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols])


def rest_units(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Units for buckets with several components: all outside the largest ask all.

    The star has compared every item with its bucket's least item, which is left out here.
    """
    m = members.filter("item <> least").join(roots, "item", "left").withColumn("root", F.coalesce("root", "item"))
    open_keys = m.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("size"),
                                     F.sum(F.xxhash64("item").cast("decimal(38,0)")).alias("content"))
    # many keys hold the same items: one of them is enough
    open_keys = open_keys.filter("a <> b").groupBy("size", "content").agg(F.min("key").alias("key"))
    m = materialize(m.join(open_keys.select("key"), "key").select("key", "least", "item", "root"), "open-buckets")
    major = m.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
        F.max(F.struct("n", "root")).alias("m")).select("key", F.col("m.root").alias("major"))
    m = m.join(major, "key").groupBy("least", "item", "root").agg(
        F.collect_set("key").alias("keys"), F.max(F.col("root") != F.col("major")).alias("asks"))  # the keys of one item
    m = materialize(m, "open-items")
    sizes = m.groupBy("least").agg(F.ceil(F.count(F.lit(1)) / REST_BLOCK).alias("blocks"),
                                   F.ceil(F.count_if("asks") / REST_BLOCK).alias("chunks"))
    m = m.join(sizes, "least")
    # buckets of one block are one unit, in which every item stands once
    single = m.filter("blocks = 1").select(
        _unit("least").alias("unit"), "item", F.when(F.col("asks"), BOTH).otherwise(ABOUT).alias("role"), "root", "keys")
    m = m.filter("blocks > 1")
    about = m.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        _unit("least", _slot("item", "blocks"), "chunk").alias("unit"), "item", F.lit(ABOUT).alias("role"), "root", "keys")
    asks = m.filter("asks").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        _unit("least", "slot", _slot("item", "chunks")).alias("unit"), "item", F.lit(ASKS).alias("role"), "root", "keys")
    return single.unionByName(about).unionByName(asks)


class Asking:
    """The items of a unit that ask, and which of them another item is to be compared with.

    Of more than ``FEW``, those are left out whose bitmaps already differ in more places than sets of
    Jaccard similarity ``percent`` can differ in elements: a place that differs stands for an
    element that only one of the sets has.
    """

    def __init__(self, percent: int):
        self.percent, self.items, self.roots, self.sets, self.by_key = percent, [], [], [], {}
        self.mapped, self.bits, self.sizes = 0, np.empty((8, BITMAP_WORDS), np.uint64), np.empty(8, np.int64)

    def add(self, item: int, root: int, own: np.ndarray, keys: list[int] | None) -> None:
        for key in keys or ():
            self.by_key.setdefault(key, []).append(len(self.items))
        self.items.append(item)
        self.roots.append(root)
        self.sets.append(own.copy())  # not a view of a block of sets

    def candidates(self, root: int, own: np.ndarray, keys: list[int] | None, find: Callable) -> list[int]:
        """Those that share a key, unless ``keys`` is null, and are not of the root's component."""
        some = range(len(self.items)) if keys is None else {k for key in keys for k in self.by_key.get(key, ())}
        root = find(root)
        some = [k for k in sorted(some) if find(self.roots[k]) != root]
        if len(some) <= FEW:
            return some
        self._map()
        at = np.array(some)
        differ = np.bitwise_count(self.bits[at] ^ bitmap(own)).sum(axis=1).astype(np.int64)
        # |A xor B| <= (|A| + |B|) * (100 - p) / (100 + p) for similarity p percent
        near = (100 + self.percent) * differ <= (100 - self.percent) * (self.sizes[at] + len(own))
        return at[near].tolist()

    def _map(self) -> None:
        """Bitmaps of the items added since."""
        if len(self.sets) > len(self.sizes):
            more = 2 * len(self.sets)
            self.bits, self.sizes = np.resize(self.bits, (more, BITMAP_WORDS)), np.resize(self.sizes, more)
        for k in range(self.mapped, len(self.sets)):
            self.bits[k], self.sizes[k] = bitmap(self.sets[k]), len(self.sets[k])
        self.mapped = len(self.sets)


def verify(units: DataFrame, payload: DataFrame, to_sets: Callable, similar: Callable, percent: int) -> DataFrame:
    """Links ``a, b`` between the similar items of a unit, enough to connect them.

    ``payload`` has ``item, text``; ``to_sets`` makes sorted hash sets of a list of texts,
    ``similar`` tests two sets.  Items with ``keys`` are compared if they share one.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, asking, parent = None, Asking(percent), {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for batch in batches:
            units, items, roles, roots, keys = (batch.column(i).to_pylist() for i in range(5))
            links: list[tuple[int, int]] = []
            for i, own in enumerate(_in_blocks(batch.column(5), to_sets)):
                if units[i] != unit:
                    unit, asking, parent = units[i], Asking(percent), {}
                if roles[i] != ASKS and asking.items:
                    for k in asking.candidates(roots[i], own, keys[i], find):
                        a, b = find(asking.roots[k]), find(roots[i])
                        if a != b and similar(own, asking.sets[k]):
                            parent[max(a, b)] = min(a, b)
                            links.append((asking.items[k], items[i]))
                if roles[i] != ABOUT:  # those that ask come first
                    asking.add(items[i], roots[i], own, keys[i])
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], schema=schema)

    tasks = shuffle_tasks(units.sparkSession)
    rows = units.join(payload, "item").select("unit", "item", "role", "root", "keys", "text")
    rows = rows.repartition(tasks, "unit").sortWithinPartitions("unit", F.desc("role"))
    return map_arrow(rows, run, "a long, b long")


def _in_blocks(column: pa.Array, to_sets: Callable) -> Iterator[np.ndarray]:
    """The sets of a column of texts, made for about ``BLOCK_CHARS`` characters at a time."""
    block, size = [], 0
    for text in column:
        text = text.as_py() or ""
        block.append(text)
        size += len(text)
        if size >= BLOCK_CHARS:
            yield from to_sets(block)
            block, size = [], 0
    yield from to_sets(block)


def bitmap(items: np.ndarray) -> np.ndarray:
    """The elements of a sorted hash set as bits of ``BITMAP_WORDS`` words, by their leading bits."""
    bits = np.zeros(64 * BITMAP_WORDS, np.uint8)
    bits[(items >> np.uint64(64 - (64 * BITMAP_WORDS - 1).bit_length())).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def components(links: DataFrame) -> DataFrame:
    """``item, root`` of every linked item; ``root`` is one item of its component.

    Distributed union-find by contraction: each round hooks every item to the
    least of itself and its neighbours, replaces the links' ends by those, and drops
    what became one.  Item ids carry no order of similarity, so a round shrinks
    chains and stars alike by a constant factor.  A hub is a key of joins that
    adaptive execution splits, and of sums that are combined before they are shuffled.
    """
    spark = links.sparkSession
    rest = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                       "links")
    rounds: list[DataFrame] = []
    while not rest.isEmpty():
        ends = rest.select(F.col("a").alias("item"), F.col("b").alias("near")).unionByName(
            rest.select(F.col("b").alias("item"), F.col("a").alias("near")))
        hook = ends.groupBy("item").agg(F.min("near").alias("near")).select("item", F.least("item", "near").alias("root"))
        hook = materialize(hook, "hooks")
        rounds.append(hook)
        rest = rest.join(hook.select(F.col("item").alias("a"), F.col("root").alias("ra")), "a")
        rest = rest.join(hook.select(F.col("item").alias("b"), F.col("root").alias("rb")), "b").filter("ra <> rb")
        rest = materialize(rest.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "links")
    if not rounds:
        return spark.range(0).select(F.col("id").alias("item"), F.col("id").alias("root"))
    labels = rounds[0]
    for hook in rounds[1:]:
        step = hook.select(F.col("item").alias("root"), F.col("root").alias("next"))
        labels = labels.join(step, "root", "left").select("item", F.coalesce("next", "root").alias("root"))
    return materialize(labels, "components")


def near_components(keys: DataFrame, fetch: Callable[[DataFrame], DataFrame], to_sets: Callable, similar: Callable,
                    percent: int) -> DataFrame:
    """``item, root`` of all items with a verified link (input: ``key, item``).

    ``fetch`` gives ``item, text`` for a frame of ``item``.
    """
    members = buckets(keys)
    star = materialize(star_units(members), "star-units")
    payload = materialize(fetch(members.select("item").distinct()), "payload")
    links = materialize(verify(star, payload, to_sets, similar, percent), "star-links")
    roots = components(links)
    rest = materialize(rest_units(members, roots), "rest-units")
    if rest.isEmpty():
        return roots
    more = materialize(verify(rest, payload, to_sets, similar, percent), "rest-links")
    if more.isEmpty():
        return roots
    return components(links.unionByName(more))
