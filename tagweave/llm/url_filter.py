"""URL rules through a Bloom filter cascade, with DataFrame functions only.

The key universe is every key that a rule could have among the given URLs: host
suffixes by number of labels and path prefixes by length, for the (labels, path
length) shapes that the rules have.  Level 0 of a cascade is a Bloom filter of
the listed keys; level 1 holds the keys of the universe that pass level 0 though
they aren't listed; level 2 the listed keys that pass level 1; and so on until no
key is left over.  For every key of the universe, membership is then exact, and
a URL is judged by looking up a few bits instead of joining the list.

Level 0 has a false-positive rate of about sqrt(1/2) * listed / others, later
levels 1/2, so that the cascade's size follows the list (about
1.44 * log2(others / listed) bits a listed key) and not the URLs.  A list whose
level 0 is too large for one task is cut by a hash of the key into several cascades
over their parts of the universe.

The shapes are rows, not expressions: a URL has one candidate row per shape that
fits, and a candidate's membership is one expression of a few bits per level.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import materialize, narrow

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"
#: Every task holds all levels of a cascade; longer lists are cut into several of them.
MAX_LEVEL_BITS = 1 << 27


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(_part(url, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return _part(url, 2)


def _part(url: Column, group: int) -> Column:
    start = F.locate("://", url)
    rest = F.substring(url, start + 3, F.greatest(F.length(url), F.lit(1)))
    return F.when(start > 0, F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", group)).otherwise(F.lit(""))


def labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def candidates(split: DataFrame, shapes: list[tuple[int, int]], *keep: str) -> DataFrame:
    """``keep`` columns and ``key, n_labels`` for every shape (labels, path length) that a URL fits."""
    by_labels: dict[int, list[int]] = {}
    for n, m in shapes:
        by_labels.setdefault(n, []).append(m)
    table = F.expr("array(" + ", ".join(f"named_struct('n', {n}, 'm', array({', '.join(map(str, ms))}))"
                                        for n, ms in sorted(by_labels.items())) + ")")
    rows = split.select(*keep, "host", "path", F.inline(table)).filter(labels(F.col("host")) >= F.col("n"))
    rows = rows.select(*keep, "path", "n", F.expr("substring_index(host, '.', -n)").alias("suffix"), F.explode("m").alias("m"))
    rows = rows.filter(F.length("path") >= F.col("m"))
    return rows.select(*keep, F.concat("suffix", F.expr("substring(path, 1, m)")).alias("key"), F.col("n").alias("n_labels"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """``key, verdict`` rows of a list of (verdict, ``host/path``) pairs."""
    rows = [F.struct(F.lit(key).alias("key"), F.lit(verdict).alias("verdict")) for verdict, key in rules]
    return spark.range(1).select(F.inline(F.array(*rows))) if rows else spark.range(0).select(
        F.lit("").alias("key"), F.lit("").alias("verdict"))


def _bit(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(bits))


class Level:
    """One Bloom filter: its words are one row of the shared scratch folder."""

    def __init__(self, keys: DataFrame, count: int, rate: float, level: int):
        self.level, self.hashes = level, max(1, round(math.log2(1 / rate)))
        self.bits = max(64, math.ceil(1.44 * count * math.log2(1 / rate) / 64) * 64)
        bit = F.explode(F.array(*[_bit(F.col("key"), level, i, self.bits) for i in range(self.hashes)]))
        set_words = keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("id")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("word"))
        every = keys.sparkSession.range(self.bits // 64).join(set_words, "id", "left")
        pairs = F.array_sort(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0)).alias("word"))))
        self.words = materialize(every.agg(pairs.alias("p")).select(F.col("p.word").alias("words")), "url-level")

    def may_hold(self, key: Column) -> Column:
        words, test = self.words.scalar(), F.lit(True)
        for i in range(self.hashes):
            bit = _bit(key, self.level, i, self.bits)
            word = F.get(words, F.shiftright(bit, 6).cast("int"))
            test = test & (F.getbit(word, (bit % 64).cast("int")) == 1)
        return test


def first_rate(listed: int, universe: int) -> float:
    return min(0.5, math.sqrt(0.5) * listed / max(1, universe))


def cascade_count(listed: int, universe: int) -> int:
    """How many cascades a list needs so that each one's level 0 fits ``MAX_LEVEL_BITS``."""
    return max(1, math.ceil(1.44 * listed * math.log2(1 / first_rate(listed, universe)) / MAX_LEVEL_BITS)) if listed else 1


class Cascade:
    """Exact membership in ``listed`` for every key of ``universe`` (both: ``key``, distinct)."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        inside, n_inside = listed, listed.count()
        self.levels: list[Level] = []
        if not n_inside:
            return
        outside = universe.join(listed, "key", "left_anti")
        rate = first_rate(n_inside, universe.count())
        while n_inside:
            level = Level(inside, n_inside, rate, len(self.levels))
            self.levels.append(level)
            # the next level holds what passes this one from the other side
            passed = materialize(outside.filter(level.may_hold(F.col("key"))), "url-passed")
            inside, outside, n_inside, rate = passed, inside, passed.count(), 0.5

    def holds(self, key: Column) -> Column:
        test = F.lit(len(self.levels) % 2 == 1)
        for n in reversed(range(len(self.levels))):
            passes = self.levels[n].may_hold(key)
            test = passes & test if n % 2 == 0 else ~passes | test
        return test


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = ALLOW) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    ``rules`` has ``key`` (``host/path``) and ``verdict`` (allow or block).  A rule
    fits its host and all subdomains if the URL's path starts with the rule's.
    The longest key wins, of equally long ones that with the longer host; a key
    listed with both verdicts blocks.  ``rule`` is the key or null; without a rule the
    verdict is ``default``, as the cascade holds no key of the URL.  Null URLs
    and URLs without ``://`` have an empty host and path and no rule.  Rows that
    repeat are judged alike; an empty table of pages gives an empty result, an empty list
    the default.  Rules with null keys
    are ignored.
    """
    src = narrow(pages, page_id=id_col, url=url_col)
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    split = src.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))

    at = F.locate("/", F.col("key"))
    rule_host = F.translate(F.when(at > 0, F.substring_index("key", "/", 1)).otherwise(F.col("key")), UPPER, LOWER)
    rule_path = F.when(at > 0, F.substring(F.col("key"), at, F.length("key"))).otherwise(F.lit(""))
    listed = materialize(
        rules.filter(F.col("key").isNotNull())
        .select(F.concat(rule_host, rule_path).alias("key"), labels(rule_host).alias("n_labels"),
                F.length(rule_path).alias("n_path"), (F.col("verdict") == BLOCK).alias("blocks"))
        .groupBy("key", "n_labels", "n_path").agg(F.max("blocks").alias("blocks")), "url-rules")
    # the shapes of the rules: label counts by path lengths, a short list
    shapes = sorted((r.n_labels, r.n_path) for r in listed.select("n_labels", "n_path").distinct().toLocalIterator())
    if not shapes:
        return split.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
                            F.lit(default).alias("verdict"))

    split = materialize(split.withColumn("row", F.monotonically_increasing_id()), "url-rows")
    universe = materialize(candidates(split, shapes).select("key").distinct(), "url-universe")
    parts = cascade_count(listed.count(), universe.count())
    found = None
    for part in range(parts):
        def own(keys: DataFrame) -> DataFrame:
            return keys if parts == 1 else keys.filter(F.pmod(F.xxhash64(F.lit("part"), "key"), F.lit(parts)) == part)

        member = Cascade(own(listed.select("key")), own(universe))
        blocked = Cascade(own(listed.filter("blocks").select("key")), own(listed.select("key")))
        hits = own(candidates(split, shapes, "row")).filter(member.holds(F.col("key"))).select(
            "row", F.struct(F.length("key").alias("n"), "n_labels", "key", blocked.holds(F.col("key")).alias("blocks")).alias("hit"))
        found = hits if found is None else found.unionByName(hits)
    best = materialize(found.groupBy("row").agg(F.max("hit").alias("hit")), "url-hits")
    verdict = F.when(F.col("hit").isNull(), F.lit(default)).when(F.col("hit.blocks"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return split.join(best, "row", "left").select("page_id", "host", "path", F.col("hit.key").alias("rule"), verdict.alias("verdict"))
