"""Null and repeated ids, collisions, overflow, empty tables and clashing columns, by brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tagweave.llm import audit, line_dedup, manifest, near_dedup, quality, sharding
from tagweave.llm.common import positions, small_enough
from tagweave.llm.mixing import mix, mixed_documents
from tagweave.llm.topk import top_products
from tests.conftest import SF_SMALL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
A, B = "one two three four five six seven eight nine ten", "other words that nothing else in this table holds at all"
SHARED = "this line stands in several different texts"


def docs_of(spark, rows, clash="pos int, item string, size double, node string, row string, tree int, leaf string, mask int"):
    """Documents, and columns whose names the operators use themselves."""
    extra = (1, "i", 0.5, "n", "r", 2, "l", 3)
    return spark.createDataFrame([(*r, *extra) for r in rows], f"{COLUMNS}, {clash}")


def doc(i, text, lang="en", source="s", n=None):
    return (i, text, lang, source, n if n is not None or text is None else len(text))


ODD = [doc(1, A), doc(None, A), doc(None, A), doc(2, None, None, None), doc(3, ""), doc(3, ""), doc(4, "Ünï ÇÖDE " * 30, "de", "t"),
       doc(None, None, "de", None), doc(5, "x" * 300_000, "de", "t"), doc(6, B, "fr", "ü"), doc(6, B.upper(), "fr", "ü"),
       doc(7, "# $", "fr", "t"), doc(8, A, "en", "u"), doc(-9, B, None, "s")]


@pytest.mark.parametrize("operator", [
    line_dedup.drop_repeated_lines, near_dedup.keep_first, mixed_documents, lambda d: quality.keep_good(d, quality.RuleModel(1.0, []))])
def test_stages_on_an_empty_table(spark, operator):
    empty = docs_of(spark, [])
    out = operator(empty)
    assert out.columns == empty.columns and out.count() == 0


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF_SMALL), f"empty-{name}")
        assert docs.count() == 0


def test_one_of_the_lines_shared_by_texts_without_ids_stays(spark):
    rows = [doc(None, f"{SHARED}\nown line number {i} of this text: {'qwxz'[i] * 30}") for i in range(4)] + [doc(None, None)]
    out = [r.text for r in line_dedup.drop_repeated_lines(docs_of(spark, rows)).collect()]
    assert sum(SHARED in (t or "") for t in out) == 1 and len(out) == 5


def test_lines_that_share_64_bits_are_told_apart(spark, monkeypatch):
    """Every line gets the same first half: only the other half differs."""
    class Hash:
        @staticmethod
        def xxh3_128_intdigest(data):
            import xxhash

            return (5 << 64) | (xxhash.xxh3_64_intdigest(data) >> 1)

    lines = [f"{c * 3} line that has nothing in common {c * 20}" for c in "abcdef"]
    rows = [doc(i, f"{lines[i]}\n{lines[0]}") for i in range(6)]
    src = docs_of(spark, rows).coalesce(1)
    table = line_dedup.line_table(src, "doc_id", "text", 8).withColumn("item", F.lit(5).cast("long"))
    monkeypatch.setattr(line_dedup, "line_table", lambda *_: table)
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(src, min_chars=8).collect()}
    assert out == {0: lines[0], **{i: lines[i] for i in range(1, 6)}}


def test_keep_first_takes_one_row_of_a_component(spark):
    rows = ODD + [doc(1, A), doc(1, A.upper())]
    kept = near_dedup.keep_first(docs_of(spark, rows)).collect()
    # A: ids 1, 1, 1, 8 and two null ids in one component; B: 6, 6 and -9; the others stand alone
    groups = defaultdict(list)
    for r in kept:
        groups[" ".join((r.text or "").translate(LOWER).split())].append(r.doc_id)
    assert groups[A] == [1] and groups[B.lower()] == [-9]
    assert sorted(groups[""], key=str) == sorted([2, 3, 3, None], key=str)  # no words: all rows stay
    assert groups["# $"] == [7] and len(kept) == 9


def test_components_of_null_ids_only_keep_one_row(spark):
    kept = near_dedup.keep_first(docs_of(spark, [doc(None, A)] * 3 + [doc(None, B), doc(None, B + " more")])).collect()
    assert len(kept) == 2 and {r.text.split()[0] for r in kept} == {"one", "other"}


def test_mix_keeps_sources_of_null_and_repeated_ids_apart(spark):
    rows = [doc(None, "w " * 10, source=s) for s in "ab" for _ in range(12)] + [doc(7, "w " * 10, source="a")] * 5
    rows += [doc(i, f"v{i} " * 10, source="c") for i in range(40)]
    docs = docs_of(spark, rows)
    plan = mix(docs).collect()
    took = Counter()
    for r in mixed_documents(docs).collect():
        took[r.source] += 10
    size = Counter()
    for r in rows:
        size[r[3]] += 10
    target = {r.source_size: r.target for r in plan}
    for s in "abc":
        assert abs(took[s] - target[size[s]]) <= 10
    assert mixed_documents(docs).columns == docs.columns


def test_products_beyond_64_bits_raise(spark):
    rows = [(i, [1e16 * (i + 1), -3.0]) for i in range(4)]
    with pytest.raises(ValueError, match="64 bits"):
        top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count()
    ok = [(i, [2.0**20 * (i + 1), -3.0]) for i in range(4)]
    got = top_products(spark.createDataFrame(ok, "vec_id long, embedding array<double>"), every=1).filter("query_id = 3 and rank = 1").first()
    assert (got.vec_id, got.score) == (2, 4 * 3 * 2**56 + 768 * 768)


def test_small_enough_counts_bytes(spark):
    df = spark.range(100).selectExpr("id", "repeat('x', 1000) AS t", "array(struct(id, 'yyyyyyyyyy' AS z)) AS s")
    assert small_enough(df) and not small_enough(df, max_rows=99) and not small_enough(df, max_bytes=50_000)
    assert small_enough(spark.range(100)) and not small_enough(spark.range(100), max_bytes=799)


@pytest.mark.parametrize("weight", [None, "w"])
def test_positions(spark, weight):
    rows = [(g, i % 7 if i % 5 else None, i % 3 + 1) for g in ("a", None, "b") for i in range(50)]
    df = spark.createDataFrame(rows, "g string, k int, w long").repartition(7)
    got = positions(df, ["g"], ["k", "w"], "test-positions", weight).collect()
    for g in ("a", None, "b"):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.pos)
        at = 0
        for r in mine:
            assert r.pos == at
            at += r.w if weight else 1
        keys = [(r.k is not None, r.k or 0, r.w) for r in mine]
        assert keys == sorted(keys) and len(mine) == 50
    assert positions(df.limit(0), ["g"], ["k"], "test-none").count() == 0


# --- op11 -----------------------------------------------------------------------------

def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = defaultdict(list)
    for i, t, _, source, _ in rows:
        t = t or ""
        words = t.encode().split()
        fails = {c for c, bad in zip("ABCDE", (
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            any(c in "#$%&*|" for c in t), i is not None and first[t] < i)) if bad}
        docs[source or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, members in docs.items():
        removed_of = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[:step - 1])
                row = [0] * 6
                for fails, is_good, is_toxic in members:
                    gone, hit = bool(fails & before), f in fails
                    row[0] += not gone and not hit
                    row[1] += hit and not gone
                    row[2] += hit and gone
                    row[3] += fails == {f}
                    row[4] += hit and not gone and is_good
                    row[5] += hit and not gone and is_toxic
                removed_of[f] += row[1]
                out[part, order, step] = row
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_of[order[step - 1]])
    return out


def test_audit_brute(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = ODD + [doc(20 + i, t, source=s) for i, (t, s) in enumerate([
        (text, "s"), (text, "t"), (text.upper(), "t"), (text + " |", "s"), ("a b " * 60, "s"), (text, None), (text + "É" * 40, ""), ("A" + "b" * 19, "t")])]
    labels = [(20, 1, 0), (21, 1, 1), (22, 0, 1), (22, None, None), (24, 1, None), (None, 1, 1), (20, 0, 0), (1, 1, 1)]
    got = audit.audit_filters(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute_audit(rows, labels)
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
            for r in got} == want
    assert len(got) == 600 * len({r[3] or "" for r in rows})
    assert audit.audit_filters(docs_of(spark, []), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_packed_fields_do_not_run_over():
    """Sums of many large counts stay in their fields."""
    masks = {3: (1 << 40) + 7, 17: (1 << 41) + 1, 0: 5, 31: (1 << 39)}
    fields = audit.unpack(sum(n * audit.packed_outcomes(m) for m, n in masks.items()))
    for o, order in enumerate(permutations(range(5))):
        for step, f in enumerate(order):
            kept = sum(n for m, n in masks.items() if not any(m >> g & 1 for g in order[:step + 1]))
            removed = sum(n for m, n in masks.items() if m >> f & 1 and not any(m >> g & 1 for g in order[:step]))
            assert fields[5 * o + step].tolist()[:2] == [kept, removed]


# --- op12 -----------------------------------------------------------------------------

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, fanout=8):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(i, t, lang, source, n):
        return sha(*map(field, (i, source, lang, n, t)))

    def climb(nodes):
        """Root and, for every leaf, the steps (left, right)."""
        steps, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[k:k + fanout] for k in range(0, len(nodes), fanout)]
            for j, p in enumerate(at):
                run, slot = runs[p // fanout], p % fanout
                steps[j].append(("".join(run[:slot]), "".join(run[slot + 1:])))
            at, nodes = [p // fanout for p in at], [sha(*r) for r in runs]
        return nodes[0], steps

    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[lang] = (mine, *climb([leaf(*r) for r in mine]))
    root, tops = climb([trees[lang][1] for lang in langs])
    out = []
    for lang, top in zip(langs, tops):
        mine, subroot, steps = trees[lang]
        for r, own in zip(mine, steps):
            path = own + top
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            fold = leaf(r[0], r[1].translate(LOWER) if hit and r[1] is not None else r[1], *r[2:])
            for left, right in path:
                fold = sha(left, fold, right)
            out.append((r[0], leaf(*r), subroot, root, sha(*(a + b for a, b in path)), fold, fold == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 8, 9, 65])
def test_manifest_brute(spark, n):
    rows = ODD + [doc(100 + i, f"Text {i}", "en") for i in range(n)] + [doc(500 + i, "t", f"l{i:02d}") for i in range(n % 13)]
    got = manifest.verify_documents(docs_of(spark, rows).repartition(5))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_manifest(rows)


def test_manifest_of_one_row_and_none(spark):
    got = manifest.verify_documents(docs_of(spark, [doc(0, "Only")])).collect()
    assert [tuple(r) for r in got] == brute_manifest([doc(0, "Only")])
    assert got[0].proof_sha256 == hashlib.sha256(b"").hexdigest() and got[0].leaf == got[0].root
    assert manifest.verify_documents(docs_of(spark, [])).count() == 0


# --- op13 -----------------------------------------------------------------------------

def size_of(text):
    return len((text or "").encode()) + 16


def test_shards_edges(spark):
    got = sharding.shard_documents(docs_of(spark, ODD), 5).collect()
    assert len(got) == len(ODD)
    want = Counter((r[0], size_of(r[1]), zlib.crc32((r[1] or "").encode())) for r in ODD)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < 5
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(docs_of(spark, []), 5).count() == 0
    assert {r.shard for r in sharding.shard_documents(docs_of(spark, ODD[:1]), 40).collect()} <= set(range(40))


def test_shards_are_balanced_and_copies_stay_together(spark):
    import random

    rng = random.Random(2)
    rows, i = [], 0
    for _ in range(1500):
        text = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 400)))
        for _ in range(rng.choice([1, 1, 1, 2, 5])):  # light groups
            rows.append(doc(i, text, rng.choice(["en", "de", None]), rng.choice(["s0"] * 5 + ["s1", "s2", None])))
            i += 1
    hot = "hot text " * 20
    rows += [doc(i + k, hot, "en", f"s{k % 3}") for k in range(len(rows) // 2)]  # a third of all rows
    got = sharding.shard_documents(docs_of(spark, rows).repartition(6), 7).collect()
    total = Counter()
    where = defaultdict(set)
    text_of = {r[0]: r[1] for r in rows}
    for r in got:
        total[r.shard] += r["size"]
        where[text_of[r.doc_id]].add(r.shard)
    mean = sum(total.values()) / 7
    assert all(abs(total[s] - mean) < 0.05 * mean for s in range(7))
    assert all(len(s) == 1 for t, s in where.items() if t != hot)
    assert len(where[hot]) <= 4
    again = sharding.shard_documents(docs_of(spark, rows).repartition(3), 7).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in got}
