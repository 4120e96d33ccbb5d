"""Near-duplicate documents and lines, components, and the pipeline against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tagweave.llm import line_dedup, links, near_dedup
from tests.conftest import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_set(text, n=2):
    words = WORD.findall((text or "").translate(LOWER))
    n = min(n, len(words))
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if n else frozenset()


def line_chars(line, n=8):
    line = " ".join(line.lower().split())
    return frozenset(line[i:i + n] for i in range(len(line) - n + 1))


def classes(sets):
    """Smallest index linked to each set by chains of similarity 0.8 or more."""
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def family(rng, words, count, edits):
    out = []
    for _ in range(count):
        text = list(words)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(len(text))] = f"new{rng.randrange(10 ** 6)}"
        out.append(" ".join(text))
    return out


def fixture():
    rng = random.Random(4)
    texts = [None, "", " \t ", "one", "ONE", "one two", "One  two", "one two three"]
    for k in range(12):
        base = [f"w{k}x{rng.randrange(60)}" for _ in range(rng.choice([12, 60, 200]))]
        texts += family(rng, base, rng.choice([1, 5, 40]), len(base) // 9)
    texts += ["copy of copies here"] * 30 + ["  ".join(f"long{i}" for i in range(30_000))]
    # a chain: each near its neighbour only
    chain = [f"c{i}" for i in range(120)]
    for k in range(0, 60, 8):
        texts.append(" ".join([*(f"z{i}" for i in range(k)), *chain[k:]]))
    rng.shuffle(texts)
    return [(3 * i + 7, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, node string, item int")


@pytest.fixture(params=[64, 3])
def block(request, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", request.param)
    monkeypatch.setattr(links, "REST_BLOCK", request.param)


def test_near_duplicates_brute(spark, block):
    rows = fixture()
    rows += [rows[40], (None, rows[50][1]), (None, "nobody else says so")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()), key=repr)
    sets = [word_set(t) for _, t in rows]
    found, want = classes(sets), []
    least = defaultdict(list)
    for (i, _), c in zip(rows, found):
        least[c].append(i)
    for (i, _), s, c in zip(rows, sets, found):
        first = min((x for x in least[c] if x is not None), default=None) if s else i
        want.append((i, len(s), first, i == first))
    assert got == sorted(want, key=repr)


def test_bitmaps_rule_out_dissimilar_pairs_only():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(1, 3000))
        a = rng.integers(1 << 63, size=n, dtype=np.uint64) * np.uint64(2)
        cut = int(n * rng.uniform(0, 0.4))
        b = np.unique(np.concatenate([a[cut:], rng.integers(1 << 63, size=int(rng.integers(0, cut + 1)), dtype=np.uint64)]))
        a = np.unique(a)
        differ = int(np.bitwise_count(links.bitmap(a) ^ links.bitmap(b)).sum())
        assert differ <= len(a) + len(b) - 2 * near_dedup.overlap(a, b)
        if near_dedup.similar(a, b):
            assert 180 * differ <= 20 * (len(a) + len(b))


def test_near_duplicates_empty(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert near_dedup.near_duplicates(frame(spark, [(1, None), (2, "")])).filter("kept").count() == 2


def test_keep_first_keeps_columns(spark):
    rows = fixture()
    docs = frame(spark, rows)
    kept = near_dedup.keep_first(docs)
    want = {r.doc_id for r in near_dedup.near_duplicates(docs).collect() if r.kept}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


def test_word_hashes_across_pieces(monkeypatch):
    text = " ".join(f"Wörd{i}" for i in range(500)) + "\x0b\x1cx " + "y" * 300
    whole = near_dedup.word_hashes(text)
    monkeypatch.setattr(near_dedup, "PIECE", 64)
    assert (near_dedup.word_hashes(text) == whole).all()
    assert len(whole) == len(WORD.findall(text))
    assert (near_dedup.word_hashes(text.translate(LOWER)) == whole).all()


def test_tensored_keys_need_a_match_on_both_sides(spark):
    from pyspark.sql import functions as F

    side, rows = 4, 2
    docs = frame(spark, [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k")])
    sig = near_dedup.signatures(docs, "doc_id", "text", 2, side, rows).orderBy("doc_id").collect()
    tables = F.flatten(F.transform("left", lambda x, i: F.transform("right", lambda y, j: F.xxhash64(i, j, x, y))))
    keys = [set(r.keys) for r in spark.createDataFrame(sig).orderBy("doc_id").select(tables.alias("keys")).collect()]
    left, right = ([x == y for x, y in zip(sig[0][c], sig[1][c])] for c in ("left", "right"))
    assert len(keys[0]) == side * side and len(keys[0] & keys[1]) == sum(left) * sum(right)


def test_components_of_a_long_chain_and_a_hub(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10 ** 9), 400)
    edges = list(zip(ids[:150], ids[1:150])) + [(ids[200], x) for x in ids[201:390]] + [(ids[391], ids[391])]
    got = {r.item: r.root for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[x] for x in ids[:150]}) == 1 and len({got[x] for x in ids[200:390]}) == 1
    assert got[ids[0]] != got[ids[200]] and set(got) == set(ids[:150]) | set(ids[200:390])
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def lines_fixture():
    rng = random.Random(8)
    lines = ["short", "", "Tiny line", "=" * 30]
    for k in range(25):
        base = [f"{rng.choice('abcdefg')}{k}{rng.randrange(90)}word" for _ in range(rng.choice([4, 12, 60]))]
        lines += family(rng, base, rng.choice([1, 3, 20]), max(1, len(base) // 25))
    lines += ["  The SAME line,  spelled with blanks ", "the same LINE, spelled with blanks"]
    docs = ["\n".join(rng.choices(lines, k=rng.randint(1, 6))) for _ in range(70)]
    docs += [None, "", "\n\n", lines[10], lines[10], "x\n" + lines[10] + "\n" + lines[10], "y" * 60_000 + "\n" + "y" * 60_000]
    return [(5 * i, t) for i, t in enumerate(docs)]


def brute_lines(rows, min_chars=24):
    first, seen = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for n, line in enumerate((t or "").split("\n")):
            norm = " ".join(line.lower().split())
            if len(norm) >= min_chars and len(line) >= min_chars:
                first.setdefault(norm, (i, n))
                seen.append((i, n, norm))
    order = list(first)
    found = dict(zip(order, classes([line_chars(s) for s in order])))
    keep = {}
    for norm in order:
        key = (first[norm][0] is not None, first[norm][0] or 0, first[norm][1])
        keep[found[norm]] = min(keep.get(found[norm], key), key)
    gone = defaultdict(set)
    for i, n, norm in seen:
        if keep[found[norm]] != (i is not None, i or 0, n):
            gone[i].add(n)
    return gone


def test_dedup_lines_brute(spark, block):
    rows = lines_fixture()
    rows += [rows[3], (None, rows[6][1])]
    gone, want = brute_lines(rows), []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [s for n, s in enumerate(lines) if n not in gone[i]]
        size = len(lines) if t else 0
        want.append((i, size, size - len(gone[i]), "\n".join(left)))
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_dedup_lines_empty(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_drop_repeated_lines(spark):
    rows = lines_fixture()
    docs = spark.createDataFrame([(i, t, "s", len(t or ""), "k") for i, t in rows],
                                 "doc_id long, text string, source string, n_chars long, removed string")
    gone, want = brute_lines(rows), []
    for i, t in rows:
        left = None if t is None else "\n".join(s for n, s in enumerate(t.split("\n")) if n not in gone[i])
        if left or not gone[i]:
            want.append((i, left, "s", len(left or ""), "k"))
    got = line_dedup.drop_repeated_lines(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_shingle_hashes_stay_inside_lines():
    a, b = "abcdefghijklmnop", "qrstuvwxyzäö"
    found, starts = line_dedup.shingle_hashes([a, b])
    alone = [line_dedup.shingle_hashes([x])[0] for x in (a, b)]
    assert list(starts) == [0, len(a) - 7] and (found == np.concatenate(alone)).all()
    assert len(line_dedup.line_sets(["tiny"])[0]) == 1


def test_pipeline_stages(spark):
    """Every stage's effect, from its own input, by brute force."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    names = docs.columns
    rows = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF_SMALL), f"test-{name}")
        assert name == "encode" or docs.columns == names
        rows.append(docs.collect())
    start, good, lines, near, mixed, encoded = rows
    assert {r.doc_id for r in good} <= {r.doc_id for r in start} and len(good) > 0.7 * len(start)
    gone = brute_lines([(r.doc_id, r.text) for r in good], min_chars=8)
    want = {r.doc_id: "\n".join(s for n, s in enumerate(r.text.split("\n")) if n not in gone[r.doc_id]) for r in good}
    assert {r.doc_id: r.text for r in lines} == {i: t for i, t in want.items() if t or not gone[i]}
    assert all(r.n_chars == len(r.text) for r in lines if gone[r.doc_id])
    order = sorted(lines, key=lambda r: r.doc_id)
    found = classes([word_set(r.text, 5) for r in order])
    assert sorted(r.doc_id for r in near) == sorted({order[c].doc_id for c in found})
    words = {r.doc_id: len(WORD.findall(r.text)) for r in near}
    took = sum(words[r.doc_id] for r in mixed)
    assert {r.doc_id for r in mixed} <= set(words) and abs(took - sum(words.values())) < 0.2 * sum(words.values())
    assert sorted(r.doc_id for r in encoded) == sorted(r.doc_id for r in mixed)


def test_pipeline_near_dedup_takes_five_words(spark):
    """Revised pages stay, and the stage agrees with brute force on five words."""
    rng = random.Random(5)
    rows = fixture()
    rows = [r for r in rows if r[1]]
    for k in range(6):
        page = [f"p{k}x{i}" for i in range(400)]
        revised, copy = list(page), list(page)
        for i in range(12, 400, 25):  # 16 words, 4 %
            revised[i] = f"r{k}x{i}"
        copy[200] = "typo"
        assert classes([word_set(" ".join(t)) for t in (page, revised)]) == [0, 0]
        rows += [(10_000 + 10 * k + j, " ".join(t)) for j, t in enumerate((page, revised, copy))]
    rows.sort()
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), SF_SMALL).collect()}
    assert got == {rows[c][0] for c in classes([word_set(t, 5) for _, t in rows])}
    assert {10_000 + 10 * k + j for k in range(6) for j in (0, 1)} == {i for i in got if i >= 10_000}


def test_short_lines_count_in_query_and_pipeline(spark, tmp_path):
    """Every line that has a shingle is compared: boilerplate of 8 to 23 characters, by brute force."""
    from tagweave.llm.queries import op1_line_dedup

    rng = random.Random(12)
    short = ["Share on Facebook", "share  on facebook", "Leave a comment", "All rights reserved.", "Shares on Facebook", "8 chars.", "7 chars"]
    short += ["十二个汉字组成的一句完整的话。", "Read more about it here", "read more about it here!"]
    rows = lines_fixture()
    rows += [(1000 + i, "\n".join([f"page {i} has {rng.random()} of its own", *rng.choices(short, k=3)])) for i in range(40)]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    gone, kept = brute_lines(rows, min_chars=8), {}
    for i, t in rows:
        kept[i] = "\n".join(s for n, s in enumerate((t or "").split("\n")) if n not in gone[i])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_kept, r.text_sha256) for r in op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: ((len(t.split("\n")) if t else 0) - len(gone[i]), hashlib.sha256(kept[i].encode()).hexdigest())
                   for i, t in rows}
    stage = {r.doc_id: r.text or "" for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()}
    assert stage == {i: t for i, t in kept.items() if t or not gone[i]}
    lines = [s for t in stage.values() for s in t.split("\n")]
    assert sum(s.lower().split() == ["share", "on", "facebook"] for s in lines) == 1 and lines.count("7 chars") > 1


def test_least_items_take_no_part_in_the_rest(spark):
    """The star has compared them with all items of their buckets."""
    members = spark.createDataFrame([(1, 10, 10), (1, 11, 10), (2, 20, 20), (2, 21, 20), (2, 22, 20)], "key long, item long, least long")
    roots = spark.createDataFrame([], "item long, root long")
    assert {r.item for r in links.rest_units(members, roots).collect()} == {21, 22}


def test_table_keys_need_halves_that_others_have(spark):
    items = spark.createDataFrame([(1, [5, 6], [7, 8]), (2, [5, 9], [7, 4]), (3, [5, 1], [2, 3]), (4, [7, 8], [5, 6])],
                                  "item long, left array<long>, right array<long>")
    keys = near_dedup.table_keys(items, 2)
    assert sorted(r.item for r in keys.collect()) == [1, 2] and keys.select("key").distinct().count() == 1


def test_lowered_texts_have_normal_lines():
    for text in ("", "A b\nC\u00c9d \u00dfX", "a  b", " a", "a ", "a\n b", "a \nb", "a\tb", "a\u00a0b", "a\u0085b", "\u0130x", "A\n\nB", "a\x1cB"):
        low = line_dedup.lowered(text)
        lines = [line_dedup.normalized(s) for s in text.split("\n")]
        assert low is None or low.split("\n") == lines
    assert line_dedup.lowered("A b\nC\u00c9d") == "a b\nc\u00e9d" and line_dedup.lowered("a  b") is None
    for c in map(chr, range(256)):
        low = line_dedup.lowered(f"x{c}Y")
        assert low is None or low.split("\n") == [line_dedup.normalized(s) for s in f"x{c}Y".split("\n")]


def test_items_of_overlapping_buckets_stand_once_in_the_rest(spark):
    rows = [(key, item, 0) for key in range(10) for item in [0, *range(1, 31), 31 + key]]  # no two keys hold the same
    members = spark.createDataFrame(rows, "key long, item long, least long")
    units = links.rest_units(members, spark.createDataFrame([], "item long, root long")).collect()
    assert sorted(r.item for r in units) == [*range(1, 41)]
    assert len({r.unit for r in units}) == 1
    assert {r.item: sorted(r["keys"]) for r in units} == {i: [i - 31] if i > 30 else [*range(10)] for i in range(1, 41)}


def test_items_of_a_unit_are_compared_if_they_share_a_key():
    asking, same = links.Asking(80), np.arange(50, dtype=np.uint64) << np.uint64(52)
    for item in range(20):
        asking.add(item, item, same, [item % 2])
    assert asking.candidates(30, same, [1], lambda x: x) == [*range(1, 20, 2)]
    assert asking.candidates(3, same, [1], lambda x: x) == [1, *range(5, 20, 2)]
    assert asking.candidates(30, same + np.uint64(100 << 52), [1], lambda x: x) == []
    assert asking.candidates(30, same, None, lambda x: x) == [*range(20)]


def test_shingle_hashes_are_the_same_beside_rare_characters():
    low, high = ["plain line of text, with é and ɏ"], ["a line with ɐ and \U0001f600 in it"]
    assert len(line_dedup._CODES) == 0x250
    alone, both = line_dedup.shingle_hashes(low)[0], line_dedup.shingle_hashes(low + high)[0]
    assert (both[:len(alone)] == alone).all() and (both[len(alone):] == line_dedup.shingle_hashes(high)[0]).all()
    twice = line_dedup.line_sets(["ab" * 20, "no shingle stands twice"])
    assert [len(x) for x in twice] == [2, 16] and all((x[1:] > x[:-1]).all() for x in twice)


def test_a_line_has_its_band_keys_in_one_value(spark):
    texts = ["a first line of plain text\nits second line, d\u00e9j\u00e0 vu \u00ff", "a third line, \u0250 and \U0001f600\na first line of plain text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = line_dedup.line_table(docs, "doc_id", "text", 8).orderBy("doc_id", "line").collect()
    lines = [x for t in texts for x in t.split("\n")]
    for line, row in zip(lines, rows):
        found, starts = line_dedup.shingle_hashes([line])
        x = (found >> np.uint64(32)).astype(np.uint32)
        minhash = near_dedup.MinHash(line_dedup.BANDS * line_dedup.ROWS)
        low = ((x ^ minhash.masks) * minhash.factors).min(axis=1)
        keys = near_dedup.folded(low, line_dedup.ROWS) + np.arange(1, line_dedup.BANDS + 1, dtype=np.uint64)
        digest = xxhash.xxh3_128_intdigest(line.encode())
        assert (row.item % (1 << 64), row.more % (1 << 64)) == (digest >> 64, digest % (1 << 64))
        assert row["keys"] is None if row is rows[3] else bytes(row["keys"]) == near_dedup.mix(keys).tobytes()
    numbers = np.arange(1, 1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert (near_dedup.mix_high(numbers) == near_dedup.mix(numbers) >> np.uint64(32)).all()
