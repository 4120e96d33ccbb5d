"""Operators with an exact answer, against brute force on small fixtures: exact
dedup, mixing, URL rules, top-k products."""

import hashlib
import math
from collections import defaultdict

import pytest

from tagweave.llm import exact_dedup as ED
from tagweave.llm.mixing import mix, mixed_documents
from tagweave.llm.topk import top_products
from tagweave.llm.url_filter import Cascade, judge_urls, rule_table

TEXTS = [(1, "A b c"), (2, "a B c"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 50_000), (8, "X" * 50_000),
         (2, "a B c"), (None, "solo"), (None, "a b c"), (9, "solo "), (10, "a\tb c")]


def docs_of(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 7, "z") for i, t in rows], "doc_id long, text string, fp int, keep_id string")


@pytest.mark.parametrize("fp_bits", [64, 3])
def test_exact_dedup_brute(spark, fp_bits):
    got = sorted(map(tuple, ED.exact_dedup(docs_of(spark, TEXTS), fp_bits=fp_bits).collect()), key=repr)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[(t or "").translate(lower)].append(i)
    want = []
    for i, t in TEXTS:
        norm = (t or "").translate(lower)
        keep = max((x for x in groups[norm] if x is not None), default=None)
        want.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_exact_dedup_empty(spark):
    assert ED.exact_dedup(docs_of(spark, [])).count() == 0


def test_quotient_filter_roundtrip_and_merge(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    values = rng.integers(-(1 << 63), 1 << 63, size=3000)
    values = np.concatenate([values, values[:700], values[:50]])
    fps = spark.createDataFrame([(int(v),) for v in values], "fp long").repartition(5)
    q, b = ED.filter_shape(len(values), 5, 3)
    merged = ED.merge_filters(ED.build_filters(fps, q, b), q, b).collect()
    got = {}
    for row in merged:
        vs, cs = ED.decode_block(row, q, b)
        assert list(vs) == sorted(vs)
        got.update(zip(vs.view(np.int64).tolist(), cs.tolist()))
    want = dict(zip(*[x.tolist() for x in np.unique(values, return_counts=True)]))
    assert got == want


def brute_mix(rows, weights=(1, 2, 3), cap=3):
    size = defaultdict(int)
    for _, n, s in rows:
        size[s] += n
    order = sorted([s for s in size if s is not None], key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        left = total - sum(cap * size[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        new = {s for s in order if s not in capped and weight[s] * left > cap * size[s] * w}
        if not new:
            break
        capped |= new
    target = {s: float(cap * size[s]) if s in capped else weight[s] * left / max(1, w) for s in order}
    taken = {}
    for s in order:
        docs = sorted(((hashlib.md5(f"mix-1:{'null' if i is None else i}".encode()).hexdigest(), i, n)
                       for i, n, x in rows if x == s), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
        budget = math.floor(target[s] + 0.5)
        whole = budget // size[s] if size[s] else 0
        left = budget - whole * size[s]
        for _, i, n in docs:
            cut = max(0, min(n, left))
            left -= cut
            taken.setdefault((i, n, s), []).append(n * whole + cut)
    return size, target, taken


MIX_ROWS = [(i, (i * 37) % 23, f"s{i % 5}") for i in range(60)] + [(100, 4000, "s1"), (101, 5, None), (102, 0, "empty"),
            (None, 7, "s2"), (103, 9, "S"), (104, 3, "é"), (7, 12, "s3")]


def mix_docs(spark, rows):
    text = {i: " ".join(["w"] * i) for i in {n for _, n, _ in rows}}
    return spark.createDataFrame([(i, text[n] if n else None, s, 1, 2) for i, n, s in rows],
                                 "doc_id long, text string, source string, size int, key int")


def test_mix_brute(spark):
    size, target, taken = brute_mix(MIX_ROWS)
    got = mix(mix_docs(spark, MIX_ROWS)).join(mix_docs(spark, MIX_ROWS).select("doc_id", "source"), "doc_id", "left").collect()
    rows = mix(mix_docs(spark, MIX_ROWS)).collect()
    assert len(rows) == len(MIX_ROWS)
    for r in rows:
        options = [s for s in size if abs(target[s] - r.target) < 1e-9 and size[s] == r.source_size]
        assert any(r.taken in taken.get((r.doc_id, r["size"], s), []) for s in options), r
    for s in size:
        assert sum(sum(v) for (_, _, x), v in taken.items() if x == s) == math.floor(target[s] + 0.5)
        assert target[s] <= 3 * size[s]
    assert all(r.taken <= 3 * r["size"] for r in rows)
    assert sum(r.taken for r in rows) == sum(math.floor(t + 0.5) for t in target.values())
    assert len(got) >= len(rows) - 1


def test_mix_reruns_agree_and_empty(spark):
    docs = mix_docs(spark, MIX_ROWS)
    assert sorted(map(repr, mix(docs).collect())) == sorted(map(repr, mix(docs.repartition(7)).collect()))
    assert mix(docs.limit(0)).count() == 0
    assert mix(docs.filter("text is null")).select("taken").distinct().collect()[0].taken == 0


def test_mixed_documents_repeat_rows(spark):
    docs = mix_docs(spark, MIX_ROWS).filter("doc_id is not null and doc_id <> 7")
    plan = {r.doc_id: r for r in mix(docs).collect()}
    got = mixed_documents(docs).groupBy("doc_id").count().collect()
    assert mixed_documents(docs).columns == docs.columns
    assert {r.doc_id: r["count"] for r in got} == {
        i: k for i, r in plan.items() if r["size"] and (k := math.floor(r.taken / r["size"] + 0.5))}


URLS = [None, "", "no scheme", "http://", "http://a.org", "http://A.ORG/x", "https://example.org/en/17?q", "http://x.example.org/es/",
        "http://example.org/en/2", "ftp://b.COM/fr/1#x", "http://b.com/de", "http://b.com/de/", "http://b.com?/fr/", "://org/",
        "http://org/", "http://xorg/", "http://a.b.c.d.net/fr/", "http://..org//", "http://com/fr/://org/", "http://a.org/" + "y" * 20_000,
        "http://" + "a." * 3000 + "org/z"]
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def brute_judge(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, rest = rest[:n].lower(), rest[n:]
        path = rest[:next((i for i, c in enumerate(rest) if c in "?#"), len(rest))]
    fits = [(len(k), k, v) for v, k in rules
            if (host == k.split("/", 1)[0] or host.endswith("." + k.split("/", 1)[0])) and path.startswith("/" + k.split("/", 1)[1])]
    return (host, path, *(max(fits)[1:] if fits else (None, default)))


@pytest.mark.parametrize("rules", [RULES, [], RULES[:1], [("block", f"h{i}.example/{i}") for i in range(300)] + RULES])
def test_judge_urls_brute(spark, rules):
    urls = URLS + [f"http://h{i}.example/{i % 7}{i}" for i in range(0, 400, 3)] + [f"https://w.h{i}.example/{i}/p" for i in range(0, 400, 7)]
    pages = spark.createDataFrame([(i, u, "k", "r") for i, u in enumerate(urls)], "page_id long, url string, key string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rule_table(spark, rules)).collect()}
    assert got == {i: brute_judge(u, rules) for i, u in enumerate(urls)}


@pytest.mark.parametrize("max_bits", [1 << 27, 1024])
def test_judge_urls_with_many_rules_of_many_shapes(spark, monkeypatch, max_bits):
    """Several hundred shapes plan at once; a list too large for one cascade is cut into some."""
    import random

    from tagweave.llm import url_filter

    monkeypatch.setattr(url_filter, "MAX_LEVEL_BITS", max_bits)
    rng = random.Random(3)
    hosts = [".".join(rng.choice("abcd") * rng.randint(1, 4) for _ in range(n)) + ".org" for n in range(1, 7) for _ in range(30)]
    paths = ["/" + "".join(rng.choice("xy/") for _ in range(m)) for m in range(60) for _ in range(3)]
    rules = sorted({(rng.choice(["allow", "block"]), h + p) for h in hosts for p in rng.sample(paths, 12)}, key=lambda r: r[1])
    rules = list({k: (v, k) for v, k in rules}.values())
    shapes = {(k.split("/", 1)[0].count("."), len(k.split("/", 1)[1])) for _, k in rules}
    assert len(shapes) > 250 and len(rules) > 1500
    if max_bits < 1 << 27:
        assert url_filter.cascade_count(len(rules), 5000) > 2
    urls = ["https://" + rng.choice(["", "w."]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "z", "?q"]) for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "verdict string, key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, table).collect()}
    assert got == {i: brute_judge(u, rules) for i, u in enumerate(urls)}
    assert sum(r[2] is not None for r in got.values()) > 50


def test_judge_urls_on_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(empty, rule_table(spark, [("block", "a.org/x")])).count() == 0
    assert judge_urls(empty, rule_table(spark, [])).count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(5000).selectExpr("concat('k', id) AS key")
    listed = spark.range(0, 5200, 13).selectExpr("concat('k', id) AS key")
    cascade = Cascade(listed, universe)
    assert len(cascade.levels) > 1
    from pyspark.sql import functions as F

    got = {r.key for r in universe.filter(cascade.holds(F.col("key"))).collect()}
    assert got == {f"k{i}" for i in range(0, 5000, 13)}


def brute_top(rows, k=5, every=50):
    out, vectors = [], {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors.setdefault((i, tuple(math.floor(256 * x) for x in v)))
    for i, v in vectors:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in vectors if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_top_products_brute(spark, spread):
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.normal(size=(8, 6))
    rows = []
    for i in range(400):
        v = base[i % 8] + 0.05 * rng.normal(size=6)
        v = v / np.linalg.norm(v) * math.exp(spread * rng.random())
        rows.append((i, [float(np.float32(x)) for x in v]))
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6), (None, [1.0] * 6),
             (2200, [0.0] * 6), (2250, [1.0, 2.0]), (50, rows[50][1])]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], "vec_id long, embedding array<float>, score double, rank int")
    got = sorted(map(tuple, top_products(df, query_block=4).collect()))
    assert got == brute_top([(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows])


def test_top_products_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert list(map(tuple, top_products(df).collect())) == [(0, 1, 1, 256 * 512)]
    assert top_products(df.limit(0)).count() == 0
