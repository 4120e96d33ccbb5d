"""Learners of the library against plain numpy: joint net, loss curve, multi-output trees,
leave-one-out ridge, path descent, adaptive search, draws with replacement."""

import itertools
import math

import numpy as np
import pytest

from tagweave.functions.seeded import MODULUS, MULTIPLIER
from tagweave.operators import hierarchy as hi
from tagweave.operators import nets
from tagweave.operators import resample as rs
from tagweave.operators import ridge
from tagweave.operators import search
from tagweave.operators import trees as tr

LABELS = ["a", "b", "c"]


def hashed(*values, seed=0):
    h = seed % MODULUS
    for v in values:
        h = ((h + v % MODULUS) * MULTIPLIER) % MODULUS
    return (h * h + 1) % MODULUS * MULTIPLIER % MODULUS


def table(n=300, d=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = (x @ rng.normal(size=(d, len(LABELS))) + 0.3 * rng.normal(size=(n, len(LABELS))) > 0).astype(float)
    return x, y


def frame(spark, x, y):
    rows = [(i, [float(v) for v in x[i]], [c for c, v in zip(LABELS, y[i]) if v]) for i in range(len(x))]
    return spark.createDataFrame(rows, "id long, features array<double>, labels array<string>")


def test_gradient_equals_differences():
    x, y = table(20, 4)
    y[0, 0] = np.nan  # a cell that doesn't count
    sizes = [4, 5, 3]
    theta = nets.init_weights(sizes, 1)
    g, loss = nets.gradient(theta, sizes, x, y)
    assert loss == pytest.approx(nets.losses(nets.forward(theta, sizes, x)[-1], y))
    for i in range(0, len(theta), 7):
        up, down = theta.copy(), theta.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        want = (nets.gradient(up, sizes, x, y)[1] - nets.gradient(down, sizes, x, y)[1]) / 2e-6
        assert g[i] == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("hidden", [(), (7,)])
def test_loss_curve_equals_a_numpy_run_on_the_same_order(spark, hidden):
    x, y = table()
    net = nets.JointNet(LABELS, hidden=hidden, alpha=0.01, rate=0.02, batch_size=60, max_epochs=6, stop_on=None, seed=3)
    model = net.fit(frame(spark, x, y))
    held = np.array([hashed(i, seed=3) % 1000 < 100 for i in range(len(x))])
    blocks = max(1, round((~held).sum() / 60))
    block = np.array([hashed(i, seed=4) % blocks for i in range(len(x))])
    sizes = [x.shape[1], *hidden, len(LABELS)]
    penal = np.concatenate([np.r_[np.ones(a * b), np.zeros(b)] for a, b in zip(sizes, sizes[1:])])
    theta, m, v, t, curve = nets.init_weights(sizes, 3), 0.0, 0.0, 0, []
    for epoch in range(1, 7):
        total = 0.0
        for b in np.random.default_rng([3, epoch]).permutation(blocks):
            at = ~held & (block == b)
            g, loss = nets.gradient(theta, sizes, x[at], y[at])
            g, t, total = (g + 0.01 * penal * theta) / at.sum(), t + 1, total + loss
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - 0.02 * math.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-8)
        p = nets.forward(theta, sizes, x[held])[-1]
        curve.append((epoch, total / (~held).sum() / 3, nets.losses(p, y[held]) / held.sum() / 3,
                      ((p >= 0.5) == (y[held] > 0)).all(1).mean()))
    assert np.allclose(model.curve, curve, atol=1e-9)
    assert curve[-1][1] < curve[0][1]
    assert np.allclose(model.theta, theta, atol=1e-9)


def test_partial_gradients_sum_in_groups(spark):
    x, y = table(200, 5)
    rows = frame(spark, x, y).selectExpr("features AS x", "transform(array('a', 'b', 'c'), v -> cast(array_contains(labels, v) AS double)) AS y")
    sizes = [5, 4, 3]
    theta = nets.init_weights(sizes, 2)
    want, loss = nets.gradient(theta, sizes, x, y)
    for parts in (1, 20):
        g, value, _, n, cells = nets.batch_totals(rows.repartition(parts), theta, sizes, True, parts)
        assert np.allclose(g, want) and value == pytest.approx(loss) and (n, cells) == (200, 600)


def test_an_epoch_of_many_steps_is_a_few_jobs(spark, monkeypatch):
    x, y = table(400)
    df = frame(spark, x, y)
    runs = []
    run_steps = nets.run_steps
    monkeypatch.setattr(nets, "run_steps", lambda rows, blocks, *a: runs.append(blocks) or run_steps(rows, blocks, *a))
    net = nets.JointNet(LABELS, hidden=(5,), rate=0.02, batch_size=10, max_epochs=2, stop_on=None)
    whole = net.fit(df)
    blocks = sorted(runs[0])
    assert len(runs) == 2 and blocks == list(range(len(blocks))) and len(blocks) > 20
    # the same steps in several runs, and with a job a step
    runs.clear()
    monkeypatch.setattr(nets, "RUN_BYTES", 10 * 10 * 8 * (6 + 3))
    cut = net.fit(df)
    assert 4 < len(runs) < 20 and runs[0] + runs[1] == net.block_order(1, len(blocks))[:len(runs[0] + runs[1])]
    monkeypatch.setattr(nets, "TASK_ROWS", 6)
    single = net.fit(df)
    for other in (cut, single):
        assert np.allclose(whole.theta, other.theta, atol=1e-9) and np.allclose(whole.curve, other.curve, atol=1e-9)


def test_early_stop_keeps_the_best_epoch(spark):
    x, y = table(200)
    y[:] = np.random.default_rng(1).random(y.shape) < 0.5  # nothing to learn
    net = nets.JointNet(LABELS, hidden=(16,), rate=0.05, batch_size=50, max_epochs=60, patience=3, stop_on="loss")
    model = net.fit(frame(spark, x, y))
    best = min(model.curve, key=lambda c: c[2])
    assert len(model.curve) < 60 and len(model.curve) - best[0] >= 3
    # null features take no part in training and have no scores
    df = frame(spark, x[:3], y[:3]).selectExpr("id", "CASE WHEN id > 0 THEN features END AS features", "labels")
    got = {r.id: r.scores for r in model.transform(df).collect()}
    assert got[0] is None and np.allclose(got[2], model.probabilities(x[2:3])[0])


def naive_tree(x, y, how, tree=0, node=1):
    """Every candidate cut tried by its own masks; {node: (feature, cut) or shares}."""
    n, s = len(x), y.sum(0)
    if ((s == 0) | (s == n)).all() or n < 2 or node.bit_length() > how.max_depth:
        return {node: s / n}
    tried, cuts = how.candidates(tree, node, x.min(0), x.max(0))
    best = None
    for f, row in zip(tried, cuts):
        for cut in row:
            cost = 0.0
            for part in (y[x[:, f] <= cut], y[x[:, f] > cut]):
                p = part.mean(0)
                cost += len(part) * (p * (1 - p)).sum()
            if best is None or round(cost, 9) < best[0]:
                best = (round(cost, 9), int(f), float(cut))
    if best is None:
        return {node: s / n}
    left = x[:, best[1]] <= best[2]
    return {node: best[1:], **naive_tree(x[left], y[left], how, tree, 2 * node), **naive_tree(x[~left], y[~left], how, tree, 2 * node + 1)}


@pytest.mark.parametrize("kind", ["tree", "extra"])
@pytest.mark.parametrize("local_rows", [10_000, 25])
def test_trees_equal_a_naive_one_wherever_nodes_are_grown(spark, kind, local_rows):
    x, y = table(160, 9)
    x[:, 4] = 1.0  # never varies
    learner = tr.MultiOutputTrees(LABELS, kind, trees=2, local_rows=local_rows, seed=5)
    model = learner.fit(frame(spark, x, y))
    for t, tree in enumerate(model.trees):
        want = naive_tree(x, y, learner.growth(9), t)
        assert tree.nodes.tolist() == sorted(k for k, v in want.items() if isinstance(v, tuple))
        for node, f, cut in zip(tree.nodes, tree.features, tree.cuts):
            assert want[node] == (f, cut)
        assert all(np.allclose(want[k], v) for k, v in zip(tree.leaves, tree.values))
    out = {r.id: r for r in model.transform(frame(spark, x, y)).collect()}
    if kind == "tree":
        assert all(set(r.pred_labels) == set(r.labels) for r in out.values())
    assert np.allclose(out[7].scores, sum(t.predict(x[7:8])[0] for t in model.trees) / 2)


def test_equal_rows_and_one_class_make_leaves(spark):
    x, y = np.ones((6, 2)), np.zeros((6, 3))
    y[:2, 0] = 1
    model = tr.MultiOutputTrees(LABELS, "extra").fit(frame(spark, x, y))
    assert model.trees[0].leaves.tolist() == [1] and np.allclose(model.trees[0].values, [[1 / 3, 0, 0]])
    with pytest.raises(ValueError, match="no training rows"):
        tr.MultiOutputTrees(LABELS).fit(frame(spark, x[:0], y[:0]))


def test_leave_one_out_errors_equal_refits(spark):
    x, y = table(60, 4)
    t, alphas = 2 * y - 1, (0.1, 3.0, 200.0)
    model = ridge.fit_ridge(frame(spark, x, y).repartition(5), LABELS, alphas)

    def fit(xs, ts, a):
        mx, mt = xs.mean(0), ts.mean(0)
        w = np.linalg.solve((xs - mx).T @ (xs - mx) + a * np.eye(xs.shape[1]), (xs - mx).T @ (ts - mt))
        return w, mt - mx @ w

    for a, errors in zip(alphas, model.label_errors):
        want = np.zeros(3)
        for i in range(len(x)):
            rest = np.arange(len(x)) != i
            w, b = fit(x[rest], t[rest], a)
            want += (t[i] - x[i] @ w - b) ** 2
        assert np.allclose(errors, want / len(x))
    assert model.alpha == alphas[int(np.argmin(model.errors))]
    w, b = fit(x, t, model.alpha)
    assert np.allclose(model.weights, w) and np.allclose(model.intercepts, b)
    for r in model.transform(frame(spark, x, y)).collect():
        assert np.allclose(r.scores, x[r.id] @ w + b) and set(r.pred_labels) == {c for c, s in zip(LABELS, r.scores) if s > 0}


EDGES = [("__root__", "A"), ("__root__", "B"), ("A", "C"), ("A", "D"), ("B", "D"), ("B", "E"), ("D", "F"), ("D", "G")]


def test_descent_equals_all_paths():
    order = hi.topological(EDGES)
    rng = np.random.default_rng(0)
    local = rng.random((200, len(EDGES)))
    path, kept = hi.descend(local, EDGES, order, 0.35)
    kids = {}
    for e, (p, c) in enumerate(EDGES):
        kids.setdefault(p, []).append((e, c))

    def paths(node):
        yield (node,)
        for _, c in kids.get(node, ()):
            yield from ((node, *rest) for rest in paths(c))

    forced_somewhere = False
    for i in range(len(local)):
        best = {}
        for walk in paths("__root__"):
            value = math.prod([local[i, EDGES.index((a, b))] for a, b in itertools.pairwise(walk)])
            best[walk[-1]] = max(best.get(walk[-1], 0.0), value)
        assert np.allclose(path[i], [best[n] for n in order])
        want = set()
        todo = ["__root__"]
        while todo:  # from every kept node on: children at the threshold, else the likeliest one
            node = todo.pop()
            if node in want:
                continue
            want.add(node)
            if node in kids:
                reached = [c for _, c in kids[node] if best[c] >= 0.35]
                forced_somewhere |= not reached
                todo += reached or [max(kids[node], key=lambda ec: local[i, ec[0]])[1]]
        assert {n for n, k in zip(order, kept[i]) if k} == want
        assert any(n in want for n in ("C", "E", "F", "G"))
    assert forced_somewhere
    with pytest.raises(ValueError, match="cycle"):
        hi.topological([("__root__", "A"), ("A", "B"), ("B", "A")])


def test_path_descent_learns_edges_on_rows_of_their_parents_only(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        labels = [["A", "C"], ["B", "E"], ["A", "B", "D", "F"]][i % 3]
        x = [float(v) + 0.1 * rng.normal() for v in np.eye(3)[i % 3]]
        rows.append((i, x, labels))
    df = spark.createDataFrame(rows, "id long, features array<double>, labels array<string>")
    model = hi.PathDescent(EDGES, hidden=(), rate=0.2, max_epochs=12, batch_size=120, stop_on=None).fit(df)
    out = model.transform(df).collect()
    assert all(set(r.pred_labels) == set(r.labels) for r in out)
    # G never occurs: its edge is learned from rows that hold D, and stays below the threshold
    assert all(r.path_scores[model.order.index("G") - 1] < 0.35 for r in out)


def test_search_prefers_the_valley_and_spends_full_budgets_on_survivors():
    calls = []

    def score(values, budget):
        calls.append((len(values), budget))
        return [(math.log10(v) - 1.5) ** 2 + 0.01 * budget for v in values]

    found = search.tune(score, 1e-3, 1e4, 24, seed=7, budgets=(0.25, 1.0))
    assert [t.trial for t in found] == list(range(24)) and all(1e-3 <= t.value <= 1e4 for t in found)
    assert calls == [(4, 0.25), (2, 1.0)] * 6
    best = [t for t in found if t.best]
    assert len(best) == 1 and best[0].score == min(t.score for t in found if t.budget == 1.0)
    late = np.mean([abs(math.log10(t.value) - 1.5) for t in found[12:]])
    assert late < np.mean([abs(math.log10(t.value) - 1.5) for t in found[:4]])
    again = search.tune(score, 1e-3, 1e4, 24, seed=7, budgets=(0.25, 1.0))
    assert [t.value for t in again] == [t.value for t in found]


def test_proposals_follow_the_density_ratio():
    """A proposal is the candidate with the largest ratio, by a plain double loop."""
    seen = [search.Trial(i, 10.0**e, 1.0, abs(e - 1)) for i, e in enumerate(np.linspace(-2, 3, 10))]
    got = search.propose(seen, 1e-3, 1e4, 1, np.random.default_rng(1))[0]
    a, b = math.log(1e-3), math.log(1e4)
    ranked = sorted(seen, key=lambda t: t.score)
    good, rest = [math.log(t.value) for t in ranked[:3]], [math.log(t.value) for t in ranked[3:]]
    rng = np.random.default_rng(1)
    x = rng.choice(good, search.CANDIDATES) + (b - a) / 3 * rng.standard_normal(search.CANDIDATES)
    x = np.clip(x, a, b)
    x[-search.CANDIDATES // 6:] = rng.uniform(a, b, search.CANDIDATES // 6)

    def mix(v, centres):
        width = (b - a) / len(centres)
        bumps = sum(math.exp(-0.5 * ((v - c) / width) ** 2) / (width * math.sqrt(2 * math.pi)) for c in centres)
        return (bumps + 1 / (b - a)) / (len(centres) + 1)

    assert math.log(got) == pytest.approx(max(x, key=lambda v: mix(v, good) / mix(v, rest)))


def test_draws_are_exact_and_seeded(spark, monkeypatch):
    monkeypatch.setattr(rs, "DRAW_CHUNK", 100)
    plan = spark.createDataFrame([("x", 1234, 7, 1), ("y", 0, 5, 1), ("z", 99, 1000, 2)], "k string, n_add long, n_min long, seed long")
    got = {(r.k, r["rank"]): r.copies for r in rs.drawn_counts(plan, ["k"]).collect()}
    want = {}
    for k, n, m, seed in (("x", 1234, 7, 1), ("z", 99, 1000, 2)):
        for i in range(n):
            rank = (hashed(seed, i, seed=1) * MODULUS + hashed(seed, i, seed=2)) % m
            want[k, rank] = want.get((k, rank), 0) + 1
    assert got == want and sum(v for (k, _), v in got.items() if k == "x") == 1234
    assert len({v for (k, _), v in got.items() if k == "x"}) > 1  # draws vary, even copies wouldn't


def test_oversampled_rows_hold_exactly_the_drawn_copies(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(500)], "id long, y int")
    out = rs.oversample_random(df, "y", 0.5, seed=9).collect()
    assert sum(r.y for r in out) == 225 and sum(1 - r.y for r in out) == 450
    times = {}
    for r in out:
        times[r.id] = times.get(r.id, 0) + 1
    ids = sorted(i for i in range(500) if i % 10 == 0)
    want = dict.fromkeys(range(500), 1)
    for i in range(175):
        want[ids[(hashed(9, i, seed=1) * MODULUS + hashed(9, i, seed=2)) % 50]] += 1
    assert times == want


def test_catalog_reads_only_the_asked_split(spark, tmp_path):
    from pyspark.sql import functions as F

    from tagweave.plans.q_sources import write_catalog_files
    from tagweave.sources.catalog import dataset_catalog
    from tests.conftest import SF_SMALL

    root = str(tmp_path)
    write_catalog_files(spark, SF_SMALL, root)
    cat = dataset_catalog(root)
    assert len(cat.names()) == 9
    df = cat.load(spark, "semeval2024_test_set_unlabeled")
    dev = df.filter(F.col("split") == "test")
    assert dev._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert all("test_unlabeled" in f for f in dev.inputFiles())
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 3
    ids = {int(r.id) % 8 for r in df.filter("split = 'train'").collect()}
    assert ids == {0, 1}


def test_json_arrays_of_no_rows_and_several_batches(spark, tmp_path):
    from tagweave.sources import io

    df = spark.range(25_000).selectExpr("cast(id AS string) AS id", "concat('line 1\n\"', id) AS text", "array('a', 'b') AS labels").coalesce(1)
    io.write_json_array(df, f"{tmp_path}/a")
    back = io.read_json_records(spark, f"{tmp_path}/a")
    assert back.count() == 25_000 and back.exceptAll(df).isEmpty()
    io.write_json_array(df.limit(0), f"{tmp_path}/b")
    assert io.read_json_records(spark, f"{tmp_path}/b").count() == 0


def test_sketched_quantiles_keep_the_rank_error(spark):
    from pyspark.sql import functions as F

    from tagweave.operators import metrics as m

    df = spark.range(60_000).select((F.col("id") % 2).alias("g"), ((F.col("id") * 48271) % 65_537).cast("double").alias("v"))
    probs = [0.01, 0.1, 0.5, 0.9, 0.99]
    q = m.sketch_quantiles(df.repartition(12), "v", probs, ["g"])
    rows = m.rank_errors(df, q, "v", ["g"]).collect()
    assert len(rows) == 10 and max(r.rank_error for r in rows) < 2 * m.SKETCH_ERROR
    few = df.filter("id < 20")
    exact = {(r.g, r.p): r.rank_error for r in m.rank_errors(few, m.sketch_quantiles(few, "v", probs, ["g"]), "v", ["g"]).collect()}
    assert all(e < 0.06 for e in exact.values())  # one row of ten, half a step


def test_hidden_states_of_a_model_from_its_file(spark, tmp_path):
    from tagweave.operators import pooling as pl

    rng = np.random.default_rng(0)
    table, scale, mixing = rng.normal(size=(7, 3)), np.array([0.5]), np.array([2.0])
    pl.store_weights(spark, f"{tmp_path}/w", table=table, scale=scale, mixing=mixing)
    rows = [("a", [1, 2, 3, 0], [1, 1, 1, 0]), ("b", [0, 0, 0, 0], [0, 0, 0, 0])]
    df = spark.createDataFrame(rows, "id string, input_ids array<int>, attention_mask array<int>")
    got = pl.hidden_states(df, pl.load_weights(spark, f"{tmp_path}/w"), pl.TokenMixer, 4, 2).collect()
    want = {}
    for i, ids, mask in rows:
        h = table[ids] * np.array(mask)[:, None]
        want |= {(i, 0, t): h[t] for t in range(4)}
        h = (h * 0.5 + h.sum(0) / max(sum(mask), 1e-9) * 2.0) * np.array(mask)[:, None]
        want |= {(i, 1, t): h[t] for t in range(4)}
    assert len(got) == 16
    for r in got:
        assert np.allclose(r.vec, want[r.id, r.layer, r.token]) and r.mask == (r.id == "a" and r.token < 3)


def test_author_is_the_leftmost_form(spark):
    from pyspark.sql import functions as F

    from tagweave.functions import text as tf

    rows = [('\\"first said\\" then — Ann Dash',), ('— Ann \\"first said\\"',), ("one — two\nthree",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(tf.author(F.col("t"))).collect()]
    assert got == ["first said", 'Ann \\"first said\\"', None, None]


def test_viterbi_equals_all_tag_sequences():
    from tagweave.operators import tagger as tg

    rng = np.random.default_rng(3)
    w = tg.Weights(rng.normal(size=tg.Weights.SIZE))
    words = tg.TOKEN.findall("Ann met Bo Lind, who left.")
    feats = tg.features(words)
    scores = w.emit[feats].sum(1)

    def value(tags):
        if tags[0] == 2 or any(a == 0 and b == 2 for a, b in itertools.pairwise(tags)):
            return -math.inf
        return sum(scores[i, t] for i, t in enumerate(tags)) + sum(w.move[a, b] for a, b in itertools.pairwise(tags))

    best = max(itertools.product(range(3), repeat=len(words)), key=value)
    assert w.decode(feats).tolist() == list(best)


def test_tagger_learns_single_names_on_held_out_documents(spark):
    from pyspark.sql import functions as F

    from tagweave.operators import tagger as tg
    from tagweave.plans.q_text import mention_rule, mention_tags
    from tests.conftest import SF_ORACLE

    assert tg.spans("Ann met Bo Lind . He left".split(), mention_rule("Ann met Bo Lind . He left".split())) == ["Bo Lind"]
    total = mention_tags(spark, SF_ORACLE).agg(*[F.sum(c).alias(c) for c in ("n_rule", "n_found", "n_agree")]).first()
    assert 2 * total.n_agree / (total.n_rule + total.n_found) > 0.95
    none = spark.createDataFrame([(1, None), (2, "")], "id long, text string")
    weights = tg.fit_tagger(none, mention_rule)
    assert not weights.any() and [r.mentions for r in tg.tag_mentions(none, weights).collect()] == [[], []]


def test_decode_and_epochs_as_a_plain_loop(spark):
    """One task, or many whose weights are summed in groups, against plain arrays."""
    from pyspark.sql import functions as F

    from tagweave.operators import tagger as tg
    from tagweave.plans.q_text import mention_rule

    rng = np.random.default_rng(5)
    w = tg.Weights(rng.integers(-1, 2, tg.Weights.SIZE).astype(float))  # small integers: many ties
    names = ["Ann", "Bo", "met", "the", "Lind", ".", "x1", "USA", "!"]
    texts = [" ".join(rng.choice(names, rng.integers(1, 12))) for _ in range(120)]

    def viterbi(m, feats):
        scores, move = m.emit[feats].sum(axis=1), np.where(tg.ALLOWED, m.move, -np.inf)
        best, back = np.where(tg.ALLOWED[0], scores[0], -np.inf), []
        for s in scores[1:]:
            paths = best[:, None] + move
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + s
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    for t in texts:
        feats = tg.features(t.split())
        assert w.decode(feats).tolist() == viterbi(w, feats)

    docs = spark.createDataFrame([(i % 20, t) for i, t in enumerate(texts)], "part long, text string").repartitionByRange(20, "part")
    parts = [[r.text for r in p] for p in docs.rdd.glom().collect()]
    flat = np.zeros(tg.Weights.SIZE)
    for _ in range(3):
        lasts, total, lines = [], 0.0, 0
        for p in filter(None, parts):
            m = tg.Weights(flat.copy())
            for t in p:
                feats, gold = tg.features(t.split()), mention_rule(t.split())
                found = viterbi(m, feats)
                if found != gold:
                    m.add(feats, np.array(gold), 1.0)
                    m.add(feats, np.array(found), -1.0)
                total, lines = total + m.flat, lines + 1
            lasts.append(m.flat)
        flat, average = sum(lasts) / len(lasts), total / lines
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("tagger-epochs", "")
    got = tg.fit_tagger(docs, mention_rule, epochs=3)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert np.allclose(got, average, atol=1e-9)
    assert len(jobs.getJobIdsForGroup("tagger-epochs")) < 20  # not a job a partition


def _plain_mention_rule(words):
    names = [len(w) > 1 and w[0].isupper() and w[1:].islower() for w in words]
    tags, last = [], 0
    for before, name, after in zip(["."] + words, names, names[1:] + [False]):
        last = 0 if not name or (before in ".!?" and not after) else 2 if last else 1
        tags.append(last)
    return tags


def _mention_texts(rng, n):
    words = ["Ann", "Bo", "met", "the", "Lind", "Éva", "x1", "USA", "a", ".", "!", "don't", "Über-cool", "<", "(so)", "12", "A"]
    return ["\n".join(" ".join(rng.choice(words, rng.integers(0, 30))) for _ in range(rng.integers(0, 6))) + "\n" * (k % 3) for k in range(n)]


def test_blocks_of_lines_say_what_single_lines_say(monkeypatch):
    from tagweave.operators import tagger as tg
    from tagweave.plans.q_text import mention_rule

    texts = [None, "", " \n ", *_mention_texts(np.random.default_rng(2), 80), "One\n\nTwo. Three Four"]
    lines = [(k, w) for k, t in enumerate(texts) for w in map(tg.TOKEN.findall, (t or "").split("\n")) if w]
    monkeypatch.setattr(tg, "CACHED_WORDS", 10)
    for chars in (1 << 18, 100, 7):  # long texts are cut between lines
        monkeypatch.setattr(tg, "BLOCK_CHARS", chars)
        found = []
        for block, marks, words, text in tg.blocks(texts, mention_rule.mark):
            tags, feats = tg.rule_tags(mention_rule, marks, words, block.starts), block.features()
            assert tags.tolist() == tg.rule_tags(_plain_mention_rule, marks, words, block.starts).tolist()
            for a, b, k in zip(block.starts, block.starts[1:], text):
                found.append((k, words[a:b]))
                assert tags[a:b].tolist() == _plain_mention_rule(words[a:b]) == mention_rule(words[a:b])
                shapes = ["<", "<", *map(tg.shape, words[a:b]), ">"]
                for w, row, f, x, o, y in zip(words[a:b], feats[a:b].tolist(), shapes, shapes[1:], shapes[2:], shapes[3:]):
                    assert row == [tg._place(m) for m in (f"0{o}", f"1{x}|{o}", f"2{o}|{y}", f"3{x}|{o}|{y}", f"4{w.lower()}", f"5{f}|{x}|{o}")]
        assert found == lines
        assert tg.rule_mentions(texts, mention_rule) == [[m for i, w in lines if i == k for m in tg.spans(w, _plain_mention_rule(w))] for k in range(len(texts))]
    assert mention_rule([]) == []


def test_epochs_read_numbers_and_decode_what_is_not_proven(spark, monkeypatch):
    """A rule is asked once a line, not once an epoch; learned lines aren't decoded; the weights are those of a loop over the lines."""
    from tagweave.operators import tagger as tg

    rng = np.random.default_rng(4)
    asked = spark.sparkContext.accumulator(0)

    def rule(words):
        asked.add(1)
        return _plain_mention_rule(words)

    docs = spark.createDataFrame([(t,) for t in _mention_texts(rng, 60)], "text string")
    lines = sum(1 for r in docs.collect() for line in r.text.split("\n") if line.strip())
    tg.fit_tagger(docs, rule)
    assert asked.value == lines

    decoded, best = [], tg.Weights.best
    monkeypatch.setattr(tg.Weights, "best", lambda self, scores: decoded.append(1) or best(self, scores))
    texts = _mention_texts(rng, 1500)
    made = [(b, b.features(), np.array(tg.rule_tags(_plain_mention_rule, m, w, b.starts))) for b, m, w, _ in tg.blocks(texts)]
    odd = [(b, f, np.where(rng.random(len(g)) < 0.02, rng.integers(0, 3, len(g)), g)) for b, f, g in made]  # tags that no decoding gives, too
    start = np.zeros(tg.Weights.SIZE)
    for rows in (odd, made, made, made):
        decoded.clear()
        learner, w, late, n, mistakes = tg.Learner(start.copy()), tg.Weights(start.copy()), tg.Weights(), 0, 0
        for block, feats, gold in rows:
            learner.learn(feats, gold, block.starts)
        few = len(decoded)
        for block, feats, gold in rows:
            for a, b in zip(block.starts, block.starts[1:]):
                found = w.decode(feats[a:b])
                if (found != gold[a:b]).any():
                    mistakes += 1
                    for target, step in ((w, 1.0), (late, float(n))):
                        target.add(feats[a:b], gold[a:b], step)
                        target.add(feats[a:b], found, -step)
                n += 1
        assert learner.lines == n and (learner.weights.flat == w.flat).all() and (learner.late.flat == late.flat).all()
        start = w.flat / 7  # no whole numbers
    assert mistakes < few < n // 2


def test_a_cell_of_neighbours_holds_little():
    import tracemalloc

    import pandas as pd

    from tagweave.operators import neighbours as nb

    rng = np.random.default_rng(0)
    q = pd.DataFrame({"qid": range(1500), "qv": list(rng.normal(size=(1500, 16)))})
    r = pd.DataFrame({"nid": range(1500), "rv": list(rng.normal(size=(1500, 16)))})
    own = nb._prepared(r)
    tracemalloc.start()
    n = sum(len(part) for part in nb._cell(nb._Nearest(5), False, [])(q, r, *own))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 7500 and peak < 24 << 20
