"""DuckDB forms of the derived fixtures, shared by the oracle SQL strings.

Each oracle is ``WITH RECURSIVE <prelude>, <own ctes> SELECT ...``; DuckDB
skips CTEs that a query does not reference.
"""

from __future__ import annotations

from tagweave.functions.seeded import seeded_int_sql
from tagweave.fixed import EVENT_CATEGORIES, LEAVES, ROOT, TAXONOMY_EDGES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


EDGES = "edges(parent, child) AS (VALUES " + ", ".join(f"({q(p)}, {q(c)})" for p, c in TAXONOMY_EDGES) + ")"
LEAVES_CTE = "leaves(j, label) AS (VALUES " + ", ".join(f"({j}, {q(x)})" for j, x in enumerate(LEAVES)) + ")"
CATS = "cats(label, category) AS (VALUES " + ", ".join(f"({q(a)}, {q(b)})" for a, b in EVENT_CATEGORIES) + ")"

GOLD_RULE = "(dl.doc_id * (2 * dl.j + 3) + dl.j * dl.j) % 11 = 0"
PRED_RULE = f"(({GOLD_RULE}) AND (dl.doc_id + dl.j) % 4 <> 0) OR (dl.doc_id * (dl.j + 5) + 2 * dl.j) % 23 = 0"

PRELUDE = ",\n".join([
    EDGES,
    LEAVES_CTE,
    CATS,
    f"nodes(node) AS (SELECT parent FROM edges WHERE parent <> {q(ROOT)} UNION SELECT child FROM edges)",
    "anc(node, ancestor, distance) AS (SELECT child, parent, 1 FROM edges "
    "UNION ALL SELECT a.node, e.parent, a.distance + 1 FROM anc a JOIN edges e ON e.child = a.ancestor)",
    "ancall AS (SELECT node, ancestor, min(distance) AS distance FROM anc GROUP BY node, ancestor)",
    f"ancpairs AS (SELECT * FROM ancall WHERE ancestor <> {q(ROOT)})",
    "clo(node, ancestor) AS (SELECT node, node FROM nodes UNION SELECT node, ancestor FROM ancpairs)",
    "dl AS (SELECT doc_id, unnest(range(0, 22)) AS j FROM documents)",
    f"gold AS (SELECT dl.doc_id, dl.j, l.label FROM dl JOIN leaves l ON l.j = dl.j WHERE {GOLD_RULE})",
    f"pred AS (SELECT dl.doc_id, dl.j, l.label FROM dl JOIN leaves l ON l.j = dl.j WHERE {PRED_RULE})",
    "goldc AS (SELECT DISTINCT g.doc_id, c.ancestor AS label FROM gold g JOIN clo c ON c.node = g.label)",
    "predc AS (SELECT DISTINCT p.doc_id, c.ancestor AS label FROM pred p JOIN clo c ON c.node = p.label)",
    "pairs AS (SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, coalesce(g.label, p.label) AS label, "
    "CASE WHEN g.doc_id IS NULL THEN 0 ELSE 1 END AS g, CASE WHEN p.doc_id IS NULL THEN 0 ELSE 1 END AS p "
    "FROM gold g FULL OUTER JOIN pred p ON g.doc_id = p.doc_id AND g.label = p.label)",
    "lcounts AS (SELECT label, CAST(sum(g * p) AS BIGINT) AS tp, CAST(sum((1 - g) * p) AS BIGINT) AS fp, "
    "CAST(sum(g * (1 - p)) AS BIGINT) AS fn FROM pairs GROUP BY label)",
    "conf AS (SELECT l.label, CAST((SELECT count(*) FROM documents) - coalesce(c.tp, 0) - coalesce(c.fp, 0) "
    "- coalesce(c.fn, 0) AS BIGINT) AS tn, coalesce(c.fp, 0) AS fp, coalesce(c.fn, 0) AS fn, "
    "coalesce(c.tp, 0) AS tp FROM leaves l LEFT JOIN lcounts c ON c.label = l.label)",
    "gsets AS (SELECT d.doc_id, coalesce(string_agg(g.label, '|' ORDER BY g.label), '') AS gold "
    "FROM documents d LEFT JOIN gold g ON g.doc_id = d.doc_id GROUP BY d.doc_id)",
    "psets AS (SELECT d.doc_id, coalesce(string_agg(p.label, '|' ORDER BY p.label), '') AS pred "
    "FROM documents d LEFT JOIN pred p ON p.doc_id = d.doc_id GROUP BY d.doc_id)",
    # FX2 features
    "feat AS (SELECT vec_id, CASE WHEN vec_id % 10 < 8 THEN 'train' WHEN vec_id % 10 = 8 THEN 'dev' "
    "ELSE 'test' END AS split, embedding, label FROM embeddings)",
    "featlab AS (SELECT vec_id, split, CAST(label AS VARCHAR) AS lab FROM feat UNION "
    "SELECT vec_id, split, CAST((label + 1) % 10 AS VARCHAR) FROM feat WHERE vec_id % 3 = 0)",
    # FX14 learnable labels: by the rule, and as given (noisy in the dev split)
    f"cells AS (SELECT f.vec_id, f.split, l.j, l.label AS lab, ({seeded_int_sql(['f.vec_id', 'l.j'], 14)} % 10 < 3 "
    f"OR (f.vec_id // 10) % 10 = l.j) AS has, f.split = 'dev' AND {seeded_int_sql(['f.vec_id', 'l.j'], 15)} % 10 = 0 AS flip "
    "FROM feat f JOIN leaves l ON l.j < 10)",
    "rulelab AS (SELECT vec_id, split, lab FROM cells WHERE has)",
    "planted AS (SELECT vec_id, split, lab FROM cells WHERE has <> flip)",
    "moved AS (SELECT f.vec_id, f.split, list_transform(range(0, 64), lambda k: CAST(f.embedding[k + 1] AS DOUBLE) + "
    "CASE WHEN c.has[k % 10 + 1] THEN 1.0 ELSE -1.0 END) AS x FROM feat f JOIN "
    "(SELECT vec_id, list(has ORDER BY j) AS has FROM cells GROUP BY vec_id) c ON c.vec_id = f.vec_id)",
    # FX3 hidden states
    "hidden AS (SELECT vec_id, lt // 4 AS layer, lt % 4 AS token, "
    "CASE WHEN lt % 4 < vec_id % 4 + 1 THEN 1 ELSE 0 END AS mask, lt, embedding "
    "FROM (SELECT vec_id, embedding, unnest(range(0, 8)) AS lt FROM embeddings))",
    "hidden_long AS (SELECT vec_id, layer, token, mask, u AS dim, CAST(embedding[lt * 8 + u + 1] AS DOUBLE) AS x "
    "FROM (SELECT *, unnest(range(0, 8)) AS u FROM hidden))",
    # FX5 one-hot, FX6 runs
    "evc AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type)",
    "onehot AS (SELECT user_id, "
    + ", ".join(f"max(CASE WHEN event_type = '{t}' AND n % 3 = 0 THEN 1 ELSE 0 END) AS {t}"
                for t in ("click", "error", "purchase", "signup", "view"))
    + " FROM evc GROUP BY user_id)",
    "runs AS (SELECT user_id % 12 AS experiment, event_type AS label, (count(*) % 5) / CAST(5.0 AS DOUBLE) AS f1 "
    "FROM events GROUP BY user_id % 12, event_type)",
    # FX7 corpus
    "glist AS (SELECT doc_id, string_agg(CAST(j AS VARCHAR), ',' ORDER BY j) AS labs FROM gold GROUP BY doc_id)",
    "corpus AS (SELECT d.doc_id, CASE WHEN d.doc_id % 41 = 0 THEN NULL ELSE d.text END AS text, "
    "CASE WHEN d.doc_id % 37 = 0 THEN NULL ELSE coalesce(gl.labs, '') END AS label "
    "FROM documents d LEFT JOIN glist gl ON gl.doc_id = d.doc_id)",
    # FX9 quotes, FX11 social
    "quotes AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || ' — ' || role ELSE text END AS text "
    "FROM conversations)",
    "social AS (SELECT conv_id, turn, text || ' @user' || CAST(conv_id AS VARCHAR) || ' https://x.example/' "
    "|| CAST(turn AS VARCHAR) || ' can’t …' AS text FROM conversations)",
    # FX10 submission (long form; empty label sets have no rows)
    "sub_ids AS (SELECT doc_id FROM documents WHERE doc_id % 97 <> 0 UNION ALL "
    "SELECT doc_id + 1000000 FROM documents WHERE doc_id % 89 = 0)",
    "sub_long AS (SELECT p.doc_id, p.label FROM pred p WHERE p.doc_id % 97 <> 0 UNION ALL "
    "SELECT p.doc_id + 1000000, p.label FROM pred p WHERE p.doc_id % 89 = 0 UNION ALL "
    "SELECT doc_id, 'Unknown' FROM sub_ids WHERE doc_id % 50 = 0)",
    # FX12 losses, FX13 splits
    "losses AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) / len(embedding) * 3 AS loss FROM embeddings)",
    "dsplit AS (SELECT *, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'validation' "
    "ELSE 'dev' END AS split FROM documents)",
])


def sql(body_ctes: str | None, select: str) -> str:
    """Assemble an oracle query: prelude, optional extra CTEs, final SELECT."""
    parts = PRELUDE if not body_ctes else PRELUDE + ",\n" + body_ctes
    return f"WITH RECURSIVE {parts}\n{select}"
