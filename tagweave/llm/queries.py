"""One query per operator over its whole table, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tagweave.llm.audit import audit_filters
from tagweave.llm.bpe import token_digests
from tagweave.llm.common import LOWER, UPPER, read_table
from tagweave.llm.exact_dedup import exact_dedup
from tagweave.llm.langid import fit_languages, identify
from tagweave.llm.line_dedup import SHINGLE, line_digests
from tagweave.llm.manifest import verify_documents
from tagweave.llm.mixing import mix
from tagweave.llm.near_dedup import near_duplicates
from tagweave.llm.quality import fit_quality, score_quality
from tagweave.llm.sharding import LARGEST_PIECE_PARTS, PIECE_PARTS, shard_documents
from tagweave.llm.token_files import token_index
from tagweave.llm.topk import top_products
from tagweave.llm.url_filter import judge_urls, rule_table
from tagweave.llm.registry import ORACLE, QUERIES, register

__all__ = ["ORACLE", "QUERIES"]


@register("op10_exact_dedup", f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256,
                  translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g ON g.norm = d.norm""")
def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(read_table(spark, sf_dir, "documents"))


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::HUGEINT AS weight FROM s),
-- by size over weight, the capped sources come first: source i is capped if the
-- share of those from i on, after the caps before it, is above its own cap
o AS (SELECT *, sum(source_size) OVER () AS total,
             coalesce(sum(3 * source_size) OVER (ORDER BY source_size::DOUBLE / weight, source
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
             sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w),
c AS (SELECT *, weight * (total - caps) > 3 * source_size * weights AS capped FROM o),
l AS (SELECT any_value(total) - coalesce(sum(3 * source_size) FILTER (capped), 0) AS words,
             sum(weight) FILTER (NOT capped) AS weights FROM c),
t AS (SELECT source, source_size::BIGINT AS source_size,
             CASE WHEN capped THEN (3 * source_size)::DOUBLE
                  ELSE (weight * words)::DOUBLE / (l.weights)::DOUBLE END AS target FROM c, l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
             floor(t.target + 0.5)::BIGINT AS budget
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM p)
SELECT doc_id, size, source_size, target,
       (size * whole + greatest(0, least(size, budget - whole * source_size - before)))::BIGINT AS taken FROM e"""


@register("op9_mix_sources", MIX_SQL)
def op9_mix_sources(spark, sf_dir):
    return mix(read_table(spark, sf_dir, "documents"))


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
             ("block", "com/de/")]

URL_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                                THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM u),
r(verdict, host, path) AS (VALUES {", ".join(f"('{v}', '{k.split('/', 1)[0]}', '/{k.split('/', 1)[1]}')" for v, k in URL_RULES)}),
m AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
             row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC) AS n
      FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1"""


@register("op8_url_filter", URL_SQL)
def op8_url_filter(spark, sf_dir):
    return judge_urls(read_table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


#: Tokenizer file of the queries.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@register("op6_bpe")
def op6_bpe(spark, sf_dir):
    return token_digests(read_table(spark, sf_dir, "documents"), TOKENIZER)


@register("op7_token_files")
def op7_token_files(spark, sf_dir):
    return token_index(read_table(spark, sf_dir, "documents"), TOKENIZER)


@register("op5_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op5_topk(spark, sf_dir):
    return top_products(read_table(spark, sf_dir, "embeddings"))


@register("op3_quality")
def op3_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))


@register("op2_language_id")
def op2_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, fit_languages(docs)).select("doc_id", "held_out", "lang_pred", "score")


@register("op4_near_dedup")
def op4_near_dedup(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "documents"))


@register("op1_line_dedup")
def op1_line_dedup(spark, sf_dir):
    return line_digests(read_table(spark, sf_dir, "documents"), min_chars=SHINGLE)


AUDIT_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT w.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
             map {'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
                  'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
                  'E': coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)} AS f
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: f[x]) AS fails, count(*) AS n,
             count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM s a, s b, s c, s d, s e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
q AS (SELECT filter_order, k::INTEGER AS step, filter_order[k] AS x, string_split(filter_order[1:k - 1], '') AS earlier
      FROM o, range(1, 6) r(k)),
j AS (SELECT part, filter_order, step, x, n, good, toxic, list_contains(fails, x) AS hit, list_has_any(fails, earlier) AS gone,
             fails = [x] AS alone FROM c, q),
g AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost FROM j GROUP BY ALL)
SELECT * EXCLUDE (x), sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley FROM g"""


@register("op11_filter_audit", AUDIT_SQL)
def op11_filter_audit(spark, sf_dir):
    return audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8: each byte (two hex digits) comes in, then eight bits go out."""
    codes = f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::BIGINT)"
    events = f"flatten(list_transform({codes}, lambda c: [c, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, 3988292384 * (a & 1)) END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {events}), lambda a, e: {step}), 4294967295)"


def merkle_sql(levels: int = 10, fanout: int = 8) -> str:
    """The manifest, one round of CTEs a level; finished trees wait."""
    def leaf(text):
        return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"
                                       for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    low = f"CASE WHEN coalesce({crc32_sql('doc_id::VARCHAR')} % 3 = 0, false) THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
    ctes = [f"d AS (SELECT *, {low} AS other FROM documents)",
            f"leaves AS (SELECT doc_id, lang, {leaf('text')} AS leaf, {leaf('other')} AS altered FROM d)",
            "t0 AS (SELECT dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS n, "
            "row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, doc_id, leaf, altered FROM leaves)",
            "a0 AS (SELECT tree, n, pos, doc_id, leaf, altered AS fold, '' AS proof FROM t0)",
            "n0 AS (SELECT tree, n, pos, leaf AS digest FROM t0)"]

    def climb(k, tag, keys):
        return [f"r{tag}{k} AS (SELECT tree, max(n) AS n, pos // {fanout} AS pos, list(digest ORDER BY pos) AS kids, sha256(string_agg(digest, '' ORDER BY pos)) AS digest "
                f"FROM n{tag}{k} WHERE n > 1 GROUP BY tree, pos // {fanout})",
                f"n{tag}{k + 1} AS (SELECT tree, CAST(ceil(n / {fanout}.0) AS BIGINT) AS n, pos, digest FROM r{tag}{k} UNION ALL SELECT tree, n, pos, digest FROM n{tag}{k} WHERE n = 1)",
                f"a{tag}{k + 1} AS (SELECT a.tree, CAST(ceil(a.n / {fanout}.0) AS BIGINT) AS n, a.pos // {fanout} AS pos, {keys}, "
                f"CASE WHEN r.tree IS NULL THEN fold ELSE sha256(array_to_string(kids[1:a.pos % {fanout}], '') || fold || array_to_string(kids[a.pos % {fanout} + 2:], '')) END AS fold, "
                f"CASE WHEN r.tree IS NULL THEN proof ELSE proof || array_to_string(kids[1:a.pos % {fanout}], '') || array_to_string(kids[a.pos % {fanout} + 2:], '') END AS proof "
                f"FROM a{tag}{k} a LEFT JOIN r{tag}{k} r ON a.tree = r.tree AND a.n > 1 AND a.pos // {fanout} = r.pos)"]

    for k in range(levels):
        ctes += climb(k, "", "doc_id, leaf")
    ctes += [f"nu0 AS (SELECT 0 AS tree, count(*) OVER () AS n, tree AS pos, digest FROM n{levels})",
             f"au0 AS (SELECT 0 AS tree, u.n, u.pos, doc_id, leaf, u.digest AS subroot, fold, proof FROM a{levels} a JOIN nu0 u ON a.tree = u.pos)"]
    for k in range(levels):
        ctes += climb(k, "u", "doc_id, leaf, subroot")
    return ("WITH " + ", ".join(ctes) + f" SELECT doc_id, leaf, subroot, n.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, "
            f"fold = n.digest AS verified FROM au{levels} a, nu{levels} n")


@register("op12_merkle_manifest", merkle_sql())
def op12_merkle_manifest(spark, sf_dir):
    return verify_documents(read_table(spark, sf_dir, "documents"))


SHARDS = 40


def shard_sql(shards: int = SHARDS) -> str:
    """The k-d tree, one round of CTEs a depth."""
    row = "struct_pack(v := value, g := grp, p := piece)"
    ctes = [
        "d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size, coalesce(text, '') AS t, "
        "unhex(sha256(coalesce(text, ''))) AS grp, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS dim_0, "
        "dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS dim_1, coalesce(n_chars, -1) AS dim_2 FROM documents)",
        f"k AS (SELECT greatest(1, sum(size) // {shards} // {PIECE_PARTS}, least(max(size), sum(size) // {shards} // {LARGEST_PIECE_PARTS}))::BIGINT AS piece_bytes FROM d)",
        "g AS (SELECT *, sum(size) OVER (PARTITION BY grp) AS gw, sum(size) OVER (PARTITION BY grp ORDER BY doc_id "
        "ROWS UNBOUNDED PRECEDING) - size AS pos, first_value(struct_pack(a := dim_0, b := dim_1, c := dim_2)) "
        "OVER (PARTITION BY grp ORDER BY doc_id) AS f FROM d)",
        "r AS (SELECT doc_id, size, t, grp, CASE WHEN gw > piece_bytes THEN pos // piece_bytes ELSE 0 END::BIGINT AS piece, f FROM g, k)",
        "c0 AS (SELECT grp, piece, sum(size)::HUGEINT AS weight, any_value(f.a) AS dim_0, any_value(f.b) AS dim_1, any_value(f.c) AS dim_2, "
        f"0 AS node, {shards} AS shards, 0 AS first FROM r GROUP BY grp, piece)",
        *[f"s{i} AS (SELECT greatest(1, max(dim_{i}) - min(dim_{i}))::DOUBLE AS w FROM c0)" for i in range(3)]]
    for k in range((shards - 1).bit_length()):
        wide = [f"(max(dim_{i}) - min(dim_{i}))::DOUBLE / (SELECT w FROM s{i})" for i in range(3)]
        ctes += [
            f"n{k} AS (SELECT node, sum(weight) AS total, {', '.join(f'{w} AS w{i}' for i, w in enumerate(wide))} FROM c{k} GROUP BY node)",
            f"v{k} AS (SELECT c.*, total, CASE WHEN w0 >= w1 AND w0 >= w2 THEN dim_0 WHEN w1 >= w2 THEN dim_1 ELSE dim_2 END AS value FROM c{k} c JOIN n{k} USING (node))",
            f"m{k} AS (SELECT *, shards > 1 AND NOT (2 * sum(weight) OVER (PARTITION BY node ORDER BY value, grp, piece ROWS UNBOUNDED PRECEDING) - weight) * shards <= 2 * total * (shards // 2) AS up FROM v{k})",
            f"c{k + 1} AS (SELECT grp, piece, weight, dim_0, dim_1, dim_2, node * 2 + up::INT AS node, CASE WHEN shards = 1 THEN 1 WHEN up THEN shards - shards // 2 ELSE shards // 2 END AS shards, "
            f"first + CASE WHEN up THEN shards // 2 ELSE 0 END AS first FROM m{k})"]
    last = f"c{(shards - 1).bit_length()}"
    return ("WITH " + ", ".join(ctes) + f", z AS (SELECT doc_id, size, {crc32_sql('t')} AS text_crc32, first::INTEGER AS shard FROM r JOIN {last} USING (grp, piece)) "
            "SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, "
            "NULL::INTEGER AS grown_shard FROM z")


@register("op13_kd_shards", shard_sql())
def op13_kd_shards(spark, sf_dir):
    placed = shard_documents(read_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@register("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
