"""Text queries (H1-H8) over whole documents and conversation texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tagweave.fixed import (
    SOCIAL_PRE_REPLACEMENTS, SOCIAL_REPLACEMENTS, SOCIAL_URL_TOKEN, SOCIAL_USER_TOKEN,
)
from tagweave.functions import text as tf
from tagweave.functions.seeded import seeded_int_sql, seeded_unit_sql
from tagweave.operators import tagger as tg
from tagweave.operators import text as tt
from tagweave.plans import fixtures as fx
from tagweave.plans.registry import register
from tagweave.plans.sqlbase import q, sql
from tagweave.session import cut_lineage, read_table, scratch_path
from tagweave.sources import io

MAX_LEN = 128
MLM_PROB = 0.15
MLM_SEED = 42
TOKS_SQL = "list_filter(regexp_split_to_array({x}, '[ \\t\\n\\r\\f]+'), lambda t: t <> '')"


# corpus tokens with their position among the non-empty tokens, and the
# frequency-ranked vocabulary (ids from 3)
_ENC_CTES = f"""dt AS (SELECT doc_id, {TOKS_SQL.format(x='text')} AS toks FROM documents),
tk AS (SELECT doc_id, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM dt),
voc AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 2 AS id
        FROM (SELECT token, count(*) AS n FROM tk GROUP BY token))"""


@register("text_lengths", sql(None, "SELECT doc_id, length(text) AS n_chars FROM corpus"))
def text_lengths(spark, sf_dir):
    """H1."""
    return fx.corpus(spark, sf_dir).select("doc_id", tf.char_length(F.col("text")).cast("bigint").alias("n_chars"))


@register("token_counts", sql(None, f"SELECT doc_id, CAST(len({TOKS_SQL.format(x='text')}) AS BIGINT) AS n_tokens "
                                    "FROM corpus"))
def token_counts(spark, sf_dir):
    """H2."""
    return fx.corpus(spark, sf_dir).select("doc_id", tf.token_count(F.col("text")).cast("bigint").alias("n_tokens"))


def _norm_sql(x: str) -> str:
    for a, b in SOCIAL_PRE_REPLACEMENTS:
        x = f"replace({x}, {q(a)}, {q(b)})"
    x = f"regexp_replace({x}, {q(tf.URL)}, {q(chr(92) + '1' + SOCIAL_URL_TOKEN)}, 'g')"
    x = f"regexp_replace({x}, {q(tf.HANDLE)}, {q(chr(92) + '1' + SOCIAL_USER_TOKEN)}, 'g')"
    x = f"array_to_string({TOKS_SQL.format(x=x)}, ' ')"
    for a, b in SOCIAL_REPLACEMENTS:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return f"trim(regexp_replace({x}, ' +', ' ', 'g'))"


@register("normalize_text", sql(None, f"SELECT conv_id, turn, {_norm_sql('text')} AS text FROM social"))
def normalize_text(spark, sf_dir):
    """H3."""
    s = fx.social(spark, sf_dir)
    return s.select("conv_id", "turn", tf.normalize_social(F.col("text")).alias("text"))


@register("extract_author", sql(None, f"""
SELECT conv_id, turn, trim(coalesce(nullif(regexp_extract(text, {q(tf.AUTHOR)}, 1), ''),
                                    nullif(regexp_extract(text, {q(tf.AUTHOR)}, 2), ''))) AS author
FROM quotes"""))
def extract_author(spark, sf_dir):
    """H4."""
    qt = fx.quotes(spark, sf_dir)
    return qt.select("conv_id", "turn", tf.author(F.col("text")).alias("author"))


@register("mention_counts", sql(None, f"""
SELECT m AS mention, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, {q(tf.MENTION)}, 1)) AS m
FROM documents) GROUP BY m"""))
def mention_counts(spark, sf_dir):
    """H5 (re-aimed): capitalised multi-word mentions counted over all documents."""
    return tt.mention_counts(read_table(spark, sf_dir, "documents"))


@register("encode_pad_mask", sql(f"""
{_ENC_CTES},
enc AS (SELECT tk.doc_id, string_agg(CAST(voc.id AS VARCHAR), ',' ORDER BY tk.pos) AS ids, count(*) AS n_real
        FROM tk JOIN voc ON voc.token = tk.token WHERE tk.pos < {MAX_LEN} GROUP BY tk.doc_id)""", f"""
SELECT dt.doc_id, CAST(len(dt.toks) AS BIGINT) AS n_tokens,
       CASE WHEN enc.ids IS NULL THEN array_to_string(list_transform(range({MAX_LEN}), lambda i: '0'), ',')
            WHEN enc.n_real = {MAX_LEN} THEN enc.ids
            ELSE enc.ids || repeat(',0', CAST({MAX_LEN} - enc.n_real AS INTEGER)) END AS input_ids,
       CAST(coalesce(enc.n_real, 0) AS BIGINT) AS n_mask
FROM dt LEFT JOIN enc ON enc.doc_id = dt.doc_id"""))
def encode_pad_mask(spark, sf_dir):
    """H6: corpus vocabulary by frequency, ids truncated / padded to 128, mask."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id"), "text")
    vocab = tt.vocabulary(docs)
    enc = tt.encode(docs, vocab, "doc_id", max_len=MAX_LEN)
    return enc.select("doc_id", "n_tokens", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"),
                      F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_mask"))


def _u(salt: int) -> str:
    return seeded_unit_sql(["m.doc_id", "m.pos", str(salt)], MLM_SEED)


@register("mlm_mask", sql(f"""
{_ENC_CTES},
pos_ids AS (SELECT tk.doc_id, tk.pos, voc.id FROM tk JOIN voc ON voc.token = tk.token WHERE tk.pos < {MAX_LEN}),
m AS (SELECT m.doc_id, m.id, {_u(0)} < {MLM_PROB} AS sel, {_u(1)} AS v,
             ({seeded_int_sql(["m.doc_id", "m.pos", "2"], MLM_SEED)} % (SELECT count(*) FROM voc)) + 3 AS rnd
      FROM pos_ids m),
per AS (SELECT doc_id, count(*) FILTER (WHERE sel) AS n_selected, count(*) FILTER (WHERE sel AND v < 0.8) AS n_masked,
               count(*) FILTER (WHERE sel AND v >= 0.8 AND v < 0.9 AND rnd <> id) AS n_replaced,
               sum(CASE WHEN NOT sel THEN id WHEN v < 0.8 THEN 1 WHEN v < 0.9 THEN rnd ELSE id END) AS ids_sum,
               coalesce(sum(id) FILTER (WHERE sel), 0) AS label_sum
        FROM m GROUP BY doc_id)""", """
SELECT d.doc_id, CAST(coalesce(p.n_selected, 0) AS BIGINT) AS n_selected,
       CAST(coalesce(p.n_masked, 0) AS BIGINT) AS n_masked, CAST(coalesce(p.n_replaced, 0) AS BIGINT) AS n_replaced,
       CAST(coalesce(p.ids_sum, 0) AS BIGINT) AS ids_sum, CAST(coalesce(p.label_sum, 0) AS BIGINT) AS label_sum
FROM documents d LEFT JOIN per p ON p.doc_id = d.doc_id"""))
def mlm_mask(spark, sf_dir):
    """H7: masked-LM examples from the encoded corpus: per document the
    selected / masked / replaced (random id other than the original) counts
    and checksums of the new input ids and of the kept labels."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    vocab = cut_lineage(tt.vocabulary(docs))
    enc = tt.encode(docs, vocab, "doc_id", max_len=MAX_LEN)
    out = tt.mlm_mask(enc, vocab.count(), "doc_id", prob=MLM_PROB, seed=MLM_SEED)
    labs = F.filter("labels", lambda x: x != -100)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select("doc_id", F.size(labs).cast("bigint").alias("n_selected"),
                      F.size(F.filter("input_ids", lambda x: x == tt.MASK_ID)).cast("bigint").alias("n_masked"),
                      F.size(F.filter(F.zip_with("input_ids", "labels", lambda a, b: (b != -100) & (a != tt.MASK_ID)
                                                 & (a != b)), lambda x: x)).cast("bigint").alias("n_replaced"),
                      total(F.col("input_ids")).alias("ids_sum"), total(labs).alias("label_sum"))


@register("format_violations", sql(None, """
SELECT 'malformed' AS kind, CAST(NULL AS BIGINT) AS doc_id, '{"doc_id":' || doc_id || ',"labels":[' AS detail
FROM documents WHERE doc_id % 89 = 0
UNION ALL SELECT 'missing_key', doc_id, 'labels' FROM documents WHERE doc_id % 83 = 0
UNION ALL SELECT 'missing_key', NULL, 'doc_id' FROM documents WHERE doc_id % 79 = 0
UNION ALL SELECT 'missing_id', doc_id, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM sub_ids) AND doc_id % 83 <> 0
UNION ALL SELECT 'extra_id', doc_id, NULL FROM sub_ids WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'unknown_label', doc_id, label FROM sub_long WHERE label NOT IN (SELECT node FROM nodes)"""))
def format_violations(spark, sf_dir):
    """H8: a submission written as JSON lines plus one truncated record per
    89th document, one without labels per 83rd and one without an id per 79th,
    read PERMISSIVE; every record validated."""
    path = scratch_path(spark, "submission")
    sub = fx.submission(spark, sf_dir)
    sub.write.json(path)
    broken = read_table(spark, sf_dir, "documents").filter(F.col("doc_id") % 89 == 0).select(
        F.concat(F.lit('{"doc_id":'), F.col("doc_id").cast("string"), F.lit(',"labels":[')).alias("value"))
    ids = read_table(spark, sf_dir, "documents").select("doc_id")
    lacking = ids.filter(F.col("doc_id") % 83 == 0).select(
        F.concat(F.lit('{"doc_id":'), F.col("doc_id").cast("string"), F.lit("}")).alias("value"))
    no_id = ids.filter(F.col("doc_id") % 79 == 0).select(F.lit('{"labels":[]}').alias("value"))
    broken.unionByName(lacking).unionByName(no_id).write.mode("append").text(path)
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("labels", T.ArrayType(T.StringType()))])
    raw = io.read_json_records(spark, path, schema, multiline=False, corrupt_col="_corrupt_record")
    gold = read_table(spark, sf_dir, "documents").select("doc_id")
    vocab = fx.taxonomy(spark)["closure"].select(F.col("node").alias("label"))
    return tt.format_violations(raw, gold, vocab, "doc_id")


class MentionRule:
    """The stated rule: a word with one leading capital is (part of) a mention unless it opens a
    sentence and no capitalised word follows it; neighbours belong together."""

    NAME, END = 1, 2

    def mark(self, word: str) -> int:
        return self.NAME if len(word) > 1 and word[0].isupper() and word[1:].islower() else self.END if word in ".!?" else 0

    def tags(self, marks: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tags of the words of some lines, the first of each at ``starts`` (and behind them the number of words)."""
        first, last = starts[:-1], starts[1:] - 1
        name, opens = marks == self.NAME, np.append(True, marks[:-1] == self.END)
        opens[first] = True
        follows = np.append(name[1:], False)
        follows[last] = False
        name &= ~opens | follows
        inside = np.append(False, name[:-1]) & name
        inside[first] = False
        return name.astype(np.int8) + inside

    def __call__(self, words: list[str]) -> list[int]:
        return self.tags(np.array([self.mark(w) for w in words]), np.array([0, len(words)])).tolist() if words else []


mention_rule = MentionRule()


@register("mention_tags")
def mention_tags(spark, sf_dir):
    """H5: mentions of every tenth document by a tagger that is learned from the others; per document the
    mentions by the rule, those found, and how many agree (single names included)."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    held = docs.filter(F.col("id") % 10 == 0)
    weights = tg.fit_tagger(docs.filter(F.col("id") % 10 != 0), mention_rule)
    rule = F.pandas_udf(lambda s: pd.Series(tg.rule_mentions(s, mention_rule)), "array<string>")
    both = tg.tag_mentions(held, weights).join(held.select("id", rule("text").alias("gold")), "id")
    # matches with repeats: the lesser of both counts of each mention
    agree = F.aggregate(F.array_distinct("gold"), F.lit(0), lambda n, g: n + F.least(
        F.size(F.filter("gold", lambda x: x == g)), F.size(F.filter("mentions", lambda x: x == g))))
    return both.select(F.col("id").alias("doc_id"), F.size("gold").alias("n_rule"), F.size("mentions").alias("n_found"),
                       agree.alias("n_agree"))
