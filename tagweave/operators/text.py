"""Corpus-level text jobs (H5-H8): vocabulary, encoding with truncation /
padding / mask, masked-LM example building, mention counts and submission
validation.  Everything runs as DataFrame jobs over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.seeded import seeded_int, seeded_unit
from tagweave.functions.text import mentions, split_ws, token_span
from tagweave.operators.clean import with_row_index
from tagweave.session import sized_broadcast

PAD_ID = 0
MASK_ID = 1
UNK_ID = 2
FIRST_TOKEN_ID = 3


def vocabulary(docs: DataFrame, text_col: str = "text", min_count: int = 1) -> DataFrame:
    """Corpus vocabulary (token, n, id): ids dense by frequency desc, then token,
    starting at FIRST_TOKEN_ID.  Counting uses partial aggregation; ids come
    from a distributed range sort (no single-partition window)."""
    toks = docs.select(F.explode(split_ws(F.col(text_col))).alias("token")).filter(F.col("token") != "")
    counts = toks.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    if min_count > 1:
        counts = counts.filter(F.col("n") >= min_count)
    return with_row_index(counts, [F.desc("n"), F.asc("token")], "id", FIRST_TOKEN_ID)


def encode(docs: DataFrame, vocab: DataFrame, id_col: str = "id", text_col: str = "text",
           max_len: int = 128) -> DataFrame:
    """H6: token ids truncated to ``max_len``, padded with PAD_ID, plus a 0/1 mask.
    A token outside the vocabulary is UNK_ID; a null text has no token.

    Tokens past ``max_len`` are cut before the vocabulary join (truncation is
    the operator's contract); ``n_tokens`` counts the whole text.  The
    vocabulary is broadcast only below the size bound, else shuffle-joined
    (AQE splits hot tokens)."""
    # one pass over the text: the split is evaluated once per document, the
    # truncated tokens carry the full count along; posexplode_outer keeps
    # documents without any token
    parts = docs.select(id_col, split_ws(F.coalesce(F.col(text_col), F.lit(""))).alias("_p"))
    lead, count = token_span(F.col("_p"))
    pos = parts.select(id_col, count.alias("n_tokens"),
                       F.posexplode_outer(F.slice("_p", lead + 1, F.least(count, F.lit(max_len))))
                       .alias("pos", "token"))
    v = sized_broadcast(vocab.select("token", F.col("id").alias("_tid")))
    ided = pos.join(v, "token", "left")
    hit = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("_tid", F.lit(UNK_ID)).alias("_tid")))
    j = ided.groupBy(id_col).agg(
        F.max("n_tokens").alias("n_tokens"),
        F.transform(F.array_sort(F.collect_list(hit)), lambda x: x["_tid"]).alias("_ids"))
    ids = F.coalesce(F.col("_ids"), F.array().cast("array<bigint>"))
    n = F.size(ids)
    padded = F.concat(ids, F.array_repeat(F.lit(PAD_ID).cast("bigint"), F.lit(max_len) - n))
    mask = F.transform(F.sequence(F.lit(0), F.lit(max_len - 1)), lambda i: (i < n).cast("int"))
    return j.select(id_col, F.col("n_tokens").cast("bigint").alias("n_tokens"), padded.alias("input_ids"),
                    mask.alias("attention_mask"))


def mlm_mask(encoded: DataFrame, vocab_size: int, id_col: str = "id", prob: float = 0.15, seed: int = 42
             ) -> DataFrame:
    """H7: masked-LM examples.  A real (mask = 1) position is selected with
    probability ``prob``; a selected token becomes MASK_ID (80 %), a random
    vocabulary id (10 %) or stays (10 %).  ``labels`` holds the original id at
    selected positions and -100 elsewhere.  Deterministic per (id, pos, seed)
    through an integer hash any SQL engine reproduces."""
    arr = F.zip_with("input_ids", "attention_mask", lambda a, b: F.struct(a.alias("tok"), b.alias("m")))
    rid = F.col(id_col)

    def pick(e: Column, i: Column) -> Column:
        sel = (e["m"] == 1) & (seeded_unit(rid, i, F.lit(0), seed=seed) < prob)
        v = seeded_unit(rid, i, F.lit(1), seed=seed)
        rnd = (F.pmod(seeded_int(rid, i, F.lit(2), seed=seed), F.lit(vocab_size)) + FIRST_TOKEN_ID).cast("bigint")
        new = F.when(~sel, e["tok"]).when(v < 0.8, F.lit(MASK_ID).cast("bigint")).when(v < 0.9, rnd).otherwise(e["tok"])
        lab = F.when(sel, e["tok"]).otherwise(F.lit(-100).cast("bigint"))
        return F.struct(new.alias("tok"), lab.alias("lab"))

    out = encoded.select(id_col, F.transform(arr, pick).alias("_x"))
    return out.select(id_col, F.transform("_x", lambda e: e["tok"]).alias("input_ids"),
                      F.transform("_x", lambda e: e["lab"]).alias("labels"))


def mention_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """H5: capitalised multi-word mentions over whole texts and their counts."""
    m = docs.select(F.explode(mentions(F.col(text_col))).alias("mention"))
    return m.groupBy("mention").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def format_violations(sub: DataFrame, gold_ids: DataFrame, vocab: DataFrame, id_col: str = "id",
                      labels_col: str = "labels", corrupt_col: str = "_corrupt_record") -> DataFrame:
    """Every violation of a submission as rows (kind, id, detail).

    kinds: malformed (unparsable record), missing_key (a record without its id
    or its labels), missing_id, extra_id, unknown_label.  Every row is checked
    (not only the last one)."""
    sub = sub.cache()  # a raw JSON scan may not be queried for the corrupt column alone
    bad = sub.filter(F.col(corrupt_col).isNotNull()).select(
        F.lit("malformed").alias("kind"), F.lit(None).cast("bigint").alias(id_col), F.col(corrupt_col).alias("detail"))
    read = sub.filter(F.col(corrupt_col).isNull()).select(F.col(id_col).cast("bigint").alias(id_col), labels_col)
    keys = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in (id_col, labels_col)]))
    lacking = read.select(F.lit("missing_key").alias("kind"), id_col, F.explode(keys).alias("detail"))
    good = read.filter(F.col(id_col).isNotNull())
    g = gold_ids.select(F.col(id_col).cast("bigint").alias(id_col)).distinct()
    s_ids = good.select(id_col).distinct()
    missing = g.join(s_ids, id_col, "left_anti").select(F.lit("missing_id").alias("kind"), id_col,
                                                         F.lit(None).cast("string").alias("detail"))
    extra = s_ids.join(g, id_col, "left_anti").select(F.lit("extra_id").alias("kind"), id_col,
                                                      F.lit(None).cast("string").alias("detail"))
    labs = good.select(id_col, F.explode(labels_col).alias("label"))
    unk = labs.join(sized_broadcast(vocab.select("label").distinct()), "label", "left_anti").select(
        F.lit("unknown_label").alias("kind"), id_col, F.col("label").alias("detail"))
    return bad.unionByName(lacking).unionByName(missing).unionByName(extra).unionByName(unk)
