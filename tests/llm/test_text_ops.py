"""Language identification, quality rules, BPE and token files on small fixtures."""

import hashlib
import json
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagweave.llm import arrow, bpe, langid, quality, token_files
from tagweave.llm.queries import TOKENIZER

LIBRARY = Tokenizer.from_file(TOKENIZER)
ENCODER = bpe.PrefixEncoder(open(TOKENIZER, encoding="utf-8").read())
ODD = ["", " ", "a" * 5000, "Don't we'll I've", "<|endoftext|> a<|startoftext|>b <|endoftext|", "x\x1cy\x1fz a\x85b c d　e",
       "ΣΑΣ ς İstanbul ſ é é 日本語 😀👍🏽 ½²", "12 34x5 --</w> !!??", "Ᲊ⿠ \U000105c0a"]


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_encoder_matches_library(text):
    got = ENCODER.encode(text)
    assert list(array("I", got)) == ids_of(text)
    assert ENCODER.decode(got).decode() == LIBRARY.decode(ids_of(text), skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("aabcdeiost '.!éß\n0<|>") + ["<|endoftext|>", "tion", "the"]), max_size=40))
def test_encoder_matches_library_on_any_text(parts):
    text = "".join(parts)
    assert list(array("I", ENCODER.encode(text))) == ids_of(text)


JOINER = token_files.LibraryEncoder(open(TOKENIZER, encoding="utf-8").read())


@pytest.mark.parametrize("text", ODD)
def test_joined_calls_match_library(text):
    assert JOINER.encode(text).tolist() == ids_of(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("aabcdeiostßéÉğſΣ '’.!,09\u0301\u00a0") + ["<|endoftext|>", "the ", "'ll", "'RE", "ﬁ", "日本"]), max_size=40))
def test_joined_calls_match_library_on_any_text(parts):
    text = "".join(parts)
    encoder = JOINER
    encoder.chunks = bpe.ChunkCache(1000, pack=bytes)  # nothing known yet
    assert encoder.encode(text).tolist() == ids_of(text)


def test_joined_calls_match_library_for_every_code_point():
    """All code points in four neighbourhoods, several thousand pieces a text."""
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 40_000):
        text = " ".join(f"{c} a{c} {c}b 1{c}." for c in points[at:at + 40_000])
        assert JOINER.encode(text).tolist() == ids_of(text)


def test_joined_calls_whose_marks_do_not_add_up_are_asked_one_by_one():
    encoder = token_files.LibraryEncoder(open(TOKENIZER, encoding="utf-8").read())
    assert len(encoder.plain) > 500
    encoder._words = lambda chunk: 1  # a wrong count
    text = "don't stop, the 1990s weren't over. naïve café"
    assert encoder.encode(text).tolist() == ids_of(text)


def test_prefixes_have_their_own_last_token():
    word = "antidisestablishmentarianisms"
    symbols = word[:-1] + chr(ord(word[-1]) + bpe.END_SHIFT)
    last = ENCODER.last_tokens(symbols)
    assert last[0] is None and all(last[1:])


def test_chunk_cache_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 3)
    cache, asked = bpe.ChunkCache(), []

    def encode(chunks):
        asked.extend(chunks)
        return [[len(c)] for c in chunks]

    long = "y" * 100
    for text in ("a bb ccc", f"a {long} a", "bb dddd", "a e"):
        assert list(array("I", cache.encode(text, encode))) == [len(c) for c in text.split()]
    assert asked.count("a") == 1 and len(cache.young) <= 5


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, start int")


def test_token_digests(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (None, "null id"), (3, ODD[3])]
    got = sorted(map(tuple, bpe.token_digests(documents(spark, rows), TOKENIZER).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = ids_of(t or "")
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.token_digests(documents(spark, []), TOKENIZER).count() == 0


@pytest.mark.parametrize("files", [1, 3])
def test_token_files_roundtrip(spark, tmp_path, files):
    rows = [(i * 7 % 40, f"{ODD[i % len(ODD)]} number {i}") for i in range(40)] + [(100, None), (None, "first")]
    manifest = token_files.write_token_files(documents(spark, rows), str(tmp_path), TOKENIZER, files=files)
    assert manifest.agg(F.sum("docs")).first()[0] == len(rows)
    got = token_files.read_token_files(manifest, str(tmp_path)).orderBy("start").collect()
    at = 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        ids = [*ids_of(t or ""), 1]
        assert (r.doc_id, r.start, list(array("I", r.ids))) == (i, at, ids)
        at += len(ids)
    some = token_files.read_token_files(manifest, str(tmp_path), doc_ids=[3, 100]).collect()
    assert sorted(r.doc_id for r in some) == [3, 100]


def test_token_index_empty_and_crc(spark):
    assert token_files.token_index(documents(spark, []), TOKENIZER).count() == 0
    r = token_files.token_index(documents(spark, [(5, "a b")]), TOKENIZER).collect()
    assert [tuple(x) for x in r] == [(5, 0, 3, zlib.crc32(array("I", [*ids_of("a b"), 1]).tobytes()))]


class Sink(bytearray):
    def write(self, data):
        self += data

    def close(self):
        pass


class Source:
    def __init__(self, data):
        self.data, self.at, self.seen = bytes(data), 0, 0

    def size(self):
        return len(self.data)

    def seek(self, at):
        self.at = at

    def read(self, n):
        self.seen += n
        return self.data[self.at:self.at + n]


def test_frames_are_read_alone_and_checked(monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_BYTES", 64)
    monkeypatch.setattr(token_files, "MAX_FRAME_BYTES", 512)
    sink, rng = Sink(), np.random.default_rng(1)
    docs = [rng.integers(0, 60_000, size=n) for n in (5, 0, 40, 3, 2000, 1, 0, 77)]
    writer = token_files.Writer(sink, 2)
    for i, ids in enumerate(docs):
        writer.add(i, ids)
    writer.close()
    reader = token_files.Reader(Source(sink))
    assert [reader.ids(i).tolist() for i in range(len(docs))] == [d.tolist() for d in docs]
    one = token_files.Reader(Source(sink))
    assert one.ids(2).tolist() == docs[2].tolist() and one.read_frames <= 2 < len(writer.frames)
    # any zstandard reader sees the same stream
    with zstandard.ZstdDecompressor().stream_reader(bytes(sink), read_across_frames=True) as s:
        assert s.read() == b"".join(d.astype("<u2").tobytes() for d in docs)
    assert struct.unpack("<I", sink[-4:])[0] == token_files.SEEKABLE
    table = len(sink) - token_files.FOOTER.size - 12 * len(writer.frames)
    broken = bytearray(sink)
    broken[table + 8] ^= 1  # the first frame's checksum
    with pytest.raises(ValueError, match="checksum"):
        token_files.Reader(Source(broken)).ids(0)
    with pytest.raises(ValueError):
        token_files.Reader(Source(sink[:-3]))


LANGS = {"en": "the house with that other thing when they were there", "fr": "les maisons avec une autre chose quand elles étaient là",
         "ru": "дом и другие вещи когда они были там", "el": "το σπίτι και τα άλλα πράγματα όταν ήταν εκεί"}


def labelled_docs(spark):
    rows = [(i, " ".join(w for _ in range(3) for w in LANGS[k].split()[i % 3:]), k) for i, k in enumerate(list(LANGS) * 30)]
    rows += [(900, "ignored", None), (901, None, "en")]
    return spark.createDataFrame([(*r, 0.5, "q") for r in rows], "doc_id long, text string, lang string, score double, spans string")


def test_language_spans(spark):
    docs = labelled_docs(spark)
    model = langid.fit_languages(docs)
    assert model.langs == sorted(LANGS)
    mixed = f"{LANGS['en']}. {LANGS['fr']}! {LANGS['ru']}"
    rows = [(1, mixed), (2, None), (3, " 12 — !"), (4, "ДОМ"), (5, LANGS["fr"] + " " + "the " * 300_000), (6, "语言"), (None, LANGS["el"])]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [s.lang for s in got[1].spans] == ["en", "fr", "ru"]
    for s in got[1].spans:
        assert mixed[s.start:s.end] in LANGS[s.lang]
    assert [(got[i].lang_pred, got[i].score) for i in (2, 3)] == [("und", 0.0)] * 2
    assert [got[i].lang_pred for i in (4, 5, None)] == ["ru", "en", "el"] and got[6].lang_pred in LANGS
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.fit_languages(docs.limit(0))
    assert langid.identify(docs, none).select("lang_pred").distinct().collect()[0].lang_pred == "und"
    assert langid.identify(docs.limit(0), model).count() == 0


def brute_path(scores, switch):
    from itertools import product

    return max(sum(s[j] for s, j in zip(scores, p)) - switch * sum(a != b for a, b in zip(p, p[1:]))
               for p in product(range(scores.shape[1]), repeat=len(scores)))


def test_viterbi_is_optimal():
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b", "c"], np.ones((langid.GRAMS, 3)), np.ones((len(langid.SCRIPT_NAMES), 3)), np.ones(3), 2.0)
    for _ in range(150):
        scores = rng.normal(size=(rng.integers(1, 7), 3)) * rng.choice([0.5, 2, 6])
        for path in (langid.viterbi(scores, 2.0), model.path(scores)):
            value = scores[np.arange(len(path)), path].sum() - 2.0 * (path[1:] != path[:-1]).sum()
            assert value == pytest.approx(brute_path(scores, 2.0))


def test_path_avoids_the_language_that_is_best_on_the_whole():
    model = langid.Model(["a", "b", "c"], np.ones((langid.GRAMS, 3)), np.ones((len(langid.SCRIPT_NAMES), 3)), np.ones(3), 12.0)
    scores = np.array([[-10.0, 0, -30], [-10, -30, 0]])
    assert list(model.path(scores)) == [1, 2]
    assert list(model.path(np.repeat(scores / 5, 5, axis=0))) == [1] * 5 + [2] * 5
    assert list(model.path(scores / 2)) == [0, 0]  # gains of 5 do not pay for a switch
    rng = np.random.default_rng(1)
    for _ in range(200):  # one language middling throughout, two that fit one part each
        n, cut = rng.integers(2, 8), rng.integers(1, 7)
        scores = rng.normal(-20, 1, (n, 3))
        scores[:, 0] = rng.normal(-10, 2, n)
        scores[:cut, 1] = scores[cut:, 2] = rng.normal(-3, 1)
        path = model.path(scores)
        value = scores[np.arange(n), path].sum() - 12.0 * (path[1:] != path[:-1]).sum()
        assert value == pytest.approx(brute_path(scores, 12.0))


def test_language_held_out_accuracy(spark):
    from tests.conftest import SF_ORACLE

    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    got = langid.identify(docs, langid.fit_languages(docs)).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg(F.expr("cast(lang = lang_pred as double)"))).first()[0] > 0.97


def test_tree_rules_are_conjunctions():
    debug = """RandomForestClassificationModel
  Tree 0 (weight 1.0):
    If (feature 0 <= 2.5)
     If (feature 1 <= 1.0)
      Predict: 0.0
     Else (feature 1 > 1.0)
      Predict: 1.0
    Else (feature 0 > 2.5)
     If (feature 0 <= 9.0E2)
      Predict: 1.0
     Else (feature 0 > 9.0E2)
      Predict: 0.0
"""
    assert quality.tree_rules(debug, ["a", "b"]) == [
        (("a", False, 2.5),), (("a", False, 2.5), ("b", False, 1.0)), (("a", False, 2.5), ("b", True, 1.0)),
        (("a", True, 2.5),), (("a", False, 900.0), ("a", True, 2.5)), (("a", True, 900.0),)]


def test_compiled_score_matches_python(spark):
    import math

    model = quality.RuleModel(0.3, [((("words", True, 2.0), ("capitals", False, 0.5)), 1.25), ((("digits", True, 0.0),), -2.0)])
    rows = [(1, "a b c"), (2, "ABC DEF GHI"), (3, "x 1"), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, 3, 0.1) for i, t in rows], "doc_id long, text string, words int, score double")
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    for i, t in rows:
        t = t or ""
        total = 0.3
        total += 1.25 * (len(t.split()) > 2 and sum(c.isupper() for c in t) / max(1, len(t)) <= 0.5)
        total -= 2.0 * any(c.isdigit() for c in t)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-total)))


def test_quality_held_out_and_edges(spark):
    from tests.conftest import SF_ORACLE

    docs, labels = (spark.read.parquet(f"{SF_ORACLE}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    assert 0 < len(model.rules) < 150
    got = quality.score_quality(docs, model).filter("held_out").join(labels, "doc_id")
    assert got.agg(F.avg(F.expr("cast(quality = predicted as double)"))).first()[0] > 0.9
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality.score_quality(docs.limit(0), model).count() == 0
    nothing = quality.fit_quality(docs, labels.limit(0))
    assert quality.keep_good(docs, nothing).count() == docs.count()


def test_kept_documents_are_judged_by_one_set_of_statistics(spark):
    """The filter on the score must not compute statistics again for every rule."""
    rules = [((("stutter", False, 0.1 * k), ("capitals", True, 0.01 * k)), 0.5 - k) for k in range(6)]
    model = quality.RuleModel(0.4, rules)
    rows = [(1, "a b c"), (2, "ABC DEF GHI"), (3, "no no no no NO"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = quality.keep_good(docs, model)
    assert kept._jdf.queryExecution().optimizedPlan().toString().count(r"\1(?!") == 1
    good = {r.doc_id for r in quality.score_quality(docs, model).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == good and 0 < len(good) < len(rows)


def test_encoding_and_decoding_share_a_worker(spark):
    docs = documents(spark, [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (7, None)])
    both = bpe.encode_and_decode(docs, TOKENIZER)
    assert both._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    apart = bpe.decode_documents(bpe.encode_documents(docs, TOKENIZER), TOKENIZER)
    assert sorted(map(tuple, both.collect()), key=repr) == sorted(map(tuple, apart.collect()), key=repr)
    assert "MapInArrow" in (plan := bpe.token_digests(docs, TOKENIZER)._jdf.queryExecution().executedPlan().toString())
    assert plan.count("MapInArrow") == 1


def test_marks_behind_words_and_capitals_ask_the_library_once():
    encoder = token_files.LibraryEncoder(open(TOKENIZER, encoding="utf-8").read())
    asked, ids = [], encoder._ids
    encoder._ids = lambda chunks: asked.extend(chunks) or ids(chunks)
    for text in ("zorbel", "ZORBEL Zorbel, zorbel!!! ZORBEL. zorbel.,", "\u00c9zor \u00e9ZOR. \u00e9zor's 'zorbel' l'\u00e9zor",
                 "zorbel<|endoftext|>ZORBEL <|ENDOFTEXT|> zorbel\u0301 \u0130ZORBEL. zorbel's"):
        assert encoder.encode(text).tolist() == ids_of(text)
    words = [w for c in asked for w in c.split()]
    assert words.count("zorbel") == 1 and words.count("\u00e9zor") == 1


def test_words_of_letters_go_to_the_model_alone(monkeypatch):
    encoder = token_files.LibraryEncoder(open(TOKENIZER, encoding="utf-8").read())
    asked = []
    joined = encoder._joined
    monkeypatch.setattr(encoder, "_joined", lambda chunks: asked.extend(chunks) or joined(chunks))
    rng = np.random.default_rng(7)
    words = ["".join(chr(97 + c) for c in rng.integers(26, size=rng.integers(1, 41))) for _ in range(3000)]
    text = " ".join([*words, "It's", "o\u2019er", "na\u00efve", "x1", "don't", "ends.", "UPPER", "\u0130zmir", "fi\ufb01"])
    want = encoder.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
    assert encoder.encode(text).tolist() == want
    assert encoder.bare and not {*words} & {*asked}
    spec = json.loads(open(TOKENIZER, encoding="utf-8").read())
    spec["normalizer"]["normalizers"].append({"type": "Prepend", "prepend": "a"})
    assert not token_files.LibraryEncoder(json.dumps(spec)).bare


def test_workers_get_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 700).alias("text"))
    spark.conf.unset(arrow._INPUT_BYTES)
    assert bpe.token_digests(docs, TOKENIZER).agg(F.sum("n_tokens")).first()[0] == 4000 * 700
    rows = arrow.map_arrow(docs, sizes, "n long, size long").collect()
    assert sum(r.n for r in rows) == 4000 and max(r.size for r in rows) < 2 * arrow.BATCH_BYTES
    spark.conf.set(arrow._INPUT_BYTES, "5m")  # the user's own bound stays
    assert 2 * arrow.BATCH_BYTES < max(r.size for r in arrow.map_arrow(docs, sizes, "n long, size long").collect())
    spark.conf.unset(arrow._INPUT_BYTES)


def test_the_library_tokenizer_is_built_when_a_piece_needs_it():
    encoder = bpe.PrefixEncoder(open(TOKENIZER, encoding="utf-8").read())
    for text in ("Plain words, d\u00e9j\u00e0 vu <|endoftext|>", "\u1c89\u2fe0 \U000105c0a"):
        assert "library" not in vars(encoder)
        assert list(array("I", encoder.encode(text))) == ids_of(text)
    assert "library" in vars(encoder)
