"""Language identification of whole, possibly mixed-language texts.

A word's script, by ranges of code points, narrows its candidate languages to
those that were seen in that script.  Each candidate scores the word by the
log-probabilities of its character trigrams (word borders included).  Viterbi
over the words, with a penalty for every switch of language, labels spans.

Counts are learned by tasks from a bounded, hash-chosen sample of labelled
documents; the model (65,536 hashed trigrams by languages) is what tasks get.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.arrow import Batches, texts
from tagweave.llm.common import narrow

#: Training documents of a language at most (expected number; chosen by a hash of the id).
MAX_FIT_DOCS = 1000
GRAMS = 1 << 16
#: Log-probability that a change of language between two words costs.
SWITCH = 12.0
#: Added to every trigram's count.
SMOOTHING = 0.05
#: Share of a language's training words from which on a script counts as its own.
SCRIPT_SHARE = 0.001
#: Texts are scored in pieces of about so many characters, cut between words.
PIECE = 1 << 20
UNKNOWN = "und"

# First code point and name of script ranges, in order.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"),
    (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1400, "Aboriginal"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"),
    (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Coptic"),
    (0x2D00, "Georgian"), (0x2D80, "Ethiopic"), (0x2DE0, "Cyrillic"), (0x2E80, "Han"), (0x3040, "Kana"),
    (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x31F0, "Kana"), (0x3400, "Han"), (0xA000, "Yi"), (0xA640, "Cyrillic"),
    (0xA720, "Latin"), (0xA960, "Hangul"), (0xAB30, "Latin"), (0xAC00, "Hangul"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"),
    (0x10000, "Other"), (0x20000, "Han"), (0x40000, "Other"),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([start for start, _ in SCRIPTS], np.uint32)
_SCRIPT = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS], np.int64)


@cache
def _in_words() -> np.ndarray:
    """By code point: 2 letter, 1 mark (goes on inside a word), 0 else."""
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x40000):
        kinds[c] = {"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0)
    return kinds


class Words:
    """Words of a text as trigram numbers: ``grams`` of all words in a row,
    ``at`` where each word's begin, its ``script``, ``letters`` and character ``start`` and ``end``."""

    def __init__(self, text: str):
        # code points of the text itself give positions; case is folded code point by code point
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _in_words()[codes]
        inside = kinds > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
        start, end = edges[::2], edges[1::2]
        letters = np.concatenate([[0], np.cumsum(kinds == 2)])
        count = letters[end] - letters[start]
        real = count > 0
        self.start, self.end, self.letters = start[real], end[real], count[real]
        folded = _folded(text, codes)
        c = np.where(inside, folded, 1).astype(np.uint64)
        c = np.concatenate([[np.uint64(1)], c, [np.uint64(1)]])
        with np.errstate(over="ignore"):
            mixed = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
                     + c[2:] * np.uint64(0x165667B19E3779F9))
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
        grams = (mixed >> np.uint64(48)).astype(np.int64)
        if not real.all():  # runs of marks only
            for a, b in zip(start[~real], end[~real]):
                inside[a:b] = False
        self.grams = grams[inside]
        size = self.end - self.start
        self.at = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
        first = codes[self.start]
        if codes.max(initial=0) < _STARTS[1]:
            self.script = np.full(len(first), _SCRIPT[0])
        else:
            self.script = _SCRIPT[np.searchsorted(_STARTS, first, side="right") - 1]

    def __len__(self) -> int:
        return len(self.start)


def _folded(text: str, codes: np.ndarray) -> np.ndarray:
    low = text.lower()
    if len(low) != len(text):  # some characters grow; fold those that stay one code point
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)


def pieces(text: str, size: int = PIECE) -> Iterator[tuple[int, str]]:
    """The text in parts of about ``size`` characters, cut at blanks; a part without a blank goes on."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            cut = text.find(" ", end)
            end = len(text) if cut < 0 else cut
        yield at, text[at:end]
        at = end


class Model:
    """Trigram log-probabilities by language and the scripts of each language."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, docs: np.ndarray, switch: float):
        self.langs, self.switch = langs, switch
        total = counts.sum(0, keepdims=True)
        self.logp = np.log((counts + SMOOTHING) / (total + SMOOTHING * GRAMS)).astype(np.float32)
        share = scripts / np.maximum(1, scripts.sum(0, keepdims=True))
        self.uses = share >= SCRIPT_SHARE  # script by language
        self.prior = np.log(docs / docs.sum())

    def word_scores(self, words: Words) -> np.ndarray:
        """Words by languages.  Words of a script that no language uses score 0 for all."""
        scores = np.add.reduceat(self.logp[words.grams], words.at, axis=0).astype(np.float64)
        uses = self.uses[words.script]
        if not uses.all():
            known = uses.any(1)
            scores[~known] = 0
            scores[known[:, None] & ~uses] = -1e6
        return scores

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The best labelling: sum of scores less the penalty for every switch."""
        best = int(np.argmax(scores.sum(0)))
        if self._constant(scores, best):
            return np.full(len(scores), best)
        return viterbi(scores, self.switch)

    def _constant(self, scores: np.ndarray, best: int) -> bool:
        """Whether one label for all is provably optimal: no run of words gains more than
        half a switch costs.  Of a path with m runs of other labels, those that gain, at
        least m - 1 switches are paid for (m if ``best`` itself stands in it), and
        m * gain <= (m - 1) * switch from m = 2 on; one other label for all is no better than ``best``."""
        gain = np.cumsum(scores - scores[:, best:best + 1], axis=0)
        low = np.minimum.accumulate(np.concatenate([np.zeros((1, gain.shape[1])), gain[:-1]]), axis=0)
        return bool(2 * (gain - low).max() <= self.switch)

    def label(self, text: str) -> tuple[str, float, list[tuple[int, int, str]]]:
        """Language, score and spans (first and last character, language) of a whole text."""
        parts = [(at, Words(part)) for at, part in pieces(text)]
        parts = [(at, words) for at, words in parts if len(words)]
        if not parts or not self.langs:
            return UNKNOWN, 0.0, []
        scores = np.concatenate([self.word_scores(words) for _, words in parts])
        letters = np.concatenate([words.letters for _, words in parts])
        path = self.path(scores)
        by_lang = np.bincount(path, weights=letters, minlength=len(self.langs))
        chosen = int(np.argmax(by_lang))
        total = scores[path == chosen].sum(0) + self.prior
        posterior = 1 / np.exp(total - total[chosen]).clip(max=1e300).sum()
        start = np.concatenate([at + words.start for at, words in parts])
        end = np.concatenate([at + words.end for at, words in parts])
        firsts = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
        lasts = np.append(firsts[1:], len(path)) - 1
        spans = [(int(start[a]), int(end[b]), self.langs[path[a]]) for a, b in zip(firsts, lasts)]
        return self.langs[chosen], float(min(1.0, by_lang[chosen] / letters.sum() * posterior)), spans


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """Best path; on a tie it stays with its language, else takes the first one."""
    n, k = scores.shape
    came = np.empty((n, k), np.int16)
    labels, value = list(range(k)), scores[0].tolist()
    for i, row in enumerate(scores.tolist()):
        if not i:
            continue
        top = max(value)
        source = value.index(top)
        top -= switch
        came[i] = [j if value[j] >= top else source for j in labels]
        value = [max(value[j], top) + row[j] for j in labels]
    path = np.empty(n, np.int64)
    path[-1] = value.index(max(value))
    for i in range(n - 1, 0, -1):
        path[i - 1] = came[i, path[i]]
    return path


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_languages(docs: DataFrame, max_docs: int = MAX_FIT_DOCS, switch: float = SWITCH, id_col: str = "doc_id",
                  text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the text and language of labelled documents outside the held-out part."""
    src = narrow(docs, doc_id=id_col, text=text_col, lang=lang_col).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r.lang: r.n for r in src.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((GRAMS, 0)), np.zeros((len(SCRIPT_NAMES), 0)), np.zeros(0), switch)
    scale = 1 << 30
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(scale, int(scale * max_docs / sizes[k]) + 1)))])
    chosen = src.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < F.element_at(share, F.col("lang")))
    index = {k: j for j, k in enumerate(langs)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((GRAMS + len(SCRIPT_NAMES), len(langs)), np.int64)
        for pdf in frames:
            for text, lang in zip(pdf["text"], pdf["lang"]):
                for _, part in pieces(text):
                    words = Words(part)
                    counts[:GRAMS, index[lang]] += np.bincount(words.grams, minlength=GRAMS)
                    counts[GRAMS:, index[lang]] += np.bincount(words.script, minlength=len(SCRIPT_NAMES))
        feature, lang = np.nonzero(counts)
        yield pd.DataFrame({"lang": lang, "feature": feature, "n": counts[feature, lang]})

    sums = (chosen.select("text", "lang").mapInPandas(run, "lang long, feature long, n long")
            .groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas())  # at most features x languages rows
    counts = np.zeros((GRAMS + len(SCRIPT_NAMES), len(langs)))
    counts[sums["feature"], sums["lang"]] = sums["n"]
    return Model(langs, counts[:GRAMS], counts[GRAMS:], np.array([sizes[k] for k in langs], float), switch)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, spans`` of every whole text.

    ``spans`` are ``start, end, lang`` in characters.  The prediction is the language
    with most letters in its spans; ``score`` is its share of the letters times its posterior.
    Null texts and texts without a letter give ``und``, score 0 and no spans, and
    so does every text if nothing could be learned.  Ties go to the language that
    is first by code point; rows that repeat are labelled alike; an empty table
    gives an empty result.  Further columns are ignored.
    """
    kept = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()),
                        ("score", pa.float64()), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, label = Batches(schema), kept.value.label
        for batch in batches:
            for doc_id, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
                lang, score, spans = label(text)
                spans = [{"start": a, "end": b, "lang": x} for a, b, x in spans]
                yield from out.add(doc_id, held, lang, score, spans, size=200 + 60 * len(spans))
        yield from out.flush()

    src = narrow(docs, doc_id=id_col, text=text_col)
    rows = src.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, "
                                "spans array<struct<start: long, end: long, lang: string>>")
