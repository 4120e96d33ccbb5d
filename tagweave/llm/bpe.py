"""BPE encoding by per-prefix dynamic programming, and decoding.

An encoding's beginnings are themselves encodings of the text they cover, so
every prefix of a word has exactly one possible last token.  An Aho-Corasick
automaton over the vocabulary (pyahocorasick, in place of a suffix automaton: it
lists the same matches) gives the tokens that end at a position; such a token is the
prefix's last one if the prefix before it is empty, or if its own last token and
this one are compatible: merging their joined symbols gives just the two again.
Following the stored last tokens back from the word's end gives the exact ids.

The tokenizer is the word-level one of ``word_bpe_49k.json``: NFC, white space
to one blank, lower case; words by a pattern; bytes as printable characters; the
last symbol of a word is a symbol of its own (written with ``</w>``).  Its two
special strings are taken out of the raw text first.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagweave.llm.arrow import Batches, map_arrow, texts
from tagweave.llm.common import narrow

END = "</w>"
#: Code points by which a word's last symbol differs from the same symbol inside.
END_SHIFT = 0x1000
#: Chunks (text between white space; two generations of them), words and token pairs whose result a worker keeps.
CACHED_CHUNKS, CACHED_CHUNK_CHARS, CACHED_WORDS, CACHED_PAIRS = 150_000, 64, 100_000, 300_000
DECODED = "doc_id long, ids binary, decoded binary"


def byte_symbols() -> list[str]:
    """The printable character of each byte: itself if printable in Latin-1, else
    the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols, free = [""] * 256, 256
    for b in range(256):
        symbols[b] = chr(b) if b in printable else chr(free)
        free += b not in printable
    return symbols


def lower(text: str) -> str:
    """Lower case character by character (a final sigma is no special case)."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


class PairRules:
    """Merge order: which tokens stay side by side, and which strings are one token."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.rank: dict[tuple[int, int], int] = {}
        size = max(vocab.values()) + 1
        # when a token comes to be, and of which two; single symbols come first
        self.born, self.halves = [-1] * size, [(0, 0)] * size
        self.symbols: list[str] = [""] * size
        for token, i in vocab.items():
            if len(token) == 1:
                self.symbols[i] = token
            elif token.endswith(END) and len(token) == 1 + len(END):
                self.symbols[i] = chr(ord(token[0]) + END_SHIFT)
        for n, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = n
            self.born[whole], self.halves[whole] = n, (left, right)
            self.symbols[whole] = self.symbols[left] + self.symbols[right]
        # a token is used only if its own symbols merge to it
        self.whole = [bool(s) for s in self.symbols]
        for token in sorted(range(size), key=self.born.__getitem__):
            if self.born[token] >= 0:
                left, right = self.halves[token]
                self.whole[token] = self.whole[left] and self.whole[right] and self._apart(left, right)

    def _apart(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border before both tokens are complete.

        Runs the merges next to the border backwards: the younger of the two
        tokens at the border (of equals the right one, as the left one is merged
        first) is split, which gives the pair that stood there until its merge.
        """
        born, rank = self.born, self.rank
        while True:
            if born[a] > born[b]:
                until, a = born[a], self.halves[a][1]
                if rank.get((a, b), until) < until:
                    return False
            elif born[b] >= 0:
                until, b = born[b], self.halves[b][0]
                if rank.get((a, b), until + 1) <= until:
                    return False
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        return (a, b) not in self.rank and self._apart(a, b)


class PrefixEncoder:
    """Exact encoder and decoder of one tokenizer file (its JSON text)."""

    def __init__(self, spec: str):
        self.file = spec
        spec = json.loads(spec)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.rules = PairRules(vocab, merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = token_bytes(spec)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.bytes = byte_symbols()
        self.automaton = ahocorasick.Automaton()
        for i, symbols in enumerate(self.rules.symbols):
            if self.rules.whole[i]:
                self.automaton.add_word(symbols, (i, len(symbols)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.word_ids: dict[str, tuple[int, ...]] = {}
        self.chunks = ChunkCache()

    @cached_property
    def library(self) -> Tokenizer:
        """The library's own tokenizer (38 MB), built when the first piece needs it; few texts have one."""
        return Tokenizer.from_str(self.file)

    def last_tokens(self, symbols: str) -> list[tuple[int, int] | None]:
        """For every prefix, by its length, its last token and that token's length."""
        last: list[tuple[int, int] | None] = [None] * (len(symbols) + 1)
        pairs, size = self.pairs, len(self.tokens)
        for at, match in self.automaton.iter(symbols):
            if last[at + 1] is None:
                token, n = match
                start = at + 1 - n
                if start:
                    pair = last[start][0] * size + token
                    if pair not in pairs:
                        if len(pairs) >= CACHED_PAIRS:
                            pairs.clear()
                        pairs[pair] = self.rules.compatible(last[start][0], token)
                    if not pairs[pair]:
                        continue
                last[at + 1] = match
        return last

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word of byte symbols."""
        symbols = word[:-1] + chr(ord(word[-1]) + END_SHIFT)
        last, at, ids = self.last_tokens(symbols), len(symbols), []
        while at:
            token, n = last[at]
            ids.append(token)
            at -= n
        return ids[::-1]

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a text without white space."""
        ids: list[int] = []
        for piece in self.specials.split(chunk) if "<|" in chunk else [chunk]:
            if piece in self.special:
                ids.append(self.special[piece])
            elif piece:
                for word in self.words_of(piece):
                    if len(word) > CACHED_CHUNK_CHARS:
                        ids += self.encode_word(word)
                        continue
                    if word not in self.word_ids:
                        if len(self.word_ids) >= CACHED_WORDS:
                            self.word_ids.clear()
                        self.word_ids[word] = tuple(self.encode_word(word))
                    ids += self.word_ids[word]
        return ids

    def words_of(self, piece: str) -> list[str]:
        """The piece's words as byte symbols.

        The tokenizer's Unicode version is newer than Python's: pieces with code
        points that Python has as unassigned go through its own normalizer and splitter.
        """
        if piece.isascii() and piece.isprintable():
            return self.words.findall(piece.lower())  # these bytes are their own symbols
        if not piece.isascii() and "Cn" in map(unicodedata.category, piece):
            words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
            return [word for word, _ in words]
        words = self.words.findall(lower(unicodedata.normalize("NFC", piece)))
        return ["".join([self.bytes[b] for b in w.encode("utf-8", "surrogatepass")]) for w in words]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.chunks.encode(text, lambda new: [self.encode_chunk(c) for c in new])

    def decode(self, ids: bytes) -> bytes:
        return decode(ids, self.tokens)


def token_bytes(spec: dict) -> list[bytes]:
    """Each id's token in UTF-8."""
    named = [*spec["model"]["vocab"].items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]
    tokens = [b""] * (max(i for _, i in named) + 1)
    for token, i in named:
        tokens[i] = token.encode()
    return tokens


def decode(ids: bytes, tokens: list[bytes]) -> bytes:
    """The tokens in order with one blank between them, in UTF-8."""
    return b" ".join(map(tokens.__getitem__, array("I", ids)))


def chunks_of(text: str) -> list[str]:
    """The text between white space (the Unicode property; Python's split also cuts at U+001C to U+001F)."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [c for c in regex.split(r"\s+", text) if c]
    return text.split()


class ChunkCache:
    """Ids of chunks in two generations: a full young one becomes the old one, and
    what is met again moves back, so frequent chunks outlive rare ones."""

    def __init__(self, chunks: int | None = None, pack=lambda ids: array("I", ids).tobytes()):
        self.chunks, self.pack = chunks, pack
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, text: str, encode) -> bytes:
        """Concatenated ids of the text's chunks; ``encode`` gives those of a list of new ones."""
        if len(self.young) >= (self.chunks or CACHED_CHUNKS):
            self.young, self.old = {}, self.young
        chunks, young, old = chunks_of(text), self.young, self.old
        ids = list(map(young.get, chunks))
        gaps = [at for at, known in enumerate(ids) if known is None]
        if gaps:
            missing = {chunks[at] for at in gaps}
            found = {c: old[c] for c in missing if c in old} if old else {}
            new = [c for c in missing if c not in found] if found else list(missing)
            if new:
                found.update(zip(new, map(self.pack, encode(new))))
            young.update(found if max(map(len, missing)) <= CACHED_CHUNK_CHARS else
                         {c: x for c, x in found.items() if len(c) <= CACHED_CHUNK_CHARS})
            for at in gaps:
                ids[at] = found[chunks[at]]
        return b"".join(ids)


_KEPT: dict[tuple, object] = {}


def kept(spec: _Spec, make):
    """What ``make`` builds of a broadcast tokenizer file; a worker keeps the last one from task to task."""
    key = (make.__name__, spec.id)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make(spec.value)
    return _KEPT[key]


def read_tokens(spec: str) -> list[bytes]:
    return token_bytes(json.loads(spec))


class _Spec:
    """A broadcast file and its name, so that workers know it again."""

    def __init__(self, value, key: int):
        self._value, self.id = value, key

    @property
    def value(self) -> str:
        return self._value.value


def tokenizer_spec(spark, path: str) -> _Spec:
    """The tokenizer file, read on the driver and sent to the tasks (a few MB, fixed by the vocabulary)."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return _Spec(spark.sparkContext.broadcast(text), hash(text))


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, ids`` (binary: little-endian u32).

    Null and empty texts have no ids; ids of documents may be null or repeat;
    other columns are ignored, whatever their names.
    """
    spec = tokenizer_spec(docs.sparkSession, tokenizer)
    return map_arrow(_documents(docs, id_col, text_col), lambda batches: _encoded(spec, batches), "doc_id long, ids binary")


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _encoded(spec: _Spec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder, out = kept(spec, PrefixEncoder), Batches(pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())]))
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            ids = encoder.encode(text)
            yield from out.add(doc_id, ids, size=len(ids))
    yield from out.flush()


def _decoded(tokens: list[bytes], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Batches(pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())]))
    for batch in batches:
        for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = value.as_py()
            decoded = decode(ids, tokens)
            yield from out.add(doc_id, ids, decoded, size=len(ids) + len(decoded))
    yield from out.flush()


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Adds ``decoded`` (UTF-8 bytes) to the rows of ``encode_documents``."""
    spec = tokenizer_spec(encoded.sparkSession, tokenizer)
    return map_arrow(encoded.select("doc_id", "ids"), lambda batches: _decoded(kept(spec, read_tokens), batches), DECODED)


def encode_and_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode_documents`` of ``encode_documents``, both steps in one Python worker a task: two
    workers would each hold what they build of the tokenizer file, and pass the ids through the JVM."""
    spec = tokenizer_spec(docs.sparkSession, tokenizer)
    return map_arrow(
        _documents(docs, id_col, text_col), lambda batches: _decoded(kept(spec, PrefixEncoder).tokens, _encoded(spec, batches)), DECODED)


def token_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text."""
    rows = encode_and_decode(docs, tokenizer, id_col, text_col)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
