"""Token-id files: independent zstandard frames with a trailing seek table.

A file holds the ids of consecutive documents as one stream of little-endian
unsigned integers (16 bits where the vocabulary allows, else 32), cut into frames that
decompress on their own.  After the data come two skippable frames, so that any
zstandard reader still decodes the file:

* the document index: ``magic, size``, then a zstandard frame of the arrays
  ``doc_ids`` (i64), ``known`` (u8, 0 for a null id) and ``n_tokens`` (u64)
  behind a header ``<QB``: number of documents, bytes an id;
* the seek table of the seekable format: ``magic, size``, per frame compressed
  size, decompressed size and checksum (low 32 bits of XXH64 of the
  decompressed bytes) as u32, then ``<IBI``: number of frames, flags, magic.

Readers fetch the tail, look up the frames that cover a document, and decompress
only those, each against its checksum.

Files are written by tasks over ranges of ``doc_id``.  Names are unique to an
attempt, and a manifest with one row per file of a finished task says which
count, so that lost executors and repeated attempts leave nothing wrong behind.
The folder is any place that ``pyarrow.fs`` opens and all executors share.
"""

from __future__ import annotations

import json
import string
import struct
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagweave.llm.arrow import Batches, texts
from tagweave.llm.bpe import ChunkCache, kept, tokenizer_spec
from tagweave.llm.common import materialize, narrow, shuffle_tasks
from tagweave.session import scratch_path

# fixed values of the seekable format
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUM_FLAG = 0x80
FOOTER = struct.Struct("<IBI")
#: Bytes of ids in a frame: a frame closes after the document that reaches the
#: first, and is cut inside a document at the second.
FRAME_BYTES, MAX_FRAME_BYTES = 256 << 10, 4 << 20
#: Chunks of a generation that a worker keeps (it holds no encoder of its own beside them).
CACHED_CHUNKS = 400_000
#: Documents of a file at most, about.
FILE_DOCS = 1_000_000
#: Pieces of a joined call, their longest, and the code points that may take part.
JOINED_CHUNKS, JOINED_CHARS, JOINABLE = 512, 40, range(0x21, 0x250)
#: Runs of marks behind a word whose ids a worker keeps.
KEPT_TAILS = 10_000
MANIFEST = "part int, path string, docs long, tokens long, frames long, bytes long"


def open_folder(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pyarrow.fs.FileSystem.from_uri(uri)


class Writer:
    """Streams documents into one file; holds a frame and the index."""

    def __init__(self, sink, id_bytes: int, level: int = 3):
        self.sink, self.dtype = sink, np.dtype(f"<u{id_bytes}")
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.buffer, self.frames = bytearray(), []
        self.doc_ids, self.known, self.n_tokens = array("q"), bytearray(), array("Q")
        self.written = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id if doc_id is not None else 0)
        self.known.append(doc_id is not None)
        self.n_tokens.append(len(ids))
        self.buffer += ids.astype(self.dtype).tobytes()
        while len(self.buffer) >= MAX_FRAME_BYTES:
            self._frame(MAX_FRAME_BYTES)
        if len(self.buffer) >= FRAME_BYTES:
            self._frame(len(self.buffer))

    def _frame(self, size: int) -> None:
        raw = bytes(self.buffer[:size])
        del self.buffer[:size]
        data = self.compress(raw)
        self.frames.append((len(data), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self._put(data)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.written += len(data)

    def close(self) -> None:
        if self.buffer:
            self._frame(len(self.buffer))
        index = struct.pack("<QB", len(self.doc_ids), self.dtype.itemsize)
        index += np.array(self.doc_ids, "<i8").tobytes() + bytes(self.known) + np.array(self.n_tokens, "<u8").tobytes()
        data = self.compress(index)
        self._put(struct.pack("<II", SKIPPABLE_INDEX, len(data)) + data)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        table += FOOTER.pack(len(self.frames), CHECKSUM_FLAG, SEEKABLE)
        self._put(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.sink.close()


class Reader:
    """Random access to one file."""

    def __init__(self, source):
        self.source, size = source, source.size()
        n, flags, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        table = size - FOOTER.size - 12 * n
        if struct.unpack("<II", self._at(table - 8, 8)) != (SKIPPABLE_SEEK, 12 * n + FOOTER.size):
            raise ValueError("damaged seek table")
        frames = np.frombuffer(self._at(table, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sums = frames[:, 2]
        self.at = np.concatenate([[0], np.cumsum(frames[:, 0])])
        self.starts = np.concatenate([[0], np.cumsum(frames[:, 1])])
        magic, length = struct.unpack("<II", self._at(int(self.at[-1]), 8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("no document index behind the frames")
        self.decompress = zstandard.ZstdDecompressor().decompress
        index = self.decompress(self._at(int(self.at[-1]) + 8, length))
        docs, id_bytes = struct.unpack_from("<QB", index)
        self.dtype, head = np.dtype(f"<u{id_bytes}"), struct.calcsize("<QB")
        self.doc_ids = np.frombuffer(index, "<i8", docs, head)
        self.known = np.frombuffer(index, "u1", docs, head + 8 * docs).astype(bool)
        self.n_tokens = np.frombuffer(index, "<u8", docs, head + 9 * docs).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.n_tokens)])
        self.read_frames, self._kept = 0, (-1, b"")

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        data = self.source.read(size)
        if len(data) != size:
            raise ValueError("the file is cut short")
        return data

    def frame(self, k: int) -> bytes:
        if self._kept[0] != k:
            size = int(self.starts[k + 1] - self.starts[k])
            raw = self.decompress(self._at(int(self.at[k]), int(self.at[k + 1] - self.at[k])), max_output_size=size)
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"checksum of frame {k} does not match")
            self.read_frames, self._kept = self.read_frames + 1, (k, raw)
        return self._kept[1]

    def ids(self, row: int) -> np.ndarray:
        """Ids of the file's document number ``row``; decompresses only its frames."""
        a, b = (int(self.offsets[row + k]) * self.dtype.itemsize for k in (0, 1))
        if a == b:
            return np.zeros(0, self.dtype)
        first, last = (int(np.searchsorted(self.starts, x, side="right")) - 1 for x in (a, b - 1))
        raw = b"".join([self.frame(k) for k in range(first, last + 1)])
        skip = a - int(self.starts[first])
        return np.frombuffer(raw, self.dtype, (b - a) // self.dtype.itemsize, skip)

    def rows_of(self, doc_ids: Iterable[int]) -> list[int]:
        return np.flatnonzero(self.known & np.isin(self.doc_ids, list(doc_ids))).tolist()


class LibraryEncoder:
    """The tokenizers library, asked once for every text between white space.

    White space never enters a token and separates words, special strings and
    normalization alike, so the ids of a text are those of its pieces in order.

    Many pieces are asked about in one call, joined by blanks.  Where a word's last token
    carries the vocabulary's end-of-word mark, the answer is cut after the words of each piece;
    the words are counted by the tokenizer's own split pattern, for pieces of characters for
    which the library was seen to agree with that count.  Other pieces, and calls whose
    marks don't add up, are asked about one by one.

    Two more rules make pieces rarer.  Where the tokenizer lower-cases, texts of code points
    below U+0100 are lower-cased as a whole first, unless a special string is in them.
    Letters and marks behind them are words of their own, so letters are asked about without
    the marks, and each run of marks once.

    A word of letters a-z is left as it is by the tokenizer's normalization and split, so its
    BPE model alone is asked about it, if the library was seen to give the same for the tokenizer.
    """

    def __init__(self, spec: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.chunks = ChunkCache(CACHED_CHUNKS, pack=bytes)
        self.pattern, self.ends, self.plain, self.one_word = None, None, frozenset(), False
        self.marks, self.tails, self.lowered = "", {}, False
        self.model, self.bare = self.tokenizer.model, False
        self._learn_joins(json.loads(spec))

    def _learn_joins(self, spec: dict) -> None:
        """Finds the characters whose pieces can be joined; none if words have no mark."""
        suffix = spec["model"].get("end_of_word_suffix")
        splits = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        if not suffix or len(splits) != 1 or not splits[0]["invert"] or "Regex" not in splits[0]["pattern"]:
            return
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        self.one_word = "[\\p{L}]+" in self.pattern.pattern.split("|")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        special = set("".join(t["content"] for t in spec["added_tokens"]) if any(
            t["content"].isalpha() for t in spec["added_tokens"]) else "<|>[]")
        tried = [chr(c) for c in JOINABLE if not chr(c).isspace() and chr(c) not in special]
        contexts = [[c, "a" + c, c + "a", "a" + c + "b", c + c, "1" + c, "." + c, c + "."] for c in tried]
        answers = iter(self.tokenizer.encode_batch_fast([x for group in contexts for x in group], add_special_tokens=False))
        agree = [[int(self.ends[next(answers).ids].sum()) == self._words(x) for x in group] for group in contexts]
        self.plain = frozenset(c for c, good in zip(tried, agree) if all(good))
        if self.one_word and self.plain.issuperset(string.ascii_letters):
            self.marks = "".join(c for c in self.plain if not c.isalnum())
            # normalizers and splits known to leave a-z as they are, byte symbols too; then every pair of letters
            known = {"NFC", "Replace", "Lowercase", "Split", "ByteLevel"}
            steps = [*(spec["normalizer"] or {}).get("normalizers", [spec["normalizer"] or {"type": "NFC"}]),
                     *spec["pre_tokenizer"]["pretokenizers"]]
            blanks = all(p["pattern"] == {"Regex": "\\s+"} for p in steps if p["type"] == "Replace")
            pairs = [a + b for a in string.ascii_lowercase for b in ("", *string.ascii_lowercase)]
            self.bare = blanks and known.issuperset(p["type"] for p in steps) and not any(
                p.get("add_prefix_space") for p in steps) and [x.tobytes() for x in self._ids(pairs)] == [
                self._bare(x) for x in pairs]
        self.special = [t["content"].lower() for t in spec["added_tokens"]]
        normalizers = (spec["normalizer"] or {}).get("normalizers", [spec["normalizer"] or {}])
        below = [chr(c) for c in range(1, 0x100) if not chr(c).isspace()]
        pairs = [(a.ids, b.ids) for a, b in zip(*(self.tokenizer.encode_batch_fast(x, add_special_tokens=False) for x in (
            ["a" + c + "b" for c in below], ["a" + c.lower() + "b" for c in below])))]
        self.lowered = {"type": "Lowercase"} in normalizers and all(self.special) and all(a == b for a, b in pairs)

    def _words(self, chunk: str) -> int:
        return len(self.pattern.findall(chunk.lower()))

    def _ids(self, chunks: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _joined(self, chunks: list[str]) -> list[bytes]:
        """Ids of pieces of plain characters, from one call."""
        ids = self._ids([" ".join(chunks)])[0]
        marks = np.flatnonzero(self.ends[ids]) + 1
        # the pattern makes one word of letters in a row; it is asked about anything else
        one = self.one_word
        words = np.cumsum([1 if one and c.isalpha() else self._words(c) for c in chunks])
        if words[-1] != len(marks) or marks[-1] != len(ids):
            return [x.tobytes() for x in self._ids(chunks)]
        cuts, raw, width = (marks[words - 1] * self.dtype.itemsize).tolist(), ids.tobytes(), 0
        out = []
        for cut in cuts:
            out.append(raw[width:cut])
            width = cut
        return out

    def _bare(self, word: str) -> bytes:
        """Ids of a word of letters a-z."""
        return array("H" if self.dtype.itemsize == 2 else "I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _tail(self, tail: str) -> bytes | None:
        """Ids of a run of marks behind letters; None if it is no word of its own there."""
        if tail not in self.tails:
            if len(self.tails) >= KEPT_TAILS:
                self.tails.clear()
            alone, behind, letter = (x.tobytes() for x in self._ids([tail, "a" + tail, "a"]))
            own = self.pattern.findall("a" + tail) == ["a", tail] and behind == letter + alone
            self.tails[tail] = alone if own else None
        return self.tails[tail]

    def _new(self, chunks: list[str]) -> list[bytes]:
        found: dict[str, bytes] = {}
        plain, ended, rest, known = [], [], [], self.chunks.young
        is_plain, marks, bare = self.plain.issuperset, self.marks, self.bare
        asked = set()
        for c in chunks:
            if len(c) > JOINED_CHARS or not is_plain(c):
                rest.append(c)
                continue
            word = c.rstrip(marks)
            if len(word) < len(c) and word.isalpha() and (tail := self._tail(c[len(word):])) is not None:
                ended.append((c, word, tail))
                c = word
                if c in known:
                    continue
            if c in asked:
                continue
            asked.add(c)
            if bare and c.isascii() and c.isalpha() and c.islower():
                found[c] = self._bare(c)
            else:
                plain.append(c)
        for at in range(0, len(plain), JOINED_CHUNKS):
            part = plain[at:at + JOINED_CHUNKS]
            found.update(zip(part, self._joined(part)))
        if rest:
            found.update(zip(rest, (x.tobytes() for x in self._ids(rest))))
        for c, word, tail in ended:
            if word not in known:
                known[word] = found[word]
            found[c] = known[word] + tail
        return [found[c] for c in chunks]

    def encode(self, text: str) -> np.ndarray:
        if self.lowered and _below_0x100(text):
            low = text.lower()
            if not any(s in low for s in self.special):
                text = low
        return np.frombuffer(self.chunks.encode(text, self._new), self.dtype)


def _below_0x100(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id",
                      text_col: str = "text", files: int | None = None) -> DataFrame:
    """Encode all documents and write their ids in ascending ``doc_id`` order.

    Returns the manifest, one row per file in order: ``part, path, docs, tokens,
    frames, bytes``.  Null texts count as empty, null ids come first, repeated ids
    stay together ordered by a hash of the text.  ``end_id`` is appended to each document (None: nothing).
    """
    spark = docs.sparkSession
    spec = tokenizer_spec(spark, tokenizer)
    id_bytes = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id or 0) <= 1 << 16 else 4
    end = np.array([] if end_id is None else [end_id], f"<u{id_bytes}")
    open_folder(folder)[0].create_dir(open_folder(folder)[1], recursive=True)
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()),
                        ("frames", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, encoder = None, kept(spec, LibraryEncoder)
        part = TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                if writer is None:
                    fs, root = open_folder(folder)
                    path = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.zst"
                    writer = Writer(fs.open_output_stream(path, compression=None), id_bytes)
                writer.add(doc_id, np.concatenate([encoder.encode(text), end]))
        if writer is not None:
            writer.close()
            row = (part, path.rsplit("/", 1)[1], len(writer.doc_ids), sum(writer.n_tokens), len(writer.frames),
                   writer.written)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    src = narrow(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a writer holds the index of its file, so files grow in number with the documents
    files = files or max(shuffle_tasks(spark), -(-src.count() // FILE_DOCS))
    ranged = src.repartitionByRange(files, "doc_id").sortWithinPartitions(
        "doc_id", F.xxhash64("text"))
    return materialize(ranged.mapInArrow(run, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """One row per document of the files: ``doc_id, start, ids`` (binary, little-endian u32).

    ``start`` counts the ids of all documents before it, over all files.  With
    ``doc_ids`` only the frames of those documents are read and decompressed.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
    wanted = None if doc_ids is None else sorted(set(doc_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches(schema)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, root = open_folder(folder)
                with fs.open_input_file(f"{root}/{name}") as source:
                    reader = Reader(source)
                    for row in range(len(reader.doc_ids)) if wanted is None else reader.rows_of(wanted):
                        ids = reader.ids(row).astype("<u4").tobytes()
                        doc_id = int(reader.doc_ids[row]) if reader.known[row] else None
                        yield from out.add(doc_id, base + int(reader.offsets[row]), ids, size=len(ids))
        yield from out.flush()

    # one row a file: the running sum over files is short
    before = F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")
    files = manifest.select("path", before.alias("base"))
    return files.repartition(max(1, manifest.count())).mapInArrow(run, "doc_id long, start long, ids binary")


def token_index(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write all documents, read them back: ``doc_id, start, n_tokens, ids_crc32``."""
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    manifest = write_token_files(docs, folder, tokenizer, end_id)
    return read_token_files(manifest, folder).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))
