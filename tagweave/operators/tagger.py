"""A learned mention tagger (H5): averaged structured perceptron, trained by iterative
parameter mixing, decoded by Viterbi.

An epoch sends the weights to all tasks, each task runs the perceptron over its own lines,
and the tasks' weights are averaged for the next epoch.  The weights have a fixed size (hashed
features of a word and its neighbours), so what travels is the size of the model; lines
stay where they are.  A line of text is a sequence; whole texts are read.

Texts become numbers once, a block of lines at a time; the epochs read those.  A round scores some
lines together and proves, word by word, which of them the weights tag as the rule does;
only the others are decoded.  A mistake changes the weights and starts the next round
behind its line, so the weights are those of the perceptron that goes line by line.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Outside, begin and inside of a mention; hashed features.
TAGS, BUCKETS = "OBI", 1 << 14
#: Forms of neighbours, and words, whose numbers a worker remembers.
CACHED, CACHED_WORDS = 1 << 16, 1 << 18
TOKEN = re.compile(r"\w+|[^\w\s]")
TOKEN_OR_END = re.compile(TOKEN.pattern + r"|\n")
#: Characters of the texts that become one block, if no line is longer, and what a rule can say of a word.
BLOCK_CHARS, MARKS = 1 << 18, 1 << 8
#: Words of a round, at least and at most; where mistakes are closer than this, a proof takes longer than decoding.
ROUND, PROVED = (1 << 6, 1 << 15), 1 << 9
BLOCK_SCHEMA = "shapes array<string>, own binary, word binary, starts binary, gold binary"
EPOCH_SCHEMA = "task int, last binary, total binary, lines long, tasks long"
#: Tasks whose weights the driver adds without a round of sums in tasks.
FAN_IN = 8
#: A mention can't go on behind another tag than begin or inside.
ALLOWED = np.array([[True, True, False], [True, True, True], [True, True, True]])
#: The same, with a line's start as the fourth tag; beyond any weights.
_FOLLOWS, FAR = np.vstack([ALLOWED, ALLOWED[0]]), 1e200


class _Classes(dict):
    """A character's class by its code: X for capitals, x for other letters, 0 for digits, else the character."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = self[code] = "X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c
        return kind


CLASSES = _Classes()


@lru_cache(CACHED)
def _cut(marks: str) -> str:
    return re.sub(r"(.)\1+", r"\1\1", marks)


def shape(word: str) -> str:
    """The classes of a word's characters; runs of one are cut to two."""
    return _cut(word[:20].translate(CLASSES))


def _place(mark: str) -> int:
    return zlib.crc32(mark.encode()) % BUCKETS


@lru_cache(CACHED)
def _form_places(first: str, before: str, own: str, after: str) -> tuple[tuple[int, ...], int]:
    marks = (f"0{own}", f"1{before}|{own}", f"2{own}|{after}", f"3{before}|{own}|{after}")
    return tuple(map(_place, marks)), _place(f"5{first}|{before}|{own}")


def _word_place(word: str) -> int:
    return _place(f"4{word.lower()}")


class Block(NamedTuple):
    """Lines as numbers.  ``own``: each word's form, as its place in ``shapes``; ``word``: its hashed place;
    ``starts``: the first word of each line, and behind them the number of words."""

    shapes: list[str]
    own: np.ndarray
    word: np.ndarray
    starts: np.ndarray

    def features(self) -> np.ndarray:
        """Word by feature: hashed places of the word's form and its neighbours'."""
        n, starts = len(self.own), self.starts
        if not n:
            return np.zeros((0, 6), np.int64)
        shapes = ["<", ">", *self.shapes]
        size, own = len(shapes), self.own.astype(np.int64) + 2
        first, before, after = (np.zeros(n, np.int64) for _ in range(3))
        first[2:], before[1:], after[:-1] = own[:-2], own[:-1], own[1:]
        first[starts[:-1]] = before[starts[:-1]] = 0
        first[np.minimum(starts[:-1] + 1, starts[1:] - 1)] = 0
        after[starts[1:] - 1] = 1
        left, lefts = pd.factorize(first * size + before)
        right, rights = pd.factorize(own * size + after)
        at, both = pd.factorize(left * len(rights) + right)
        lefts, rights = lefts[both // len(rights)], rights[both % len(rights)]
        forms = [_form_places(shapes[f], shapes[b], shapes[o], shapes[a]) for f, b, o, a in
                 zip((lefts // size).tolist(), (lefts % size).tolist(), (rights // size).tolist(), (rights % size).tolist())]
        flat = np.empty((6, n), np.int64)
        flat[:4] = np.array([x[0] for x in forms]).T[:, at]
        flat[4] = self.word
        flat[5] = np.array([x[1] for x in forms])[at]
        return flat.T


def features(words: list[str]) -> np.ndarray:
    """Word by feature, of one line."""
    shapes: dict[str, int] = {}
    own = [shapes.setdefault(shape(w), len(shapes)) for w in words]
    return Block(list(shapes), np.array(own, np.int64), np.array([_word_place(w) for w in words], np.int64),
                 np.array([0, len(words)])).features()


class Words(dict):
    """A word as one number: its form's place in ``shapes``, what ``mark`` says of it, its hashed place."""

    def __init__(self, mark: Callable[[str], int] | None):
        super().__init__({"\n": -1})
        self.mark, self.shapes = mark, {}

    def __missing__(self, word: str) -> int:
        form = self.shapes.setdefault(shape(word), len(self.shapes))
        number = self[word] = (form * MARKS + (self.mark(word) if self.mark else 0)) * BUCKETS + _word_place(word)
        return number


def _pieces(texts: Iterable[str | None]) -> Iterator[tuple[int, str]]:
    """The texts with their numbers; long ones are cut between lines."""
    for k, text in enumerate(texts):
        text, at = text or "", 0
        while len(text) - at > BLOCK_CHARS:
            end = text.rfind("\n", at, at + BLOCK_CHARS)
            end = text.find("\n", at) if end < 0 else end
            if end < 0:
                break
            yield k, text[at:end]
            at = end + 1
        yield k, text[at:]


def blocks(texts: Iterable[str | None], mark: Callable[[str], int] | None = None) -> Iterator[tuple[Block, np.ndarray, list[str], np.ndarray]]:
    """Blocks of the lines that have words, with the words' marks, the words, and the number of each line's text."""
    known, rows, size = Words(mark), [], 0

    def block() -> tuple[Block, np.ndarray, list[str], np.ndarray] | None:
        tokens = TOKEN_OR_END.findall("\n".join(p for _, p in rows))
        numbers = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        end = numbers < 0
        numbers, line = numbers[~end], np.cumsum(end)[~end]
        if not len(numbers):
            return None
        starts = np.append(np.flatnonzero(np.diff(line, prepend=-1)), len(numbers))
        own, used = pd.factorize(numbers // (MARKS * BUCKETS))
        shapes = list(known.shapes)
        text = np.repeat([k for k, _ in rows], [p.count("\n") + 1 for _, p in rows])[line[starts[:-1]]]
        if len(known) > CACHED_WORDS:
            known.clear()
            known.update({"\n": -1})
            known.shapes.clear()
        return (Block([shapes[k] for k in used], own, numbers % BUCKETS, starts), numbers // BUCKETS % MARKS,
                [t for t in tokens if t != "\n"], text)

    for k, piece in _pieces(texts):
        if rows and size + len(piece) > BLOCK_CHARS:
            if made := block():
                yield made
            rows, size = [], 0
        rows.append((k, piece))
        size += len(piece) + 1
    if rows and (made := block()):
        yield made


def rule_tags(rule: Callable[[list[str]], list[int]], marks: np.ndarray, words: list[str], starts: np.ndarray) -> np.ndarray:
    """The rule's tags of a block: at once if it has ``mark`` (of a word) and ``tags`` (of marks), else line by line."""
    if hasattr(rule, "mark"):
        return rule.tags(marks, starts)
    at = starts.tolist()
    return np.array([t for a, b in zip(at, at[1:]) for t in rule(words[a:b])], np.int64)


class Weights:
    """Emission weights (bucket x tag) and transitions (tag x tag) as one vector."""

    SIZE = BUCKETS * len(TAGS) + len(TAGS) ** 2

    def __init__(self, flat: np.ndarray | None = None):
        self.flat = np.zeros(self.SIZE) if flat is None else flat
        self.emit = self.flat[:BUCKETS * len(TAGS)].reshape(BUCKETS, len(TAGS))
        self.move = self.flat[BUCKETS * len(TAGS):].reshape(len(TAGS), len(TAGS))

    def scores(self, feats: np.ndarray) -> np.ndarray:
        """Word by tag, without what stands beside it."""
        scores = np.zeros((len(feats), len(TAGS)))
        for column in feats.T:
            scores += self.emit.take(column, axis=0)
        return scores

    def decode(self, feats: np.ndarray) -> np.ndarray:
        """The best allowed tags of a line (Viterbi)."""
        return self.best(self.scores(feats))

    def best(self, scores: np.ndarray) -> np.ndarray:
        if not len(scores):
            return np.zeros(0, np.int64)
        # plain numbers: three tags are too few for arrays; of equal paths the first tag's wins
        scores = scores.tolist()
        (oo, ob, oi), (bo, bb, bi), (io, ib, ii) = np.where(ALLOWED, self.move, -np.inf).tolist()
        o, b, i = (s if ok else -math.inf for s, ok in zip(scores[0], ALLOWED[0].tolist()))
        back = []
        for so, sb, si in scores[1:]:
            to_o, o1, to_b, b1, to_i, i1 = 0, o + oo, 0, o + ob, 0, o + oi
            if b + bo > o1:
                to_o, o1 = 1, b + bo
            if i + io > o1:
                to_o, o1 = 2, i + io
            if b + bb > b1:
                to_b, b1 = 1, b + bb
            if i + ib > b1:
                to_b, b1 = 2, i + ib
            if b + bi > i1:
                to_i, i1 = 1, b + bi
            if i + ii > i1:
                to_i, i1 = 2, i + ii
            back.append((to_o, to_b, to_i))
            o, b, i = o1 + so, b1 + sb, i1 + si
        last = (o, b, i)
        tags = [last.index(max(last))]
        for step in reversed(back):
            tags.append(step[tags[-1]])
        return np.array(tags[::-1])

    def limits(self) -> np.ndarray:
        """By a word's tag, between those of its neighbours, and another tag: what the transitions can add, at most,
        to a way that takes the other tag.  What two changed words add between them is shared out."""
        move = np.where(ALLOWED, self.move, -FAR)
        enter = move[:, None, :] - move[:, :, None]
        enter[0, :, 2] = (move[1:, 2, None] - move[1:]).max(axis=0)  # inside is never behind outside, but behind a changed word
        leave = (move - move[:, :, None, None] - enter[:, :, None]).max(axis=3)
        left, right = np.zeros((4, 3, 3)), np.zeros((3, 4, 3))
        left[:3], right[:, :3], left[3, :, 2] = enter, leave, -FAR  # the fourth: a line's end
        limits = left[:, :, None] + right
        limits[:, range(3), :, range(3)] = -FAR
        return limits.reshape(-1, 3)

    def doubtful(self, scores: np.ndarray, gold: np.ndarray, beside: np.ndarray, starts: np.ndarray) -> Iterator[int]:
        """The lines, in order, whose best tags aren't proven to be ``gold``.

        Another way through a line gains, over each stretch of words in which it differs, no more than the sum
        of the words' bounds.  Stretches whose bounds don't sum below zero are looked into tag by tag."""
        least = -1e-15 * len(gold) ** 2 * (1 + abs(scores).max() + 9 * abs(self.move).max())  # beyond all rounding
        sums = np.cumsum((scores + self.limits().take(beside, axis=0)).max(axis=1) - scores.ravel().take(np.arange(0, 3 * len(gold), 3) + gold))
        lowest = np.minimum.accumulate(np.append(0.0, sums[:-1]))
        words = np.flatnonzero(np.maximum.accumulate(sums[::-1])[::-1] - lowest >= least)
        if not len(words):
            return
        lines = np.searchsorted(starts, words, side="right") - 1
        cuts = np.flatnonzero((np.diff(words) > 1) | (np.diff(lines) > 0)) + 1
        move, done = np.where(ALLOWED, self.move, -math.inf).tolist(), -1
        for a, b, line in zip(words[np.append(0, cuts)].tolist(), words[np.append(cuts - 1, -1)].tolist(), lines[np.append(0, cuts)].tolist()):
            if line != done:
                before = None if a == starts[line] else int(gold[a - 1])
                after = None if b + 1 == starts[line + 1] else int(gold[b + 1])
                if not _stays(scores[a:b + 1].tolist(), gold[a:b + 1].tolist(), before, after, move, least):
                    yield line
                    done = line

    def add(self, feats: np.ndarray, tags: np.ndarray, step: float) -> None:
        np.add.at(self.emit, (feats, tags[:, None]), step)
        np.add.at(self.move, (tags[:-1], tags[1:]), step)


def _stays(scores: list[list[float]], gold: list[int], before: int | None, after: int | None, move: list[list[float]], least: float) -> bool:
    """Whether every other way through these words, between these tags, gains less than ``least``."""
    gains, last = [-math.inf] * 3, before
    for score, own in zip(scores, gold):
        base = 0.0 if last is None else move[last][own]
        start = [0.0, 0.0, -math.inf] if last is None else move[last]
        ways = [max(gains[0] + move[0][j], gains[1] + move[1][j], gains[2] + move[2][j]) for j in range(3)]
        if ways[own] - base >= least:
            return False
        gains = [-math.inf if j == own else max(ways[j], start[j]) - base + score[j] - score[own] for j in range(3)]
        last = own
    if after is None:
        return max(gains) < least
    return max(gains[i] + move[i][after] for i in range(3)) - move[last][after] < least


class Learner:
    """The perceptron over a task's lines; ``late`` is the changes, each weighed by its place, for the mean of all weights on the way."""

    def __init__(self, flat: np.ndarray):
        self.weights, self.late, self.lines, self.round = Weights(flat), Weights(), 0, ROUND[0]

    def learn(self, feats: np.ndarray, gold: np.ndarray, starts: np.ndarray) -> None:
        before, after = np.append(3, gold[:-1]), np.append(gold[1:], 3)
        before[starts[:-1]] = after[starts[1:] - 1] = 3
        beside, at, lines = (before * 3 + gold) * 4 + after, 0, len(starts) - 1
        allowed = _FOLLOWS[before, gold].all()  # a rule may give tags that no decoding does
        while at < lines:
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + self.round, side="right")) - 1)
            a, b = starts[at], starts[end]
            scores, own = self.weights.scores(feats[a:b]), starts[at:end + 1] - a
            proved = allowed and self.round >= PROVED
            for line in self.weights.doubtful(scores, gold[a:b], beside[a:b], own) if proved else range(end - at):
                x, y = own[line], own[line + 1]
                found = self.weights.best(scores[x:y])
                if (found != gold[a + x:a + y]).any():
                    for target, step in ((self.weights, 1.0), (self.late, float(self.lines + at + line))):
                        target.add(feats[a + x:a + y], gold[a + x:a + y], step)
                        target.add(feats[a + x:a + y], found, -step)
                    at, self.round = at + line + 1, max(ROUND[0], int(y))
                    break
            else:
                at, self.round = end, min(ROUND[1], 2 * self.round)
        self.lines += lines


def spans(words: list[str], tags) -> list[str]:
    """The mentions of a line."""
    out: list[list[str]] = []
    for w, t in zip(words, tags):
        if TAGS[t] == "B":
            out.append([w])
        elif TAGS[t] == "I":
            out[-1].append(w)
    return [" ".join(m) for m in out]


def _encoder(rule: Callable[[list[str]], list[int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("shapes", pa.list_(pa.string()))] + [(c, pa.binary()) for c in ("own", "word", "starts", "gold")])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (text.as_py() for batch in batches for text in batch.column(0))
        for block, marks, words, _ in blocks(texts, getattr(rule, "mark", None)):
            row = {"shapes": block.shapes, "own": block.own.astype(np.min_scalar_type(len(block.shapes))).tobytes(),
                   "word": block.word.astype(np.min_scalar_type(BUCKETS - 1)).tobytes(), "starts": block.starts.astype(np.int64).tobytes(),
                   "gold": rule_tags(rule, marks, words, block.starts).astype(np.int8).tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    return encode


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, np.ndarray]]:
    for batch in batches:
        for shapes, own, word, starts, gold in zip(*batch.columns):
            shapes = shapes.as_py()
            yield (Block(shapes, np.frombuffer(own.as_py(), np.min_scalar_type(len(shapes))), np.frombuffer(word.as_py(), np.min_scalar_type(BUCKETS - 1)),
                         np.frombuffer(starts.as_py(), np.int64)), np.frombuffer(gold.as_py(), np.int8).astype(np.int64))


def fit_tagger(docs: DataFrame, rule: Callable[[list[str]], list[int]], text_col: str = "text", epochs: int = 3) -> np.ndarray:
    """Weights learned from the tags that ``rule`` gives a line's words.  Null and empty texts have
    no line; without any line the weights are zero and nothing is tagged.  The lines as numbers,
    some 4 bytes a word, are on the executors' disks meanwhile."""
    spark, weights = docs.sparkSession, np.zeros(Weights.SIZE)
    average = weights
    parts = docs.rdd.getNumPartitions()
    schema = pa.schema([("task", pa.int32()), ("last", pa.binary()), ("total", pa.binary()), ("lines", pa.int64()), ("tasks", pa.int64())])
    encoded = docs.select(F.col(text_col).cast("string")).mapInArrow(_encoder(rule), BLOCK_SCHEMA).persist(StorageLevel.DISK_ONLY)
    try:
        for _ in range(epochs):
            shared = spark.sparkContext.broadcast(weights)

            def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                from pyspark import TaskContext

                learner = Learner(shared.value.copy())
                for block, gold in _encoded(batches):
                    learner.learn(block.features(), gold, block.starts)
                if n := learner.lines:
                    total = learner.weights.flat * n - learner.late.flat
                    yield pa.RecordBatch.from_pylist([{"task": TaskContext.get().partitionId(), "last": learner.weights.flat.tobytes(), "total": total.tobytes(),
                                                       "lines": n, "tasks": 1}], schema=schema)

            def add(pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values("task")
                sums = {c: sum(map(np.frombuffer, pdf[c])).tobytes() for c in ("last", "total")}
                return pd.DataFrame([{"task": pdf["task"].min(), **sums, "lines": pdf["lines"].sum(), "tasks": pdf["tasks"].sum()}])

            # all tasks at once, their weights summed in groups; a few sums come back
            sums = encoded.mapInArrow(train, EPOCH_SCHEMA)
            if parts > FAN_IN:
                groups = round(math.sqrt(parts))
                sums = sums.withColumn("to", F.col("task") % groups).groupBy("to").applyInPandas(lambda pdf: add(pdf.drop(columns="to")), EPOCH_SCHEMA)
            last, total, lines, tasks = np.zeros(Weights.SIZE), np.zeros(Weights.SIZE), 0, 0
            try:
                for r in sorted(sums.collect(), key=lambda r: r.task):
                    last, total = last + np.frombuffer(bytes(r.last)), total + np.frombuffer(bytes(r.total))
                    lines, tasks = lines + r.lines, tasks + r.tasks
            finally:
                shared.destroy()
            if not lines:
                break
            weights, average = last / tasks, total / lines
    finally:
        encoded.unpersist()
    return average


def mentions(texts: Iterable[str | None], mark: Callable[[str], int] | None, tag: Callable[..., np.ndarray]) -> list[list[str]]:
    """The mentions of each text, by the tags that ``tag`` gives a block, its marks and its words."""
    texts = list(texts)
    out: list[list[str]] = [[] for _ in texts]
    for block, marks, words, text in blocks(texts, mark):
        at, tags = block.starts.tolist(), tag(block, marks, words).tolist()
        for a, b, k in zip(at, at[1:], text.tolist()):
            out[k] += spans(words[a:b], tags[a:b])
    return out


def rule_mentions(texts: Iterable[str | None], rule: Callable[[list[str]], list[int]]) -> list[list[str]]:
    """The mentions of each text by the rule."""
    return mentions(texts, getattr(rule, "mark", None), lambda block, marks, words: rule_tags(rule, marks, words, block.starts))


def tag_mentions(docs: DataFrame, weights: np.ndarray, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, mentions`` (array of strings, in the order of the text) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = Weights(shared.value)

        def tag(block: Block, *_) -> np.ndarray:
            scores, at = w.scores(block.features()), block.starts.tolist()
            return np.concatenate([w.best(scores[a:b]) for a, b in zip(at, at[1:])])

        for s in batches:
            yield pd.Series(mentions(s, None, tag))

    return docs.select(F.col(id_col).alias("id"), run(F.col(text_col).cast("string")).alias("mentions"))
