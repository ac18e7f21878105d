"""Scoring by a hashed maximum-entropy language model.

P(word | context) = P(superclass | context) * P(class | superclass, context) * P(word | class, context), each factor
log-linear in hashed features of the context: the word before, the word before that (a skip feature), and both as
a pair. The most frequent words are classes of their own; the other frequent words, ordered by their endings, are cut
into classes of equal size, and neighbouring classes make up a superclass. Every other word, seen or not, belongs
to the class into whose endings it falls; there it shares one outcome, within which its probability
is its smoothed share of the counts. An outcome for unseen words is among these, so all probabilities sum to 1.

Training: word counts; then each document once as an array of ids, which all later passes read. A pass over
all training documents counts features with outcomes, from which the weights start. Then ROUNDS synchronous gradient
updates, each from another part of the training documents, so that every one takes part in one: tasks
sum observed less expected counts under the current weights, and each weight moves along its sum,
scaled by how often it was observed.

The tables of features and the MORE most frequent words have fixed sizes (some 25 MB); they are all that executors are
sent. Counts of rarer words grow with the corpus and never leave the cluster: they are joined with each document's rare words.

Cases: null and empty texts have the end token alone; a null id is held out; repeated rows are scored
each, and learnt from each; with no training documents every token has the base probability of an
unknown word; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, free_shuffles, keep, mapped, read, resident

#: Classes of one word; classes by ending, and their outcomes (the last one: all rarer words).
SINGLE, GROUPS, SLOTS = 32, 224, 48
CLASSES, HEAD = SINGLE + GROUPS, SINGLE + GROUPS * (SLOTS - 1)
#: Superclasses, of as many classes each.
SUPER = 16
#: Ids: words of the head, then rarer words by their classes, then what stands before a text.
RARE, START = HEAD, HEAD + CLASSES
#: Words whose counts executors are sent; rarer ones are joined with theirs.
MORE = 100_000


class Level(NamedTuple):
    """A factor: its softmaxes, their outcomes, and the bits of each feature's own rows in one of them."""

    nodes: int
    outcomes: int
    bits: tuple[int, ...]

    @property
    def rows(self) -> int:
        return sum(1 << b for b in self.bits)

    @property
    def weights(self) -> int:
        return self.nodes * self.rows * self.outcomes


LEVELS = (Level(1, SUPER, (14, 13, 15)), Level(SUPER, CLASSES // SUPER, (10, 9, 11)), Level(GROUPS, SLOTS, (7, 6, 6)))
#: Weights of all tables, and of one block when they are summed.
WEIGHTS, BLOCK = sum(level.weights for level in LEVELS), 1 << 16
ROUNDS, RATE = 3, 0.4
#: Prior observations of a feature, and the share of its own log-odds that a weight starts with.
PRIOR, SHARE = 5.0, 0.4
ADD = 0.1
END = b"\n"
#: Tokens that one array operation takes, and that are held at once.
STEP, HELD = 4096, 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)


#: For each byte: whether it parts words, and its lower case (A-Z).
SPACE, LOWER = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8)), np.frombuffer(bytes(range(256)).lower(), np.uint8)


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words and the end token, which no word equals."""
    words = text.encode().lower().split()
    words.append(END)
    return words


def words_of_all(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts (the last one: END), the number of each token's word, and each text's end among the tokens."""
    texts = texts.cast(pa.large_string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    own = ends[:-1][ends[:-1] < len(data)]
    first[own] = inside[own]  # words don't go on from text to text
    starts = np.flatnonzero(first)
    letters = LOWER[data[inside]]
    bounds = np.append(np.cumsum(inside, dtype=np.int32)[starts] - 1, len(letters)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
    words = pa.concat_arrays([found.dictionary, pa.array([END], pa.binary())])
    ends = np.searchsorted(starts, ends[1:]) + np.arange(1, len(texts) + 1)
    tokens = np.full(len(starts) + len(texts), len(words) - 1, np.int64)
    of_words = np.ones(len(tokens), bool)
    of_words[ends - 1] = False
    tokens[of_words] = found.indices.to_numpy()
    return words, tokens, ends


class Vocabulary(dict):
    """word -> id; head: (word, count) by falling count. Rarer words are classed when asked for."""

    def __init__(self, head: list[tuple[bytes, int]]):
        super().__init__((w, i) for i, (w, _) in enumerate(head))
        self.classes = np.zeros(START + 1, np.int64)
        self.slots = np.full(START + 1, SLOTS - 1)
        self.classes[RARE:START], self.classes[: min(SINGLE, len(head))] = np.arange(CLASSES), np.arange(min(SINGLE, len(head)))
        by_ending = sorted(range(SINGLE, len(head)), key=lambda i: head[i][0][::-1])
        self.starts = []
        for g, run in enumerate(np.array_split(np.array(by_ending, np.int64), GROUPS)):
            self.classes[run], self.slots[run] = SINGLE + g, np.arange(len(run))
            if len(run):
                self.starts.append(head[run[0]][0][::-1])

        self.nodes = (np.zeros_like(self.classes), self.classes // SUPER, self.classes - SINGLE)
        self.outcomes = (self.classes // SUPER, self.classes % SUPER, self.slots)

    def __missing__(self, word: bytes) -> int:
        return RARE + SINGLE + max(0, bisect_right(self.starts, word[::-1]) - 1)


def tables(weights: np.ndarray) -> list[np.ndarray]:
    """Views of the levels' tables: (nodes * rows, outcomes)."""
    ends = np.cumsum([level.weights for level in LEVELS])
    return [weights[end - level.weights : end].reshape(-1, level.outcomes) for level, end in zip(LEVELS, ends.tolist(), strict=True)]


@dataclass
class Model:
    """Counts of the head and of the classes' rarer words (tokens, distinct), and the weights."""

    head: list[tuple[bytes, int]]
    rare: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        v = self.vocabulary = Vocabulary(self.head)
        c = np.array([c for _, c in self.head], float)
        self.tokens, self.distinct = int(c.sum() + self.rare[0].sum()), int(len(c) + self.rare[1].sum())
        self.log_all = np.log10(self.tokens + ADD * (self.distinct + 1))
        self.log_count = np.zeros(START + 1)  # rare words: added by the join
        self.log_count[: len(c)] = np.log10(c + ADD)
        rest = self.rare[0] + ADD * (self.rare[1] + 1)
        self.log_rest = np.zeros(START + 1)
        self.log_rest[RARE:START] = np.log10(rest)
        words = np.zeros((GROUPS, SLOTS))
        own, slot = v.classes[: len(c)], v.slots[: len(c)]
        grouped = own >= SINGLE
        words[own[grouped] - SINGLE, slot[grouped]] = c[grouped]
        words[:, -1] = rest[SINGLE:]
        classes = np.zeros(CLASSES)
        classes[own[~grouped]] = c[~grouped]
        classes[SINGLE:] = words.sum(axis=1)
        above = classes.reshape(SUPER, -1)
        with np.errstate(divide="ignore", invalid="ignore"):
            shares = (above.sum(axis=1)[None, :], above, words)
            self.priors = [np.nan_to_num(np.log(x / x.sum(axis=1, keepdims=True)), nan=-np.inf, neginf=-np.inf).astype(np.float32) for x in shares]
        self.tables = tables(self.weights)

    @cached_property
    def odds(self) -> list[np.ndarray]:
        """exp of the tables, the prior within each node's first feature. A weight is a damped logarithm of a ratio of counts
        and some steps, so a product of three is far from what single precision can't hold."""
        out = []
        for level, table, prior in zip(LEVELS, self.tables, self.priors, strict=True):
            own = np.exp(table)
            own.reshape(level.nodes, level.rows, level.outcomes)[:, : 1 << level.bits[0]] *= np.exp(prior)[:, None]
            out.append(own)
        return out


def keys_of(ids: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """The features of the contexts, hashed."""
    one, two = (ids[places - k].astype(np.uint64) for k in (1, 2))
    return [(key + np.uint64(1)) * MIX for key in (one, two, two << np.uint64(16) | one)]


def rows_of_features(level: Level, nodes: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """(features, places) rows of a level's table, each feature in rows of its own."""
    out = np.empty((len(keys), len(nodes)), np.int64)
    base = nodes * level.rows
    for row, key, b in zip(out, keys, level.bits, strict=True):
        np.add((key >> np.uint64(64 - b)).view(np.int64), base, out=row)
        base += 1 << b
    return out


class Step:
    """Array operations on a level, for STEP places at most, in memory that is taken once: new pages cost more than sums."""

    def __init__(self, level: Level):
        self.p, self.factor, self.numbers = (np.empty((STEP, level.outcomes), t) for t in (np.float32, np.float32, float))
        self.pairs = np.arange(level.outcomes // 2)
        self.places = np.empty((STEP, len(self.pairs)), np.int64)

    def products(self, odds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, outcomes) probabilities but for a factor of each place, and the factors."""
        p, factor = self.p[: rows.shape[1]], self.factor[: rows.shape[1]]
        np.take(odds, rows[0], axis=0, out=p, mode="clip")
        for row in rows[1:]:
            np.take(odds, row, axis=0, out=factor, mode="clip")
            p *= factor
        return p, np.einsum("ij->i", p)

    def subtract(self, table: np.ndarray, rows: np.ndarray, p: np.ndarray) -> None:
        """table[rows[k, i]] -= p[i] for all k and i, two outcomes at once as a complex number."""
        numbers, places = self.numbers[: len(p)], self.places[: len(p)]
        numbers[:] = p
        table, numbers = (x.reshape(-1).view(np.complex128) for x in (table, numbers))
        for row in rows:
            np.add((row * len(self.pairs))[:, None], self.pairs, out=places)
            np.subtract.at(table, places.reshape(-1), numbers)


COUNTED = "word binary, c long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pending, held = [], 0

    def merged() -> pa.Table:
        return pa.concat_tables(pending).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

    for b in batches:
        words, tokens, _ = words_of_all(b.column("text"))
        pending.append(pa.table({"word": words, "c": np.bincount(tokens, minlength=len(words))}))
        held += len(words)
        if held >= 600_000:
            pending = [merged()]
            if (held := pending[0].num_rows) >= 300_000:
                yield from pending[0].to_batches()
                pending, held = [], 0
    if pending:
        yield from merged().to_batches()


def _rarer(words: Callable[[], Vocabulary]) -> Callable:
    """Tokens and distinct words of each class that the head lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, out = words(), np.zeros((2, CLASSES), np.int64)
        for b in batches:
            own = np.fromiter(map(v.__getitem__, b.column("word").to_pylist()), np.int64, b.num_rows)
            some = own >= RARE
            np.add.at(out[0], own[some] - RARE, b.column("c").to_numpy()[some])
            out[1] += np.bincount(own[some] - RARE, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(out[0]), pa.array(out[1])], ["class", "c", "v"])

    return run


ENCODED = "row long, doc_id long, held_out boolean, ids binary, n_more long, log_more double, rare array<struct<word:binary,tf:long>>"


def _encode(known: Callable[[], tuple[Vocabulary, dict[bytes, int]]]) -> Callable:
    """Ids; of words beyond the head with known counts the number and logarithms; the others with their frequencies."""
    names = [c.split()[0] for c in ENCODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (vocabulary, more), row = known(), TaskContext.get().partitionId() << 33
        get, count = vocabulary.__getitem__, more.get
        for b in batches:
            words, tokens, ends = words_of_all(b.column("text"))
            found = words.to_pylist()
            own_ids = np.fromiter(map(get, found), np.uint16, len(found))
            all_ids = own_ids[tokens]
            logs = np.full(len(found), np.nan)
            for i in np.flatnonzero(own_ids >= RARE).tolist():
                if c := count(found[i]):
                    logs[i] = math.log10(c + ADD)
            places = np.flatnonzero(all_ids >= RARE)
            words_there, texts_there = tokens[places], np.searchsorted(ends, places, "right")
            logs = logs[words_there]
            has = ~np.isnan(logs)
            n_more, log_more = np.bincount(texts_there[has], minlength=b.num_rows), np.bincount(texts_there[has], logs[has], b.num_rows)
            pairs, tfs = np.unique(texts_there[~has] * len(found) + words_there[~has], return_counts=True)
            upto = np.searchsorted(pairs, np.arange(b.num_rows + 1) * len(found)).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(upto), pa.StructArray.from_arrays([words.take(pa.array(pairs % len(found))), pa.array(tfs)], ["word", "tf"]))
            bounds = np.concatenate([[0], ends * all_ids.itemsize]).astype(np.int32)
            all_ids = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(bounds), pa.py_buffer(all_ids)])
            own = [pa.array(np.arange(row, row + b.num_rows)), b.column("doc_id"), b.column("held_out"), all_ids, pa.array(n_more, pa.int64()), pa.array(log_more, pa.float64())]
            yield pa.RecordBatch.from_arrays([*own, rare], names)
            row += b.num_rows

    return run


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all tokens, two starts before each text, and the places of the tokens."""
    start = np.full(2, START, np.uint16).tobytes()
    ids = np.frombuffer(b"".join([x for t in texts for x in (start, t)]), np.uint16)
    return ids, np.flatnonzero(ids != START)


def _slices(texts: list[bytes]) -> Iterator[slice]:
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t) // 2
        if held >= HELD or i + 1 == len(texts):
            yield slice(start, i + 1)
            start, held = i + 1, 0


BLOCKS = "block int, scale float, data binary"


def _blocks(vector: np.ndarray, half: bool = False) -> Iterator[pa.RecordBatch]:
    """A vector's blocks that aren't empty; half: each scaled to its largest number, in half precision."""
    for lo in range(0, len(vector), BLOCK):
        part = vector[lo : lo + BLOCK].astype(np.float32)
        if scale := float(np.abs(part).max(initial=0)):
            part = (part / scale).astype(np.float16) if half else part
            yield pa.RecordBatch.from_arrays([pa.array([lo // BLOCK], pa.int32()), pa.array([scale if half else 0.0], pa.float32()), pa.array([part.tobytes()], pa.binary())], ["block", "scale", "data"])


def _read_block(scale: float, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float16).astype(np.float32) * np.float32(scale) if scale else np.frombuffer(data, np.float32)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the blocks that meet here, as they come."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for block, scale, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            part = _read_block(scale, data)
            sums[block] = sums[block] + part if block in sums else part.astype(float)
    for block, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([0.0], pa.float32()), pa.array([s.astype(np.float32).tobytes()], pa.binary())], ["block", "scale", "data"])


def _summed(encoded: DataFrame, run: Callable) -> np.ndarray:
    """The sum over all tasks: WEIGHTS numbers, whatever the input's size; tasks are few, as each returns so many."""
    context = encoded.sparkSession.sparkContext
    tasks = max(context.defaultParallelism, encoded.rdd.getNumPartitions() // 16)
    out = np.zeros(WEIGHTS, np.float32)
    for row in mapped(mapped(encoded.select("ids").coalesce(tasks), run, BLOCKS).repartition("block"), _add, BLOCKS).collect():
        out[row.block * BLOCK : (row.block + 1) * BLOCK] = _read_block(row.scale, bytes(row.data))
    free_shuffles(encoded.sparkSession)
    return out


def observations(v: Vocabulary, ids: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level: numbers of the tokens that have it, their rows and outcomes, in the order of the first feature's rows."""
    token, keys = ids[places], keys_of(ids, places)
    for level, nodes, outcomes in zip(LEVELS, v.nodes, v.outcomes, strict=True):
        node = nodes[token]
        some = np.flatnonzero(node >= 0)
        rows = rows_of_features(level, node[some], [k[some] for k in keys] if len(some) < len(token) else keys)
        order = np.argsort(rows[0].astype(np.uint16), kind="stable")  # a table has fewer rows than 65,536
        some = some[order]
        yield some, np.take(rows, order, axis=1), outcomes[token[some]]


def _observed(words: Callable[[], Vocabulary]) -> Callable:
    """Counts of (feature, outcome)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, out = words(), np.zeros(WEIGHTS)
        for b in batches:
            texts = b.column("ids").to_pylist()
            for part in _slices(texts):
                for own, level, (_, rows, outcomes) in zip(tables(out), LEVELS, observations(v, *_joined(texts[part])), strict=True):
                    np.add.at(own.reshape(-1), (rows * level.outcomes + outcomes).ravel(), 1.0)
        yield from _blocks(out)

    return run


def _gradient(model: Callable[[], Model]) -> Callable:
    """Observed less expected counts of (feature, outcome), under the current weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, out, steps = model(), np.zeros(WEIGHTS), [Step(level) for level in LEVELS]
        for b in batches:
            texts = b.column("ids").to_pylist()
            for part in _slices(texts):
                found = observations(m.vocabulary, *_joined(texts[part]))
                for step, own, odds, (_, rows, outcomes) in zip(steps, tables(out), m.odds, found, strict=True):
                    for a in range(0, len(outcomes), STEP):
                        of = slice(a, a + STEP)
                        p, sums = step.products(odds, rows[:, of])
                        p /= sums[:, None]
                        p[np.arange(len(p)), outcomes[of]] -= 1
                        step.subtract(own, rows[:, of], p)
        yield from _blocks(out, half=True)

    return run


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_head long, base double, score double"


def token_scores(m: Model, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """log10 probabilities of the tokens; of rare words without the logarithm of their count."""
    out = np.zeros(len(places))
    for step, odds, (some, rows, outcomes) in zip(map(Step, LEVELS), m.odds, observations(m.vocabulary, ids, places), strict=True):
        for a in range(0, len(some), STEP):
            of = slice(a, a + STEP)
            p, sums = step.products(odds, rows[:, of])
            own = p[np.arange(len(p)), outcomes[of]] / sums
            out[some[of]] += np.log10(np.maximum(own.astype(float), 1e-30))
    return out - m.log_rest[ids[places]]


def _score(model: Callable[[], Model]) -> Callable:
    names = [c.split()[0] for c in SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model()
        for b in batches:
            texts = b.column("ids").to_pylist()
            for part in _slices(texts):
                ids, places = _joined(texts[part])
                token, sizes = ids[places], np.array([len(t) // 2 for t in texts[part]])
                add = lambda x, first=np.cumsum(sizes) - sizes: np.add.reduceat(x, first)
                own = [b.column(c).slice(part.start, part.stop - part.start) for c in ("row", "doc_id", "held_out")]
                sums = [sizes, add((token < RARE).astype(np.int64)), add(m.log_count[token] - m.log_all), add(token_scores(m, ids, places))]
                more = [b.column(c).slice(part.start, part.stop - part.start).to_numpy() for c in ("n_more", "log_more")]
                sums = [sums[0], sums[1] + more[0], sums[2] + more[1], sums[3] + more[1]]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, sums)], names)

    return run


def _from(sent, make: Callable) -> Callable:
    """A worker's own object, made of a broadcast value."""
    key = uuid.uuid4().hex
    return lambda: resident(key, lambda: make(sent.value))


def rows_of(docs: DataFrame, fold: int = 10, out: int = 0) -> DataFrame:
    """doc_id, text, held_out: whether crc32(id) mod fold is out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("held_out", crc_mod(F.col("doc_id"), fold) == out)


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, by falling count: as many whole classes of frequency as have most words at most."""
    level = F.floor(16 * F.log2("c"))
    least, total = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        total += r.n
        if total > most:
            break
        least = r.level
    head = [] if least is None else [(bytes(r.word), r.c) for r in counts.filter(level >= least).collect()]
    return sorted(head, key=lambda x: (-x[1], x[0]))


def start(model: Model, observed: np.ndarray) -> np.ndarray:
    """Weights from counts: a share of each feature's own log-odds against the prior, damped."""
    out = np.empty(WEIGHTS, np.float32)
    for level, own, seen, prior in zip(LEVELS, tables(out), tables(observed), model.priors, strict=True):
        for node in range(level.nodes):
            of = slice(node * level.rows, (node + 1) * level.rows)
            p = np.exp(prior[node])
            ratio = (seen[of] + PRIOR * p) / ((seen[of].sum(axis=1, keepdims=True) + PRIOR) * np.maximum(p, 1e-30))
            own[of] = np.where(p > 0, SHARE * np.log(np.maximum(ratio, 1e-30)), 0)
    return out


def _known(head: list[tuple[bytes, int]], more: list[tuple[bytes, int]]) -> tuple[Vocabulary, dict[bytes, int]]:
    """The vocabulary, which classes further words once, and their counts."""
    v = Vocabulary(head)
    v.update([(w, v[w]) for w, _ in more])
    return v, dict(more)


def train(counts: DataFrame, encode: Callable[[Callable], DataFrame], rounds: int = ROUNDS, most: int = HEAD, more: int = MORE) -> tuple[Model, DataFrame]:
    """The model and the encoded rows, from counts of the training words."""
    spark = counts.sparkSession
    found = frequent(counts, more)
    head = found[:most]
    words = _from(spark.sparkContext.broadcast(head), Vocabulary)
    rare = np.zeros((2, CLASSES))
    for r in mapped(counts, _rarer(words), "class long, c long, v long").groupBy("class").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect():
        rare[:, r["class"]] = r.c, r.v
    encoded = encode(_from(spark.sparkContext.broadcast((head, found[most:])), lambda value: _known(*value)))
    training = encoded.filter("NOT held_out")
    model = Model(head, rare, np.zeros(WEIGHTS, np.float32))
    if not model.tokens:
        return model, encoded
    send = lambda m: _from(spark.sparkContext.broadcast((m.head, m.rare, m.weights)), lambda value: Model(*value))
    observed = _summed(training, _observed(words))
    model = Model(head, rare, start(model, observed))
    for k in range(rounds):
        gradient = _summed(training.filter(F.col("row") % rounds == k), _gradient(send(model)))
        gradient /= observed / rounds + np.float32(PRIOR / rounds)
        model = Model(head, rare, model.weights + np.float32(RATE) * np.clip(gradient, -1, 1))
    return model, encoded


def scores(docs: DataFrame, fold: int = 10, out: int = 0, rounds: int = ROUNDS, most: int = HEAD, more: int = MORE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learnt from rows whose crc32(id) mod fold is not out."""
    spark = docs.sparkSession
    rows = rows_of(docs, fold, out)
    counts = keep(mapped(rows.filter("NOT held_out").select("text"), _count, COUNTED).groupBy("word").agg(F.sum("c").alias("c")), "counts")
    free_shuffles(spark)
    model, encoded = train(counts, lambda known: keep(mapped(rows, _encode(known), ENCODED), "encoded"), rounds, most, more)
    return scored(model, encoded, counts)


def scored(model: Model, encoded: DataFrame, counts: DataFrame) -> DataFrame:
    sent = _from(encoded.sparkSession.sparkContext.broadcast((model.head, model.rare, model.weights)), lambda value: Model(*value))
    own = mapped(encoded.select("row", "doc_id", "held_out", "ids", "n_more", "log_more"), _score(sent), SCORED)
    rare = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tf").join(counts, "word", "left")
    rare = rare.groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))).alias("log_rare"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("n_rare"))
    return own.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("log_rare", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("log_rare", F.lit(0.0))).alias("score"))


def op6(spark, sf_dir: str) -> DataFrame:
    return scores(read(spark, sf_dir, "documents"))
