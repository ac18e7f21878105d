"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of the character
n-grams of its words; the document's is the noisy-or of its sentences', and only documents have
labels. Training maximises the likelihood of those labels, so blame settles on the sentences that
explain them, and the same model then locates offending sentences. A word of more than WINDOW characters
(a passage in a script without spaces, say) is taken in windows, half of each in the next; the first
stays in its sentence, the others count as sentences of their own. Length alone decides nothing: a sentence
that shows no feature has probability 0, and those below WEAK count as a rate, as STEADY sentences would, in
texts of more sentences; those at or above WEAK count in full wherever they stand. The classifier is fitted on a
bounded sample of labelled rows (TRAIN_DOCS per class, texts up to TRAIN_CHARS); every whole text is scored.

Cases: null and empty texts have no sentence and score 0; a null id counts as remainder 0; labels
that are null are not used, and of repeated labels the largest holds; without labels of both classes
every text scores 0; an empty table gives an empty result; no column but the text
enters a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, id_text, mapped, read, resident

#: Labelled documents of each class that training uses at most, by hash order.
TRAIN_DOCS = 2500
#: Longer texts are not trained on (they are scored whole).
TRAIN_CHARS = 50_000
BUCKETS = 1 << 20
#: Features kept: those that occur more often in toxic documents by this many standard deviations,
#: and this many times as often as in others (what only marks a language or a genre doesn't).
Z, RATIO, FEATURES = 4.0, 5.0, 8192
#: Log-odds to which a sentence's features add.
BIAS = -11.0
#: Sentences of a lower probability are weak; the number of sentences from which weak ones count as a rate.
WEAK, STEADY = 0.1, 1000
STEPS, RATE, PENALTY = 300, 0.1, 2e-3
THRESHOLD = 0.7

SENTENCE = re.compile(r"[.!?\n\u3002\uff01\uff1f\uff61\uff0e\u061f\u06d4\u0964\u0965\u1362\u104b\u17d4]+")
EDGE = "\"'`,;:()[]{}<>*_-"
#: Characters that one window of a long word has, and what marks a window's end that is not the word's.
WINDOW, CUT = 64, "\n"


def word_features(word: str) -> np.ndarray:
    """Hashed n-grams of 3 to 6 characters, the word's ends marked."""
    marked = f"<{word}>" if CUT not in word else f"{'' if word[0] == CUT else '<'}{word.strip(CUT)}{'' if word[-1] == CUT else '>'}"
    return np.array(sorted({zlib.crc32(marked[i : i + n].encode(errors="surrogatepass")) % BUCKETS for n in (3, 4, 5, 6) for i in range(max(1, len(marked) - n + 1))}), np.int64)


def windows(word: str) -> Iterator[str]:
    """All of a long word, in windows of WINDOW characters that start half as far apart."""
    for at in range(0, len(word) - WINDOW // 2, WINDOW // 2):
        yield f"{CUT if at else ''}{word[at : at + WINDOW]}{CUT if at + WINDOW < len(word) else ''}"


def bags(text: str) -> Iterator[set[str]]:
    """The distinct words of each sentence that has any; further windows of long words after it."""
    for s in SENTENCE.split(text.lower()):
        words = {w.strip(EDGE) for w in s.split()}
        words.discard("")
        if len(s) <= WINDOW or not words or max(map(len, words)) <= WINDOW:
            if words:
                yield words
            continue
        long = sorted(w for w in words if len(w) > WINDOW)
        yield words.difference(long) | {next(windows(w)) for w in long}
        for w in long:
            for more in islice(windows(w), 1, None):
                yield {more}


def sentences(text: str) -> list[set[str]]:
    return list(bags(text))


class Model:
    def __init__(self, weights: dict[int, float]):
        self.weights = weights
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            get = self.weights.get
            found = sum(get(f, 0.0) for f in word_features(word).tolist()) if self.weights else 0.0
            if len(word) > WINDOW:
                return found
            if len(self.known) >= 500_000:
                self.known.clear()
            self.known[word] = found
        return found

    def sentence_probabilities(self, text: str) -> list[float]:
        """Of each sentence that has a word, and of each further window."""
        return [_sigmoid(BIAS + z) if (z := math.fsum(map(self.word, words))) else 0.0 for words in bags(text)]

    def score(self, text: str) -> float:
        word, n, weak, strong = self.word, 0, 0.0, 0.0
        for n, words in enumerate(bags(text), 1):
            z = math.fsum(map(word, words))
            if z:
                p = _sigmoid(BIAS + z)
                if p < WEAK:
                    weak += math.log1p(-p)
                else:
                    strong += math.log1p(-min(p, 1 - 1e-12))
        return -math.expm1(strong + weak * min(1.0, STEADY / max(n, 1)))

    def offending(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) of sentences at or above least, in characters of the text."""
        out, at = [], 0
        for m in [*SENTENCE.finditer(text), None]:
            end = m.start() if m else len(text)
            found = self.sentence_probabilities(text[at:end].replace("\n", " ")) if text[at:end].strip() else []
            if found and max(found) >= least:
                out.append((at, end, max(found)))
            at = m.end() if m else end
        return out


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def fit(texts: list[str], labels: list[int]) -> Model:
    """Fits the weights by noisy-or likelihood; the same rows in the same order give the same model."""
    y = np.array(labels, bool)
    if not y.any() or y.all():
        return Model({})
    cache: dict[str, np.ndarray] = {}

    def of(word: str) -> np.ndarray:
        if len(word) > WINDOW:
            return word_features(word)
        if word not in cache:
            cache[word] = word_features(word)
        return cache[word]

    seen = np.zeros((2, BUCKETS), np.int32)
    for text, label in zip(texts, y, strict=True):
        words = {w for s in bags(text) for w in s}
        if words:
            seen[int(label), np.unique(np.concatenate([of(w) for w in words]))] += 1
    n1, n0 = int(y.sum()), int((~y).sum())
    p1, p0 = seen[1] / n1, seen[0] / n0
    mean = (seen[0] + seen[1] + 1) / (n1 + n0 + 2)
    z = (p1 - p0) / np.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n0))
    chosen = np.argsort(-z, kind="stable")[:FEATURES]
    chosen = chosen[(z[chosen] >= Z) & (seen[1, chosen] >= 3) & (p1[chosen] >= RATIO * p0[chosen])]
    if not len(chosen):
        return Model({})
    index = np.full(BUCKETS, -1, np.int64)
    index[chosen] = np.arange(len(chosen))
    rows, columns, owner = [], [], []
    hits: dict[str, np.ndarray] = {w: f for w, all_ in cache.items() if len(f := (i := index[all_])[i >= 0])}
    none = np.zeros(0, np.int64)
    for d, text in enumerate(texts):
        for words in bags(text):
            found = [f for w in sorted(words) if len(f := hits.get(w, none) if len(w) <= WINDOW else (i := index[of(w)])[i >= 0])]
            if found:
                found = np.concatenate(found)
                rows.append(np.full(len(found), len(owner)))
                columns.append(found)
                owner.append(d)
    rows, columns, owner = np.concatenate(rows), np.concatenate(columns), np.array(owner)
    w, m, v = np.full(len(chosen), 0.1), np.zeros(len(chosen)), np.zeros(len(chosen))
    weight = np.where(y, 0.5 / n1, 0.5 / n0)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(BIAS + np.bincount(rows, w[columns], len(owner)), -60, 30)))
        clean = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), len(texts))
        q = np.exp(clean)
        pull = np.where(y, -q / np.maximum(-np.expm1(clean), 1e-12), 1.0) * weight
        g = np.bincount(columns, (pull[owner] * p)[rows], len(w)) + PENALTY * w / len(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Model({int(f): float(x) for f, x in zip(chosen, w, strict=True) if abs(x) > 1e-6})


def train(docs: DataFrame, labels: DataFrame, fold: int = 3, out: int | None = 1, per_class: int = TRAIN_DOCS) -> Model:
    """Fits on labelled documents whose crc32(id) mod fold is not out (None: on all)."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1) AND doc_id IS NOT NULL")
    if out is not None:
        rows = rows.filter(crc_mod(F.col("doc_id"), fold) != out)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    sample = rows.filter("toxic = 1").orderBy(order, "doc_id").limit(per_class).unionByName(rows.filter("toxic = 0").orderBy(order, "doc_id").limit(per_class))
    ids = sample.toPandas()  # at most 2 * per_class pairs
    if not len(ids):
        return Model({})
    sent = F.broadcast(docs.sparkSession.createDataFrame(ids))
    # of rows with one id the smallest text: at most 2 * per_class texts reach the driver
    found = id_text(docs).filter(F.char_length("text") <= TRAIN_CHARS).join(sent, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("one"))
    found = found.select("doc_id", "one.*").toPandas().sort_values("doc_id").drop_duplicates("text")
    return fit(found["text"].tolist(), found["toxic"].tolist())


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    weights = model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _resident(weights)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(own.score, b.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    return mapped(id_text(docs), run, "doc_id long, score double")


def _resident(weights: dict[int, float]) -> Model:
    """The worker's model with its cache of words."""
    return resident(("toxicity", hash(tuple(weights.items()))), lambda: Model(weights))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns, that score below the threshold."""
    weights, at = model.weights, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _resident(weights)
        for b in batches:
            yield b.filter(pa.array([own.score(t or "") < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return mapped(docs, run, docs.schema)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
