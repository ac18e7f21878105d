"""Benchmark decontamination: BM25 with block-max WAND, then overlap of question and answer.

Benchmark items are cut into pieces of at most PIECE words, the documents of a BM25 inverted index
whose postings lie in blocks with their largest weights. A document's query is the words of those of its
shingles (five words in a row) that some item has, wherever they stand. It retrieves every item with a
piece whose score reaches the item's share of the piece's score for itself; documents whose block-max
bounds can't reach that are passed over in bulk, the others run WAND with block-max skips. The share
follows from what confirms an item: at most so many of its shingles are missing that SIMILAR of them
remain, and a word is missing only where all its shingles are. If each word's weight is dealt
evenly to the shingles that have it, no more can be missing than the heaviest of so many shingles hold. So
whatever can be confirmed is retrieved. An item is confirmed on the whole document: SIMILAR of the item's
shingles occur there, some of the question's and some of the answer's among them. The question is the
item up to its last question mark (or the first half of its words), the answer the rest. The score
returned, bm25, is the best share that a piece reaches by all words of the document.

Cases: null and empty texts, on either side, hold nothing; an item of fewer than five words is one
shingle; null ids are returned as null; repeated rows are reported each; an item that occurs twice in a
document is reported once; empty tables give an empty result; other columns are not read. A benchmark
of more than BLOCK_ITEMS items is queried in blocks, all of them against all rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, mapped, read, resident

PIECE = 64
#: Pieces in a block of postings.
BLOCK = 2
#: Weights are scaled so that LEAST is every piece's threshold; SIMILAR of an item's shingles confirm it.
LEAST, SIMILAR, SHINGLE = 0.6, 0.8, 5
K1, B = 1.2, 0.75
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Items, and characters of items, that one index holds; this bounds what executors are sent.
BLOCK_ITEMS, BLOCK_CHARS = 1000, 1_000_000

PUNCTUATION = bytes(b if not (b < 128 and not chr(b).isalnum()) else 32 for b in range(256))

FOUND = "doc_id long, item_id long, bm25 double, overlap double, question_overlap double, answer_overlap double"


#: Characters of scripts written without spaces (Thai to Khmer, kana, Han), and punctuation beyond ASCII.
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
SIGNS = re.compile("[\u00a0-\u00bf\u2000-\u206f\u3000-\u3020\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def words_of(text: str) -> list[bytes]:
    """Lower-cased words; punctuation and white space separate them, and each character of an unspaced script is a word."""
    text = text.lower()
    if not text.isascii():
        text = UNSPACED.sub(r" \1 ", SIGNS.sub(" ", text))
    return text.encode(errors="surrogatepass").translate(PUNCTUATION).split()


def shingles(words: list[bytes], n: int = SHINGLE) -> set[tuple]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


class Item:
    def __init__(self, item_id: int | None, text: str):
        self.item_id, self.words = item_id, words_of(text)
        asked = max(text.rfind(mark) for mark in "?\uff1f\u061f")
        cut = len(words_of(text[: asked + 1])) if asked >= 0 else 0
        if not 0 < cut < len(self.words):
            cut = (len(self.words) + 1) // 2
        self.all, self.question, self.answer = shingles(self.words), shingles(self.words[:cut]), shingles(self.words[cut:])

    def overlaps(self, have: set[tuple], words: list[bytes]) -> tuple[float, float, float] | None:
        """Shares of the item's, the question's and the answer's shingles in a document; None: not confirmed."""
        if len(self.words) < SHINGLE:
            n = len(self.words)
            whole = tuple(self.words)
            held = any(tuple(words[i : i + n]) == whole for i in range(len(words) - n + 1))
            return (1.0, 1.0, 1.0) if held else None
        share = len(self.all & have) / len(self.all)
        if share < SIMILAR:
            return None
        parts = [len(p & have) / len(p) if p and len(next(iter(p))) == SHINGLE else share for p in (self.question, self.answer)]
        return (share, *parts) if min(parts) > 0 else None


def least_share(item: Item, weights: Counter[bytes]) -> float:
    """A share of the words' weights that every document with SIMILAR of the item's shingles has."""
    n = len(item.all)
    missing = max(m for m in range(n) if (n - m) / n >= SIMILAR)
    among = Counter(w for s in item.all for w in set(s))
    held = sorted((math.fsum(weights[w] / among[w] for w in set(s)) for s in item.all), reverse=True)
    return math.fsum(held[missing:]) / math.fsum(held)


class Index:
    """BM25 over pieces, each piece's weights divided by its score for itself and by its item's share."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.items = [Item(i, t) for i, t in items]
        pieces = [(k, item.words[at : at + PIECE]) for k, item in enumerate(self.items) for at in range(0, len(item.words), PIECE)]
        df = Counter(w for _, words in pieces for w in set(words))
        # pieces with the same frequent words side by side: tighter blocks
        pieces.sort(key=lambda p: (max(p[1], key=lambda w: (df[w], w)), p[0]))
        self.owner = [k for k, _ in pieces]
        self.vocabulary = {w: i for i, w in enumerate(sorted(df))}
        average = max(1.0, sum(len(w) for _, w in pieces) / max(1, len(pieces)))
        postings: list[list[tuple[int, float]]] = [[] for _ in df]
        self.weights: list[dict[bytes, float]] = []
        of_item = [Counter() for _ in self.items]
        for k, words in pieces:
            weights = {}
            for w, tf in Counter(words).items():
                idf = math.log(1 + (len(pieces) - df[w] + 0.5) / (df[w] + 0.5))
                weights[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / average))
            for w, x in weights.items():
                of_item[k][w] += x
            own = sum(weights.values())
            self.weights.append({w: x / own for w, x in weights.items()})
        share = [least_share(item, of) if of else 1.0 for item, of in zip(self.items, of_item, strict=True)]
        self.pieces: dict[int, list[int]] = {}
        for p, k in enumerate(self.owner):
            self.pieces.setdefault(k, []).append(p)
            for w, x in self.weights[p].items():
                postings[self.vocabulary[w]].append((p, x * LEAST / share[k]))
        self.postings = postings
        self.blocks = (len(pieces) + BLOCK - 1) // BLOCK
        self.block_max = np.zeros((len(df), max(1, self.blocks)), np.float32)
        for t, posting in enumerate(postings):
            for p, x in posting:
                self.block_max[t, p // BLOCK] = max(self.block_max[t, p // BLOCK], x)
        self.block_max *= np.float32(1 + 1e-6)  # bounds stay bounds in single precision
        self.most = self.block_max.max(axis=1, initial=0)
        # hashes of all shingles, by length: under SHINGLE words an item is one
        every: dict[int, set[tuple]] = {}
        for s in set().union(*(item.all for item in self.items)):
            every.setdefault(len(s), set()).add(s)
        self.shingles = {n: np.unique(_mixed(np.array([[self.vocabulary[w] for w in s] for s in of], np.int64).T)) for n, of in every.items()}

    def wand(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All (piece, score) with a score of at least least, by WAND with block-max skips."""
        out, least = [], least - 1e-9
        cursors = [[self.postings[t][0][0], t, 0] for t in terms]
        block_max, most, postings = self.block_max, self.most, self.postings

        def seek(c: list, piece: int) -> bool:
            posting, at = postings[c[1]], c[2]
            while at < len(posting) and posting[at][0] < piece:
                at += 1
            c[2] = at
            if at == len(posting):
                return False
            c[0] = posting[at][0]
            return True

        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += most[c[1]]
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                return out
            piece = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == piece:
                pivot += 1
            block = piece // BLOCK
            if sum(float(block_max[c[1], block]) for c in cursors[: pivot + 1]) < least:
                # nothing up to the block's end, or up to the next cursor, can reach the threshold
                goal = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    goal = min(goal, cursors[pivot + 1][0])
                goal = max(goal, piece + 1)
            elif cursors[0][0] == piece:
                score = sum(postings[c[1]][c[2]][1] for c in cursors[: pivot + 1])
                if score >= least:
                    out.append((piece, score))
                goal = piece + 1
            else:
                goal = piece
            cursors = [c for i, c in enumerate(cursors) if i > pivot or c[0] >= goal or seek(c, goal)]
        return out

    def starts(self, terms: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(n, places in terms where a shingle of n words starts that, by its hash, some item has)."""
        for n, known in self.shingles.items():
            ends = len(terms) - n + 1
            if ends <= 0:
                continue
            able = terms[:ends] >= 0
            for j in range(1, n):
                able &= terms[j : ends + j] >= 0
            at = np.flatnonzero(able)
            hashes = _mixed([terms[at + j] for j in range(n)])
            near = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            yield n, at[known[near] == hashes]

    def search(self, documents: list[list[bytes]], least: float = LEAST) -> Iterator[tuple[int, set[int], list[int]]]:
        """(number of the document, retrieved items, where shingles of items start) for documents with retrieved pieces."""
        if not self.owner:
            return
        get, size = self.vocabulary.get, len(self.vocabulary)
        for lo in range(0, len(documents), 200):
            part = documents[lo : lo + 200]
            counts = [len(d) + 1 for d in part]  # a -1 after each: no shingle crosses it
            first = np.concatenate([[0], np.cumsum(counts)])
            terms = np.full(first[-1], -1, np.int64)
            for n, d in enumerate(part):
                terms[first[n] : first[n] + len(d)] = np.fromiter(map(get, d, repeat(-1)), np.int64, len(d))
            shared, whole = np.zeros(len(terms), bool), np.zeros(0, np.int64)
            for n, at in self.starts(terms):
                for j in range(n):
                    shared[at + j] = True
                if n == SHINGLE:
                    whole = at
            at = np.flatnonzero(shared)
            keys = np.unique((np.searchsorted(first, at, "right") - 1) * size + terms[at])
            document, term = keys // size, keys % size
            able = np.bincount(document, self.most[term], len(part)) >= least - 1e-6
            keep = able[document]
            document, term = document[keep], term[keep]
            hits: dict[int, set[int]] = {}
            for a in _slices(document, 4_000_000 // self.block_max.shape[1] + 1):
                d, t = document[a], term[a]
                starts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                bounds = np.add.reduceat(self.block_max[t], starts, axis=0)
                for k in np.flatnonzero((bounds >= least - 1e-6).any(axis=1)):
                    end = starts[k + 1] if k + 1 < len(starts) else len(d)
                    for piece, _ in self.wand(t[starts[k] : end].tolist(), least):
                        hits.setdefault(int(d[starts[k]]), set()).add(self.owner[piece])
            for n in sorted(hits):
                yield lo + n, hits[n], (whole[slice(*np.searchsorted(whole, first[n : n + 2]))] - first[n]).tolist()

    def confirm(self, text_words: list[bytes], found: set[int], starts: list[int]) -> list[tuple]:
        have = {tuple(text_words[i : i + SHINGLE]) for i in starts}
        out, words = [], None
        for k in sorted(found):
            shares = self.items[k].overlaps(have, text_words)
            if shares:
                words = words or set(text_words)
                best = max(math.fsum(x for w, x in self.weights[p].items() if w in words) for p in self.pieces[k])
                out.append((self.items[k].item_id, best, *shares))
        return out


def _mixed(columns) -> np.ndarray:
    """One hash of the terms in each row."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = (out + c.astype(np.uint64) + np.uint64(1)) * MIX
        out ^= out >> np.uint64(29)
    return out


def _slices(document: np.ndarray, size: int) -> Iterator[slice]:
    """Slices that end between documents."""
    at = 0
    while at < len(document):
        end = len(document) if at + size >= len(document) else int(np.searchsorted(document, document[at + size], "left"))
        end = end if end > at else int(np.searchsorted(document, document[at], "right"))
        yield slice(at, end)
        at = end


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of bounded size; a block is all that the driver holds at once."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    for k in range(parts):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else rows
        yield [tuple(r) for r in part.collect()]


def _index(items: list[tuple[int | None, str]]) -> Index:
    return resident(("benchmark", hash(tuple(items))), lambda: Index(items))


def _in_batch(index: Index, texts: list[str]) -> Iterator[tuple[int, list[tuple]]]:
    for lo in range(0, len(texts), 1000):
        words = [words_of(t or "") for t in texts[lo : lo + 1000]]
        for n, found, starts in index.search(words):
            if confirmed := index.confirm(words[n], found, starts):
                yield lo + n, confirmed


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that it holds."""
    rows, out = id_text(docs), None
    for items in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = _index(items)
            for b in batches:
                ids, found = b.column("doc_id").to_pylist(), []
                for n, confirmed in _in_batch(index, b.column("text").to_pylist()):
                    found += [(ids[n], *x) for x in confirmed]
                names = [c.split()[0] for c in FOUND.split(", ")]
                columns = list(zip(*found, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n.endswith("_id") else pa.float64()) for n, c in zip(names, columns, strict=True)], names)

        part = mapped(rows, run, FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, all columns, that hold no benchmark item."""
    at = docs.columns.index("text")
    for items in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = _index(items)
            for b in batches:
                bad = {n for n, _ in _in_batch(index, b.column(at).to_pylist())}
                yield b.filter(pa.array([n not in bad for n in range(b.num_rows)], pa.bool_()))

        docs = mapped(docs, run, docs.schema)
    return docs


def op7(spark, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
