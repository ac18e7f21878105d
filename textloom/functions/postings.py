"""From texts to postings inside a task: no row per word leaves it, and no document's words are dealt out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .analyzer import MAX_TERM_BYTES, distinct_terms, word_list

#: Words of a sorted run, unless one document has more; postings of a batch that goes out.
RUN, BATCH = 2_000_000, 20_000
#: Texts whose words are Python strings at once hold about this many words.
_PIECE = 200_000
SCHEMA = pa.schema([("doc_id", pa.int64()), ("term", pa.string()), ("tf", pa.int32()), ("positions", pa.list_(pa.int32()))])


def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n) from (text): how many distinct terms each has; no text is null."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([distinct_terms(word_list(t)) for t in b.column(0).to_pylist()], pa.int32())], ["n"])


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, doc_terms) from (doc_id, text); no text is null."""
    for b in batches:
        n = pa.array([distinct_terms(word_list(t)) for t in b.column(1).to_pylist()], pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["doc_id", "text", "doc_terms"])


def _sorted(key: np.ndarray, bits: int) -> np.ndarray:
    """The order of keys below 2 ** bits, equal ones as they come."""
    own = max(1, len(key) - 1).bit_length()
    if bits + own > 63:
        return np.argsort(key, kind="stable")
    return np.sort((key << own) | np.arange(len(key), dtype=np.int64)) & ((1 << own) - 1)


def _run(ids: pa.Array, lengths: list[int], words: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    """Postings by term, then doc_id. A document's words are numbered as they come; those that are no terms count."""
    coded = pa.chunked_array(words, pa.string()).dictionary_encode().combine_chunks()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.chunk(0)
    vocabulary = coded.dictionary
    order = np.asarray(pc.sort_indices(vocabulary), dtype=np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    width = np.asarray(pc.binary_length(vocabulary))
    rank[(width == 0) | (width > MAX_TERM_BYTES)] = -1

    count = np.array(lengths, np.int64)
    by_id = np.asarray(pc.sort_indices(ids, null_placement="at_start"), dtype=np.int64)
    place = np.empty(len(by_id), np.int64)
    place[by_id] = np.arange(len(by_id))
    positions = np.arange(count.sum(), dtype=np.int64) - np.repeat(np.cumsum(count) - count, count)
    key = rank[np.asarray(coded.indices)]
    kept = key >= 0
    key, positions = (key * len(count) + np.repeat(place, count))[kept], positions[kept].astype(np.int32)
    at = _sorted(key, (len(order) * len(count)).bit_length())
    key, positions = key[at], positions[at]

    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(key)]
    for i in range(0, len(starts), BATCH):
        a, b = starts[i : i + BATCH], ends[i : i + BATCH]
        term, doc = np.divmod(key[a], len(count))
        offsets = pa.array(np.r_[a, b[-1]] - a[0], pa.int32())
        places = pa.ListArray.from_arrays(offsets, pa.array(positions[a[0] : b[-1]]))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(by_id[doc])), vocabulary.take(pa.array(order[term])), pa.array((b - a).astype(np.int32)), places], schema=SCHEMA)


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, term, tf, positions) from (doc_id, text), in sorted runs; no text is null. One posting for each row and term."""
    ids: list[pa.Array] = []
    lengths: list[int] = []
    words: list[pa.Array] = []
    piece: list[str] = []
    held = 0

    def run() -> Iterator[pa.RecordBatch]:
        return _run(pa.concat_arrays(ids), lengths, [*words, pa.array(piece, pa.string())])

    for b in batches:
        before = 0
        for i, text in enumerate(b.column(1).to_pylist(), 1):
            own = word_list(text)
            lengths.append(len(own))
            piece += own
            held += len(own)
            if len(piece) >= _PIECE:
                words.append(pa.array(piece, pa.string()))
                piece.clear()
            if held >= RUN:
                ids.append(b.column(0).slice(before, i - before))
                yield from run()
                before, held = i, 0
                for kept in (ids, lengths, words, piece):
                    kept.clear()
        ids.append(b.column(0).slice(before))
    if lengths:
        yield from run()
