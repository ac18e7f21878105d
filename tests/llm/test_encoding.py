import random

import pytest

from rows import awkward, by_id, documents
from textloom.llm.encoding import PieceCounter, WordBpe, balanced, tokenizer_path
from textloom.llm.token_counts import count_tokens

ALPHABET = ["a", "B", "é", "É", "ß", "İ", "ǅ", "Σ", "日", "1", "23", "'s", "'", ".", ",", "-", "_", "<|", "|>", "▁", " ", "  ", "\t", "\n", "\r", "\x0b", "\x1c", " ", " ", "́", "​", "the", "Word", "don't", "🙂", "\x00", "<s>", "<unk>", "µ", "ﬁ"]


def texts(n=3000, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(n)] + [t for _, t in awkward() if t is not None]


def test_word_bpe_gives_the_librarys_ids():
    own = WordBpe(tokenizer_path("word_bpe_49k.json"))
    for t in texts():
        assert own.ids(t) == own._library(t), repr(t[:80])


def test_piece_counts_are_the_librarys():
    own = PieceCounter(tokenizer_path("piece_bpe_32k.model"))
    assert own.cuttable
    all_ = texts()
    for t, n in zip(all_, own.counts(all_), strict=True):
        assert n == len(own.library.encode(t)), repr(t[:80])


def test_full_caches_change_nothing(monkeypatch):
    from textloom.llm import encoding

    monkeypatch.setattr(encoding, "CACHE_ENTRIES", 3)
    own, counter = WordBpe(tokenizer_path("word_bpe_49k.json")), PieceCounter(tokenizer_path("piece_bpe_32k.model"))
    for t in texts(200):
        assert own.ids(t) == own._library(t)
        assert counter.counts([t, t]) == [len(counter.library.encode(t))] * 2


@pytest.mark.parametrize("limit", [1, 5, 100])
def test_balanced_slices_cover_all(limit):
    sizes = [3, 0, 9, 1, 1, 1, 50, 2]
    slices = list(balanced(sizes, limit))
    assert [n for s in slices for n in sizes[s]] == sizes
    assert all(sum(sizes[s]) <= limit or s.stop - s.start == 1 or not sum(sizes[s.start : s.stop - 1]) for s in slices)


def test_counts_over_a_table(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    own = PieceCounter(path)
    rows = awkward()
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in count_tokens(documents(spark, rows), path).collect())
    wanted = sorted((i is None, i or 0, len((t or "").encode()), len(own.library.encode(t or ""))) for i, t in rows)
    assert found == wanted
    assert count_tokens(documents(spark, []), path).count() == 0
    assert by_id(count_tokens(documents(spark, [(1, None)]), path))[1].n_tokens == 0
