import zlib
from collections import defaultdict

import numpy as np
import pytest

from rows import awkward, documents
from textloom.llm.encoding import tokenizer_path
from textloom.llm.packing import Packer, pack_conversations, pack_documents

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    return lambda text: [*own.encode(text or "", add_special_tokens=False).ids, 1]


def test_every_id_lies_in_one_piece_and_sequences_are_gapless(spark, library):
    rows = awkward()
    found = pack_documents(documents(spark, rows), PATH).collect()
    spans, sequences, crcs = defaultdict(list), defaultdict(list), {}
    for r in found:
        spans[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    wanted = defaultdict(list)
    for i, text in rows:
        wanted[i].append(library(text))
    for i, texts in wanted.items():
        assert sum(n for _, n, _, _ in spans[i]) == sum(map(len, texts))
        if len(texts) == 1:
            (ids,), at = texts, 0
            for start, n, crc, tokens in sorted(spans[i]):
                assert (start, tokens) == (at, len(ids))
                assert crc == zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())
                at += n
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.01 * sum(r.length for r in found)
    assert not crcs


def test_empty_table(spark):
    assert pack_documents(documents(spark, []), PATH).count() == 0


def test_three_limits_hold_together():
    rng = np.random.default_rng(3)
    packer = Packer(tokens=100, segments=6, loss=40, pool=32)
    placed = []
    sizes = rng.integers(1, 250, 300).tolist()
    flags = [rng.random(n) < p for n, p in zip(sizes, rng.random(300), strict=True)]
    for k, (n, f) in enumerate(zip(sizes, flags, strict=True)):
        placed += packer.add(k, 0, n, f)
    placed += packer.finish()
    covered, sequences = defaultdict(int), defaultdict(list)
    for key, start, length, loss, sequence, _ in placed:
        assert loss == flags[key][start : start + length].sum()
        covered[key] += length
        sequences[sequence].append((length, loss))
    assert [covered[k] for k in range(300)] == sizes
    for parts in sequences.values():
        assert sum(n for n, _ in parts) <= 100 and len(parts) <= 6 and sum(x for _, x in parts) <= 40


def test_whole_examples_are_not_cut_and_too_large_ones_raise():
    packer = Packer(tokens=10, segments=3, cut=False)
    placed = [p for k, n in enumerate([7, 3, 5, 5, 10, 1, 1, 1, 1]) for p in packer.add(k, 0, n)] + packer.finish()
    assert sorted((k, s, n) for k, s, n, *_ in placed) == [(k, 0, n) for k, n in enumerate([7, 3, 5, 5, 10, 1, 1, 1, 1])]
    with pytest.raises(ValueError):
        packer.add(9, 0, 11)


def test_dot_product_places_the_example_that_fits_what_is_left():
    # much loss is left and few tokens: the short, loss-bearing example comes before the long one
    packer = Packer(tokens=100, segments=10, loss=50, cut=False)
    for k, (n, loss) in enumerate([(60, 0), (30, 30), (40, 0)]):
        packer.add(k, 0, n, np.arange(n) < loss)
    first = [k for k, *_, sequence, _ in packer.finish() if sequence == 0]
    assert first[0] == 1


def test_conversations_count_only_the_assistants_tokens(spark, library):
    turns = [(1, 0, "user", "hello there"), (1, 1, "assistant", "good day"), (2, 0, "user", None), (2, 1, None, "x"), (None, 0, "assistant", "lost")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    tokens, loss = defaultdict(int), defaultdict(int)
    for r in pack_conversations(df, PATH).collect():
        tokens[r.doc_id] += r.length
        loss[r.doc_id] += r.loss_tokens
    for conv in (1, 2, None):
        own = [(role, len(library(text))) for c, _, role, text in turns if c == conv]
        assert tokens[conv] == sum(n for _, n in own)
        assert loss[conv] == sum(n for role, n in own if role == "assistant")
