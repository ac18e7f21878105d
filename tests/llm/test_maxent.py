import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rows import awkward, by_id, documents
from textloom.llm import maxent
from textloom.llm.common import keep, mapped
from textloom.llm.maxent import scores


def words(text):
    return [w for w in re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))] + [None]


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def base(rows):
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, t in rows:
        own = words(t)
        out[i] = (held(i), len(own), sum(counts[w] > 0 for w in own), n, math.fsum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
    return out


@pytest.mark.parametrize("most, more", [(maxent.HEAD, maxent.MORE), (40, 80)])
def test_base_scores_against_brute_force(spark, most, more):
    # 40, 80: most words are rare ones, which a join scores
    rows = [(i, t) for i, t in awkward() if i not in (None, 16)]
    found = by_id(scores(documents(spark, rows), most=most, more=more))
    wanted = base(rows)
    assert found.keys() == wanted.keys()
    for i, (out, n, known, train, score) in wanted.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, train)
        assert r.base_score == pytest.approx(score, rel=1e-9)
        assert -1e9 < r.score < 0


def test_edges(spark):
    assert scores(documents(spark, [])).count() == 0
    (r,) = scores(documents(spark, [(None, "a b")])).collect()  # nothing to learn from
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and math.isfinite(r.score)
    found = scores(documents(spark, [(1, "a b"), (1, "a b"), (2, "a")])).collect()
    assert len(found) == 3 and {r.train_tokens for r in found} == {8}


def hashed(key, bits):
    return ((key + 1) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - bits)


def softmax(table, rows, prior):
    z = prior.astype(float) + sum(table[r].astype(float) for r in rows)
    z = np.exp(z - z.max())
    return z / z.sum()


def steps(v, before, i):
    """(level, node, rows, outcome) of each factor of a token."""
    k = int(v.classes[i])
    path = [(0, k // maxent.SUPER), (k // maxent.SUPER, k % maxent.SUPER)] + [(k - maxent.SINGLE, int(v.slots[i]))] * (k >= maxent.SINGLE)
    for n, (node, outcome) in enumerate(path):
        level, rows = maxent.LEVELS[n], []
        base = node * level.rows
        for key, bits in zip([before[-1], before[-2], before[-2] * 65536 + before[-1]], level.bits, strict=True):
            rows.append(base + hashed(key, bits))
            base += 1 << bits
        yield n, node, rows, outcome


def slow(model, counts, text):
    """log10 P(text), one token at a time."""
    v, before, total = model.vocabulary, [maxent.START] * 2, 0.0
    for w in maxent.words_of(text):
        i = v[w]
        for n, node, rows, outcome in steps(v, before, i):
            total += math.log10(softmax(model.tables[n], rows, model.priors[n][node])[outcome])
        if i >= maxent.RARE:
            k = i - maxent.RARE
            total += math.log10((counts.get(w, 0) + 0.1) / (model.rare[0, k] + 0.1 * (model.rare[1, k] + 1)))
        before.append(i)
    return total


@pytest.mark.parametrize("most, more", [(maxent.HEAD, maxent.MORE), (60, 120)])
def test_scores_against_a_slow_model(spark, most, more):
    rows = [(i, t if t is None else t[:3000]) for i, t in awkward()]
    docs = maxent.rows_of(documents(spark, rows))
    counts = keep(spark.createDataFrame(list(Counter(w for i, t in rows if not held(i) for w in maxent.words_of(t or "")).items()), "word binary, c long"), "counts")
    model, encoded = maxent.train(counts, lambda known: keep(mapped(docs, maxent._encode(known), maxent.ENCODED), "encoded"), most=most, more=more)
    assert np.abs(model.weights).max() > 0.1
    have = {bytes(r.word): r.c for r in counts.collect()}
    scored = maxent.scored(model, encoded, counts).collect()
    assert sorted(str(r.doc_id) for r in scored) == sorted(str(i) for i, _ in rows)
    wanted = {t or "": slow(model, have, t or "") for _, t in rows}
    texts = {i: t or "" for i, t in rows if i not in (None, 16)}
    for r in scored:
        if r.doc_id in texts:
            assert r.score == pytest.approx(wanted[texts[r.doc_id]], rel=1e-4, abs=1e-3)


def test_words_of_a_batch_are_those_of_its_texts():
    texts = [t or "" for _, t in awkward()] + ["ends in space ", "next", "", " ", "", "MiXeD\x00 \x1c\x1f nul", "last"]
    whole = pa.array(texts)
    for lo, hi in [(0, len(texts)), (3, 9), (len(texts) - 7, len(texts)), (1, 2), (0, 0)]:
        words, tokens, ends = maxent.words_of_all(whole.slice(lo, hi - lo))
        words = words.to_pylist()
        assert len(words) == len(set(words)) and words[-1] == maxent.END
        assert [[words[i] for i in run] for run in np.split(tokens, ends)[:-1]] == [maxent.words_of(t) for t in texts[lo:hi]]
        assert not len(ends) or ends[-1] == len(tokens)


def test_steps_sum_rows_that_meet():
    # float32 sums would lose the last ones
    level, rng = maxent.LEVELS[2], np.random.default_rng(3)
    table = np.zeros((level.nodes * level.rows, level.outcomes))
    table[5] = 2.0**30
    rows = rng.integers(0, 7, (3, 100))
    p = rng.random((100, level.outcomes)).astype(np.float32)
    wanted = table.copy()
    for i in range(100):
        for r in rows[:, i]:
            wanted[r] -= p[i]
    maxent.Step(level).subtract(table, rows, p)
    assert np.allclose(table, wanted, rtol=0, atol=1e-5)


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    counts = {b"w%d" % i: int(900 / (i + 1)) + 1 for i in range(300)} | {maxent.END: 40}
    head = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    rare = np.zeros((2, maxent.CLASSES))
    rare[:, maxent.SINGLE :] = [[7.0], [3.0]]
    return maxent.Model(head, rare, rng.normal(size=maxent.WEIGHTS).astype(np.float32))


def test_probabilities_of_all_words_sum_to_one():
    m = small_model()
    for before in ([0, 40], [maxent.RARE + 50, 200], [maxent.START] * 2):
        total = 0.0
        for i in [*range(len(m.head)), *range(maxent.RARE + maxent.SINGLE, maxent.START)]:
            p = math.prod(softmax(m.tables[n], rows, m.priors[n][node])[outcome] for n, node, rows, outcome in steps(m.vocabulary, before, i))
            if i >= maxent.RARE:  # all rarer words of the class, and the unseen one
                k = i - maxent.RARE
                p *= (m.rare[0, k] + 0.1 * m.rare[1, k] + 0.1) / (m.rare[0, k] + 0.1 * (m.rare[1, k] + 1))
            total += p
        assert total == pytest.approx(1, abs=1e-5)


def test_gradient_against_a_slow_sum():
    m = small_model(1)
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 301, 30).astype(np.uint16).tobytes() for _ in range(6)]
    out, wanted = np.zeros(maxent.WEIGHTS), np.zeros(maxent.WEIGHTS)
    for b in maxent._gradient(lambda: m)(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["ids"])])):
        for k, scale, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            part = maxent._read_block(scale, data)
            out[k * maxent.BLOCK : k * maxent.BLOCK + len(part)] += part
    for t in texts:
        before = [maxent.START] * 2
        for i in np.frombuffer(t, np.uint16).tolist():
            for n, node, rows, outcome in steps(m.vocabulary, before, i):
                p = softmax(m.tables[n], rows, m.priors[n][node])
                for r in rows:
                    maxent.tables(wanted)[n][r] -= p
                    maxent.tables(wanted)[n][r, outcome] += 1
            before.append(i)
    assert np.abs(wanted).max() > 1 and np.abs(out - wanted).max() < 5e-3 * np.abs(wanted).max()


def test_the_model_beats_an_interpolated_bigram_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = [(r.doc_id, maxent.words_of(r.text or "")) for r in docs.collect()]
    counts, pairs = Counter(), {}
    for i, own in rows:
        if not held(i):
            counts.update(own)
            for a, b in zip([None, *own], own, strict=False):
                pairs.setdefault(a, Counter())[b] += 1
    n, v, bigram = sum(counts.values()), len(counts), 0.0
    for i, own in rows:
        if held(i):
            for a, b in zip([None, *own], own, strict=False):
                alone, after = (counts[b] + 0.1) / (n + 0.1 * (v + 1)), pairs.get(a, Counter())
                bigram += math.log10((after[b] + 10 * alone) / (after.total() + 10))
    found = [r for r in scores(docs).collect() if r.held_out]
    assert len(found) > 50
    assert sum(r.score for r in found) > bigram > sum(r.base_score for r in found)
    print(f"held out, log10 a token: model {sum(r.score for r in found) / sum(r.n_tokens for r in found):.3f}, bigram {bigram / sum(r.n_tokens for r in found):.3f}, base {sum(r.base_score for r in found) / sum(r.n_tokens for r in found):.3f}")
