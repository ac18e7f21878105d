import hashlib
import random
from collections import Counter

import numpy as np

from rows import awkward, documents
from textloom.llm.suffix_dedup import LENGTH, common_prefixes, remove_repeats, repeated_windows, suffix_ranks, window_digests


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        spans = sum(1 for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def planted(seed=4, n=60):
    rng = random.Random(seed)
    chars = lambda k: "".join(rng.choice("abcd é") for _ in range(k))
    common = [chars(k) for k in (150, 198, 201, 260, 700)]
    rows = []
    for i in range(n):
        parts = [chars(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            c = rng.choice(common)
            a = rng.randint(0, 30)
            parts += [c[a : len(c) - rng.randint(0, 30)], chars(rng.randint(0, 5))]
        rows.append((i, "".join(parts)))
    return rows + [(n, "ab" * 400), (n + 1, "z" * 700), (n + 2, rows[3][1]), (n + 3, None), (n + 4, "")]


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_removal_against_brute_force(spark):
    rows = planted()
    assert found(remove_repeats(documents(spark, rows))) == brute(rows, LENGTH)


def test_small_shards_find_what_only_shards_together_repeat(spark):
    # tiny shards salt every anchor over several, and merge them by binary search
    rows = planted(9, 40)
    assert found(remove_repeats(documents(spark, rows), shard_bytes=600)) == brute(rows, LENGTH)


def test_awkward_and_repeated_rows(spark):
    rows = [(i, t[:4000] if t else t) for i, t in awkward()]
    assert found(remove_repeats(documents(spark, rows))) == brute(rows, LENGTH)
    assert remove_repeats(documents(spark, [])).count() == 0


def test_windows_of_parts_against_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        length = rng.randint(2, 9)
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 6))]
        seen = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        for p, flags in zip(parts, repeated_windows(parts, length), strict=True):
            assert flags.tolist() == [seen[p[i : i + length]] > 1 for i in range(len(p) - length + 1)]


def test_suffix_arrays_and_common_prefixes():
    rng = random.Random(6)
    for _ in range(40):
        parts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 50))) for _ in range(3)]
        sizes = np.array([len(p) for p in parts])
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(parts), np.uint8)
        left = np.repeat(starts + sizes, sizes) - np.arange(len(data))
        suffix = lambda i: bytes(data[i : i + left[i]])
        order, place = suffix_ranks(data, left, int(sizes.max()))
        sorted_ = [suffix(i) for i in order.tolist()]
        assert sorted_ == sorted(sorted_)
        assert (place[order] == np.arange(len(data))).all()
        lcp = common_prefixes(data, order, place, left, starts, sizes, 1000)
        for k in range(1, len(order)):
            a, b = sorted_[k - 1], sorted_[k]
            assert lcp[k] == next((n for n in range(min(len(a), len(b))) if a[n] != b[n]), min(len(a), len(b)))


def test_window_digests_tell_windows_apart():
    rng = random.Random(7)
    for length in (1, 7, 64, 200):
        data = bytes(rng.choice(b"ab") for _ in range(600)) * 2
        digests = [tuple(d) for d in window_digests(np.frombuffer(data, np.uint8), length).tolist()]
        texts = [data[i : i + length] for i in range(len(data) - length + 1)]
        assert len(digests) == len(texts) and len(set(zip(digests, texts, strict=True))) == len(set(digests)) == len(set(texts))
    assert len(window_digests(np.zeros(5, np.uint8), 9)) == 0
