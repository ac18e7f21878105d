import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from rows import awkward, by_id, documents
from textloom.llm import minhash
from textloom.llm.minhash import _signatures, near_groups, shingle_set


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def components(rows, size, percent=80):
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def versions(seed=2, families=12, each=6):
    """Families of edited texts, so that similarities lie on both sides of the limit."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = []
    for f in range(families):
        base = [word() for _ in range(rng.choice([5, 20, 80, 200]))]
        for _ in range(each):
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
            if rng.random() < 0.5:
                base = own  # chains
    return rows


def check(spark, rows, size):
    wanted = components(rows, size)
    found = by_id(near_groups(documents(spark, rows), size=size))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in found.items()} == wanted


@pytest.mark.parametrize("small", [32, 2])
def test_components_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)  # 2: buckets are compared in blocks
    monkeypatch.setattr(minhash, "BLOCK", 7 if small == 2 else 2048)
    check(spark, versions(), 4)


def test_awkward_rows(spark):
    rows = [(i, t) for i, t in awkward() if i is not None and i != 16]
    check(spark, rows, 5)
    found = near_groups(documents(spark, [(None, "a b c d e"), (None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (3, None), (9, "A  b C\td e")])).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=repr) == sorted([(None, 1, None, True)] * 2 + [(4, 1, 4, True)] * 2 + [(3, 0, 3, True), (9, 1, 4, False)], key=repr)


def test_empty_table(spark):
    assert near_groups(documents(spark, [])).count() == 0


def test_the_limit_is_exact():
    # 4 of 5 shingles: exactly at the limit; the integers decide
    a, b = "1 2 3 4 5 6 7 8", "1 2 3 4 5 6 7"
    x, y = shingle_set(a, 4), shingle_set(b, 4)
    assert (len(x), len(y), len(np.intersect1d(x, y))) == (5, 4, 4)


def test_signatures_are_one_permutation_shifted():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 7, 300)]
    signature = _signatures(sets, 40)
    assert signature.shape == (40, 3)
    # agreement estimates similarity
    a = np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64))
    both = _signatures([a, np.concatenate([a[:800], rng.integers(0, 2**63, 200, dtype=np.uint64)])], 1000)
    assert abs(float((both[0::1, 0] == both[:, 1]).mean()) - 800 / 1200) < 0.06


def test_words_hash_to_64_bits_that_do_not_follow_from_each_other():
    words = [b"%08d" % i for i in range(2000)]
    hashes = minhash._WordHashes()
    x = np.array([hashes[w] for w in words], np.uint64)
    low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
    assert len(np.unique(low ^ high)) > 1900


def test_signed_rows_keep_their_order():
    batch = pa.RecordBatch.from_arrays([pa.array([5, None, 7], pa.int64()), pa.array(["a b", "", "a b"])], ["doc_id", "text"])
    out = [r for b in minhash.sign(iter([batch]), 5) for r in b.to_pylist()]
    assert [(r["doc_id"], r["n"], len(r["bands"])) for r in out] == [(5, 1, minhash.BANDS), (None, 0, 0), (7, 1, minhash.BANDS)]
    assert out[0]["bands"] == out[2]["bands"]
