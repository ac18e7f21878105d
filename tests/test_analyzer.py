"""Words, folding and positions, and that the Column form equals the Python form."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from textloom.functions import analyzer as A
from textloom.functions import postings as P


def test_ascii_words():
    cases = {"fox's 3.14 1,000 a:b U.S.A": ["fox's", "3.14", "1,000", "a:b", "u.s.a"], "a__b _a_ __": ["a__b", "_a_"], "e-mail 1.a": ["e", "mail", "1", "a"], "'a' b.": ["a", "b"]}
    for text, want in cases.items():
        assert A.term_list(text) == want


def test_unicode():
    assert A.term_list("Crème BRÛLÉE København") == ["creme", "brulee", "københavn"]
    assert A.term_list("café 日本 ﬁne") == ["cafe", "日", "本", "fine"]
    assert A.term_list("שמ\"ל カタカナ") == ['שמ"ל', "カタカナ"]
    assert A.term_list("🇩🇪🇫🇷 👩‍🚀 x") == ["x"]


def test_positions_count_dropped_words():
    assert [(t, p) for t, p, *_ in A.analyze(f"a {'x' * 65} b")] == [("a", 0), ("b", 2)]


def test_grams():
    assert A.fragment_grams("abcde") == ["abcd", "bcde"]


def test_ascii_rule_equals_the_general_one():
    rng = random.Random(5)
    for _ in range(5000):
        text = "".join(rng.choice("ab1_.,:;'\"- \n\r\t") for _ in range(rng.randint(0, 12)))
        general = [(a, b) for a, b in A.segments(text) if any(c.isalnum() for c in text[a:b])]
        assert general == A.word_spans(text), text


def test_column_form(spark):
    rng = random.Random(7)
    alphabet = "abZ1_.,:;'’-  éÉÑøßÅœ\n\"…"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["", "x" * 70 + " y"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", A.plain(F.col("text")).alias("plain"), A.folded(F.col("text")).alias("words")).collect()
    for r in rows:
        if r.plain:
            text = texts[r.i]
            assert r.words == [A.fold(text[a:b]) for a, b in A.word_spans(text)], text
    assert sum(r.plain for r in rows) > 2000
    assert not spark.createDataFrame([("日本",)], "t string").select(A.plain(F.col("t"))).first()[0]


def test_words_in_bulk_equal_the_general_ones():
    rng = random.Random(3)
    alphabet = "abZ1_.,:;'’‘·-  éÉÑøßÅœŒµ\n\"…–€Ğſı²日ש́x"
    for i in range(20000):
        text = "".join(rng.choice(alphabet if i % 3 else alphabet[:28]) for _ in range(rng.randint(0, 14)))
        words = [A.fold(text[a:b]) for a, b in A.word_spans(text)]
        assert A.word_list(text) == words, text
        assert A.distinct_terms(words) == len({w for w in words if A.is_term_text(w)})


def test_postings_of_a_task(monkeypatch):
    """Every place of every term, in runs sorted by term, whatever the sizes of batches and runs; equal ids stay rows of their own."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["ale", "Beer", "x_y", "é", "z" * 65, "日本", ","]) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    rows = [(rng.choice([None, 1, 2, i]), t) for i, t in enumerate(texts)]
    want = Counter()
    for i, t in rows:
        own = {}
        for term, position, *_ in A.analyze(t):
            own.setdefault(term, []).append(position)
        want.update((i, term, len(p), tuple(p)) for term, p in own.items())
    table = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": texts})
    for run, piece, batch in ((P.RUN, P._PIECE, P.BATCH), (50, 20, 7), (1, 1, 1)):
        for name, value in (("RUN", run), ("_PIECE", piece), ("BATCH", batch)):
            monkeypatch.setattr(P, name, value)
        found = [tuple(r.values()) for b in P.postings(iter(table.to_batches(max_chunksize=37))) for r in b.to_pylist()]
        assert Counter((i, t, n, tuple(p)) for i, t, n, p in found) == want
        if run == 2_000_000:
            assert [t for _, t, *_ in found] == sorted((t for _, t, *_ in found), key=str.encode)
    assert list(P.postings(iter(pa.table({"doc_id": [1], "text": [""]}).to_batches()))) == []


def test_long_runs_in_column_form(spark):
    """A run of letters and digits, or of underscores, takes neither a stack frame a character nor quadratic time."""
    texts = ["a1" * 100_000, "É1" * 100_000 + " b", "_" * 100_000, "_" * 100_000 + "é"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", F.transform(A.folded(F.col("text")), F.md5).alias("words")).collect()
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert {r.i: r.words for r in rows} == {i: [md5(w) for w in A.word_list(t)] for i, t in enumerate(texts)}
