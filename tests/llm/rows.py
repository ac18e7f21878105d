"""Rows for the tests of this folder: awkward texts, and columns whose names clash with the operators' own."""

import random

EXTRA = ("row", "n", "band", "digest", "kept", "anchor", "score", "c", "word", "component", "a", "b", "ta", "held_out", "payload")


def documents(spark, rows, slices=3):
    """doc_id, text and columns that no operator may look at."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(slices)
    for i, name in enumerate(EXTRA):
        df = df.withColumn(name, F.lit(None).cast("string") if i % 2 else F.lit("clash"))
    return df


def awkward(seed=1):
    """Texts that are null, empty, blank, long, repeated, of other scripts, or hold special strings."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    long = prose(30_000)
    texts = [None, "", " ", "\t\n\x0b\x0c\r ", "one", "two words", "UPPER lower İstanbul Straße ΑΣ", "日本語 テキスト é  nbsp", "<|endoftext|> a <|startoftext|>b", "▁mark ▁▁ x", long, long, prose(400), "a" * 5000, "..!? 12,5 a1b2 'twas don't", "x y　z \x1c\x1d\x85 end", "same same", "same  same"]
    rows = list(enumerate(texts)) + [(100 + i, prose(rng.randint(1, 60))) for i in range(40)]
    return rows + [(None, "no id"), (None, None), (16, "same same")]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}
