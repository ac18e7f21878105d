"""Matching without an index: a filter over any DataFrame with a text column."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import analyzer
from ..plans.compile import bound, by_text, by_words, necessary, needs_positions
from ..plans.query import Query, parse


def query(q: str | Query) -> Query:
    return parse(q) if isinstance(q, str) else q


def split_by_script(df: DataFrame, text: Column) -> tuple[DataFrame, DataFrame]:
    """Rows for the Column form of the analyzer, and the rest."""
    plain = analyzer.plain(text)
    return df.filter(plain), df.filter(~plain)


def search(df: DataFrame, q: str | Query, text: str = "text") -> DataFrame:
    """The rows that match; null texts and null queries match nothing."""
    if q is None:
        return df.limit(0)
    q, col = query(q), F.col(text)
    if needs_positions(q):
        # one bulk analysis takes less than it takes to fold a text for a first look
        return df.filter(by_text(q, col))
    plain, other = split_by_script(df, col)
    if necessary(q, lambda term: F.contains(col, F.lit(term))) is not None:
        # only texts that hold the characters of what is wanted are analysed
        plain = plain.filter(bound(analyzer.folded_text(col), lambda t: necessary(q, lambda term: F.contains(t, F.lit(term)))))
    return plain.filter(by_words(q, analyzer.folded(col))).unionByName(other.filter(by_text(q, col)))


def match_column(q: str | Query, words: Column) -> Column:
    """The query on a column of folded words, for use inside larger expressions."""
    return by_words(query(q), words)


def analyzed(df: DataFrame, text: str = "text", to: str = "words", use: Callable[[Column], Column] = lambda words: words) -> DataFrame:
    """df with an array of folded words, or with use of it; a word's index is its position. Null texts give null."""
    @F.arrow_udf("array<string>")
    def slow(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            out = [None if t is None else [analyzer.fold(t[i:j]) for i, j in analyzer.word_spans(t)] for t in b.to_pylist()]
            yield pa.array(out, pa.list_(pa.string()))

    plain, other = split_by_script(df, F.coalesce(F.col(text), F.lit("")))
    return plain.withColumn(to, bound(analyzer.folded(F.col(text)), use)).unionByName(other.withColumn(to, bound(slow(F.col(text)), use)))


def search_many(df: DataFrame, queries: Iterable[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(q, key) for each query of a stated set that a row matches, in one pass over the rows."""
    found = list(dict.fromkeys(queries))
    words = analyzed(df.select(key, text), text).drop(text)
    hits = F.filter(F.array(*(F.when(F.coalesce(match_column(q, F.col("words")), F.lit(False)), F.lit(q)) for q in found)), lambda x: x.isNotNull())
    return words.select(F.explode(hits).alias("q"), key)


def union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
