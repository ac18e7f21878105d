"""The functions under SQL names.

Queries are parsed once per worker and text. All functions give null for null arguments.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..plans.query import Query, parse
from . import highlight as H
from .spans import Document


@lru_cache(maxsize=1000)
def parsed(q: str) -> Query:
    try:
        return parse(q)
    except ValueError as e:
        raise ValueError(f"invalid query {json.dumps(q, ensure_ascii=False)}: {e}") from e


def strict(f: Callable, kind: pa.DataType) -> Callable:
    """An Arrow function of batches from a function of values; null in, null out."""

    def run(batches: Iterator) -> Iterator[pa.Array]:
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            rows = zip(*(c.to_pylist() for c in columns), strict=True)
            yield pa.array([None if any(v is None for v in r) else f(*r) for r in rows], kind)

    return run


def text_match(doc: str, q: str) -> bool:
    return Document(doc).matches(parsed(q))


def search_distance(doc: str, q: str, max_typos: int = 2) -> float:
    from ..operators.searchbox import tier_of

    tier = tier_of(q, doc, max_typos)
    return float("inf") if tier is None else float(tier)


def search_match(doc: str, q: str, max_typos: int = 2) -> bool:
    return search_distance(doc, q, max_typos) < float("inf")


def highlight(doc: str, q: str, start: str = "<b>", stop: str = "</b>") -> str:
    return H.highlight(doc, parsed(q), start, stop)


def snippet(doc: str, q: str, words: int = 30, start: str = "<b>", stop: str = "</b>") -> str:
    return H.snippet(doc, parsed(q), words, start, stop)


def _typed(arity: int, run: Callable) -> Callable:
    """An Arrow iterator function with the annotations that Spark reads the style from."""
    if arity == 1:

        def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from run(batches)

        return one

    def many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        yield from run(batches)

    return many


def function(f: Callable, ddl: str, kind: pa.DataType, arity: int = 2):
    return F.arrow_udf(_typed(arity, strict(f, kind)), ddl)


def register(spark: SparkSession) -> None:
    """text_match, search_match, search_distance, highlight, snippet, and the statistics of indexes by path."""
    udf = spark.udf.register
    udf("text_match", function(text_match, "boolean", pa.bool_()))
    udf("search_match", function(search_match, "boolean", pa.bool_()))
    udf("search_distance", function(search_distance, "double", pa.float64()))
    udf("highlight", function(highlight, "string", pa.string()))
    udf("snippet", function(snippet, "string", pa.string()))


def register_index(index, name: str) -> None:
    """bm25_score_<name> and explain_score_<name> over the index's statistics, <name>_segments and <name>_stats as views.

    The functions hold the frequencies of terms, so they are for indexes of at most 1,000,000 terms;
    index.score() has no such bound.
    """
    from ..operators.score import weights

    spark = index.spark
    frequency = index.terms()
    if frequency.limit(1_000_001).count() > 1_000_000:
        raise ValueError(f"index {name} has more than 1,000,000 terms; use index.score()")
    stats = index.collection()
    sent = spark.sparkContext.broadcast({r.term: r.df for r in frequency.collect()})
    docs, average = stats.docs, stats.average

    def explain(doc: str, q: str) -> dict:
        import math

        from ..operators.score import B, K1
        from .patterns import matches

        tree, own = parsed(q), Document(doc)
        found: dict[str, float] = {}
        for leaf, w in weights(tree).items():
            for t in own.terms:
                if matches(leaf, t):
                    found[t] = found.get(t, 0.0) + w
        terms = []
        for t, w in found.items():
            df, tf = max(1, sent.value.get(t, 0)), len(own.terms[t])
            idf = math.log(1 + max(max(docs, 1) - df + 0.5, 0.0) / (df + 0.5))
            terms.append({"term": t, "weight": w, "tf": tf, "df": df, "idf": idf, "score": w * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own.terms) / average))})
        terms.sort(key=lambda t: (-t["score"], t["term"]))
        return {"score": sum(t["score"] for t in terms), "matches": own.matches(tree), "doc_terms": len(own.terms), "avg_doc_terms": average, "docs": float(docs), "k1": K1, "b": B, "terms": terms}

    def rounded(value):
        if isinstance(value, float):
            return round(value, 6)
        if isinstance(value, dict):
            return {k: rounded(v) for k, v in value.items()}
        return [rounded(v) for v in value] if isinstance(value, list) else value

    spark.udf.register(f"bm25_score_{name}", function(lambda d, q: explain(d, q)["score"], "double", pa.float64()))
    spark.udf.register(f"explain_score_{name}", function(lambda d, q: json.dumps(rounded(explain(d, q))), "string", pa.string()))
    index.segments().createOrReplaceTempView(f"{name}_segments")
    index.stats().createOrReplaceTempView(f"{name}_stats")
