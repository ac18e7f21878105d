"""BM25 with a query's boosts; a document's length is its number of distinct terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analyzer import distinct_terms, word_list
from ..functions.patterns import hit
from ..functions.spans import Finder, spans
from ..plans.query import Boost, Leaf, Not, Query, Term, leaves
from ..sources.scratch import scratch
from .match import query

K1, B = 1.2, 0.75


def weights(q: Query) -> dict[Query, float]:
    """Positive leaves and their weights: the boosts on the way, added up over repeats."""
    found: dict[Query, float] = {}

    def visit(node: Query, w: float) -> None:
        if isinstance(node, Leaf):
            found[node] = found.get(node, 0.0) + w
        elif isinstance(node, Boost):
            visit(node.of, w * float(np.float32(node.by)))
        elif not isinstance(node, Not):
            for p in node.parts():
                visit(p, w)

    visit(q, 1.0)
    return {leaf: w for leaf, w in found.items() if w > 0}


@dataclass(frozen=True)
class Collection:
    """Statistics of a collection: documents, and the sum of their distinct terms."""

    docs: int
    postings: int

    @property
    def average(self) -> float:
        return max(1.0, self.postings / self.docs) if self.docs else 1.0


def idf(df: Column, docs: float) -> Column:
    return F.log(1 + F.greatest(F.lit(float(max(docs, 1))) - df + 0.5, F.lit(0.0)) / (df + 0.5))


def tf_part(tf: Column, length: Column, average: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def _weight(leaves: dict[Query, float], term: Column) -> Column:
    return sum((F.when(hit(leaf, term), F.lit(w)).otherwise(F.lit(0.0)) for leaf, w in leaves.items()), F.lit(0.0))


def term_scores(counted: DataFrame, frequency: DataFrame, leaves: dict[Query, float], stats: Collection) -> DataFrame:
    """(doc_id, doc_terms, term, tf, df, weight, idf, score) from (doc_id, doc_terms, term, tf) and (term, df)."""
    out = counted.join(frequency, "term").withColumn("weight", _weight(leaves, F.col("term")))
    out = out.withColumn("idf", idf(F.greatest("df", F.lit(1)), stats.docs))
    return out.withColumn("score", F.col("weight") * F.col("idf") * tf_part(F.col("tf"), F.col("doc_terms"), stats.average))


def wanted(leaves: dict[Query, float], term: Column) -> Column:
    out = F.lit(False)
    for leaf in leaves:
        out = out | hit(leaf, term)
    return out


FACTS = "doc_id long, doc_terms int, own array<struct<term: string, tf: long>>, matches boolean"
_OWN = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))


def facts(q: Query, weighted: dict[Query, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text) to FACTS: what scoring needs of a text, from one analysis of it; own: its terms that have a weight."""
    every = [*leaves(q), *weighted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(every)
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                words = word_list(text)
                places = finder.places(words)
                # a word that several leaves match is there once
                own = Counter(words[i] for i in {i for leaf in weighted for i in places[leaf]})
                rows.append((distinct_terms(words), [{"term": t, "tf": n} for t, n in own.items()], bool(spans(q, places.__getitem__))))
            n, own, matches = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(own, _OWN), pa.array(matches, pa.bool_())], ["doc_id", "doc_terms", "own", "matches"])

    return run


def scored_terms(df: DataFrame, q: str | Query, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, Collection]:
    """Each document's scored terms, with whether the document matches; statistics over all of df.

    Texts are analysed once: what scoring needs of them is written to the shared folder, and the statistics and frequencies read that.
    """
    q = query(q)
    weighted = weights(q)
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("text IS NOT NULL")
    found = rows.mapInArrow(facts(q, weighted), FACTS)
    spark = df.sparkSession
    path = scratch(spark, "scored")
    found.write.parquet(path)
    kept = spark.read.schema(FACTS).parquet(path)
    n, total = kept.agg(F.count("*"), F.coalesce(F.sum("doc_terms"), F.lit(0))).first()
    # a row's terms come from one analysis, so equal rows are documents of their own and nothing is grouped
    counted = kept.select("doc_id", "matches", "doc_terms", F.explode("own").alias("x")).select("doc_id", "matches", "doc_terms", "x.term", "x.tf")
    frequency = counted.groupBy("term").agg(F.count("*").alias("df"))
    if all(isinstance(leaf, Term) for leaf in weighted):
        frequency = F.broadcast(frequency)  # a row for each word of the query
    stats = Collection(n, total)
    return term_scores(counted, frequency, weighted, stats), stats


def scores(df: DataFrame, q: str | Query, key: str = "doc_id", text: str = "text", matching: bool = True) -> DataFrame:
    """(doc_id, score) of the documents that match, or of all that hold a positive term."""
    found, _ = scored_terms(df, q, key, text)
    return (found.filter("matches") if matching else found).groupBy("doc_id").agg(F.sum("score").alias("score"))


def top(df: DataFrame, q: str | Query, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    return scores(df, q, key, text).orderBy(F.desc(F.round("score", 9)), "doc_id").limit(k)


def explained(terms: DataFrame, stats: Collection) -> DataFrame:
    """(doc_id, explanation): how a score comes about, numbers to six places."""
    r = lambda c: F.round(c, 6)
    part = F.struct(F.col("term"), r("weight").alias("weight"), F.col("tf"), F.col("df"), r("idf").alias("idf"), r("score").alias("score"))
    # a document's terms of one query: as many as its positive leaves match in it
    grouped = terms.groupBy("doc_id", "matches", "doc_terms").agg(F.sum("score").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), F.col("term").alias("name"), part.alias("part")))).alias("parts"))
    return grouped.select("doc_id", F.struct(r("total").alias("score"), F.col("matches"), F.col("doc_terms"), F.lit(round(stats.average, 6)).alias("avg_doc_terms"), F.lit(float(stats.docs)).alias("docs"), F.lit(K1).alias("k1"), F.lit(B).alias("b"), F.transform("parts", lambda p: p["part"]).alias("terms")).alias("explanation"))


def explain(df: DataFrame, q: str | Query, key: str = "doc_id", text: str = "text") -> DataFrame:
    return explained(*scored_terms(df, q, key, text))
