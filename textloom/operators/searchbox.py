"""The search box: no syntax, every term as well as it can.

A query term's tier for a document term is 0 if equal, 1 if it is a prefix, 2 if it is contained (three
characters or more), 3 within one typo (four or more), 4 within two (seven or more). A document's tier
is its worst query term's best; a term without a tier, or an empty query, is no match.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analyzer import folded, is_term, term_list
from ..functions.patterns import typo, within
from .match import bound, split_by_script

NO_TIER = 5


def box_terms(q: str) -> list[str]:
    return sorted(set(term_list(q)))


def term_tier(q: str, term: Column, max_typos: int = 2) -> Column:
    """The tier of one query term for a document's term; null: none."""
    out = F.when(term == q, 0).when(F.startswith(term, F.lit(q)), 1)
    if len(q) >= 3:
        out = out.when(F.contains(term, F.lit(q)), 2)
    if len(q) >= 4 and max_typos >= 1:
        out = out.when(typo(term, q, 1), 3)
    if len(q) >= 7 and max_typos >= 2:
        out = out.when(typo(term, q, 2), 4)
    return out


def tier_column(q: str, words: Column, max_typos: int = 2) -> Column:
    """The tier of a document given as folded words; null: no match."""
    terms = box_terms(q)
    if not terms:
        return F.lit(None).cast("int")

    def of(t: str) -> Column:
        return F.array_min(F.transform(words, lambda w: F.when(is_term(w), term_tier(t, w, max_typos))))

    best = [of(t) for t in terms]
    worst = best[0] if len(best) == 1 else F.greatest(*best)
    return F.when(sum((b.isNull().cast("int") for b in best), F.lit(0)) == 0, worst)


def tier_of(q: str, text: str, max_typos: int = 2) -> int | None:
    """The tier in Python, for any text."""
    terms, own = box_terms(q), set(term_list(text))
    worst = 0 if terms else None
    for t in terms:
        best = None
        for w in own:
            tier = 0 if w == t else 1 if w.startswith(t) else 2 if len(t) >= 3 and t in w else 3 if len(t) >= 4 and max_typos >= 1 and within(w, t, 1) else 4 if len(t) >= 7 and max_typos >= 2 and within(w, t, 2) else None
            if tier is not None and (best is None or tier < best):
                best = tier
        if best is None:
            return None
        worst = max(worst, best)
    return worst


def ranked(df: DataFrame, q: str, text: str = "text", max_typos: int = 2) -> DataFrame:
    """Matching rows with their tier."""

    @F.arrow_udf("int")
    def slow(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if t is None else tier_of(q, t, max_typos) for t in b.to_pylist()], pa.int32())

    plain, other = split_by_script(df, F.col(text))
    plain = plain.withColumn("tier", bound(folded(F.col(text)), lambda words: tier_column(q, words, max_typos)))
    return plain.unionByName(other.withColumn("tier", slow(F.col(text)))).filter(F.col("tier").isNotNull())


def distance(tier: Column) -> Column:
    """The rank as a number, infinite where nothing matches."""
    return F.coalesce(tier.cast("double"), F.lit(float("inf")))


def top(df: DataFrame, q: str, k: int, key: str, text: str = "text", max_typos: int = 2) -> DataFrame:
    """The k best rows, ties by key."""
    return ranked(df, q, text, max_typos).orderBy("tier", key).limit(k)


def top_with_rest(df: DataFrame, q: str, k: int, key: str, text: str = "text", max_typos: int = 2) -> DataFrame:
    """The k best of already filtered rows; those without a match come last."""
    tiers = ranked(df, q, text, max_typos).select(key, "tier")
    return df.join(tiers, key, "left").withColumn("tier", F.coalesce("tier", F.lit(NO_TIER))).orderBy("tier", key).limit(k)


def fallback(df: DataFrame, q: str, k: int, key: str, text: str = "text") -> DataFrame:
    """Exact and prefix matches; if there are none fragments; then one typo; then two (7 characters or more)."""
    terms = box_terms(q)
    found = ranked(df, q, text)
    least = found.agg(F.min("tier").alias("least"))
    # the first non-empty step decides: tiers 0 and 1 together, else the best tier alone
    return found.join(F.broadcast(least)).filter((F.col("tier") <= F.greatest("least", F.lit(1)))).drop("least").orderBy("tier", key).limit(k) if terms else found.limit(0)
