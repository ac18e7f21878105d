"""From a query's tree to Columns.

A source of positions gives, for each leaf, whether it occurs and where, as Columns; from these a query
becomes one boolean Column, unless it needs the interval evaluator: phrases with slop, and THEN or
NEAR between anything but words. Those are evaluated by an Arrow UDF on the leaves' positions alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import analyzer
from ..functions.patterns import hit
from ..functions.spans import Finder, spans
from .query import And, AtLeast, Boost, Fragment, Leaf, Near, Not, Or, Phrase, Prefix, Query, Term, leaves


#: Gaps up to which THEN and NEAR are Columns; wider ones go to the interval evaluator.
NEAR_LIMIT = 64


class Positions(Protocol):
    def has(self, leaf: Query) -> Column: ...

    def at(self, leaf: Query) -> Column: ...


class InWords:
    """Positions in an array of folded words."""

    def __init__(self, words: Column):
        self.words = words

    def has(self, leaf: Query) -> Column:
        if isinstance(leaf, Term) and analyzer.is_term_text(leaf.text):
            return F.array_contains(self.words, leaf.text)
        return F.exists(self.words, lambda t: self._is(leaf, t))

    def at(self, leaf: Query) -> Column:
        places = F.transform(self.words, lambda t, i: F.when(self._is(leaf, t), i).otherwise(F.lit(-1)))
        return F.filter(places, lambda p: p >= 0)

    @staticmethod
    def _is(leaf: Query, word: Column) -> Column:
        return hit(leaf, word) if isinstance(leaf, Term) and analyzer.is_term_text(leaf.text) else analyzer.is_term(word) & hit(leaf, word)


class InArrays:
    """Positions gathered from postings: one array Column for each leaf."""

    def __init__(self, arrays: dict[Query, Column]):
        self.arrays = arrays

    def has(self, leaf: Query) -> Column:
        return F.size(self.arrays[leaf]) > 0

    def at(self, leaf: Query) -> Column:
        return self.arrays[leaf]


class InFlags:
    """Whether each leaf occurs: enough for a query without phrases and proximity."""

    def __init__(self, flags: dict[Query, Column]):
        self.flags = flags

    def has(self, leaf: Query) -> Column:
        return self.flags[leaf]

    def at(self, leaf: Query) -> Column:
        raise NotImplementedError


def needs_positions(q: Query) -> bool:
    return isinstance(q, (Phrase, Near)) or any(map(needs_positions, q.parts()))


def _single(q: Query) -> list[Query] | None:
    """The leaves, if the query's intervals are single words."""
    if isinstance(q, Boost):
        return _single(q.of)
    if isinstance(q, Leaf):
        return [q]
    if isinstance(q, Or):
        found = [_single(c) for c in q.of]
        return None if None in found else [leaf for part in found for leaf in part]
    return None


def _any_at(where: Positions, choices: list[Query]) -> Column:
    arrays = [where.at(c) for c in choices]
    return arrays[0] if len(arrays) == 1 else F.flatten(F.array(*arrays))


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p + F.lit(by))


def native(q: Query, where: Positions) -> Column | None:
    """The query as a Column; None if it needs the interval evaluator."""
    if isinstance(q, Leaf):
        return where.has(q)
    if isinstance(q, Boost):
        return native(q.of, where)
    if isinstance(q, (And, Or, AtLeast)):
        parts = [native(p.of if isinstance(p, Not) else p, where) for p in q.of]
        if any(p is None for p in parts):
            return None
        parts = [~c if isinstance(p, Not) else c for p, c in zip(q.of, parts, strict=True)]
        if isinstance(q, AtLeast):
            return sum((c.cast("int") for c in parts), F.lit(0)) >= q.least
        out = parts[0]
        for c in parts[1:]:
            out = out & c if isinstance(q, And) else out | c
        return out
    if isinstance(q, Phrase) and not q.slop:
        # each slot's array is used once, and intersected by hash
        first, *rest = q.slots
        places, before = _any_at(where, list(first.choices)), first.offset
        for slot in rest:
            places = F.array_intersect(_moved(places, slot.offset - before), _any_at(where, list(slot.choices)))
            before = slot.offset
        return F.size(places) > 0
    if isinstance(q, Near) and (left := _single(q.left)) and (right := _single(q.right)) and q.gap <= NEAR_LIMIT:
        a, b = _any_at(where, left), _any_at(where, right)
        after = lambda x, y: F.arrays_overlap(F.flatten(F.transform(x, lambda p: F.sequence(p + F.lit(1), p + F.lit(q.gap + 1)))), y)
        return after(a, b) if q.ordered else after(a, b) | after(b, a)
    return None


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value evaluated once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def places(q: Query, where: Positions) -> Column:
    return F.struct(*(where.at(leaf).alias(f"p{i}") for i, leaf in enumerate(leaves(q))))


def by_intervals(q: Query, places: Column) -> Column:
    """The query on a struct of its leaves' positions, by Arrow UDF."""
    own = leaves(q)

    @F.arrow_udf("boolean")
    def evaluate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            rows = b.to_pylist()
            yield pa.array([bool(spans(q, lambda leaf, r=r: sorted(r[f"p{own.index(leaf)}"] or ()))) for r in rows], pa.bool_())

    return evaluate(places)


def by_positions(q: Query, where: Positions) -> Column:
    """The query as a Column, by Arrow UDF over positions where it must be."""
    found = native(q, where)
    return by_intervals(q, places(q, where)) if found is None else found


def by_words(q: Query, words: Column) -> Column:
    """The query on an array of folded words, which is evaluated once a row."""
    if native(q, InWords(words)) is None:
        return by_intervals(q, bound(words, lambda w: places(q, InWords(w))))
    return bound(words, lambda w: native(q, InWords(w)))


def necessary(q: Query, has: Callable[[str], Column]) -> Column | None:
    """What a text that matches must hold, by has(characters of a term); None where nothing is known."""
    every = lambda parts: reduce(Column.__and__, parts) if parts else None
    either = lambda parts: None if any(c is None for c in parts) else reduce(Column.__or__, parts)
    parts = lambda of: [necessary(p, has) for p in of]
    known = lambda of: [c for c in parts(of) if c is not None]
    if isinstance(q, (Term, Prefix, Fragment)):
        return has(q.text)
    if isinstance(q, Boost):
        return necessary(q.of, has)
    if isinstance(q, Phrase):
        slots = [either(parts(slot.choices)) for slot in q.slots]
        return every([c for c in slots if c is not None])
    if isinstance(q, (And, Near)):
        return every(known(p for p in q.parts() if not isinstance(p, Not)))
    if isinstance(q, (Or, AtLeast)):
        return either(parts(q.of))
    return None


def by_text(q: Query, text: Column) -> Column:
    """The query on any text, by the Python analyzer in bulk."""

    @F.arrow_udf("boolean")
    def evaluate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = Finder(leaves(q))
        for b in batches:
            yield pa.array([None if t is None else bool(spans(q, finder.places(analyzer.word_list(t)).__getitem__)) for t in b.to_pylist()], pa.bool_())

    return evaluate(text)
