"""Term patterns as Columns and as Python: equal, prefix, fragment, and typos (optimal string alignment over bytes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.query import Fragment, Fuzzy, Prefix, Query, Term


def within(a: str, b: str, k: int) -> bool:
    """Whether at most k insertions, deletions, substitutions or swaps of neighbours lead from a to b, in UTF-8 bytes."""
    x, y = a.encode(), b.encode()
    if abs(len(x) - len(y)) > k:
        return False
    before: list[int] = []
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        new = [i]
        for j, d in enumerate(y, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d))
            if i > 1 and j > 1 and c == y[j - 2] and x[i - 2] == d:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > k and (not row or min(row) > k):
            return False
        before, row = row, new
    return row[-1] <= k


def matches(leaf: Query, term: str) -> bool:
    if isinstance(leaf, Term):
        return term == leaf.text
    if isinstance(leaf, Prefix):
        return term.startswith(leaf.text)
    if isinstance(leaf, Fragment):
        return leaf.text in term
    return within(term, leaf.text, leaf.distance)


def _bytewise(term: Column) -> Column:
    """One character for each byte, so that edits count bytes."""
    return F.when(F.octet_length(term) == F.length(term), term).otherwise(F.decode(F.encode(term, "UTF-8"), "ISO-8859-1"))


def _swaps(q: str) -> list[tuple[str, str, str]]:
    """(before, swapped pair, after) for each pair of unequal neighbours."""
    return [(q[:i], q[i + 1] + q[i], q[i + 2 :]) for i in range(len(q) - 1) if q[i] != q[i + 1]]


def _once(t: Column, q: str) -> Column:
    found = F.levenshtein(t, F.lit(q), 1) >= 0
    swapped = [a + w + b for a, w, b in _swaps(q)]
    return found | t.isin(swapped) if swapped else found


def typo(term: Column, query: str, k: int) -> Column:
    """within() as a Column: Levenshtein, or one swap with the rest within what is left."""
    t, q = _bytewise(term), query.encode().decode("latin-1")
    if k == 1:
        return _once(t, q)
    found = F.levenshtein(t, F.lit(q), 2) >= 0
    for a, w, b in _swaps(q):
        head, tail = a + w, w + b
        found = found | (F.startswith(t, F.lit(head)) & _once(F.substring(t, len(head) + 1, 1_000_000), b))
        found = found | (F.endswith(t, F.lit(tail)) & _once(F.substr(t, F.lit(1), F.length(t) - len(tail)), a))
    return found & (F.abs(F.length(t) - len(q)) <= 2)


def hit(leaf: Query, term: Column) -> Column:
    """Whether the leaf matches a term."""
    if isinstance(leaf, Term):
        return term == leaf.text
    if isinstance(leaf, Prefix):
        return F.startswith(term, F.lit(leaf.text))
    if isinstance(leaf, Fragment):
        return F.contains(term, F.lit(leaf.text))
    assert isinstance(leaf, Fuzzy)
    return typo(term, leaf.text, leaf.distance)
