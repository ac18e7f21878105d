"""Highlighting and snippets."""

from __future__ import annotations

from ..plans.query import Query
from .spans import Document, marks


def _joined(between: str) -> bool:
    """Neighbours share a pair of markers if nothing but spaces, or no space at all, parts them."""
    return not any(c.isspace() for c in between) or between.isspace()


def _render(text: str, tokens: list[tuple[int, int, int]], marked: set[int], lo: int, hi: int, start: str, stop: str) -> str:
    runs: list[list[int]] = []  # last position, start, end
    for position, a, b in tokens:
        if position in marked and lo <= a and b <= hi:
            if runs and position == runs[-1][0] + 1 and _joined(text[runs[-1][2] : a]):
                runs[-1][0], runs[-1][2] = position, b
            else:
                runs.append([position, a, b])
    out, at = [], lo
    for _, a, b in runs:
        out += [text[at:a], start, text[a:b], stop]
        at = b
    return "".join([*out, text[at:hi]])


def highlight(text: str, q: Query, start: str = "<b>", stop: str = "</b>") -> str:
    """The text, matched words between markers."""
    doc = Document(text)
    return _render(text, doc.tokens, marks(q, doc.positions), 0, len(text), start, stop)


def snippet(text: str, q: Query, words: int = 30, start: str = "<b>", stop: str = "</b>") -> str:
    """Up to so many words where matches are densest, highlighted; cuts show as an ellipsis."""
    doc = Document(text)
    if not doc.tokens or words <= 0:
        return ""
    marked = marks(q, doc.positions)
    n = min(words, len(doc.tokens))
    flags = [p in marked for p, _, _ in doc.tokens]
    total = [0]
    for f in flags:
        total.append(total[-1] + f)
    at = max(range(len(flags) - n + 1), key=lambda i: (total[i + n] - total[i], -i))
    first = flags[at : at + n].index(True) if any(flags[at : at + n]) else 0
    if first > n // 4:
        at = min(at + first - n // 4, len(flags) - n)
    body = _render(text, doc.tokens, marked, doc.tokens[at][1], doc.tokens[at + n - 1][2], start, stop)
    return "…" * (at > 0) + body + "…" * (at + n < len(flags))
