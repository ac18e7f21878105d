"""From text to terms: word boundaries of UAX #29, then case and accent folding.

Two forms that agree: Column expressions for texts of Latin script (plain()), which stay in the JVM, and
a Python analyzer for any text. A term's position is its word's number; a word that folds to nothing or
to more than MAX_TERM_BYTES keeps its number but is no term.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TERM_BYTES = 64

#: Words of folded Latin text: runs of letters, digits and underscores with one of the former two, joined as UAX #29 joins them.
#: Possessive and by runs, so that a match takes no step of recursion a character; what fails most often is looked at first.
WORD = r"(?:[a-z0-9\p{L}]|_(?<!__)_*+[a-z0-9\p{L}])[\w\p{L}]*+(?:[:.,;'’‘·](?:(?<=\p{L}[:.'’‘·])(?=\p{L})|(?<=[0-9][,;.'’‘])(?=[0-9]))[\w\p{L}]++)*+"
ASCII_WORD = r"(?:[a-z0-9]|_(?<!__)_*+[a-z0-9])\w*+(?:[:.,;'](?:(?<=[a-z][:.'])(?=[a-z])|(?<=[0-9][,;.'])(?=[0-9]))\w++)*+"
_ASCII_WORD = regex.compile(r"(?:[A-Za-z](?:[:.'][A-Za-z])*|[0-9](?:[,;.'][0-9])*|_)+")
#: Characters that the Column form handles as the Python form does.
_LAST = 0x024F


def _simple(code: int) -> bool:
    c = chr(code)
    if code < 0x80:
        return True
    if unicodedata.category(c) not in ("Lu", "Ll", "Lt"):
        return c in "¡¿«»§©°±·×÷\xa0"
    parts = [d for d in unicodedata.normalize("NFKD", c) if not unicodedata.category(d).startswith("M")]
    return len(parts) == 1 and len(parts[0].lower()) == 1 and len(c.lower()) == 1 and regex.match(r"\p{WB=ALetter}", c) is not None


_PLAIN = [c for c in range(0x80, _LAST + 1) if _simple(c)] + [ord(c) for c in "–—‘’“”„…€"]


def fold(word: str) -> str:
    """NFKD without marks, each character in lower case."""
    if word.isascii():
        return word.lower()
    return "".join(c.lower() for c in unicodedata.normalize("NFKD", word) if not unicodedata.category(c).startswith("M"))


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, str]:
    """What plain() looks for, and the two sides of the folding table."""
    ranges, start = [], None
    for c in [*sorted(_PLAIN), None]:
        if start is not None and c != last + 1:
            ranges.append(f"\\x{{{start:x}}}-\\x{{{last:x}}}")
            start = c
        start, last = (c if start is None else start), c
    source = [c for c in map(chr, _PLAIN) if fold(c) and fold(c) != c and unicodedata.category(c)[0] == "L"]
    return "[^\\x00-\\x7f" + "".join(ranges) + "]", "".join(source), "".join(map(fold, source))


def plain(text: Column) -> Column:
    """Whether the Column form applies; about every text of Latin script."""
    return ascii_only(text) | ~F.rlike(text, F.lit(_tables()[0]))


def ascii_only(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def folded_text(text: Column) -> Column:
    """A whole text folded (Column form): it holds every term of the text."""
    _, source, target = _tables()
    return F.lower(F.when(ascii_only(text), text).otherwise(F.translate(text, source, target)))


def folded(text: Column) -> Column:
    """Each word's folded form; its index is its position. Folding turns letters into letters, so the whole text is folded first."""
    found = lambda t, word: F.regexp_extract_all(t, F.lit(word), F.lit(0))
    return F.when(ascii_only(text), found(F.lower(text), ASCII_WORD)).otherwise(found(folded_text(text), WORD))


def is_term(term: Column) -> Column:
    return (F.octet_length(term) <= MAX_TERM_BYTES) & (term != "")


def terms(text: Column) -> Column:
    """Terms in order, repeats included."""
    return F.filter(folded(text), is_term)


def unique_terms(text: Column) -> Column:
    return F.array_sort(F.array_distinct(terms(text)))


def grams(term: Column) -> Column:
    """Distinct runs of four characters of the term, its end marked."""
    marked = F.concat(term, F.lit("\u0002"))
    return F.when(F.length(marked) < 4, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(marked) - 3), lambda i: F.substr(marked, i, F.lit(4)))))


def fragment_grams(fragment: str) -> list[str]:
    return sorted({fragment[i : i + 4] for i in range(len(fragment) - 3)})


# the Python form

_LETTER, _HEBREW = "L", "H"
_CLASSES = [("ALetter", "L"), ("Hebrew_Letter", "H"), ("Numeric", "N"), ("Katakana", "K"), ("ExtendNumLet", "U"), ("MidLetter", "m"), ("MidNum", "n"), ("MidNumLet", "b"), ("Single_Quote", "q"), ("Double_Quote", "d"), ("Extend", "x"), ("Format", "x"), ("ZWJ", "z"), ("Regional_Indicator", "R"), ("CR", "r"), ("LF", "f"), ("Newline", "w"), ("WSegSpace", "s")]
_FINDERS = [(regex.compile(rf"\p{{WB={name}}}"), code) for name, code in _CLASSES]
_PICTURE = regex.compile(r"\p{Extended_Pictographic}")
_WORDLIKE = regex.compile(r"[\p{Alphabetic}\p{N}]")


@lru_cache(maxsize=20_000)
def _class(c: str) -> str:
    for finder, code in _FINDERS:
        if finder.match(c):
            return code
    return "o"


def segments(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the segments between the default word boundaries."""
    if not text:
        return
    kinds = [_class(c) for c in text]
    n, start, flags = len(text), 0, 0

    def after(i: int) -> str:
        """The class that follows place i, ignorable characters skipped."""
        i += 1
        while i < n and kinds[i] in "xz":
            i += 1
        return kinds[i] if i < n else ""

    left = kinds[0]  # the last class that counts, and the one before it
    before = ""
    flags = 1 if left == "R" else 0
    for i in range(1, n):
        raw, k = kinds[i - 1], kinds[i]
        if raw == "r" and k == "f":
            joined = True
        elif raw in "rfw" or k in "rfw":
            joined = False
        elif raw == "z" and _PICTURE.match(text[i]):
            joined = True
        elif raw == "s" and k == "s":
            joined = True
        elif k in "xz":
            continue
        else:
            joined = (
                (left in "LH" and k in "LH")
                or (left in "LH" and k in "mbq" and after(i) in ("L", "H"))
                or (left in "mbq" and before in ("L", "H") and k in "LH")
                or (left == "H" and k == "q")
                or (left == "H" and k == "d" and after(i) == "H")
                or (left == "d" and before == "H" and k == "H")
                or (left in "NLH" and k == "N")
                or (left == "N" and k in "LH")
                or (left in "nbq" and before == "N" and k == "N")
                or (left == "N" and k in "nbq" and after(i) == "N")
                or (left == "K" and k == "K")
                or (left in "LHNKU" and k == "U")
                or (left == "U" and k in "LHNK")
                or (left == "R" and k == "R" and flags % 2 == 1)
            )
        if not joined:
            yield start, i
            start = i
        flags = flags + 1 if k == "R" and left == "R" and joined else 1 if k == "R" else 0
        before, left = (left if joined else ""), k
    yield start, n


def word_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of each word, in characters."""
    if text.isascii():
        return [m.span() for m in _ASCII_WORD.finditer(text) if m.group().strip("_")]
    return [(a, b) for a, b in segments(text) if _WORDLIKE.search(text, a, b)]


def analyze(text: str) -> list[tuple[str, int, int, int]]:
    """(term, position, start, end) in order."""
    out = []
    for position, (a, b) in enumerate(word_spans(text)):
        term = fold(text[a:b])
        if term and len(term.encode()) <= MAX_TERM_BYTES:
            out.append((term, position, a, b))
    return out


def term_list(text: str) -> list[str]:
    return [t for t, *_ in analyze(text)]


# the Python form in bulk: whole texts are folded and split by C functions, to the same words as word_spans() and fold()

_NOT_PLAIN = re.compile("[^\x00-\x7f" + "".join(map(chr, _PLAIN)) + "]")
_JOINERS = ":.,;'’‘·"
#: Joiners that join nothing.
_LOOSE = re.compile(rf"[{_JOINERS}](?!(?<=[^\W\d_][:.'’‘·])[^\W\d_]|(?<=\d[,;.'’‘])\d)")
#: Two joiners and what the micro sign folds to are beyond Latin-1; they travel as controls, which plain texts don't hold.
_CARRIED = {"’": "\x91", "‘": "\x92", "μ": "\x93"}
_SPACED = re.compile("[–—“”„…€]")


def _spaced(c: str) -> str:
    """A plain character folded, or a space where it can't be in a word."""
    return fold(c) if c.isalnum() or c == "_" else c if c in _JOINERS else " "


_FOLDED = {c: _spaced(chr(c)) for c in [*range(128), *_PLAIN]}
_BYTES = bytes(ord(_CARRIED.get(c, c)) for c in (_FOLDED.get(c, chr(c)) for c in range(256)))


def word_list(text: str) -> list[str]:
    """Each word's folded form; its index is its position."""
    if text.isascii():
        text = text.translate(_FOLDED)
    elif _NOT_PLAIN.search(text):
        return [fold(text[a:b]) for a, b in word_spans(text)]
    else:
        carried = _SPACED.sub(" ", text)
        for c in "’‘":
            carried = carried.replace(c, _CARRIED[c])
        try:
            text = carried.encode("latin-1").translate(_BYTES).decode("latin-1")
            for c, control in _CARRIED.items():
                text = text.replace(control, c)
        except UnicodeEncodeError:
            text = text.translate(_FOLDED)
    found = _LOOSE.sub(" ", text).split()
    return [w for w in found if w.strip("_")] if "_" in text else found


def is_term_text(word: str) -> bool:
    return 0 < len(word.encode()) <= MAX_TERM_BYTES


def distinct_terms(words: list[str]) -> int:
    """How many terms a text of these words has."""
    found = set(words)
    longest = max(map(len, found), default=0)
    return len(found) - ("" in found) if 4 * longest <= MAX_TERM_BYTES else sum(map(is_term_text, found))
