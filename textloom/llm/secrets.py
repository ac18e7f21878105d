"""Secret scans: candidates by shape, false positives removed by a random forest.

A candidate is a run of 12 or more key characters that has a digit, or changes from lower to upper
case inside; any value, of any length and characters, that is assigned to a word which names secrets
(up to its quote, or white space or a delimiter); the password of a URL; and three or more runs joined by
dots. Of findings inside each other the longest is reported. The forest sees its length, the shares of character classes, how usual its character
transitions are in prose, how much of it dictionary words cover, whether it is part of a path, an address or a URL,
and the words beside it. It is trained from labelled findings; without any of the user's own, from
the labelled examples that examples() makes (keys, tokens and passwords; hashes of commits and
files, identifiers, versions, paths, addresses, numbers, placeholders).

Cases: null and empty texts hold nothing; a null id is returned as null; repeated rows are reported
each; a candidate of any length is judged whole; equal findings at several places are reported at
each; an empty table gives an empty result; other columns are not read. Secrets themselves are never
returned, only their places and digests.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, mapped, read

CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{12,}={0,2}")
TELLING = re.compile(r"[0-9]|[a-z][A-Z]")
DOTTED = re.compile(r"(?<![A-Za-z0-9_\-])[A-Za-z0-9_\-]+(?:\.[A-Za-z0-9_\-]+){2,}")
LOGIN = re.compile(r"://[^\s/:@]*:([^\s/]+)@")
ASSIGNED = re.compile(r"(?:pass(?:w|phrase|_|\b)|pwd|secret|token|api[_\-]?key|auth|bearer|credential|private|key)[\w\-]{0,32}[\"'\])]{0,2}[ \t]{0,8}(?:=>|:=|==?|:)[ \t]{0,8}|bearer[ \t]{1,8}", re.IGNORECASE)
VALUE = re.compile(r"\"([^\"\n]+)\"|'([^'\n]+)'|`([^`\n]+)`|[\"'`]?([^\s\"'`,;<>]+)")
#: Characters looked at before and after a candidate.
NEAR = 40
TREES, DEPTH, LEAF, SEED = 40, 8, 4, 7
THRESHOLD = 0.5

ASKING = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private", "key")
PLAIN = ("commit", "sha", "md5", "checksum", "digest", "hash", "uuid", "guid", "etag", "version", "build", "rev", "isbn", "id", "ref", "href", "src", "http", "file", "path", "example", "sample")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "eyJ", "AIza", "glpat-", "npm_", "SG")
WORDS = frozenset("the and for that with this from have not are was but you all can has more will one about there their which when what your page home user name test data file list view item text time year work part place case week company system program question number night point world area money story fact month right study book word business issue side kind head house service friend father power hour game line end member law car city community president team minute idea body information back parent face others level office door health person art war history party result change morning reason research girl guy moment air teacher force education index image style script class main content default config setting value table query server client public private static final return import package module function method object string integer array example sample placeholder password secret token changeme release version build update install linux windows".split())
LONGEST = max(map(len, WORDS))

NAMES = ("length", "digits", "upper", "lower", "hex", "symbols", "entropy", "changes", "transitions", "dictionary", "slashes", "separators", "uuid", "path", "address", "assigned", "quoted", "asking", "plain", "prefix", "groups", "runs")


@lru_cache(maxsize=1)
def _transitions() -> dict[str, float]:
    """How usual each pair of lower-case letters is in the dictionary's words, as log-odds."""
    counts: dict[str, int] = {}
    for w in WORDS:
        for i in range(len(w) - 1):
            counts[w[i : i + 2]] = counts.get(w[i : i + 2], 0) + 1
    total = sum(counts.values())
    letters = "abcdefghijklmnopqrstuvwxyz"
    return {a + b: math.log((counts.get(a + b, 0) + 0.1) * 676 / (total + 67.6)) for a in letters for b in letters}


def _covered(lower: str) -> float:
    """Share of the characters that dictionary words of four or more letters cover, longest first."""
    at = n = 0
    while at < len(lower):
        for k in range(min(LONGEST, len(lower) - at), 3, -1):
            if lower[at : at + k] in WORDS:
                at, n = at + k, n + k
                break
        else:
            at += 1
    return n / len(lower)


def describe(text: str, start: int, end: int) -> list[float]:
    """The features NAMES of the candidate text[start:end]."""
    s, n = text[start:end], end - start
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    near = before.lower()
    lower = s.lower()
    kinds = [0 if c.isdigit() else 1 if "A" <= c <= "Z" else 2 if "a" <= c <= "z" else 3 for c in s]
    share = [kinds.count(k) / n for k in range(4)]
    pairs = [_transitions()[p] for i in range(n - 1) if (p := lower[i : i + 2]) in _transitions()]
    counts = {c: s.count(c) for c in set(s)}
    words = re.findall(r"[a-z_\-]+|[^\sa-z_\-]", near)[-4:]
    edge = before[-1:]
    return [
        float(n), share[0], share[1], share[2], float(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) is not None), share[3],
        -sum(c / n * math.log2(c / n) for c in counts.values()), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        sum(pairs) / len(pairs) if pairs else 0.0, _covered(lower), float(s.count("/")), float(s.count("-") + s.count("_")),
        float(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", s) is not None),
        float(s[:1] == "/" or edge in "/.~\\" and edge != "" or after[:1] in (".", "/", "\\") and after[1:2].isalnum()), float(edge == "@" or after[:1] == "@"),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(edge in "\"'`" and edge != ""),
        float(any(a in w for w in words for a in ASKING)), float(any(w.strip("-_") == a or a in ("http", "sha", "commit") and w.startswith(a) for w in words for a in PLAIN)),
        float(s.startswith(PREFIXES)), float(len(re.findall(r"[A-Za-z]+|[0-9]+", s))) / n, max(len(m.group()) for m in re.finditer(r"(.)\1*", s)) / n,
    ]


class Forest:
    """Random forest of classification trees (Gini, bootstrap rows, square-root features)."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        self.trees = trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = SEED) -> Forest:
        rng = np.random.default_rng(seed)
        y = y.astype(float)
        out = []
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            feature, cut, left, right, value = [], [], [], [], []

            def grow(rows: np.ndarray, level: int) -> int:
                node = len(value)
                for column, start in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (value, float(y[rows].mean()))):
                    column.append(start)
                if level == depth or len(rows) < 2 * leaf or value[node] in (0.0, 1.0):
                    return node
                best = (1e-9, -1, 0.0)
                whole = value[node] * (1 - value[node]) * len(rows)
                for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]))), replace=False):
                    order = np.argsort(x[rows, f], kind="stable")
                    v, t = x[rows[order], f], np.cumsum(y[rows[order]])
                    n = np.arange(1, len(rows))
                    p, q = t[:-1] / n, (t[-1] - t[:-1]) / (len(rows) - n)
                    gain = whole - p * (1 - p) * n - q * (1 - q) * (len(rows) - n)
                    gain[(v[1:] == v[:-1]) | (n < leaf) | (len(rows) - n < leaf)] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), int(f), float((v[k] + v[k + 1]) / 2))
                if best[1] >= 0:
                    feature[node], cut[node] = best[1], best[2]
                    low = x[rows, best[1]] <= best[2]
                    left[node] = grow(rows[low], level + 1)
                    right[node] = grow(rows[~low], level + 1)
                return node

            grow(rows, 0)
            out.append((np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value)))
        return cls(out)

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                f = feature[at]
                inner = f >= 0
                low = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += value[at]
        return total / len(self.trees)


def examples(n: int = 3000, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """Labelled findings (text, start, end, label), half of them secrets."""
    rng = random.Random(seed)
    run = lambda a, k: "".join(rng.choice(a) for _ in range(k))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa, b62, b64 = "0123456789abcdef", low + up + num, low + up + num + "+/"
    words = sorted(WORDS)
    prose = lambda: " ".join(rng.choice(words) if rng.random() < 0.5 else run(low, rng.randint(2, 9)) for _ in range(rng.randint(2, 6)))
    join = lambda: rng.choice(["=", ": ", " = ", ":", '="', " = \"", "': '"])
    slug = lambda k: rng.choice("-_/").join(rng.choice(words) for _ in range(k))
    out = []
    for i in range(n):
        secret = i % 2
        if secret:
            kind = rng.randrange(7)
            value = [lambda: "AKIA" + run(up + num, 16), lambda: run(hexa, rng.choice([16, 18, 20, 24, 32, 40, 64])), lambda: run(b62, rng.randint(14, 48)), lambda: run(b64, rng.choice([24, 32, 40, 44, 64])), lambda: rng.choice(["ghp_", "sk-", "sk_live_", "glpat-", "xoxb-"]) + run(b62, rng.randint(20, 40)), lambda: "eyJ" + run(b62 + "-_", rng.randint(30, 80)), lambda: run(low + num, rng.randint(12, 24))][kind]()
            lead = "" if kind in (0, 4, 5) and rng.random() < 0.6 else rng.choice(ASKING) + join()
        else:
            kind = rng.randrange(9)
            value = [lambda: run(hexa, 40), lambda: run(hexa, rng.choice([32, 64])), lambda: "-".join(run(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: slug(rng.randint(3, 6)) + rng.choice(["", run(num, 4)]), lambda: run(num, rng.choice([13, 15, 16])), lambda: "".join(w.capitalize() for w in rng.choices(words, k=rng.randint(2, 4))), lambda: rng.choice(words) + "-" + run(num, rng.randint(6, 10)), lambda: rng.choice(["your_password_here1", "changeme12345", "example-token-123", "xxxxxxxxxxxx1234", "password12345678", "000000000000", "123456789012"]), lambda: run(low, rng.randint(9, 14)) + run(num, rng.randint(1, 3))][kind]()
            lead = {0: ["commit ", "sha1: ", "rev ", "etag="], 1: ["md5: ", "sha256:", "checksum = ", "digest: "], 2: ["uuid=", "id: ", "", "guid: "], 3: ["/", "path=/", "http://", "src=\""], 7: ["password=", "token: ", "secret = "]}.get(kind, ["", "id=", " "])
            lead = rng.choice(lead)
        left = f"{prose()} {lead}"
        tail = rng.choice(["", " ", '" ', ", ", ". ", "\n"]) + (prose() if rng.random() < 0.8 else "")
        if CANDIDATE.fullmatch(value):
            out.append((f"{left}{value}{tail if tail[:1] in ('', ' ', ',', chr(34), chr(10), '.') else ' '}", len(left), len(left) + len(value), secret))
    # assigned values of any shape, passwords of URLs, dotted tokens
    signs = "!@#$%^&*.?"
    asking = [a for a in ASKING if a != "bearer"]
    leet = lambda w: "".join({"a": "4", "o": "0", "e": "3", "i": "1"}.get(c, c) if rng.random() < 0.6 else c for c in w)
    for i in range(n):
        secret, left, right = i % 2, prose() + " ", ""
        kind = rng.randrange(8 if secret else 6)
        if secret and kind == 0:
            value, left, right = run(low + num, rng.randint(5, 14)) + rng.choice(["", run(signs, 1)]), f"{left}{rng.choice(['postgres', 'mysql', 'https', 'redis', 'amqp'])}://{rng.choice(words)}:", f"@{rng.choice(words)}.{rng.choice(words)}/{rng.choice(words)}"
        elif secret and kind == 1:
            value, left = f"eyJ{run(b62, rng.randint(15, 40))}.eyJ{run(b62, rng.randint(20, 80))}.{run(b62 + '-_', 43)}", left + rng.choice(["", "token: ", "token=", "Bearer "])
        elif secret:
            value = [run(b62 + signs, rng.randint(8, 20)), leet(rng.choice(words)).capitalize() + run(num + signs, rng.randint(2, 5)), run(b62, rng.randint(6, 11)), run(low, rng.randint(9, 20)), run(up, rng.randint(9, 20)), run(low, 4) + run(signs, 1) + run(num + up, 4)][kind - 2]
        elif kind == 0:
            value = ".".join(rng.choices(words, k=rng.randint(3, 5)))+ "." + rng.choice(["com", "org", "v1", "html", "py3"])
            left += rng.choice(["", "http://", "www.", "key: "])
        else:
            value = [rng.choice(words), run(num, rng.randint(1, 4)), rng.choice(["${PASSWORD}", "$TOKEN", "********", "xxxxxx", "None", "null", "true", "false", "os.environ", "getpass()", "args.password", "{{secret}}", "{token}", "self.token", "changeme", "required", "your-token-here", "optional"]), rng.choice(words) + rng.choice(["_", "-", "."]) + rng.choice(words), rng.choice(words).capitalize()][kind - 1]
        if secret and kind > 1 or not secret and kind > 0:
            quote = rng.choice(["", '"', "'"])
            left, right = left + rng.choice(asking) + rng.choice(["=", ": ", " = ", ":"]) + quote, quote
        right += rng.choice(["", " " + prose(), "\n" + prose()])
        place = (len(left), len(left) + len(value))
        if place in candidates(left + value + right):
            out.append((left + value + right, *place, secret))
    return out


def train(findings: list[tuple[str, int, int, int]] | None = None, most: int = 20_000) -> Forest:
    """Fits on labelled findings, at most so many (the first ones)."""
    rows = (findings or examples())[:most]
    return Forest.fit(np.array([describe(t, a, b) for t, a, b, _ in rows]), np.array([y for *_, y in rows]))


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """The places of all candidates, in order."""
    found = {m.span() for m in CANDIDATE.finditer(text) if TELLING.search(text, m.start(), m.end())}
    found |= {m.span() for m in DOTTED.finditer(text) if m.end() - m.start() >= 24 and TELLING.search(text, m.start(), m.end())}
    found |= {m.span(1) for m in LOGIN.finditer(text)}
    plain: list[int] = []  # first and last start, and the end, of the unquoted value read last
    for lead in ASSIGNED.finditer(text):
        if plain and lead.end() < plain[2]:
            plain[1] = lead.end()
            continue
        if m := VALUE.match(text, lead.end()):
            start, end = m.span(m.lastindex)
            if m.lastindex < 4:
                found.add((start, end))
                continue
            if plain:
                found |= {_trimmed(text, plain[0], plain[2]), _trimmed(text, plain[1], plain[2])}
            plain = [start, start, end]
    if plain:
        found |= {_trimmed(text, plain[0], plain[2]), _trimmed(text, plain[1], plain[2])}
    yield from sorted(x for x in found if x[0] < x[1])


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Without the full stop or bracket of the sentence around it."""
    while end > start + 1 and text[end - 1] in ".)]}":
        end -= 1
    return start, end


def outermost(rows: list[tuple[int, int, float]]) -> Iterator[tuple[int, int, float]]:
    """(start, end, probability) less those inside others."""
    reached = -1
    for start, end, p in sorted(rows, key=lambda r: (r[0], -r[1])):
        if end > reached:
            reached = end
            yield start, end, p


def kind_of(s: str) -> str:
    if s.startswith(PREFIXES):
        return "key with a known prefix"
    return "hexadecimal" if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) else "password or token"


FOUND = "doc_id long, start_char long, end_char long, kind string, probability double, secret_sha256 string"


def scan(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The findings that the forest does not hold false, with their places in the text."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            found = [(i, s, e) for i, t in enumerate(texts) for s, e in candidates(t)]
            rows: list[tuple] = []
            held: dict[int, list[tuple[int, int, float]]] = {}
            for lo in range(0, len(found), 10_000):
                part = found[lo : lo + 10_000]
                p = forest.probability(np.array([describe(texts[i], s, e) for i, s, e in part]))
                for (i, s, e), x in zip(part, p.tolist(), strict=True):
                    if x >= threshold:
                        held.setdefault(i, []).append((s, e, x))
            for i in sorted(held):
                for s, e, x in outermost(held[i]):
                    value = texts[i][s:e]
                    rows.append((ids[i], s, e, kind_of(value), round(x, 6), hashlib.sha256(value.encode()).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return mapped(id_text(docs, id_col, text_col), run, FOUND)


def op9(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"), train())
