"""Near-duplicate detection by circulant MinHash, confirmed on full shingle sets.

A text's set is its distinct word shingles. One permutation (sigma) scatters the shingle hashes, a
second one (pi), shifted circularly by k, gives the k-th signature coordinate: BANDS * ROWS
coordinates from two permutations. Documents that share a band are candidates. A pair at the limit
of 0.8 is missed with probability (1 - 0.8**ROWS)**BANDS, 1.2e-7.

Without all pairs of a group: equal sets first collapse to one representative. Then every band bucket
links its members to its smallest one only (a star); confirmed stars give components. Only buckets
that still span several components go on. In small ones, pairs of different components that pass
a bound on length and a one-bit sketch (192 coordinates; a pair at the limit fails it with less than
1e-9) are confirmed as well. Large ones are joined by their largest component, and their members
outside it are compared, in blocks, with all members by an index of their shingles. So no two members of one
bucket stay unjoined without a comparison, and pairs inside a component, which change nothing, are
not made.

Cases: null and empty texts and texts without words have an empty set, linked with nothing; fewer
words than a shingle are one shingle; rows repeated with one id are one node (their links count
together); null ids get a null component and are kept; ties go to the smallest id; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, free_shuffles, id_text, join_counted, keep, mapped, read, resident

ROWS, BANDS = 5, 40
SKETCH_WORDS = 3
#: Bits of the sketch in which a pair at the limit may differ (19 expected, 4 the deviation).
SKETCH_DIFFER = 48

SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Members up to which a bucket's open pairs are compared one by one; rows of a block in larger ones.
SMALL, BLOCK = 32, 2048
#: Words that a worker keeps the hashes of.
CACHE_WORDS = 600_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word)
        self[word] = found
        return found


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode().translate(LOWER).translate(SPACE).split(b" ")
    h = np.fromiter(map(resident("words", _WordHashes).__getitem__, [w for w in words if w]), np.uint64)
    if not len(h):
        return h
    h = _mix64(h)
    n = min(size, len(h))
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        acc = _mix64(acc * _M2 + h[i : len(h) - n + 1 + i])
    return np.unique(acc)


def _signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """(coordinates, sets) uint32; every set has at least one member."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    # sigma
    x ^= x >> np.uint32(17)
    x *= np.uint32(0xED5AD4BB)
    x ^= x >> np.uint32(11)
    x *= np.uint32(0xAC4C1B51)
    out = np.empty((coordinates, len(sets)), np.uint32)
    a, b = np.empty_like(x), np.empty_like(x)
    for k in range(coordinates):
        # pi, shifted by k
        np.add(x, np.uint32((k * 0x9E3779B1) & 0xFFFFFFFF), out=a)
        np.right_shift(a, np.uint32(16), out=b)
        np.bitwise_xor(a, b, out=a)
        np.multiply(a, np.uint32(0x7FEB352D), out=a)
        np.right_shift(a, np.uint32(15), out=b)
        np.bitwise_xor(a, b, out=a)
        np.multiply(a, np.uint32(0x846CA68B), out=a)
        np.right_shift(a, np.uint32(16), out=b)
        np.bitwise_xor(a, b, out=a)
        out[k] = np.minimum.reduceat(a, starts)
    return out


SIGNED = "doc_id long, n long, d0 long, d1 long, s0 long, s1 long, s2 long, bands array<long>"
_SIGNED = pa.schema([*((c, pa.int64()) for c in "doc_id n d0 d1 s0 s1 s2".split()), ("bands", pa.list_(pa.int64()))])


def sign(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    import hashlib

    for b in batches:
        ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
        lo = 0
        while lo < len(ids):
            sets, held = [], 0
            while lo < len(ids) and held < 40_000:  # keeps the arrays in the processor's cache
                sets.append((ids[lo], shingle_set(texts[lo], size)))
                held += len(sets[-1][1])
                lo += 1
            full = [s for _, s in sets if len(s)]
            rows: list[tuple] = []
            if full:
                signature = _signatures(full, ROWS * BANDS)
                keys = np.zeros((BANDS, len(full)), np.uint64)
                for k in range(ROWS * BANDS):
                    band = k // ROWS
                    keys[band] = _mix64(keys[band] + signature[k] + np.uint64(band + 1))
                keys = keys.view(np.int64).T.tolist()
                bits = np.packbits((signature[: 64 * SKETCH_WORDS] & np.uint32(1)).astype(bool), axis=0, bitorder="little")
                sketches = np.ascontiguousarray(bits.T).view("<i8").tolist()
                digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8").tolist() for s in full]
                rows = list(zip(keys, sketches, digests, strict=True))
            columns: list[list] = [[] for _ in range(8)]
            at = iter(rows)
            for doc_id, s in sets:
                keys_, sketch, digest = next(at) if len(s) else ([], [0] * 3, [None] * 2)
                for column, value in zip(columns, (doc_id, len(s), *digest, *sketch, keys_), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SIGNED, strict=True)], schema=_SIGNED)


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: OrderedDict[str, np.ndarray] = OrderedDict()

        def of(text: str) -> np.ndarray:
            if text in cache:
                cache.move_to_end(text)
            else:
                cache[text] = shingle_set(text, size)
                if len(cache) > 64:
                    cache.popitem(last=False)
            return cache[text]

        for b in batches:
            good = []
            for s, t in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True):
                x, y = of(s), of(t)
                small, large = sorted((len(x), len(y)))
                common = 0
                if 100 * small >= percent * large:
                    common = small + large - len(np.unique(np.concatenate([x, y])))
                good.append(bool(large) and 100 * common >= percent * (small + large - common))
            keep_ = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(keep_)

    # a hot centre's pairs are split by the adaptive skew join
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    with_both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    return mapped(with_both, run, "a long, b long")


def _in_blocks(placed: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components among rows (main, doc_id, component) of large buckets with one main component.

    The rows outside the main component are the queries, in blocks; every block meets every block of
    all rows, once, and only confirmed links come out, one for each query and component.
    """
    sizes = placed.groupBy("main").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("all_blocks"), F.ceil(F.count(F.when(F.col("component") != F.col("main"), 1)) / BLOCK).cast("int").alias("query_blocks"))
    rows = placed.join(sizes, "main").filter("query_blocks > 0")
    block = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = rows.filter("component <> main").select("main", block("query_blocks").alias("i"), every("all_blocks").alias("j"), F.lit(0).alias("role"), "doc_id", "component")
    asking = rows.select("main", every("query_blocks").alias("i"), block("all_blocks").alias("j"), F.lit(1).alias("role"), "doc_id", "component")
    full = asked.unionByName(asking).join(texts, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, queries, index = None, [], None
        out: list[tuple[int, int]] = []
        linked: set[tuple[int, int]] = set()
        for b in batches:
            for main, i, j, role, doc_id, component, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (main, i, j) != cell:
                    cell, queries, index, linked = (main, i, j), [], None, set()
                own = shingle_set(text, size)
                if role == 0:
                    queries.append((doc_id, component, own))
                    continue
                if not queries:
                    continue
                if index is None:
                    members = np.concatenate([q[2] for q in queries])
                    order = np.argsort(members, kind="stable")
                    owners = np.repeat(np.arange(len(queries)), [len(q[2]) for q in queries])[order]
                    index = members[order], owners, np.array([len(q[2]) for q in queries])
                members, owners, lengths = index
                first, end = np.searchsorted(members, own, "left"), np.searchsorted(members, own, "right")
                n = end - first
                at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                common = np.bincount(owners[at], minlength=len(queries))
                for k in np.flatnonzero(100 * common >= percent * (lengths + len(own) - common)).tolist():
                    other, its, _ = queries[k]
                    if its != component and (other, component) not in linked:
                        linked.add((other, component))
                        out.append((other, doc_id))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
                out = []

    ordered = full.select("main", "i", "j", "role", "doc_id", "component", "text").repartition("main", "i", "j").sortWithinPartitions("main", "i", "j", "role")
    return mapped(ordered, run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, of every id that an edge (a, b) has.

    Labels spread along edges and jump to their labels' labels; minima are aggregated before they
    are shuffled, so a hub's edges meet in no task.
    """
    both = keep(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "edges")
    labels = keep(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("near")).select("id", F.least("id", "near").alias("component")), "labels")
    while True:
        heard = both.join(labels.select(F.col("id").alias("v"), "component"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("heard"))
        spread = labels.join(heard, "id", "left").select("id", F.col("component").alias("old"), F.least("component", "heard").alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("component").alias("far"))
        new = keep(spread.join(jump, "near", "left").select("id", "old", F.least("near", "far").alias("component")), "labels")
        changed = new.filter("old <> component").limit(1).count()
        forget(labels)
        labels = new.select("id", "component")
        labels._textloom_path = new._textloom_path
        if not changed:
            forget(both)
            return labels


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    signed = keep(mapped(rows, lambda it: sign(it, size), SIGNED), "signed")

    groups = keep(signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("d0", "d1").agg(F.min("doc_id").alias("rep")), "groups")
    members = signed.select("doc_id", "n", "d0", "d1").join(groups, ["d0", "d1"], "left").select("doc_id", "n", "rep")
    reps = signed.filter("n > 0").join(groups.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id", "d0", "d1"])

    bands = reps.select(F.explode("bands").alias("band"), "doc_id")
    centres = bands.groupBy("band").agg(F.min("doc_id").alias("centre"), F.count("*").alias("members")).filter("members > 1").select("band", "centre")
    shared = keep(bands.join(centres, "band"), "shared")
    free_shuffles(spark)

    wanted = shared.select("doc_id").distinct()
    texts = rows.join(wanted, "doc_id", "left_semi").groupBy("doc_id", F.xxhash64("text").alias("hash")).agg(F.first("text").alias("text"))
    texts = keep(texts.select("doc_id", "text"), "texts")
    free_shuffles(spark)

    facts = signed.filter("n > 0").join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "d0", "d1"])
    facts = keep(facts.select("doc_id", "n", "s0", "s1", "s2"), "facts")

    def could(a: str, b: str):
        """The bounds that every linked pair keeps: lengths, and the sketch up to 1e-9."""
        differ = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))
        small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
        return (100 * small >= percent * large) & (differ <= SKETCH_DIFFER)

    stars = shared.filter("doc_id <> centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct().alias("p")
    stars = stars.join(facts.alias("x"), F.col("p.a") == F.col("x.doc_id")).join(facts.alias("y"), F.col("p.b") == F.col("y.doc_id"))
    stars = keep(stars.filter(could("x", "y")).select("p.a", "p.b").distinct(), "stars")
    links = keep(_confirmed(stars, texts, size, percent), "links")
    found = components(links)

    # buckets that still span components
    placed = shared.select("band", "doc_id").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    placed = keep(placed, "placed")
    parts = placed.groupBy("band", "component").agg(F.count("*").alias("size"))
    split = parts.groupBy("band").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.sum("size").alias("members"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    open_ = keep(placed.join(split, "band"), "open")

    small = open_.filter(F.col("members") <= SMALL).join(facts, "doc_id")
    rest = small.filter("component <> main")
    cross = rest.alias("x").join(small.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.doc_id") < F.col("y.doc_id"))) & could("x", "y"))
    pairs = cross.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    large = open_.filter(F.col("members") > SMALL).select("main", "doc_id", "component").distinct()
    more = keep(_confirmed(pairs, texts, size, percent).unionByName(_in_blocks(large, texts, size, percent)), "links")
    if more.limit(1).count():
        found = components(links.unionByName(more))
    for table in (shared, texts, facts, stars, placed, open_):
        forget(table)
    free_shuffles(spark)

    component = F.when(F.col("doc_id").isNull() | F.col("rep").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
    return members.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


ORACLE = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END)) AS shingles
  FROM split),
-- equal sets are linked: one document stands for them
groups AS (SELECT shingles, min(doc_id) AS a FROM sets WHERE len(shingles) > 0 GROUP BY shingles),
members AS (SELECT a, len(shingles) AS n, unnest(shingles) AS s FROM groups),
common AS (
  SELECT x.a, y.a AS b, x.n AS na, y.n AS nb, count(*) AS c
  FROM members x JOIN members y ON x.s = y.s AND x.a < y.a AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT a, a AS b FROM groups UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a),
components AS (SELECT a, min(b) AS component FROM reached GROUP BY a)
SELECT d.doc_id, len(d.shingles)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id, d.doc_id = coalesce(component, d.doc_id) AS kept
FROM sets d LEFT JOIN groups g ON d.shingles = g.shingles LEFT JOIN components USING (a)
"""


def op2(spark, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"), size=4)
