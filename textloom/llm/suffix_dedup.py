"""Duplicate passages by suffix arrays.

Every byte that a string of LENGTH bytes covers, if the same string starts anywhere else, is removed.

Sharding. A window is LENGTH bytes of one text; its anchor is the gram of GRAM bytes in it with the
smallest hash (the leftmost one of equals). Equal windows have equal anchors, so windows are dealt out by
anchor: consecutive windows with one anchor are a segment, a few hundred bytes long. A segment whose
anchor occurs once in the corpus has no copy; of segments that occur twice as they stand, every
window has one. Only segments that share an anchor, but differ, need suffix arrays.

Suffix arrays. A shard holds whole anchors, as many as fit SHARD_BYTES, and refines its suffixes by
Larsson and Sadakane's doubling (in numpy, refining only groups that are still unsorted). Kasai's common prefixes, computed for all segments in step, then mark
windows that agree with a neighbour in LENGTH bytes. The segments of a hot anchor are salted over
several shards; each of these also returns one digest of 128 bits for every distinct window, and the sorted
digests are merged by binary search, which finds windows that only shards together repeat. What the
method leaves out: a segment that recurs unchanged is known by two hashes of 64 bits and needs no suffix array.

Cases: null and empty texts, and texts shorter than LENGTH, lose nothing; matches never cross texts;
overlapping repeats in one text count; rows repeated, or with one id, are texts of their own and so
lose everything that LENGTH allows; null ids are kept apart by row; an empty table gives an empty result;
other columns are not read. A character may lose some of its bytes: the rule is about bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, free_shuffles, join_counted, keep, mapped, read

LENGTH, GRAM = 200, 32
#: Bytes of segments in one suffix array; some 80 bytes of memory go with each.
SHARD_BYTES = 1 << 20
#: Bytes of texts that anchors are sought in at once.
SLICE_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _byte_hashes() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = _byte_hashes()


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Of every gram bytes (a power of two), by doubling."""
    h, n = _BYTES[data], 1
    while n < gram:
        a = h[:-n] * _M1
        a ^= a >> np.uint64(29)
        a += h[n:]
        a *= _M2
        a ^= a >> np.uint64(32)
        h, n = a, 2 * n
    return h


def segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the text, anchors, starts of first windows, windows) for slices of texts.

    A text longer than a slice is cut between windows, which may split a segment but no window.
    """
    lo = 0
    while lo < len(texts):
        part, size = [], 0
        while lo < len(texts) and (not part or size + len(texts[lo]) <= SLICE_BYTES):
            if len(texts[lo]) >= length:
                part.append(lo)
                size += len(texts[lo])
            lo += 1
        if not part:
            continue
        if len(part) == 1:
            text = texts[part[0]]
            for at in range(0, len(text) - length + 1, SLICE_BYTES):
                yield from _segments([part[0]], [text[at : at + SLICE_BYTES + length - 1]], at, length, gram)
        else:
            yield from _segments(part, [texts[i] for i in part], 0, length, gram)


def _segments(numbers: list[int], texts: list[bytes], shift: int, length: int, gram: int) -> Iterator[tuple]:
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    h = gram_hashes(np.frombuffer(b"".join(texts), np.uint8), gram)
    # the hash above, the place below: the smallest, of equals the leftmost
    key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    width, have, least = length - gram + 1, 1, key
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    for k, number in enumerate(numbers):
        start = ends[k] - sizes[k]
        own = place[start : ends[k] - length + 1]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        yield number, h[own[first]].view(np.int64), first + shift, np.diff(np.concatenate([first, [len(own)]]))


SEGMENTS = "row long, anchor long, content long, start int, windows int"


def _anchored(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for b in batches:
        rows, texts = b.column("row").to_numpy(), b.column("text").to_pylist()
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        held = 0
        for number, anchor, start, windows in segments(texts, length):
            text = texts[number]
            content = np.array([digest(text[s : s + w + length - 1]) for s, w in zip(start.tolist(), windows.tolist(), strict=True)], np.uint64).view(np.int64)
            for column, value in zip(out, (np.full(len(start), rows[number]), anchor, content, start.astype(np.int32), windows.astype(np.int32)), strict=True):
                column.append(value)
            held += len(start)
            if held >= 200_000:
                yield _batch(out)
                out, held = [[], [], [], [], []], 0
        if held:
            yield _batch(out)


def _batch(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["row", "anchor", "content", "start", "windows"])


def suffix_ranks(data: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks (int32), sorted by the first depth bytes at least; suffixes end with their segment.

    left: bytes from a place to its segment's end. Doubling refines only groups of equal ranks, and a
    group of one is done. Equals stay in the order of their places.
    """
    n = len(data)
    key = np.minimum(left, 7).astype(np.uint64)
    for i in range(min(7, n)):
        byte = data[i:].astype(np.uint64)
        byte <<= np.uint64(8 * (7 - i))
        byte *= left[: n - i] > i
        key[: n - i] |= byte
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    rank = np.empty(n, np.int32)
    # a group's rank is the place of its first member
    rank[order] = np.maximum.accumulate(np.where(np.concatenate([np.ones(min(n, 1), bool), key[1:] != key[:-1]]), np.arange(n, dtype=np.int32), 0))
    del key
    have = 7
    open_ = np.arange(n, dtype=np.int32)  # places in the array whose groups are not single
    while have < depth:
        group = rank[order[open_]]
        same = group[1:] == group[:-1]
        open_ = open_[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        if not len(open_):
            break
        members = order[open_]
        group = rank[members]
        second = np.where(left[members] > have, rank[np.minimum(members + have, n - 1)] + 1, 0)
        by = np.argsort(group.astype(np.int64) * (n + 1) + second, kind="stable")
        members, group, second = members[by], group[by], second[by]
        order[open_] = members
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        rank[members] = open_[np.maximum.accumulate(np.where(new, np.arange(len(members)), 0))]
        have *= 2
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    return order, place


def common_prefixes(data: np.ndarray, order: np.ndarray, place: np.ndarray, left: np.ndarray, starts: np.ndarray, steps: np.ndarray, cap: int) -> np.ndarray:
    """Kasai's: the length, up to cap, that a suffix shares with the one before it in the array.

    Each segment's suffixes are visited from left to right, all segments in step: what suffix i shares
    is at least what suffix i - 1 shared, less one. Only the first steps suffixes of a segment are visited.
    """
    lcp = np.zeros(len(data), np.int32)  # by place in the array
    held = np.zeros(len(starts), np.int32)
    longest = np.argsort(-steps, kind="stable")
    counts = np.searchsorted(-steps[longest], -np.arange(int(steps.max(initial=0))), "left")
    for t, n in enumerate(counts.tolist()):
        live = longest[:n]
        i = starts[live] + t
        at = place[i]
        j = order[np.maximum(at - 1, 0)]
        most = np.where(at > 0, np.minimum(np.minimum(left[i], left[j]), cap), 0)
        length = np.minimum(held[live], most)
        going = np.flatnonzero(length < most)
        while len(going):
            a, b, k = i[going], j[going], length[going]
            equal = data[a + k] == data[b + k]
            going = going[equal]
            length[going] += 1
            going = going[length[going] < most[going]]
        lcp[at] = length
        held[live] = np.maximum(length - 1, 0)
    return lcp


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Of each segment, whether the window at each of its places starts elsewhere in the parts too."""
    sizes = np.array([len(p) for p in parts], np.int32)
    ends = np.cumsum(sizes, dtype=np.int32)
    starts = ends - sizes
    data = np.frombuffer(b"".join(parts), np.uint8)
    left = np.repeat(ends, sizes) - np.arange(len(data), dtype=np.int32)
    # to the full depth: what a suffix shares bounds what the next one shares only in a finished order
    order, place = suffix_ranks(data, left, int(sizes.max(initial=0)))
    windows = np.maximum(sizes - length + 1, 0)
    # a window's other half may lie before or after it: the one after it has it as predecessor
    lcp = common_prefixes(data, order, place, left, starts, windows, length)
    hit = np.zeros(len(data), bool)
    found = np.flatnonzero(lcp >= length)
    hit[order[found]] = True
    hit[order[found - 1]] = True
    return [hit[s : s + w] for s, w in zip(starts.tolist(), windows.tolist(), strict=True)]


def window_digests(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """(windows, 2) uint64: a digest of the length bytes from each place on, from two seeds."""
    out = np.empty((max(0, len(data) - length + 1), 2), np.uint64)
    for seed in (0, 1):
        total = np.full(len(out), length, np.uint64)
        h, size = (_BYTES + np.uint64(seed)) * _M1 if seed else _BYTES, 1
        h, at = h[data], 0
        while size <= length:
            if length & size:  # the window's next size bytes
                total += h[at : at + len(out)]
                total *= _M2
                total ^= total >> np.uint64(29 + seed)
                at += size
            if 2 * size <= length:
                a = h[:-size] * _M1
                a ^= a >> np.uint64(29)
                a += h[size:]
                a *= _M2
                a ^= a >> np.uint64(32)
                h = a
            size *= 2
        out[:, seed] = total
    return out


SHARDED = "anchor long, content long, first int, n int, run binary"
#: An entry of a run of distinct windows, and the bytes of entries that one task merges at a time.
ENTRY, MERGE_BYTES = np.dtype([("high", "<u8"), ("low", "<u8"), ("anchor", "<i8"), ("content", "<i8"), ("first", "<i4")]), 4 << 20


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def _suffix_shards(batches: Iterator[pa.RecordBatch], length: int, shard_bytes: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of sorted segments; of hot anchors also the distinct windows by digest.

    The latter are sorted runs of entries (n = 0), one for each range of digests (first: its number).
    """
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    rows: list[tuple] = []
    group: list[tuple] = []  # the anchor, or the salted part of a hot one, that is still arriving
    sizes = {"rows": 0, "group": 0}

    def solve() -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (anchor, content, *_), flags in zip(rows, repeated_windows([r[4] for r in rows], length), strict=True):
            out += [(anchor, content, s, n, None) for s, n in zip(*(x.tolist() for x in _spans(flags)), strict=True)]
        if hot := [r for r in rows if r[2]]:
            run = _run(hot, length)
            cuts = np.searchsorted(run["high"], _bounds(ranges), "left").tolist()
            out += [(None, None, k, 0, run[i:j].tobytes()) for k, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(run)], strict=True)) if j > i]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["anchor", "content", "first", "n", "run"])

    def settle() -> Iterator[pa.RecordBatch]:
        """The complete group joins the shard, a new one if it doesn't fit."""
        nonlocal rows, group
        if rows and sizes["rows"] + sizes["group"] > shard_bytes:
            yield from solve()
            rows, sizes["rows"] = [], 0
        rows += group
        sizes["rows"] += sizes["group"]
        group, sizes["group"] = [], 0

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("anchor", "content", "hot", "salt", "segment")), strict=True):
            if group and (row[0], row[3]) != (group[0][0], group[0][3]):
                yield from settle()
            group.append(row)
            sizes["group"] += len(row[4])
    yield from settle()
    if rows:
        yield from solve()


def _bounds(ranges: int) -> np.ndarray:
    """Where ranges of the digests' high halves begin, but for the first."""
    return np.array([k * (1 << 64) // ranges for k in range(1, ranges)], np.uint64)


def _run(segments: list[tuple], length: int) -> np.ndarray:
    """The distinct windows of segments, sorted by digest."""
    long = np.array([len(r[4]) for r in segments])
    counts = np.maximum(long - length + 1, 0)
    owners = np.repeat(np.arange(len(segments)), counts)
    places = np.arange(len(owners)) - np.repeat(np.cumsum(counts) - counts, counts)
    digests = window_digests(np.frombuffer(b"".join(r[4] for r in segments), np.uint8), length)[(np.cumsum(long) - long)[owners] + places]
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    digests = digests[order]
    new = np.concatenate([np.ones(min(1, len(order)), bool), (digests[1:] != digests[:-1]).any(axis=1)])
    order, out = order[new], np.empty(int(new.sum()), ENTRY)
    out["high"], out["low"], out["first"] = digests[new, 0], digests[new, 1], places[order]
    for k, name in enumerate(("anchor", "content")):
        out[name] = np.array([r[k] for r in segments], np.int64)[owners[order]]
    return out


def _merge_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by range: entries whose digest binary search finds in several."""
    held: list[bytes] = []
    last = None

    def merge() -> Iterator[pa.RecordBatch]:
        entries = np.frombuffer(b"".join(held), ENTRY)
        entries = entries[np.lexsort((entries["low"], entries["high"]))]
        high, low = np.ascontiguousarray(entries["high"]), entries["low"]
        first, end = np.searchsorted(high, high, "left"), np.searchsorted(high, high, "right")
        twice = np.zeros(len(high), bool)
        for i in np.flatnonzero(end - first > 1).tolist():
            part = low[first[i] : end[i]]
            twice[i] = np.searchsorted(part, low[i], "right") - np.searchsorted(part, low[i], "left") > 1
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(entries[name][twice])) for name in ("anchor", "content", "first")], ["anchor", "content", "first"])

    for b in batches:
        for number, run in zip(b.column("first").to_pylist(), b.column("run").to_pylist(), strict=True):
            if held and number != last:
                yield from merge()
                held = []
            held.append(run)
            last = number
    if held:
        yield from merge()


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of segments (starts and windows as arrays beside the text)."""
    for b in batches:
        out: list[tuple] = []
        for text, wanted in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist(), strict=True):
            for w in wanted:
                out.append((w["anchor"], w["content"], w["parts"], text[w["start"] : w["start"] + w["windows"] + length - 1]))
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["anchor", "content", "parts", "segment"])


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removal(text: bytes, starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[int, int, bytes]:
    """(bytes removed, spans, what remains), windows given as runs."""
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + counts + length - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    at, n = _spans(gone)
    return int(n.sum()), len(at), np.frombuffer(text, np.uint8)[~gone].tobytes()


def _removed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in REMOVED.split(", ")]
    for b in batches:
        out = []
        for doc_id, text, runs in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
            n, spans, rest = 0, 0, text
            if runs:
                pairs = np.array([(r["at"], r["n"]) for r in runs], np.int64)
                n, spans, rest = removal(text, pairs[:, 0], pairs[:, 1], length)
            out.append((doc_id, len(text), n, spans, hashlib.sha256(rest).hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "kept_sha256" else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)], names)


def repeated_runs(rows: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(row, at, n): runs of n repeated windows, of rows (row long, unique; text binary)."""
    spark = rows.sparkSession
    found = keep(mapped(rows.select("row", "text"), lambda it: _anchored(it, length), SEGMENTS), "segments")
    often = keep(found.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1"), "often")
    shared = keep(join_counted(found, often, ["anchor"], F.col("c")).drop("c"), "shared")
    free_shuffles(spark)
    forget(found)
    forget(often)

    distinct = shared.groupBy("anchor", "content").agg(F.count("*").alias("c"), F.min(F.struct("row", "start", "windows")).alias("one"))
    distinct = keep(distinct.select("anchor", "content", "c", "one.*"), "distinct")
    # anchors with several contents, some of which occur once
    unsure = distinct.groupBy("anchor").agg(F.count("*").alias("contents"), F.min("c").alias("least"), F.sum(F.col("windows").cast("long") + length).alias("size")).filter("contents > 1 AND least = 1")
    unsure = keep(unsure.select("anchor", "contents", F.ceil(F.col("size") / shard_bytes).cast("int").alias("parts")), "unsure")
    wanted = join_counted(distinct, unsure, ["anchor"], F.col("contents")).groupBy("row").agg(F.collect_list(F.struct("anchor", "content", "start", "windows", "parts")).alias("wanted"))
    cut = keep(mapped(rows.select("row", "text").join(wanted, "row").select("text", "wanted"), lambda it: _cut(it, length), "anchor long, content long, parts int, segment binary"), "cut")
    free_shuffles(spark)

    hot_parts = unsure.filter("parts > 1").agg(F.sum(F.col("parts").cast("long"))).first()[0] or 0
    ranges = max(16, -(-hot_parts * shard_bytes * ENTRY.itemsize // MERGE_BYTES))
    salted = cut.select("anchor", "content", (F.col("parts") > 1).alias("hot"), F.pmod(F.col("content"), F.col("parts")).cast("int").alias("salt"), "segment")
    salted = salted.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "content")
    sharded = keep(mapped(salted, lambda it: _suffix_shards(it, length, shard_bytes, ranges), SHARDED), "sharded")
    merged = mapped(sharded.filter("n = 0").select("first", "run").repartition("first").sortWithinPartitions("first"), _merge_shards, "anchor long, content long, first int").withColumn("n", F.lit(1))
    some = sharded.filter("n > 0").select("anchor", "content", "first", "n").unionByName(merged)
    # a content that recurs is a run wherever it stands; one that occurs once has its place in distinct
    recurring = join_counted(shared.select("row", "anchor", "content", "start"), distinct.filter("c > 1").select("anchor", "content", "c", F.col("windows").alias("n")), ["anchor", "content"], F.col("c"))
    single = some.join(distinct.filter("c = 1").select("anchor", "content", "row", "start"), ["anchor", "content"])
    out = keep(recurring.select("row", F.col("start").alias("at"), "n").unionByName(single.select("row", (F.col("start") + F.col("first")).alias("at"), "n")), "places")
    free_shuffles(spark)
    for table in (shared, distinct, unsure, cut, sharded):
        forget(table)
    return out


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, text (bytes). A row's number follows from its id where ids are unique."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    again = rows.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1 OR doc_id IS NULL").limit(1).count()
    if not again:
        return rows.withColumn("row", F.col("doc_id"))
    # repeated or missing ids: number the rows once, in a table that later steps read
    return keep(rows.withColumn("row", F.monotonically_increasing_id()), "rows")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = numbered(docs, id_col, text_col)
    runs = repeated_runs(rows, length, shard_bytes).groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    return mapped(rows.join(runs, "row", "left").select("doc_id", "text", "runs"), lambda it: _removed(it, length), REMOVED)


ORACLE = r"""
WITH bytes AS (
  SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
starts AS (SELECT row, unnest(range(n - 199)) AS p, h FROM bytes WHERE n >= 200),
windows AS (SELECT row, p, md5_number(substr(h, 2 * p + 1, 400)) AS w FROM starts),
repeated AS (SELECT row, p FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)),
marked AS (SELECT row, p, coalesce(p > lag(p) OVER (PARTITION BY row ORDER BY p) + 200, true) AS fresh FROM repeated),
numbered AS (SELECT row, p, sum(fresh::INT) OVER (PARTITION BY row ORDER BY p) AS span FROM marked),
spans AS (SELECT row, span, min(p) AS a, max(p) + 200 AS b FROM numbered GROUP BY row, span),
-- what stays: before each span, and after the last
gaps AS (
  SELECT row, coalesce(lag(b) OVER (PARTITION BY row ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL SELECT row, max(b), NULL FROM spans GROUP BY row),
kept AS (SELECT row, string_agg(substr(h, (2 * a + 1)::BIGINT, (2 * (coalesce(gaps.b, n) - a))::BIGINT), '' ORDER BY a) AS h FROM gaps JOIN bytes USING (row) GROUP BY row),
sums AS (SELECT row, sum(b - a) AS removed, count(*) AS spans FROM spans GROUP BY row)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept.h, bytes.h))) AS kept_sha256
FROM bytes LEFT JOIN sums USING (row) LEFT JOIN kept USING (row)
"""


def op3(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))
