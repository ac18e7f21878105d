"""Exact deduplication by Grace hashing.

Texts are equal when they are identical without the six ASCII white-space characters. Each input
partition first folds its own copies; one content per text and partition is then dealt out by its
digest, so a text with a third of all rows sends one row per partition. Each task partitions what it
receives further, by other bits of the digest and into spill files, until a bucket fits an
open-addressing table that compares complete contents. Spill files are scratch of one task attempt:
they go with it, and an attempt elsewhere writes its own.

Cases: null counts as empty, and all empty texts are one group; of equal texts the row with the most
code points in the original stays, then the smallest id (null ids last); rows repeated with the same
id all carry that id as keep_id and only kept tells equal rows apart by id, so they are all kept;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, mapped, read

SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of contents that one table may hold; beyond it a bucket is split into FAN spill files.
TABLE_BYTES = 48 << 20
FAN = 16


class OpenTable:
    """Open addressing with linear probing; slots hold entries, entries compare by complete content."""

    def __init__(self):
        self.slots: list[int] = [-1] * 64
        self.entries: list[list] = []
        self.bytes = 0

    def entry(self, digest: bytes, content: bytes) -> tuple[list, bool]:
        """The entry of this content (digest, content, data) and whether it is new."""
        if 2 * len(self.entries) >= len(self.slots):
            self._grow()
        at = self._probe(digest, content)
        if self.slots[at] >= 0:
            return self.entries[self.slots[at]], False
        self.slots[at] = len(self.entries)
        self.entries.append([digest, content, None])
        self.bytes += len(content) + 200
        return self.entries[-1], True

    def _probe(self, digest: bytes, content: bytes | None) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[:8], "little") & mask
        while (i := self.slots[at]) >= 0 and (content is None or self.entries[i][1] != content):
            at = (at + 1) & mask
        return at

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        for i, (digest, _, _) in enumerate(self.entries):
            self.slots[self._probe(digest, None)] = i


def normalised(text: bytes) -> bytes:
    return text.translate(None, SPACE)


def _better(a: tuple, b: tuple) -> tuple:
    """Of (code points, id): the more code points, then the smaller id, null last."""
    return min(a, b, key=lambda x: (-x[0], x[1] is None, x[1] or 0))


def _rows(entries: list[list]) -> pa.RecordBatch:
    """(digest, content, n, chars, doc_id) of folded entries."""
    data = [e[2] for e in entries]
    return pa.RecordBatch.from_arrays(
        [pa.array([e[0] for e in entries], pa.binary()), pa.array([e[1] for e in entries], pa.binary()), pa.array([d[0] for d in data], pa.int64()), pa.array([d[1][0] for d in data], pa.int64()), pa.array([d[1][1] for d in data], pa.int64())],
        ["digest", "content", "n", "chars", "doc_id"],
    )


FOLDED = "digest binary, content binary, n long, chars long, doc_id long"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: folds copies within the partition, as far as a table of TABLE_BYTES reaches."""
    table = OpenTable()
    for batch in batches:
        for doc_id, chars, text in zip(batch.column("doc_id").to_pylist(), batch.column("chars").to_pylist(), batch.column("text").to_pylist(), strict=True):
            content = normalised(text)
            entry, new = table.entry(hashlib.sha256(content).digest(), content)
            entry[2] = (1, (chars, doc_id)) if new else (entry[2][0] + 1, _better(entry[2][1], (chars, doc_id)))
            if table.bytes >= TABLE_BYTES:
                yield _rows(table.entries)
                table = OpenTable()
    if table.entries:
        yield _rows(table.entries)


GROUPS = "digest binary, keep_id long, group_size long"


def grace(batches: Iterator[pa.RecordBatch], scratch: Path, level: int = 0, table_bytes: int = TABLE_BYTES) -> Iterator[list[list]]:
    """Entries of each bucket of (digest, content, n, chars, doc_id) rows, equal contents folded."""
    table, held = OpenTable(), None

    def put(table: OpenTable, row: tuple) -> None:
        digest, content, n, chars, doc_id = row
        entry, new = table.entry(digest, content)
        entry[2] = (n, (chars, doc_id)) if new else (entry[2][0] + n, _better(entry[2][1], (chars, doc_id)))

    def bucket(digest: bytes) -> int:
        return digest[8 + level] % FAN  # other bits than the exchange and the table use

    schema = _rows([]).schema
    for batch in batches:
        if held is None:
            for row in zip(*(batch.column(c).to_pylist() for c in ("digest", "content", "n", "chars", "doc_id")), strict=True):
                put(table, row)
            if table.bytes >= table_bytes and len(table.entries) > 1 and level < 16:
                held = [pa.OSFile(str(scratch / f"{level}-{i}"), "wb") for i in range(FAN)]
                writers = [pa.ipc.new_stream(f, schema) for f in held]
                _spill(_rows(table.entries), writers, bucket)
                table = OpenTable()
        else:
            _spill(batch, writers, bucket)
    if held is None:
        if table.entries:
            yield table.entries
        return
    for w, f in zip(writers, held, strict=True):
        w.close()
        f.close()
    for i in range(FAN):
        path = scratch / f"{level}-{i}"
        below = scratch / f"{level}-{i}-"
        below.mkdir()
        with pa.OSFile(str(path), "rb") as f:
            yield from grace(iter(pa.ipc.open_stream(f)), below, level + 1, table_bytes)
        path.unlink()


def _spill(batch: pa.RecordBatch, writers: list, bucket) -> None:
    dealt = [bucket(d) for d in batch.column("digest").to_pylist()]
    for i in set(dealt):
        writers[i].write_batch(batch.take(pa.array([k for k, b in enumerate(dealt) if b == i], pa.int64())))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        for entries in grace(batches, Path(folder)):
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in entries], pa.binary()), pa.array([e[2][1][1] for e in entries], pa.int64()), pa.array([e[2][0] for e in entries], pa.int64())], ["digest", "keep_id", "group_size"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = id_text(docs, id_col, text_col).select("doc_id", F.char_length("text").cast("long").alias("chars"), F.col("text").cast("binary").alias("text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashlib.sha256(normalised(t)).digest() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "digest"])

    groups = mapped(mapped(rows, _fold, FOLDED).repartition("digest"), _groups, GROUPS)
    # a hot digest's documents are split by the adaptive skew join
    return (
        mapped(rows.select("doc_id", "text"), digests, "doc_id long, digest binary")
        .join(groups, "digest")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    )


def op5(spark, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY length(text) DESC, doc_id) AS keep_id FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
