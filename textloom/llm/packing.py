"""Packing by vector bin packing.

Every example takes tokens, one segment and some loss-bearing tokens; a sequence has a limit on each.
An open sequence takes the example whose demand has the largest dot product with what the sequence
has left (each limit scaled to 1), as long as one fits; where examples may be cut, the gap that then
remains is closed with the head of another example, whose rest goes back into the pool. Each
partition packs its own rows from a bounded pool, so there is no shuffle and memory does not follow
the data. What is left at a partition's end is cut at powers of two, which need no padding.

Cases: null and empty texts count as empty (one piece with the end id alone); a null id stays null;
repeated rows are packed each; ties go to the example that came first; an empty table gives no
pieces; other columns are not read. A text of any length is cut into full sequences first.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, mapped, read
from .encoding import WordBpe, loaded, tokenizer_path

#: Examples that wait for a place at once in one task.
POOL = 256

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Packer:
    """Places examples (key, start, length, loss flags or None for all) under the three limits.

    place() gives lists of (key, start, length, loss, sequence, offset), the pieces of finished
    sequences. cut: examples may be cut anywhere; else each is placed whole, and one beyond a limit
    raises ValueError.
    """

    def __init__(self, tokens: int = 2048, segments: int = 256, loss: int | None = None, pool: int = POOL, cut: bool = True):
        self.limits = np.array([tokens, segments, loss or tokens], float)
        self.tokens, self.segments, self.loss = tokens, segments, loss or tokens
        self.pool, self.cut = pool, cut
        self.need = np.zeros((0, 3))
        self.items: list[tuple] = []
        self.sequence = 0

    def _loss(self, flags: np.ndarray | None, start: int, length: int) -> int:
        return length if flags is None else int(flags[start : start + length].sum())

    def _fitting(self, flags: np.ndarray | None, start: int, length: int, loss: int) -> int:
        """The longest head within length tokens and that many loss-bearing ones."""
        if flags is None:
            return min(length, loss)
        over = np.flatnonzero(np.cumsum(flags[start : start + length]) > loss)
        return int(over[0]) if len(over) else length

    def add(self, key, start: int, length: int, flags: np.ndarray | None = None) -> list[tuple]:
        out: list[tuple] = []
        if self.cut:
            while length >= self.tokens and self._loss(flags, start, self.tokens) <= self.loss:
                out.append((key, start, self.tokens, self._loss(flags, start, self.tokens), self.sequence, 0))
                self.sequence += 1
                start, length = start + self.tokens, length - self.tokens
        elif length > self.tokens or self._loss(flags, start, length) > self.loss:
            raise ValueError(f"example {key!r} alone exceeds a limit")
        if length:
            self._push(key, start, length, flags)
        while len(self.items) >= self.pool:
            out += self._fill()
        return out

    def finish(self) -> list[tuple]:
        out: list[tuple] = []
        while self.items:
            out += self._fill(last=True)
        return out

    def _push(self, key, start: int, length: int, flags: np.ndarray | None) -> None:
        self.items.append((key, start, length, flags))
        self.need = np.vstack([self.need, np.array([[length, 1, self._loss(flags, start, length)]]) / self.limits])

    def _pop(self, i: int) -> tuple:
        self.need = np.delete(self.need, i, axis=0)
        return self.items.pop(i)

    def _fill(self, last: bool = False) -> list[tuple]:
        left, placed = np.ones(3), []
        used = loss = 0
        while self.items and len(placed) < self.segments:
            fits = (self.need <= left + 1e-9).all(axis=1)
            if not fits.any():
                break
            i = int(np.argmax(np.where(fits, self.need @ left, -1.0)))
            left = left - self.need[i]
            key, start, length, flags = self._pop(i)
            placed.append((key, start, length, self._loss(flags, start, length), flags))
            used, loss = used + length, loss + placed[-1][3]
        if self.cut and self.items and used < self.tokens and len(placed) < self.segments:
            i = int(np.argmax(self.need[:, 0]))
            key, start, length, flags = self.items[i]
            n = self._fitting(flags, start, min(length, self.tokens - used), self.loss - loss)
            if n or not placed:
                self._pop(i)
                n = n or length
                placed.append((key, start, n, self._loss(flags, start, n), flags))
                used += n
                if n < length:
                    self._push(key, start + n, length - n, flags)
        if self.cut and last and not self.items and used & (used - 1):
            return self._powers(placed, used)
        out, at = [], 0
        for key, start, length, n_loss, _ in placed:
            out.append((key, start, length, n_loss, self.sequence, at))
            at += length
        self.sequence += 1
        return out

    def _powers(self, placed: list[tuple], used: int) -> list[tuple]:
        """The last, partly filled sequence as sequences of powers of two."""
        out, room, at = [], 1 << (used.bit_length() - 1), 0
        for key, start, length, _, flags in placed:
            while length:
                n = min(length, room - at)
                out.append((key, start, n, self._loss(flags, start, n), self.sequence, at))
                start, length, at, used = start + n, length - n, at + n, used - n
                if at == room:
                    self.sequence += 1
                    at, room = 0, 1 << max(0, used.bit_length() - 1)
        return out


def pack(rows: DataFrame, encode: Callable[[], Callable[[str], tuple[bytes, np.ndarray | None]]], max_tokens: int = 2048, max_segments: int = 256, max_loss: int | None = None, cut: bool = True, with_ids: bool = False) -> DataFrame:
    """Packs rows (doc_id long, text string).

    encode() runs once per task and gives a function from a text to its ids (little-endian uint32
    bytes) and its loss flags per token (None: all bear loss).
    """
    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
    schema = PIECES + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        to_ids = encode()
        packer = Packer(max_tokens, max_segments, max_loss, cut=cut)
        waiting: dict[int, list] = {}  # number of a text -> id, ids, tokens still to be placed
        number = 0

        def table(pieces: list[tuple]) -> pa.RecordBatch:
            rows: list[list] = [[] for _ in names]
            for key, start, length, loss, sequence, offset in pieces:
                held = waiting[key]
                part = held[1][4 * start : 4 * (start + length)]
                values = [held[0], start, length, zlib.crc32(part), len(held[1]) // 4, base + sequence, offset, loss] + [part] * with_ids
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
                held[2] -= length
                if not held[2]:
                    del waiting[key]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, rows, strict=True)], names)

        for batch in batches:
            done: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids, flags = to_ids(text)
                waiting[number] = [doc_id, ids, len(ids) // 4]
                if ids:
                    done += packer.add(number, 0, len(ids) // 4, flags)
                else:
                    del waiting[number]
                number += 1
            if done:
                yield table(done)
        if rest := packer.finish():
            yield table(rest)

    return mapped(rows, run, schema)


def document_encoder(path: str, end_id: int = 1) -> Callable[[], Callable[[str], tuple[bytes, None]]]:
    end = np.array([end_id], "<u4").tobytes()

    def start():
        encoder = loaded(WordBpe, path)
        return lambda text: (encoder.ids(text) + end, None)

    return start


def pack_documents(docs: DataFrame, path: str, max_tokens: int = 2048, max_segments: int = 256, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Plain documents: every token bears loss, documents are cut freely."""
    return pack(id_text(docs, id_col, text_col), document_encoder(path), max_tokens, max_segments, with_ids=with_ids)


def pack_conversations(turns: DataFrame, path: str, max_tokens: int = 2048, max_segments: int = 64, max_loss: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """Instruction data (conv_id, turn, role, text): a conversation is one example, only loss_role's turns bear loss."""
    sep, mark = "\x1e", "\x1f"
    clean = F.translate(F.coalesce("text", F.lit("")), sep + mark, "  ")
    tagged = turns.select(F.col("conv_id").cast("long").alias("doc_id"), F.struct(F.col("turn").alias("turn"), F.concat(F.when(F.col("role") == loss_role, "1").otherwise("0"), F.lit(mark), clean).alias("part")).alias("one"))
    # a conversation's turns belong together by definition; its size is that of one example
    rows = tagged.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("one")), lambda x: x["part"]), sep).alias("text"))

    def encoder():
        documents = document_encoder(path)()

        def ids(text: str) -> tuple[bytes, np.ndarray]:
            parts, flags = [], []
            for part in text.split(sep):
                found, _ = documents(part[2:])
                parts.append(found)
                flags.append(np.full(len(found) // 4, part[:1] == "1"))
            return b"".join(parts), np.concatenate(flags)

        return ids

    return pack(rows, encoder, max_tokens, max_segments, max_loss)


def op1(spark, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_path(tokenizer))
