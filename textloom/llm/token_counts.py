"""Token counts: texts encoded in batches balanced by bytes, only lengths returned.

All texts of a slice are cut where tokens provably end, and the library gets the pieces that the worker has
not met before as one batch.

Cases: null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows are counted
each; an empty table gives an empty result; other columns of the input are not read. Long texts are
cut where tokens provably end (a space after a non-space), so no text is truncated.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, mapped, read
from .encoding import PieceCounter, balanced, loaded, tokenizer_path

#: Bytes that one call of the library covers, unless one text is longer.
SLICE_BYTES = 1 << 20


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row, by the sentencepiece model at path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(PieceCounter, path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts: list[int] = []
            for part in balanced(batch.column("n_bytes").to_pylist(), SLICE_BYTES):
                counts += counter.counts(texts[part])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = id_text(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return mapped(rows, run, "doc_id long, n_bytes long, n_tokens long")


def op8(spark, sf_dir: str, limit: int = 4096, model: str = "piece_bpe_32k.model") -> DataFrame:
    counted = count_tokens(read(spark, sf_dir, "documents"), tokenizer_path(model))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
