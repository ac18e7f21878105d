"""What the operators of this subpackage share: table access, tables kept in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch that an Arrow function gets at once, unless one row is longer.
BATCH_BYTES = 8 << 20
#: A key is hot with more than this share of all rows: there are at most HOT_SHARE such keys.
HOT_SHARE = 2000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text (null: empty): columns of other names can't clash with ours."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = made.get() if made.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows as a table in the shared folder, which outlives any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._textloom_path = path
    return kept


def forget(df: DataFrame) -> None:
    """Deletes a table of keep() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._textloom_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished jobs before the next large one."""
    gc.collect()
    spark._jvm.System.gc()


def crc_mod(column, n: int):
    """crc32 of the id as text, modulo n; null ids count as remainder 0."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % n, F.lit(0))


def _small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if batch.num_rows > 1 and batch.nbytes > BATCH_BYTES:
        half = batch.num_rows // 2
        yield from _small(batch.slice(0, half))
        yield from _small(batch.slice(half))
    else:
        yield batch


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over batches of bounded bytes; a task returns its free memory when it ends."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(part for b in batches for part in _small(b))
        finally:
            release()

    return df.mapInArrow(bounded, schema)


def release() -> None:
    """Gives memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library: it has its own policy


_resident: dict = {}


def resident(key, make: Callable):
    """What a worker process keeps between tasks, such as a cache: one thing only, so a stage's goes when another's comes."""
    if key not in _resident:
        _resident.clear()
        release()
        _resident[key] = make()
    return _resident[key]


def join_counted(rows: DataFrame, groups: DataFrame, on: list[str], counts: Column) -> DataFrame:
    """Inner join of rows with groups (one row for each key of rows; counts: its number of rows), hot keys apart.

    Keys with more than 1 / HOT_SHARE of all rows are at most HOT_SHARE: their groups are broadcast, so their
    rows stay where they are. groups must be cheap to read again, and its rows of bounded size.
    """
    total = groups.agg(F.sum(counts)).first()[0] or 0
    least = F.lit(max(total // HOT_SHARE, 1000))
    hot = F.broadcast(groups.filter(counts > least))
    return rows.join(hot, on).unionByName(rows.join(F.broadcast(groups.filter(counts > least).select(on)), on, "left_anti").join(groups.filter(counts <= least), on))
