"""What the operators of this subpackage share: shared work folders, row access, word rules."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space (space, \t \n \v \f \r).
WORD = r"[^\x20\x09-\x0D]+"

#: Texts that Python handles at a time, in characters; bounds a worker's memory whatever the batch.
CHUNK_CHARS = 2_000_000


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None

#: What operators remember in this process between tasks.
_memos: list[dict] = []


def remembered() -> dict:
    """An empty memo that forget_memos() clears."""
    _memos.append({})
    return _memos[-1]


def forget_memos() -> None:
    """Drops what other operators' tasks left in this process; Spark reuses a worker for later stages."""
    for memo in _memos:
        memo.clear()


def give_back() -> None:
    """Returns memory that this worker's allocators hold but nothing uses; else an idle worker keeps its largest batch."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


@cache
def _stand_in(master: str) -> str:
    """One temporary folder of this process, on one machine only."""
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='shelfmark-')}"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for this run under spark.checkpoint.dir, which driver and executors share.

    Where that setting is empty (tests on one machine) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _stand_in(spark.sparkContext.master)
    return f"{base.rstrip('/')}/shelfmark/{name}-{uuid.uuid4().hex}"


def put(df: DataFrame, path: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: the lineage ends there, a lost executor costs nothing."""
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    del df
    release(out.sparkSession)
    return out


#: Seconds between two collections of garbage; small jobs need none of their own.
RELEASE_S = 5.0
_released = 0.0


def release(spark: SparkSession, after: float = RELEASE_S) -> None:
    """Lets go of ended jobs' shuffle files: Spark deletes them once the driver's objects for them are collected."""
    global _released
    if time.monotonic() - _released < after:
        return
    _released = time.monotonic()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of the work folder that no later step reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of put() that nothing reads any more; what is derived from them must have been written."""
    for t in tables:
        discard(t.sparkSession, t.written_to)


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def learns(doc_id: Column, parts: int, held: int) -> Column:
    """True where crc32 of doc_id as text, modulo parts, is not held; a null doc_id never teaches."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts != held, F.lit(False))


def chunks(sizes: list[int], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes sum to about most; a larger row stands alone."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches with their texts, null as empty, of bounded size together."""
    for batch in batches:
        col = batch.column(column)
        sizes = [n or 0 for n in pc.binary_length(col).to_pylist()]
        for a, b in chunks(sizes, most):
            part = batch.slice(a, b - a)
            yield part, [x if x is not None else "" for x in part.column(column).to_pylist()]
        batch = col = part = None
        give_back()


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, most_rows: int, size: str | None = None, most_size: int = 1 << 62) -> Iterator[pa.Table]:
    """Tables of one or more whole groups from batches that are sorted by key.

    Groups are gathered until most_rows rows (or most_size in column size) are exceeded; a group is never cut.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def cut(table: pa.Table) -> Iterator[pa.Table]:
        keys = table.column(key).to_pylist()
        weights = table.column(size).to_pylist() if size else None
        begin = last = 0
        total = 0
        for i in range(1, len(keys) + 1):
            total += weights[i - 1] if weights else 0
            if i == len(keys) or keys[i] != keys[i - 1]:
                if i - begin > most_rows or total > most_size:
                    if last > begin:
                        yield table.slice(begin, last - begin)
                        begin, total = last, sum(weights[last:i]) if weights else 0
                last = i
        yield table.slice(begin)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most_rows:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_pylist()
        end = len(keys)
        while end and keys[end - 1] == keys[-1]:
            end -= 1
        if end:
            yield from cut(table.slice(0, end))
            held = table.slice(end).combine_chunks().to_batches()
            rows = table.num_rows - end
    if held:
        yield from cut(pa.Table.from_batches(held))
    held.clear()
    give_back()
