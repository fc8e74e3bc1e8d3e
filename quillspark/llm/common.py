"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.stored import read_table, stored

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python task takes out of an Arrow batch at a time (one text may be longer), and rows of such a batch.
AT_ONCE, TEXT_ROWS = 1 << 20, 500
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """Actions inside send texts to Python tasks in batches of few rows; the session's own number is back afterwards."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def durable(df: DataFrame, *, texts: bool = False) -> DataFrame:
    """df, kept as a table in the shared folder; with ``texts`` its Python tasks get whole texts, so batches are small."""
    if not texts:
        return stored(df)
    with small_batches(df.sparkSession):
        return stored(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], text: str, at_once: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about at_once bytes of the column ``text``, so that a task's memory doesn't depend on the session's batch size."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        part = np.cumsum(sizes) // at_once
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()  # a worker lives on between stages: what it doesn't hold goes back


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte plane by byte plane, compressed."""
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def expand(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    """The arrays of squeeze, of n elements each."""
    planes, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8), [], 0
    for kind in map(np.dtype, kinds):
        size = n * kind.itemsize
        out.append(np.ascontiguousarray(planes[at : at + size].reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += size
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def id_crc(column: str | Column, modulus: int) -> Column:
    """crc32 of an id as text, modulo; a null id counts as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % modulus


def word_count(column: Column) -> Column:
    """Number of words; null counts as no text."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def sampled(rows: int, wanted: int, seed: int, *by: str) -> Column:
    """True for about ``wanted`` of ``rows`` rows, by a hash of the columns ``by``; for all of them where there are no more. 62 bits
    of the hash are used and the share is rounded up, so that it doesn't become zero however many rows there are."""
    if rows <= wanted:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 62)) < -(-wanted * (1 << 62) // rows)


def small(spark: SparkSession, rows: list, schema: str, most: int = 100_000) -> DataFrame:
    """A table of rows that the driver holds; it is broadcast in joins as long as it has no more than ``most`` rows."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= most else df


def counted(df: DataFrame, most: int) -> DataFrame:
    """df, kept as a table; it is broadcast in joins if it turns out to have no more than ``most`` rows, else joined by a shuffle."""
    held = durable(df)
    return F.broadcast(held) if held.count() <= most else held


def without(docs: DataFrame, keys: DataFrame, on: str, most: int = 1_000_000) -> DataFrame:
    """docs without the rows whose ``on`` is in keys (one column of that name, no nulls). Up to ``most`` keys, which
    are counted first, are broadcast, so that texts needn't move; more are joined by a shuffle."""
    return docs.join(counted(keys.distinct(), most), on, "left_anti")
