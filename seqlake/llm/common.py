"""What several operators share: table access, scratch tables, bounded slices of a batch, words."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from seqlake.session import scratch_path, spread

# A Python task works on so many bytes of text at a time (a longer text alone).
SLICE_BYTES = 2 << 20


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; one of few row groups is dealt out, as the work per row is heavy."""
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: worked out once, and safe from lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Inside, what a job shuffled is deleted once the job has written its table, as nothing reads it again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(
    batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES, rows: int | None = None
) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``most`` bytes in ``column`` and ``rows`` rows, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        stop = stop if rows is None else min(stop, start + rows)
        yield batch.slice(start, stop - start)
        start = stop


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All runs of characters other than 0x20 and 0x09-0x0D, text after text, and their number per text.

    A null text has none.
    """
    if len(texts) == 0:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    counts = np.add.reduceat(full.to_numpy(zero_copy_only=False).astype(np.int64), starts)
    return flat.filter(full), counts


def word_hashes(flat: pa.Array) -> np.ndarray:
    """XXH64 of each word; equal words are hashed once."""
    coded = flat.dictionary_encode()
    values = coded.dictionary.to_pylist()
    table = np.fromiter((xxhash.xxh64_intdigest(word) for word in values), np.uint64, len(values))
    return table[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else table


def mixed(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, so that their order says nothing about the text."""
    out = values.astype(np.uint64)
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))
