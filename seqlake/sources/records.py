"""Record files in mixed encodings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Bytes of a batch that become Python values at a time.
SLICE_BYTES = 1 << 20


def in_slices(function: Callable[[Any], Any], column: pa.Array, kind: pa.DataType) -> Iterator[pa.Array]:
    """The function of every value that is not null, of a few rows at a time: a batch is never held in Python as a whole."""
    step = max(1, len(column) * SLICE_BYTES // max(1, column.nbytes))
    for start in range(0, len(column), step):
        yield pa.array([None if value is None else function(value) for value in column.slice(start, step).to_pylist()], kind)


@F.arrow_udf(T.StringType())
def _decode_cp932(contents: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for content in contents:
        yield from in_slices(lambda raw: raw.decode("cp932", errors="replace"), content, pa.string())


def decode_text(content: Column | str) -> Column:
    """Text of the bytes: UTF-8, else CP932 with undecodable bytes replaced; line ends are ``\\n``.

    Only content that is not UTF-8 reaches Python.
    """
    content = F.col(content) if isinstance(content, str) else content
    as_text = content.cast("string")
    is_utf8 = F.is_valid_utf8(as_text)
    text = F.coalesce(F.when(is_utf8, as_text), _decode_cp932(F.when(~is_utf8, content)))
    return F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "\r\n?", "\n")


def read_text_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path, text`` of each file."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", decode_text("content").alias("text"))
