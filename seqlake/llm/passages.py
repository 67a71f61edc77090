"""Content-selected anchors of word windows.

Every window of ``window`` words is known by the smallest of its k-gram hashes, which depends on the
window alone. Consecutive windows with the same smallest hash form a run; two equal windows always
have the same anchor, so rows that share no anchor with another document need not be compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import mixed, slices, word_hashes, words

WINDOW = 50
GRAM = 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def gram_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` values, put together from runs of powers of two."""
    part, part_size = values, 1
    whole, whole_size = None, 0
    while True:
        factor = np.uint64(pow(_BASE, part_size, 1 << 64))
        if size & part_size:
            if whole is None:
                whole, whole_size = part, part_size
            else:
                count = max(0, len(values) - whole_size - part_size + 1)
                whole = whole[:count] * factor + part[whole_size : whole_size + count]
                whole_size += part_size
        if part_size * 2 > size:
            return mixed(whole)
        count = max(0, len(part) - part_size)
        part = part[:count] * factor + part[part_size : part_size + count]
        part_size *= 2


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while width * 2 <= size:
        values = np.minimum(values[:-width], values[width:]) if len(values) > width else values[:0]
        width *= 2
    rest = size - width
    if not rest:
        return values
    return np.minimum(values[:-rest], values[rest:]) if len(values) > rest else values[:0]


def span_hashes(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each ``values[start : start + size]``, of any sizes."""
    power = np.ones(len(values) + 1, np.uint64)
    power[1:] = np.uint64(_BASE)
    power = np.multiply.accumulate(power)
    back = np.ones(len(values) + 1, np.uint64)
    back[1:] = np.uint64(_INVERSE)
    back = np.multiply.accumulate(back)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:-1], out=sums[1:])
    return mixed((sums[starts + sizes] - sums[starts]) * back[starts] + sizes.astype(np.uint64))


def find_runs(values: np.ndarray, counts: np.ndarray, window: int, gram: int):
    """Row, first window, number of windows and anchor of each run, over texts laid end to end."""
    ends = np.cumsum(counts)
    anchors = sliding_min(gram_hashes(values, gram), window - gram + 1)
    row = np.repeat(np.arange(len(counts)), counts)[: len(anchors)]
    place = np.arange(len(anchors))
    inside = np.flatnonzero(place + window <= ends[row])
    if not len(inside):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    row, anchor = row[inside], anchors[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(inside)))
    return row[first], inside[first], sizes, anchor[first]


RUN_SCHEMA = "doc_id bigint, text_key bigint, anchor bigint, content bigint, start int, windows int"


def anchored_runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per run: its anchor, a hash of all its words, its first word and its number of windows.

    ``docs`` has doc_id, text and text_key. Rows without doc_id or with fewer words have no runs.
    """

    def work(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                flat, counts = words(batch.column("text"))
                values = word_hashes(flat)
                row, first, sizes, anchor = find_runs(values, counts, window, gram)
                content = span_hashes(values, first, sizes + window - 1)
                begins = np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(row)),
                        batch.column("text_key").take(pa.array(row)),
                        pa.array(anchor.view(np.int64)),
                        pa.array(content.view(np.int64)),
                        pa.array((first - begins[row]).astype(np.int32)),
                        pa.array(sizes.astype(np.int32)),
                    ],
                    names=["doc_id", "text_key", "anchor", "content", "start", "windows"],
                )

    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return rows.select("doc_id", "text_key", "text").mapInArrow(work, RUN_SCHEMA)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text, which tells rows of one doc_id apart."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("text_key"),
    )


def merged_spans(starts, sizes) -> list[tuple[int, int]]:
    """Spans (start, end) that overlap or touch, put together."""
    out: list[tuple[int, int]] = []
    for start, size in sorted(zip(starts, sizes)):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], start + size))
        else:
            out.append((start, start + size))
    return out


def list_column(batch: pa.RecordBatch, name: str):
    """Offsets and values of a list column, whatever slice the batch is; null lists are empty."""
    column = batch.column(name)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), pc.list_flatten(column)
