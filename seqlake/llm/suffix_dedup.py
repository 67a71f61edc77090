"""Repeated passages by a sparse suffix array.

Suffixes are kept only where a minimiser stands: the smallest 20-word hash of some window of 50 words.
They are sorted by that hash and a hash of the words around it, and compared with their neighbours; a
suffix whose first 20 words equal no neighbour's is dropped. The rest is extended to both sides: of every
suffix the windows of 50 words around its minimiser are compared with those of the others, equal ones
side by side, and neighbouring windows are put together into maximal spans. Any two equal windows have
the same minimiser, so every repeated passage of 50 words or more is found, and no other.

Suffixes with equal surroundings (copies) are extended once. Rows of a frequent phrase are spread over
tasks by their surroundings.

Defined cases: null, empty and short texts repeat nothing; a row without doc_id is left out; repeats inside
one document and between rows of one doc_id do not count; rows with one doc_id and different texts are
judged one by one; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import slices, stored, word_hashes, words
from seqlake.llm.neighbours import with_equal_neighbour
from seqlake.llm.passages import WINDOW, anchored_runs, gram_hashes, keyed_texts, list_column, merged_spans

_SPANS = "array<struct<offset:int,windows:int,doc_id:bigint>>"


def _window_hashes(window: int):
    """For each wanted run the hashes of its windows."""

    def work(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                flat, counts = words(batch.column("text"))
                hashes = gram_hashes(word_hashes(flat), window).view(np.int64)
                begins = np.cumsum(counts) - counts
                bounds, runs = list_column(batch, "runs")
                anchor, content, start, size = (runs.field(i) for i in range(4))
                size = size.to_numpy().astype(np.int64)
                at = start.to_numpy() + np.repeat(begins, np.diff(bounds))
                ends = np.cumsum(size)
                places = np.arange(int(size.sum())) + np.repeat(at - (ends - size), size)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [anchor, content, pa.ListArray.from_arrays(offsets, pa.array(hashes[places]))],
                    names=["anchor", "content", "hashes"],
                )

    return work


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key and ``spans`` (start, windows, doc_id of the first occurrence) of repeated windows."""
    runs = stored(anchored_runs(docs, window), "runs")
    members = stored(with_equal_neighbour(runs, ["anchor"], ["content", "doc_id", "text_key", "start"]), "members")
    classes = members.groupBy("anchor", "content").agg(
        F.min(F.struct("doc_id", "text_key", "start", "windows")).alias("one"), F.max("doc_id").alias("high")
    )
    classes = stored(classes, "classes")
    several = classes.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    # All surroundings equal: all windows repeat.
    alone = classes.join(several, "anchor", "left_anti").filter("one.doc_id < high").select(
        "anchor", "content",
        F.array(F.struct(F.lit(0).alias("offset"), F.col("one.windows").alias("windows"), F.col("one.doc_id").alias("doc_id")))
        .cast(_SPANS).alias("spans"),
    )
    mixed = classes.join(several, "anchor")
    wanted = mixed.groupBy("one.doc_id", "one.text_key").agg(
        F.collect_list(F.struct("anchor", "content", "one.start", "one.windows")).alias("runs")
    )
    texts = docs.join(wanted, ["doc_id", "text_key"]).select("text", "runs")
    hashed = texts.mapInArrow(_window_hashes(window), "anchor bigint, content bigint, hashes array<bigint>")
    windows = stored(
        hashed.dropDuplicates(["anchor", "content"]).join(mixed, ["anchor", "content"])
        .select("anchor", "content", F.col("one.doc_id").alias("low"), "high", F.posexplode("hashes").alias("offset", "hash")),
        "windows",
    )
    repeated = windows.groupBy("hash").agg(F.min("low").alias("first"), F.max("high").alias("last")).filter("first < last")
    extended = (
        windows.join(stored(repeated, "repeated"), "hash")
        .groupBy("anchor", "content")
        .agg(F.collect_list(F.struct("offset", F.lit(1).alias("windows"), F.col("first").alias("doc_id"))).cast(_SPANS).alias("spans"))
    )
    found = alone.unionByName(extended)
    return (
        members.join(found, ["anchor", "content"])
        .select("doc_id", "text_key", F.expr("transform(spans, s -> struct(start + s.offset AS start, s.windows, s.doc_id))").alias("spans"))
        .groupBy("doc_id", "text_key")
        .agg(F.flatten(F.collect_set("spans")).alias("spans"))
    )


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents with passages of ``window`` or more words that another document has too.

    doc_id, n_words, n_repeated (words in such passages), n_removed (those whose windows also start in a
    document with a smaller doc_id) and the maximal spans (start, end, first_doc_id), end exclusive.
    """
    texts = keyed_texts(docs)
    found = repeated_windows(texts, window)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first_doc_id", pa.int64())]))
    schema = (
        "doc_id bigint, n_words bigint, n_repeated bigint, n_removed bigint,"
        " spans array<struct<start:int,end:int,first_doc_id:bigint>>"
    )

    def work(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                counts = words(batch.column("text"))[1]
                bounds, spans = list_column(batch, "spans")
                start, size, first = (spans.field(i).to_numpy().astype(np.int64) for i in range(3))
                repeated, removed, out = [], [], []
                for row, doc in enumerate(batch.column("doc_id").to_pylist()):
                    part = slice(bounds[row], bounds[row + 1])
                    begin, length, document = start[part], size[part] + window - 1, first[part]
                    merged = merged_spans(begin.tolist(), length.tolist())
                    earlier = document < doc
                    gone = merged_spans(begin[earlier].tolist(), length[earlier].tolist())
                    repeated.append(sum(b - a for a, b in merged))
                    removed.append(sum(b - a for a, b in gone))
                    least = lambda a, b: int(document[(begin >= a) & (begin < b)].min())  # noqa: B023, E731
                    out.append([dict(start=a, end=b, first_doc_id=least(a, b)) for a, b in merged])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(counts), pa.array(repeated, pa.int64()),
                     pa.array(removed, pa.int64()), pa.array(out, kind)],
                    names=["doc_id", "n_words", "n_repeated", "n_removed", "spans"],
                )

    return texts.join(found, ["doc_id", "text_key"]).select("doc_id", "text", "spans").mapInArrow(work, schema)
