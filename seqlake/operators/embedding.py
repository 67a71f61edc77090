"""Texts to vectors."""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.feature import IDF, HashingTF, IDFModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.functions.text import tokens

BATCH_ROWS = 32
# Texts that are sorted by length together, and rows whose terms are counted together.
BUFFER_BYTES = 8 << 20
COUNTED_ROWS = 512
_WORKER_STATE = "seqlake_worker_state"
DIMENSIONS = 256

Encoder = Callable[[Sequence[str]], np.ndarray]


def _resident(key: str, load: Callable[[], Encoder]) -> Encoder:
    """The encoder of this process, loaded the first time. Of others only the newest is kept.

    Code of this library reaches a worker by value, a task at a time, so what is to stay lives in a module of its own.
    """
    held = vars(sys.modules.setdefault(_WORKER_STATE, types.ModuleType(_WORKER_STATE))).setdefault("models", {})
    if key not in held:
        held.clear()
        held[key] = load()
    return held[key]


def embed_with(
    df: DataFrame,
    text: str,
    load: Callable[[], Encoder],
    batch_rows: int = BATCH_ROWS,
    buffer_bytes: int = BUFFER_BYTES,
) -> DataFrame:
    """Add ``embedding`` by a model: ``load`` runs once in a worker process and returns the encoder.

    The encoder stays for all tasks that the process is given. It gets ``batch_rows`` texts at a time, of about the
    same length: texts are sorted by length over ``buffer_bytes`` of them, whatever batches they came in. Rows keep
    their order. Rows without a text get no vector.
    """
    vector = T.StructField("embedding", T.ArrayType(T.FloatType()))
    schema = T.StructType([*df.schema.fields, vector])
    key = hashlib.sha256(cloudpickle.dumps(load)).hexdigest()

    def encoded(held: list[pa.RecordBatch], encode: Encoder) -> Iterator[pa.RecordBatch]:
        texts = [value for batch in held for value in batch.column(text).to_pylist()]
        vectors: list[np.ndarray | None] = [None] * len(texts)
        places = sorted((i for i, value in enumerate(texts) if value is not None), key=lambda i: len(texts[i]))
        for start in range(0, len(places), batch_rows):
            part = places[start:start + batch_rows]
            for i, found in zip(part, np.asarray(encode([texts[i] for i in part]), np.float32)):
                vectors[i] = found
        start = 0
        for batch in held:
            mine = pa.array(vectors[start:start + batch.num_rows], pa.list_(pa.float32()))
            start += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, mine], [*batch.schema.names, "embedding"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(text).nbytes + 1
            if size >= buffer_bytes:
                yield from encoded(held, _resident(key, load))
                held, size = [], 0
        if held:
            yield from encoded(held, _resident(key, load))

    return df.mapInArrow(run, schema)


def with_terms(df: DataFrame, text: str) -> DataFrame:
    """Add ``_terms``: the words of the text, then each two that follow each other."""
    def both(words: Column) -> Column:
        pairs = F.zip_with(
            F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
            lambda one, two: F.concat_ws(" ", one, two),
        )
        return F.concat(words, pairs)

    # A variable of a function, so that the text is cut once and not for each use of its words.
    words = tokens(F.coalesce(F.col(text), F.lit("")))
    return df.withColumn("_terms", F.transform(F.array(words), both)[0])


def count_terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, n``: how often a text holds each of its words, and each two that follow each other.

    Counted where the row is; nothing is shuffled.
    """
    shape = T.StructType([df.schema[key], T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, COUNTED_ROWS):
                batch = whole.slice(start, COUNTED_ROWS)
                lists = batch.column("_words")
                row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                words = lists.flatten()
                inner = np.flatnonzero(row[1:] == row[:-1])
                pairs = pc.binary_join_element_wise(words.take(pa.array(inner)), words.take(pa.array(inner + 1)), " ")
                terms = pa.concat_arrays([words, pairs]).dictionary_encode()
                rows = np.concatenate([row, row[inner]])
                width = max(1, len(terms.dictionary))
                held, n = np.unique(rows * width + terms.indices.to_numpy(zero_copy_only=False), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).take(pa.array(held // width)), terms.dictionary.take(pa.array(held % width)), pa.array(n, pa.int64())],
                    [key, "term", "n"],
                )

    words = tokens(F.coalesce(F.col(text), F.lit(""))).alias("_words")
    return df.select(key, words).mapInArrow(run, shape)


def _counted(df: DataFrame, text: str, dimensions: int) -> DataFrame:
    tokenised = with_terms(df, text)
    return HashingTF(inputCol="_terms", outputCol="_counts", numFeatures=dimensions).transform(tokenised)


def term_weights(df: DataFrame, text: str, dimensions: int = DIMENSIONS) -> IDFModel:
    """Weights that count rare terms of the texts for more, for ``embed``; one pass of partial sums."""
    return IDF(inputCol="_counts", outputCol="_weighted").fit(_counted(df, text, dimensions))


def embed(
    df: DataFrame, text: str, dimensions: int = DIMENSIONS, weights: IDFModel | None = None
) -> DataFrame:
    """Add ``embedding`` without a model: hashed counts of words and word pairs, of length 1.

    It runs in the JVM. Without weights it needs no pass to fit, and gives a text the same vector in
    any table; texts and questions must share their weights.
    """
    counted = _counted(df, text, dimensions)
    if weights is not None:
        counted = weights.transform(counted).drop("_counts").withColumnRenamed("_weighted", "_counts")
    unit = Normalizer(inputCol="_counts", outputCol="_unit").transform(counted)
    return unit.withColumn("embedding", vector_to_array("_unit", "float32")).drop(
        "_terms", "_counts", "_unit"
    )
