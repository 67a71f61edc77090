"""Cosine nearest neighbours of many queries, exact: see ``blocks`` for distances and ties."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.operators.blocks import (
    QUERY_BYTES, TILE_ROWS, TOP_K, Nearest, arrow_matrix, each_group, hit_schema, named, numbered, ranked, raw_matrix, unit_rows, vectors,
)
from seqlake.operators.vector_index import top_k_pruned


def _scan(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Every task streams its part of the corpus past all queries. For a checked number of them."""
    rows = queries.toArrow()
    packed = corpus.sparkSession.sparkContext.broadcast(
        (rows["query_id"].combine_chunks(), rows["_group"].to_numpy(), raw_matrix(rows["embedding"]))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_groups, raw = packed.value
        asked = unit_rows(raw, np.arange(len(raw)))
        numbers, number_of = numbered(query_groups)
        places = [np.flatnonzero(numbers == number) for number in range(len(number_of))]
        nearest, id_type = Nearest(len(asked), k), None
        for batch in batches:
            if len(batch) == 0:
                continue
            id_type = batch.schema.field("id").type
            ids, found = batch.column("id").to_numpy(zero_copy_only=False), arrow_matrix(batch.column("embedding"))
            for number, mine in each_group(batch.column("_group").to_numpy(zero_copy_only=False), number_of):
                nearest.meet(asked, places[number], ids[mine], found[mine])
        q, ids, distance = nearest.hits()
        if len(q):
            yield pa.RecordBatch.from_arrays(
                [query_ids.take(pa.array(q)), pa.array(query_groups[q], pa.string()), pa.array(ids, id_type), pa.array(distance)],
                ["query_id", "_group", "id", "distance"],
            )

    return corpus.mapInArrow(run, hit_schema(queries, corpus))


def top_k(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    on: str | None = None,
    query_bytes: int = QUERY_BYTES,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``query_id, rank, id, distance``: the k nearest rows of ``corpus`` for each query.

    ``corpus`` has ``id, embedding``, ``queries`` has ``query_id, embedding``; with ``on`` a query
    only meets rows with its own value of that column, which the result names too. Queries of up to
    ``query_bytes`` are sent to all tasks and the corpus is not shuffled; beyond that the corpus is
    clustered, and a query goes to the clusters that may hold a hit (``vector_index.top_k_pruned``).
    """
    left = vectors(corpus, "id", "id", on)
    right = vectors(queries, "query_id", "query_id", on)
    size = right.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    if size["n"] == 0:
        hits = left.sparkSession.createDataFrame([], hit_schema(right, left))
    elif size["n"] * size["dim"] * 8 <= query_bytes:
        hits = _scan(left, right, k)
    else:
        return top_k_pruned(corpus, queries, k, on, tile_rows)[0]
    return named(ranked(hits, k), queries, on)
