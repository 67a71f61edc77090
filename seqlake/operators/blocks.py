"""Blocks of vectors: cosine distances between two of them, and the k nearest rows of each query.

Distance is 1 - cosine, rounded to 6 decimals, and equal distances are ordered by id, so the
result does not depend on how the rows were split. No pair of rows is ever emitted: a task
multiplies blocks of vectors and passes on at most k hits per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOP_K = 5
# Queries that are sent to all tasks at once, and rows of a corpus that a task holds.
QUERY_BYTES = 64 << 20
TILE_ROWS = 20_000
# Distances worked out at once, and rows of a block.
BLOCK_CELLS = 1 << 20
BLOCK_ROWS = 2_048
# Distances are rounded to 6 decimals.
_ROUNDING = 1e-6
_SINGLE = float(np.finfo(np.float32).eps)


def unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0, 1, norms)


def arrow_matrix(column: pa.Array) -> np.ndarray:
    return unit(column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1))


def raw_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as they came, a row for each: no wider than the column, and none of them a Python object."""
    return np.concatenate([part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1) for part in column.chunks if len(part)])


def unit_rows(raw: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``unit`` of some rows, a block of them at a time."""
    out = np.empty((len(rows), raw.shape[1]))
    for start in range(0, len(rows), BLOCK_ROWS):
        out[start:start + BLOCK_ROWS] = unit(raw[rows[start:start + BLOCK_ROWS]].astype(np.float64))
    return out


def _smallest(distance: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k smallest values per row; among equal ones the leftmost."""
    if distance.shape[1] <= k:
        return np.ones(distance.shape, bool)
    bound = np.partition(distance, k - 1, axis=1)[:, k - 1:k]
    below = distance < bound
    equal = distance == bound
    room = k - below.sum(axis=1, keepdims=True)
    return below | (equal & (np.cumsum(equal, axis=1) <= room))


def _in_order(q: np.ndarray, distance: np.ndarray, ids: np.ndarray) -> np.ndarray:
    if ids.dtype == object:
        return pd.DataFrame({"q": q, "d": distance, "id": ids}).sort_values(["q", "d", "id"], kind="stable").index.to_numpy()
    return np.lexsort((ids, distance, q))


class Nearest:
    """The k nearest rows of each of ``n`` queries among blocks that are met one after the other.

    Holds n x k hits, however many rows are met, and BLOCK_CELLS distances at a time. ``limit`` gives for each query
    a distance beyond which no row is wanted. Once a query has k hits, its k-th is such a limit, so that most blocks
    cost a product and a comparison in single precision; what may be a hit by that is worked out in double precision.
    """

    def __init__(self, n: int, k: int, limit: np.ndarray | None = None):
        self.k = k
        self.limit = np.full(n, np.inf) if limit is None else np.array(limit, np.float64)
        self.distance = np.full((n, k), np.inf)
        self.ids = None

    def meet(self, queries: np.ndarray, places: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Meet a block with the queries at ``places``, each of them named once."""
        if not len(ids) or not len(places):
            return
        if self.ids is None:
            self.ids = np.zeros(self.distance.shape, ids.dtype)
        by_id = np.argsort(ids, kind="stable")
        ids, vectors = ids[by_id], vectors[by_id]
        width, dim = min(len(ids), BLOCK_ROWS), vectors.shape[1]
        # What single precision may be off by, twice over.
        margin = _ROUNDING + (dim + 4) * _SINGLE
        for left in range(0, len(ids), width):
            block = vectors[left:left + width]
            quick = block.T.astype(np.float32)
            step = max(1, BLOCK_CELLS // len(block))
            for start in range(0, len(places), step):
                here = places[start:start + step]
                asked, limit = queries[here], self.limit[here]
                found = np.flatnonzero(asked.astype(np.float32) @ quick >= (1 - limit - margin).astype(np.float32)[:, None])
                if not len(found):
                    continue
                if len(found) * dim <= BLOCK_CELLS:
                    q, c = np.divmod(found, len(block))
                    cosine = np.einsum("ij,ij->i", asked[q], block[c])
                else:
                    q, c, cosine = self._many(asked, block, limit)
                if len(q):
                    self._merge(here[q], ids[left + c], np.round(1 - cosine, 6) + 0.0)

    def _many(self, asked: np.ndarray, block: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and cosine of every pair that may be a hit."""
        cosine = asked @ block.T
        near = cosine >= (1 - limit - _ROUNDING)[:, None]
        if np.count_nonzero(near) > 4 * self.k * len(asked):
            near &= _smallest(np.round(1 - cosine, 6) + 0.0, self.k)
        q, c = np.nonzero(near)
        return q, c, cosine[q, c]

    def _merge(self, q: np.ndarray, ids: np.ndarray, distance: np.ndarray) -> None:
        some = distance <= self.limit[q]
        q, ids, distance = q[some], ids[some], distance[some]
        touched = np.unique(q)
        held = np.isfinite(self.distance[touched])
        q = np.concatenate([np.broadcast_to(touched[:, None], held.shape)[held], q])
        ids = np.concatenate([self.ids[touched][held], ids])
        distance = np.concatenate([self.distance[touched][held], distance])
        order = _in_order(q, distance, ids)
        q, ids, distance = q[order], ids[order], distance[order]
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(starts, append=len(q)))
        kept = rank < self.k
        q, rank = q[kept], rank[kept]
        self.ids[q, rank], self.distance[q, rank] = ids[kept], distance[kept]
        self.limit[touched] = np.minimum(self.limit[touched], self.distance[touched, -1])

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and distance of every hit."""
        held = np.isfinite(self.distance)
        q, _ = np.nonzero(held)
        return q, self.ids[held] if self.ids is not None else np.zeros(0, np.int64), self.distance[held]


def numbered(groups: np.ndarray) -> tuple[np.ndarray, dict]:
    """Groups as numbers, and the number of each."""
    numbers, names = pd.factorize(groups, use_na_sentinel=False)
    return numbers, {name: number for number, name in enumerate(names)}


def each_group(groups: np.ndarray, number_of: dict) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of every group that some query has: its number, and where they are."""
    for name in pd.unique(groups):
        if name in number_of:
            yield number_of[name], np.flatnonzero(groups == name)


def vectors(df: DataFrame, id: str, name: str, on: str | None) -> DataFrame:
    group = F.col(on).cast("string") if on else F.lit("")
    return df.filter(F.col("embedding").isNotNull()).select(
        F.col(id).alias(name), group.alias("_group"), "embedding"
    )


def ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "_group").orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def named(ranked: DataFrame, queries: DataFrame, on: str | None) -> DataFrame:
    group = [F.col("_group").cast(queries.schema[on].dataType).alias(on)] if on else []
    return ranked.select("query_id", *group, "rank", "id", "distance")


def hit_schema(queries: DataFrame, corpus: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("_group", T.StringType()),
        T.StructField("id", corpus.schema["id"].dataType),
        T.StructField("distance", T.DoubleType()),
    ])
