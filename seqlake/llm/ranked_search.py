"""Ranked lexical search: the best documents for every item, exact, by blocked matrix products.

Terms are runs of letters and digits (see ``terms``). The score of a document for an item is the sum, over the
item's different terms, of the term's weight times the document's impact, both whole numbers:

- weight ``floor(1000 * ln((2 N + 2) / (2 df + 1)))``, in doubles;
- impact ``(10^9 tf) div (1000 tf + 20 m)`` with ``m = 50 + (50 n N) div L``;

N counts the documents with a term, L all their terms, n the terms of the document, df the documents that hold the
term, tf how often the document does.

Items are cut into tiles of bounded size by a hash of item_id. For a tile, one pass over the documents leaves of each
text only what the tile's vocabulary finds in it, ``(term number, count)``, in a table in the shared folder. From it
come N, L and df, and then the scores: blocks of documents become dense matrices of impacts over a slice of the
vocabulary, multiplied in float64 with the dense weights of the items. A slice is so narrow that no partial sum can
reach 2^53, so every product is exact; slices are added up in 64-bit integers. A block keeps what reaches an item's
k-th best score so far, ties included, and only then cuts by doc_id; a task passes on k rows an item.

Bounds: a tile's terms take about ``TILE_BYTES`` on the driver and in a task (an item with more is alone with them),
a block of documents ``DOC_ROWS`` times ``WIDTH`` numbers. Documents are never shuffled.

Defined cases: null text has no terms; documents and items without terms find nothing; rows of one item_id (null is
one, too) are one item with the terms of all of them; every row of documents is ranked, so repeated rows rank one
after the other, and a null doc_id before others of its score; empty tables give an empty result; other columns are
not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.llm.common import slices, stored
from seqlake.llm.terms import LETTERS_DIGITS, terms

TOP_K = 50
TILE_BYTES = 64 << 20
DOC_ROWS = 512
WIDTH = 4096
ITEM_ROWS = 1024
_EXACT = 1 << 53
_MOST_IMPACT = 10**6
_SCALE = 10**9


@dataclass
class ItemTile:
    """Items of one tile: ``item`` and ``term`` are the places of each pair in ``ids`` and ``vocabulary``."""

    ids: list
    vocabulary: pa.Array
    item: np.ndarray
    term: np.ndarray


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term``: the different terms of every item."""
    id_type = items.schema["item_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                flat, sizes = terms(batch.column("text"), LETTERS_DIGITS)
                ids = batch.column("item_id").take(pa.array(np.repeat(np.arange(batch.num_rows), sizes)))
                yield pa.RecordBatch.from_arrays([ids, flat], names=["item_id", "term"])

    schema = T.StructType([T.StructField("item_id", id_type), T.StructField("term", T.StringType())])
    return items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(work, schema).distinct()


def item_tile(pairs: DataFrame) -> ItemTile:
    """The pairs of a tile, whose size has been checked, as arrays."""
    rows = pairs.toArrow().combine_chunks()
    ids, vocabulary = (rows.column(name).combine_chunks().dictionary_encode("encode") for name in ("item_id", "term"))
    return ItemTile(
        ids.dictionary.to_pylist(), vocabulary.dictionary,
        ids.indices.to_numpy(zero_copy_only=False), vocabulary.indices.to_numpy(zero_copy_only=False),
    )


def found_terms(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """``doc_id, n, ids, counts``: how many terms a text has, and which of the vocabulary, how often."""
    packed = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = packed.value
        width = max(1, len(known))
        for whole in batches:
            for batch in slices(whole, "text"):
                flat, sizes = terms(batch.column("text"), LETTERS_DIGITS)
                coded = flat.dictionary_encode()
                number = pc.index_in(coded.dictionary, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                term = number[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(batch.num_rows), sizes)[term >= 0]
                held, times = np.unique(row * width + term[term >= 0], return_counts=True)
                ends = np.searchsorted(held, np.arange(batch.num_rows + 1) * width).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), pa.array(sizes),
                        pa.ListArray.from_arrays(ends, pa.array((held % width).astype(np.int32))),
                        pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))),
                    ],
                    names=["doc_id", "n", "ids", "counts"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id bigint, n bigint, ids array<int>, counts array<int>")


def term_weights(found: DataFrame, n_terms: int, documents: int) -> np.ndarray:
    """Whole weight of each term of the vocabulary."""
    df = np.zeros(n_terms, np.int64)
    # A row for each term of the tile.
    for number, n in found.select(F.explode("ids").alias("id")).groupBy("id").count().collect():
        df[number] = n
    # The logarithm of the C library, as SQL takes it.
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in df], np.int64)


def impacts(counts: np.ndarray, n: np.ndarray, documents: int, occurrences: int) -> np.ndarray:
    """``n``: the number of terms of the document of each count."""
    lengths, place = np.unique(n, return_inverse=True)
    m = np.array([50 + 50 * int(length) * documents // occurrences for length in lengths], np.int64)
    counts = counts.astype(np.int64)
    return _SCALE * counts // (1000 * counts + 20 * m[place]) if len(counts) else counts


def exact_width(weights: np.ndarray, width: int = WIDTH) -> int:
    """Columns whose products can be summed in float64 without reaching 2^53."""
    return max(1, min(width, (_EXACT - 1) // (max(1, int(weights.max(initial=0))) * _MOST_IMPACT)))


class Best:
    """The k best documents of each item among the blocks seen; of equal scores the smallest doc_id, null first."""

    def __init__(self, items: int, k: int):
        self.items, self.k = items, k
        self.floor = np.ones(items, np.int64)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """``scores``: documents by items ``first`` and on."""
        row, item = np.nonzero(scores >= self.floor[first : first + scores.shape[1]])
        self.held.append((item + first, scores[row, item], ids[row], null[row]))
        self.size += len(row)
        if self.size > 8 * self.k * self.items + 100_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        item, score, ids, null = (np.concatenate(part) for part in zip(*self.held)) if self.held else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((ids, ~null.astype(bool), -score, item))
        item, score, ids, null = item[order], score[order], ids[order], null[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        # Whatever ties with the k-th may still win by its doc_id, so it is the floor itself that passes.
        last = rank == self.k - 1
        self.floor[item[last]] = score[last]
        keep = rank < self.k
        self.held = [(item[keep], score[keep], ids[keep], null[keep])]
        self.size = int(keep.sum())
        return self.held[0]


def _tile_hits(
    found: DataFrame, tile: ItemTile, weights: np.ndarray, documents: int, occurrences: int, k: int, width: int
) -> DataFrame:
    """``item, doc_id, score``: at most k rows for each task and item."""
    packed = found.sparkSession.sparkContext.broadcast((tile.item, tile.term, weights))
    n_items, width = len(tile.ids), exact_width(weights, width)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, term, weight = packed.value
        order = np.lexsort((item, term))
        item, term = item[order], term[order]
        best = Best(n_items, k)
        for whole in batches:
            for start in range(0, whole.num_rows, DOC_ROWS):
                batch = whole.slice(start, DOC_ROWS)
                n = batch.column("n").to_numpy(zero_copy_only=False)
                lists = batch.column("ids")
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(batch.num_rows), sizes)
                held = lists.flatten().to_numpy(zero_copy_only=False)
                impact = impacts(batch.column("counts").flatten().to_numpy(zero_copy_only=False), n[row], documents, occurrences)
                doc = batch.column("doc_id")
                null = doc.is_null().to_numpy(zero_copy_only=False)
                ids = doc.fill_null(0).to_numpy(zero_copy_only=False)
                by_term = np.argsort(held, kind="stable")
                row, held, impact = row[by_term], held[by_term], impact[by_term]
                for first in range(0, n_items, ITEM_ROWS):
                    count = min(ITEM_ROWS, n_items - first)
                    scores = np.zeros((batch.num_rows, count), np.int64)
                    for low in range(0, len(weight), width):
                        docs_at = slice(*np.searchsorted(held, (low, low + width)))
                        items_at = slice(*np.searchsorted(term, (low, low + width)))
                        if docs_at.start == docs_at.stop or items_at.start == items_at.stop:
                            continue
                        high = min(len(weight), low + width)
                        left = np.zeros((batch.num_rows, high - low))
                        left[row[docs_at], held[docs_at] - low] = impact[docs_at]
                        mine = (item[items_at] >= first) & (item[items_at] < first + count)
                        right = np.zeros((high - low, count))
                        columns = term[items_at][mine]
                        right[columns - low, item[items_at][mine] - first] = weight[columns]
                        scores += (left @ right).astype(np.int64)
                    best.add(first, scores, ids, null)
        item, score, ids, null = best.cut()
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)), pa.array(ids.astype(np.int64), mask=null.astype(bool)),
             pa.array(score.astype(np.int64))],
            names=["item", "doc_id", "score"],
        )

    return found.filter(F.size("ids") > 0).mapInArrow(work, "item int, doc_id bigint, score bigint")


def top_documents(
    docs: DataFrame, items: DataFrame, k: int = TOP_K, tile_bytes: int = TILE_BYTES, width: int = WIDTH
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item, highest score first."""
    pairs = stored(item_terms(items), "item_terms")
    # What a pair takes on the driver: the term, its entry in the vocabulary, and its places.
    size = pairs.agg(F.sum(F.octet_length("term") + 100)).first()[0] or 0
    n_tiles = max(1, math.ceil(size / tile_bytes))
    spark = docs.sparkSession
    id_type = items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", id_type)])
    out = None
    for number in range(n_tiles):
        tile = item_tile(pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_tiles)) == number))
        if not tile.ids and (out is not None or number < n_tiles - 1):
            continue
        found = stored(found_terms(docs, tile.vocabulary), "found_terms")
        seen = found.filter("n > 0").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("occurrences")).first()
        documents, occurrences = seen["documents"], seen["occurrences"] or 1
        weights = term_weights(found, len(tile.vocabulary), documents)
        hits = _tile_hits(found, tile, weights, documents, occurrences, k, width)
        best = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
        ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(place, name) for place, name in enumerate(tile.ids)], schema)
        # A row for each item of the tile.
        named = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        named = stored(named, "hits") if n_tiles > 1 else named
        out = named if out is None else out.unionByName(named)
    return out
