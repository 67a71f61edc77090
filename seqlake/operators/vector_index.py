"""Clusters of vectors: an index that is built once and searched often, and exact search that skips clusters.

The unit vectors of a corpus are clustered by cosine. Every row goes to the list of its nearest centroid; a list
knows its centroid, its number of rows and its radius, the largest angle between the centroid and a row of it. Lists
longer than ``tile_rows`` are cut into parts, so copies of one vector do not make one task.

``search_index`` lets every query meet the lists nearest to it, a few more in each round, until its k-th hit has not
changed for ``patience`` rounds. ``top_k_pruned`` is exact: the rows of a query's nearest lists give a bound for its
k-th distance, and by the triangle inequality a list whose centroid is farther than that bound and its radius
together holds no hit. There the corpus is shuffled once by cell, some lists side by side, and never copied; queries
are copied to the cells that hold a list they must meet, and stream past them. Cells grow with the corpus up to
``TILE_ROWS`` rows, so their number, and with it the copies of a query, stays the same until then.

Centroids come from at most ``SAMPLE_BYTES`` of different vectors, chosen by a hash of the id; all rows are
assigned. Centroids, ``LIST_BYTES`` at most, are the only data of the corpus that pass through the driver. Of the
queries one set at a time does, as it came, to be sent to all tasks; ids, hits and rows met stay in the shared folder.
A vector of length zero belongs to list -1, which every query meets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.operators.blocks import (
    BLOCK_CELLS, BLOCK_ROWS, QUERY_BYTES, TILE_ROWS, TOP_K, Nearest, arrow_matrix, each_group, hit_schema, named, numbered, ranked, raw_matrix, unit,
    unit_rows, vectors,
)
from seqlake.session import scratch_path, stored
from seqlake.sources.tables import publish

# Lists for each square root of the number of rows.
LISTS_PER_ROOT = 16
# Lists of a corpus that is clustered for one exact search, and cells that its rows are dealt to, if these hold no more
# than TILE_ROWS each. Neither grows with the corpus, so its rows and queries are compared with as many centroids and
# queries are copied as often at every size.
PRUNED_LISTS = 2_048
CELLS = 32
LIST_BYTES = 32 << 20
SAMPLE_BYTES = 128 << 20
SAMPLE_PER_LIST = 32
ROUNDS = 4
# Share of the lists that a query meets in a round, and rounds without a change that end its search.
STEP = 0.04
PATIENCE = 2
# Hits of one set of queries, and lists that a scan is told to read alone.
HIT_ROWS = 1_000_000
FILTER_LISTS = 1_000
# Distances are rounded to 6 decimals.
_ROUNDING = 1e-6
_MET = [T.StructField("rows_met", T.LongType()), T.StructField("rows_total", T.LongType())]


@dataclass(frozen=True)
class VectorIndex:
    """``rows``: list, part, id, _group, embedding. ``lists``: list, centroid, n, radius, parts."""

    rows: DataFrame
    lists: DataFrame

    def table_of_lists(self) -> Lists:
        """A row for each list, of bounded size."""
        found = self.lists.filter("list >= 0").orderBy("list").toArrow()
        if not len(found):
            return Lists(np.zeros((0, 1)), np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int))
        return Lists(raw_matrix(found["centroid"]), *(found[name].to_numpy() for name in ("list", "n", "radius", "parts")))


@dataclass(frozen=True)
class Lists:
    centroids: np.ndarray
    numbers: np.ndarray
    sizes: np.ndarray
    radius: np.ndarray
    parts: np.ndarray


def _angles(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(left @ right.T, -1, 1))


def _assigner(centroids: np.ndarray, names: list[str]):
    """Adds the nearest centroid and the angle to it; a vector of length zero gets -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = arrow_matrix(batch.column("embedding"))
            place, gap = np.empty(len(found), np.int32), np.empty(len(found))
            step = max(1, (16 << 20) // (8 * len(centroids) + 1))
            for start in range(0, len(found), step):
                cosine = found[start:start + step] @ centroids.T
                near = cosine.argmax(axis=1)
                place[start:start + step] = near
                gap[start:start + step] = np.arccos(np.clip(cosine[np.arange(len(near)), near], -1, 1))
            none = ~found.any(axis=1)
            place[none], gap[none] = -1, 0.0
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(place), pa.array(gap)], [*names, "list", "gap"])

    return run


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    shape = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("gap", T.DoubleType())])
    return rows.mapInArrow(_assigner(centroids, rows.columns), shape)


def _mean(table: pa.Table) -> pa.Table:
    total = arrow_matrix(table.column("embedding").combine_chunks()).sum(axis=0)
    centre = unit(total[None, :])[0]
    return pa.table({"list": pa.array([table.column("list")[0].as_py()], pa.int32()), "centroid": [centre.tolist()]})


def train_centroids(rows: DataFrame, n_rows: int, dim: int, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of a bounded sample of different vectors, moved ``rounds`` times to the middle of their rows."""
    steps = 1 << 20
    wanted = min(lists * SAMPLE_PER_LIST, SAMPLE_BYTES // (8 * dim))
    drawn = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(steps)) < min(steps, -(-wanted * steps // n_rows))
    sample = rows.filter(drawn & F.exists("embedding", lambda x: x != 0)).select("id", "embedding")
    sample = stored(sample.dropDuplicates(["embedding"]), "sample")
    # The first ones, one for each list.
    first = sample.orderBy(F.xxhash64("id"), "id").limit(lists).select("embedding").toArrow()
    if not len(first):
        return np.zeros((0, dim))
    centroids = unit(raw_matrix(first["embedding"]).astype(np.float64))
    for _ in range(rounds):
        # The sample is bounded, so a list of it is, too.
        moved = _assigned(sample.select("embedding"), centroids).groupBy("list").applyInArrow(
            _mean, "list int, centroid array<double>"
        ).toArrow()
        if len(moved):
            centres = raw_matrix(moved["centroid"])
            some = centres.any(axis=1)
            centroids[moved["list"].to_numpy()[some]] = centres[some]
    return centroids


def number_of_lists(n_rows: int, dim: int) -> int:
    return max(1, min(int(LISTS_PER_ROOT * math.sqrt(n_rows)), n_rows // 2, LIST_BYTES // (8 * dim)))


def build_index(
    corpus: DataFrame, on: str | None = None, lists: int | None = None, tile_rows: int = TILE_ROWS, rounds: int = ROUNDS
) -> VectorIndex:
    """Cluster ``corpus`` (``id, embedding``; with ``on``, hits must agree in that column). Null vectors are left out.

    The index lies in the shared folder; ``publish_index`` makes tables of it.
    """
    rows = vectors(corpus, "id", "id", on)
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    n_rows, dim = seen["n"], max(1, seen["dim"] or 1)
    centroids = np.zeros((0, dim))
    if n_rows:
        centroids = train_centroids(rows, n_rows, dim, lists or number_of_lists(n_rows, dim), rounds)
    # With no vector but zeros there is no centroid, and list -1 takes all.
    placed = stored(_assigned(rows, centroids if len(centroids) else np.zeros((1, dim))), "index_rows")
    sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius"))
    centres = rows.sparkSession.createDataFrame(
        pa.table({
            "list": pa.array(np.arange(len(centroids), dtype=np.int32)),
            "centroid": pa.ListArray.from_arrays(np.arange(len(centroids) + 1, dtype=np.int32) * dim, centroids.ravel()),
        }),
        "list int, centroid array<double>",
    )
    parts = F.ceil(F.col("n") / tile_rows).cast("int").alias("parts")
    table = stored(sizes.join(F.broadcast(centres), "list", "left").select("list", "centroid", "n", "radius", parts), "index_lists")
    return VectorIndex(_with_parts(placed.drop("gap"), table), table)


def _with_parts(rows: DataFrame, lists: DataFrame) -> DataFrame:
    part = F.pmod(F.xxhash64(F.col("id").cast("string")), "parts").cast("int").alias("part")
    found = rows.join(F.broadcast(lists.select("list", "parts")), "list")
    return found.select("list", part, "id", "_group", "embedding")


def publish_index(index: VectorIndex, table: str, path: str | None = None) -> VectorIndex:
    """Write the index as the tables ``<table>_rows``, in the order of its lists, and ``<table>_lists``."""
    inside = lambda name: f"{path}/{name}" if path else None
    rows = index.rows.repartitionByRange("list", "part").sortWithinPartitions("list", "part")
    return VectorIndex(
        publish(rows, f"{table}_rows", inside("rows")), publish(index.lists, f"{table}_lists", inside("lists"))
    )


def open_index(spark: SparkSession, table: str) -> VectorIndex:
    return VectorIndex(spark.read.table(f"{table}_rows"), spark.read.table(f"{table}_lists"))


def _with_bounds(queries: DataFrame, lists: Lists, packed_lists: Broadcast, step: float) -> DataFrame:
    """``nearer``: the least cosine of a list that the query meets by each round; ``met``: the rows it has met by then."""
    count = len(lists.numbers)
    if not count:
        # One round, for the vectors of length zero.
        return queries.withColumns({"nearer": F.array(F.lit(-2.0)), "met": F.array(F.lit(0).cast("long"))})
    ends = sorted({min(count, max(1, math.ceil(count * step * turn))) for turn in range(1, math.ceil(1 / step) + 1)})
    shape = T.StructType([
        *queries.schema.fields, T.StructField("nearer", T.ArrayType(T.DoubleType())), T.StructField("met", T.ArrayType(T.LongType()))
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, sizes, _ = packed_lists.value
        for whole in batches:
            block = max(1, (16 << 20) // (8 * count + 1))
            for start in range(0, whole.num_rows, block):
                batch = whole.slice(start, block)
                cosine = arrow_matrix(batch.column("embedding")) @ centroids.T
                order = np.argsort(-cosine, axis=1, kind="stable")
                # Between the last list that is met and the next one, so that no rounding moves a list to the other side.
                last, after = (order[:, np.minimum(np.array(ends) + more, count) - 1] for more in (0, 1))
                nearer = (np.take_along_axis(cosine, last, axis=1) + np.take_along_axis(cosine, after, axis=1)) / 2
                met = np.cumsum(sizes[order], axis=1)[:, np.array(ends) - 1]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(list(nearer), pa.list_(pa.float64())), pa.array(list(met), pa.list_(pa.int64()))],
                    [*batch.schema.names, "nearer", "met"],
                )

    return queries.mapInArrow(run, shape)


def _probe(
    rows: DataFrame, lists: Lists, packed_lists: Broadcast, asked, packed_asked: Broadcast, now, packed_now: Broadcast, k: int
) -> DataFrame:
    """``q, id, distance``, up to ``kth``, among the lists whose cosine lies from ``nearer`` up to, but below, ``before``.

    ``asked`` is a set of queries: names, groups by number, what these numbers are, and vectors as they came. ``now`` says
    of a round which of them still go on, and up to where. A task holds k hits of each, however many rows it meets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, _, place_of = packed_lists.value
        (names, groups, number_of, raw), (going, nearer, before, kth, first) = packed_asked.value, packed_now.value
        numbers = groups[going]
        nearest, id_type, matrix = Nearest(len(going), k, kth), pa.int64(), None
        step = max(1, BLOCK_CELLS // len(going))
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = unit_rows(raw, going) if matrix is None else matrix
            id_type = batch.schema.field("id").type
            number = batch.column("list").to_numpy()
            group = batch.column("_group").to_numpy(zero_copy_only=False)
            ids, found = batch.column("id").to_numpy(zero_copy_only=False), arrow_matrix(batch.column("embedding"))
            order = np.argsort(number, kind="stable")
            starts = np.flatnonzero(np.diff(number[order], prepend=-2))
            inside = np.split(order, starts[1:])
            here = number[order[starts]]
            for at in range(0, len(here), step):
                centres = centroids[place_of[np.maximum(here[at:at + step], 0)]] if len(centroids) else np.zeros((1, matrix.shape[1]))
                cosine = centres @ matrix.T
                met = (cosine >= nearer) & (cosine < before)
                met[here[at:at + step] < 0] = first
                for these, chosen in zip(met, inside[at:at + step]):
                    mine = np.flatnonzero(these)
                    for name, rows_of in each_group(group[chosen], number_of) if len(mine) else ():
                        of_group = mine if len(number_of) == 1 else mine[numbers[mine] == name]
                        nearest.meet(matrix, of_group, ids[chosen[rows_of]], found[chosen[rows_of]])
        q, ids, distance = nearest.hits()
        if len(q):
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[going[q]]), pa.array(ids, id_type), pa.array(distance)], ["q", "id", "distance"]
            )

    going, nearer, *_ = now
    # The lists of the last few queries are worth naming to the scan.
    few, wanted = 0 < len(going) * len(lists.numbers) <= 1 << 22, lists.numbers
    if few:
        blocks = np.array_split(np.arange(len(going)), -(-len(going) // BLOCK_ROWS))
        wanted = wanted[sum((lists.centroids @ unit_rows(asked[3], going[some]).T >= nearer[some]).any(axis=1) for some in blocks) > 0]
    if len(wanted) <= min(FILTER_LISTS, len(lists.numbers) - 1):
        rows = rows.filter(F.col("list").isin([int(n) for n in wanted]) | (F.col("list") < 0))
    shape = T.StructType([T.StructField("q", T.LongType()), rows.schema["id"], T.StructField("distance", T.DoubleType())])
    return rows.mapInArrow(run, shape)


def _k_best(hits: DataFrame, k: int) -> DataFrame:
    return ranked(hits.select(F.col("q").alias("query_id"), F.lit("").alias("_group"), "id", "distance"), k).select(
        F.col("query_id").alias("q"), "id", "distance", "rank"
    )


def search_index(
    index: VectorIndex,
    queries: DataFrame,
    k: int = TOP_K,
    on: str | None = None,
    step: float = STEP,
    patience: int = PATIENCE,
    query_bytes: int = QUERY_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """``query_id, rank, id, distance`` of at most k hits, and ``query_id, rows_met, rows_total, complete`` of every query.

    A round meets ``step`` of the lists, nearest first. ``complete`` tells that a query has met all lists, so that
    its hits are exact. A query is done when its k-th distance stayed the same for ``patience`` rounds. Queries are
    taken in sets of ``query_bytes``, one after the other through the driver; hits lie in the shared folder between the rounds.
    """
    spark = queries.sparkSession
    lists = index.table_of_lists()
    right = vectors(queries, "query_id", "query_id", on)
    size = right.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    per_set = max(1, min(query_bytes // (8 * (size["dim"] or 1)), HIT_ROWS // k))
    sets = max(1, math.ceil(size["n"] / per_set))
    zeros = index.lists.filter("list < 0").agg(F.sum("n")).first()[0] or 0
    group = [F.col("_group").cast(queries.schema[on].dataType).alias(on)] if on else []
    name, rank = T.StructField("q", T.LongType()), T.StructField("rank", T.IntegerType())
    hit_shape = T.StructType([name, rank, index.rows.schema["id"], T.StructField("distance", T.DoubleType())])
    last_shape = T.StructType([name, T.StructField("last", T.IntegerType())])
    if not size["n"]:
        names = [right.schema["query_id"], right.schema["_group"]]
        hits = spark.createDataFrame([], T.StructType([*names, *hit_shape.fields[1:]]))
        met = spark.createDataFrame([], T.StructType([*names, *_MET, T.StructField("complete", T.BooleanType())]))
        return named(hits, queries, on), met.select("query_id", *group, "rows_met", "rows_total", "complete")
    share = spark.sparkContext.broadcast
    place_of = np.full(int(lists.numbers.max(initial=0)) + 1, -1)
    place_of[lists.numbers] = np.arange(len(lists.numbers))
    packed_lists = share((lists.centroids, lists.sizes, place_of))
    # Ids may repeat, and so might all rows of a set; a name of its own is what a query is known by until the end.
    asked = stored(_with_bounds(right.withColumn("q", F.monotonically_increasing_id()), lists, packed_lists, step), "asked")
    hits_path, last_path = scratch_path(spark, "hits"), scratch_path(spark, "last_rounds")
    for turn in range(sets):
        mine = asked.filter(F.pmod(F.xxhash64("q"), F.lit(sets)) == turn).select("q", "_group", "embedding", "nearer").toArrow()
        if not len(mine):
            continue
        names, nearer = mine["q"].to_numpy(), raw_matrix(mine["nearer"])
        whole = (names, *numbered(mine["_group"].to_numpy()), raw_matrix(mine["embedding"]))
        del mine
        packed_asked = share(whole)
        # The last round takes whatever is left.
        rounds, nearer[:, -1] = nearer.shape[1], -2.0
        by_name = np.argsort(names)
        before, kth = np.full(len(names), np.inf), np.full(len(names), np.inf)
        same, last = np.zeros(len(names), int), np.zeros(len(names), np.int32)
        found = None
        for at in range(rounds):
            going = np.flatnonzero(same < patience)
            if not len(going):
                break
            now = (going, nearer[going, at], before[going], kth[going], at == 0)
            packed_now = share(now)
            fresh = _probe(index.rows, lists, packed_lists, whole, packed_asked, now, packed_now, k)
            both = fresh if found is None else fresh.unionByName(found.drop("rank"))
            found = stored(_k_best(both, k), "found")
            packed_now.destroy()
            ends = found.filter(F.col("rank") == k).select("q", "distance").toArrow()
            new = kth.copy()
            new[by_name[np.searchsorted(names, ends["q"].to_numpy(), sorter=by_name)]] = ends["distance"].to_numpy()
            unchanged = np.isfinite(new) & (new == kth)
            same[going] = np.where(unchanged[going], same[going] + 1, 0)
            kth, last[going], before[going] = new, at, nearer[going, at]
        packed_asked.destroy()
        found.select(hit_shape.names).write.parquet(hits_path, "append", compression="zstd")
        spark.createDataFrame(pa.table({"q": names, "last": last}), last_shape).write.parquet(last_path, "append", compression="zstd")
    packed_lists.destroy()
    hits = spark.read.schema(hit_shape).parquet(hits_path).join(asked.select("q", "query_id", "_group"), "q")
    met = asked.join(spark.read.schema(last_shape).parquet(last_path), "q").withColumns({
        "rows_met": F.element_at("met", F.col("last") + 1) + F.lit(zeros),
        "rows_total": F.lit(int(lists.sizes.sum()) + zeros).cast("long"),
        "complete": F.col("last") == F.size("met") - 1,
    })
    return named(hits, queries, on), met.select("query_id", *group, "rows_met", "rows_total", "complete")


def top_k_approx(corpus: DataFrame, queries: DataFrame, k: int = TOP_K, on: str | None = None, **search) -> DataFrame:
    """As ``top_k``, by an index built for this call; near rows may be missed. Keep the index to ask again."""
    return search_index(build_index(corpus, on), queries, k, on, **search)[0]


@dataclass(frozen=True)
class Cells:
    """Lists in the order of their cells: ``starts`` is where each cell begins, ``cell`` names each list's cell.

    A cell is some lists that lie side by side and hold ``rows`` rows or so together, or one list of several parts. It
    is named by its first list. A query is copied to a cell once, for all the lists in it.
    """

    lists: Lists
    cell: np.ndarray
    starts: np.ndarray


def _cells(lists: Lists, rows: int) -> Cells:
    # Lists that are near to one of a few centroids follow each other.
    some = lists.centroids[:math.isqrt(len(lists.numbers)) + 1]
    order = np.lexsort(((lists.centroids @ some.T).argmax(axis=1), lists.parts > 1))
    lists = Lists(*(values[order] for values in (lists.centroids, lists.numbers, lists.sizes, lists.radius, lists.parts)))
    starts, held = [], 0
    for at, (size, parts) in enumerate(zip(lists.sizes, lists.parts)):
        if not at or parts > 1 or held + size > rows:
            starts.append(at)
            held = 0
        held += size
    starts = np.array(starts)
    cell = np.repeat(lists.numbers[starts], np.diff(starts, append=len(lists.numbers)))
    return Cells(lists, cell, starts)


def _in_cells(rows: DataFrame, cells: Cells) -> DataFrame:
    """``rows`` of an index with the cell's name as ``list``, and their own list as ``inner``."""
    names = rows.sparkSession.createDataFrame(
        [(int(number), int(cell)) for number, cell in zip(cells.lists.numbers, cells.cell)], "inner int, list int"
    )
    return rows.withColumnRenamed("list", "inner").join(F.broadcast(names), "inner")


def _meet(rows: DataFrame, probes: DataFrame, k: int, shape: T.StructType, cells: Cells, choose) -> DataFrame:
    """Hits up to ``bound`` of ``probes`` (list, part and a query) among the rows of their cell that ``choose`` names.

    Cells come one after the other, each its rows first: these are held, ``tile_rows`` or so, and queries stream past.
    """
    left = rows.withColumns({
        "query_id": F.lit(None).cast(probes.schema["query_id"].dataType), "bound": F.lit(None).cast("double"), "side": F.lit(0),
    })
    right = probes.withColumns({"id": F.lit(None).cast(rows.schema["id"].dataType), "inner": F.lit(None).cast("int"), "side": F.lit(1)})
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = left.unionByName(right).repartition(tasks, "list", "part").sortWithinPartitions("list", "part", "side")
    lists = cells.lists

    def ready_of(held: list[pa.RecordBatch], cell: int):
        """The rows of a cell by list and group."""
        inner = np.concatenate([p.column("inner").to_numpy() for p in held])
        groups = np.concatenate([p.column("_group").to_numpy(zero_copy_only=False) for p in held])
        ids = np.concatenate([p.column("id").to_numpy(zero_copy_only=False) for p in held])
        found = np.concatenate([arrow_matrix(p.column("embedding")) for p in held])
        places = np.flatnonzero(cells.cell == cell)
        blocks = []
        for at, place in enumerate(places):
            here = np.flatnonzero(inner == lists.numbers[place])
            blocks += [(at, name, ids[here[mine]], found[here[mine]]) for name in pd.unique(groups[here]) for mine in [groups[here] == name]]
        return places, blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(name).to_numpy() for name in ("list", "part", "side")])
            starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for start, end in zip(starts, starts[1:]):
                piece = batch.slice(start, end - start)
                here = tuple(keys[:2, start])
                if here != place:
                    place, held, ready = here, [], None
                if keys[2, start] == 0:
                    held.append(piece)
                    continue
                if not held:
                    continue
                if ready is None:
                    ready, held = ready_of(held, here[0]), [None]
                places, blocks = ready
                asked, matrix = piece.column("_group").to_numpy(zero_copy_only=False), arrow_matrix(piece.column("embedding"))
                bound = piece.column("bound").fill_null(np.inf).to_numpy(zero_copy_only=False)
                nearest = Nearest(len(matrix), k, bound)
                wanted = choose(bound, matrix, places)
                of_group = {name: asked == name for name in pd.unique(asked)}
                for at, name, ids, found in blocks:
                    if name in of_group:
                        nearest.meet(matrix, np.flatnonzero(wanted[:, at] & of_group[name]), ids, found)
                q, ids, distance = nearest.hits()
                if len(q):
                    at = pa.array(q)
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("query_id").take(at), piece.column("_group").take(at),
                         pa.array(ids, batch.schema.field("id").type), pa.array(distance)],
                        ["query_id", "_group", "id", "distance"],
                    )

    return both.mapInArrow(run, shape)


def _probes(queries: DataFrame, cells: Cells, choose) -> DataFrame:
    """A row ``list, part`` and a copy of the query for every part of the cells that hold a list ``choose`` names for it."""
    shape = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("part", T.IntegerType()),
                          *(queries.schema[name] for name in ("query_id", "_group", "embedding", "bound"))])
    lists, starts = cells.lists, cells.starts
    step = max(1, min(256, BLOCK_CELLS // len(lists.numbers)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                bound = batch.column("bound").fill_null(np.inf).to_numpy(zero_copy_only=False)
                chosen = choose(bound, arrow_matrix(batch.column("embedding")), np.arange(len(lists.numbers)))
                query, place = np.nonzero(np.logical_or.reduceat(chosen, starts, axis=1))
                place = starts[place]
                copies = lists.parts[place]
                query, place = np.repeat(query, copies), np.repeat(place, copies)
                part = np.arange(len(place)) - np.repeat(np.cumsum(copies) - copies, copies)
                at = pa.array(query)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists.numbers[place].astype(np.int32)), pa.array(part.astype(np.int32)),
                     *(batch.column(name).take(at) for name in ("query_id", "_group", "embedding", "bound"))],
                    ["list", "part", "query_id", "_group", "embedding", "bound"],
                )

    return queries.mapInArrow(run, shape)


def top_k_pruned(
    corpus: DataFrame, queries: DataFrame, k: int = TOP_K, on: str | None = None, tile_rows: int = TILE_ROWS,
    index: VectorIndex | None = None,
) -> tuple[DataFrame, DataFrame]:
    """As ``top_k``, exact, and ``query_id, rows_met, rows_total`` of every query; the other rows were skipped unseen.

    Without an ``index`` the corpus is clustered into lists of about ``tile_rows`` rows.
    """
    if index is None:
        # Written once: counting, drawing and assigning read it again, and vectors may be costly to make.
        corpus = stored(corpus.select("id", "embedding", *([on] if on else [])), "corpus")
        seen = corpus.filter(F.col("embedding").isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
        n_rows, dim = seen["n"], max(1, seen["dim"] or 1)
        wanted = max(1, min(-(-n_rows // tile_rows), PRUNED_LISTS, LIST_BYTES // (8 * dim)))
        index = build_index(corpus, on, wanted, max(tile_rows, min(TILE_ROWS, -(-n_rows // CELLS))))
    lists = index.table_of_lists()
    zero_list = index.lists.filter("list < 0").select("n", "parts").first()
    right = vectors(queries, "query_id", "query_id", on)
    shape = hit_schema(right, index.rows)
    if zero_list is not None:
        # One more list, as near to every query as can be.
        lists = Lists(
            np.vstack([lists.centroids, np.zeros((1, lists.centroids.shape[1]))]) if len(lists.numbers) else
            np.zeros((1, right.agg(F.max(F.size("embedding"))).first()[0] or 1)),
            np.append(lists.numbers, -1), np.append(lists.sizes, zero_list["n"]),
            np.append(lists.radius, np.pi), np.append(lists.parts, zero_list["parts"]),
        )
    if not len(lists.numbers):
        return named(ranked(right.sparkSession.createDataFrame([], shape), k), queries, on), _met(right, lists, None, queries, on)
    cells = _cells(lists, max(tile_rows, min(TILE_ROWS, -(-int(lists.sizes.sum()) // CELLS))))
    lists = cells.lists
    centroids, sizes, radius, zero = lists.centroids, lists.sizes, lists.radius, lists.numbers < 0
    rows = _in_cells(index.rows, cells)
    of_cell = np.repeat(np.arange(len(cells.starts)), np.diff(cells.starts, append=len(sizes)))

    def nearest(bound: np.ndarray, found: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The cells of the nearest lists that hold k rows together."""
        cosine = found @ centroids.T
        order = np.argsort(-cosine, axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1) - sizes[order]
        out = np.empty(cosine.shape, bool)
        np.put_along_axis(out, order, held < k, axis=1)
        return np.logical_or.reduceat(out, cells.starts, axis=1)[:, of_cell[places]]

    def all_of_it(bound: np.ndarray, found: np.ndarray, places: np.ndarray) -> np.ndarray:
        return np.ones((len(found), len(places)), bool)

    def may_hold(bound: np.ndarray, found: np.ndarray, places: np.ndarray) -> np.ndarray:
        cosine = found @ centroids[places].T
        closest = 1 - np.cos(np.maximum(0, np.arccos(np.clip(cosine, -1, 1)) - radius[places]))
        # A query of length zero is equally far from everything.
        none = ~found.any(axis=1)[:, None]
        return (closest <= bound[:, None] + _ROUNDING) | zero[places] | none

    unbound = right.withColumn("bound", F.lit(None).cast("double"))
    first = stored(ranked(_meet(rows, _probes(unbound, cells, nearest), k, shape, cells, all_of_it), k), "first_hits")
    bound = first.filter(F.col("rank") == k).select(
        F.col("query_id").alias("_query"), F.col("_group").alias("_in"), F.col("distance").alias("bound")
    )
    known = right.join(
        bound, right["query_id"].eqNullSafe(bound["_query"]) & right["_group"].eqNullSafe(bound["_in"]), "left"
    ).drop("_query", "_in")
    known = stored(known, "bounds")
    # The lists met before are met once more with the others: they are few, and no hit need be told from its copy.
    hits = ranked(_meet(rows, _probes(known, cells, may_hold), k, shape, cells, may_hold), k)

    def met(bound: np.ndarray, found: np.ndarray, places: np.ndarray) -> np.ndarray:
        return may_hold(bound, found, places) | nearest(bound, found, places)

    return named(hits, queries, on), _met(known, lists, met, queries, on)


def _met(known: DataFrame, lists: Lists, choose, queries: DataFrame, on: str | None) -> DataFrame:
    """``query_id, rows_met, rows_total``: the rows of the lists that ``choose`` names for a query, and of all."""
    shape = T.StructType([known.schema["query_id"], known.schema["_group"], *_MET])
    sizes, total = lists.sizes, int(lists.sizes.sum())
    step = max(1, min(256, BLOCK_CELLS // max(1, len(sizes))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                met = np.zeros(batch.num_rows, np.int64)
                if choose is not None:
                    bound = batch.column("bound").fill_null(np.inf).to_numpy(zero_copy_only=False)
                    met = choose(bound, arrow_matrix(batch.column("embedding")), np.arange(len(sizes))) @ sizes
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id"), batch.column("_group"), pa.array(met.astype(np.int64)), pa.array(np.full(len(met), total))],
                    ["query_id", "_group", "rows_met", "rows_total"],
                )

    group = [F.col("_group").cast(queries.schema[on].dataType).alias(on)] if on else []
    return known.mapInArrow(run, shape).select("query_id", *group, "rows_met", "rows_total")
