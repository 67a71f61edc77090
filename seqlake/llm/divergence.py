"""How the sources of a language differ in their words: divergence of every two sources, and telling terms.

Terms are runs of letters (see ``terms``), of which a language keeps those in at least ``MIN_DOCS`` of its
documents. A group, that is a source of a language, gives each kept term the smoothed share
``p = 1 + floor(SCALE * (count + 1) / (N + V))``: N counts the kept terms it holds, V the kept terms. The divergence
of p from q is the sum of ``floor((p - q)^2 / q)`` over all kept terms. Whole numbers throughout.

Most terms are missing in most groups, so the sum is built the way Gustavson multiplies sparse matrices. The counts
are one index, ordered by term and cut into blocks of terms. In a block, each group goes through its own terms and
adds, for every peer that holds the term, the difference from the zero baselines to a dense accumulator with a cell
for each peer. What a group's terms add against peers that lack them follows from how often each count occurs, and
the baseline of terms that both lack is one product. Only accumulators leave a block, never a pair of postings.

Bounds: a block holds about ``BLOCK`` postings, or as many as its accumulators have cells. More than ``TILE`` sources
are cut into tiles, and every tile of rows meets every tile of peers, so a task holds at most ``TILE`` squared cells.
Counts are summed inside a task's slice of text and again before the shuffle, so a source with a third of all rows
sends no more than one row for each of its terms and tasks. Sums hold while a language has fewer than 10^9 kept terms
and 9 * 10^15 occurrences.

Defined cases: null text, lang and source are read as the empty string; every row counts as a document, repeated ones
too, whatever its doc_id; a group without terms has N = 0; a language without kept terms gives its pairs with value 0;
a language of one source has no pairs; equal values are ranked by item; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import slices, stored
from seqlake.llm.terms import LETTERS, terms

MIN_DOCS = 3
TOP_TERMS = 200
BLOCK = 1 << 16
TILE = 512
# Texts whose terms are counted together, and the size up to which the table of groups is sent to all tasks.
COUNT_BYTES = 4 << 20
GROUP_BYTES = 32 << 20

_COUNTS = "lang string, source string, term string, n bigint, docs bigint"
_CELLS = "lang string, source string, item string, value bigint"


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Occurrences and documents of each term, by lang and source."""
    flat, sizes = terms(batch.column("text"), LETTERS)
    coded = flat.dictionary_encode()
    n_terms = max(1, len(coded.dictionary))
    row = np.repeat(np.arange(batch.num_rows), sizes)
    held, times = np.unique(row * n_terms + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    lang, source = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
    n_sources = max(1, len(source.dictionary))
    group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n_sources
    group += source.indices.to_numpy(zero_copy_only=False)
    cells, place, docs = np.unique(
        group[held // n_terms] * n_terms + held % n_terms, return_inverse=True, return_counts=True
    )
    n = np.bincount(place, weights=times, minlength=len(cells)).astype(np.int64)
    of_group = cells // n_terms
    return pa.RecordBatch.from_arrays(
        [
            lang.dictionary.take(pa.array(of_group // n_sources)),
            source.dictionary.take(pa.array(of_group % n_sources)),
            coded.dictionary.take(pa.array(cells % n_terms)),
            pa.array(n, pa.int64()),
            pa.array(docs.astype(np.int64), pa.int64()),
        ],
        names=["lang", "source", "term", "n", "docs"],
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", COUNT_BYTES):
            yield _counted(batch)


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, source, term, n, total, first``: how often a group holds a kept term, and its language does.

    ``first`` marks one row of each term of a language.
    """
    counts = docs.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )
    of_term = Window.partitionBy("lang", "term").orderBy("source")
    whole = of_term.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = counts.select(
        "lang", "source", "term", "n",
        F.sum("n").over(whole).alias("total"),
        F.sum("docs").over(whole).alias("in_docs"),
        (F.row_number().over(of_term) == 1).alias("first"),
    )
    return seen.filter(F.col("in_docs") >= min_docs).drop("in_docs")


def share(count: str, total: str, scale_steps: int = 3) -> Column:
    """1 + floor(10^9 * (count + 1) / total) without leaving 64 bits: three digits of the quotient at a time."""
    out, rest = f"(({count}) + 1) div ({total})", f"(({count}) + 1) % ({total})"
    for _ in range(scale_steps):
        out = f"({out}) * 1000 + (({rest}) * 1000) div ({total})"
        rest = f"(({rest}) * 1000) % ({total})"
    return F.expr(f"1 + {out}")


def group_table(docs: DataFrame, kept: DataFrame, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """A row for each group: its N as ``own``, its share of a missing term as ``zero``, and its language's figures.

    ``vocabulary`` is V and ``held`` the N of the language, ``tiles`` and ``blocks`` how its sources and terms are cut.
    """
    held = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("own"),
        F.count_if("first").alias("new"),
        F.sum(F.when(F.col("first"), F.col("total"))).alias("new_total"),
        F.count(F.lit(1)).alias("rows"),
    )
    groups = docs.select("lang", "source").distinct().join(held, ["lang", "source"], "left")
    groups = stored(groups.fillna(0, ["own", "new", "new_total", "rows"]), "group_sizes")
    languages = groups.groupBy("lang").agg(
        F.sum("new").alias("vocabulary"),
        F.sum("new_total").alias("held"),
        F.sum("rows").alias("rows"),
        F.count(F.lit(1)).alias("sources"),
    )
    cells = F.pow(F.least("sources", F.lit(tile)), F.lit(2))
    languages = languages.select(
        "lang", "vocabulary", "held",
        F.ceil(F.col("sources") / tile).cast("int").alias("tiles"),
        F.greatest(F.lit(1), F.ceil(F.col("rows") / F.greatest(F.lit(block), cells))).cast("int").alias("blocks"),
    )
    # A language without kept terms has nothing to divide.
    size = "greatest(own + vocabulary, 1)"
    out = groups.join(languages, "lang").withColumn("zero", share("0", size))
    out = out.withColumn("tile", F.pmod(F.xxhash64("source"), "tiles").cast("int"))
    return stored(
        out.select("lang", "source", "own", "vocabulary", "held", "tiles", "tile", "blocks", "zero",
                   (F.octet_length("lang") + F.octet_length("source") + 64).alias("bytes")),
        "groups",
    )


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def accumulate(table: pa.Table) -> pa.Table:
    """The cells of one block: every group of the tile ``a`` against every peer of the tile ``b``.

    Rows without a term name the groups of both tiles; the others are the postings of the block's terms.
    """
    a, b, block = (table.column(name)[0].as_py() for name in ("a", "b", "block"))
    tile = table.column("tile").to_numpy()
    source = table.column("source").combine_chunks()
    term = table.column("term").combine_chunks().dictionary_encode().indices
    posting = term.is_valid().to_numpy(zero_copy_only=False)
    share_of = table.column("p").to_numpy()

    def side(number: int):
        """Names and zero shares of a tile's groups, and its postings: place of the group, term, share."""
        mine = tile == number
        names = source.filter(pa.array(mine & ~posting))
        order = pc.array_sort_indices(names)
        names, zero = names.take(order), share_of[mine & ~posting][order.to_numpy()]
        at = mine & posting
        place = pc.index_in(source.filter(pa.array(at)), value_set=names).to_numpy(zero_copy_only=False)
        return names, zero, place.astype(np.int64), term.filter(pa.array(at)).to_numpy(zero_copy_only=False), share_of[at]

    rows, row_zero, row_place, row_term, row_share = side(a)
    peers, peer_zero, peer_place, peer_term, peer_share = (rows, row_zero, row_place, row_term, row_share) if a == b else side(b)
    base = _f(row_zero[:, None], peer_zero[None, :])
    cells = np.zeros(base.shape, np.int64)
    if block == 0:
        cells += base * table.column("vocabulary")[0].as_py()

    # The peers' index, by term.
    order = np.argsort(peer_term, kind="stable")
    peer_place, peer_share = peer_place[order], peer_share[order]
    starts = np.searchsorted(peer_term[order], np.arange(int(max(row_term.max(initial=-1), peer_term.max(initial=-1))) + 2))
    by_row = np.argsort(row_place, kind="stable")
    row_ends = np.searchsorted(row_place[by_row], np.arange(len(rows) + 1))
    for row in range(len(rows)):
        mine = by_row[row_ends[row] : row_ends[row + 1]]
        if not len(mine):
            continue
        held, own = row_term[mine], row_share[mine]
        # Its terms against peers that lack them: equal shares add the same.
        shares, times = np.unique(own, return_counts=True)
        cells[row] += (times[:, None] * (_f(shares[:, None], peer_zero[None, :]) - base[row])).sum(axis=0)
        # Peers that hold the term as well: scatter along the index.
        sizes = starts[held + 1] - starts[held]
        at = np.arange(sizes.sum()) + np.repeat(starts[held] - (np.cumsum(sizes) - sizes), sizes)
        p, q, peer = np.repeat(own, sizes), peer_share[at], peer_place[at]
        zero = row_zero[row]
        np.add.at(cells[row], peer, _f(p, q) - _f(p, peer_zero[peer]) - _f(zero, q) + base[row][peer])
    # A peer's terms against rows that lack them.
    by_peer = np.argsort(peer_place, kind="stable")
    peer_ends = np.searchsorted(peer_place[by_peer], np.arange(len(peers) + 1))
    for peer in range(len(peers)):
        shares, times = np.unique(peer_share[by_peer[peer_ends[peer] : peer_ends[peer + 1]]], return_counts=True)
        if len(shares):
            cells[:, peer] += (times * (_f(row_zero[:, None], shares[None, :]) - base[:, peer, None])).sum(axis=1)

    row, peer = np.indices(cells.shape).reshape(2, -1)
    other = np.ones(len(row), bool) if a != b else row != peer
    row, peer = row[other], peer[other]
    lang = pa.array([table.column("lang")[0].as_py()], pa.string()).take(pa.array(np.zeros(len(row), np.int64)))
    return pa.table({
        "lang": lang, "source": rows.take(pa.array(row)), "item": peers.take(pa.array(peer)),
        "value": pa.array(cells[row, peer], pa.int64()),
    })


def _ranked(cells: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return cells.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank")
    )


def audit(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    top_terms: int = TOP_TERMS,
    tile: int = TILE,
    block: int = BLOCK,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every group.

    Part ``pair`` ranks the other sources of the language by divergence, all of them; part ``term`` the ``top_terms``
    terms that the group holds more often than its language, by what they add to its divergence from the language.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    docs = docs.select(text("text"), text("lang"), text("source"))
    kept = stored(kept_terms(docs, min_docs), "kept_terms")
    groups = group_table(docs, kept, tile, block)
    small = (groups.agg(F.sum("bytes")).first()[0] or 0) <= group_bytes
    known = kept.join(F.broadcast(groups) if small else groups, ["lang", "source"])
    known = known.withColumn("p", share("n", "own + vocabulary")).withColumn("q", share("total", "held + vocabulary"))

    # Every unit (tile of rows, tile of peers, block) a posting or a group takes part in.
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    units = F.explode(F.concat(
        F.transform(every, lambda other: F.struct(F.col("tile").alias("a"), other.alias("b"))),
        F.transform(F.filter(every, lambda other: other != F.col("tile")),
                    lambda other: F.struct(other.alias("a"), F.col("tile").alias("b"))),
    )).alias("unit")
    postings = known.select(
        "lang", "source", "term", "p", "tile", "vocabulary",
        F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), units,
    )
    members = groups.select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"), "tile", "vocabulary",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "tiles",
    ).select("lang", "source", "term", "p", "tile", "vocabulary", "block", units)
    rows = postings.unionByName(members).select("*", "unit.a", "unit.b").drop("unit")
    cells = rows.groupBy("lang", "a", "b", "block").applyInArrow(accumulate, _CELLS)
    pairs = cells.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    telling = known.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q AS value"))
    top = _ranked(telling, "term").filter(F.col("rank") <= top_terms)
    return _ranked(pairs, "pair").unionByName(top)
