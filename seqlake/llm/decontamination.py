"""Benchmark decontamination: BM25 retrieval of test items by every training passage, then verification.

Test items are cut into segments of at most ``SEGMENT`` words. Each posting holds its BM25 impact as a
share of what the segment scores against itself, so one threshold fits all segments. Postings lie in
blocks of ``BLOCK`` segments with the largest impact of each block. Training documents are read in
passages of two segments' length, a segment's length apart, so that every segment lies whole in some
passage. As in block-max WAND a passage first adds up the largest impacts of its terms, then, if that
reaches the threshold, those of each block, and only blocks that reach it are scored. All segments at or
above the threshold are retrieved; none is lost to a top k.

A retrieved item is verified against the whole document: at least ``OVERLAP`` of the five-word shingles of
its question, and of its answer, must occur there.

Statistics are taken over all items in Spark. Index shards of about ``SHARD_POSTINGS`` postings are built in tasks and
written to the shared folder. One at a time is loaded and sent to the tasks, and read past all documents; if there are
several, what each leaves is written before the next is loaded, so neither the driver nor a task holds two.

Question and answer: the answer begins after a line or word ``Answer:`` or ``A:``, else after the last
question mark that text follows, else with the last sentence; an item of one sentence is a question only.

Defined cases: null or empty items and items without doc partners match nothing; null and empty documents
match nothing and are kept; rows without doc_id are searched; repeated rows are searched one by one;
of items with equal text each is reported; further columns are ignored by ``find`` and kept by
``drop_contaminated``; empty tables give no matches.
"""

from __future__ import annotations

import pickle
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import slices, stored, word_hashes, words
from seqlake.llm.passages import gram_hashes

K1, B = 1.2, 0.75
SEGMENT = 64
BLOCK = 64
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
SHARD_POSTINGS = 500_000
_EDGES = string.punctuation + "«»„“”‘’…¿¡–—"
_ANSWER = re.compile(r"(?:^|\s)(?:answer|a):\s", re.IGNORECASE)
_SENTENCE = re.compile(r"[.!?]\s+(?=\S)")


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, in lower case and without marks at their edges; number per text."""
    flat, counts = words(pc.utf8_lower(texts))
    return word_hashes(pc.utf8_trim(flat, characters=_EDGES)), counts


def question_and_answer(text: str) -> tuple[str, str]:
    marks = list(_ANSWER.finditer(text))
    if marks:
        return text[: marks[-1].start()], text[marks[-1].end() :]
    asked = text.rstrip().rstrip("?").rfind("?")
    if asked >= 0:
        return text[: asked + 1], text[asked + 1 :]
    ends = list(_SENTENCE.finditer(text))
    return (text[: ends[-1].end()], text[ends[-1].end() :]) if ends else (text, "")


def shingles(values: np.ndarray) -> np.ndarray:
    """Different hashes of five words in a row; of fewer words, one of all."""
    return np.unique(gram_hashes(values, min(SHINGLE, len(values)))) if len(values) else values


def _postings(items: DataFrame) -> DataFrame:
    """(item_id, segment, term, impact): impacts as shares of the segment's own score."""

    def work(batches):
        for batch in batches:
            values, counts = terms(batch.column("text"))
            begins = np.cumsum(counts) - counts
            rows = []
            for item, key, start, count in zip(*(c.to_pylist() for c in batch.columns[:2]), begins, counts):
                for part in range(-(-int(count) // SEGMENT)):
                    own = values[start + part * SEGMENT : start + min((part + 1) * SEGMENT, count)]
                    for term, times in zip(*np.unique(own.view(np.int64), return_counts=True)):
                        rows.append((item, key, part, int(term), int(times), len(own)))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            names = ["item_id", "item_key", "part", "term", "times", "size"]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = "item_id bigint, item_key bigint, part int, term bigint, times int, size int"
    found = stored(items.select("item_id", "item_key", "text").mapInArrow(work, schema), "terms")
    segment = ["item_id", "item_key", "part"]
    number, average = found.groupBy(*segment).agg(F.first("size").alias("size")).agg(F.count("*"), F.avg("size")).first()
    common = found.groupBy("term").agg(F.count("*").alias("n"))
    idf = F.log(1 + (F.lit(number) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    impact = idf * F.col("times") * (K1 + 1) / (F.col("times") + K1 * (1 - B + B * F.col("size") / F.lit(average or 1.0)))
    weighted = found.join(common, "term").withColumn("impact", impact)
    own = F.sum("impact").over(Window.partitionBy(*segment))
    return weighted.select(*segment, "term", (F.col("impact") / own).cast("float").alias("impact"))


@dataclass
class Shard:
    """Postings in order of term and segment, their blocks, and what verification needs of each item."""

    terms: np.ndarray
    bounds: np.ndarray
    segments: np.ndarray
    impacts: np.ndarray
    largest: np.ndarray
    block_bounds: np.ndarray
    blocks: np.ndarray
    block_largest: np.ndarray
    block_start: np.ndarray
    block_size: np.ndarray
    n_segments: int
    item_of: np.ndarray
    items: list[tuple[int, np.ndarray, np.ndarray]]

    def retrieve(self, values: np.ndarray, counts: np.ndarray, threshold: float) -> list[dict[int, float]]:
        """For each document, the items that a passage of it retrieves, with the best score."""
        out: list[dict[int, float]] = [{} for _ in counts]
        place = np.searchsorted(self.terms, values)
        known = np.flatnonzero(self.terms[np.minimum(place, len(self.terms) - 1)] == values) if len(self.terms) else place[:0]
        if not len(known):
            return out
        # Passages are numbered across the documents; a word lies in two of them.
        begins = np.cumsum(counts) - counts
        document = np.repeat(np.arange(len(counts)), counts)[known]
        first = np.cumsum(counts // SEGMENT + 2) - (counts // SEGMENT + 2)
        later = first[document] + (known - begins[document]) // SEGMENT + 1
        n_terms = len(self.terms)
        pairs = np.unique(np.concatenate([later, later - 1]) * n_terms + np.tile(place[known], 2))
        passage, term = pairs // n_terms, pairs % n_terms
        bound = np.bincount(passage, weights=self.largest[term])
        hopeful = bound[passage] >= threshold
        passage, term = passage[hopeful], term[hopeful]
        if not len(passage):
            return out
        n_blocks = -(-self.n_segments // BLOCK)
        at, block = _expand(self.block_bounds[term], self.block_bounds[term + 1])
        slot, slot_of = np.unique(passage[at] * n_blocks + self.blocks[block], return_inverse=True)
        bound = np.bincount(slot_of, weights=self.block_largest[block])
        hopeful = bound[slot_of] >= threshold
        at, block = at[hopeful], block[hopeful]
        where, posting = _expand(self.block_start[block], self.block_start[block] + self.block_size[block])
        slot, slot_of = np.unique(passage[at][where] * self.n_segments + self.segments[posting], return_inverse=True)
        score = np.bincount(slot_of, weights=self.impacts[posting], minlength=len(slot))
        for found in np.flatnonzero(score >= threshold):
            owner = int(np.searchsorted(first, slot[found] // self.n_segments, side="right")) - 1
            item = int(self.item_of[slot[found] % self.n_segments])
            out[owner][item] = max(out[owner].get(item, 0.0), float(score[found]))
        return out

    def verify(self, item: int, present: np.ndarray) -> tuple[float, float]:
        """Shares of the item's question and answer shingles among those of the document; 1 for no answer."""
        _, question, answer = self.items[item]
        return tuple(float(np.isin(part, present).mean()) if len(part) else 1.0 for part in (question, answer))


def _expand(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each start to before its end, with the number of the range."""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _build(postings: list, items: list) -> Shard:
    """``postings``: (item_id, item_key, part, term, impact); ``items``: (item_id, item_key, text)."""
    names = {(item, key): number for number, (item, key, _) in enumerate(items)}
    segments = sorted({(names[p[0], p[1]], p[2]) for p in postings})
    number = {segment: n for n, segment in enumerate(segments)}
    rows = sorted((np.uint64(p[3] & (1 << 64) - 1), number[names[p[0], p[1]], p[2]], p[4]) for p in postings)
    term = np.array([r[0] for r in rows], np.uint64)
    segment = np.array([r[1] for r in rows], np.int64)
    impact = np.array([r[2] for r in rows], np.float64)
    unique, starts = np.unique(term, return_index=True)
    bounds = np.append(starts, len(term))
    # A block entry for each term and block of segments.
    change = np.ones(len(term), bool)
    change[1:] = (term[1:] != term[:-1]) | (segment[1:] // BLOCK != segment[:-1] // BLOCK)
    block_start = np.flatnonzero(change)
    maximum = lambda cuts: np.maximum.reduceat(impact, cuts) if len(cuts) else impact
    parts = []
    for item, _, text in items:
        halves = []
        for half in question_and_answer(text):
            halves.append(shingles(terms(pa.array([half]))[0]))
        parts.append((item, *halves))
    return Shard(
        unique, bounds, segment, impact, maximum(starts), np.searchsorted(block_start, bounds),
        segment[block_start] // BLOCK, maximum(block_start), block_start,
        np.diff(np.append(block_start, len(term))), len(segments), np.array([s[0] for s in segments], np.int64), parts,
    )


class Shards:
    """Index shards of whole items, built and kept in a table; one is loaded at a time."""

    def __init__(self, table: DataFrame):
        self.table = table
        self.numbers = sorted(row["shard"] for row in table.select("shard").collect())

    def __len__(self) -> int:
        return len(self.numbers)

    def __iter__(self) -> Iterator[Shard]:
        for number in self.numbers:
            yield Shard(**pickle.loads(self.table.filter(F.col("shard") == number).first()["built"]))


def _built(key: tuple, postings: pa.Table, items: pa.Table) -> pa.Table:
    rows = [tuple(row.values()) for row in postings.drop_columns("shard").to_pylist()]
    texts = sorted((tuple(row.values()) for row in items.drop_columns("shard").to_pylist()), key=repr)
    built = [pickle.dumps(vars(_build(rows, texts)))] if rows else []
    return pa.table({"shard": pa.array([key[0].as_py()] * len(built), pa.int64()), "built": pa.array(built, pa.binary())})


def shards(benchmark: DataFrame, most: int = SHARD_POSTINGS) -> Shards:
    """Index shards of whole items, of about ``most`` postings each, built in tasks and written to the shared folder."""
    items = benchmark.select(
        F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")
    ).filter(F.col("text").isNotNull()).withColumn("item_key", F.xxhash64("text")).distinct()
    items = stored(items, "items")
    postings = stored(_postings(items), "postings")
    number = 1 + postings.count() // most
    shard = F.pmod(F.xxhash64("item_id", "item_key"), F.lit(number)).cast("bigint").alias("shard")
    # A group is a bounded number of postings and the texts they come from.
    parts = postings.select(shard, "item_id", "item_key", "part", "term", "impact").groupBy("shard")
    texts = items.select(shard, "item_id", "item_key", "text").groupBy("shard")
    return Shards(stored(parts.cogroup(texts).applyInArrow(_built, "shard bigint, built binary"), "shards"))


def _matches(shard: Shard, batch: pa.RecordBatch, threshold: float, overlap: float):
    """(row, item, score, question overlap, answer overlap) of verified items."""
    values, counts = terms(batch.column("text"))
    ends = np.cumsum(counts)
    for row, found in enumerate(shard.retrieve(values, counts, threshold)):
        if found:
            present = shingle_set(values[ends[row] - counts[row] : ends[row]])
            for item, score in sorted(found.items()):
                question, answer = shard.verify(item, present)
                if question >= overlap and answer >= overlap:
                    yield row, shard.items[item][0], score, question, answer


def shingle_set(values: np.ndarray) -> np.ndarray:
    """All shingles of one to five words of a document: short answers are one shingle of fewer words."""
    return np.concatenate([gram_hashes(values, size) for size in range(1, SHINGLE + 1)])


_FOUND = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"


def find(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, most: int = SHARD_POSTINGS
) -> DataFrame:
    """One row for each document and item found in it."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def search(shard):
        def work(batches):
            for whole in batches:
                for batch in slices(whole, "text", 1 << 20):
                    found = list(zip(*_matches(shard, batch, threshold, overlap))) or [()] * 5
                    ids = batch.column("doc_id").take(pa.array(found[0], pa.int64()))
                    columns = [pa.array(found[1], pa.int64())] + [pa.array(c, pa.float64()) for c in found[2:]]
                    yield pa.RecordBatch.from_arrays(
                        [ids, *columns], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
                    )

        return rows.mapInArrow(work, _FOUND)

    out = None
    index = shards(benchmark, most)
    for shard in index:
        # Of several shards each is done with before the next is loaded.
        found = search(shard) if len(index) == 1 else stored(search(shard), "found")
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], _FOUND) if out is None else out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, most: int = SHARD_POSTINGS
) -> DataFrame:
    """The rows of ``docs``, all columns, without those in which an item is found."""

    def clean(shard):
        def work(batches):
            for whole in batches:
                for batch in slices(whole, "text", 1 << 20):
                    keep = np.ones(batch.num_rows, bool)
                    for row, *_ in _matches(shard, batch, threshold, overlap):
                        keep[row] = False
                    yield batch.filter(pa.array(keep))

        return work

    index = shards(benchmark, most)
    for shard in index:
        docs = docs.mapInArrow(clean(shard), docs.schema)
        # Of several shards each is done with before the next is loaded.
        docs = docs if len(index) == 1 else stored(docs, "clean")
    return docs
