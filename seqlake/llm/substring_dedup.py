"""Substring deduplication with suffix automata of reference shards.

A word is removed if a window of ``window`` words that covers it also starts in a document with a
smaller doc_id. The reference is the corpus itself, cut into shards small enough to be matched in
memory: passages of one anchor (see ``passages``) form the reference for that anchor, shards are runs
of anchors, and a document is streamed past only the shards that can match it. Nothing that grows
with the corpus is sent to every task.

Equal passages are matched once, for all their copies. An anchor with more than ``SHARD_WORDS`` words
of different passages (a common line in many contexts) is cut into single windows, dealt out by the
window; equal windows meet in one shard whatever the contexts are.

Defined cases: null or empty text gives no words and the digest of the empty string; a row without
doc_id is kept whole and is nobody's reference; repeated rows of one doc_id do not remove each other;
rows with one doc_id and different texts are judged one by one; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import slices, stored, word_hashes, words
from seqlake.llm.passages import (
    WINDOW, anchored_runs, gram_hashes, keyed_texts, list_column, merged_spans, span_hashes,
)

# Words of one automaton, and of the passages of an anchor that stay whole.
SHARD_WORDS = 20_000
_NOBODY = 1 << 63


class SuffixAutomaton:
    """All substrings of the words added, each state with the smallest document that has it."""

    def __init__(self, window: int):
        self.window = window
        self.steps: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first = [_NOBODY]
        self.words = 0

    def _state(self, steps: dict[int, int], link: int, length: int) -> int:
        self.steps.append(steps)
        self.link.append(link)
        self.length.append(length)
        self.first.append(_NOBODY)
        return len(self.steps) - 1

    def _split(self, parent: int, word: int, state: int) -> int:
        """The state of the longest string of ``parent`` followed by ``word``."""
        if self.length[parent] + 1 == self.length[state]:
            return state
        copy = self._state(dict(self.steps[state]), self.link[state], self.length[parent] + 1)
        self.link[state] = copy
        while parent >= 0 and self.steps[parent].get(word) == state:
            self.steps[parent][word] = copy
            parent = self.link[parent]
        return copy

    def add(self, sequence: list[int], document: int) -> None:
        last = 0
        for word in sequence:
            known = self.steps[last].get(word)
            if known is not None:
                last = self._split(last, word, known)
            else:
                new = self._state({}, 0, self.length[last] + 1)
                parent = last
                while parent >= 0 and word not in self.steps[parent]:
                    self.steps[parent][word] = new
                    parent = self.link[parent]
                if parent >= 0:
                    self.link[new] = self._split(parent, word, self.steps[parent][word])
                last = new
            if document < self.first[last]:
                self.first[last] = document
        self.words += len(sequence)

    def finish(self) -> None:
        """Hand the smallest document down the links; find the state of each window-long suffix."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for state in reversed(order):
            link = self.link[state]
            if self.first[state] < self.first[link]:
                self.first[link] = self.first[state]
        self.suffix = list(range(len(self.length)))
        for state in order:
            if self.length[self.link[state]] >= self.window:
                self.suffix[state] = self.suffix[self.link[state]]

    def match(self, sequence: list[int]) -> list[tuple[int, int, int]]:
        """(first window, windows, document) of consecutive windows found, with their smallest document."""
        out: list[tuple[int, int, int]] = []
        state = length = 0
        for place, word in enumerate(sequence, 1 - self.window):
            while state and word not in self.steps[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.steps[state]:
                state = self.steps[state][word]
                length += 1
            if length >= self.window:
                document = self.first[self.suffix[state]]
                if out and out[-1][2] == document and out[-1][0] + out[-1][1] == place:
                    out[-1] = (out[-1][0], out[-1][1] + 1, document)
                else:
                    out.append((place, 1, document))
        return out


_PIECES = "anchor bigint, content bigint, offset int, shard bigint, piece bigint, words binary, doc_id bigint"
_SPANS = "array<struct<offset:int,windows:int,doc_id:bigint>>"


def _cut_pieces(window: int):
    """The words of the wanted runs; those of crowded anchors as single windows."""

    def work(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                flat, counts = words(batch.column("text"))
                values = word_hashes(flat)
                windows = gram_hashes(values, window)
                begins = np.cumsum(counts) - counts
                bounds, runs = list_column(batch, "runs")
                rows = zip(*(runs.field(i).to_pylist() for i in range(5)))
                ids = batch.column("doc_id").to_pylist()
                out: list[tuple] = []
                owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                for row, (anchor, content, start, size, crowded) in zip(owner, rows):
                    at = int(begins[row]) + start
                    if not crowded:
                        sequence = values[at : at + size + window - 1].tobytes()
                        out.append((anchor, content, 0, anchor, content, sequence, ids[row]))
                        continue
                    for offset in range(size):
                        piece = int(windows[at + offset].view(np.int64))
                        sequence = values[at + offset : at + offset + window].tobytes()
                        out.append((anchor, content, offset, piece, piece, sequence, ids[row]))
                    if len(out) > 20_000:
                        yield _piece_batch(out)
                        out = []
                yield _piece_batch(out)

    return work


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 7
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    names = ["anchor", "content", "offset", "shard", "piece", "words", "doc_id"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _match_shards(window: int, most: int):
    """Gather passages up to ``most`` words, whole anchors at least, and match them with each other."""
    kind = pa.list_(pa.struct([("offset", pa.int32()), ("windows", pa.int32()), ("doc_id", pa.int64())]))

    def matched(held):
        automaton = SuffixAutomaton(window)
        for _, _, sequence, document in held:
            automaton.add(sequence, document)
        automaton.finish()
        spans = [
            [dict(offset=o, windows=n, doc_id=d) for o, n, d in automaton.match(sequence)]
            for _, _, sequence, _ in held
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()),
             pa.array(spans, kind)],
            names=["shard", "piece", "spans"],
        )

    def work(batches):
        held, size = [], 0
        for batch in batches:
            for shard, piece, raw, document in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= most and shard != held[-1][0]:
                    yield matched(held)
                    held, size = [], 0
                sequence = np.frombuffer(raw, np.uint64).tolist()
                held.append((shard, piece, sequence, document))
                size += len(sequence)
        if held:
            yield matched(held)

    return work


def repeated_spans(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, text_key and the spans of windows that start in a document with a smaller doc_id."""
    runs = stored(anchored_runs(docs, window), "runs")
    shared = (
        runs.groupBy("anchor")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .filter("low < high")
        .select("anchor")
    )
    # Grouped sides are written before they are joined: a join of plain shuffles splits hot keys.
    members = stored(runs.join(stored(shared, "shared"), "anchor"), "members")
    classes = members.groupBy("anchor", "content").agg(
        F.min(F.struct("doc_id", "text_key", "start", "windows")).alias("one")
    )
    classes = stored(classes, "classes")
    crowded = (
        classes.groupBy("anchor")
        .agg(F.sum(F.col("one.windows") + window - 1).alias("n"))
        .filter(F.col("n") > shard_words)
        .select("anchor", F.lit(True).alias("crowded"))
    )
    wanted = (
        classes.join(stored(crowded, "crowded"), "anchor", "left")
        .groupBy("one.doc_id", "one.text_key")
        .agg(
            F.collect_list(
                F.struct("anchor", "content", "one.start", "one.windows", F.coalesce("crowded", F.lit(False)))
            ).alias("runs")
        )
    )
    texts = docs.join(wanted, ["doc_id", "text_key"]).select("doc_id", "text", "runs")
    pieces = stored(texts.mapInArrow(_cut_pieces(window), _PIECES), "pieces")
    matched = (
        pieces.groupBy("shard", "piece")
        .agg(F.min(F.struct("doc_id", "words")).alias("one"))
        .select("shard", "piece", "one.words", "one.doc_id")
        .repartition("shard")
        .sortWithinPartitions("shard")
        .mapInArrow(_match_shards(window, shard_words), f"shard bigint, piece bigint, spans {_SPANS}")
    )
    found = (
        pieces.select("anchor", "content", "offset", "shard", "piece")
        .join(matched, ["shard", "piece"])
        .select(
            "anchor",
            "content",
            F.expr("transform(spans, s -> struct(s.offset + offset AS offset, s.windows, s.doc_id))").alias("spans"),
        )
        .groupBy("anchor", "content")
        .agg(F.flatten(F.collect_set("spans")).alias("spans"))
    )
    return (
        members.join(stored(found, "found"), ["anchor", "content"])
        .select(
            "doc_id",
            "text_key",
            F.expr(
                "transform(filter(spans, s -> s.doc_id < doc_id), s -> struct(start + s.offset AS start,"
                f" s.windows + {window - 1} AS size))"
            ).alias("spans"),
        )
        .filter(F.size("spans") > 0)
        .groupBy("doc_id", "text_key")
        .agg(F.flatten(F.collect_set("spans")).alias("spans"))
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Every row of ``docs``: doc_id, kept (the words left, joined by a space), n_words, n_removed, spans.

    ``spans`` are the maximal removed spans as (start, end) word numbers, end exclusive.
    """
    texts = keyed_texts(docs)
    spans = repeated_spans(texts, window, shard_words)
    schema = "doc_id bigint, kept string, n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def work(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                bounds, found = list_column(batch, "spans")
                starts, sizes = found.field(0).to_pylist(), found.field(1).to_pylist()
                kept, totals, removed, merged = [], [], [], []
                for row, text in enumerate(batch.column("text").to_pylist()):
                    tokens = (text or "").encode().split()
                    low, high = bounds[row], bounds[row + 1]
                    spans = merged_spans(starts[low:high], sizes[low:high])
                    left, at = [], 0
                    for start, end in spans:
                        left += tokens[at:start]
                        at = end
                    left += tokens[at:]
                    kept.append(b" ".join(left).decode())
                    totals.append(len(tokens))
                    removed.append(len(tokens) - len(left))
                    merged.append([dict(start=s, end=e) for s, e in spans])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(totals, pa.int64()),
                     pa.array(removed, pa.int64()), pa.array(merged, kind)],
                    names=["doc_id", "kept", "n_words", "n_removed", "spans"],
                )

    rows = texts.join(spans, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(work, schema)


