"""Packing documents into token sequences of a fixed size by bin completion.

A document is the ids of its text and one end id; only longer ones are cut, into full pieces and a rest.
How pieces are combined depends on their lengths alone, and there are at most ``size`` different ones. So
Spark counts the pieces of each length, the search runs over those counts, and its patterns (lengths that
share a sequence, and how often) are dealt out to the numbered pieces of each length. The result is one
packing of the whole table, whatever its partitions are.

The search takes the largest length left and looks for the filling of the room beside it with the least
waste, larger pieces first. It starts from the best-fit filling, branches over the lengths that still fit,
cuts branches whose bound on waste is no better, and ends at a perfect filling or after ``NODES``
branches. A filling that another one dominates (a larger piece fits where it has several) gives way to that one.
A pattern is used as often as its scarcest length allows. Only one filling is followed for each sequence: other
ones, and what they leave for later sequences, are not tried.

Defined cases: null and empty text is the end id alone; a row without doc_id is packed; repeated rows are
packed as often as they occur; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from bisect import bisect_right
from collections import Counter
from itertools import accumulate, chain
from types import ModuleType

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import slices, stored, words

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SIZE = 2048
END = 0
# Branches looked at for one filling.
NODES = 2000
# Different words whose ids a worker keeps, for its later tasks too.
CACHE_WORDS = 300_000
# Pieces of one length that are numbered together.
NUMBERED_ROWS = 1000


# Words of printable ASCII and Latin-1 letters, and how the tokenizer cuts them in lower case.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies use for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [byte for byte in range(256) if byte not in own]
    return {byte: chr(byte) for byte in own} | {byte: chr(256 + i) for i, byte in enumerate(rest)}


class WordEncoder:
    """Ids of whole texts, encoding each different word once.

    The tokenizer drops white space and never looks across it, so a text's ids are those of its words in
    a row. Plain words are cut here and only their parts go to the tokenizer's model, which saves most of
    the time; all others, and tokenizers that cut otherwise, take the tokenizer's own way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        made = json.loads(self.tokenizer.to_str())
        steps = (made["normalizer"] or {}).get("normalizers", []), (made["pre_tokenizer"] or {}).get("pretokenizers", [])
        cut = [step.get("pattern", {}).get("Regex") for step in steps[1]]
        self.plain = (
            [step["type"] for step in steps[0]] == ["NFC", "Replace", "Lowercase"]
            and [step["type"] for step in steps[1]] == ["Split", "ByteLevel"]
            and cut[0] == _SPLIT and not steps[1][1]["add_prefix_space"] and made["model"]["type"] == "BPE"
        )
        self.letters = _byte_letters()
        self._clear()

    def _part(self, part: str) -> list[int]:
        ids = self.parts.get(part)
        if ids is None:
            written = part.encode().decode("latin-1").translate(self.letters)
            ids = self.parts[part] = [token.id for token in self.model.tokenize(written)]
        return ids

    def _clear(self) -> None:
        self.parts: dict[str, list[int]] = {}
        self.place: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, new: list[str]) -> None:
        found: list[list[int]] = [[]] * len(new)
        others = []
        for number, word in enumerate(new):
            if self.plain and _PLAIN.fullmatch(word) and "<|" not in word:
                parts = _PART.findall(word.lower())
                found[number] = self._part(parts[0]) if len(parts) == 1 else sum(map(self._part, parts), [])
            else:
                others.append(number)
        encoded = self.tokenizer.encode_batch_fast([new[number] for number in others], add_special_tokens=False)
        for number, one in zip(others, encoded):
            found[number] = one.ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        self.place.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the end id, and their number per text."""
        flat, counts = words(texts)
        coded = flat.dictionary_encode()
        known = coded.dictionary.to_pylist()
        if len(self.place) > CACHE_WORDS:
            self._clear()
        new = [word for word in known if word not in self.place]
        if new:
            self._learn(new)
        places = np.fromiter(map(self.place.__getitem__, known), np.int64, len(known))
        places = places[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else places
        sizes = self.sizes[places]
        before = np.cumsum(sizes) - sizes
        ids = self.ids[np.repeat(self.starts[places] - before, sizes) + np.arange(int(sizes.sum()))]
        total = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        lengths = total[bounds[1:]] - total[bounds[:-1]]
        out = np.full(len(ids) + len(lengths), END, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths)] = ids
        return out, lengths + 1


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this worker process; tasks that follow find the words of those before."""
    held = sys.modules.setdefault("seqlake_word_encoders", ModuleType("seqlake_word_encoders"))
    if path not in vars(held):
        setattr(held, path, WordEncoder(path))
    return getattr(held, path)


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, size: int = SIZE, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""

    def work(batches):
        encoder = worker_encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, lengths = encoder.encode(batch.column("text"))
                ends = np.cumsum(lengths)
                number = -(-lengths // size)
                row = np.repeat(np.arange(len(lengths)), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * size
                length = np.minimum(size, lengths[row] - start)
                at = ends[row] - lengths[row] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
                columns = [
                    batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start),
                    pa.array(length), pa.array(sums, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, _PIECES + (", ids array<int>" if with_ids else ""))


def best_filling(room: int, lengths: list[int], counts: dict[int, int], nodes: int = NODES) -> list[int]:
    """Lengths that fill ``room`` with the least waste. ``lengths``: those left, in rising order."""
    # Incumbent: best fit, the largest that still fits, again and again.
    best: list[int] = []
    left = room
    high = len(lengths)
    while high := bisect_right(lengths, left, 0, high):
        length = lengths[high - 1]
        times = min(left // length, counts[length])
        best += [length] * times
        left -= length * times
        if left >= length:
            high -= 1
    waste, seen = left, 0
    if not waste:
        return best

    # No more than this can be filled with the lengths up to a place.
    most = list(accumulate(length * min(counts[length], room // length) for length in lengths))

    # A step takes one length, as often as it says: at most as deep as different lengths fit beside each other.
    def search(left: int, high: int, chosen: list[int]) -> bool:
        """Try all fillings of ``left`` with ``lengths[:high]``; true once nothing is wasted or nodes run out."""
        nonlocal best, waste, seen
        high = bisect_right(lengths, left, 0, high)
        while high and left - most[high - 1] < waste:
            high -= 1
            length = lengths[high]
            for times in range(min(left // length, counts[length]), 0, -1):
                seen += 1
                if seen > nodes:
                    return True
                rest, taken = left - length * times, chosen + [length] * times
                if rest < waste:
                    waste, best = rest, taken
                    if not waste:
                        return True
                if high and rest >= lengths[0] and search(rest, high, taken):
                    return True
        return False

    search(room, len(lengths), [])
    return undominated(best, waste, lengths, counts) if waste else best


def undominated(filling: list[int], waste: int, lengths: list[int], counts: dict[int, int]) -> list[int]:
    """Put a larger piece in place of several (or of a smaller one) as long as it fits in their room and ``waste``.

    Whatever packs the other pieces then packs those it replaces too, so the filling is as good or better. A complete
    search ends at such a filling by itself: larger pieces come first, and only less waste replaces the best.
    """
    filling = list(filling)
    while True:
        # For each sum the places of pieces that make it, several rather than one.
        sums: dict[int, tuple[int, ...]] = {0: ()}
        for place, length in enumerate(filling):
            for total, places in list(sums.items()):
                if len(sums.get(total + length, ())) < 2:
                    sums[total + length] = (*places, place)
        used = Counter(filling)
        # Several pieces of the same sum are replaced too, and one piece by a larger one.
        found = next(
            (
                (length, total) for length in reversed(lengths) if used[length] < counts[length]
                for total in range(length, max(0, length - waste - 1), -1)
                if total in sums and [filling[place] for place in sums[total]] != [length]
            ),
            None,
        )
        if found is None:
            return filling
        length, total = found
        gone = set(sums[total])
        filling = sorted([length, *(own for place, own in enumerate(filling) if place not in gone)], reverse=True)
        waste -= length - total


def bin_completion(counts: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one sequence, how often) that use up ``counts`` pieces of each length."""
    left = {length: count for length, count in counts.items() if count}
    lengths = sorted(left)
    plan: list[tuple[list[int], int]] = []
    while lengths:
        largest = lengths[-1]
        left[largest] -= 1
        beside = [length for length in lengths if left[length]] if not left[largest] else lengths
        pattern = [largest, *(best_filling(size - largest, beside, left) if beside else [])]
        left[largest] += 1
        need = {length: pattern.count(length) for length in set(pattern)}
        times = min(left[length] // n for length, n in need.items())
        for length, n in need.items():
            left[length] -= n * times
            if not left[length]:
                lengths.remove(length)
        plan.append((pattern, times))
    return plan


def _slots(plan: list[tuple[list[int], int]]):
    """Which numbers of a length go where: (length, first number, sequence of the first, offset), in order."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            rows.append((length, taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + times
            offset += length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def assign(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to ``rows`` of ``pieces``."""
    # At most ``size`` rows, whatever the table.
    histogram = {row["length"]: row["n"] for row in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(bin_completion(histogram, size))
    keys = slots[:, 0] << 44 | slots[:, 1]
    # Pieces of a common length are numbered in shares; a share's first number is the sum of those before.
    shares = F.element_at(F.lit([1 + histogram.get(n, 0) // NUMBERED_ROWS for n in range(1, size + 1)]), F.col("length").cast("int"))
    dealt = rows.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), shares))
    inside = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("number", F.row_number().over(inside) - 1)
    sizes = dealt.groupBy("length", "share").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("length", "share", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    placed = numbered.join(begins, ["length", "share"]).withColumn("number", F.col("begin") + F.col("number"))

    def work(batches):
        for batch in batches:
            number = batch.column("number").to_numpy()
            slot = np.searchsorted(keys, batch.column("length").to_numpy() << 44 | number, side="right") - 1
            sequence = slots[slot, 2] + number - slots[slot, 1]
            kept = [name for name in batch.schema.names if name != "number"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in kept] + [pa.array(sequence), pa.array(slots[slot, 3])],
                names=[*kept, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return placed.select(*rows.columns, "number").mapInArrow(work, f"{schema}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, size: int = SIZE, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """All pieces of ``docs`` with their place: sequences of at most ``size`` ids, filled without gaps."""
    return assign(stored(pieces(docs, size, tokenizer, with_ids), "pieces"), size)
