"""Quality by a generalised additive model with pairwise interactions, learned by cyclic boosting.

A text becomes the numbers of ``FEATURES``: shares of kinds of characters, words and lines, and how much of it
repeats. Each feature is cut into bins at quantiles of the fitting rows. The model is a lookup table for each feature
and for some pairs of features: boosting visits the features in turn, round after round, and adds a small step of a
shallow tree over that feature alone, fitted to the logistic loss; then the pairs whose trees explain most of what is
left are visited in the same way, with trees that cut both features. A score is the sum of the looked-up numbers
through the logistic function: additions of bins, no tree is walked.

Fitting uses a bounded sample of labelled rows outside the held-out fold, at most about ``TRAIN_DOCS`` of each label,
chosen by a hash of doc_id; only their feature numbers (8 bytes a feature) reach the driver. The share of each label
among all labelled rows corrects the starting score. Prediction reads every whole text and sees nothing but the text.

Defined cases: null text is empty text, and scores by its features as any other; a row without doc_id is scored, counts
as not held out and is not learned from; rows of ``labels`` without a document or a label are ignored; of several
labels of a document the largest counts; without training rows of both labels every score is the share of label 1
among them, 1 if there are none; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import slices, words
from seqlake.llm.language_id import fold

TRAIN_DOCS = 4000
FOLDS = 3
HELD_OUT = 1
THRESHOLD = 0.5
BINS = 32
PAIR_BINS = 12
PAIRS = 10
ROUNDS = 150
PAIR_ROUNDS = 60
RATE = 0.1
_RIDGE = 1.0
# The least weight of a leaf, as a sum of chance * (1 - chance).
_LEAST = 1.0
_SLICE_BYTES = 1 << 20

_UPPER, _LOWER, _DIGIT, _BLANK, _BREAK, _STOP, _QUOTE, _MARK, _WIDE, _INNER = range(10)
FEATURES = (
    "log_bytes", "log_words", "upper", "lower", "digit", "blank", "stop", "quote", "mark", "wide",
    "word_length", "longest_word", "with_letter", "capital_word", "shouted_word", "marked_word", "ended_word",
    "different_words", "repeated_next", "commonest_word", "line_words", "different_lines", "longest_line",
)


def _classes() -> np.ndarray:
    out = np.full(256, _MARK, np.uint8)
    for kind, members in (
        (_UPPER, range(65, 91)), (_LOWER, range(97, 123)), (_DIGIT, range(48, 58)), (_BLANK, b" \t"),
        (_BREAK, b"\n\r\x0b\x0c"), (_STOP, b".,;:?"), (_QUOTE, b"'\"()-"), (_INNER, range(0x80, 0xC0)),
        (_WIDE, range(0xC0, 0x100)),
    ):
        out[list(members)] = kind
    return out


_CLASS = _classes()


def _repeats(codes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the number of different codes and the count of the commonest."""
    held, times = np.unique(row * (int(codes.max(initial=0)) + 1) + codes, return_counts=True)
    of_row = held // (int(codes.max(initial=0)) + 1)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, of_row, times)
    return np.bincount(of_row, minlength=rows), most


def features(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    rows = len(texts)
    if rows == 0:
        return np.zeros((0, len(FEATURES)))
    texts = texts.cast(pa.string()).fill_null("")
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + rows + 1].astype(np.int64)
    codes = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if data is not None else np.zeros(0, np.uint8)
    sizes = np.diff(places)
    row = np.repeat(np.arange(rows), sizes)
    kinds = np.bincount(row * 16 + _CLASS[codes], minlength=rows * 16).reshape(rows, 16).astype(float)
    chars = np.maximum(kinds.sum(axis=1) - kinds[:, _INNER], 1)

    flat, n_words = words(texts)
    word_row = np.repeat(np.arange(rows), n_words)
    coded = flat.dictionary_encode()
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    known = coded.dictionary
    total = np.maximum(n_words, 1)

    def mean_of(values) -> np.ndarray:
        values = values.to_numpy(zero_copy_only=False).astype(float)
        return np.bincount(word_row, weights=values[word], minlength=rows) / total

    lengths = pc.utf8_length(known)
    longest = np.zeros(rows)
    np.maximum.at(longest, word_row, lengths.to_numpy(zero_copy_only=False)[word])
    matches = lambda pattern: mean_of(pc.match_substring_regex(known, pattern))
    different, most = _repeats(word, word_row, rows)
    same = (word[1:] == word[:-1]) & (word_row[1:] == word_row[:-1])
    repeated = np.bincount(word_row[1:][same], minlength=rows)

    lines = pc.split_pattern(texts, "\n")
    n_lines = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    line = pc.list_flatten(lines)
    line_row = np.repeat(np.arange(rows), n_lines)
    different_lines, _ = _repeats(line.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), line_row, rows)
    longest_line = np.zeros(rows)
    np.maximum.at(longest_line, line_row, pc.utf8_length(line).to_numpy(zero_copy_only=False))

    out = {
        "log_bytes": np.log1p(sizes), "log_words": np.log1p(n_words),
        "upper": kinds[:, _UPPER] / chars, "lower": kinds[:, _LOWER] / chars, "digit": kinds[:, _DIGIT] / chars,
        "blank": kinds[:, _BLANK] / chars, "stop": kinds[:, _STOP] / chars, "quote": kinds[:, _QUOTE] / chars,
        "mark": kinds[:, _MARK] / chars, "wide": kinds[:, _WIDE] / chars,
        "word_length": mean_of(lengths), "longest_word": np.log1p(longest),
        "with_letter": matches(r"\pL"), "capital_word": matches(r"^\p{Lu}"),
        "shouted_word": matches(r"^(\PL*\p{Lu}){2,}\PL*$"),
        "marked_word": matches(r"[^\pL\pN.,;:?!'\"()-]"), "ended_word": matches(r"[.!?]$"),
        "different_words": different / total, "repeated_next": repeated / total, "commonest_word": most / total,
        "line_words": np.log1p(n_words / n_lines), "different_lines": different_lines / n_lines,
        "longest_line": np.log1p(longest_line),
    }
    return np.column_stack([out[name] for name in FEATURES])


@dataclass
class GamModel:
    """Score: ``bias`` plus a number of each table, picked by the bins of its features."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    bias: float
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def scores(self, values: np.ndarray) -> np.ndarray:
        total = np.full(len(values), self.bias)
        for number, table in enumerate(self.tables):
            total += table[binned(values[:, number], self.edges[number])]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[binned(values[:, a], self.pair_edges[a]), binned(values[:, b], self.pair_edges[b])]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def binned(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, values, side="right")


def quantile_edges(values: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins - 1`` different cuts; a value equal to a cut lies above it."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="lower"))


def _leaf(gradient, hessian):
    return gradient / (hessian + _RIDGE)


def _gain(gradient, hessian):
    return gradient * gradient / (hessian + _RIDGE)


def _best_cut(gradient: np.ndarray, hessian: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins; place 0 if none is worth it."""
    if len(gradient) < 2:
        return 0.0, 0
    left, weight = np.cumsum(gradient)[:-1], np.cumsum(hessian)[:-1]
    right, rest = gradient.sum() - left, hessian.sum() - weight
    gain = _gain(left, weight) + _gain(right, rest) - _gain(gradient.sum(), hessian.sum())
    gain = np.where((weight >= _LEAST) & (rest >= _LEAST), gain, 0.0)
    place = int(gain.argmax())
    return (float(gain[place]), place + 1) if gain[place] > 1e-9 else (0.0, 0)


def line_tree(gradient: np.ndarray, hessian: np.ndarray, depth: int = 2) -> np.ndarray:
    """The steps of a tree of this depth over one feature, for each bin."""
    place = _best_cut(gradient, hessian)[1] if depth else 0
    if not place:
        return np.full(len(gradient), _leaf(gradient.sum(), hessian.sum()))
    return np.concatenate([
        line_tree(gradient[:place], hessian[:place], depth - 1), line_tree(gradient[place:], hessian[place:], depth - 1)
    ])


def pair_tree(gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, float]:
    """The steps of a tree over two features, for each pair of bins, and its gain: one cut, then the other feature's."""
    best, out = 0.0, np.full(gradient.shape, _leaf(gradient.sum(), hessian.sum()))
    for flip in (False, True):
        g, h = (gradient.T, hessian.T) if flip else (gradient, hessian)
        for place in range(1, len(g)):
            halves = [slice(0, place), slice(place, len(g))]
            steps, gain = np.empty(g.shape), -_gain(g.sum(), h.sum())
            if min(h[half].sum() for half in halves) < _LEAST:
                continue
            for half in halves:
                across, weight = g[half].sum(axis=0), h[half].sum(axis=0)
                more, cut = _best_cut(across, weight)
                gain += more + _gain(across.sum(), weight.sum())
                for part in (slice(0, cut), slice(cut, len(across))):
                    steps[half, part] = _leaf(across[part].sum(), weight[part].sum())
            if gain > best:
                best, out = gain, steps.T if flip else steps
    return out, best


def fit(values: np.ndarray, label: np.ndarray, prior: float | None = None) -> GamModel:
    """``prior``: the share of label 1 among all labelled rows, if the given ones were drawn by label."""
    if not len(label) or label.min() == label.max():
        none = 1.0 if not len(label) else float(label[0])
        return GamModel([], [], 60 * none - 30)
    n = values.shape[1]
    edges = [quantile_edges(values[:, number], BINS) for number in range(n)]
    tables = [np.zeros(len(cut) + 1) for cut in edges]
    place = [binned(values[:, number], edges[number]) for number in range(n)]
    base = label.mean()
    start = np.log(base / (1 - base))
    total = np.full(len(label), start)

    def push(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        chance = 1 / (1 + np.exp(-total))
        return (np.bincount(at, weights=label - chance, minlength=size),
                np.bincount(at, weights=chance * (1 - chance), minlength=size))

    for _ in range(ROUNDS):
        for number in range(n):
            step = RATE * line_tree(*push(place[number], len(tables[number])))
            tables[number] += step
            total += step[place[number]]

    pair_edges = [quantile_edges(values[:, number], PAIR_BINS) for number in range(n)]
    pair_place = [binned(values[:, number], pair_edges[number]) for number in range(n)]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(pair_edges[a]) + 1, len(pair_edges[b]) + 1
        at = pair_place[a] * shape[1] + pair_place[b]
        gradient, hessian = push(at, shape[0] * shape[1])
        return at, gradient.reshape(shape), hessian.reshape(shape)

    gains = [(pair_tree(*grid(a, b)[1:])[1], (a, b)) for a, b in combinations(range(n), 2)]
    pairs = [pair for gain, pair in sorted(gains, key=lambda found: (-found[0], found[1]))[:PAIRS] if gain > 0]
    pair_tables = [np.zeros((len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)) for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for number, (a, b) in enumerate(pairs):
            at, gradient, hessian = grid(a, b)
            step = RATE * pair_tree(gradient, hessian)[0]
            pair_tables[number] += step
            total += step.ravel()[at]
    if prior is not None and 0 < prior < 1:
        start += np.log(prior / (1 - prior)) - np.log(base / (1 - base))
    return GamModel(edges, tables, float(start), pair_edges, pairs, pair_tables)


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> GamModel:
    marks = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality")).filter(
        (fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("quality").isin(0, 1)
    )
    marks = marks.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sizes = {row["quality"]: row["n"] for row in marks.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    steps = 1 << 20
    chance = [min(steps, -(-train_docs * steps // max(1, sizes.get(label, 0)))) for label in (0, 1)]
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(steps))
    # About 2 x train_docs rows: the only ones whose texts are looked up.
    marks = marks.filter(drawn < F.when(F.col("quality") == 1, chance[1]).otherwise(chance[0]))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", _SLICE_BYTES):
                values = features(batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("quality"), pa.array([row.tobytes() for row in values], pa.binary())],
                    names=["quality", "numbers"],
                )

    found = rows.select("quality", "text").mapInArrow(work, "quality int, numbers binary").toArrow().to_pydict()
    examples = sorted(zip(found["numbers"], found["quality"]))
    values = np.frombuffer(b"".join(numbers for numbers, _ in examples), float).reshape(-1, len(FEATURES))
    return fit(values, np.array([label for _, label in examples], int), sizes.get(1, 0) / max(1, sum(sizes.values())))


def score(docs: DataFrame, model: GamModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", _SLICE_BYTES):
                values = model.scores(features(batch.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(values),
                     pa.array((values >= threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(work, "doc_id bigint, held_out boolean, score double, predicted int")
