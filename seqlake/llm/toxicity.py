"""Toxicity by averaged subword embeddings and a linear softmax.

A word, in lower case and marked at both ends, is the bag of its character n-grams of 3 to 6
characters and of itself, hashed into ``BUCKETS`` rows of an embedding table. A text is the mean over
all its subwords, so a misspelling shares most of its vector with the word. Embeddings and softmax are
trained together, by gradient steps in numpy.

Fitting uses a bounded sample of labelled rows outside the held-out fold: about ``TRAIN_DOCS`` toxic
ones and twice as many others, chosen by a hash of doc_id. Prediction reads every whole text and sees nothing but the text: the
trained model gives each bucket one number (its embedding times the difference of the softmax rows),
and a text the mean of the numbers of its subwords.

Defined cases: null and empty text score as the bias alone; a row without doc_id is scored, counts as
not held out and is not learned from; rows of ``labels`` without a document or a label are ignored; of
several labels of a document the largest counts; without training rows of both labels every score is
0; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import slices
from seqlake.llm.language_id import fold

BUCKETS = 1 << 18
WIDTH = 16
GRAMS = (3, 4, 5, 6)
TRAIN_DOCS = 1500
FOLDS = 3
HELD_OUT = 1
THRESHOLD = 0.7
_BORDER = 32
_STEP = np.uint64(0x100000001B3)


def subwords(texts: list[str | None]):
    """(row, bucket) of every subword of every text, a block for each n-gram size, then whole words."""
    lowered = [" " + " ".join((text or "").lower().split()) + " " for text in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(lowered)), sizes)
    border = codes == _BORDER
    # Number of borders before each place: a gram lies in one word if it has none but at its ends.
    before = np.concatenate([[0], np.cumsum(border)])
    mixed = np.zeros(len(codes), np.uint64)
    for width in range(1, max(GRAMS) + 1):
        count = len(codes) - width + 1
        if count <= 0:
            break
        mixed = (mixed[:count] ^ codes[width - 1 :]) * _STEP
        if width in GRAMS:
            inner = before[width - 1 : width - 1 + count] - before[1 : count + 1]
            whole = border[:count] & border[width - 1 :]
            inside = (inner == 0) & ~whole
            yield row[:count][inside], _bucket(mixed[inside], width)
    starts = np.flatnonzero(border[:-1] & ~border[1:]) + 1
    if len(starts):
        ends = np.flatnonzero(~border[:-1] & border[1:]) + 1
        one = np.ones(1, np.uint64)
        power = np.multiply.accumulate(np.concatenate([one, np.full(len(codes), _STEP)]))
        inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
        back = np.multiply.accumulate(np.concatenate([one, np.full(len(codes), inverse)]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power[:-1], dtype=np.uint64)])
        yield row[starts], _bucket((sums[ends] - sums[starts]) * back[starts], 0)


def _bucket(mixed: np.ndarray, width: int) -> np.ndarray:
    out = (mixed + np.uint64(width)) * np.uint64(0x9E3779B97F4A7C15)
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (out >> np.uint64(46)).astype(np.int64)


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        total = np.zeros(len(texts))
        count = np.zeros(len(texts))
        for row, bucket in subwords(texts):
            total += np.bincount(row, weights=self.weights[bucket], minlength=len(texts))
            count += np.bincount(row, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -30, 30)))


def fit(bags: list[tuple], toxic: np.ndarray, rounds: int = 8, rate: float = 0.5, seed: int = 7) -> ToxicityModel:
    """Train table and softmax together. ``bags``: the different buckets of each text and their counts."""
    if not len(toxic) or toxic.min() == toxic.max():
        return ToxicityModel(np.zeros(BUCKETS), -30.0)
    random = np.random.default_rng(seed)
    table = random.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    softmax = random.normal(0, 1, (2, WIDTH)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    table_sum = np.full(BUCKETS, 1e-8, np.float32)
    softmax_sum = np.float32(1e-8)
    for turn in range(rounds):
        step = rate * (1 - turn / rounds)
        for place in random.permutation(len(bags)):
            bucket, count = bags[place]
            if not len(bucket):
                continue
            share = (count / count.sum()).astype(np.float32)
            mean = share @ table[bucket]
            logits = softmax @ mean + bias
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            chance[toxic[place]] -= 1
            towards = chance @ softmax
            # Adagrad with one scale for each row: rare subwords keep large steps.
            table_sum[bucket] += share * share * float(towards @ towards)
            table[bucket] -= step * (share / np.sqrt(table_sum[bucket]))[:, None] * towards
            softmax_sum += float(chance @ chance) * float(mean @ mean)
            softmax -= step * np.outer(chance, mean) / np.sqrt(softmax_sum)
            bias -= 0.05 * step * chance
    difference = softmax[1] - softmax[0]
    return ToxicityModel(table.astype(np.float64) @ difference, float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> ToxicityModel:
    marks = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        (fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("toxic").isin(0, 1)
    )
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {row["toxic"]: row["n"] for row in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    steps = 1 << 20
    wanted = (2 * train_docs, train_docs)
    chance = [min(steps, -(-wanted[label] * steps // max(1, sizes.get(label, 0)))) for label in (0, 1)]
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(steps))
    # About 3 x train_docs rows: the only ones whose texts are looked up.
    marks = marks.filter(drawn < F.when(F.col("toxic") == 1, chance[1]).otherwise(chance[0]))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "doc_id")

    def work(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                    parts = [bucket for _, bucket in subwords([text])]
                    bag, count = np.unique(np.concatenate(parts or [[]]).astype(np.int32), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([label], pa.int32()), pa.array([bag.tobytes()], pa.binary()),
                         pa.array([count.astype(np.int32).tobytes()], pa.binary())],
                        names=["toxic", "bag", "counts"],
                    )

    # About 3 x train_docs rows of 8 bytes for each different subword.
    found = rows.select("toxic", "text").mapInArrow(work, "toxic int, bag binary, counts binary").toArrow().to_pydict()
    examples = sorted(zip(found["bag"], found["counts"], found["toxic"]))
    bags = [(np.frombuffer(bag, np.int32), np.frombuffer(count, np.int32)) for bag, count, _ in examples]
    return fit(bags, np.array([label for *_, label in examples], int))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = ToxicityModel(model.weights.astype(np.float32), model.bias)

    def work(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                values = model.scores(batch.column("text").to_pylist())
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
