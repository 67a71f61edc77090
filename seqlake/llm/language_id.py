"""Language identification by the nearest of several centroids per language.

A text becomes the counts of its letter n-grams (one to three, lower case, words marked off by a
space), hashed into ``BUCKETS``, weighted by log term frequency and inverse document frequency and
scaled to length one. The training vectors of each language are clustered by cosine; a text takes the
language of the most similar centroid. A text farther from it than any training text of its size
(with ``SLACK``) is rejected.

Fitting uses a bounded sample of labelled rows: at most about ``TRAIN_DOCS`` per language and
``TRAIN_TOTAL`` in all, chosen by a hash of doc_id, each as one vector of ``BUCKETS`` floats (4 x
``BUCKETS`` bytes). Of more than ``TRAIN_TOTAL`` values of lang the most frequent ones are learned, of equal ones those
that sort first. Prediction reads every whole text and sees nothing but the text.

Defined cases: null text and text without a letter give ``und`` and score 0, rejected; a row without
doc_id is predicted, counts as not held out and is not learned from; rows without lang are not learned
from; of equal similarities the language that sorts first wins; without any training row every text is
``und`` and none is rejected; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import slices

BUCKETS = 4096
CENTROIDS = 4
TRAIN_DOCS = 500
TRAIN_TOTAL = 4000
SLACK = 1.25
# Texts whose vectors are held at a time.
SLICE_ROWS = 1024
FOLDS = 5
UNKNOWN = "und"
_SPACE = 32
_FACTORS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def fold(key: Column, folds: int) -> Column:
    return F.crc32(key.cast("string")) % folds


def _letter_table() -> np.ndarray:
    return np.array([chr(code).isalpha() for code in range(0x110000)])


_LETTERS: list[np.ndarray] = []


def ngram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts, a row for each text, and the number of letters."""
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    lowered = [(text or "").lower() for text in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
    codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTERS[0][codes]
    codes = np.where(letter, codes, np.uint32(_SPACE))
    row = np.repeat(np.arange(len(lowered)), sizes)
    counts = np.zeros(len(lowered) * BUCKETS, np.float32)
    known = letter
    mixed = np.zeros(len(codes), np.uint32)
    for width, factor in enumerate(_FACTORS):
        count = len(codes) - width
        if count <= 0:
            break
        mixed = mixed[:count] * np.uint32(31) + codes[width:] * factor
        known = letter[:count] if width == 0 else known[:count] | letter[width:]
        # Grams of spaces alone, and those that reach into the next text by more than its border, say nothing.
        bucket = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(20)
        inside = known & (row[:count] == row[width:])
        slots = row[:count][inside] * BUCKETS + bucket[inside]
        counts += np.bincount(slots, minlength=len(counts)).astype(np.float32)
    letters = np.bincount(row, weights=letter, minlength=len(lowered)).astype(np.int64)
    return counts.reshape(len(lowered), BUCKETS), letters


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    # By the number of binary digits of the letter count.
    radius: np.ndarray = field(default_factory=lambda: np.ones(40))

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        weighted = np.log1p(counts) * self.idf
        norm = np.linalg.norm(weighted, axis=1, keepdims=True)
        return weighted / np.maximum(norm, 1e-9)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosine = self.vectors(counts) @ self.centroids.T
        best = cosine.argmax(axis=1)
        return self.owner[best], cosine[np.arange(len(best)), best]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score from 0 to 1 and whether the text is rejected."""
        counts, letters = ngram_counts(texts)
        if not len(self.centroids):
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        owner, cosine = self.nearest(counts)
        none = letters == 0
        score = np.where(none, 0.0, np.clip(cosine.astype(float), 0.0, 1.0))
        far = 1 - score > self.radius[size_class(letters)]
        names = [UNKNOWN if n else self.languages[o] for o, n in zip(owner, none)]
        return names, score, none | far


def size_class(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(letters + 1.0)).astype(int), 39)


def spherical_clusters(vectors: np.ndarray, count: int, rounds: int = 15) -> np.ndarray:
    """Centroids of length one; the first is the mean, each next starts at the vector farthest from those before."""
    mean = vectors.mean(axis=0)
    centres = [mean / max(np.linalg.norm(mean), 1e-9)]
    while len(centres) < min(count, len(vectors)):
        nearest = (vectors @ np.array(centres).T).max(axis=1)
        centres.append(vectors[nearest.argmin()])
    out = np.array(centres)
    for _ in range(rounds):
        owner = (vectors @ out.T).argmax(axis=1)
        for number in range(len(out)):
            if (owner == number).any():
                total = vectors[owner == number].sum(axis=0)
                out[number] = total / max(np.linalg.norm(total), 1e-9)
    return out


def fit_vectors(languages: list[str], counts: np.ndarray, letters: np.ndarray) -> LanguageModel:
    """``languages``: the label of each row of ``counts``."""
    names = sorted(set(languages))
    label = np.array([names.index(name) for name in languages], int)
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    model = LanguageModel(names, idf, np.zeros((0, BUCKETS), np.float32), np.zeros(0, int))
    if not names:
        return model
    vectors = model.vectors(counts)
    parts = [spherical_clusters(vectors[label == number], CENTROIDS) for number in range(len(names))]
    model.centroids = np.concatenate(parts).astype(np.float32)
    model.owner = np.repeat(np.arange(len(parts)), [len(part) for part in parts])
    # The farthest training text of each size; shorter texts may be as far as longer ones.
    distance = 1 - (vectors @ model.centroids.T).max(axis=1)
    radius = np.zeros(40)
    np.maximum.at(radius, size_class(letters), distance)
    seen = np.maximum.accumulate(radius[::-1])[::-1]
    largest = size_class(letters).max()
    seen[largest:] = seen[largest]
    # A size with few training texts says little: what most texts of any size keep is never too far.
    model.radius = np.minimum(1.0, np.maximum(seen, np.quantile(distance, 0.9)) * SLACK)
    return model


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_total: int = TRAIN_TOTAL) -> LanguageModel:
    """Learn from the rows with text, lang and a doc_id outside fold 0."""
    rows = docs.select(
        F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    ).filter((fold(F.col("doc_id"), FOLDS) != 0) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    # One row for each language that is learned.
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(train_total).collect()
    quota = max(1, min(train_docs, train_total // max(1, len(sizes))))
    steps = 1 << 30
    chances = [(row["lang"], min(steps, -(-quota * steps // row["n"]))) for row in sizes]
    chances = docs.sparkSession.createDataFrame(chances, "lang string, chance bigint")
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(steps))
    sample = rows.join(F.broadcast(chances), "lang").filter(drawn < F.col("chance"))

    def work(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20, SLICE_ROWS):
                counts, letters = ngram_counts(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang"), pa.array([c.tobytes() for c in counts], pa.binary()), pa.array(letters)],
                    names=["lang", "counts", "letters"],
                )

    found = sample.select("lang", "text").mapInArrow(work, "lang string, counts binary, letters bigint").toArrow()
    found = found.filter(pa.compute.greater(found["letters"], 0))
    rows = sorted(zip(found["lang"].to_pylist(), found["counts"].to_pylist(), found["letters"].to_pylist()))
    counts = np.frombuffer(b"".join(row[1] for row in rows), np.float32).reshape(-1, BUCKETS)
    return fit_vectors([row[0] for row in rows], counts, np.array([row[2] for row in rows], np.int64))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row."""

    def work(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20, SLICE_ROWS):
                names, score, rejected = model.predict(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score),
                     pa.array(rejected)],
                    names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
                )

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(work, "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose text is rejected."""

    def work(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20, SLICE_ROWS):
                rejected = model.predict(batch.column("text").to_pylist())[2]
                yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(work, docs.schema)
