"""Scores of retrieval and toxicity against plain loops over the texts."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seqlake.llm import decontamination, toxicity


def plain_bm25(items, texts):
    """Of each text, the best score of each item over all pairs of passage and segment, as shares of a segment's own score."""
    segment, k1, b = decontamination.SEGMENT, decontamination.K1, decontamination.B
    split = lambda text: [int(v) for v in decontamination.terms(pa.array([text], pa.string()))[0]]
    segments = [(item, words[i : i + segment]) for item, text in items for words in [split(text)] for i in range(0, len(words), segment)]
    average = sum(len(words) for _, words in segments) / len(segments)
    holds = Counter(term for _, words in segments for term in set(words))
    weighted = []
    for item, words in segments:
        impact = {}
        for term, times in Counter(words).items():
            idf = math.log(1 + (len(segments) - holds[term] + 0.5) / (holds[term] + 0.5))
            impact[term] = idf * times * (k1 + 1) / (times + k1 * (1 - b + b * len(words) / average))
        own = sum(impact.values())
        weighted.append((item, {term: value / own for term, value in impact.items()}))
    out = []
    for text in texts:
        words, best = split(text), {}
        for start in range(-segment, len(words), segment):
            passage = set(words[max(0, start) : start + 2 * segment])
            for item, impact in weighted:
                score = sum(value for term, value in impact.items() if term in passage)
                best[item] = max(best.get(item, 0.0), score)
        out.append(best)
    return out


@pytest.mark.parametrize("threshold", [0.2, 0.6])
def test_retrieval_equals_full_bm25(spark, threshold):
    rng = random.Random(12)
    prose = lambda n, words: " ".join(f"w{rng.randrange(words)}" for _ in range(n))
    # Short items, some of several segments, and texts that hold a part of one.
    items = [(n, prose(rng.choice([8, 20, 64, 65, 150]), 120)) for n in range(90)]
    texts = [prose(rng.randrange(0, 400), 120) for _ in range(25)] + ["", items[3][1], items[7][1].upper() + "!", "none of these words"]
    for n in range(12):
        words = items[n][1].split()
        kept = [word for word in words if rng.random() < 0.75]
        texts.append(prose(rng.randrange(0, 200), 4000) + " " + " ".join(kept) + " " + prose(50, 4000))
    built = decontamination.shards(spark.createDataFrame(items, "item_id bigint, text string"), most=1000)
    assert len(built) > 1
    got = [{} for _ in texts]
    values, counts = decontamination.terms(pa.array(texts, pa.string()))
    for shard in built:
        for row, found in enumerate(shard.retrieve(values, counts, threshold)):
            for item, score in found.items():
                name = shard.items[item][0]
                got[row][name] = max(got[row].get(name, 0.0), score)
    compared = 0
    for row, want in enumerate(plain_bm25(items, texts)):
        near = {item for item, score in want.items() if abs(score - threshold) < 1e-5}
        sure = {item: score for item, score in want.items() if score >= threshold and item not in near}
        assert set(got[row]) - near == set(sure)
        for item, score in sure.items():
            assert got[row][item] == pytest.approx(score, abs=1e-5)
            compared += 1
    assert compared > 100


def plain_subwords(text):
    """Character n-grams inside each marked word, the whole marked word left out, and each word itself."""
    grams, whole = Counter(), Counter()
    for word in (text or "").lower().split():
        marked = f" {word} "
        for width in toxicity.GRAMS:
            grams.update((width, marked[i : i + width]) for i in range(len(marked) - width + 1) if marked[i : i + width] != marked)
        whole[word] += 1
    return grams, whole


def buckets_of(text):
    return Counter(int(b) for _, found in toxicity.subwords([text]) for b in found)


TEXTS = ["Some words, some WORDS", "a bc def ghij", "naïve Straße 漢字かな", "", None, "x", "aaaa aaaa", "one\n two\tthree"]


def test_subwords_are_those_of_plain_loops():
    for text in TEXTS:
        grams, whole = plain_subwords(text)
        got = buckets_of(text)
        # A gram or word alone tells its bucket: the sum over all of them is the text's bag.
        assert sum(got.values()) == sum(grams.values()) + sum(whole.values())
        words = Counter()
        for word, times in whole.items():
            for bucket, n in buckets_of(word).items():
                words[bucket] += n * times
        assert got == words


def test_toxicity_scores_of_a_stated_table():
    rng = np.random.default_rng(5)
    model = toxicity.ToxicityModel(rng.normal(size=toxicity.BUCKETS), -0.3)
    scores = model.scores(TEXTS)
    for text, score in zip(TEXTS, scores):
        bag = buckets_of(text)
        mean = sum(model.weights[bucket] * n for bucket, n in bag.items()) / max(1, sum(bag.values()))
        assert score == pytest.approx(1 / (1 + math.exp(-(mean + model.bias))))
    # The joint training learns the texts it is given.
    bags = [(np.array(sorted(bag), np.int32), np.array([bag[b] for b in sorted(bag)], np.int32)) for bag in map(buckets_of, TEXTS[:3])]
    label = np.array([1, 0, 1])
    trained = toxicity.fit(bags, label, rounds=30)
    assert ((trained.scores(TEXTS[:3]) > 0.5) == label).all()
