"""Routing by a table of rules: one automaton over all words of all rules, one pass over each text.

A rule says that a text which contains its word calls for its collection; a rule without a word calls for it always.
The words are data: their number does not change the plan, and a text is read once however many there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words of one automaton: more are taken in several passes.
WORD_BYTES = 32 << 20
_WORD_OVERHEAD = 64
_CALLED = "_called"


def _automaton(words: list[str], numbers: list[int]) -> ahocorasick.Automaton:
    """Of each word, the numbers of the collections it calls for."""
    out = ahocorasick.Automaton()
    for word, number in zip(words, numbers):
        out.add_word(word, (*out.get(word, ()), number))
    out.make_automaton()
    return out


def _with_called(queries: DataFrame, text: str, rules: list[tuple[str, int, str]]) -> DataFrame:
    """``_called`` with the collections added whose words occur in the text."""
    names = sorted({(collection, hits) for collection, hits, _ in rules})
    place = {name: number for number, name in enumerate(names)}
    packed = queries.sparkSession.sparkContext.broadcast(
        ([word for *_, word in rules], [place[collection, hits] for collection, hits, _ in rules])
    )
    called = pa.list_(pa.struct([("collection", pa.string()), ("hits", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(*packed.value)
        entries = [{"collection": collection, "hits": hits} for collection, hits in names]
        for batch in batches:
            found = []
            for value, before in zip(batch.column(text).to_pylist(), batch.column(_CALLED).to_pylist()):
                numbers = {number for _, several in automaton.iter(value) for number in several} if value else ()
                found.append([*before, *(entries[number] for number in sorted(numbers))])
            columns = [pa.array(found, called) if name == _CALLED else batch.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return queries.mapInArrow(run, queries.schema)


def route_by_rules(queries: DataFrame, text: str, rules: DataFrame, word_bytes: int = WORD_BYTES) -> DataFrame:
    """One row per question and collection it calls for, with ``hits``, the number to take.

    ``rules`` has ``collection, hits, word``; a rule whose word is null or empty holds for every text. Of several
    rules that call for a collection the largest ``hits`` counts; without text only rules without a word hold.
    """
    rows = rules.select("collection", F.col("hits").cast("int").alias("hits"), F.coalesce("word", F.lit("")).alias("word"))
    rows = rows.groupBy("collection", "word").agg(F.max("hits").alias("hits")).persist()
    size = rows.agg(F.sum(F.octet_length("word") + F.octet_length("collection") + _WORD_OVERHEAD)).first()[0] or 0
    passes = max(1, math.ceil(size / word_bytes))
    entry = "array<struct<collection:string,hits:int>>"
    out = queries.withColumn(_CALLED, F.array().cast(entry))
    for turn in range(passes):
        part = rows.filter(F.pmod(F.xxhash64("collection", "word"), F.lit(passes)) == turn).collect()
        always = sorted({(r["collection"], r["hits"]) for r in part if r["word"] == ""})
        if always:
            more = F.array(*[F.struct(F.lit(name).alias("collection"), F.lit(hits).alias("hits")) for name, hits in always])
            out = out.withColumn(_CALLED, F.concat(_CALLED, more.cast(entry)))
        words = [(r["collection"], r["hits"], r["word"]) for r in part if r["word"] != ""]
        if words:
            out = _with_called(out, text, words)
    rows.unpersist()
    # Sorted, so that of a collection the last one, with the most hits, stays.
    best = F.aggregate(
        F.array_sort(_CALLED), F.array().cast(entry),
        lambda done, one: F.concat(F.filter(done, lambda kept: kept["collection"] != one["collection"]), F.array(one)),
    )
    return out.select(*queries.columns, F.inline(best))
