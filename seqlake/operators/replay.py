"""Folding a state along each key: the state before and after every row.

A fold is sequential inside a key, yet a hot key must not be one task. Keys longer than a bucket
are folded in three steps: every bucket is summarised on its own, the few summaries of a key are
run through in order to find the state each bucket starts from, and all buckets are then played
in parallel. Rows stream through sorted partitions, so no key or bucket is ever held in memory.

A fold can be gone on with: ``fold_with_states`` gives the state of each key behind its last row, and
takes such states to start from, so that new rows are folded without the old ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.operators.ordered import BUCKET, HALO, bucket_of, with_halos
from seqlake.session import stored
from seqlake.spec import SequenceSpec

BEFORE, AFTER = "_before", "_after"
_KEY, _ORDER, _VALUE, _START = "_key", "_at", "_value", "_start"


class Fold(Protocol):
    """States are texts between the steps of the fold, and anything while rows are played."""

    start: str

    def open(self, state: str) -> Any: ...

    def step(self, state: Any, order: int, value: str | None) -> str | None:
        """Play one row on ``state``; the text of the new state, or None if it cannot be applied."""

    def summary(self, rows: Iterable[tuple[int, str | None]]) -> str:
        """What a run of rows, which can be gone through once, does to a state it does not know yet."""

    def resume(self, state: str, summary: str) -> str:
        """The state after the run of rows."""


def _columns(batch: pa.RecordBatch, *names: str):
    return zip(*(batch.column(name).to_pylist() for name in names))


def _play(fold: Fold):
    """Rows in order, each with the state before and after; behind a misfit, whose state after is null, a bucket ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, text, state, stopped = None, fold.start, None, False
        for batch in batches:
            kept, before, after = [], [], []
            rows = _columns(batch, _KEY, BUCKET, _ORDER, _VALUE, _START, HALO)
            for i, (key, bucket, order, value, start, is_halo) in enumerate(rows):
                if (key, bucket) != place:
                    place, stopped = (key, bucket), False
                    text = start if is_halo else fold.start
                    state = fold.open(text)
                if is_halo or stopped:
                    continue
                result = fold.step(state, order, value)
                stopped = result is None
                kept.append(i)
                before.append(text)
                after.append(result)
                text = result
            out = batch.take(pa.array(kept, pa.int64()))
            columns = [out.column(n) for n in out.schema.names if n not in internal]
            names = [n for n in out.schema.names if n not in internal]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(before, pa.string()), pa.array(after, pa.string())],
                [*names, BEFORE, AFTER],
            )

    internal = {_KEY, BUCKET, _ORDER, _VALUE, _START, HALO}
    return run


def _summaries(fold: Fold):
    shape = pa.schema([(_KEY, pa.string()), (BUCKET, pa.int64()), ("summary", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in _columns(batch, _KEY, BUCKET, _ORDER, _VALUE))
        for (key, bucket), run_of_rows in groupby(rows, key=lambda row: row[:2]):
            summary = fold.summary((order, value) for *_, order, value in run_of_rows)
            yield pa.RecordBatch.from_pydict({_KEY: [key], BUCKET: [bucket], "summary": [summary]}, shape)

    return run


def _starts(fold: Fold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, fold.start
        first = True
        for batch in batches:
            keys, buckets, starts = [], [], []
            for key, bucket, summary, given in _columns(batch, _KEY, BUCKET, "summary", "given"):
                if first or key != current:
                    first, current, state = False, key, fold.start
                if summary is None:
                    # What earlier rows have left stands ahead of the buckets.
                    state = given
                    continue
                keys.append(key)
                buckets.append(bucket)
                starts.append(state)
                state = fold.resume(state, summary)
            yield pa.RecordBatch.from_pydict(
                {_KEY: keys, BUCKET: buckets, _START: starts},
                pa.schema([(_KEY, pa.string()), (BUCKET, pa.int64()), (_START, pa.string())]),
            )

    return run


def unordered_rows(df: DataFrame, spec: SequenceSpec) -> DataFrame:
    """``key, rows``: how many rows of a key have no order. A fold leaves them out."""
    return df.filter(F.col(spec.order).isNull()).groupBy(spec.key).agg(F.count(F.lit(1)).alias("rows"))


def fold_per_key(
    df: DataFrame, spec: SequenceSpec, value: str, fold: Fold
) -> DataFrame:
    """``df`` with ``_before`` and ``_after``: the state around each row of its key.

    The order counts from 0 without gaps; rows without one are left out (``unordered_rows`` counts them). The first
    row that cannot be applied ends its key: that row and all later ones are left out too.
    """
    return _applied(*_played(df, spec, value, fold, None), spec)


def fold_with_states(
    df: DataFrame, spec: SequenceSpec, value: str, fold: Fold, before: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``fold_per_key``, and ``key, state`` behind the last row of each key; null if the key has ended.

    ``before`` holds such states of earlier rows, to go on from: the order of new rows goes on, too. A key that has
    ended stays so, and one without new rows keeps its state.
    """
    played, several = _played(df, spec, value, fold, before)
    played = played if several else stored(played, "played")
    ended = F.count_if(F.col(AFTER).isNull()) > 0
    last = F.max_by(AFTER, F.col(spec.order).cast("bigint"))
    states = played.groupBy(spec.key).agg(F.when(~ended, last).alias("state"))
    if before is not None:
        kept = before.join(states.select(F.col(spec.key).alias("_has")), before[spec.key].eqNullSafe(F.col("_has")), "left_anti")
        states = states.unionByName(kept.select(spec.key, "state"))
    return _applied(played, several, spec), states


def _applied(played: DataFrame, several: bool, spec: SequenceSpec) -> DataFrame:
    """The rows ahead of the first misfit of their key."""
    fitting = played.filter(F.col(AFTER).isNotNull())
    if not several:
        return fitting
    # A bucket stops at its own misfit; the buckets behind it are cut here.
    misfits = played.filter(F.col(AFTER).isNull()).groupBy(F.col(spec.key).alias("_ended")).agg(F.min(spec.order).alias("_end"))
    return (
        fitting.join(misfits, F.col(spec.key).eqNullSafe(F.col("_ended")), "left")
        .filter(F.col("_end").isNull() | (F.col(spec.order) < F.col("_end")))
        .drop("_ended", "_end")
    )


def _played(
    df: DataFrame, spec: SequenceSpec, value: str, fold: Fold, before: DataFrame | None
) -> tuple[DataFrame, bool]:
    """Every row with its states, null after a misfit, and whether a key may have more than one bucket."""
    states = [T.StructField(name, T.StringType()) for name in (BEFORE, AFTER)]
    shape = T.StructType([*df.schema.fields, *states])
    rows = df.filter(F.col(spec.order).isNotNull()).withColumns({
        _KEY: F.col(spec.key).cast("string"),
        BUCKET: bucket_of(spec),
        _ORDER: F.col(spec.order).cast("bigint"),
        _VALUE: F.col(value).cast("string"),
    })
    given = None
    if before is not None:
        given = before.select(F.col(spec.key).cast("string").alias("_given"), F.col("state").alias("given"))
        over = given.filter(F.col("given").isNull()).select("_given")
        rows = rows.join(over, rows[_KEY].eqNullSafe(over["_given"]), "left_anti")
        given = given.filter(F.col("given").isNotNull())
    in_order = [_KEY, BUCKET, F.col(HALO).desc(), _ORDER]

    # A fixed number of partitions: small ones would be merged, though playing takes far longer
    # than their size suggests.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def played(part: DataFrame) -> DataFrame:
        return (
            part.repartition(tasks, _KEY, BUCKET)
            .sortWithinPartitions(*in_order)
            .mapInArrow(_play(fold), shape)
        )

    beyond = rows.filter(F.col(spec.order) >= spec.bucket_rows)
    if given is None and (spec.one_bucket or beyond.isEmpty()):
        return played(rows.withColumns({HALO: F.lit(False), _START: F.lit(None).cast("string")})), False

    long_keys = beyond.select(_KEY)
    if given is not None:
        long_keys = long_keys.unionByName(given.select(F.col("_given").alias(_KEY)))
    long_keys = long_keys.distinct()
    long_rows = rows.join(long_keys, rows[_KEY].eqNullSafe(long_keys[_KEY]), "left_semi")
    summaries = (
        long_rows.select(_KEY, BUCKET, _ORDER, _VALUE)
        .repartition(tasks, _KEY, BUCKET)
        .sortWithinPartitions(_KEY, BUCKET, _ORDER)
        .mapInArrow(_summaries(fold), f"{_KEY} string, {BUCKET} bigint, summary string")
    ).withColumn("given", F.lit(None).cast("string"))
    if given is not None:
        # Ahead of all buckets.
        first = F.lit(-(2**63)).cast("bigint")
        summaries = summaries.unionByName(given.select(
            F.col("_given").alias(_KEY), first.alias(BUCKET), F.lit(None).cast("string").alias("summary"), "given"
        ))
    # One summary per bucket of a long key; they stream through, one state at a time.
    starts = (
        summaries.repartition(_KEY)
        .sortWithinPartitions(_KEY, BUCKET)
        .mapInArrow(_starts(fold), f"{_KEY} string, {BUCKET} bigint, {_START} string")
    )
    # All rows are played here, once, and read from the shared folder by what follows.
    part = with_halos(rows.withColumn(_START, F.lit(None).cast("string")), starts)
    return stored(played(part), "played"), True


@dataclass(frozen=True)
class RunningTotal:
    """Sum of the values so far; a row that would carry it over ``limit`` cannot be applied."""

    limit: int
    start: str = "0"

    def open(self, state):
        return [int(state)]

    def step(self, state, order, value):
        total = state[0] + int(value)
        if total > self.limit:
            return None
        state[0] = total
        return str(total)

    def summary(self, rows):
        return str(sum(int(value) for _, value in rows))

    def resume(self, state, summary):
        return str(int(state) + int(summary))
