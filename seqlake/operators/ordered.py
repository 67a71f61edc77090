"""Looking back inside an ordered key without holding the key in one task.

A plain window puts every row of a key into one task. Here the work is a prefix scan over ranges. Long keys are
cut into ranges of about the same number of rows, whatever their orders are (``cut_ranges``); a first pass leaves
one carry row for each range, a window runs over the few carries of a key, and a second pass over the rows,
hashed by (key, range), starts from what was carried in: one extra row, the *halo* of the range. That is three
exchanges, one of them of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.spec import SequenceSpec

BUCKET = "_bucket"
HALO = "_halo"
_NUMBER, _TAIL = "_rows", "_tail"
_EARLIER = "_earlier"
# Ranges of all keys together, and how many rows are drawn for each of them.
MOST_RANGES = 100_000
DRAWN_PER_RANGE = 32


def with_bounds(df: DataFrame, spec: SequenceSpec) -> SequenceSpec:
    """``spec`` with the largest order as its bound, if no order is negative. One pass over the order.

    Where all keys turn out to fit a bucket, what follows takes one scan and one shuffle.
    """
    seen = df.agg(F.min(spec.order).alias("low"), F.max(spec.order).alias("high")).first()
    known = seen["low"] is not None and seen["low"] >= 0
    return spec.with_max_order(int(seen["high"]) if known else None)


def fit_buckets(df: DataFrame, spec: SequenceSpec, rows: int = 100_000) -> SequenceSpec:
    """``spec`` with wide buckets that hold at most twice ``rows`` rows of any key.

    For orders with wide gaps, such as event ids or times, where a bucket of a fixed width would
    hold few rows. The width that fits the longest key on average is tried first, and a quarter of
    it as long as a cluster fills some bucket with more; each try is one pass over key and order.
    """
    order = F.col(spec.order).cast("bigint")
    per_key = df.groupBy(spec.key).agg(
        F.count(order).alias("n"), F.min(order).alias("low"), F.max(order).alias("high")
    )
    seen = per_key.agg(
        F.max(F.struct("n", "low", "high")).alias("longest"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    ).first()
    longest = seen["longest"]
    if longest is None or longest["n"] == 0:
        return spec
    span = longest["high"] - longest["low"] + 1
    width = max(1, math.ceil(span * rows / longest["n"]))
    while True:
        fitted = replace(spec, bucket_rows=width, max_order=seen["high"] if seen["low"] >= 0 else None)
        # Orders are unique in a key: a bucket of ``rows`` values cannot hold more.
        if width <= rows:
            return fitted
        most = df.groupBy(spec.key, bucket_of(fitted).alias(BUCKET)).count().agg(F.max("count")).first()[0]
        if most <= 2 * rows:
            return fitted
        width = max(rows, width // 4)


def bucket_of(spec: SequenceSpec) -> Column:
    return F.expr(f"cast(`{spec.order}` as bigint) div {spec.bucket_rows}")


def null_first(order: str) -> str:
    """An integer column as an aggregate's order, in SQL: null comes first, as in a window."""
    return f"coalesce(cast(`{order}` AS bigint), bigint('{-(2**63)}'))"


def cut_ranges(df: DataFrame, spec: SequenceSpec, most_ranges: int = MOST_RANGES) -> SequenceSpec:
    """``spec`` with cuts that split every key of more than ``bucket_rows`` rows into ranges of about as many.

    If there is no such key, ``short_keys`` says so, and what follows takes one plain window. Two passes over key and
    order: one counts the rows of each key, one draws orders of the long keys by a hash, ``DRAWN_PER_RANGE`` for a range. With so many long keys that there would be more than ``most_ranges`` ranges,
    the ranges get longer. The cuts are the only rows that are kept, one row for each long key.
    """
    shared = df.select(F.col(spec.key).alias("_key"), F.col(spec.order).cast("bigint").alias("_at"))
    sizes = shared.groupBy("_key").agg(F.count("_at").alias("n")).filter(F.col("n") > spec.bucket_rows)
    sizes = sizes.persist()
    total = sizes.agg(F.sum("n")).first()[0]
    if not total:
        return replace(spec, short_keys=True)
    rows = max(spec.bucket_rows, -(-total // most_ranges))
    steps = 1 << 30
    drawn = F.pmod(F.xxhash64("_key", "_at"), F.lit(steps)) < min(steps, max(1, DRAWN_PER_RANGE * steps // rows))
    # There are at most ``most_ranges`` long keys.
    long = shared.filter(drawn & F.col("_at").isNotNull()).join(F.broadcast(sizes.withColumnRenamed("_key", "_long")), F.col("_key").eqNullSafe(F.col("_long")))
    per_cut = min(DRAWN_PER_RANGE, rows)
    place = F.row_number().over(Window.partitionBy("_key").orderBy("_at"))
    cuts = long.select("_key", "_at", place.alias("place")).filter(F.col("place") % per_cut == 0)
    per_key = cuts.groupBy("_key").agg(F.array_sort(F.collect_list("_at")).alias("every"))
    # Blocks of cuts, so that a row is compared with few of them.
    width = F.ceil(F.sqrt(F.size("every"))).cast("int")
    starts = F.sequence(F.lit(1), F.size("every"), width)
    blocks = F.transform(starts, lambda start: F.slice("every", start, width))
    # A number for each range, in a row for each long key.
    found = per_key.select("_key", blocks.alias("cuts"))
    cuts = df.sparkSession.createDataFrame(found.collect(), found.schema)
    sizes.unpersist()
    return replace(spec, cuts=cuts)


def measured(df: DataFrame, spec: SequenceSpec) -> SequenceSpec:
    """``spec`` as it is if its buckets are known to be few, else as ``cut_ranges`` finds it."""
    known = spec.max_order is not None and spec.max_order // spec.bucket_rows < MOST_RANGES
    return spec if spec.one_bucket or known or spec.cuts is not None else cut_ranges(df, spec)


def with_bucket(df: DataFrame, spec: SequenceSpec) -> DataFrame:
    """Add the bucket of each row in its key: the number of cuts up to its order, or its order by width."""
    if spec.cuts is None:
        return df.withColumn(BUCKET, bucket_of(spec))
    at = F.col(spec.order).cast("bigint")
    # The last block that starts at or before the row, and the cuts in it; all blocks before it are full.
    before = F.size(F.filter("_cuts", lambda block: block[0] <= at))
    inside = F.size(F.filter(F.get("_cuts", before - 1), lambda cut: cut <= at))
    bucket = F.when(before > 0, (before - 1) * F.size(F.col("_cuts")[0]) + inside).otherwise(0).cast("bigint")
    cuts = F.broadcast(spec.cuts.select(F.col("_key").alias("_cut_key"), F.col("cuts").alias("_cuts")))
    # One row for each long key, of bounded number.
    found = df.join(cuts, F.col(spec.key).eqNullSafe(F.col("_cut_key")), "left")
    return found.withColumn(BUCKET, bucket).drop("_cut_key", "_cuts")


def row_rank(spec: SequenceSpec) -> Column:
    return F.expr(null_first(spec.order))


def with_halos(cut: DataFrame, halos: DataFrame) -> DataFrame:
    return cut.withColumn(HALO, F.lit(False)).unionByName(
        halos.withColumn(HALO, F.lit(True)), allowMissingColumns=True
    )


def _in_bucket(spec: SequenceSpec):
    return Window.partitionBy(spec.key, BUCKET).orderBy(F.col(HALO).desc(), spec.order)


def _drop_halos(rows: DataFrame, keep_bucket: bool = False) -> DataFrame:
    rows = rows.filter(~F.col(HALO)).drop(HALO)
    return rows if keep_bucket else rows.drop(BUCKET)


def _with_earlier(buckets: DataFrame, spec: SequenceSpec, how: Mapping[str, str]) -> DataFrame:
    """Add ``_earlier<column>``: what the earlier buckets of the key hold, null if nothing.

    ``buckets`` has a row for each key and bucket; ``how`` says of each column whether its "sum" or its
    "last" value that is not null is taken.
    """
    window = Window.partitionBy(spec.key).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return buckets.withColumns({
        _EARLIER + name: (F.sum(name) if rule == "sum" else F.last(name, ignorenulls=True)).over(window)
        for name, rule in how.items()
    })


def with_history(
    df: DataFrame,
    spec: SequenceSpec,
    previous: Mapping[str, str],
    number: str | None = None,
    keep_bucket: bool = False,
) -> DataFrame:
    """``previous`` as in ``with_previous`` and, if named, ``number`` as in ``with_row_number``, in one go."""
    spec = measured(df, spec)
    if spec.one_bucket:
        window = Window.partitionBy(spec.key).orderBy(spec.order)
        found = {new: F.lag(old).over(window) for new, old in previous.items()}
        if number:
            found[number] = F.row_number().over(window).cast("bigint")
        return df.withColumns(found)

    cut = with_bucket(df, spec)
    sources = sorted(set(previous.values()))
    # A struct is never null, so the last one is that of the bucket before, whatever it holds.
    kept = {_TAIL: (F.max_by(F.struct(*sources), row_rank(spec)), "last")} if sources else {}
    if number:
        kept[_NUMBER] = F.count(F.lit(1)), "sum"
    tails = cut.groupBy(spec.key, BUCKET).agg(*[value.alias(name) for name, (value, _) in kept.items()])
    rules = {name: rule for name, (_, rule) in kept.items()}
    earlier = _with_earlier(tails, spec, rules)
    carried = [f"{_EARLIER}{_TAIL}.{name}" for name in sources]
    if number:
        carried.append(F.col(_EARLIER + _NUMBER).alias("_before"))
    halos = earlier.filter(F.col(_EARLIER + next(iter(kept))).isNotNull()).select(spec.key, BUCKET, *carried)
    here = _in_bucket(spec)
    found = {new: F.lag(old).over(here) for new, old in previous.items()}
    if number:
        # A halo takes the first place of its bucket, so its rows are numbered one too high.
        place = F.row_number().over(here)
        found[number] = F.coalesce(F.first("_before").over(here) + place - 1, place.cast("bigint"))
    return _drop_halos(with_halos(cut, halos).withColumns(found), keep_bucket).drop("_before")


def with_previous(
    df: DataFrame, spec: SequenceSpec, previous: Mapping[str, str], keep_bucket: bool = False
) -> DataFrame:
    """Add columns ``{new: old}`` holding ``old`` of the preceding row of the key, else null.

    ``keep_bucket`` leaves the bucket column, by which the result is already hashed.
    """
    return with_history(df, spec, previous, keep_bucket=keep_bucket)


def with_last_known(df: DataFrame, spec: SequenceSpec, new: str, old: str) -> DataFrame:
    """Add ``new``: the last non-null ``old`` of the key, up to and including the row."""
    spec = measured(df, spec)
    if spec.one_bucket:
        window = Window.partitionBy(spec.key).orderBy(spec.order)
        return df.withColumn(new, F.last(old, ignorenulls=True).over(window))

    cut = with_bucket(df, spec)
    tails = cut.groupBy(spec.key, BUCKET).agg(
        F.expr(f"max_by(`{old}`, {null_first(spec.order)}) FILTER (WHERE `{old}` IS NOT NULL)").alias(old)
    )
    earlier = _with_earlier(tails, spec, {old: "last"})
    halos = earlier.select(spec.key, BUCKET, F.col(_EARLIER + old).alias(old)).filter(F.col(old).isNotNull())
    upto = _in_bucket(spec).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = with_halos(cut, halos).withColumn(new, F.last(old, ignorenulls=True).over(upto))
    return _drop_halos(rows)


def with_row_number(df: DataFrame, spec: SequenceSpec, new: str) -> DataFrame:
    """Add ``new``: the 1-based place of the row in its key."""
    return with_history(df, spec, {}, new)
