"""Row expectations and table audits, each counted in one pass over the table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.operators.ordered import BUCKET, measured, with_history, with_previous, with_row_number
from seqlake.spec import SequenceSpec


def _count(condition: Column) -> Column:
    """Rows for which the condition holds; null does not count, and no row gives 0."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def expect(
    df: DataFrame, rules: Mapping[str, str], extra: Mapping[str, Column] | None = None
) -> tuple[DataFrame, Observation]:
    """Count the rows that satisfy each rule while ``df`` is written; every row is kept.

    Place it last before the write: result tasks report once, even when they are run again after
    a lost executor, while the tasks of an earlier stage may report twice. ``extra`` adds further
    aggregates to the same pass.
    """
    observation = Observation()
    counts = [_count(F.expr(rule)).alias(f"passed_{name}") for name, rule in rules.items()]
    more = [value.alias(name) for name, value in (extra or {}).items()]
    return df.observe(observation, F.count(F.lit(1)).alias("rows"), *counts, *more), observation


def observed_counts(observation: Observation, rules: Mapping[str, str]) -> list[tuple[str, int, int]]:
    """(rule, passed, failed) after the write."""
    seen = observation.get
    return [
        (name, seen[f"passed_{name}"], seen["rows"] - seen[f"passed_{name}"]) for name in rules
    ]


def _long(df: DataFrame, counts: Sequence[Column], rows: Sequence[Column]) -> DataFrame:
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def expectation_counts(df: DataFrame, dataset: str, rules: Mapping[str, str]) -> DataFrame:
    """``dataset, name, passed_records, failed_records``; a null rule result counts as failed."""
    counts = [F.count(F.lit(1)).alias("_rows")]
    counts += [_count(F.expr(rule)).alias(f"_{i}") for i, rule in enumerate(rules.values())]
    rows = [
        F.struct(
            F.lit(dataset).alias("dataset"),
            F.lit(name).alias("name"),
            F.col(f"_{i}").alias("passed_records"),
            (F.col("_rows") - F.col(f"_{i}")).alias("failed_records"),
        )
        for i, name in enumerate(rules)
    ]
    return _long(df, counts, rows)


def is_null(column: str) -> tuple[str, str, Column]:
    return column, "null", F.col(column).isNull()


def is_empty(column: str) -> tuple[str, str, Column]:
    return column, "empty", F.col(column) == ""


def is_negative(column: str) -> tuple[str, str, Column]:
    return column, "negative", F.col(column) < 0


def not_in(column: str, values: Iterable) -> tuple[str, str, Column]:
    return column, "not_in", ~F.col(column).isin(list(values))


def audit_columns(df: DataFrame, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """``column, rule, bad_rows`` for rules such as ``is_null("game_id")``, in one aggregation."""
    counts = [_count(condition).alias(f"_{i}") for i, (_, _, condition) in enumerate(rules)]
    rows = [
        F.struct(
            F.lit(column).alias("column"),
            F.lit(rule).alias("rule"),
            F.col(f"_{i}").alias("bad_rows"),
        )
        for i, (column, rule, _) in enumerate(rules)
    ]
    return _long(df, counts, rows)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that occur more than once, with their ``count``."""
    return df.groupBy(*keys).count().filter(F.col("count") > 1)


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: ``row_count, key_count, is_unique``."""
    return (
        df.groupBy(*keys)
        .count()
        .agg(F.coalesce(F.sum("count"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("key_count"))
        .withColumn("is_unique", F.col("row_count") == F.col("key_count"))
    )


def check_same_count(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: ``left_rows, right_rows, is_same``."""
    counts = left.agg(F.count(F.lit(1)).alias("left_rows")).unionByName(
        right.agg(F.count(F.lit(1)).alias("right_rows")), allowMissingColumns=True
    )
    return counts.agg(F.max("left_rows").alias("left_rows"), F.max("right_rows").alias("right_rows")).withColumn(
        "is_same", F.col("left_rows") == F.col("right_rows")
    )


def sequence_gaps(df: DataFrame, spec: SequenceSpec) -> DataFrame:
    """Rows whose order is not their place in the key, counted from 0."""
    numbered = with_row_number(df, spec, "_number")
    return (
        numbered.withColumn("expected_order", F.col("_number") - 1)
        .filter(F.col(spec.order) != F.col("expected_order"))
        .drop("_number")
    )


def chain_breaks(df: DataFrame, spec: SequenceSpec) -> DataFrame:
    """Rows whose state before differs from the state after the previous row.

    On row 0 both states of the row itself must agree. A null on either side is no break.
    """
    chained = with_previous(df, spec, {"expected_state": spec.state})
    chained = chained.withColumn(
        "expected_state",
        F.when(F.col(spec.order) == 0, F.col(spec.state)).otherwise(F.col("expected_state")),
    )
    return chained.filter(F.col(spec.order) >= 0).filter(
        F.col(spec.prev_state) != F.col("expected_state")
    )


def inconsistent_keys(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys that hold more than one value of a column, with its smallest and largest value.

    Two different values exist exactly when minimum and maximum differ, so nothing but two values
    per key and map task is shuffled.
    """
    return df.groupBy(key).agg(*_extremes(columns)).filter(_differs(columns))


def _extremes(columns: Sequence[str]) -> list[Column]:
    return [f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)]


def _differs(columns: Sequence[str]) -> Column:
    found = F.lit(False)
    for column in columns:
        found = found | F.coalesce(F.col(f"min_{column}") != F.col(f"max_{column}"), F.lit(False))
    return found


def audit_sequence(
    df: DataFrame,
    spec: SequenceSpec,
    rules: Sequence[tuple[str, str, Column]],
    constant: Sequence[str] = (),
    chain: bool = False,
) -> DataFrame:
    """``check, bad_rows``: ``audit_columns``, duplicate keys, gaps, chain breaks and inconsistent keys in one pass.

    Counts as the operators of those names do; rows are shuffled once where the keys fit a bucket, and take along what
    ``rules`` say of them instead of the columns these read.
    """
    order = F.col(spec.order)
    spec = measured(df, spec)
    taken = dict.fromkeys([spec.key, spec.order, *constant, *([spec.state, spec.prev_state] if chain else [])])
    said = df.select(*taken, *[condition.alias(f"_rule_{i}") for i, (_, _, condition) in enumerate(rules)])
    rows = with_history(said, spec, {"_state_before": spec.state} if chain else {}, "_number", keep_bucket=True)
    place = [spec.key, *([BUCKET] if BUCKET in rows.columns else []), spec.order]
    rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy(*place).orderBy(spec.order)))
    checks = [(f"{column} {rule}", F.col(f"_rule_{i}")) for i, (column, rule, _) in enumerate(rules)]
    checks += [("duplicate keys", F.col("_copy") == 2), ("sequence gaps", order != F.col("_number") - 1)]
    if chain:
        expected = F.when(order == 0, F.col(spec.state)).otherwise(F.col("_state_before"))
        checks.append(("chain breaks", (order >= 0) & (F.col(spec.prev_state) != expected)))
    per_key = rows.groupBy(spec.key).agg(
        *[_count(condition).alias(f"_{i}") for i, (_, condition) in enumerate(checks)], *_extremes(constant)
    )
    counts = [F.coalesce(F.sum(f"_{i}"), F.lit(0)).alias(f"_{i}") for i in range(len(checks))]
    names = [name for name, _ in checks]
    if constant:
        counts.append(F.count_if(_differs(constant)).alias(f"_{len(names)}"))
        names.append("inconsistent keys")
    return _long(per_key, counts, [
        F.struct(F.lit(name).alias("check"), F.col(f"_{i}").alias("bad_rows")) for i, name in enumerate(names)
    ])


def bad_series(df: DataFrame, order: str, series: str = "score_series_json") -> DataFrame:
    """Rows whose series is no JSON array or is not sorted by ``order``."""
    entries = F.from_json(
        series, T.ArrayType(T.StructType([T.StructField(order, T.LongType())])), {"mode": "PERMISSIVE"}
    )
    orders = F.transform(entries, lambda e: e[order])
    valid = F.col(series).startswith("[") & (orders == F.array_sort(orders))
    return df.filter(~F.coalesce(valid, F.lit(False)))


def check_schema(df: DataFrame, expected: T.StructType | Iterable[str]) -> DataFrame:
    """``column, expected, actual, stored_values`` for each column that is off.

    ``expected`` is an exact schema, or a set of names when types do not matter.
    ``stored_values`` counts the values the table holds in that column.
    """
    if isinstance(expected, T.StructType):
        want = {f.name: f.dataType.simpleString() for f in expected}
        have = {f.name: f.dataType.simpleString() for f in df.schema}
    else:
        want, have = dict.fromkeys(expected, "any"), dict.fromkeys(df.columns, "any")
    off = [name for name in {**want, **have} if want.get(name) != have.get(name)]
    shape = "column string, expected string, actual string, stored_values bigint"
    if not off:
        return df.sparkSession.createDataFrame([], shape)
    counts = [
        (F.count(F.col(name)) if name in have else F.count(F.lit(None))).alias(f"_{i}")
        for i, name in enumerate(off)
    ]
    rows = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(want.get(name)).cast("string").alias("expected"),
            F.lit(have.get(name)).cast("string").alias("actual"),
            F.col(f"_{i}").alias("stored_values"),
        )
        for i, name in enumerate(off)
    ]
    return _long(df, counts, rows)


def mismatches(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.filter(F.expr(left) != F.expr(right))


def is_stale(df: DataFrame, ts: str, now: datetime, hours: int = 24) -> DataFrame:
    """One row: ``newest`` and whether it is more than ``hours`` before ``now``."""
    limit = F.col("newest") + F.expr(f"INTERVAL {hours} HOURS")
    kind = df.schema[ts].dataType.simpleString()
    return df.agg(F.max(ts).alias("newest")).withColumn(
        "is_stale", limit < F.lit(now.isoformat(sep=" ")).cast(kind)
    )
