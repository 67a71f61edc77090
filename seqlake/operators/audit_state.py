"""Audits that add up: the state of each version of a table, stored, merged, and read as the audit of all of them.

An audit of a table that is appended to need not read the old rows again. What it counts of a version is kept as a
state: rows and bad rows of each check, the extremes and a sketch of the different values of a column. States of
versions merge into the state of all their rows, in any order. Keys that occur more than once are found from the
counts of each key, kept by version in the same way.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.sources.tables import append_rows

# One row for each check or column.
_EXTREMES = ("low_number", "high_number", "low_text", "high_text")
_NUMBER = "decimal(38,6)"
SKETCH_BITS = 12


def _row(check: str, bad, low=None, high=None, text: bool = False, sketch=None) -> Column:
    none = lambda kind: F.lit(None).cast(kind)
    number = lambda value: none(_NUMBER) if value is None or text else value.cast(_NUMBER)
    words = lambda value: value.cast("string") if value is not None and text else none("string")
    return F.struct(
        F.lit(check).alias("check"), F.col("_rows").alias("rows"), bad.alias("bad"), number(low).alias("low_number"),
        number(high).alias("high_number"), words(low).alias("low_text"), words(high).alias("high_text"),
        (none("binary") if sketch is None else sketch).alias("sketch"),
    )


def audit_state(
    df: DataFrame,
    dataset: str,
    rules: Mapping[str, str] | None = None,
    audits: Sequence[tuple[str, str, Column]] = (),
    columns: Sequence[str] = (),
) -> DataFrame:
    """``dataset, check, rows, bad, low_number, high_number, low_text, high_text, sketch`` of one version, in one pass.

    ``rules`` are row expectations (a null result is bad), ``audits`` as in ``audit_columns`` (a null result is not),
    and of each of ``columns`` the check ``<column> values`` holds the number of nulls as bad, the extremes and the sketch.
    Numbers go to the number columns, everything else is told as text.
    """
    counts, rows = [F.count(F.lit(1)).alias("_rows")], []
    for name, rule in (rules or {}).items():
        counts.append(F.count_if(~F.coalesce(F.expr(rule), F.lit(False))).alias(f"_{len(counts)}"))
        rows.append(_row(name, F.col(f"_{len(counts) - 1}")))
    for column, rule, condition in audits:
        counts.append(F.count_if(F.coalesce(condition, F.lit(False))).alias(f"_{len(counts)}"))
        rows.append(_row(f"{column} {rule}", F.col(f"_{len(counts) - 1}")))
    for column in columns:
        at = len(counts)
        text = not isinstance(df.schema[column].dataType, T.NumericType)
        value = F.col(column).cast("string") if text else F.col(column)
        # The sketch takes no decimals or doubles, so it is told the value as text.
        counts += [
            F.count_if(F.col(column).isNull()).alias(f"_{at}"), F.min(value).alias(f"_{at + 1}"), F.max(value).alias(f"_{at + 2}"),
            F.hll_sketch_agg(F.col(column).cast("string"), SKETCH_BITS).alias(f"_{at + 3}"),
        ]
        rows.append(_row(f"{column} values", F.col(f"_{at}"), F.col(f"_{at + 1}"), F.col(f"_{at + 2}"), text, F.col(f"_{at + 3}")))
    found = df.agg(*counts).select(F.inline(F.array(*rows)))
    return found.select(F.lit(dataset).alias("dataset"), "*")


def record_state(state: DataFrame, table: str, version: int, path: str | None = None) -> None:
    """Append the state of a version to a table of states."""
    append_rows(state.withColumn("version", F.lit(version).cast("bigint")), table, path)


def merged(states: DataFrame) -> DataFrame:
    """The state of all versions together. A version that was recorded twice counts once."""
    once = states.dropDuplicates(["version", "dataset", "check"]) if "version" in states.columns else states
    return once.groupBy("dataset", "check").agg(
        F.sum("rows").alias("rows"), F.sum("bad").alias("bad"),
        *[(F.min if name.startswith("low") else F.max)(name).alias(name) for name in _EXTREMES],
        F.when(F.count("sketch") > 0, F.hll_union_agg("sketch")).alias("sketch"),
    )


def audit_of(state: DataFrame) -> DataFrame:
    """``dataset, check, rows, passed, bad``, the extremes, and ``different``, about how many values there are."""
    return state.select(
        "dataset", "check", "rows", (F.col("rows") - F.col("bad")).alias("passed"), "bad", *_EXTREMES,
        F.hll_sketch_estimate("sketch").alias("different"),
    )


def key_state(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of one version, each with its number of rows ``n``: its state under duplicate keys."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def merged_keys(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    once = states.dropDuplicates(["version", *keys]) if "version" in states.columns else states
    return once.groupBy(*keys).agg(F.sum("n").alias("n"))


def duplicates_of(keys: DataFrame) -> DataFrame:
    """As ``duplicate_keys`` of all rows."""
    return keys.filter(F.col("n") > 1).withColumnRenamed("n", "count")


def uniqueness_of(keys: DataFrame) -> DataFrame:
    """As ``check_unique`` of all rows."""
    return keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("key_count")
    ).withColumn("is_unique", F.col("row_count") == F.col("key_count"))
