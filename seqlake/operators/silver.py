"""Silver transforms: one row per key, renames, and the join of analysis onto positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.session import stored

# Keys that are sent to all tasks.
REPEATED_KEYS = 100_000


def _first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    # The row_number filter becomes a group limit before the shuffle: a map task sends on at most
    # one row per key, however many copies of a key it holds.
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(window)).filter("_place = 1").drop("_place")


def dedupe(df: DataFrame, keys: Sequence[str], tie_break: Sequence[str]) -> DataFrame:
    """One row per key, the first one by ``tie_break``."""
    return _first_per_key(df, keys, [F.col(name) for name in tie_break])


def latest_per_key(
    df: DataFrame, key: str | Sequence[str], ts: str, tie_break: Sequence[str]
) -> DataFrame:
    """The newest row of each key; among equally new ones the last by ``tie_break``."""
    keys = [key] if isinstance(key, str) else list(key)
    return _first_per_key(df, keys, [F.col(name).desc() for name in (ts, *tie_break)])


def latest_of_wide_rows(df: DataFrame, key: str, ts: str, tie_break: Sequence[str]) -> DataFrame:
    """As ``latest_per_key``, and only rows that share their key are shuffled.

    For wide rows of which few have older versions: the keys are counted first, which reads that column alone. Beyond
    ``REPEATED_KEYS`` keys of several rows all rows go the plain way.
    """
    repeated = stored(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col(key).alias("_key")), "repeated")
    if repeated.count() > REPEATED_KEYS:
        return latest_per_key(df, key, ts, tie_break)
    # At most that many keys.
    same = F.col(key).eqNullSafe(F.col("_key"))
    several = df.join(F.broadcast(repeated), same, "left_semi")
    return df.join(F.broadcast(repeated), same, "left_anti").unionByName(latest_per_key(several, key, ts, tie_break))


def build_knowledge(raw: DataFrame) -> DataFrame:
    """``joseki_knowledge``: the newest article of each strategy, body renamed to ``content``."""
    newest = latest_of_wide_rows(raw, "strategy", "fetched_at", ["raw_content", "source"])
    return newest.select("strategy", F.col("raw_content").alias("content"), "source")


def attach_analysis(positions: DataFrame, analysis: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join of one analysis row per position."""
    return positions.join(analysis, list(on))
