"""Readers of the given tables, and the sequences built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.operators.ordered import with_bounds
from seqlake.session import spread
from seqlake.spec import SequenceSpec


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_spread(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """For work that is heavy per row: the given tables have one row group each."""
    return spread(read(spark, folder, name))


# Conversations: a turn is a step, its role the actor, the length of its text the score.
TURNS = SequenceSpec(
    key="conv_id",
    order="turn",
    actor="role",
    score="score",
    first_actor="user",
    second_actor="assistant",
    first_name="first_name",
    second_name="second_name",
    state="state",
    prev_state="prev_state",
    move="move",
    best="best",
)
TURNS_SQL = """
turns AS (
  SELECT conv_id, turn, role, CAST(length(text) AS INTEGER) AS score,
         text AS move, CASE WHEN turn % 3 = 0 THEN text ELSE concat(role, text) END AS best,
         text AS state, concat(role, text) AS prev_state,
         concat('U', CAST(conv_id AS VARCHAR)) AS first_name,
         concat('A', CAST(conv_id AS VARCHAR)) AS second_name
  FROM conversations)
"""


def turns_spec(spark: SparkSession, folder: str) -> SequenceSpec:
    """``TURNS`` with the largest turn, so that keys which fit a bucket take one window."""
    return with_bounds(read(spark, folder, "conversations"), TURNS)


def turns(spark: SparkSession, folder: str) -> DataFrame:
    conv = F.col("conv_id").cast("string")
    return read(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        "role",
        F.length("text").alias("score"),
        F.col("text").alias("move"),
        F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.concat("role", "text")).alias("best"),
        F.col("text").alias("state"),
        F.concat("role", "text").alias("prev_state"),
        F.concat(F.lit("U"), conv).alias("first_name"),
        F.concat(F.lit("A"), conv).alias("second_name"),
    )


# Events: few long sequences with gaps in the order, cut into many buckets.
EVENTS = SequenceSpec(
    key="event_type",
    order="event_id",
    actor="actor",
    score="score",
    first_actor="even",
    second_actor="odd",
    first_name="first_name",
    second_name="second_name",
    state="props",
    prev_state="props",
    move="move",
    best="best",
    bucket_rows=500,
)
EVENTS_SQL = """
steps AS (
  SELECT event_type, event_id, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS actor,
         CAST(round(value * 100) AS BIGINT) AS score, props,
         CAST(user_id % 7 AS VARCHAR) AS move, CAST(event_id % 7 AS VARCHAR) AS best,
         concat('E', event_type) AS first_name, concat('O', event_type) AS second_name
  FROM events)
"""


def steps(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").select(
        "event_type",
        "event_id",
        F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("actor"),
        F.round(F.col("value") * 100).cast("bigint").alias("score"),
        "props",
        (F.col("user_id") % 7).cast("string").alias("move"),
        (F.col("event_id") % 7).cast("string").alias("best"),
        F.concat(F.lit("E"), "event_type").alias("first_name"),
        F.concat(F.lit("O"), "event_type").alias("second_name"),
    )
