"""Audits of the published tables: what must hold in each, and how many rows break it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.operators import quality
from seqlake.operators.ordered import with_bounds
from seqlake.spec import (
    ARTICLE_RAW_SCHEMA,
    FEED_POSITIONS_SCHEMA,
    FEED_RAW_SCHEMA,
    POSITIONS_SCHEMA,
    Layers,
    SequenceSpec,
)


@dataclass(frozen=True)
class Audit:
    """What must hold in a table. ``after_start`` may be null on the first row of a sequence only.

    A ``sequence`` is unique by its key and order; ``chain`` and ``constant`` go with sequences.
    """

    layer: str
    columns: Sequence[str]
    not_null: Sequence[str] = ()
    after_start: Sequence[str] = ()
    not_empty: Sequence[str] = ()
    not_negative: Sequence[str] = ()
    one_of: Mapping[str, Sequence[str]] = field(default_factory=dict)
    unique: Sequence[str] = ()
    sequence: bool = False
    chain: bool = False
    constant: Sequence[str] = ()
    equal: Sequence[tuple[str, str]] = ()
    series: bool = False
    rows_of: str | None = None


_NAMES = ["black_player", "white_player"]
_FEATURES = ["score_from_turn", "score_delta", "is_best_move", "is_blunder", "move_quality", "search_text"]
_PLAYERS = {"player": ("black", "white")}

# What each table promises.
AUDITS = {
    "floodgate_raw": Audit(
        "bronze", FEED_RAW_SCHEMA.fieldNames(),
        not_null=["game_id", "csa", "fetched_at", "source"], not_empty=["csa"],
    ),
    "wikipedia_raw": Audit(
        "bronze", ARTICLE_RAW_SCHEMA.fieldNames(),
        not_null=["strategy", "raw_content", "fetched_at", "source"], not_empty=["raw_content"],
    ),
    "positions": Audit(
        "silver", POSITIONS_SCHEMA.fieldNames(),
        not_null=["game_id", "move_number", "sfen"], one_of=_PLAYERS, unique=["game_id", "move_number"],
        sequence=True, chain=True, constant=_NAMES,
    ),
    "floodgate_positions": Audit(
        "silver", FEED_POSITIONS_SCHEMA.fieldNames(),
        not_null=["game_id", "move_number", "sfen", "move_usi", *_NAMES], one_of=_PLAYERS,
        unique=["game_id", "move_number"], sequence=True, constant=_NAMES,
    ),
    "joseki_knowledge": Audit(
        "silver", ["strategy", "content", "source"],
        not_null=["strategy", "content", "source"], unique=["strategy"],
    ),
    "position_features": Audit(
        "gold", [*POSITIONS_SCHEMA.fieldNames(), *_FEATURES],
        not_null=["game_id", "move_number", "score_from_turn"], after_start=["is_best_move", "search_text"],
        one_of={"move_quality": ("start", "best", "blunder", "normal")}, rows_of="positions",
    ),
    "game_summary": Audit(
        "gold",
        ["game_id", *_NAMES, "total_moves", "final_score_cp", "black_blunders", "white_blunders", "score_series_json"],
        not_null=["game_id", *_NAMES, "total_moves", "final_score_cp", "black_blunders", "white_blunders"],
        not_negative=["total_moves", "black_blunders", "white_blunders"], unique=["game_id"], series=True,
    ),
    "floodgate_position_features": Audit(
        "gold", [*FEED_POSITIONS_SCHEMA.fieldNames(), "search_text"],
        not_null=["game_id", "move_number", *_NAMES, "search_text"], not_empty=["search_text"],
        not_negative=["move_number"], one_of=_PLAYERS, rows_of="floodgate_positions",
    ),
    "joseki_features": Audit(
        "gold", ["strategy", "content", "source", "search_text"],
        not_null=["strategy", "content", "source", "search_text"], equal=[("search_text", "content")],
        rows_of="joseki_knowledge",
    ),
}


def _counted(df: DataFrame, check: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("bad_rows")).select(F.lit(check).alias("check"), "bad_rows")


def audit(
    df: DataFrame, rules: Audit, spec: SequenceSpec | None = None, source: DataFrame | None = None
) -> DataFrame:
    """``check, bad_rows`` for every promise. All checks of a sequence share one pass, as do those of columns.

    Without ``spec`` a sequence's bounds are read first, which is one pass over its order.
    """
    if spec is None:
        spec = with_bounds(df, SequenceSpec()) if rules.sequence else SequenceSpec()
    columns = [quality.is_null(c) for c in rules.not_null]
    columns += [(c, "null after the start", F.col(c).isNull() & (F.col(spec.order) != 0)) for c in rules.after_start]
    columns += [quality.is_empty(c) for c in rules.not_empty]
    columns += [quality.is_negative(c) for c in rules.not_negative]
    columns += [quality.not_in(c, values) for c, values in rules.one_of.items()]
    columns.append(("empty", "table", F.lit(True)))
    if rules.sequence:
        counted = quality.audit_sequence(df, spec, columns, rules.constant, rules.chain)
    else:
        counted = quality.audit_columns(df, columns).select(F.concat_ws(" ", "column", "rule").alias("check"), "bad_rows")
    is_empty = (F.col("bad_rows") == 0).cast("bigint")
    parts = [
        counted.withColumn("bad_rows", F.when(F.col("check") == "empty table", is_empty).otherwise(F.col("bad_rows"))),
        _counted(quality.check_schema(df, rules.columns), "columns"),
    ]
    if rules.unique and not rules.sequence:
        parts.append(_counted(quality.duplicate_keys(df, rules.unique), "duplicate keys"))
    parts += [_counted(quality.mismatches(df, a, b), f"{a} = {b}") for a, b in rules.equal]
    if rules.series:
        parts.append(_counted(quality.bad_series(df, spec.order), "series"))
    if source is not None:
        same = quality.check_same_count(df, source)
        parts.append(same.select(
            F.lit("rows of the source").alias("check"),
            F.abs(F.col("left_rows") - F.col("right_rows")).alias("bad_rows"),
        ))
    return reduce(DataFrame.unionByName, parts)


def audit_tables(
    spark: SparkSession, layers: Layers, tables: Sequence[str] = tuple(AUDITS), spec: SequenceSpec | None = None
) -> DataFrame:
    """``dataset, check, bad_rows`` over the published tables."""
    found = []
    for name in tables:
        rules = AUDITS[name]
        source = None
        if rules.rows_of:
            source = spark.read.table(layers.table(AUDITS[rules.rows_of].layer, rules.rows_of))
        table = spark.read.table(layers.table(rules.layer, name))
        found.append(audit(table, rules, spec, source).select(F.lit(name).alias("dataset"), "check", "bad_rows"))
    return reduce(DataFrame.unionByName, found)
