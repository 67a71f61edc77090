"""Feed records (CSA text): one row per move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.functions.arrays import explode_with_place
from seqlake.operators.silver import latest_of_wide_rows
from seqlake.spec import INITIAL_SFEN


def _lines(body: str) -> Column:
    """Lines without a carriage return at their end, which the feed may carry."""
    return F.transform(F.split(F.col(body), "\n"), lambda line: F.regexp_replace(line, r"\r+$", ""))


def _last_name(lines: Column, mark: str) -> Column:
    found = F.filter(lines, lambda line: line.startswith(mark))
    return F.coalesce(F.substring(F.try_element_at(found, F.lit(-1)), 3, 2**31 - 1), F.lit(""))


def explode_record(df: DataFrame, key: str, body: str) -> DataFrame:
    """One row per move of each record; a record without moves gives none.

    A move is a line that starts with ``+`` or ``-`` and has more text. The actor alternates and
    does not follow the sign; the first move has number 0. Every row carries the initial state,
    because the moves are not played out.
    """
    lines = F.col("_lines")
    moves = F.filter(
        lines, lambda line: (line.startswith("+") | line.startswith("-")) & (F.length(line) > 1)
    )
    records = (
        df.select(F.col(key).cast("string").alias(key), _lines(body).alias("_lines"))
        .select(
            key,
            _last_name(lines, "N+").alias("black_player"),
            _last_name(lines, "N-").alias("white_player"),
            moves.alias("_moves"),
        )
    )
    # Apart from the names, which would else be worked out again for every move.
    per_move = explode_with_place(
        records, [key, "black_player", "white_player"], F.col("_moves"), "move_number", "_line"
    )
    return (
        per_move.select(
            key,
            "move_number",
            F.lit(INITIAL_SFEN).alias("sfen"),
            F.substring("_line", 2, 2**31 - 1).alias("move_usi"),
            F.when(F.col("move_number") % 2 == 0, "black").otherwise("white").alias("player"),
            "black_player",
            "white_player",
        )
    )


def build_feed_positions(raw: DataFrame) -> DataFrame:
    """``floodgate_positions``: the newest version of each game, move by move."""
    return explode_record(
        latest_of_wide_rows(raw, "game_id", "fetched_at", ["csa"]), "game_id", "csa"
    )
