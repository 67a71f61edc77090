"""Engine logs: one analysis row per log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Score of a forced mate, moves kept of a line of play, answer when none is given; the
# words of the protocol's lines below (info depth, score cp, score mate, pv, bestmove).
MATE_SCORE = 30_000
PV_MOVES = 8
NO_MOVE = "resign"


def parse_engine_log(
    lines: DataFrame, key: str, line_no: str, line: str, pv_moves: int | None = PV_MOVES
) -> DataFrame:
    """``best_move, score_cp, pv`` of each log, given line by line; ``pv`` holds ``pv_moves`` moves, None all.

    Score and line of play come from the last ``info depth`` line, the move from the first
    ``bestmove``. A mate in N counts as a fixed score with the sign of N, and 0 as negative.
    Both lines are picked by partial aggregates, so a log of any length shuffles two lines per task.
    """
    text = F.col("_info")

    def number(kind: str):
        return F.regexp_extract(text, rf"score {kind}\s+(-?\d+)", 1).try_cast("int")

    mate = F.when(number("mate") > 0, MATE_SCORE).when(number("mate") <= 0, -MATE_SCORE)
    moves = F.split(F.trim(F.regexp_extract(text, r"\bpv\s+(.+)", 1)), r"\s+")
    if pv_moves is not None:
        moves = F.slice(moves, 1, pv_moves)
    answer = F.regexp_extract("_best", r"bestmove\s+(\S+)", 1)
    return (
        lines.groupBy(key)
        .agg(
            F.expr(f"max_by(`{line}`, `{line_no}`) FILTER (WHERE startswith(`{line}`, 'info depth'))").alias("_info"),
            F.expr(f"min_by(`{line}`, `{line_no}`) FILTER (WHERE `{line}` RLIKE 'bestmove[ \\\\t]+[^ \\\\t]')").alias("_best"),
        )
        .select(
            key,
            F.coalesce(answer, F.lit(NO_MOVE)).alias("best_move"),
            F.coalesce(mate, number("cp"), F.lit(0)).alias("score_cp"),
            F.coalesce(F.array_join(moves, " "), F.lit("")).alias("pv"),
        )
    )
