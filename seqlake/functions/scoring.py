"""Column expressions of the sequence features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqlake.spec import SequenceSpec

JUMP_THRESHOLD = 200


def turn_score(spec: SequenceSpec) -> Column:
    """The score from the acting side: negated for the second actor, null stays null."""
    score = F.col(spec.score)
    return F.when(F.col(spec.actor) == spec.second_actor, -score).otherwise(score)


def is_jump(delta: Column | str, threshold: int = JUMP_THRESHOLD) -> Column:
    """Gains count as well as losses; a null change gives a null flag."""
    return F.abs(delta) >= threshold


def matches(left: str, right: str) -> Column:
    """Whether two columns are equal; null when either side is null."""
    return F.col(left) == F.col(right)


def label(order: Column | str, match: Column | str, jump: Column | str) -> Column:
    """The first rule that holds names the row; null flags fall through."""
    order, match, jump = (F.col(c) if isinstance(c, str) else c for c in (order, match, jump))
    return (
        F.when(order == 0, "start")
        .when(match, "best")
        .when(jump, "blunder")
        .otherwise("normal")
    )


def search_text(parts: list[tuple[str, str]], suffix: str = "") -> Column:
    """Labelled concatenation, null as soon as one part is null."""
    pieces: list[Column] = []
    for i, (title, column) in enumerate(parts):
        pieces += [F.lit(f"{' ' if i else ''}{title}: "), F.col(column).cast("string")]
    return F.concat(*pieces, F.lit(suffix))


def position_text(spec: SequenceSpec) -> Column:
    # The labels of the search text.
    return search_text(
        [("局面", spec.state), ("指し手", spec.move), ("推奨手", spec.best), ("評価値", spec.score)],
        "cp",
    )


def feed_text(spec: SequenceSpec) -> Column:
    # The labels of the search text.
    return search_text([("局面", spec.state), ("指し手", spec.move)])
