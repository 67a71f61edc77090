"""Move notation to Japanese text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Numerals of the ranks and names of the pieces.
RANK_LETTERS = "abcdefghi"
RANK_NUMERALS = "一二三四五六七八九"
PIECE_NAMES = {
    "p": "歩", "l": "香", "n": "桂", "s": "銀", "g": "金", "b": "角", "r": "飛", "k": "玉",
    "+p": "と", "+l": "杏", "+n": "圭", "+s": "全", "+b": "馬", "+r": "龍",
}
USI_MOVE = r"^(?:[PLNSGBR]\*[1-9][a-i]|[1-9][a-i][1-9][a-i]\+?)$"


def _cells(rank: Column) -> Column:
    """Nine letters: a promoted piece becomes one capital letter, an empty square a dot."""
    cells = F.lower(rank)
    for piece in "plnsbr":
        cells = F.replace(cells, F.lit(f"+{piece}"), F.lit(piece.upper()))
    for empty in range(1, 10):
        cells = F.replace(cells, F.lit(str(empty)), F.lit("." * empty))
    return cells


def usi_to_japanese(move: Column | str, state: Column | str) -> Column:
    """A move in words, from its notation and the state before it.

    That is file digit, rank numeral, piece and ``成`` or ``打``. Text that is no move, and a move
    from an empty square, give null.
    """
    move, state = (F.col(c) if isinstance(c, str) else c for c in (move, state))
    drop = F.substring(move, 2, 1) == "*"
    file, rank = F.substring(move, 3, 1), F.translate(F.substring(move, 4, 1), RANK_LETTERS, RANK_NUMERALS)
    letters = list(PIECE_NAMES)
    names = F.create_map(*[
        F.lit(x)
        for code in letters
        for x in (code[1:].upper() if code[0] == "+" else code, PIECE_NAMES[code])
    ])
    # Ranks run from a to i, and inside a rank files run from 9 to 1.
    ranks = F.split(F.substring_index(state, " ", 1), "/")
    rank_before = F.get(ranks, F.instr(F.lit(RANK_LETTERS), F.substring(move, 2, 1)) - 1)
    place = 10 - F.substring(move, 1, 1).try_cast("int")
    code = F.when(drop, F.lower(F.substring(move, 1, 1))).otherwise(
        F.substr(_cells(rank_before), place, F.lit(1))
    )
    suffix = F.when(drop, "打").when(move.endswith("+"), "成").otherwise("")
    shown = F.concat(file, rank, F.try_element_at(names, code), suffix)
    return F.when(move.rlike(USI_MOVE), shown)


def with_japanese(df: DataFrame, move: str, state: str) -> DataFrame:
    """Add ``text``, and ``error``: the move where it gives no text."""
    return df.withColumn("text", usi_to_japanese(move, state)).withColumn(
        "error", F.when(F.col("text").isNull(), F.col(move))
    )
