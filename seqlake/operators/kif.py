"""Game records in KIF notation: one row per move, in USI notation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.functions.arrays import explode_with_place

# Fixed values of the notation.
RULER = "手数--"
FIRST_NAMES = ("先手：", "下手：")
SECOND_NAMES = ("後手：", "上手：")
WIDE_DIGITS = "１２３４５６７８９"
RANK_NUMERALS = "一二三四五六七八九"
RANK_LETTERS = "abcdefghi"
DROP_PIECES = "歩香桂銀金角飛"
DROP_LETTERS = "PLNSGBR"
MOVE = (
    r"^\s*\d+\s+(?:([１２３４５６７８９][一二三四五六七八九])|同[\s　]*)"
    r"(成香|成桂|成銀|[歩香桂銀金角飛玉王と杏圭全馬龍竜])"
    r"(?:(打)|(成|不成)?\(([1-9][1-9])\)).*$"
)
# What a move line becomes: a mark, then target, piece, 打 or 成, and origin.
MARK, SAME = "\u0001", "\u0002"
PARTS = MARK + "$1,$2,$3$4,$5"


def _name(lines: Column, marks: tuple[str, ...]) -> Column:
    found = F.filter(lines, lambda line: line.startswith(marks[0]) | line.startswith(marks[1]))
    value = F.substring(F.try_element_at(found, F.lit(-1)), len(marks[0]) + 1, 2**31 - 1)
    return F.regexp_replace(value, r"[\s　]+$", "")


def _moves(lines: Column) -> Column:
    """The lines below the ruler up to the first one that is no move, in parts."""
    below = F.slice(
        lines,
        F.array_position(F.transform(lines, lambda line: line.startswith(RULER)), F.lit(True)).cast("int") + 1,
        F.size(lines) + 1,
    )
    return F.transform(below, lambda line: F.regexp_replace(line, MOVE, PARTS))


def _until_other(moves: Column) -> Column:
    end = F.array_position(F.transform(moves, lambda m: m.startswith(MARK)), F.lit(False)).cast("int")
    return F.when(end > 0, F.slice(moves, 1, F.greatest(end - 1, F.lit(0)))).otherwise(moves)


def _with_targets(moves: Column) -> Column:
    """Give a move to the same square the target of the last move that names one.

    The moves are joined and split again where a target is named, so that each piece is one such
    move and the moves to its square behind it.
    """
    joined = F.replace(F.array_join(moves, ""), F.lit(f"{MARK},"), F.lit(f"{SAME},"))
    runs = F.filter(F.split(joined, MARK), lambda run: run != "")

    def spelled(run: Column) -> Column:
        target = F.substring_index(run, ",", 1)
        return F.transform(
            F.split(run, SAME), lambda move, i: F.when(i == 0, move).otherwise(F.concat(target, move))
        )

    return F.flatten(F.transform(runs, spelled))


def parse_kif(records: DataFrame, key: str, body: str) -> DataFrame:
    """``move_number, move_usi`` and both names per record; row 0 is the start, with an empty move.

    A missing name is null. Comments are skipped, and the first other line that is no move ends the
    record. Nothing is shuffled: the moves of a record come out in order where the record lies.
    """
    unix = F.replace(F.replace(F.col(body), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.filter(F.split(unix, "\n"), lambda line: (F.trim(line) != "") & ~line.startswith("*"))
    parts = F.col("_parts")
    target = F.translate(parts[0], WIDE_DIGITS + RANK_NUMERALS, "123456789" + RANK_LETTERS)
    origin = F.concat(
        F.substring(parts[3], 1, 1), F.translate(F.substring(parts[3], 2, 1), "123456789", RANK_LETTERS)
    )
    usi = (
        F.when(F.col("move_number") == 0, "")
        .when(parts[2] == "打", F.concat(F.translate(parts[1], DROP_PIECES, DROP_LETTERS), F.lit("*"), target))
        .otherwise(F.concat(origin, target, F.when(parts[2] == "成", "+").otherwise("")))
    )
    parsed = (
        records.select(key, lines.alias("_lines"))
        .select(
            key,
            _name(F.col("_lines"), FIRST_NAMES).alias("black_player"),
            _name(F.col("_lines"), SECOND_NAMES).alias("white_player"),
            _moves(F.col("_lines")).alias("_moves"),
        )
        .withColumn("_moves", _until_other(F.col("_moves")))
        .withColumn("_moves", F.concat(F.array(F.lit("")), _with_targets(F.col("_moves"))))
    )
    # Apart from the names, which would else be worked out again for every move.
    per_move = explode_with_place(
        parsed, [key, "black_player", "white_player"], F.col("_moves"), "move_number", "_move"
    )
    return per_move.withColumn("_parts", F.split("_move", ",")).select(
        key, "move_number", usi.alias("move_usi"), "black_player", "white_player"
    )
