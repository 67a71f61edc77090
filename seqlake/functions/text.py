"""Text expressions of the retrieval layer."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for no text, blank characters, and the limits of a chunk.
NO_TEXT = ("", "nan", "none")
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
CHUNK_CHARS = 500
HEADING_MARK = "^(=+[^=]|#+ )"


def strip(text: Column | str) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def tokens(text: Column | str) -> Column:
    """Words, and single characters of scripts that are written without spaces."""
    pattern = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|[\p{L}\p{N}]+"
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def chunks(text: Column | str, max_chars: int = CHUNK_CHARS) -> Column:
    """The paragraphs of a text, cut after ``max_chars``; blank and heading lines are dropped.

    A heading is a line that begins with its mark: ``==`` or ``#`` and a blank.
    """
    lines = F.transform(F.split(text, "\n"), lambda line: F.trim(F.regexp_replace(line, r"\r+$", "")))
    body = F.filter(
        lines,
        lambda line: (line != "") & ~line.rlike(HEADING_MARK),
    )
    piece = F.lit(f"(?s).{{1,{max_chars}}}")
    return F.flatten(F.transform(body, lambda line: F.regexp_extract_all(line, piece, F.lit(0))))


def metadata_text(metadata: Column) -> Column:
    entries = F.transform(
        F.map_entries(metadata),
        lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), F.coalesce(
            F.concat(F.lit("'"), e["value"], F.lit("'")), F.lit("None"))),
    )
    return F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))


def metadata_map(columns: Mapping[str, Column] | list[str]) -> Column:
    """A map from column name to its value as text, in the given order."""
    if not isinstance(columns, Mapping):
        columns = {name: F.col(name) for name in columns}
    return F.map_from_arrays(
        F.array(*[F.lit(name) for name in columns]),
        F.array(*[value.cast("string") for value in columns.values()]),
    )
