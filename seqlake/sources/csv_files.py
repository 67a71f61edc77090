"""Typed CSV in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.spec import POSITIONS_SCHEMA


def _options(escape: str | None) -> dict[str, str]:
    return {} if escape is None else {"escape": escape}


def read_sequences_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType = POSITIONS_SCHEMA,
    escape: str | None = None,
) -> DataFrame:
    """Files, folders or globs with a header line each, read by position with a fixed schema.

    A value that does not fit its type, a missing field and an empty field are null. ``escape='"'``
    reads files whose quotes are doubled; give ``write_sequences_csv`` the same setting.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.options(**_options(escape)).csv(paths, header=True, schema=schema)


def parse_csv_lines(
    lines: Column | str, schema: T.StructType = POSITIONS_SCHEMA, escape: str | None = None
) -> Column:
    """The same tolerant reading for CSV lines held in a text column, as a struct."""
    return F.from_csv(lines, schema.toDDL(), {"mode": "PERMISSIVE", **_options(escape)})


def write_sequences_csv(
    df: DataFrame,
    path: str,
    columns: Sequence[str] | None = None,
    escape: str | None = None,
    mode: str = "errorifexists",
) -> None:
    """Header and a fixed column order, by default that of the positions.

    Blanks at the ends of a value and microseconds are kept; an empty text is an empty field.
    """
    chosen = list(columns) if columns else POSITIONS_SCHEMA.fieldNames()
    options = {
        "emptyValue": "",
        "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
        "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
        **_options(escape),
    }
    df.select(*chosen).write.options(**options).csv(path, header=True, mode=mode)
