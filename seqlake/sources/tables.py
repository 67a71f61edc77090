"""Appending to Bronze and publishing Silver and Gold tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

# Versions of a published table that are kept beside the current one.
KEEP_VERSIONS = 10
# Tables hold texts, often the same one in several columns, which Spark's own choice for a format packs loosely.
COMPRESSION = {"parquet": "zstd", "orc": "zstd"}
_FOLDER = "version-"
_VERSION_MARK = "__v"
_NOTE = "note."


def _writer(df: DataFrame, format: str) -> DataFrameWriter:
    writer = df.write.format(format)
    return writer.option("compression", COMPRESSION[format]) if format in COMPRESSION else writer


def append_rows(df: DataFrame, table: str, path: str | None = None, format: str = "parquet") -> None:
    writer = _writer(df, format).mode("append")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def append_bronze(
    df: DataFrame,
    table: str,
    fetched_at: datetime | Column,
    body: str,
    path: str | None = None,
    format: str = "parquet",
) -> None:
    """Append the rows that have a body, stamped with the time of the fetch; never overwrite."""
    stamp = fetched_at if isinstance(fetched_at, Column) else F.lit(fetched_at)
    rows = df.filter(F.col(body) != "").withColumn("fetched_at", stamp.cast("timestamp"))
    append_rows(rows, table, path, format)


def _home(spark: SparkSession, table: str) -> str:
    *schema, name = table.split(".")
    return f"{spark.catalog.getDatabase('.'.join(schema) or spark.catalog.currentDatabase()).locationUri}/{name}"


def version_table(table: str, version: int) -> str:
    """The name under which one version of a published table is kept."""
    return f"{table}{_VERSION_MARK}{version:06d}"


@dataclass(frozen=True)
class Version:
    """One version of a published table: what it was written as, and whether readers get it now."""

    number: int
    location: str
    format: str
    columns: tuple[str, ...]
    current: bool


def _described(spark: SparkSession, table: str) -> dict[str, str]:
    return {row["col_name"]: row["data_type"] for row in spark.sql(f"DESCRIBE FORMATTED {table}").collect()}


def _numbers(spark: SparkSession, table: str) -> list[int]:
    *schema, name = table.split(".")
    inside = f" IN {'.'.join(schema)}" if schema else ""
    found = spark.sql(f"SHOW TABLES{inside} LIKE '{name}{_VERSION_MARK}*'").collect()
    tails = [row["tableName"].rsplit(_VERSION_MARK, 1)[1] for row in found]
    return sorted(int(tail) for tail in tails if tail.isdigit())


def current_version(spark: SparkSession, table: str) -> int | None:
    """The version that readers of the table get, None if there is none."""
    if not spark.catalog.tableExists(table):
        return None
    number = _described(spark, table).get("View Text", "").rsplit(_VERSION_MARK, 1)[-1]
    return int(number) if number.isdigit() else None


def versions(spark: SparkSession, table: str) -> list[Version]:
    """The manifest of the table: all versions that are kept, oldest first; a version that never came to be current too."""
    now = current_version(spark, table)
    out = []
    for number in _numbers(spark, table):
        name = version_table(table, number)
        seen = _described(spark, name)
        out.append(Version(number, seen["Location"], seen["Provider"], tuple(spark.read.table(name).columns), number == now))
    return out


def read_version(spark: SparkSession, table: str, version: int) -> DataFrame:
    """One version, whatever is published meanwhile."""
    return spark.read.table(version_table(table, version))


def _register(df: DataFrame, name: str, place: str, format: str, notes: Mapping[str, str]) -> None:
    spark = df.sparkSession
    spark.catalog.createTable(name, path=place, source=format, schema=df.schema)
    if notes:
        pairs = ", ".join(f"'{_NOTE}{key}' = '{_quoted(value)}'" for key, value in notes.items())
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({pairs})")


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def notes_of(spark: SparkSession, table: str) -> dict[str, str]:
    """What the current version was published with; nothing if there is no version."""
    number = current_version(spark, table)
    if number is None:
        return {}
    rows = spark.sql(f"SHOW TBLPROPERTIES {version_table(table, number)}").collect()
    return {row["key"].removeprefix(_NOTE): row["value"] for row in rows if row["key"].startswith(_NOTE)}


def _switch(spark: SparkSession, table: str, version: int) -> None:
    """Point the table's name to a version: one operation of the catalog."""
    spark.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM {version_table(table, version)}")


def publish(
    df: DataFrame,
    table: str,
    path: str | None = None,
    format: str = "parquet",
    keep: int = KEEP_VERSIONS,
    notes: Callable[[], Mapping[str, str]] | None = None,
) -> DataFrame:
    """Replace the table by ``df`` and return the version that was written.

    A version is a folder below ``path`` and a table of its own; the table's name is a view of one of them. First the
    rows are written, then the version is registered, and at last the view is replaced, which is the only step
    readers see. Columns and format may change with a version. A write that dies at any step leaves the table as it
    was, a table can be worked out from itself, and who reads a version keeps it until ``keep`` newer ones are there.
    Of two publishers that draw the same number the second fails before the last step. A plain table of that name
    becomes version 0. ``notes`` is asked once the rows are written; what it says is kept with the version.
    """
    spark = df.sparkSession
    if spark.catalog.tableExists(table) and current_version(spark, table) is None:
        spark.sql(f"ALTER TABLE {table} RENAME TO {version_table(table, 0)}")
        _switch(spark, table, 0)
    number = max(_numbers(spark, table), default=0) + 1
    place = f"{path or _home(spark, table)}/{_FOLDER}{number:06d}-{uuid.uuid4().hex}"
    _writer(df, format).save(place)
    _register(df, version_table(table, number), place, format, notes() if notes else {})
    _switch(spark, table, number)
    _drop(spark, table, [n for n in _numbers(spark, table) if n < number][:-keep] if keep else [])
    return read_version(spark, table, number)


def roll_back(spark: SparkSession, table: str, version: int) -> DataFrame:
    """Give readers an earlier version again."""
    if version not in _numbers(spark, table):
        raise ValueError(f"{table} has no version {version}")
    _switch(spark, table, version)
    return read_version(spark, table, version)


def _delete(spark: SparkSession, place: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(place)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _drop(spark: SparkSession, table: str, numbers: list[int]) -> None:
    for number in numbers:
        place = _described(spark, version_table(table, number))["Location"]
        spark.sql(f"DROP TABLE {version_table(table, number)}")
        _delete(spark, place)


def drop_old_versions(spark: SparkSession, table: str) -> int:
    """Delete all versions but the current one, and what dead writes left, and return the number of folders.

    To be called when nobody reads an earlier version or publishes the table.
    """
    now = current_version(spark, table)
    place = spark._jvm.org.apache.hadoop.fs.Path(_described(spark, version_table(table, now))["Location"])
    old = [number for number in _numbers(spark, table) if number != now]
    _drop(spark, table, old)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    left = [
        status.getPath() for status in files.listStatus(place.getParent())
        if status.getPath().getName().startswith(_FOLDER) and status.getPath().getName() != place.getName()
    ]
    return len(old) + sum(files.delete(folder, True) for folder in left)
