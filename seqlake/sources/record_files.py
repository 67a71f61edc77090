"""``records``: a data source of text files in mixed encodings, each read as a stream.

A file is UTF-8, with or without a mark at its start, or else in ``encoding`` (CP932 if not given) with what cannot
be decoded replaced; which of the two is found out file by file. Line ends become ``\\n``. By ``rows``:

- ``line`` (default): ``path, line, text``, a row for each line, counted from 0. No file is ever held as a whole.
- ``file``: ``path, text``, a row for each file.

Files are dealt out by size, about ``partitionBytes`` to a task. Paths may hold ``* ? []``, and a folder stands for
the files in it; names that start with ``_`` or ``.`` are left out. Written, the column ``text`` goes to one file a task
in ``encoding``, a line each; a file appears only when it is whole, so a task may be run again.
"""

from __future__ import annotations

import codecs
import fnmatch
import io
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

NAME = "records"
ENCODING = "cp932"
PARTITION_BYTES = 64 << 20
_CHUNK = 1 << 20
_BATCH_BYTES = 4 << 20
_WILD = set("*?[")
LINES = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("line", T.LongType()), T.StructField("text", T.StringType())
])
FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType())])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _hidden(path: str) -> bool:
    return posixpath.basename(path).startswith(("_", "."))


def matching_files(path: str) -> list[tuple[str, int]]:
    """Files of a path, folder or pattern with their sizes, in order of their names. None is an error."""
    store, where = _open(path)
    parts = where.rstrip("/").split("/")
    wild = next((i for i, part in enumerate(parts) if _WILD & set(part)), len(parts))
    found = [store.get_file_info("/".join(parts[:wild]) or "/")]
    for pattern in parts[wild:]:
        inside = [
            info for folder in found if folder.type == fs.FileType.Directory
            for info in store.get_file_info(fs.FileSelector(folder.path, allow_not_found=True))
        ]
        found = [info for info in inside if fnmatch.fnmatchcase(posixpath.basename(info.path), pattern)]
    files = []
    for info in found:
        if info.type == fs.FileType.Directory:
            files += [inner for inner in store.get_file_info(fs.FileSelector(info.path)) if inner.type == fs.FileType.File and not _hidden(inner.path)]
        elif info.type == fs.FileType.File:
            files.append(info)
    if not files:
        raise FileNotFoundError(f"no file at {path}")
    return sorted({(info.path, info.size) for info in files})


def _is_utf8(store: fs.FileSystem, path: str) -> bool:
    decoder = codecs.getincrementaldecoder("utf-8")()
    with store.open_input_stream(path, compression=None) as stream:
        try:
            while chunk := stream.read(_CHUNK):
                decoder.decode(chunk)
            decoder.decode(b"", final=True)
        except UnicodeDecodeError:
            return False
    return True


def open_text(store: fs.FileSystem, path: str, encoding: str = ENCODING) -> io.TextIOWrapper:
    """The file as text with ``\\n`` for line ends, decoded piece by piece."""
    utf8 = _is_utf8(store, path)
    raw = store.open_input_stream(path, compression=None)
    return io.TextIOWrapper(raw, encoding="utf-8-sig" if utf8 else encoding, errors="replace", newline=None)


@dataclass
class Share(InputPartition):
    """The files of one task."""

    files: tuple[str, ...]


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.by_line = options["path"], "line" in schema.fieldNames()
        self.encoding = options.get("encoding", ENCODING)
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[Share]:
        shares, current, size = [], [], 0
        for path, length in matching_files(self.path):
            if current and size + length > self.bytes:
                shares.append(Share(tuple(current)))
                current, size = [], 0
            current.append(path)
            size += length
        return [*shares, Share(tuple(current))]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.path)
        for path in partition.files:
            with open_text(store, path, self.encoding) as text:
                if self.by_line:
                    yield from self._lines(path, text)
                else:
                    yield pa.RecordBatch.from_pydict({"path": [path], "text": [text.read()]})

    def _lines(self, path: str, text: io.TextIOWrapper) -> Iterator[pa.RecordBatch]:
        lines, size, first = [], 0, 0
        for line in text:
            lines.append(line.removesuffix("\n"))
            size += len(line)
            if size >= _BATCH_BYTES:
                yield self._batch(path, first, lines)
                first, lines, size = first + len(lines), [], 0
        if lines:
            yield self._batch(path, first, lines)

    @staticmethod
    def _batch(path: str, first: int, lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "path": pa.array([path] * len(lines)), "line": pa.array(range(first, first + len(lines)), pa.int64()), "text": pa.array(lines, pa.string()),
        })


class RecordWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.encoding = options["path"], options.get("encoding", "utf-8")

    def write(self, rows) -> WriterCommitMessage:
        store, folder = _open(self.path)
        store.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}.txt"
        hidden = f"{folder}/.{name}"
        with store.open_output_stream(hidden, compression=None) as out:
            for row in rows:
                if row.text is not None:
                    out.write(f"{row.text}\n".encode(self.encoding, errors="replace"))
        store.move(hidden, f"{folder}/{name}")
        return WriterCommitMessage()


class RecordFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        rows = self.options.get("rows", "line")
        if rows not in ("line", "file"):
            raise ValueError(f"rows must be 'line' or 'file', not {rows!r}")
        return LINES if rows == "line" else FILES

    def reader(self, schema: T.StructType) -> RecordReader:
        return RecordReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> RecordWriter:
        if overwrite:
            raise ValueError("records can only be appended to")
        return RecordWriter(dict(self.options))


def read_records(spark: SparkSession, path: str, rows: str = "line", **options: str) -> DataFrame:
    """``path, line, text`` or ``path, text``: see above."""
    spark.dataSource.register(RecordFiles)
    return spark.read.format(NAME).options(rows=rows, **options).load(path)


def write_records(df: DataFrame, path: str, encoding: str = "utf-8") -> None:
    """Append the column ``text``, a line each; null is left out."""
    df.sparkSession.dataSource.register(RecordFiles)
    df.select("text").write.format(NAME).mode("append").option("encoding", encoding).save(path)
