import datetime as dt

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from seqlake.sources.csv_files import parse_csv_lines, read_sequences_csv, write_sequences_csv
from seqlake.sources.records import decode_text, read_text_records
from seqlake.sources import record_files, records, tables
from seqlake.sources.record_files import read_records, write_records
from seqlake.sources.tables import (
    append_bronze, append_rows, current_version, drop_old_versions, publish, read_version, roll_back, version_table, versions,
)
from seqlake.sources.web import day_urls, first_extract, listing_links
from seqlake.spec import POSITIONS_SCHEMA
from seqlake.streaming.ingest import append_new_files

HEADER = ",".join(POSITIONS_SCHEMA.fieldNames())


def write(path, *lines, header=HEADER):
    path.write_text("\n".join([header, *lines]) + "\n", encoding="utf-8")
    return str(path)


def test_typed_scan_and_empty_fields(spark, tmp_path):
    path = write(tmp_path / "a.csv", "G1,0,s0,,7g7f,black,Alice,Bob,7g7f,,7g7f 3c3d")
    df = read_sequences_csv(spark, path)
    assert df.schema.simpleString() == POSITIONS_SCHEMA.simpleString()
    row = df.first()
    assert (row["move_number"], row["prev_sfen"], row["score_cp"], row["pv"]) == (0, None, None, "7g7f 3c3d")


def test_header_only_gives_no_rows(spark, tmp_path):
    df = read_sequences_csv(spark, write(tmp_path / "a.csv"))
    assert df.count() == 0 and df.columns == POSITIONS_SCHEMA.fieldNames()


def test_files_folders_and_globs(spark, tmp_path):
    a = write(tmp_path / "a.csv", "G1,0,s,,m,black,A,B,m,1,p")
    b = write(tmp_path / "b.csv", "G2,0,s,,m,black,A,B,m,1,p")
    write(tmp_path / "c.txt", "G3,0,s,,m,black,A,B,m,1,p")
    games = lambda paths: sorted(r["game_id"] for r in read_sequences_csv(spark, paths).collect())
    assert games(a) == ["G1"]
    assert games([a, b]) == ["G1", "G2"]
    assert games(f"{tmp_path}/*.csv") == ["G1", "G2"]
    assert games(f"{tmp_path}/[a].csv") == ["G1"]
    assert games(f"{tmp_path}/?.txt") == ["G3"]
    assert games(str(tmp_path)) == ["G1", "G2", "G3"]
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_sequences_csv(spark, f"{tmp_path}/*.none").count()


DAMAGED = {
    "G1,abc,s,,m,black,A,B,m,1,p": {"game_id": "G1", "move_number": None, "score_cp": 1},
    "G1,1,s,x,m,black,A,B": {"white_player": "B", "best_move": None, "score_cp": None, "pv": None},
    'G1,1,s,x,m,black,A,B,"7g7f,50,7g7f 3c3d': {"best_move": "7g7f,50,7g7f 3c3d", "score_cp": None, "pv": None},
}


@pytest.mark.parametrize("line", DAMAGED)
def test_damaged_rows_are_read_as_far_as_they_go(spark, tmp_path, line):
    from_file = read_sequences_csv(spark, write(tmp_path / "a.csv", line)).first().asDict()
    from_text = spark.createDataFrame([(line,)], "line string").select(parse_csv_lines("line").alias("r")).first()["r"]
    for row in (from_file, from_text.asDict()):
        assert {k: row[k] for k in DAMAGED[line]} == DAMAGED[line]


def test_columns_are_read_by_position(spark, tmp_path):
    header = ",".join(POSITIONS_SCHEMA.fieldNames()[1:])
    path = write(tmp_path / "a.csv", "1,s,x,m,black,A,B,m,1,p", header=header)
    row = read_sequences_csv(spark, path).first()
    assert (row["game_id"], row["move_number"]) == ("1", None)


@pytest.mark.parametrize("escape", [None, '"'])
def test_export_round_trip(spark, tmp_path, escape):
    values = ("G1", 1, 'a "quoted", text', " blank ", "m", "black", "ア", "B\\", "m", -5, "p q")
    df = spark.createDataFrame([values], POSITIONS_SCHEMA).select(*reversed(POSITIONS_SCHEMA.fieldNames()))
    path = f"{tmp_path}/out"
    write_sequences_csv(df, path, escape=escape)
    assert tuple(read_sequences_csv(spark, path, escape=escape).first()) == values
    first_line = next(p for p in (tmp_path / "out").glob("part-*")).read_text(encoding="utf-8").split("\n")[0]
    assert first_line == HEADER


def test_day_urls(spark):
    end = spark.sql("SELECT date'2024-03-01' AS end_day")
    rows = day_urls(end, "https://h/x", "end_day").collect()
    assert [(str(r["day"]), r["url"]) for r in rows] == [
        ("2024-03-01", "https://h/x/2024/03/01/"),
        ("2024-02-29", "https://h/x/2024/02/29/"),
        ("2024-02-28", "https://h/x/2024/02/28/"),
    ]


def test_listing_links_are_capped_in_page_order(spark):
    html = " ".join(f'<a href="game+{n}.v1.rec">' for n in range(15))
    df = spark.createDataFrame([("https://h/d/", html), ("https://h/e/", "none")], "url string, html string")
    rows = listing_links(df, "url", "html", r'(game[^\s"]+\.rec)').orderBy("place").collect()
    assert len(rows) == 10
    assert (rows[3]["link_url"], rows[3]["key"]) == ("https://h/d/game+3.v1.rec", "game+3.v1")


@pytest.mark.parametrize("answer, text", [
    ('{"query":{"pages":{"1":{"extract":"a"}}}}', "a"),
    ('{"query":{"pages":{"1":{"extract":""},"2":{},"3":{"extract":"b"}}}}', "b"),
    ('{"query":{"pages":{"-1":{"missing":""}}}}', ""),
    ('{"query":{}}', ""), ("{}", ""), ("not json", ""), (None, ""),
])
def test_first_extract(spark, answer, text):
    df = spark.createDataFrame([(answer,)], "a string")
    assert df.select(first_extract("a").alias("t")).first()["t"] == text


def test_bronze_is_appended_without_empty_bodies(spark, tmp_path, table):
    df = spark.createDataFrame([("a", "text"), ("b", ""), ("c", None)], "strategy string, raw_content string")
    for hour in (1, 2):
        append_bronze(df, table, dt.datetime(2024, 1, 1, hour), "raw_content", f"{tmp_path}/bronze")
    rows = spark.read.table(table).orderBy("fetched_at").collect()
    assert [(r["strategy"], r["fetched_at"].hour) for r in rows] == [("a", 1), ("a", 2)]


def test_publish_replaces_the_table(spark, tmp_path, table):
    path = f"{tmp_path}/gold"
    assert publish(spark.range(5), table, path).count() == 5
    assert publish(spark.range(2), table, path).count() == 2
    assert publish(spark.range(2).withColumn("more", F.lit(1)), table, path).columns == ["id", "more"]


def test_a_write_that_dies_leaves_the_table_and_a_table_is_made_from_itself(spark, tmp_path, table):
    path = f"{tmp_path}/gold"
    before = publish(spark.range(5), table, path)
    broken = spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("dies"))).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="dies"):
        publish(broken, table, path)
    assert spark.read.table(table).count() == 5
    assert publish(spark.read.table(table).filter("id > 1"), table, path).count() == 3
    assert before.count() == 5
    assert drop_old_versions(spark, table) == 2 and spark.read.table(table).count() == 3


@pytest.mark.parametrize("step", ["write", "_register", "_switch"])
def test_a_write_killed_at_each_step_leaves_the_old_table(spark, tmp_path, table, step, monkeypatch):
    """Also when columns and format change; the next write goes through."""
    path = f"{tmp_path}/gold"
    publish(spark.range(5), table, path)
    fresh = spark.range(9).select(F.col("id").cast("string").alias("name"), F.lit(1).alias("more"))

    def die(*args):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        if step == "write":
            fresh_or_broken = fresh.withColumn("more", F.raise_error(F.lit("killed")).cast("int"))
        else:
            fresh_or_broken = fresh
            patch.setattr(tables, step, die)
        with pytest.raises(Exception, match="killed"):
            publish(fresh_or_broken, table, path, format="json")
    now = spark.read.table(table)
    assert now.columns == ["id"] and now.count() == 5 and current_version(spark, table) == 1
    assert publish(fresh, table, path, format="json").count() == 9
    now = spark.read.table(table)
    assert now.columns == ["name", "more"] and now.schema["more"].dataType.simpleString() == "int"
    assert [v.format for v in versions(spark, table) if v.current] == ["json"]
    drop_old_versions(spark, table)
    assert [v.current for v in versions(spark, table)] == [True] and spark.read.table(table).count() == 9
    assert len([p for p in (tmp_path / "gold").iterdir() if p.name.startswith("version-")]) == 1


def test_readers_keep_their_version_and_history_is_bounded(spark, tmp_path, table):
    path = f"{tmp_path}/gold"
    for n in range(1, 6):
        written = publish(spark.range(n), table, path, keep=2)
        assert written.count() == n
    assert [(v.number, v.current) for v in versions(spark, table)] == [(3, False), (4, False), (5, True)]
    pinned = read_version(spark, table, 4)
    publish(spark.range(50).withColumnRenamed("id", "other"), table, path, keep=2)
    assert pinned.count() == 4 and spark.read.table(table).columns == ["other"]
    assert roll_back(spark, table, 5).count() == 5 and spark.read.table(table).count() == 5
    with pytest.raises(ValueError):
        roll_back(spark, table, 1)
    # The next version is newer than all there were, rolled back or not.
    publish(spark.range(7), table, path)
    assert current_version(spark, table) == 7


def test_a_plain_table_becomes_the_first_version(spark, tmp_path, table):
    spark.range(3).write.option("path", f"{tmp_path}/plain").saveAsTable(table)
    publish(spark.range(4).withColumn("more", F.lit("x")), table, f"{tmp_path}/gold")
    assert spark.read.table(table).count() == 4 and read_version(spark, table, 0).count() == 3
    assert version_table(table, 0).endswith("__v000000")


def test_publish_without_a_path(spark, table):
    assert publish(spark.range(3), table).count() == 3 and publish(spark.range(4), table).count() == 4


def test_text_in_two_encodings(spark, tmp_path):
    text = "先手：一郎\n後手：二郎\n"
    (tmp_path / "a.kif").write_bytes(text.encode("utf-8"))
    (tmp_path / "b.kif").write_bytes(text.encode("cp932"))
    (tmp_path / "c.kif").write_bytes(text.replace("\n", "\r\n").encode("utf-8-sig"))
    (tmp_path / "d.kif").write_bytes(b"\x81\xff\x81\xff")
    rows = {r["path"][-5]: r["text"] for r in read_text_records(spark, f"{tmp_path}/*.kif").collect()}
    assert rows["a"] == rows["b"] == rows["c"] == text
    assert "�" in rows["d"]


TEXTS = {
    "a.kif": "先手：一郎\n後手：二郎\n".encode(), "b.kif": "先手：一郎\n後手：二郎".encode("cp932"), "c.kif": "一\r\n\r二\n".encode("utf-8-sig"),
    "d.kif": b"\x81\xff\x81\xff\nok", "e.kif": b"", "_hidden.kif": b"no", "f.txt": b"other",
}


def test_record_files_as_lines_and_as_files(spark, tmp_path):
    for name, content in TEXTS.items():
        (tmp_path / name).write_bytes(content)
    lines = {}
    for r in read_records(spark, f"{tmp_path}/[a-e].kif", partitionBytes="40").collect():
        lines.setdefault(r["path"][-5], {})[r["line"]] = r["text"]
    assert lines["a"] == lines["b"] == {0: "先手：一郎", 1: "後手：二郎"}
    assert lines["c"] == {0: "一", 1: "", 2: "二"} and "�" in lines["d"][0] and lines["d"][1] == "ok" and "e" not in lines
    files = {r["path"][-5]: r["text"] for r in read_records(spark, f"{tmp_path}/*.kif", rows="file").collect()}
    assert files["b"] == "先手：一郎\n後手：二郎" and files["e"] == "" and files["c"] == "一\n\n二\n"
    old = {r["path"][-5]: r["text"] for r in read_text_records(spark, f"{tmp_path}/*.kif").collect()}
    assert {name: files[name] for name in old} == old
    assert sorted(r["path"][-5] for r in read_records(spark, str(tmp_path), rows="file").collect()) == ["a", "b", "c", "d", "e", "f"]
    with pytest.raises(Exception, match="no file at"):
        read_records(spark, f"{tmp_path}/*.none").count()
    with pytest.raises(Exception, match="rows must be"):
        read_records(spark, str(tmp_path), rows="word").count()


def test_record_files_are_dealt_out_by_size_and_decoded_in_pieces(spark, tmp_path):
    for n in range(12):
        (tmp_path / f"{n:02d}.txt").write_bytes(b"x" * 100)
    shares = record_files.RecordReader({"path": str(tmp_path), "partitionbytes": "250"}, record_files.LINES).partitions()
    assert [len(share.files) for share in shares] == [2] * 6
    # Characters that lie across the pieces in which a file is read.
    long = "漢字" * 700_000
    for name, encoding in (("long8", "utf-8"), ("long932", "cp932")):
        (tmp_path / name).write_bytes(("a" + long + "\nend").encode(encoding))
        got = read_records(spark, f"{tmp_path}/{name}").orderBy("line").collect()
        assert [r["text"] for r in got] == ["a" + long, "end"]


def test_written_records_are_read_back(spark, tmp_path):
    path = f"{tmp_path}/out"
    df = spark.createDataFrame([("一二",), ("two\nlines",), (None,), ("",)], "text string").repartition(2)
    for encoding in ("utf-8", "cp932"):
        write_records(df, path, encoding)
    got = sorted(r["text"] for r in read_records(spark, path).collect())
    assert got == sorted(["一二", "two", "lines", ""] * 2)


def test_undecodable_bytes_do_not_stop_the_others(spark):
    df = spark.createDataFrame([(b"\xff\xfe\xff",), (None,), (b"ok",)], "content binary")
    found = [r["t"] for r in df.select(decode_text("content").alias("t")).collect()]
    assert found[1:] == [None, "ok"] and found[0]


def test_streaming_reads_each_landing_file_once(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    where = str(landing), f"{tmp_path}/bronze", f"{tmp_path}/checkpoint"
    write(landing / "a.csv", "G1,0,s,,m,black,A,B,m,1,p")
    append_new_files(spark, *where)
    append_new_files(spark, *where)
    assert spark.read.parquet(where[1]).count() == 1
    write(landing / "b.csv", "G2,0,s,,m,black,A,B,m,1,p", "G2,1,s,,m,white,A,B,m,1,p")
    append_new_files(spark, *where)
    stored = spark.read.parquet(where[1])
    assert stored.groupBy("game_id").count().orderBy("game_id").collect() == [("G1", 1), ("G2", 2)]
    assert stored.filter(F.col("ingested_at").isNull()).count() == 0


def test_tables_are_packed_tightly(spark, tmp_path, table):
    rows = spark.range(1_000).select("id", F.concat(F.lit("some words of number "), "id").alias("text"))
    publish(rows, table, f"{tmp_path}/published")
    for _ in range(2):
        append_rows(rows, f"{table}_more", f"{tmp_path}/appended")
    found = [str(path) for path in tmp_path.rglob("*.parquet")]
    assert len(found) >= 3 and all(path.endswith(".zstd.parquet") for path in found)
    assert spark.read.table(table).exceptAll(rows).isEmpty() and spark.read.table(f"{table}_more").count() == 2_000
    publish(rows, table, f"{tmp_path}/published", format="json")
    assert spark.read.table(table).count() == 1_000


def test_a_batch_becomes_python_values_in_slices(spark, monkeypatch):
    monkeypatch.setattr(records, "SLICE_BYTES", 2_000)
    held = []
    column = pa.array([None, b"", *[b"x" * 100] * 500], pa.binary())
    parts = [*records.in_slices(lambda raw: held.append(len(raw)) or raw.decode(), column, pa.string())]
    assert pa.concat_arrays(parts).to_pylist() == [None, "", *["x" * 100] * 500] and max(len(part) for part in parts) <= 25
    assert [*records.in_slices(bytes.decode, column.slice(0, 0), pa.string())] == []
    texts = [None, "", *["将棋" * n for n in range(1, 300)]]
    rows = spark.createDataFrame([(i, None if t is None else bytearray(t.encode("cp932"))) for i, t in enumerate(texts)], "i int, raw binary")
    found = rows.repartition(2).select("i", decode_text("raw").alias("text"))
    assert [r["text"] for r in found.orderBy("i").collect()] == texts
    # Not a batch as a series, but an iterator over its slices.
    assert records._decode_cp932.evalType == PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF
