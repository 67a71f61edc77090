"""S1–S11 and R1: scans, sources, sinks and flows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driver_queries.common import read, read_spread
from driver_queries.silver import KIF_SQL, feed_records, kif_records
from seqlake.operators import event_log
from seqlake.operators.kif import parse_kif
from seqlake.plans import audits, flows
from seqlake.session import scratch_path
from seqlake.sources.csv_files import parse_csv_lines, read_sequences_csv, write_sequences_csv
from seqlake.sources.record_files import read_records, write_records
from seqlake.sources.records import decode_text, in_slices
from seqlake.sources.tables import append_bronze, publish, read_version, roll_back
from seqlake.sources.web import day_urls, first_extract, listing_links
from seqlake.spec import EXPECTATIONS, Layers

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
LINE_SCHEMA = T.StructType([
    T.StructField("order_key", T.LongType()),
    T.StructField("part_key", T.LongType()),
    T.StructField("flag", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("quantity", T.DoubleType()),
])
STAMP = datetime(2024, 2, 1, 12, 30)
# Letters to kana, to have text that both encodings can write.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
KANA = "あいうえおかきくけこさしすせそたちつてとなにぬねのは"


def s1(spark, folder):
    path = scratch_path(spark, "events-csv")
    columns = EVENT_SCHEMA.fieldNames()
    # Odd users have no value, to have empty fields.
    rows = read(spark, folder, "events").withColumn("value", F.when(F.col("user_id") % 2 == 0, F.col("value")))
    write_sequences_csv(rows, path, columns)
    return read_sequences_csv(spark, path, EVENT_SCHEMA)


def s2(spark, folder):
    path = scratch_path(spark, "events-parts")
    events = read(spark, folder, "events")
    quiet = F.col("event_type").isin("view", "click")
    write_sequences_csv(events.filter(quiet), f"{path}/part_a", events.columns)
    write_sequences_csv(events.filter(~quiet), f"{path}/part_b", events.columns)
    return read_sequences_csv(spark, f"{path}/part_[ab]/*.csv", EVENT_SCHEMA)


def s3(spark, folder):
    """Lines of CSV text with damage by line number: a word for a number, an unclosed quote, fields
    missing at the end."""
    number = F.col("l_linenumber")
    part = F.when(number == 3, "abc").otherwise(F.col("l_partkey").cast("string"))
    flag = F.when(number == 2, F.concat(F.lit('"'), "l_returnflag")).otherwise(F.col("l_returnflag"))
    head = F.concat_ws(",", F.col("l_orderkey").cast("string"), part, flag)
    quantity = F.col("l_quantity").cast("int").cast("string")
    tail = F.when(number == 5, "").otherwise(F.concat(F.lit(","), number.cast("string"), F.lit(","), quantity))
    lines = read_spread(spark, folder, "lineitem").select(F.concat(head, tail).alias("line"))
    return lines.select(parse_csv_lines("line", LINE_SCHEMA).alias("row")).select("row.*")


def s4(spark, folder):
    span = read(spark, folder, "events").agg(
        F.max("ts").cast("date").alias("last_day"),
        (F.datediff(F.max("ts"), F.min("ts")) + 1).alias("days"),
    )
    return day_urls(span, "https://feed.example/x", "last_day", F.col("days"))


def s5(spark, folder):
    return listing_links(read_spread(spark, folder, "pages"), "url", "html", 'href="([^"]+)"')


def s6(spark, folder):
    """A JSON answer per document: an empty page first, then one with the whole text. Beside them, broken answers."""
    page = F.struct(F.col("text").alias("extract"))
    empty = F.struct(F.lit("").alias("extract"))
    pages = F.create_map(F.lit("0"), empty, F.concat(F.lit("p"), F.col("doc_id").cast("string")), page)
    answer = F.to_json(F.struct(F.struct(pages.alias("pages")).alias("query")))
    documents = read_spread(spark, folder, "documents")
    broken = documents.filter("lang = 'de'").select((-F.col("doc_id") - 1).alias("doc_id"), F.lit('{"query": {}}').alias("answer"))
    return documents.select("doc_id", answer.alias("answer")).unionByName(broken).select("doc_id", first_extract("answer").alias("extract"))


def s6_props(spark, folder):
    """``props`` as the body of a page."""
    answer = F.concat(
        F.lit('{"query":{"pages":{"1":{"extract":""},"2":{"extract":"'),
        F.regexp_replace("props", '"', "'"), F.lit('"}}}}'),
    )
    return read_spread(spark, folder, "events").select("event_id", first_extract(answer).alias("extract"))


def s7(spark, folder):
    name = uuid.uuid4().hex
    table, path = f"bronze_{name}", scratch_path(spark, "bronze")
    documents = read(spark, folder, "documents")
    # Empty bodies come with the others, and are not appended.
    empty = documents.filter("lang = 'de'").select((-F.col("doc_id") - 1).alias("doc_id"), F.lit("").alias("body"), "source")
    rows = documents.select("doc_id", F.col("text").alias("body"), "source").unionByName(empty)
    for _ in range(2):
        append_bronze(rows, table, STAMP, "body", path)
    appended = spark.read.table(table)
    return appended.groupBy("doc_id", "source", "fetched_at").agg(
        F.count(F.lit(1)).alias("versions"), F.max(F.length("body")).alias("chars")
    )


@F.arrow_udf(T.BinaryType())
def _cp932(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for text in texts:
        yield from in_slices(lambda value: value.encode("cp932", errors="replace"), text, pa.binary())


def s8(spark, folder):
    """English texts in ASCII are turned to kana and written in CP932, the others in UTF-8."""
    plain = (F.col("lang") == "en") & F.col("text").rlike(r"^[\x00-\x7f]*$")
    content = F.coalesce(
        _cp932(F.when(plain, F.translate("text", LETTERS, KANA))), F.col("text").cast("binary")
    )
    return read_spread(spark, folder, "documents").select("doc_id", decode_text(content).alias("text"))


def s8_files(spark, folder):
    """The same texts written to files in both encodings, read back as lines, each with its number of copies."""
    path = scratch_path(spark, "records")
    documents = read_spread(spark, folder, "documents").filter(F.col("text").isNotNull())
    plain = (F.col("lang") == "en") & F.col("text").rlike(r"^[\x00-\x7f]*$")
    write_records(documents.filter(plain).select(F.translate("text", LETTERS, KANA).alias("text")), path, "cp932")
    write_records(documents.filter(~plain), path)
    return read_records(spark, f"{path}/*.txt").groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def s9(spark, folder):
    return parse_kif(kif_records(spark, folder), "game_id", "body")


def s10(spark, folder):
    path = scratch_path(spark, "positions-csv")
    conv = F.col("conv_id").cast("string")
    rows = read(spark, folder, "conversations").select(
        F.col("text").alias("pv"),
        F.length("text").alias("score_cp"),
        conv.alias("game_id"),
        F.col("turn").cast("int").alias("move_number"),
        F.concat(F.lit('"'), "role", F.lit('", '), conv).alias("sfen"),
        F.concat(F.lit("\\"), "role").alias("prev_sfen"),
        F.when(F.col("turn") > 0, F.col("role")).otherwise("").alias("move_usi"),
        F.col("role").alias("player"),
        F.concat(F.lit(" "), "role").alias("black_player"),
        F.concat("role", F.lit(" ")).alias("white_player"),
        F.lit(None).cast("string").alias("best_move"),
    )
    one_line = rows.withColumn("pv", F.regexp_replace("pv", r"[\r\n]+", "|"))
    write_sequences_csv(one_line, path, escape='"')
    return read_sequences_csv(spark, path, escape='"')


def s11(spark, folder):
    table, path = f"gold_{uuid.uuid4().hex}", scratch_path(spark, "published")
    orders = read(spark, folder, "orders")
    publish(orders.limit(0), table, path)
    return publish(orders, table, path)


def s11_versions(spark, folder):
    """Three versions of other columns and formats, the first of which readers have again at the end."""
    table, path = f"gold_{uuid.uuid4().hex}", scratch_path(spark, "versions")
    orders = read(spark, folder, "orders")
    publish(orders, table, path)
    pinned = read_version(spark, table, 1)
    publish(orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), table, path, format="json")
    publish(spark.read.table(table).withColumn("twice", F.col("n") * 2), table, path, format="orc")
    roll_back(spark, table, 1)
    by_version = [
        pinned.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit(1)),
        read_version(spark, table, 2).withColumn("version", F.lit(2)),
        read_version(spark, table, 3).select("o_orderstatus", F.col("twice").alias("n"), F.lit(3).alias("version")),
        spark.read.table(table).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit(0)),
    ]
    return by_version[0].unionByName(by_version[1]).unionByName(by_version[2]).unionByName(by_version[3])


def _flow_inputs(spark, folder):
    """Landing files and Bronze tables of the three flows, from the given tables."""
    base, name = scratch_path(spark, "flows"), uuid.uuid4().hex[:12]
    layers = Layers("landing", f"bronze_{name}", f"silver_{name}", f"gold_{name}", location=base)
    flows.create_schema(spark, layers, "bronze")
    conversations = read(spark, folder, "conversations")
    positions = conversations.select(
        F.when(F.col("role") != "system", F.col("conv_id").cast("string")).alias("game_id"),
        F.col("turn").cast("int").alias("move_number"),
        F.regexp_replace("text", r"\s+", " ").alias("sfen"),
        F.col("role").alias("prev_sfen"),
        F.substring("role", 1, 2).alias("move_usi"),
        F.when(F.col("role") == "user", "black").when(F.col("role") == "assistant", "white").alias("player"),
        F.lit("b").alias("black_player"),
        F.lit("w").alias("white_player"),
        F.lit("us").alias("best_move"),
        F.length("text").alias("score_cp"),
        F.lit("pv").alias("pv"),
    )
    write_sequences_csv(positions, f"{base}/landing", escape='"')
    feed = feed_records(spark, folder).select("game_id", F.col("body").alias("csa"), "source")
    append_bronze(feed, layers.table("bronze", "floodgate_raw"), STAMP, "csa", layers.path("bronze", "floodgate_raw"))
    articles = read(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("strategy"), F.col("text").alias("raw_content"), "source"
    )
    append_bronze(articles, layers.table("bronze", "wikipedia_raw"), STAMP, "raw_content", layers.path("bronze", "wikipedia_raw"))
    return layers, {
        "positions": f"{base}/landing",
        "feed": layers.table("bronze", "floodgate_raw"),
        "knowledge": layers.table("bronze", "wikipedia_raw"),
    }


def _run_flows(spark, folder):
    layers, sources = _flow_inputs(spark, folder)
    reports = flows.run_all(spark, layers, sources)
    errors = [report.error for report in reports if report.error]
    if errors:
        raise RuntimeError("; ".join(errors))
    return layers, reports


def r1(spark, folder):
    """The expectation counts of the flows."""
    _, reports = _run_flows(spark, folder)
    counts = [report.expectations(spark) for report in reports]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def r1_rerun(spark, folder):
    """Three runs of the flows: all new, nothing changed, and after one more article for each document in German.

    Each with the tables it made, and how many rows they hold.
    """
    layers, sources = _flow_inputs(spark, folder)
    rows = []

    def run(number):
        for report in flows.run_all(spark, layers, sources, only_changed=True):
            if report.error:
                raise RuntimeError(report.error)
            held = {dataset: passed + failed for dataset, _, passed, failed in report.counts}
            rows.extend((number, name, state, held[name]) for name, state in report.states.items())

    run(1)
    run(2)
    more = read(spark, folder, "documents").filter("lang = 'de'").select(
        F.concat(F.lit("more "), F.col("doc_id").cast("string")).alias("strategy"), F.col("text").alias("raw_content"), "source"
    )
    append_bronze(more, layers.table("bronze", "wikipedia_raw"), STAMP, "raw_content", layers.path("bronze", "wikipedia_raw"))
    run(3)
    return spark.createDataFrame(rows, "run int, dataset string, state string, rows bigint")


def r1_gate(spark, folder):
    """The rules that a run of the flows does not meet, read back from its event log."""
    layers, _ = _run_flows(spark, folder)
    results = event_log.expectation_results(spark.read.table(layers.table("gold", "event_log")))
    return event_log.gate(results, EXPECTATIONS)


def r1_audits(spark, folder):
    """What the audits find in the tables of the flows: every check, with its number of bad rows."""
    layers, _ = _run_flows(spark, folder)
    return audits.audit_tables(spark, layers)


def _checks_sql():
    """(dataset, check) of every audit as SQL values."""
    rows = []
    for name, rules in audits.AUDITS.items():
        checks = [f"{c} {rule}" for rule, columns in (
            ("null", rules.not_null), ("null after the start", rules.after_start), ("empty", rules.not_empty),
            ("negative", rules.not_negative), ("not_in", rules.one_of),
        ) for c in columns]
        checks += ["empty table", "columns"] + [f"{a} = {b}" for a, b in rules.equal]
        checks += [check for check, wanted in (
            ("duplicate keys", rules.unique), ("sequence gaps", rules.sequence), ("chain breaks", rules.chain),
            ("inconsistent keys", rules.constant), ("series", rules.series), ("rows of the source", rules.rows_of),
        ) if wanted]
        rows += [f"('{name}', '{check}')" for check in checks]
    return ", ".join(rows)


FLOWS_SQL = """
        WITH c AS (SELECT CASE WHEN role != 'system' THEN conv_id END AS game_id, turn, role FROM conversations),
        d AS (SELECT DISTINCT game_id, turn, role FROM c
              QUALIFY row_number() OVER (PARTITION BY game_id, turn) = 1),
        n AS (SELECT count(*) AS n, count(game_id) AS keyed, count(*) FILTER (WHERE role != 'system') AS known,
                     count(DISTINCT coalesce(game_id, -1)) AS games FROM d),
        m AS (SELECT count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
              WHERE line != ''),
        k AS (SELECT count(*) AS n FROM documents)
        SELECT 'positions' AS dataset, 'valid_game_id' AS name, keyed AS passed_records, n - keyed AS failed_records FROM n
        UNION ALL SELECT 'positions', 'valid_move_number', n, 0 FROM n
        UNION ALL SELECT 'positions', 'valid_player', known, n - known FROM n
        UNION ALL SELECT 'position_features', 'valid_move_quality', n, 0 FROM n
        UNION ALL SELECT 'game_summary', 'final_score_not_null', games, 0 FROM n
        UNION ALL SELECT 'game_summary', 'valid_players', games, 0 FROM n
        UNION ALL SELECT 'floodgate_positions', unnest(['valid_game_id', 'valid_move_number', 'valid_player']), n, 0 FROM m
        UNION ALL SELECT 'floodgate_position_features', 'search_text_not_null', n, 0 FROM m
        UNION ALL SELECT 'joseki_knowledge', unnest(['strategy_not_null', 'content_not_null', 'source_not_null']), n, 0 FROM k
        UNION ALL SELECT 'joseki_features', 'search_text_not_null', n, 0 FROM k"""

QUERIES = {
    "S1_typed_csv": s1,
    "S2_many_files": s2,
    "S3_tolerant_rows": s3,
    "S4_day_urls": s4,
    "S5_listing_links": s5,
    "S6_first_extract": s6,
    "S6_first_extract_props": s6_props,
    "S7_append_bronze": s7,
    "S8_mixed_encodings": s8,
    "S8_files": s8_files,
    "S9_parse_kif": s9,
    "S10_export_csv": s10,
    "S11_publish": s11,
    "S11_versions": s11_versions,
    "R1_flows": r1,
    "R1_rerun": r1_rerun,
    "R1_gate": r1_gate,
    "R1_audits": r1_audits,
}

ORACLES = {
    "S1_typed_csv": """
        SELECT event_id, ts, user_id, event_type, CASE WHEN user_id % 2 = 0 THEN value END AS value, props
        FROM events""",
    "S2_many_files": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "S3_tolerant_rows": """
        SELECT l_orderkey AS order_key, CASE WHEN l_linenumber != 3 THEN l_partkey END AS part_key,
               CASE WHEN l_linenumber = 2
                    THEN l_returnflag || ',2,' || CAST(CAST(floor(l_quantity) AS INTEGER) AS VARCHAR)
                    ELSE l_returnflag END AS flag,
               CASE WHEN l_linenumber NOT IN (2, 5) THEN l_linenumber END AS line_number,
               CASE WHEN l_linenumber NOT IN (2, 5) THEN floor(l_quantity) END AS quantity
        FROM lineitem""",
    "S4_day_urls": """
        WITH span AS (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events),
        days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM span)
        SELECT day, 'https://feed.example/x/' || strftime(day, '%Y/%m/%d') || '/' AS url FROM days""",
    "S5_listing_links": """
        WITH links AS (SELECT url, regexp_extract_all(html, 'href="([^"]+)"', 1)[1:10] AS l FROM pages),
        each_link AS (SELECT url, unnest(l) AS link, generate_subscripts(l, 1) - 1 AS place FROM links),
        named AS (SELECT *, url || link AS link_url FROM each_link)
        SELECT url, CAST(place AS INTEGER) AS place, link_url,
               regexp_replace(split_part(link_url, '/', -1), '\\.[^.]*$', '') AS key
        FROM named""",
    "S6_first_extract": """
        SELECT doc_id, text AS extract FROM documents
        UNION ALL SELECT -doc_id - 1, '' FROM documents WHERE lang = 'de'""",
    "S6_first_extract_props": "SELECT event_id, replace(props, '\"', chr(39)) AS extract FROM events",
    "S7_append_bronze": """
        SELECT doc_id, source, TIMESTAMP '2024-02-01 12:30:00' AS fetched_at, 2 * count(*) AS versions,
               CAST(max(length(text)) AS INTEGER) AS chars
        FROM documents GROUP BY doc_id, source""",
    "S8_mixed_encodings": f"""
        SELECT doc_id, CASE WHEN lang = 'en' AND regexp_full_match(text, '[\\x00-\\x7f]*')
               THEN translate(text, '{LETTERS}', '{KANA}')
               ELSE text END AS text FROM documents""",
    "S8_files": f"""
        WITH texts AS (
          SELECT CASE WHEN lang = 'en' AND regexp_full_match(text, '[\\x00-\\x7f]*')
                 THEN translate(text, '{LETTERS}', '{KANA}') ELSE text END AS text FROM documents)
        SELECT text, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM texts) GROUP BY text""",
    "S9_parse_kif": "WITH" + KIF_SQL + """
        SELECT game_id, move_number, move_usi, black_player, white_player FROM plies
        UNION ALL
        SELECT concat(conv_id, '-', turn), 0, '', CAST(conv_id AS VARCHAR), role FROM conversations""",
    "S10_export_csv": """
        SELECT CAST(conv_id AS VARCHAR) AS game_id, CAST(turn AS INTEGER) AS move_number,
               '"' || role || '", ' || CAST(conv_id AS VARCHAR) AS sfen, '\\' || role AS prev_sfen,
               CASE WHEN turn > 0 THEN role END AS move_usi, role AS player, ' ' || role AS black_player,
               role || ' ' AS white_player, CAST(NULL AS VARCHAR) AS best_move,
               CAST(length(text) AS INTEGER) AS score_cp,
               regexp_replace(text, '[\\r\\n]+', '|', 'g') AS pv
        FROM conversations""",
    "S11_publish": "SELECT * FROM orders",
    "S11_versions": """
        SELECT o_orderstatus, CASE version WHEN 3 THEN 2 ELSE 1 END * count(*) AS n, CAST(version AS INTEGER) AS version
        FROM orders, range(4) t(version) GROUP BY o_orderstatus, version""",
    "R1_audits": f"""
        WITH wanted(dataset, "check") AS (VALUES {_checks_sql()}),
        c AS (SELECT CASE WHEN role != 'system' THEN conv_id END AS game_id, turn, role,
                          regexp_replace(text, '\\s+', ' ', 'g') AS sfen FROM conversations),
        d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY game_id, turn ORDER BY sfen) = 1),
        w AS (SELECT *, row_number() OVER g - 1 AS place, lag(sfen) OVER g AS before
              FROM d WINDOW g AS (PARTITION BY game_id ORDER BY turn)),
        found AS (
          SELECT unnest(['positions', 'position_features', 'game_summary']) AS dataset, 'game_id null' AS "check",
                 count(*) AS bad_rows FROM d WHERE game_id IS NULL
          UNION ALL SELECT 'positions', 'sequence gaps', count(*) FROM w WHERE place != turn
          UNION ALL SELECT 'positions', 'chain breaks', count(*) FROM w
            WHERE CASE WHEN turn = 0 THEN sfen != role ELSE role != before END)
        SELECT dataset, "check", coalesce(bad_rows, 0) AS bad_rows FROM wanted LEFT JOIN found USING (dataset, "check")""",
    "R1_flows": FLOWS_SQL,
    "R1_rerun": f"""
        WITH held AS (SELECT DISTINCT dataset, passed_records + failed_records AS rows FROM ({FLOWS_SQL})),
        german AS (SELECT count(*) AS n FROM documents WHERE lang = 'de')
        SELECT CAST(run AS INTEGER) AS run, dataset,
               CASE WHEN run = 1 OR run = 3 AND dataset LIKE 'joseki%' THEN 'ran' ELSE 'unchanged' END AS state,
               CASE WHEN run = 3 AND dataset LIKE 'joseki%' THEN rows + n ELSE rows END AS rows
        FROM held, german, range(1, 4) t(run)""",
    "R1_gate": f"""
        SELECT dataset, name, 'failed_records=' || failed_records AS reason FROM ({FLOWS_SQL})
        WHERE failed_records > 0""",
}
