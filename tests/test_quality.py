import datetime as dt
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.operators import audit_state, event_log, quality
from seqlake.spec import EXPECTATIONS, SequenceSpec

SPEC = SequenceSpec(key="k", order="n", state="s", prev_state="p")
CUT = replace(SPEC, bucket_rows=2)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_expectations_keep_all_rows_and_null_fails(spark, tmp_path):
    rules = {"known": "k IS NOT NULL", "positive": "n >= 0"}
    df = spark.createDataFrame([("a", 1), (None, None), ("b", -1)], "k string, n int")
    checked, observation = quality.expect(df, rules)
    checked.write.parquet(f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3
    assert quality.observed_counts(observation, rules) == [("known", 2, 1), ("positive", 1, 2)]
    assert rows(quality.expectation_counts(df, "t", rules)) == [("t", "known", 2, 1), ("t", "positive", 1, 2)]


def test_expectations_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string")
    assert rows(quality.expectation_counts(df, "t", {"r": "k = 'a'"})) == [("t", "r", 0, 0)]


def test_audit_columns(spark):
    df = spark.createDataFrame([("", 1), (None, -2), ("x", None)], "k string, n int")
    found = quality.audit_columns(df, [
        quality.is_null("k"), quality.is_empty("k"), quality.is_negative("n"), quality.not_in("k", ["x"]),
    ])
    assert rows(found) == [("k", "empty", 1), ("k", "not_in", 1), ("k", "null", 1), ("n", "negative", 1)]


def test_keys_and_counts(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "k string")
    assert rows(quality.duplicate_keys(df, ["k"])) == [("a", 2), (None, 2)]
    assert rows(quality.check_unique(df, ["k"])) == [(5, 3, False)]
    assert rows(quality.check_unique(df.distinct(), ["k"])) == [(3, 3, True)]
    assert rows(quality.check_unique(df.limit(0), ["k"])) == [(0, 0, True)]
    assert rows(quality.check_same_count(df, df.distinct())) == [(5, 3, False)]


@pytest.mark.parametrize("spec", [CUT, SPEC, replace(SPEC, max_order=50)])
def test_sequence_gaps(spark, spec):
    df = spark.createDataFrame([("a", n) for n in range(7)] + [("b", n) for n in (0, 1, 3, 4)], "k string, n int")
    assert rows(quality.sequence_gaps(df, spec)) == [("b", 3, 2), ("b", 4, 3)]


@pytest.mark.parametrize("spec", [CUT, SPEC, replace(SPEC, max_order=50)])
def test_chain_breaks(spark, spec):
    data = [
        ("a", 0, "s0", "s0"), ("a", 1, "s1", "s0"), ("a", 2, "s2", "xx"), ("a", 3, "s3", None), ("a", 4, "s4", "s3"),
        ("b", 0, "s0", "s9"), ("b", 1, None, "s0"), ("b", 2, "s2", "s1"),
    ]
    df = spark.createDataFrame(data, "k string, n int, s string, p string")
    assert rows(quality.chain_breaks(df, spec)) == [("a", 2, "s2", "xx", "s1"), ("b", 0, "s0", "s9", "s0")]


def test_inconsistent_keys(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 1), ("b", "x", 1), ("b", "y", 1)], "k string, c string, d int")
    assert rows(quality.inconsistent_keys(df, "k", ["c", "d"])) == [("b", "x", "y", 1, 1)]


@pytest.mark.parametrize("series, bad", [
    ('[{"n":0,"s":1},{"n":1}]', False), ("[]", False), ('[{"n":1},{"n":0}]', True),
    ('[{"n":0}', True), ("nonsense", True), ('{"n":0}', True), (None, True),
])
def test_bad_series(spark, series, bad):
    df = spark.createDataFrame([(series,)], "score_series_json string")
    assert quality.bad_series(df, "n").count() == int(bad)


def test_check_schema(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "k string, n int")
    assert quality.check_schema(df, df.schema).count() == 0
    assert quality.check_schema(df, {"k", "n"}).count() == 0
    want = T.StructType([T.StructField("k", T.LongType()), T.StructField("m", T.LongType())])
    assert rows(quality.check_schema(df, want)) == [
        ("k", "bigint", "string", 1), ("m", "bigint", None, 0), ("n", None, "int", 2),
    ]


def test_mismatches(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "b")], "x string, y string")
    assert rows(quality.mismatches(df, "x", "y")) == [("a", "b")]


@pytest.mark.parametrize("hours, stale", [(23, False), (24, False), (25, True)])
def test_freshness(spark, hours, stale):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT timestamp'2023-01-01 00:00:00'")
    now = dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)
    assert quality.is_stale(df, "ts", now).first()["is_stale"] is stale


def event(minute, kind, update, details="{}", level="INFO", message="m"):
    return (dt.datetime(2024, 1, 1, 0, minute), kind, level, message, details, (update,))


def flow(*reports):
    entries = [dict(zip(("name", "dataset", "passed_records", "failed_records"), r)) for r in reports]
    return json.dumps({"flow_progress": {"data_quality": {"expectations": entries}}})


def state(value):
    return json.dumps({"update_progress": {"state": value}})


@pytest.fixture
def log(spark):
    events = [
        event(1, "flow_progress", "u1", flow(("r", "c.s.t", 5, 1))),
        event(2, "update_progress", "u1", state("COMPLETED")),
        event(3, "flow_progress", "u2", flow(("r", "c.s.t", 3, 3), ("q", "c.s.t", 1, 0))),
        event(4, "flow_progress", "u2", flow(("r", "c.s.t", 9, 0))),
        event(5, "flow_progress", "u2", "{}"),
        event(6, "update_progress", "u2", state("COMPLETED")),
        event(7, "update_progress", "u3", state("FAILED")),
        event(9, "log", "u3", level="ERROR", message="second"),
        event(8, "log", "u3", level="ERROR", message="first"),
    ]
    schema = ("timestamp timestamp, event_type string, level string, message string, details string, "
              "origin struct<update_id:string>")
    return spark.createDataFrame(events, schema)


def test_expectation_results(log):
    found = lambda df: rows(df.select("dataset", "name", "passed_records", "failed_records"))
    assert found(event_log.expectation_results(log, "u1")) == [("t", "r", 5, 1)]
    newest = event_log.expectation_results(log)
    assert found(newest) == [("t", "q", 1, 0), ("t", "r", 9, 0)]
    assert event_log.expectation_results(log.filter("event_type != 'update_progress'")).count() == 0


def test_gate(log):
    expected = {"t": {"r", "q", "x"}}
    assert rows(event_log.gate(event_log.expectation_results(log), expected)) == [("t", "x", "missing")]
    assert rows(event_log.gate(event_log.expectation_results(log, "u1"), {"t": ["r"]})) == [
        ("t", "r", "failed_records=1")
    ]
    empty = event_log.expectation_results(log, "u1").selectExpr(
        "dataset", "name", "0L AS passed_records", "0L AS failed_records", "timestamp"
    )
    assert event_log.gate(empty, {"t": ["r"]}).count() == 0
    assert rows(event_log.gate(empty, {"t": ["r"]}, require_passed=True)) == [("t", "r", "passed_records=0")]


def test_error_digest(log):
    lines = [r["line"] for r in event_log.error_digest(log, "u3").collect()]
    assert lines == ["[2024-01-01 00:08:00] first", "[2024-01-01 00:09:00] second"]
    assert [r["line"] for r in event_log.error_digest(log, "u1").collect()] == [event_log.NO_ERRORS]


def test_all_tables_have_expectations():
    assert sum(map(len, EXPECTATIONS.values())) == 14


def test_state_of_two_versions_equals_the_audit_of_both(spark, tmp_path, table):
    rows = [(n, n % 7 - 3 if n % 5 else None, f"t{n % 13}", dt.datetime(2024, 1, 1 + n % 20)) for n in range(300)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "id bigint, v int, t string, at timestamp")
    rules, audits = {"positive": "v > 0"}, [quality.is_null("v"), quality.not_in("t", ["t1", "t2"])]

    def state(part):
        return audit_state.audit_state(part, "x", rules, audits, ["id", "v", "t", "at"])

    parts = [df.filter("id < 100"), df.filter("id >= 100 OR id IS NULL"), df.limit(0)]
    for number, part in enumerate(parts):
        audit_state.record_state(state(part), table, number, f"{tmp_path}/s")
    audit_state.record_state(state(parts[0]), table, 0, f"{tmp_path}/s")
    got = {r["check"]: r.asDict() for r in audit_state.audit_of(audit_state.merged(spark.read.table(table))).collect()}
    want = {r["check"]: r.asDict() for r in audit_state.audit_of(state(df)).collect()}
    assert got == want
    counted = {r["name"]: r["passed_records"] for r in quality.expectation_counts(df, "x", rules).collect()}
    assert got["positive"]["passed"] == counted["positive"]
    bad = {f'{r["column"]} {r["rule"]}': r["bad_rows"] for r in quality.audit_columns(df, audits).collect()}
    assert {check: got[check]["bad"] for check in bad} == bad
    values = got["v values"]
    assert (values["bad"], int(values["low_number"]), int(values["high_number"]), values["different"]) == (61, -3, 3, 7)
    assert got["t values"]["low_text"] == "t0" and got["at values"]["high_text"].startswith("2024-01-20")
    assert abs(got["id values"]["different"] - 300) < 15


def test_keys_of_two_versions_equal_the_keys_of_both(spark):
    df = spark.createDataFrame([(n % 40, "x" if n % 3 else None) for n in range(90)], "a int, b string")
    parts = [df.filter("a < 10").withColumn("version", F.lit(1)), df.filter("a >= 10").withColumn("version", F.lit(2))]
    states = [audit_state.key_state(part, ["version", "a", "b"]) for part in parts]
    # A version that was recorded twice.
    merged = audit_state.merged_keys(states[0].unionByName(states[1]).unionByName(states[1]), ["a", "b"])
    assert audit_state.uniqueness_of(merged).collect() == quality.check_unique(df, ["a", "b"]).collect()
    assert sorted(map(tuple, audit_state.duplicates_of(merged).collect()), key=str) == sorted(
        map(tuple, quality.duplicate_keys(df, ["a", "b"]).collect()), key=str
    )
    assert audit_state.uniqueness_of(merged.limit(0)).first().asDict() == {"row_count": 0, "key_count": 0, "is_unique": True}
