"""Q1–Q14: data quality and monitoring."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from driver_queries.common import EVENTS, EVENTS_SQL, TURNS, TURNS_SQL, read, steps, turns, turns_spec
from seqlake.operators import audit_state, event_log, features, quality
from seqlake.operators.ordered import measured, with_previous
from seqlake.session import scratch_path

EVENT_RULES = {
    "valid_user": "user_id IS NOT NULL",
    "small_value": "value < 50",
    "known_type": "event_type IN ('click', 'view', 'purchase')",
    "null_rule": "nullif(event_type, 'error') IN ('click', 'view')",
}
DOCUMENT_RULES = {
    "has_text": "text IS NOT NULL AND text != ''",
    "english": "lang = 'en'",
    "long_text": "n_chars >= 200",
}
GATE = {
    "click": ["rule_0", "rule_1", "rule_2", "rule_9"],
    "view": ["rule_0", "rule_1", "rule_2"],
    "purchase": ["rule_0", "rule_1", "rule_2"],
    "absent": ["rule_0"],
}


def q1(spark, folder):
    events = quality.expectation_counts(read(spark, folder, "events"), "events", EVENT_RULES)
    documents = quality.expectation_counts(
        read(spark, folder, "documents"), "documents", DOCUMENT_RULES
    )
    return events.unionByName(documents)


def q2_customer(spark, folder):
    return quality.audit_columns(
        read(spark, folder, "customer"),
        [
            quality.is_null("c_custkey"),
            quality.is_empty("c_name"),
            quality.is_negative("c_acctbal"),
            quality.not_in("c_mktsegment", ["BUILDING", "MACHINERY"]),
        ],
    )


def q2_events(spark, folder):
    return quality.audit_columns(
        read(spark, folder, "events"),
        [
            quality.is_null("props"),
            quality.is_empty("event_type"),
            quality.is_negative("value"),
            quality.not_in("event_type", ["click", "view"]),
        ],
    )


def q3(spark, folder):
    return quality.duplicate_keys(read(spark, folder, "documents"), ["text"])


def q4_unique(spark, folder):
    return quality.check_unique(read(spark, folder, "documents"), ["text"])


def q4_same_count(spark, folder):
    rows = turns(spark, folder)
    return quality.check_same_count(rows, features.build_features(rows, turns_spec(spark, folder)))


def q5(spark, folder):
    return quality.sequence_gaps(turns(spark, folder), turns_spec(spark, folder)).select(
        "conv_id", "turn", "expected_order"
    )


def q5_long(spark, folder):
    return quality.sequence_gaps(steps(spark, folder), EVENTS).select(
        "event_type", "event_id", "expected_order"
    )


def _versions(spark, folder):
    """The documents in three versions, as they might have been appended."""
    documents = read(spark, folder, "documents")
    return [documents.filter(F.col("doc_id") % 3 == number) for number in range(3)]


def q2_merged(spark, folder):
    """The audit of all documents from the stored states of their versions; the second one was recorded twice."""
    table, path = f"states_{uuid.uuid4().hex}", scratch_path(spark, "states")
    for number in (0, 1, 1, 2):
        state = audit_state.audit_state(
            _versions(spark, folder)[number], "documents", {"long": "n_chars > 500", "known": "lang IN ('en', 'fr')"},
            [quality.is_empty("text"), quality.not_in("source", ["src0", "src1"])], ["doc_id", "lang", "text"],
        )
        audit_state.record_state(state, table, number, path)
    found = audit_state.audit_of(audit_state.merged(spark.read.table(table)))
    different = F.when(F.col("check") == "lang values", F.col("different"))
    return found.select(
        "check", "rows", "passed", "bad", F.col("low_number").cast("bigint").alias("low_number"),
        F.col("high_number").cast("bigint").alias("high_number"), "low_text", "high_text", different.alias("different"),
    )


def q3_merged(spark, folder):
    """Texts that occur more than once, from the keys of the versions."""
    states = [audit_state.key_state(version, ["text"]) for version in _versions(spark, folder)]
    both = states[0].unionByName(states[1]).unionByName(states[2])
    return audit_state.duplicates_of(audit_state.merged_keys(both, ["text"]))


def q4_merged(spark, folder):
    states = [audit_state.key_state(version, ["text"]) for version in _versions(spark, folder)]
    both = states[0].unionByName(states[1]).unionByName(states[2])
    return audit_state.uniqueness_of(audit_state.merged_keys(both, ["text"]))


def _chain(rows, spec):
    """Each event's state is its value; the state before was the value of the event before it
    by the same rule, spoiled where the event id divides by 11."""
    return with_previous(rows, spec, {"prev_state": "state"}).withColumn(
        "prev_state",
        F.when(F.col("event_id") % 11 == 0, F.col("prev_state") + 1).otherwise(F.col("prev_state")),
    )


def q6(spark, folder):
    rows = steps(spark, folder).select("event_type", "event_id", F.col("score").alias("state"))
    spec = measured(rows, replace(EVENTS, state="state", prev_state="prev_state"))
    return quality.chain_breaks(_chain(rows, spec), spec)


def q7(spark, folder):
    return quality.inconsistent_keys(
        read(spark, folder, "events"), "user_id", ["event_type", "props"]
    )


def q8(spark, folder):
    """The series of every conversation; those of odd conversations are turned round or cut."""
    series = features.series_json(turns(spark, folder), turns_spec(spark, folder))
    text = F.col("score_series_json")
    spoiled = (
        F.when(F.col("conv_id") % 4 == 1, F.expr("substr(score_series_json, 1, length(score_series_json) - 1)"))
        .when(F.col("conv_id") % 4 == 3, F.regexp_replace(text, '"turn":0', '"turn":99'))
        .otherwise(text)
    )
    return quality.bad_series(series.withColumn("score_series_json", spoiled), "turn").select("conv_id")


def q9(spark, folder):
    expected = T.StructType([
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.IntegerType()),
        T.StructField("session_id", T.StringType()),
    ])
    return quality.check_schema(read(spark, folder, "events"), expected)


def q10(spark, folder):
    spoiled = read(spark, folder, "documents").withColumn(
        "n_chars", F.when(F.col("doc_id") % 10 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    )
    return quality.mismatches(spoiled, "n_chars", "length(text)").select("doc_id", "n_chars")


def event_log_of(spark, folder):
    """An event log with one row per event, spread over three updates."""
    kind = F.col("event_type")
    expectation = F.struct(
        F.concat(F.lit("rule_"), (F.col("event_id") % 3).cast("string")).alias("name"),
        F.concat(F.lit("cat.silver."), kind).alias("dataset"),
        F.col("user_id").alias("passed_records"),
        (F.col("event_id") % 4).alias("failed_records"),
    )
    flow = F.to_json(F.struct(F.struct(F.struct(F.array(expectation).alias("expectations"))
                                       .alias("data_quality")).alias("flow_progress")))
    state = F.when(F.col("event_id") % 5 < 2, "COMPLETED").otherwise("RUNNING")
    update = F.to_json(F.struct(F.struct(state.alias("state")).alias("update_progress")))
    return read(spark, folder, "events").select(
        F.col("ts").alias("timestamp"),
        F.when(kind == "signup", "update_progress").when(kind == "error", "log").otherwise("flow_progress")
        .alias("event_type"),
        F.when(kind == "error", "ERROR").otherwise("INFO").alias("level"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"),
        F.when(kind == "signup", update).when(kind == "error", "{}").otherwise(flow).alias("details"),
        F.struct(F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("update_id")).alias("origin"),
    )


def q11(spark, folder):
    return event_log.expectation_results(event_log_of(spark, folder), "u1")


def q11_newest(spark, folder):
    return event_log.expectation_results(event_log_of(spark, folder))


def q12(spark, folder):
    return event_log.gate(q11(spark, folder), GATE)


def q13(spark, folder):
    return quality.is_stale(read(spark, folder, "events"), "ts", datetime(2024, 1, 31, 12))


def q14(spark, folder):
    return event_log.error_digest(event_log_of(spark, folder), "u1")


RESULTS_SQL = """
reports AS (
  SELECT event_type AS dataset, concat('rule_', CAST(event_id % 3 AS VARCHAR)) AS name,
         user_id AS passed_records, event_id % 4 AS failed_records, ts AS timestamp,
         concat('u', CAST(user_id % 3 AS VARCHAR)) AS update_id
  FROM events WHERE event_type NOT IN ('signup', 'error')),
newest AS (
  SELECT concat('u', CAST(user_id % 3 AS VARCHAR)) AS update_id FROM events
  WHERE event_type = 'signup' AND event_id % 5 < 2 ORDER BY ts DESC LIMIT 1),
results AS (
  SELECT dataset, name, passed_records, failed_records, timestamp FROM reports
  WHERE update_id = {update}
  QUALIFY row_number() OVER (PARTITION BY dataset, name ORDER BY timestamp DESC) = 1)
"""


def _counts_sql(table, rules):
    parts = [
        f"SELECT '{table}' AS dataset, '{name}' AS name, "
        f"count(*) FILTER (WHERE coalesce({rule}, false)) AS passed_records, "
        f"count(*) FILTER (WHERE NOT coalesce({rule}, false)) AS failed_records FROM {table}"
        for name, rule in rules.items()
    ]
    return " UNION ALL ".join(parts)


def _audit_sql(table, rules):
    return " UNION ALL ".join(
        f"SELECT '{column}' AS \"column\", '{rule}' AS rule, count(*) FILTER (WHERE {sql}) AS bad_rows FROM {table}"
        for column, rule, sql in rules
    )


QUERIES = {
    "Q1_expectation_counts": q1,
    "Q2_audit_customer": q2_customer,
    "Q2_audit_events": q2_events,
    "Q3_duplicate_keys": q3,
    "Q4_check_unique": q4_unique,
    "Q4_check_same_count": q4_same_count,
    "Q2_merged_states": q2_merged,
    "Q3_merged_keys": q3_merged,
    "Q4_merged_keys": q4_merged,
    "Q5_sequence_gaps": q5,
    "Q5_sequence_gaps_long_keys": q5_long,
    "Q6_chain_breaks": q6,
    "Q7_inconsistent_keys": q7,
    "Q8_bad_series": q8,
    "Q9_check_schema": q9,
    "Q10_mismatches": q10,
    "Q11_expectation_results": q11,
    "Q11_expectation_results_newest": q11_newest,
    "Q12_gate": q12,
    "Q13_is_stale": q13,
    "Q14_error_digest": q14,
}

ORACLES = {
    "Q1_expectation_counts": _counts_sql("events", EVENT_RULES)
    + " UNION ALL "
    + _counts_sql("documents", DOCUMENT_RULES),
    "Q2_audit_customer": _audit_sql("customer", [
        ("c_custkey", "null", "c_custkey IS NULL"),
        ("c_name", "empty", "c_name = ''"),
        ("c_acctbal", "negative", "c_acctbal < 0"),
        ("c_mktsegment", "not_in", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    ]),
    "Q2_audit_events": _audit_sql("events", [
        ("props", "null", "props IS NULL"),
        ("event_type", "empty", "event_type = ''"),
        ("value", "negative", "value < 0"),
        ("event_type", "not_in", "event_type NOT IN ('click', 'view')"),
    ]),
    "Q3_duplicate_keys": 'SELECT text, count(*) AS "count" FROM documents GROUP BY text HAVING count(*) > 1',
    "Q4_check_unique": """
        SELECT count(*) AS row_count, count(DISTINCT text) AS key_count,
               count(*) = count(DISTINCT text) AS is_unique FROM documents""",
    "Q4_check_same_count": """
        SELECT count(*) AS left_rows, count(*) AS right_rows, true AS is_same FROM conversations""",
    "Q2_merged_states": """
        WITH n AS (SELECT count(*) AS n FROM documents),
        checks AS (
          SELECT 'long' AS "check", count(*) FILTER (NOT coalesce(n_chars > 500, false)) AS bad FROM documents
          UNION ALL SELECT 'known', count(*) FILTER (NOT coalesce(lang IN ('en', 'fr'), false)) FROM documents
          UNION ALL SELECT 'text empty', count(*) FILTER (text = '') FROM documents
          UNION ALL SELECT 'source not_in', count(*) FILTER (source NOT IN ('src0', 'src1')) FROM documents),
        columns AS (
          SELECT 'doc_id values' AS "check", count(*) FILTER (doc_id IS NULL) AS bad, CAST(min(doc_id) AS BIGINT) AS low_number,
                 CAST(max(doc_id) AS BIGINT) AS high_number, NULL AS low_text, NULL AS high_text, NULL AS different FROM documents
          UNION ALL SELECT 'lang values', count(*) FILTER (lang IS NULL), NULL, NULL, min(lang), max(lang), count(DISTINCT lang) FROM documents
          UNION ALL SELECT 'text values', count(*) FILTER (text IS NULL), NULL, NULL, min(text), max(text), NULL FROM documents),
        found AS (SELECT "check", bad, NULL AS low_number, NULL AS high_number, NULL AS low_text, NULL AS high_text, NULL AS different FROM checks
                  UNION ALL SELECT * FROM columns)
        SELECT "check", n AS rows, n - bad AS passed, bad, low_number, high_number, low_text, high_text, different FROM found, n""",
    "Q3_merged_keys": "SELECT text, count(*) AS count FROM documents GROUP BY text HAVING count(*) > 1",
    "Q4_merged_keys": """
        SELECT count(*) AS row_count, count(DISTINCT text) AS key_count, count(*) = count(DISTINCT text) AS is_unique FROM documents""",
    "Q5_sequence_gaps": """
        SELECT conv_id, turn, expected_order FROM (
          SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS expected_order
          FROM conversations) WHERE turn != expected_order""",
    "Q5_sequence_gaps_long_keys": """
        SELECT event_type, event_id, expected_order FROM (
          SELECT event_type, event_id,
                 row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS expected_order
          FROM events) WHERE event_id != expected_order""",
    "Q6_chain_breaks": "WITH" + EVENTS_SQL + """,
        chained AS (
          SELECT event_type, event_id, score AS state,
                 lag(score) OVER (PARTITION BY event_type ORDER BY event_id) AS lag_state FROM steps),
        spoiled AS (
          SELECT *, CASE WHEN event_id % 11 = 0 THEN lag_state + 1 ELSE lag_state END AS prev_state,
                 CASE WHEN event_id = 0 THEN state ELSE lag_state END AS expected_state FROM chained)
        SELECT event_type, event_id, state, prev_state, expected_state FROM spoiled
        WHERE prev_state != expected_state""",
    "Q7_inconsistent_keys": """
        SELECT user_id, min(event_type) AS min_event_type, max(event_type) AS max_event_type,
               min(props) AS min_props, max(props) AS max_props
        FROM events GROUP BY user_id
        HAVING count(DISTINCT event_type) > 1 OR count(DISTINCT props) > 1""",
    "Q8_bad_series": """
        SELECT conv_id FROM conversations GROUP BY conv_id
        HAVING conv_id % 4 = 1 OR (conv_id % 4 = 3 AND count(*) > 1)""",
    "Q9_check_schema": """
        SELECT 'user_id' AS "column", 'string' AS expected, 'bigint' AS actual, count(user_id) AS stored_values FROM events
        UNION ALL SELECT 'value', 'int', 'double', count(value) FROM events
        UNION ALL SELECT 'session_id', 'string', NULL, 0
        UNION ALL SELECT 'props', NULL, 'string', count(props) FROM events""",
    "Q10_mismatches": """
        SELECT doc_id, n_chars + 1 AS n_chars FROM documents
        WHERE doc_id % 10 = 0 AND n_chars + 1 != length(text)""",
    "Q11_expectation_results": "WITH" + RESULTS_SQL.format(update="'u1'") + "SELECT * FROM results",
    "Q11_expectation_results_newest": "WITH"
    + RESULTS_SQL.format(update="(SELECT update_id FROM newest)")
    + "SELECT * FROM results",
    "Q12_gate": "WITH" + RESULTS_SQL.format(update="'u1'") + """,
        wanted(dataset, name) AS (VALUES """
    + ", ".join(f"('{d}', '{n}')" for d, names in GATE.items() for n in names)
    + """)
        SELECT * FROM (
          SELECT w.dataset, w.name,
                 CASE WHEN r.failed_records IS NULL THEN 'missing'
                      WHEN r.failed_records > 0 THEN 'failed_records=' || CAST(r.failed_records AS VARCHAR)
                 END AS reason
          FROM wanted w LEFT JOIN results r ON w.dataset = r.dataset AND w.name = r.name)
        WHERE reason IS NOT NULL""",
    "Q13_is_stale": """
        SELECT max(ts) AS newest, max(ts) + INTERVAL 24 HOURS < TIMESTAMP '2024-01-31 12:00:00' AS is_stale
        FROM events""",
    "Q14_error_digest": """
        SELECT ts AS timestamp,
               '[' || CASE WHEN date_part('microsecond', ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
                           ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END
                   || '] event ' || CAST(event_id AS VARCHAR) AS line
        FROM events WHERE event_type = 'error' AND user_id % 3 = 1""",
}
