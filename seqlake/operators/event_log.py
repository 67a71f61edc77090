"""Reading a run's event log: expectation results, the quality gate, the error digest.

The log has ``timestamp, event_type, level, message, details`` (JSON text) and
``origin`` (a struct with ``update_id``).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.operators.silver import latest_per_key

# Shape of the expectation entries and the message of an empty digest.
EXPECTATIONS_TYPE = (
    "array<struct<name:string,dataset:string,passed_records:bigint,failed_records:bigint>>"
)
LOG_SCHEMA = (
    "timestamp timestamp, event_type string, level string, message string, details string, "
    "origin struct<update_id:string>"
)
NO_ERRORS = "(event_logにERRORレベルのイベントなし)"


def _newest_completed(log: DataFrame) -> DataFrame:
    done = (F.col("event_type") == "update_progress") & (
        F.get_json_object("details", "$.update_progress.state") == "COMPLETED"
    )
    newest = F.max(F.struct("timestamp", "origin.update_id"))["update_id"]
    return log.filter(done).agg(newest.alias("update_id"))


def expectation_results(log: DataFrame, update_id: str | None = None) -> DataFrame:
    """``dataset, name, passed_records, failed_records, timestamp``: the newest report of each rule.

    The reports are those of one update: the given one, else the newest that was completed.
    """
    quality = "$.flow_progress.data_quality"
    flows = log.filter(F.col("event_type") == "flow_progress").filter(
        F.get_json_object("details", quality).isNotNull()
    )
    if update_id is not None:
        flows = flows.filter(F.col("origin.update_id") == update_id)
    else:
        # One row by construction, so it may be broadcast at any size of the log.
        target = F.broadcast(_newest_completed(log))
        flows = flows.join(target, F.col("origin.update_id") == target["update_id"], "left_semi")
    entries = F.from_json(F.get_json_object("details", f"{quality}.expectations"), EXPECTATIONS_TYPE)
    # The outer form reads the JSON once; a plain inline would read it for a filter as well.
    entries = flows.select("timestamp", F.inline_outer(entries)).filter(F.col("name").isNotNull())
    reports = entries.select(
        F.substring_index("dataset", ".", -1).alias("dataset"),
        "name",
        "passed_records",
        "failed_records",
        "timestamp",
    )
    return latest_per_key(
        reports, ["dataset", "name"], "timestamp", ["passed_records", "failed_records"]
    )


def gate(
    results: DataFrame, expected: Mapping[str, Iterable[str]], require_passed: bool = False
) -> DataFrame:
    """The expected rules that are not met: ``dataset, name, reason``; empty when all are."""
    rules = [(dataset, name) for dataset, names in expected.items() for name in sorted(names)]
    wanted = results.sparkSession.createDataFrame(rules, "dataset string, name string")
    reason = F.when(F.col("failed_records").isNull(), "missing").when(
        F.col("failed_records") > 0, F.concat(F.lit("failed_records="), F.col("failed_records"))
    )
    if require_passed:
        reason = reason.when(F.col("passed_records") <= 0, "passed_records=0")
    return (
        wanted.join(results, ["dataset", "name"], "left")
        .select("dataset", "name", reason.alias("reason"))
        .filter(F.col("reason").isNotNull())
    )


def error_digest(log: DataFrame, update_id: str, empty: str = NO_ERRORS) -> DataFrame:
    """``timestamp, line``: the errors of an update in time order, one text line each.

    The lines stay rows, sorted across tasks, so a digest of any length is never one value.
    """
    errors = log.filter((F.col("origin.update_id") == update_id) & (F.col("level") == "ERROR"))
    seconds = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    micros = F.date_format("timestamp", ".SSSSSS")
    stamp = F.when(micros == ".000000", seconds).otherwise(F.concat(seconds, micros))
    lines = errors.select(
        "timestamp", F.concat(F.lit("["), stamp, F.lit("] "), F.col("message")).alias("line")
    )
    none = (
        errors.agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("timestamp"))
        .filter(F.col("n") == 0)
        .select("timestamp", F.lit(empty).alias("line"))
    )
    return lines.unionByName(none).orderBy("timestamp", "line")
