"""The three table flows, each from its source through Silver to Gold.

The seven tables are declared with their inputs (see ``graph``). Every table is replaced as a whole, and its row
expectations are counted in the pass that writes it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.operators.event_log import LOG_SCHEMA
from seqlake.operators.feed import build_feed_positions
from seqlake.operators.features import (
    build_features,
    build_feed_features,
    build_knowledge_features,
    summarise,
)
from seqlake.operators.silver import build_knowledge, dedupe
from seqlake.plans.graph import BLOCKED, FAILED, Made, Node, Outcome, Source, file_source, run_graph, table_source
from seqlake.sources.csv_files import read_sequences_csv
from seqlake.sources.tables import append_rows
from seqlake.spec import EXPECTATIONS, Layers, SequenceSpec


@dataclass
class FlowReport:
    """Tables a flow wrote, what became of each of its tables, its expectation counts, and the error that ended it."""

    flow: str
    tables: list[str] = field(default_factory=list)
    counts: list[tuple[str, str, int, int]] = field(default_factory=list)
    error: str | None = None
    states: dict[str, str] = field(default_factory=dict)

    def expectations(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.counts, "dataset string, name string, passed_records bigint, failed_records bigint"
        )


def _positions(made: Made) -> DataFrame:
    rows = made.tables["landing"]
    keys = ["game_id", "move_number"]
    return dedupe(rows, keys, [name for name in rows.columns if name not in keys])


def _bounds():
    return {"min_order": F.min("move_number"), "max_order": F.max("move_number")}


def _spec(made: Made) -> SequenceSpec:
    """The bounds were seen in the write: when all orders fit a bucket, one window per key will do.

    Keys, the null key too, hold an order once, as Silver was deduplicated.
    """
    seen = made.seen["positions"]
    known = seen["min_order"] is not None and seen["min_order"] >= 0
    return SequenceSpec().with_max_order(seen["max_order"] if known else None)


NODES = {node.name: node for node in (
    Node("positions", "silver", ("landing",), _positions, EXPECTATIONS["positions"], _bounds),
    Node(
        "position_features", "gold", ("positions",), lambda made: build_features(made.tables["positions"], _spec(made)),
        EXPECTATIONS["position_features"],
    ),
    # The features hold the changes already, so the summary needs no window of its own.
    Node(
        "game_summary", "gold", ("position_features", "positions"),
        lambda made: summarise(made.tables["position_features"], _spec(made)), EXPECTATIONS["game_summary"],
    ),
    Node(
        "floodgate_positions", "silver", ("floodgate_raw",), lambda made: build_feed_positions(made.tables["floodgate_raw"]),
        EXPECTATIONS["floodgate_positions"],
    ),
    Node(
        "floodgate_position_features", "gold", ("floodgate_positions",),
        lambda made: build_feed_features(made.tables["floodgate_positions"]), EXPECTATIONS["floodgate_position_features"],
    ),
    Node(
        "joseki_knowledge", "silver", ("wikipedia_raw",), lambda made: build_knowledge(made.tables["wikipedia_raw"]),
        EXPECTATIONS["joseki_knowledge"],
    ),
    Node(
        "joseki_features", "gold", ("joseki_knowledge",),
        lambda made: build_knowledge_features(made.tables["joseki_knowledge"]), EXPECTATIONS["joseki_features"],
    ),
)}
# The source of each flow and the tables it makes.
FLOWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "positions": ("landing", ("positions", "position_features", "game_summary")),
    "feed": ("floodgate_raw", ("floodgate_positions", "floodgate_position_features")),
    "knowledge": ("wikipedia_raw", ("joseki_knowledge", "joseki_features")),
}


def _source(flow: str, source: str) -> Source:
    if flow == "positions":
        return file_source(source, lambda spark: read_sequences_csv(spark, source))
    return table_source(source)


def _run(spark: SparkSession, layers: Layers, sources: Mapping[str, str], only_changed: bool) -> dict[str, Outcome]:
    for layer in ("silver", "gold"):
        create_schema(spark, layers, layer)
    nodes = [NODES[name] for flow in sources for name in FLOWS[flow][1]]
    read = {FLOWS[flow][0]: _source(flow, source) for flow, source in sources.items()}
    return run_graph(spark, nodes, read, layers, only_changed)


def _report(report: FlowReport, outcomes: Mapping[str, Outcome]) -> BaseException | None:
    """Put what became of the flow's tables into its report; the first error, if any."""
    first = None
    for name in FLOWS[report.flow][1]:
        made = outcomes[name]
        report.states[name] = made.state
        if made.state not in (FAILED, BLOCKED):
            report.tables.append(made.table)
            report.counts += [(name, *count) for count in made.counts]
        elif made.state == FAILED and first is None:
            first = made.error
            report.error = f"{type(first).__name__}: {first}"
    return first


def create_schema(spark: SparkSession, layers: Layers, layer: str) -> None:
    """The schema of a layer, in the folder of its tables when that is given."""
    where = f" LOCATION '{layers.location}/{getattr(layers, layer)}'" if layers.location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {layers.schema(layer)}{where}")


def run(
    spark: SparkSession, flow: str, layers: Layers, source: str, report: FlowReport | None = None, only_changed: bool = False
) -> FlowReport:
    """Run one flow; ``source`` is its landing path or its Bronze table. Errors are raised.

    ``report``, if given, holds what was done even if an error ends the flow. With ``only_changed`` tables whose
    inputs are what they were stay as they are.
    """
    report = FlowReport(flow) if report is None else report
    error = _report(report, _run(spark, layers, {flow: source}, only_changed))
    if error is not None:
        raise error
    return report


def log_events(spark: SparkSession, reports: Sequence[FlowReport], update_id: str) -> DataFrame:
    """The rows of an event log for one run: what each flow counted, its error, and how the run ended."""
    rows = []

    def add(kind: str, message: str, details: dict, level: str = "INFO") -> None:
        rows.append((datetime.now(timezone.utc), kind, level, message, json.dumps(details), (update_id,)))

    for report in reports:
        names = {table.rsplit(".", 1)[-1]: table for table in report.tables}
        state = "FAILED" if report.error else "COMPLETED"
        progress = {"status": state, "tables": report.states}
        if report.counts:
            progress["data_quality"] = {"expectations": [
                {"name": rule, "dataset": names[dataset], "passed_records": passed, "failed_records": failed}
                for dataset, rule, passed, failed in report.counts
            ]}
        add("flow_progress", f"Flow {report.flow}: {state}", {"flow_progress": progress})
        if report.error:
            add("flow_progress", f"Flow {report.flow}: {report.error}", {}, "ERROR")
    state = "FAILED" if any(report.error for report in reports) else "COMPLETED"
    add("update_progress", f"Update {update_id}: {state}", {"update_progress": {"state": state}})
    return spark.createDataFrame(rows, LOG_SCHEMA)


def run_all(
    spark: SparkSession, layers: Layers, sources: Mapping[str, str], update_id: str | None = None, only_changed: bool = False
) -> list[FlowReport]:
    """Run the flows side by side; an error ends the tables made from the failed one only.

    It is kept in the flow's report, beside the tables and counts of the others. What happened is appended
    to the Gold table ``event_log`` under ``update_id`` (a new one if none is given).
    """
    outcomes = _run(spark, layers, sources, only_changed)
    reports = [FlowReport(flow) for flow in sources]
    for report in reports:
        _report(report, outcomes)
    events = log_events(spark, reports, update_id or uuid.uuid4().hex)
    append_rows(events, layers.table("gold", "event_log"), layers.path("gold", "event_log"))
    return reports
