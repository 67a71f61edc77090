"""Tables declared with what they are made from, and a run that makes those that need it.

Every table keeps, with the version that was published, a fingerprint of all that went into it: its inputs'
fingerprints, its row expectations and the edition of its rule. A run goes through the tables in the order of their
inputs, those that do not depend on each other side by side. A table whose fingerprint is still the same is left as it
is, and what was counted when it was written is reported again. An error ends the tables made from the failed one, and
no others. As fingerprint and rows become current in one step, a run that dies is simply run again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.operators.quality import expect, observed_counts
from seqlake.sources.tables import current_version, notes_of, publish
from seqlake.spec import Layers

RAN, UNCHANGED, FAILED, BLOCKED = "ran", "unchanged", "failed", "blocked"


@dataclass(frozen=True)
class Made:
    """What a table is made from: the inputs by name, and what was seen when they were written."""

    tables: Mapping[str, DataFrame]
    seen: Mapping[str, Mapping]


@dataclass(frozen=True)
class Node:
    """A table, its inputs (tables or sources) and how it is made from them.

    ``edition`` is raised when what ``build`` does changes. ``rules`` are row expectations, and ``seen`` gives further
    aggregates that are taken in the pass that writes the table.
    """

    name: str
    layer: str
    inputs: tuple[str, ...]
    build: Callable[[Made], DataFrame]
    rules: Mapping[str, str] = field(default_factory=dict)
    seen: Callable[[], Mapping[str, Column]] = dict
    edition: int = 1


@dataclass(frozen=True)
class Source:
    """Data that no table of the graph holds: how it is read, and what tells that it has changed."""

    read: Callable[[SparkSession], DataFrame]
    fingerprint: Callable[[SparkSession], str]


@dataclass
class Outcome:
    name: str
    table: str
    state: str
    fingerprint: str = ""
    counts: list[tuple[str, int, int]] = field(default_factory=list)
    seen: Mapping = field(default_factory=dict)
    error: BaseException | None = None


def in_order(nodes: Sequence[Node]) -> list[Node]:
    """Each table after its inputs. An input that is no table is a source."""
    by_name = {node.name: node for node in nodes}
    if len(by_name) != len(nodes):
        raise ValueError("two tables of one name")
    done: dict[str, Node] = {}

    def visit(node: Node, above: tuple[str, ...]) -> None:
        if node.name in above:
            raise ValueError(f"tables made from each other: {' > '.join((*above, node.name))}")
        for name in node.inputs:
            if name in by_name:
                visit(by_name[name], (*above, node.name))
        done.setdefault(node.name, node)

    for node in nodes:
        visit(node, ())
    return list(done.values())


def _digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def files_fingerprint(spark: SparkSession, path: str | Sequence[str], glob: str = "*") -> str:
    """Name, size and time of all files, whatever their order. Their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    one = F.xxhash64("path", "length", "modificationTime")
    seen = files.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(one).alias("a"), F.sum(one.cast("decimal(38,0)")).alias("b")).first()
    return _digest(seen["n"], seen["a"], str(seen["b"]))


def table_fingerprint(spark: SparkSession, table: str) -> str:
    """Of a published table its version and notes, of another one its files."""
    number = current_version(spark, table)
    if number is not None:
        return _digest(table, number, notes_of(spark, table))
    place = spark.sql(f"DESCRIBE FORMATTED {table}").filter("col_name = 'Location'").first()["data_type"]
    return files_fingerprint(spark, place)


def file_source(path: str | Sequence[str], read: Callable[[SparkSession], DataFrame]) -> Source:
    return Source(read, lambda spark: files_fingerprint(spark, path))


def table_source(table: str) -> Source:
    return Source(lambda spark: spark.read.table(table), lambda spark: table_fingerprint(spark, table))


def run_graph(
    spark: SparkSession, nodes: Sequence[Node], sources: Mapping[str, Source], layers: Layers, only_changed: bool = True
) -> dict[str, Outcome]:
    """Make the tables and tell what became of each. With ``only_changed`` those up to date are left as they are."""
    ordered = in_order(nodes)
    known = {node.name for node in ordered}
    missing = {name for node in ordered for name in node.inputs} - known - set(sources)
    if missing:
        raise ValueError(f"nothing makes {sorted(missing)}")
    found: dict[str, Future] = {}

    def source(name: str) -> Outcome:
        try:
            return Outcome(name, "", UNCHANGED, sources[name].fingerprint(spark))
        except Exception as error:
            return Outcome(name, "", FAILED, error=error)

    def make(node: Node) -> Outcome:
        table = layers.table(node.layer, node.name)
        # Inputs were handed to the pool before, so they are never waited for in vain.
        inputs = {name: found[name].result() for name in node.inputs}
        broken = [made for made in inputs.values() if made.state in (FAILED, BLOCKED)]
        if broken:
            # A source that cannot be read is the failure of the table that wants it.
            first = broken[0]
            state = FAILED if first.name in sources else BLOCKED
            return Outcome(node.name, table, state, error=first.error)
        mark = _digest(node.name, node.edition, dict(node.rules), [inputs[name].fingerprint for name in node.inputs])
        try:
            notes = notes_of(spark, table)
            if only_changed and notes.get("fingerprint") == mark:
                counts = [tuple(count) for count in json.loads(notes["counts"])]
                return Outcome(node.name, table, UNCHANGED, mark, counts, json.loads(notes["seen"]))
            tables = {
                name: sources[name].read(spark) if name in sources else spark.read.table(inputs[name].table) for name in node.inputs
            }
            extra = node.seen()
            checked, observation = expect(node.build(Made(tables, {name: made.seen for name, made in inputs.items()})), node.rules, extra)

            def said() -> dict[str, str]:
                seen = {name: observation.get[name] for name in extra}
                return {
                    "fingerprint": mark, "counts": json.dumps(observed_counts(observation, node.rules)), "seen": json.dumps(seen),
                }

            publish(checked, table, layers.path(node.layer, node.name), notes=said)
            notes = notes_of(spark, table)
            counts = [tuple(count) for count in json.loads(notes["counts"])]
            return Outcome(node.name, table, RAN, mark, counts, json.loads(notes["seen"]))
        except Exception as error:
            return Outcome(node.name, table, FAILED, error=error)

    with ThreadPoolExecutor(max(1, len(sources) + len(ordered))) as pool:
        for name in sources:
            found[name] = pool.submit(source, name)
        for node in ordered:
            found[node.name] = pool.submit(make, node)
        return {node.name: found[node.name].result() for node in ordered}
