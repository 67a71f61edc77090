import uuid
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from seqlake.plans import graph
from seqlake.plans.flows import create_schema
from seqlake.plans.graph import Node, Source, in_order, run_graph
from seqlake.sources import tables
from seqlake.spec import Layers


@pytest.fixture
def layers(spark, tmp_path):
    name = uuid.uuid4().hex[:10]
    found = Layers("landing", f"b_{name}", f"s_{name}", f"g_{name}", location=str(tmp_path))
    for layer in ("silver", "gold"):
        create_schema(spark, found, layer)
    return found


def doubled(name):
    return lambda made: made.tables[name].withColumn("id", F.col("id") * 2)


NODES = (
    Node("last", "gold", ("left", "right"), lambda made: made.tables["left"].unionByName(made.tables["right"]).withColumn(
        "top", F.lit(made.seen["left"]["top"]))),
    Node("left", "silver", ("a",), doubled("a"), {"even": "id % 2 = 0", "small": "id < 4"}, lambda: {"top": F.max("id")}),
    Node("right", "silver", ("b",), doubled("b")),
)


def sources(rows=5, mark="1", b="1"):
    return {
        "a": Source(lambda spark: spark.range(rows), lambda spark: mark),
        "b": Source(lambda spark: spark.range(2), lambda spark: b),
    }


def states(outcomes):
    return {name: made.state for name, made in outcomes.items()}


def test_tables_come_after_their_inputs():
    assert [node.name for node in in_order(NODES)] == ["left", "right", "last"]
    with pytest.raises(ValueError, match="made from each other"):
        in_order([Node("x", "gold", ("y",), None), Node("y", "gold", ("x",), None)])
    with pytest.raises(ValueError, match="two tables"):
        in_order([NODES[0], NODES[0]])


def test_only_what_changed_is_made_again(spark, layers):
    first = run_graph(spark, NODES, sources(), layers)
    assert set(states(first).values()) == {graph.RAN}
    assert first["left"].counts == [("even", 5, 0), ("small", 2, 3)] and first["left"].seen == {"top": 8}
    again = run_graph(spark, NODES, sources(), layers)
    assert set(states(again).values()) == {graph.UNCHANGED}
    # What was counted and seen is told again.
    assert again["left"].counts == first["left"].counts and again["left"].seen == {"top": 8}
    b = run_graph(spark, NODES, sources(b="2"), layers)
    assert states(b) == {"left": graph.UNCHANGED, "right": graph.RAN, "last": graph.RAN}
    a = run_graph(spark, NODES, sources(rows=9, mark="2", b="2"), layers)
    assert states(a) == {"left": graph.RAN, "right": graph.UNCHANGED, "last": graph.RAN}
    assert spark.read.table(layers.table("gold", "last")).agg(F.max("top")).first()[0] == 16
    rule = (NODES[0], replace(NODES[1], rules={"even": "id % 2 = 0"}), replace(NODES[2], edition=2))
    assert set(states(run_graph(spark, rule, sources(rows=9, mark="2", b="2"), layers)).values()) == {graph.RAN}
    forced = run_graph(spark, rule, sources(rows=9, mark="2", b="2"), layers, only_changed=False)
    assert set(states(forced).values()) == {graph.RAN}


def test_an_error_ends_what_is_made_from_it_and_is_made_up_for(spark, layers):
    broken = (NODES[0], NODES[1], replace(NODES[2], build=lambda made: made.tables["b"].select(F.raise_error(F.lit("dies")).alias("id"))))
    seen = run_graph(spark, broken, sources(), layers)
    assert states(seen) == {"left": graph.RAN, "right": graph.FAILED, "last": graph.BLOCKED}
    assert "dies" in str(seen["right"].error) and not spark.catalog.tableExists(layers.table("gold", "last"))
    assert states(run_graph(spark, NODES, sources(), layers)) == {"left": graph.UNCHANGED, "right": graph.RAN, "last": graph.RAN}


def test_a_source_that_is_gone(spark, layers):
    gone = sources() | {"a": graph.table_source(layers.table("silver", "nothing"))}
    assert states(run_graph(spark, NODES, gone, layers)) == {"left": graph.FAILED, "right": graph.RAN, "last": graph.BLOCKED}
    with pytest.raises(ValueError, match="nothing makes"):
        run_graph(spark, NODES, {"a": gone["a"]}, layers)


def test_a_run_killed_before_the_switch_is_run_again(spark, layers, monkeypatch):
    run_graph(spark, NODES, sources(), layers)

    def die(*args):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(tables, "_switch", die)
        assert states(run_graph(spark, NODES, sources(rows=3, mark="2"), layers))["left"] == graph.FAILED
    assert spark.read.table(layers.table("silver", "left")).count() == 5
    assert states(run_graph(spark, NODES, sources(rows=3, mark="2"), layers))["left"] == graph.RAN
    assert spark.read.table(layers.table("silver", "left")).count() == 3


def test_fingerprints_follow_files_and_versions(spark, layers, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.csv").write_text("x")
    first = graph.files_fingerprint(spark, str(folder))
    assert first == graph.files_fingerprint(spark, str(folder))
    (folder / "b.csv").write_text("x")
    assert graph.files_fingerprint(spark, str(folder)) != first
    name = layers.table("silver", "t")
    tables.publish(spark.range(2), name, f"{tmp_path}/t")
    one = graph.table_fingerprint(spark, name)
    assert one == graph.table_fingerprint(spark, name)
    tables.publish(spark.range(2), name, f"{tmp_path}/t")
    assert graph.table_fingerprint(spark, name) != one
    spark.range(3).write.option("path", f"{tmp_path}/plain").saveAsTable(layers.table("silver", "plain"))
    plain = graph.table_fingerprint(spark, layers.table("silver", "plain"))
    spark.range(1).write.mode("append").option("path", f"{tmp_path}/plain").saveAsTable(layers.table("silver", "plain"))
    assert graph.table_fingerprint(spark, layers.table("silver", "plain")) != plain


def test_notes_of_a_version_keep_any_text(spark, layers, tmp_path):
    name = layers.table("silver", "t")
    said = {"text": "it's \"so\" \\ {x: 1}"}
    tables.publish(spark.range(1), name, f"{tmp_path}/t", notes=lambda: said)
    assert tables.notes_of(spark, name) == said
    tables.publish(spark.range(1), name, f"{tmp_path}/t")
    assert tables.notes_of(spark, name) == {}
