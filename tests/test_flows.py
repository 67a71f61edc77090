import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from seqlake.operators import event_log
from seqlake.plans import audits, collections, flows
from seqlake.session import scratch_path, shared_dir, spread
from seqlake.sources.tables import append_bronze, publish
from seqlake.spec import EXPECTATIONS, POSITIONS_SCHEMA, Layers, SequenceSpec

HEADER = ",".join(POSITIONS_SCHEMA.fieldNames())


@pytest.fixture
def layers(spark, tmp_path):
    name = uuid.uuid4().hex[:10]
    found = Layers("landing", f"bronze_{name}", f"silver_{name}", f"gold_{name}", location=str(tmp_path))
    flows.create_schema(spark, found, "bronze")
    return found


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "a.csv").write_text("\n".join([
        HEADER,
        "G1,0,s0,s0,,black,A,B,x,0,p",
        "G1,1,s1,s0,x,black,A,B,y,300,p",
        "G1,1,s1,s0,x,black,A,B,y,300,p",
        "G1,2,s2,s1,z,white,A,B,w,-100,p",
    ]) + "\n")
    (folder / "b.csv").write_text(f"{HEADER}\n,0,s0,s0,m,black,A,B,m,1,p\nG2,bad,s0,s0,m,nobody,A,B,m,1,p\n")
    return str(folder)


def counts(report):
    return {(dataset, rule): (passed, failed) for dataset, rule, passed, failed in report.counts}


def test_positions_flow(spark, layers, landing):
    report = flows.run(spark, "positions", layers, landing)
    assert report.tables == [
        layers.table("silver", "positions"),
        layers.table("gold", "position_features"),
        layers.table("gold", "game_summary"),
    ]
    found = counts(report)
    assert found["positions", "valid_game_id"] == (4, 1)
    assert found["positions", "valid_move_number"] == (4, 1)
    assert found["positions", "valid_player"] == (4, 1)
    assert found["position_features", "valid_move_quality"] == (5, 0)
    assert found["game_summary", "valid_players"] == (3, 0)
    summary = spark.read.table(layers.table("gold", "game_summary")).filter("game_id = 'G1'").first()
    assert (summary["total_moves"], summary["final_score_cp"]) == (2, -100)
    assert (summary["black_blunders"], summary["white_blunders"]) == (1, 1)
    assert report.expectations(spark).count() == 6


def test_audits_of_the_flow_tables(spark, layers, landing):
    flows.run(spark, "positions", layers, landing)
    tables = ["positions", "position_features", "game_summary"]
    rows = audits.audit_tables(spark, layers, tables, SequenceSpec(bucket_rows=2)).collect()
    found = {(r["dataset"], r["check"]): r["bad_rows"] for r in rows}
    assert {k: n for k, n in found.items() if n} == {
        ("positions", "game_id null"): 1, ("positions", "move_number null"): 1, ("positions", "player not_in"): 1,
        ("position_features", "game_id null"): 1, ("position_features", "move_number null"): 1,
        ("game_summary", "game_id null"): 1, ("game_summary", "total_moves null"): 1,
    }
    for check in ("sequence gaps", "chain breaks", "inconsistent keys", "duplicate keys", "columns", "empty table"):
        assert found["positions", check] == 0
    assert found["position_features", "rows of the source"] == 0 and found["game_summary", "series"] == 0


def test_audit_of_an_empty_table_with_a_column_too_many(spark):
    df = spark.createDataFrame([], "strategy string, content string, source string, extra int")
    found = {r["check"]: r["bad_rows"] for r in audits.audit(df, audits.AUDITS["joseki_knowledge"]).collect()}
    assert found["columns"] == 1 and found["empty table"] == 1 and found["strategy null"] == 0


def test_flow_runs_again_over_its_own_tables(spark, layers, landing):
    flows.run(spark, "positions", layers, landing)
    flows.run(spark, "positions", layers, landing)
    assert spark.read.table(layers.table("silver", "positions")).count() == 5


def test_all_flows_and_an_error_that_stays_in_its_flow(spark, layers, landing):
    articles = spark.createDataFrame([("a", "body", "src"), ("b", "", "src")], "strategy string, raw_content string, source string")
    append_bronze(articles, layers.table("bronze", "wikipedia_raw"), dt.datetime(2024, 1, 1), "raw_content",
                  layers.path("bronze", "wikipedia_raw"))
    reports = flows.run_all(spark, layers, {
        "feed": layers.table("bronze", "floodgate_raw"),
        "positions": landing,
        "knowledge": layers.table("bronze", "wikipedia_raw"),
    })
    assert [(r.flow, r.error is None) for r in reports] == [("feed", False), ("positions", True), ("knowledge", True)]
    log = spark.read.table(layers.table("gold", "event_log"))
    update = log.first()["origin"]["update_id"]
    results = event_log.expectation_results(log, update)
    missed = {(r["dataset"], r["name"]): r["reason"] for r in event_log.gate(results, EXPECTATIONS).collect()}
    assert missed["positions", "valid_game_id"] == "failed_records=1" and ("joseki_knowledge", "content_not_null") not in missed
    assert missed["floodgate_positions", "valid_player"] == "missing"
    assert "Flow feed" in event_log.error_digest(log, update).first()["line"]
    assert event_log.expectation_results(log).count() == 0
    features = spark.read.table(layers.table("gold", "joseki_features")).collect()
    assert [r.asDict() for r in features] == [{"strategy": "a", "content": "body", "source": "src", "search_text": "body"}]


def test_collections_of_the_gold_tables(spark, layers, landing):
    assert collections.build_collections(spark, layers) == []
    flows.run(spark, "positions", layers, landing)
    publish(spark.createDataFrame([], "strategy string, content string, source string, search_text string"),
            layers.table("gold", "joseki_features"), layers.path("gold", "joseki_features"))
    assert collections.build_collections(spark, layers) == ["positions"]
    entries = {r["id"]: r for r in spark.read.table(collections.collection_table(layers, "positions")[0]).collect()}
    # Row 0 has no move, so no text.
    assert {"G1__move0001", "G1__move0002"} <= set(entries) and "G1__move0000" not in entries
    assert entries["G1__move0001"]["metadata"]["move_quality"] == "blunder" and len(entries["G1__move0001"]["embedding"]) == 256
    articles = spark.createDataFrame([("a", "== h ==\nfirst\n\nsecond", "src")], "strategy string, search_text string, source string")
    chunks = {r["id"]: (r["document"], r["metadata"]["chunk_index"]) for r in collections.collection_of(articles, "joseki_knowledge").collect()}
    assert chunks == {"a__chunk0000": ("first", "0"), "a__chunk0001": ("second", "1")}


def test_feed_flow(spark, layers):
    games = spark.createDataFrame([("g", "N+A\nN-B\n+7776FU\n-3334FU\n", "src")], "game_id string, csa string, source string")
    for hour in (1, 2):
        append_bronze(games, layers.table("bronze", "floodgate_raw"), dt.datetime(2024, 1, 1, hour), "csa",
                      layers.path("bronze", "floodgate_raw"))
    report = flows.run(spark, "feed", layers, layers.table("bronze", "floodgate_raw"))
    assert counts(report) == {
        ("floodgate_positions", "valid_game_id"): (2, 0),
        ("floodgate_positions", "valid_move_number"): (2, 0),
        ("floodgate_positions", "valid_player"): (2, 0),
        ("floodgate_position_features", "search_text_not_null"): (2, 0),
    }


def test_empty_landing_gives_empty_tables(spark, layers, tmp_path):
    (tmp_path / "empty.csv").write_text(HEADER + "\n")
    report = flows.run(spark, "positions", layers, f"{tmp_path}/empty.csv")
    assert all(value == (0, 0) for value in counts(report).values())
    assert spark.read.table(layers.table("gold", "game_summary")).count() == 0


def test_names_of_layers():
    layers = Layers(catalog="c", location="/x")
    assert layers.table("gold", "t") == "c.gold.t"
    assert layers.path("gold", "t") == "/x/gold/t"
    assert Layers().path("gold", "t") is None
    assert set(EXPECTATIONS) >= {"positions", "game_summary"}


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_spread_deals_out_small_inputs_only(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == cores
    many = spark.range(0, 100, 1, cores * 3)
    assert spread(many) is many
    assert spread(many).filter(F.col("id") >= 0).count() == 100
