"""The plans the README promises, read from the optimizer's own output."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driver_queries.common import EVENTS, TURNS, steps, turns
from driver_queries.silver import feed_records, kif_records
from seqlake.operators import features, quality
from seqlake.operators.feed import explode_record
from seqlake.operators.kif import parse_kif
from seqlake.operators.nearest import top_k
from seqlake.operators.silver import latest_per_key
from seqlake.sources.web import listing_links
from seqlake.spec import SequenceSpec

FOLDER = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def exchanges(df):
    return [line for line in physical(df).splitlines() if "Exchange hashpartitioning" in line]


def test_summary_has_one_wide_shuffle(spark):
    """Rows once by key and bucket; the other exchanges carry a row per bucket or key."""
    plan = physical(features.build_summary(steps(spark, "/root/testdata/sf0.01"), EVENTS)).splitlines()
    wide = [
        i for i, line in enumerate(plan)
        if "Exchange hashpartitioning" in line and "Aggregate" not in plan[i + 1]
    ]
    assert len(wide) == 1 and "_bucket" in plan[wide[0]]


@pytest.mark.parametrize("name, most", [
    ("Q5_sequence_gaps_long_keys", 3), ("G4_matches_previous", 3), ("G11_summary_long_keys", 4), ("Q6_chain_breaks", 6),
])
def test_looking_back_takes_three_exchanges(spark, name, most):
    """Carries by (key, range), carries by key, and the rows. The summary groups once more, Q6 looks back twice."""
    import __spark_entry__ as entry

    plan = physical(entry.queries()[name](spark, "/root/testdata/sf0.01"))
    assert plan.count("Exchange hashpartitioning") <= most and "Exchange SinglePartition" not in plan
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "_bucket" in line]
    assert wide


def test_keys_known_to_be_short_take_one_shuffle(spark):
    df = features.build_summary(turns(spark, FOLDER), TURNS.with_max_order(7))
    assert len(exchanges(df)) == 1


def test_features_and_audits_read_what_they_need(spark):
    plan = physical(features.with_turn_score(turns(spark, FOLDER), TURNS).select("conv_id", "role"))
    assert "ReadSchema: struct<conv_id:bigint,role:string>" in plan
    audit = quality.audit_columns(
        spark.read.parquet(f"{FOLDER}/customer.parquet"), [quality.is_null("c_name"), quality.is_empty("c_name")]
    )
    assert "ReadSchema: struct<c_name:string>" in physical(audit) and physical(audit).count("FileScan") == 1


def test_filters_reach_the_scan(spark):
    rows = latest_per_key(spark.read.parquet(f"{FOLDER}/events.parquet"), "user_id", "ts", ["event_id"])
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in physical(rows.filter("user_id = 3"))


@pytest.mark.parametrize("build, work", [
    (lambda s: explode_record(feed_records(s, FOLDER), "game_id", "body"), "StartsWith(lambda"),
    (lambda s: parse_kif(kif_records(s, FOLDER), "game_id", "body"), "StartsWith(lambda"),
    (lambda s: listing_links(s.read.parquet(f"{FOLDER}/pages.parquet"), "url", "html", 'href="([^"]+)"'),
     "regexp_extract_all("),
])
def test_exploded_arrays_are_worked_out_once(spark, build, work):
    assert not [line for line in optimized(build(spark)).splitlines() if "Filter" in line and work in line]


def test_search_does_not_shuffle_the_corpus(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(4).astype(np.float32).tolist()) for i in range(20)]
    corpus = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    plan = physical(top_k(corpus, corpus.withColumnRenamed("id", "query_id"), 2)).splitlines()
    at = next(i for i, line in enumerate(plan) if "MapInArrow" in line)
    assert not any("Exchange" in line for line in plan[at:])
    assert any("WindowGroupLimit" in line and "Partial" in line for line in plan[:at])


def test_a_sequence_is_audited_in_one_pass(spark):
    rows = spark.read.parquet(f"{FOLDER}/conversations.parquet").select(
        F.col("conv_id").cast("string").alias("game_id"), F.col("turn").cast("int").alias("move_number"),
        F.col("text").alias("sfen"), F.col("role").alias("prev_sfen"), F.lit("b").alias("black_player"),
    )
    plan = physical(quality.audit_sequence(
        rows, SequenceSpec(max_order=99), [quality.is_null("sfen")], ["black_player"], chain=True
    ))
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_an_audit_shuffles_what_its_rules_say_not_the_columns_they_read(spark):
    rows = spark.createDataFrame(
        [("g", 0, "b", "long text", "x"), ("g", 1, "b", None, "black"), ("g", 1, "c", "", "white")],
        "game_id string, move_number int, black_player string, move_usi string, player string",
    )
    rules = [quality.is_null("move_usi"), quality.is_empty("move_usi"), quality.not_in("player", ("black", "white"))]
    for spec in (SequenceSpec(max_order=99), SequenceSpec(max_order=99, bucket_rows=1)):
        found = quality.audit_sequence(rows, spec, rules, ["black_player"])
        assert {r["check"]: r["bad_rows"] for r in found.collect()} == {
            "move_usi null": 1, "move_usi empty": 1, "player not_in": 1, "duplicate keys": 1, "sequence gaps": 1, "inconsistent keys": 1,
        }
    plan = physical(quality.audit_sequence(rows, SequenceSpec(max_order=99), rules, ["black_player"]))
    after, before = plan.split("Exchange hashpartitioning")
    assert "move_usi#" in before and "move_usi#" not in after


def test_no_cross_joins(spark):
    import __spark_entry__ as entry

    for name in ("G11_summary_long_keys", "Q4_check_same_count", "Q11_expectation_results_newest", "T8_attach_analysis"):
        plan = physical(entry.queries()[name](spark, FOLDER))
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_a_hot_key_is_spread_over_tasks(spark):
    """A third of the rows share a key; no task gets more than its share of buckets."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") < 10_000, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 500).cast("string"))).alias("game_id"),
        F.col("id").cast("int").alias("move_number"), F.lit("black").alias("player"), F.lit(1).alias("score_cp"),
    )
    scored = features.with_scores(rows, SequenceSpec(bucket_rows=500), keep_bucket=True)
    sizes = [r["count"] for r in scored.groupBy("game_id", "_bucket").count().collect()]
    assert max(sizes) <= 1_100 and sum(sizes) == 30_000
