import json
import random
from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqlake.operators import features
from seqlake.operators.ordered import (
    bucket_of, cut_ranges, fit_buckets, measured, with_bounds, with_bucket, with_last_known, with_row_number,
)
from seqlake.spec import POSITIONS_SCHEMA, SequenceSpec

SPEC = SequenceSpec()
SPLIT = SequenceSpec(bucket_rows=3)
WHOLE = SequenceSpec(max_order=1_000)
NAMES = POSITIONS_SCHEMA.fieldNames()


def row(**values):
    base = dict(
        game_id="G1", move_number=0, sfen="s0", prev_sfen=None, move_usi="7g7f", player="black",
        black_player="Alice", white_player="Bob", best_move="7g7f", score_cp=50, pv="",
    )
    return tuple({**base, **values}[name] for name in NAMES)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), POSITIONS_SCHEMA)


def by_key(df, *columns):
    return {(r["game_id"], r["move_number"]): tuple(r[c] for c in columns) for r in df.collect()}


def model(rows):
    """Turn score, change, jump flag and label, row by row."""
    out, previous = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        values = dict(zip(NAMES, r))
        score = values["score_cp"]
        turn = None if score is None else (-score if values["player"] == "white" else score)
        before = previous.get(values["game_id"])
        delta = None if turn is None or before is None else turn - before
        jump = None if delta is None else abs(delta) >= 200
        move, best = values["move_usi"], values["best_move"]
        match = None if move is None or best is None else move == best
        label = (
            "start" if values["move_number"] == 0
            else "best" if match else "blunder" if jump else "normal"
        )
        previous[values["game_id"]] = turn
        out[values["game_id"], values["move_number"]] = (turn, delta, match, jump, label)
    return out


FEATURES = ("score_from_turn", "score_delta", "is_best_move", "is_blunder", "move_quality")


@pytest.mark.parametrize("player, expected", [("black", 100), ("white", -100)])
def test_turn_score_is_negated_for_the_second_actor(spark, player, expected):
    df = features.with_turn_score(frame(spark, row(player=player, score_cp=100)))
    assert df.first()["score_from_turn"] == expected


def test_first_row_has_no_change_and_no_flag(spark):
    assert by_key(features.build_features(frame(spark, row())), "score_delta", "is_blunder") == {
        ("G1", 0): (None, None)
    }


def test_change_does_not_cross_keys(spark):
    df = frame(
        spark,
        row(), row(move_number=1, player="white", score_cp=30),
        row(game_id="G2", score_cp=500), row(game_id="G2", move_number=1, player="white", score_cp=0),
    )
    assert by_key(features.build_features(df), "score_delta") == {
        ("G1", 0): (None,), ("G1", 1): (-80,), ("G2", 0): (None,), ("G2", 1): (-500,),
    }


@pytest.mark.parametrize("change, flag", [(200, True), (-200, True), (199, False), (-199, False)])
def test_jump_threshold_is_inclusive_and_takes_gains_too(spark, change, flag):
    df = frame(spark, row(score_cp=0), row(move_number=1, score_cp=change))
    assert by_key(features.build_features(df), "is_blunder")["G1", 1] == (flag,)


def test_label_priority(spark):
    df = frame(
        spark,
        row(move_usi="a", best_move="a"),
        row(move_number=1, move_usi="a", best_move="a", score_cp=900),
        row(move_number=2, move_usi="a", best_move="b", score_cp=0),
        row(move_number=3, move_usi="a", best_move="b", score_cp=0),
        row(move_number=4, move_usi=None, best_move="b", score_cp=None),
    )
    labels = by_key(features.build_features(df), "move_quality")
    assert [labels["G1", n][0] for n in range(5)] == ["start", "best", "blunder", "normal", "normal"]


def test_match_can_look_at_the_previous_best_move(spark):
    df = frame(spark, row(best_move="x"), row(move_number=1, move_usi="x", best_move="y"))
    for spec in (WHOLE, replace(SPLIT, bucket_rows=1)):
        matched = features.with_match(df, spec, compare_to="previous")
        assert by_key(matched, "is_best_move") == {("G1", 0): (None,), ("G1", 1): (True,)}
    with pytest.raises(ValueError):
        features.with_match(df, SPEC, compare_to="next")


def test_search_text_holds_all_parts_and_is_null_without_one(spark):
    df = features.build_features(frame(spark, row(), row(move_number=1, score_cp=None)))
    assert by_key(df, "search_text") == {
        ("G1", 0): ("局面: s0 指し手: 7g7f 推奨手: 7g7f 評価値: 50cp",),
        ("G1", 1): (None,),
    }


def test_feature_columns_and_types(spark):
    df = features.build_features(frame(spark, row()))
    assert [(f.name, f.dataType.simpleString()) for f in df.schema][11:] == [
        ("score_from_turn", "int"), ("score_delta", "int"), ("is_best_move", "boolean"),
        ("is_blunder", "boolean"), ("move_quality", "string"), ("search_text", "string"),
    ]
    assert df.columns[:11] == NAMES


def test_summary_columns_and_types(spark):
    df = features.build_summary(frame(spark, row()))
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [
        ("game_id", "string"), ("black_player", "string"), ("white_player", "string"),
        ("total_moves", "int"), ("final_score_cp", "int"), ("black_blunders", "bigint"),
        ("white_blunders", "bigint"), ("score_series_json", "string"),
    ]


@pytest.mark.parametrize("spec", [SPEC, WHOLE, replace(SPEC, bucket_rows=1)])
def test_summary_of_rows_out_of_order(spark, spec):
    df = frame(
        spark,
        row(move_number=2, player="black", score_cp=100),
        row(move_number=0, player="black", score_cp=0),
        row(move_number=1, player="white", score_cp=300),
        row(move_number=3, player="white", score_cp=None),
    )
    summary = features.build_summary(df, spec).collect()
    assert len(summary) == 1
    found = summary[0].asDict()
    series = json.loads(found.pop("score_series_json"))
    assert found == {
        "game_id": "G1", "black_player": "Alice", "white_player": "Bob", "total_moves": 3,
        "final_score_cp": 100, "black_blunders": 1, "white_blunders": 1,
    }
    assert series == [
        {"move_number": 0, "score_cp": 0}, {"move_number": 1, "score_cp": 300},
        {"move_number": 2, "score_cp": 100}, {"move_number": 3},
    ]
    kept = features.build_summary(df, spec, keep_nulls=True).first()["score_series_json"]
    assert json.loads(kept)[3] == {"move_number": 3, "score_cp": None}


def test_a_series_of_many_parts_is_whole(spark):
    rows = [row(move_number=n, score_cp=n) for n in range(10)]
    rows += [row(game_id="G2", move_number=n, score_cp=n) for n in range(4)]
    df = frame(spark, *rows)
    series = {r["game_id"]: r["score_series_json"] for r in features.series_json(df, SPLIT).collect()}
    summary = {r["game_id"]: r for r in features.build_summary(df, SPLIT).collect()}
    for game, length in (("G1", 10), ("G2", 4)):
        want = [{"move_number": n, "score_cp": n} for n in range(length)]
        assert json.loads(series[game]) == want == json.loads(summary[game]["score_series_json"])
    parts = features.series_parts(df, SPLIT).filter("game_id = 'G1'").orderBy("part").collect()
    assert [e for p in parts for e in json.loads(p["series_json"])] == json.loads(series["G1"])


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for game in range(rng.randint(1, 6)):
        orders = rng.sample(range(40), rng.randint(1, 30))
        for n in orders:
            rows.append(row(
                game_id=f"G{game}", move_number=n, player=rng.choice(["black", "white"]),
                score_cp=rng.choice([None, rng.randint(-500, 500)]),
                move_usi=rng.choice(["a", "b", None]), best_move=rng.choice(["a", "b", None]),
            ))
    rng.shuffle(rows)
    return rows


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6), bucket=st.sampled_from([1, 2, 5, 17]))
def test_features_equal_the_model_however_keys_are_cut(spark, seed, bucket):
    rows = random_rows(seed)
    df = frame(spark, *rows)
    want = model(rows)
    for spec in (WHOLE, SequenceSpec(bucket_rows=bucket)):
        assert by_key(features.build_features(df, spec), *FEATURES) == want


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6), bucket=st.sampled_from([1, 3, 8]))
def test_summary_is_the_same_however_keys_are_cut(spark, seed, bucket):
    df = frame(spark, *random_rows(seed))
    whole = sorted(map(tuple, features.build_summary(df, WHOLE).collect()))
    cut = sorted(map(tuple, features.build_summary(df, SequenceSpec(bucket_rows=bucket)).collect()))
    assert whole == cut


@pytest.mark.parametrize("bucket", [1, 2, 5])
def test_last_known_and_row_number_are_the_same_however_keys_are_cut(spark, bucket):
    df = frame(spark, *random_rows(bucket))
    cut = SequenceSpec(bucket_rows=bucket)
    for build in (
        lambda spec: with_last_known(df, spec, "out", "score_cp"),
        lambda spec: with_row_number(df, spec, "out"),
    ):
        assert by_key(build(cut), "out") == by_key(build(WHOLE), "out")


def test_buckets_fit_orders_with_gaps(spark):
    rows = [row(game_id="long", move_number=n * 1_000, score_cp=n) for n in range(100)]
    rows += [row(game_id="short", move_number=n, score_cp=n) for n in range(3)]
    df = frame(spark, *rows)
    spec = fit_buckets(df, SPEC, rows=10)
    assert 9_000 <= spec.bucket_rows <= 11_000 and not spec.one_bucket
    sizes = [r["count"] for r in df.groupBy("game_id", bucket_of(spec)).count().collect()]
    assert max(sizes) <= 11
    assert by_key(features.build_features(df, spec), *FEATURES) == model(rows)
    assert fit_buckets(df, SPEC, rows=1_000).one_bucket
    assert fit_buckets(df.limit(0), SPEC) == SPEC
    negative = fit_buckets(df.withColumn("move_number", F.col("move_number") - 5), SPEC, rows=1_000)
    assert not negative.one_bucket


ORDERS = {
    "microseconds": [1_700_000_000_000_000 + n * 7_919_333 for n in range(60)],
    "a dense cluster": [*range(500_000, 500_040), *range(0, 10_000_000_000, 500_000_007)],
    "negative": [n * 3 - 90 for n in range(60)],
}


@pytest.mark.parametrize("orders", ORDERS.values(), ids=ORDERS.keys())
def test_no_bucket_holds_more_than_its_share_whatever_the_orders(spark, orders):
    """Rows for a task, and the same features."""
    rng = random.Random(len(orders))
    rows = [("G1", n, rng.choice(["black", "white"]), rng.choice([None, rng.randint(-500, 500)])) for n in orders]
    df = spark.createDataFrame(rows, "game_id string, move_number bigint, player string, score_cp int")

    def built(spec):
        known = with_last_known(features.with_scores(df, spec), spec, "known", "score_cp")
        return by_key(with_row_number(known, spec, "place"), "score_delta", "known", "place")

    want = built(SequenceSpec(max_order=10**18, bucket_rows=2 * 10**18))
    for spec in (fit_buckets(df, SPEC, rows=10), cut_ranges(df, SequenceSpec(bucket_rows=10))):
        sizes = [r["count"] for r in with_bucket(df, spec).groupBy("game_id", "_bucket").count().collect()]
        assert max(sizes) <= 20 and sum(sizes) == len(orders)
    narrow = SequenceSpec(bucket_rows=10)
    assert by_key(features.with_scores(df, narrow), "score_delta") == {k: v[:1] for k, v in want.items()}
    assert by_key(with_last_known(df, narrow, "out", "score_cp"), "out") == {k: v[1:2] for k, v in want.items()}
    assert by_key(with_row_number(df, narrow, "out"), "out") == {k: v[2:] for k, v in want.items()}


def test_bounds_are_read_from_the_orders(spark):
    df = spark.createDataFrame([("a", 3), ("b", 0), ("b", None)], "game_id string, move_number int")
    assert with_bounds(df, SPEC).max_order == 3
    assert with_bounds(df.withColumn("move_number", F.col("move_number") - 1), SPEC).max_order is None
    assert with_bounds(df.limit(0), SPEC) == SPEC


def test_null_order_comes_first_and_null_keys_are_one_key(spark):
    rows = [
        row(move_number=None, score_cp=7), row(score_cp=10), row(move_number=5, score_cp=11),
        row(game_id=None, score_cp=1), row(game_id=None, move_number=9, score_cp=4),
    ]
    df = frame(spark, *rows)
    want = by_key(features.build_features(df, WHOLE), *FEATURES)
    assert want["G1", 0][1] == 3 and want[None, 9][1] == 3
    assert by_key(features.build_features(df, SPLIT), *FEATURES) == want
    only_null = frame(spark, row(move_number=None, score_cp=7))
    for spec in (WHOLE, SPLIT):
        assert features.build_summary(only_null, spec).first()["final_score_cp"] == 7
        assert by_key(with_last_known(df, spec, "out", "score_cp"), "out")["G1", None] == (7,)


def test_a_long_key_is_no_single_window_partition(spark):
    """One key holds all rows; the shuffle hashes by key and bucket, so its rows are spread."""
    df = spark.range(1000).select(
        F.lit("hot").alias("game_id"), F.col("id").cast("int").alias("move_number"),
        F.lit("black").alias("player"), F.col("id").cast("int").alias("score_cp"),
    )
    spec = SequenceSpec(bucket_rows=10)
    scored = features.with_scores(df, spec, keep_bucket=True)
    assert max(r["count"] for r in scored.groupBy("_bucket").count().collect()) <= 10
    assert scored.filter("score_delta = 1").count() == 999
    plan = scored._jdf.queryExecution().toString()
    assert "hashpartitioning(game_id" in plan and "_bucket" in plan


def test_cuts_of_a_hot_key_among_short_ones(spark):
    """A third of the rows share a key, whose orders come in bursts; drawn cuts make ranges of about the same size."""
    df = spark.range(90_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None).otherwise(F.concat(F.lit("g"), (F.col("id") % 997).cast("string"))).alias("game_id"),
        (F.col("id") * F.when(F.col("id") % 5 == 0, 1).otherwise(1_000_000_007) - 10_000).alias("move_number"),
    )
    spec = cut_ranges(df, SequenceSpec(bucket_rows=1_000))
    assert not spec.one_bucket and spec.cuts.count() == 2
    sizes = with_bucket(df, spec).groupBy("game_id", "_bucket").count().collect()
    assert sum(r["count"] for r in sizes) == 90_000 and max(r["count"] for r in sizes) <= 2_200
    assert {r["_bucket"] for r in sizes if r["game_id"] and r["game_id"] != "hot"} == {0}
    assert len([r for r in sizes if r["game_id"] == "hot"]) >= 20
    few = cut_ranges(df, SequenceSpec(bucket_rows=1_000), most_ranges=6)
    assert with_bucket(df, few).select("game_id", "_bucket").filter("_bucket > 0").distinct().count() <= 8
    assert measured(df, SequenceSpec()).short_keys
    numbered = with_row_number(df, SequenceSpec(bucket_rows=1_000), "place")
    whole = with_row_number(df, SequenceSpec(short_keys=True), "place")
    assert numbered.exceptAll(whole).isEmpty()


def test_gold_of_feed_and_knowledge(spark):
    feed = spark.createDataFrame([("s", "m"), (None, "m")], "sfen string, move_usi string")
    assert [r["search_text"] for r in features.build_feed_features(feed).collect()] == ["局面: s 指し手: m", None]
    articles = spark.createDataFrame([("a", "text", "src")], "strategy string, content string, source string")
    assert features.build_knowledge_features(articles).first().asDict() == {
        "strategy": "a", "content": "text", "source": "src", "search_text": "text",
    }
