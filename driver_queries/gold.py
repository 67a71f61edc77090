"""G1–G13: scalar, window and aggregate operators of the Gold tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.common import EVENTS, EVENTS_SQL, TURNS, TURNS_SQL, read, steps, turns, turns_spec
from driver_queries.silver import FEED_SQL, feed_records
from seqlake.functions import scoring
from seqlake.operators import features
from seqlake.operators.feed import explode_record
from seqlake.operators.ordered import fit_buckets

KEYS = ["conv_id", "turn"]
FEATURES = ["score_from_turn", "score_delta", "is_best_move", "is_blunder", "move_quality"]

SCORED_SQL = """
signed AS (SELECT *, CASE WHEN {actor} = '{second}' THEN -score ELSE score END AS score_from_turn
           FROM {source}),
changed AS (SELECT *, score_from_turn - lag(score_from_turn)
                   OVER (PARTITION BY {key} ORDER BY {order}) AS score_delta FROM signed),
scored AS (SELECT *, abs(score_delta) >= 200 AS is_blunder, move = best AS is_best_move FROM changed)
"""
TURNS_SCORED = "WITH" + TURNS_SQL + "," + SCORED_SQL.format(
    actor="role", second="assistant", source="turns", key="conv_id", order="turn"
)
EVENTS_SCORED = "WITH" + EVENTS_SQL + "," + SCORED_SQL.format(
    actor="actor", second="odd", source="steps", key="event_type", order="event_id"
)
LABEL_SQL = """CASE WHEN {order} = 0 THEN 'start' WHEN is_best_move THEN 'best'
                    WHEN is_blunder THEN 'blunder' ELSE 'normal' END AS move_quality"""
TEXT_SQL = """'局面: ' || state || ' 指し手: ' || move || ' 推奨手: ' || best
              || ' 評価値: ' || CAST(score AS VARCHAR) || 'cp' AS search_text"""
SUMMARY_SQL = """
SELECT {key}, min_by(first_name, {order}) AS first_name, min_by(second_name, {order}) AS second_name,
       max({order}) AS total_moves, last(score ORDER BY {order}) AS final_score,
       CAST(sum(CASE WHEN {actor} = '{first}' AND is_blunder THEN 1 ELSE 0 END) AS BIGINT) AS {first}_blunders,
       CAST(sum(CASE WHEN {actor} = '{second}' AND is_blunder THEN 1 ELSE 0 END) AS BIGINT) AS {second}_blunders,
       CAST(to_json(list(struct_pack({order} := {order}, score := score) ORDER BY {order})) AS VARCHAR)
         AS score_series_json
FROM scored GROUP BY {key}
"""


def g1(spark, folder):
    return features.with_turn_score(turns(spark, folder), TURNS).select(*KEYS, "score_from_turn")


def g2(spark, folder):
    signed = features.with_turn_score(turns(spark, folder), TURNS)
    return features.with_delta(signed, turns_spec(spark, folder)).select(*KEYS, "score_delta")


def g3(spark, folder):
    return features.with_scores(turns(spark, folder), turns_spec(spark, folder)).select(*KEYS, "is_blunder")


def g4(spark, folder):
    return features.with_match(turns(spark, folder), TURNS).select(*KEYS, "is_best_move")


def g4_previous(spark, folder):
    matched = features.with_match(steps(spark, folder), EVENTS, compare_to="previous")
    return matched.select("event_type", "event_id", "is_best_move")


def g5(spark, folder):
    scored = features.with_scores(turns(spark, folder), turns_spec(spark, folder))
    labelled = features.with_label(features.with_match(scored, TURNS), TURNS)
    return labelled.select(*KEYS, "move_quality")


def g6(spark, folder):
    text = scoring.position_text(TURNS).alias("search_text")
    return turns(spark, folder).select(*KEYS, text)


def g7(spark, folder):
    return features.build_features(turns(spark, folder), turns_spec(spark, folder))


def g7_long(spark, folder):
    rows = steps(spark, folder)
    # Buckets of about 500 rows, whatever the gaps between the ids.
    featured = features.build_features(rows, fit_buckets(rows, EVENTS, rows=500))
    return featured.select("event_type", "event_id", "actor", "score", *FEATURES)


def g8(spark, folder):
    score = features.final_score(TURNS).alias("final_score")
    return turns(spark, folder).groupBy("conv_id").agg(score)


def g9(spark, folder):
    scored = features.with_scores(turns(spark, folder), turns_spec(spark, folder))
    return scored.groupBy("conv_id").agg(
        features.count_jumps("user", TURNS).alias("user_blunders"),
        features.count_jumps("assistant", TURNS).alias("assistant_blunders"),
    )


def g10(spark, folder):
    return features.series_json(turns(spark, folder), turns_spec(spark, folder))


def g10_parts(spark, folder):
    return features.series_parts(steps(spark, folder), EVENTS)


def g11(spark, folder):
    return features.build_summary(turns(spark, folder), turns_spec(spark, folder))


def g11_long(spark, folder):
    return features.build_summary(steps(spark, folder), EVENTS)


def g12(spark, folder):
    moves = explode_record(feed_records(spark, folder), "game_id", "body")
    return features.build_feed_features(moves)


def g13(spark, folder):
    docs = read(spark, folder, "documents")
    return features.build_knowledge_features(
        docs.select(F.col("doc_id").alias("strategy"), F.col("text").alias("content"), "source")
    )


QUERIES = {
    "G1_turn_score": g1,
    "G2_delta": g2,
    "G3_is_jump": g3,
    "G4_matches": g4,
    "G4_matches_previous": g4_previous,
    "G5_label": g5,
    "G6_search_text": g6,
    "G7_features": g7,
    "G7_features_long_keys": g7_long,
    "G8_final_score": g8,
    "G9_count_jumps": g9,
    "G10_series_json": g10,
    "G10_series_parts_long_keys": g10_parts,
    "G11_summary": g11,
    "G11_summary_long_keys": g11_long,
    "G12_feed_features": g12,
    "G13_knowledge_features": g13,
}

ORACLES = {
    "G1_turn_score": TURNS_SCORED + "SELECT conv_id, turn, score_from_turn FROM scored",
    "G2_delta": TURNS_SCORED + "SELECT conv_id, turn, score_delta FROM scored",
    "G3_is_jump": TURNS_SCORED + "SELECT conv_id, turn, is_blunder FROM scored",
    "G4_matches": TURNS_SCORED + "SELECT conv_id, turn, is_best_move FROM scored",
    "G4_matches_previous": "WITH" + EVENTS_SQL + """
        SELECT event_type, event_id,
               move = lag(best) OVER (PARTITION BY event_type ORDER BY event_id) AS is_best_move
        FROM steps""",
    "G5_label": TURNS_SCORED + f"SELECT conv_id, turn, {LABEL_SQL.format(order='turn')} FROM scored",
    "G6_search_text": "WITH" + TURNS_SQL + f"SELECT conv_id, turn, {TEXT_SQL} FROM turns",
    "G7_features": TURNS_SCORED + f"""
        SELECT conv_id, turn, role, score, move, best, state, prev_state, first_name, second_name,
               score_from_turn, score_delta, is_best_move, is_blunder,
               {LABEL_SQL.format(order='turn')}, {TEXT_SQL}
        FROM scored""",
    "G7_features_long_keys": EVENTS_SCORED + f"""
        SELECT event_type, event_id, actor, score, score_from_turn, score_delta, is_best_move,
               is_blunder, {LABEL_SQL.format(order='event_id')}
        FROM scored""",
    "G8_final_score": "WITH" + TURNS_SQL + """
        SELECT conv_id, last(score ORDER BY turn) AS final_score FROM turns GROUP BY conv_id""",
    "G9_count_jumps": TURNS_SCORED + """
        SELECT conv_id,
               count(*) FILTER (WHERE role = 'user' AND is_blunder) AS user_blunders,
               count(*) FILTER (WHERE role = 'assistant' AND is_blunder) AS assistant_blunders
        FROM scored GROUP BY conv_id""",
    "G10_series_json": "WITH" + TURNS_SQL + """
        SELECT conv_id, CAST(to_json(list(struct_pack(turn := turn, score := score) ORDER BY turn))
                             AS VARCHAR) AS score_series_json
        FROM turns GROUP BY conv_id""",
    "G10_series_parts_long_keys": "WITH" + EVENTS_SQL + """
        SELECT event_type, event_id // 500 AS part, CAST(count(*) AS INTEGER) AS entries,
               CAST(to_json(list(struct_pack(event_id := event_id, score := score) ORDER BY event_id))
                    AS VARCHAR) AS series_json
        FROM steps GROUP BY event_type, event_id // 500""",
    "G11_summary": TURNS_SCORED + SUMMARY_SQL.format(
        key="conv_id", order="turn", actor="role", first="user", second="assistant"),
    "G11_summary_long_keys": EVENTS_SCORED + SUMMARY_SQL.format(
        key="event_type", order="event_id", actor="actor", first="even", second="odd"),
    "G12_feed_features": "WITH" + FEED_SQL + """
        SELECT *, '局面: ' || sfen || ' 指し手: ' || move_usi AS search_text FROM feed""",
    "G13_knowledge_features": """
        SELECT doc_id AS strategy, text AS content, source, text AS search_text FROM documents""",
}
