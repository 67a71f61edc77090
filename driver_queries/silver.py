"""T1–T9: Silver transforms and records."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from driver_queries.common import TURNS, TURNS_SQL, read, read_spread, turns
from seqlake.functions.moves import with_japanese
from seqlake.operators.engine_log import parse_engine_log
from seqlake.operators.feed import explode_record
from seqlake.operators.replay import RunningTotal, fold_per_key, fold_with_states
from seqlake.operators.silver import attach_analysis, build_knowledge, dedupe, latest_per_key
from seqlake.spec import INITIAL_SFEN

LIMIT = 1_500


def feed_records(spark, folder):
    """A feed record per document: its names are source and language, its lines the moves."""
    lines = F.regexp_replace("text", "\n", "\r\n+")
    body = F.concat(
        F.lit("' record\nN+"), "source", F.lit("\r\nN-"), "lang", F.lit("\n-"), lines, F.lit("\nN+last\n%TORYO\n+")
    )
    return read_spread(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("game_id"), body.alias("body"), "source"
    )


FEED_SQL = f"""
lines AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
moves AS (
  SELECT CAST(doc_id AS VARCHAR) AS game_id,
         CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS move_number,
         '{INITIAL_SFEN}' AS sfen, line AS move_usi,
         'last' AS black_player, lang AS white_player
  FROM lines WHERE line != ''),
feed AS (SELECT *, CASE WHEN move_number % 2 = 0 THEN 'black' ELSE 'white' END AS player FROM moves)
"""


def kif_records(spark, folder):
    """A game record per turn: each word is a move of a rook, out by the length of the word or home.

    Black moves the rook of 2h along rank 8, white the rook of 8b along rank 2; every second move
    of a side goes home again.
    """
    words = F.split("text", " ")
    wide, home = "１２３４５６７８９", {0: ("２", "28"), 1: ("８", "82")}

    def line(word, i):
        side, back = i % 2, (F.floor(i / 2) % 2) == 1
        spoken = F.when(back, F.element_at(F.col("_words"), F.greatest(i - 1, F.lit(1)))).otherwise(word)
        step = F.length(spoken) % 5
        file = F.when(side == 0, step + 3).otherwise(7 - step)
        rank = F.when(side == 0, "八").otherwise("二")
        away = F.concat(F.substr(F.lit(wide), file, F.lit(1)), rank)
        at = F.concat(file.cast("string"), F.when(side == 0, "8").otherwise("2"))
        to_home = F.concat(F.when(side == 0, home[0][0]).otherwise(home[1][0]), rank)
        at_home = F.when(side == 0, home[0][1]).otherwise(home[1][1])
        move = F.concat(
            F.when(back, to_home).otherwise(away), F.lit("飛("), F.when(back, at).otherwise(at_home), F.lit(")")
        )
        return F.concat(F.lit("   "), (i + 1).cast("string"), F.lit(" "), move, F.lit("   ( 0:01/00:00:01)"))

    conv = F.col("conv_id").cast("string")
    # The header lines of a game record, its ruler, and its end.
    body = F.concat(
        F.lit("手合割：平手\n先手："), conv, F.lit("\n後手："), "role",
        F.lit("\n手数----指手---------消費時間--\n* comment\n"),
        F.array_join(F.transform("_words", line), "\r\n"),
        F.lit("\n  999 投了\nまで\n   1 ７六歩(77)\n"),
    )
    return read_spread(spark, folder, "conversations").withColumn("_words", words).select(
        F.concat_ws("-", conv, F.col("turn").cast("string")).alias("game_id"), body.alias("body")
    )


KIF_SQL = """
words AS (
  SELECT concat(conv_id, '-', turn) AS game_id, CAST(conv_id AS VARCHAR) AS black_player, role AS white_player,
         unnest(string_split(text, ' ')) AS word,
         generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM conversations),
spoken AS (
  SELECT *, (i // 2) % 2 = 1 AS back, length(word) % 5 AS step,
         lag(length(word) % 5, 2) OVER w AS step2, lag(length(word) % 5, 1) OVER w AS step1
  FROM words WINDOW w AS (PARTITION BY game_id ORDER BY i)),
filed AS (
  SELECT *, CASE WHEN back THEN step2 ELSE step END AS s,
         CASE WHEN i % 2 = 0 THEN '2h' ELSE '8b' END AS home FROM spoken),
squares AS (
  SELECT *, CASE WHEN i % 2 = 0 THEN CAST(3 + s AS VARCHAR) || 'h' ELSE CAST(7 - s AS VARCHAR) || 'b' END AS away
  FROM filed),
plies AS (
  SELECT *, CAST(i + 1 AS INTEGER) AS move_number, CASE WHEN back THEN away || home ELSE home || away END AS move_usi
  FROM squares)
"""
# Moves with the state before them, what is said of them and which fail: plain, capture by a promoted
# piece, promotion, drop, king, an empty origin, text that is no move.
STATED_MOVES = (
    ("2g2f", INITIAL_SFEN, "2六歩"),
    ("8h2b+", "lnsgkgsnl/1r5b1/pppppp1pp/6p2/9/2P6/PP1PPPPPP/1B5R1/LNSGKGSNL b - 3", "2二角成"),
    ("P*5e", INITIAL_SFEN, "5五歩打"),
    ("1a1b", "8+r/9/9/9/9/9/9/9/9 b - 1", "1二龍"),
    ("5i5h", INITIAL_SFEN, "5八玉"),
    ("5e5d", INITIAL_SFEN, None),
    ("xxxx", INITIAL_SFEN, None),
)


def t1(spark, folder):
    return dedupe(read(spark, folder, "documents"), ["text"], ["doc_id"])


def t2(spark, folder):
    return latest_per_key(read(spark, folder, "events"), "user_id", "ts", ["event_id"])


def t3(spark, folder):
    """Some texts come in several copies; one row of each is the article."""
    raw = read(spark, folder, "documents").select(
        F.col("text").alias("strategy"),
        F.col("text").alias("raw_content"),
        F.col("n_chars").alias("fetched_at"),
        "source",
    )
    return build_knowledge(raw)


def t4(spark, folder):
    return explode_record(feed_records(spark, folder), "game_id", "body")


def t6_running(spark, folder):
    # Three turns per bucket, so that most conversations are folded over several buckets.
    spec = replace(TURNS, bucket_rows=3)
    rows = turns(spark, folder).select("conv_id", "turn", "score")
    folded = fold_per_key(rows, spec, "score", RunningTotal(LIMIT))
    return folded.select(
        "conv_id", "turn", F.col("_before").cast("bigint").alias("before"), F.col("_after").cast("bigint").alias("after")
    )


def t6_resumed(spark, folder):
    """The same fold in three runs over turns that come later and later, each from the states the one before has left."""
    spec = replace(TURNS, bucket_rows=3)
    rows = turns(spark, folder).select("conv_id", "turn", "score")
    out, states = None, None
    for low, high in ((0, 2), (2, 4), (4, 10**9)):
        folded, states = fold_with_states(rows.filter(F.col("turn").between(low, high - 1)), spec, "score", RunningTotal(LIMIT), states)
        out = folded if out is None else out.unionByName(folded)
    return out.select(
        "conv_id", "turn", F.col("_before").cast("bigint").alias("before"), F.col("_after").cast("bigint").alias("after")
    )


def t7(spark, folder):
    """A log line per event; the log is that of the user."""
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    moves = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda n: F.concat(F.lit("m"), number, F.lit("x"), n.cast("string"))), " ")
    line = (
        F.when(kind == "view", F.concat(
            F.lit("info depth 5 multipv 1 score cp "), (F.col("event_id") - 3000).cast("string"), F.lit(" nodes 9 pv "), moves))
        .when(kind == "click", F.concat(
            F.lit("info depth 3 score mate "), (F.col("event_id") % 5 - 2).cast("string"), F.lit(" pv a  b")))
        .when(kind == "signup", "info depth 9 currmove x")
        .when(kind == "purchase", F.concat(F.lit("bestmove "), number, F.lit(" ponder y")))
        .otherwise("info string score cp 5")
    )
    lines = read(spark, folder, "events").select("user_id", "event_id", line.alias("line"))
    return parse_engine_log(lines, "user_id", "event_id", "line")


def t8(spark, folder):
    analysis = (
        read(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count(F.lit(1)).alias("lines"), F.max("l_linenumber").alias("last_line"))
    )
    return attach_analysis(read(spark, folder, "orders"), analysis, ["o_orderkey"])


def t9(spark, folder):
    """Each turn stands for one of the stated moves, by its number."""
    cases = F.array(*[F.struct(F.lit(m).alias("move"), F.lit(state).alias("state")) for m, state, _ in STATED_MOVES])
    case = F.element_at(cases, ((F.col("conv_id") + F.col("turn")) % len(STATED_MOVES) + 1).cast("int"))
    moves = read(spark, folder, "conversations").select("conv_id", "turn", case.alias("case")).select("conv_id", "turn", "case.*")
    return with_japanese(moves, "move", "state").select("conv_id", "turn", "text", "error")


QUERIES = {
    "T1_dedupe": t1,
    "T2_latest_per_key": t2,
    "T3_rename": t3,
    "T4_explode_record": t4,
    "T6_running_fold": t6_running,
    "T6_resumed_fold": t6_resumed,
    "T7_engine_log": t7,
    "T8_attach_analysis": t8,
    "T9_usi_to_japanese": t9,
}

RUNNING_SQL = "WITH" + TURNS_SQL + f""",
        sums AS (SELECT conv_id, turn, score, CAST(sum(score) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS after
                 FROM turns)
        SELECT conv_id, turn, after - score AS before, after FROM sums WHERE after <= {LIMIT}"""
ORACLES = {
    "T1_dedupe": """
        SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
    "T2_latest_per_key": """
        SELECT * FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "T3_rename": """
        SELECT text AS strategy, text AS content, source FROM documents
        QUALIFY row_number() OVER (PARTITION BY text
                                   ORDER BY n_chars DESC, text DESC, source DESC) = 1""",
    "T4_explode_record": "WITH" + FEED_SQL + "SELECT * FROM feed",
    "T6_running_fold": RUNNING_SQL,
    "T6_resumed_fold": RUNNING_SQL,
    "T7_engine_log": """
        WITH infos AS (
          SELECT user_id, max_by(event_type, event_id) AS kind, max(event_id) AS n FROM events
          WHERE event_type IN ('view', 'click', 'signup') GROUP BY user_id),
        bests AS (SELECT user_id, min(event_id) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id)
        SELECT u.user_id, coalesce(CAST(b.n AS VARCHAR), 'resign') AS best_move,
               CAST(CASE WHEN i.kind = 'view' THEN i.n - 3000
                         WHEN i.kind = 'click' THEN CASE WHEN i.n % 5 - 2 > 0 THEN 30000 ELSE -30000 END
                         ELSE 0 END AS INTEGER) AS score_cp,
               CASE WHEN i.kind = 'view' THEN array_to_string(
                           list_transform(range(1, 9), lambda x: 'm' || CAST(i.n AS VARCHAR) || 'x' || CAST(x AS VARCHAR)), ' ')
                    WHEN i.kind = 'click' THEN 'a b' ELSE '' END AS pv
        FROM (SELECT DISTINCT user_id FROM events) u
        LEFT JOIN infos i ON u.user_id = i.user_id LEFT JOIN bests b ON u.user_id = b.user_id""",
    "T8_attach_analysis": """
        SELECT o.*, a.lines, a.last_line FROM orders o JOIN (
          SELECT l_orderkey, count(*) AS lines, max(l_linenumber) AS last_line FROM lineitem GROUP BY l_orderkey) a
        ON o.o_orderkey = a.l_orderkey""",
    "T9_usi_to_japanese": f"""
        SELECT conv_id, turn,
               CASE (conv_id + turn) % {len(STATED_MOVES)} {' '.join(
                   f"WHEN {n} THEN {'NULL' if text is None else repr(text)}" for n, (_, _, text) in enumerate(STATED_MOVES))} END AS text,
               CASE (conv_id + turn) % {len(STATED_MOVES)} {' '.join(
                   f"WHEN {n} THEN {repr(move)}" for n, (move, _, text) in enumerate(STATED_MOVES) if text is None)} END AS error
        FROM conversations""",
}
