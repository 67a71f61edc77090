import pytest
from pyspark.sql import functions as F

from seqlake.functions.moves import with_japanese
from seqlake.operators.engine_log import parse_engine_log
from seqlake.operators.feed import build_feed_positions, explode_record
from seqlake.operators.kif import parse_kif
from seqlake.operators import replay, silver
from seqlake.operators.replay import RunningTotal, fold_per_key, fold_with_states, unordered_rows
from seqlake.operators.silver import attach_analysis, build_knowledge, dedupe, latest_per_key
from seqlake.spec import ARTICLE_RAW_SCHEMA, FEED_POSITIONS_SCHEMA, FEED_RAW_SCHEMA, INITIAL_SFEN, SequenceSpec

# Header lines and moves in the format of game records.
HEAD = "手合割：平手\n先手：一郎\n後手：二郎\n手数----指手---------消費時間--\n"
GAME = HEAD + (
    "*a comment\n"
    "   1 ７六歩(77)   ( 0:01/00:00:01)\n"
    "   2 ３四歩(33)   ( 0:01/00:00:01)\n"
    "&bookmark\n".replace("&", "*")
    + "   3 ２二角成(88)   ( 0:01/00:00:01)\n"
    "   4 同　銀(31)   ( 0:01/00:00:01)\n"
    "   5 ５五角打   ( 0:01/00:00:01)\n"
    "   6 投了   ( 0:01/00:00:01)\n"
    "   7 １八歩(17)\n"
)


def texts(spark, *bodies):
    return spark.createDataFrame([(f"g{i}", b) for i, b in enumerate(bodies)], "game_id string, body string")


def moves_of(df):
    found = {}
    for r in df.orderBy("game_id", "move_number").collect():
        found.setdefault(r["game_id"], []).append(r["move_usi"])
    return found


# Feed records

def feed(spark, *rows):
    return spark.createDataFrame(list(rows), "game_id string, csa string")


def test_feed_record_gives_moves_names_and_alternating_actors(spark):
    df = explode_record(feed(spark, ("g", "' comment\nN+first\nN-second\n+7776FU\n+3334FU\n")), "game_id", "csa")
    assert [tuple(r) for r in df.orderBy("move_number").collect()] == [
        ("g", 0, INITIAL_SFEN, "7776FU", "black", "first", "second"),
        ("g", 1, INITIAL_SFEN, "3334FU", "white", "first", "second"),
    ]


def test_feed_record_without_names_moves_or_rows(spark):
    rows = feed(spark, ("a", "+7776FU\n"), ("b", "N+first\n+\n-\r\n'+x\n"), ("c", ""), ("d", None))
    df = explode_record(rows, "game_id", "csa")
    assert [(r["game_id"], r["move_usi"], r["black_player"]) for r in df.collect()] == [("a", "7776FU", "")]
    assert explode_record(rows.limit(0), "game_id", "csa").schema.simpleString() == FEED_POSITIONS_SCHEMA.simpleString()


def test_feed_last_name_wins_and_carriage_returns_go(spark):
    df = explode_record(feed(spark, ("g", "N+one\r\nN+two\r\n+7776FU\r\n")), "game_id", "csa")
    assert [(r["black_player"], r["move_usi"]) for r in df.collect()] == [("two", "7776FU")]


def test_feed_takes_the_newest_version_of_a_game(spark):
    raw = spark.sql("""
        SELECT * FROM VALUES ('g', '+old', timestamp'2024-01-01 12:00:00', 's'),
                             ('g', '+new', timestamp'2024-01-01 13:00:00', 's') AS t(game_id, csa, fetched_at, source)
    """).to(FEED_RAW_SCHEMA)
    assert [r["move_usi"] for r in build_feed_positions(raw).collect()] == ["new"]


# Silver

def test_dedupe_and_latest_are_deterministic(spark):
    df = spark.createDataFrame([("a", 1, 9), ("a", 1, 3), ("a", 2, 5), ("b", 1, 1)], "k string, t int, v int")
    assert sorted(map(tuple, dedupe(df, ["k", "t"], ["v"]).collect())) == [("a", 1, 3), ("a", 2, 5), ("b", 1, 1)]
    assert sorted(map(tuple, latest_per_key(df, "k", "t", ["v"]).collect())) == [("a", 2, 5), ("b", 1, 1)]


def test_one_row_per_key_is_picked_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    plan = latest_per_key(df, "k", "id", ["id"])._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in before_shuffle


def test_knowledge_is_the_newest_article(spark):
    raw = spark.sql("""
        SELECT * FROM VALUES ('x', 'old', timestamp'2024-01-01 00:00:00', 's'),
                             ('x', 'new', timestamp'2024-01-02 00:00:00', 's') AS t(strategy, raw_content, fetched_at, source)
    """).to(ARTICLE_RAW_SCHEMA)
    assert [r.asDict() for r in build_knowledge(raw).collect()] == [{"strategy": "x", "content": "new", "source": "s"}]


def test_analysis_is_attached_by_key_and_order(spark):
    left = spark.createDataFrame([("g", 0), ("g", 1)], "game_id string, move_number int")
    right = spark.createDataFrame([("g", 1, 5)], "game_id string, move_number int, score_cp int")
    assert [tuple(r) for r in attach_analysis(left, right, ["game_id", "move_number"]).collect()] == [("g", 1, 5)]


# KIF

def test_kif_moves_same_square_drop_promotion_and_end(spark):
    df = parse_kif(texts(spark, GAME, GAME.replace("\n", "\r\n")), "game_id", "body")
    want = ["", "7g7f", "3c3d", "8h2b+", "3a2b", "B*5e"]
    assert moves_of(df) == {"g0": want, "g1": want}
    assert {(r["black_player"], r["white_player"]) for r in df.collect()} == {("一郎", "二郎")}


def test_kif_without_names_or_moves(spark):
    no_names = "手合割：平手\n手数----指手---------消費時間--\n1 ７六歩(77) ( 0:00/00:00:00)\n"
    df = parse_kif(texts(spark, no_names, HEAD), "game_id", "body")
    assert moves_of(df) == {"g0": ["", "7g7f"], "g1": [""]}
    first = df.filter("game_id = 'g0'").first()
    assert (first["black_player"], first["white_player"]) == (None, None)


def test_kif_long_piece_names_and_repeated_same_square(spark):
    body = HEAD + "1 ５五成銀(44)\n2 同　成香(56)\n3 同竜(54)\n4 同 と(45)\n5 ４四銀不成(55)\n"
    assert moves_of(parse_kif(texts(spark, body), "game_id", "body")) == {
        "g0": ["", "4d5e", "5f5e", "5d5e", "4e5e", "5e4d"]
    }


# Folds

@pytest.mark.parametrize("bucket", [1, 3, 50])
def test_running_total_stops_at_its_limit(spark, bucket):
    values = {"a": [3, 4, 5, 1], "b": [1] * 30, None: [20]}
    rows = [(k, n, v) for k, vs in values.items() for n, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k string, n int, v int")
    spec = SequenceSpec(key="k", order="n", bucket_rows=bucket)
    folded = fold_per_key(df, spec, "v", RunningTotal(11))
    found = {}
    for r in folded.orderBy("n").collect():
        found.setdefault(r["k"], []).append((int(r["_before"]), int(r["_after"])))
    assert found == {"a": [(0, 3), (3, 7)], "b": [(n, n + 1) for n in range(11)]}


@pytest.mark.parametrize("bucket_rows", [4, 1_000])
def test_fold_of_two_halves_equals_the_fold_of_the_whole(spark, bucket_rows, monkeypatch):
    """Keys that end in the first half, in the second, in neither; keys of one half only; the null key; no rows at all."""
    spec = SequenceSpec(key="k", order="n", bucket_rows=bucket_rows)
    rows = [(k, n, 1) for k, size in (("long", 40), (None, 25), ("short", 3), ("first", 9)) for n in range(size)]
    rows += [("ends", n, 99 if n == 5 else 1) for n in range(30)] + [("late", n, 99 if n == 22 else 1) for n in range(30)]
    rows += [("short", None, 1), (None, None, 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "k string, n int, v int")
    whole = {(r["k"], r["n"]): (r["_before"], r["_after"]) for r in fold_per_key(df, spec, "v", RunningTotal(60)).collect()}
    assert len(whole) == 40 + 25 + 3 + 9 + 5 + 22
    plays = []
    play = replay._play
    monkeypatch.setattr(replay, "_play", lambda fold: plays.append(1) or play(fold))
    one, states = fold_with_states(df.filter("n < 10"), spec, "v", RunningTotal(60))
    two, after = fold_with_states(df.filter("n >= 10"), spec, "v", RunningTotal(60), states)
    # Every row is played once.
    assert len(plays) == 2
    halves = [(r["k"], r["n"], r["_before"], r["_after"]) for df in (one, two) for r in df.collect()]
    assert len(halves) == len(whole) and {h[:2]: h[2:] for h in halves} == whole
    assert {r["k"]: r["state"] for r in after.collect()} == {
        "long": "40", None: "25", "short": "3", "first": "9", "ends": None, "late": None,
    }
    nothing, same = fold_with_states(df.limit(0), spec, "v", RunningTotal(60), after)
    assert nothing.isEmpty() and same.exceptAll(after).isEmpty() and same.count() == 6
    assert {r["k"]: r["rows"] for r in unordered_rows(df, spec).collect()} == {"short": 1, None: 2}


# Notation. Positions and moves in their public notations.

@pytest.mark.parametrize("move, state, text", [
    ("2g2f", INITIAL_SFEN, "2六歩"),
    ("8h2b+", "lnsgkgsnl/1r5b1/pppppp1pp/6p2/9/2P6/PP1PPPPPP/1B5R1/LNSGKGSNL b - 3", "2二角成"),
    ("P*5e", INITIAL_SFEN, "5五歩打"),
    ("1a1b", "8+r/9/9/9/9/9/9/9/9 b - 1", "1二龍"),
    ("9i9h", "9/9/9/9/9/9/9/9/+p8 b - 1", "9八と"),
    ("5i5h", INITIAL_SFEN, "5八玉"),
    ("xxxx", INITIAL_SFEN, None),
    ("5e5d", INITIAL_SFEN, None),
    ("0a1b", INITIAL_SFEN, None),
    ("", INITIAL_SFEN, None),
])
def test_move_in_japanese(spark, move, state, text):
    df = spark.createDataFrame([(move, state)], "move string, state string")
    shown = with_japanese(df, "move", "state").first()
    assert (shown["text"], shown["error"]) == (text, None if text else move)


# Engine logs

@pytest.mark.parametrize("lines, expected", [
    (["info depth 1 score cp 5 pv a", "info depth 2 score cp -120 pv 7g7f 3c3d", "bestmove 7g7f ponder 3c3d"],
     ("7g7f", -120, "7g7f 3c3d")),
    (["info depth 9 score mate 5 pv a", "bestmove a"], ("a", 30000, "a")),
    (["info depth 9 score mate -3 pv a", "bestmove a"], ("a", -30000, "a")),
    (["info depth 9 score mate 0 pv a", "bestmove a"], ("a", -30000, "a")),
    (["info depth 9 score mate +3 pv a", "bestmove a"], ("a", 0, "a")),
    (["info string nothing"], ("resign", 0, "")),
    (["info depth 3 multipv 1 score cp 7 pv  1 2 3  4 5 6 7 8 9 10"], ("resign", 7, "1 2 3 4 5 6 7 8")),
    (["info depth 3 score cp 7", "info depth 4 nodes 3", "bestmove x", "bestmove y"], ("x", 0, "")),
])
def test_engine_log(spark, lines, expected):
    df = spark.createDataFrame([("g", n, line) for n, line in enumerate(lines)], "k string, n int, line string")
    assert tuple(parse_engine_log(df, "k", "n", "line").first())[1:] == expected


@pytest.mark.parametrize("most", [0, 100_000])
def test_only_rows_that_share_their_key_are_shuffled(spark, monkeypatch, tmp_path, most):
    monkeypatch.setattr(silver, "REPEATED_KEYS", most)
    rows = [(f"k{n}" if n else None, n % 4, f"v{n}", "s") for n in range(50)]
    rows += [("k7", 3, "newer", "s"), ("k7", 3, "newest", "s"), ("k8", 0, "z", "s"), (None, 9, "none", "s"), ("k9", 1, "v9", "s")]
    spark.createDataFrame(rows, "strategy string, fetched_at int, raw_content string, source string").write.parquet(f"{tmp_path}/raw")
    raw = spark.read.parquet(f"{tmp_path}/raw")
    found = silver.latest_of_wide_rows(raw, "strategy", "fetched_at", ["raw_content"])
    want = latest_per_key(raw, "strategy", "fetched_at", ["raw_content"])
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.count() == 50
    plan = build_knowledge(raw)._jdf.queryExecution().optimizedPlan().toString()
    if most:
        # The window has the rows of a semi join beneath it, the others pass beside it.
        above, beneath = plan.split("Window", 1)
        assert "LeftAnti" in above and "LeftSemi" in beneath
