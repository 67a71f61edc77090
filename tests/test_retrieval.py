import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from seqlake.functions.text import metadata_text
from seqlake.operators import blocks, retrieval, vector_index
from seqlake.operators.embedding import count_terms, embed, embed_with, term_weights
from seqlake.operators.nearest import top_k
from seqlake.operators.retrieval import ROUTES, Merged
from seqlake.operators.routing import route_by_rules
from seqlake.operators.vector_index import build_index, open_index, publish_index, search_index, top_k_approx, top_k_pruned

VECTOR = "embedding array<float>"


def vectors(n, dim=8, seed=1, copies=0):
    rng = np.random.default_rng(seed)
    found = rng.standard_normal((n, dim)).astype(np.float32)
    found[:copies] = found[0]
    return found


def corpus_frame(spark, data, groups=None):
    rows = [(i, v.tolist(), f"g{groups[i]}" if groups is not None else "g") for i, v in enumerate(data)]
    return spark.createDataFrame(rows, f"id bigint, {VECTOR}, collection string").repartition(3)


def query_frame(spark, data, groups=None):
    return corpus_frame(spark, data, groups).withColumnRenamed("id", "query_id")


def brute(data, queries, k, allowed=None):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    distance = np.round(1 - unit(queries.astype(np.float64)) @ unit(data.astype(np.float64)).T, 6) + 0.0
    out = []
    for q, row in enumerate(distance):
        ids = [i for i in range(len(data)) if allowed is None or allowed(q, i)]
        for rank, i in enumerate(sorted(ids, key=lambda i: (row[i], i))[:k], 1):
            out.append((q, rank, i, row[i]))
    return out


def hits(df):
    return sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in df.collect())


WAYS = [{}, {"query_bytes": 0, "tile_rows": 7}, {"query_bytes": 0, "tile_rows": 1_000}]


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("k", [1, 5, 100])
def test_top_k_equals_brute_force(spark, way, k):
    data, queries = vectors(60), vectors(11, seed=2)
    found = top_k(corpus_frame(spark, data), query_frame(spark, queries), k, **way)
    assert hits(found) == brute(data, queries, k)


@pytest.mark.parametrize("way", WAYS)
def test_copies_are_ordered_by_id(spark, way):
    """A third of the corpus are copies of one vector."""
    data = vectors(60, copies=20)
    found = top_k(corpus_frame(spark, data), query_frame(spark, data[:3]), 4, **way)
    assert hits(found) == brute(data, data[:3], 4)
    assert [h[2] for h in hits(found) if h[0] == 0] == [0, 1, 2, 3]


@pytest.mark.parametrize("way", WAYS)
def test_queries_meet_their_own_group_only(spark, way):
    data, queries = vectors(60), vectors(9, seed=2)
    groups, asked = np.arange(60) % 4, np.arange(9) % 5
    found = top_k(corpus_frame(spark, data, groups), query_frame(spark, queries, asked), 3, on="collection", **way)
    assert hits(found) == brute(data, queries, 3, lambda q, i: groups[i] == asked[q])
    assert {r["collection"] for r in found.collect()} == {"g0", "g1", "g2", "g3"}


def test_no_queries_null_vectors_and_text_ids(spark):
    data = vectors(5)
    corpus = corpus_frame(spark, data).withColumn("id", F.concat(F.lit("v"), F.col("id").cast("string")))
    assert top_k(corpus, query_frame(spark, data).limit(0)).count() == 0
    assert top_k(corpus.limit(0), query_frame(spark, data)).count() == 0
    gone = corpus.withColumn("embedding", F.when(F.col("id") != "v1", F.col("embedding")))
    assert [r["id"] for r in top_k(gone, query_frame(spark, data).filter("query_id = 1"), 4).orderBy("rank").collect()
            if r["id"] == "v1"] == []
    asked = top_k(corpus, query_frame(spark, data), 1)
    assert sorted((r["query_id"], r["id"]) for r in asked.collect()) == [(n, f"v{n}") for n in range(5)]


def clustered(n, centres=12, dim=8, seed=6):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, dim))
    return (middle[np.arange(n) % centres] + 0.05 * rng.standard_normal((n, dim))).astype(np.float32)


def brute_with_zeros(data, queries, k):
    """As ``brute``; whatever has length zero is at distance 1 from everything."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    distance = np.round(1 - unit(queries.astype(np.float64)) @ unit(data.astype(np.float64)).T, 6) + 0.0
    return [(q, rank, i, row[i]) for q, row in enumerate(distance)
            for rank, i in enumerate(sorted(range(len(data)), key=lambda i: (row[i], i))[:k], 1)]


@pytest.mark.parametrize("tile_rows", [9, 40])
def test_pruned_search_is_exact_and_skips_clusters(spark, tile_rows):
    data, queries = clustered(300), clustered(25, seed=6)
    data[:90] = data[0]
    data[200:203], queries[7] = 0, 0
    found, met = top_k_pruned(corpus_frame(spark, data), query_frame(spark, queries), 4, tile_rows=tile_rows)
    assert hits(found) == brute_with_zeros(data, queries, 4)
    seen = {r["query_id"]: r for r in met.collect()}
    assert set(seen) == set(range(25)) and {r["rows_total"] for r in seen.values()} == {300}
    assert seen[7]["rows_met"] == 300
    assert np.mean([r["rows_met"] for q, r in seen.items() if q != 7]) < 150


def test_pruned_search_asks_for_more_than_there_is(spark):
    data = clustered(20)
    found, met = top_k_pruned(corpus_frame(spark, data), query_frame(spark, data[:3]), 50, tile_rows=5)
    assert hits(found) == brute(data, data[:3], 50) and {r["rows_met"] for r in met.collect()} == {20}
    empty, none = top_k_pruned(corpus_frame(spark, data).limit(0), query_frame(spark, data[:3]), 5)
    assert empty.count() == 0 and {r["rows_met"] for r in none.collect()} == {0}


def test_pruned_search_moves_the_corpus_once(spark, monkeypatch):
    """No generator copies rows of the corpus: parts and queries are brought together by one shuffle each."""
    moved = []
    meet = vector_index._meet
    monkeypatch.setattr(vector_index, "_meet", lambda *args: moved.append(meet(*args)) or moved[-1])
    top_k_pruned(corpus_frame(spark, clustered(60)), query_frame(spark, clustered(9)), 3, tile_rows=10)
    for df in moved:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(list") == 1 and "Generate" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("way", [{}, {"query_bytes": 16 * 8 * 15}])
def test_index_finds_most_from_few_rows(spark, way):
    data, queries = vectors(800, dim=16, seed=4, copies=200), vectors(60, dim=16, seed=5)
    index = build_index(corpus_frame(spark, data), tile_rows=50)
    sizes = index.rows.groupBy("list", "part").count().agg(F.max("count")).first()[0]
    assert sizes <= 90  # 200 copies in one list, cut
    found, met = search_index(index, query_frame(spark, queries), 5, **way)
    exact = {h[::2] for h in brute(data, queries, 5)}
    assert len({h[::2] for h in hits(found)} & exact) / len(exact) >= 0.9
    rows = met.collect()
    assert len(rows) == 60 and np.mean([r["rows_met"] for r in rows]) < 0.4 * 800
    distance = {h[::2]: h[3] for h in brute(data, queries, 800)}
    assert all(distance[q, i] == d for q, _, i, d in hits(found))


def test_index_is_exact_when_all_lists_are_met(spark, tmp_path):
    data, queries = vectors(120), vectors(9, seed=2)
    data[5], queries[3] = 0, 0
    groups, asked = np.arange(120) % 4, np.arange(9) % 5
    index = build_index(corpus_frame(spark, data, groups), on="collection")
    schema = f"i_{tmp_path.name}".replace("-", "_")
    spark.sql(f"CREATE SCHEMA {schema} LOCATION '{tmp_path}/{schema}'")
    publish_index(index, f"{schema}.vectors", f"{tmp_path}/v")
    found, met = search_index(open_index(spark, f"{schema}.vectors"), query_frame(spark, queries, asked), 3, on="collection", step=1.0)
    allowed = {q: [i for i in range(120) if groups[i] == asked[q]] for q in range(9)}
    want = []
    for q, ids in allowed.items():
        want += [(q, rank, ids[i], d) for _, rank, i, d in brute_with_zeros(data[ids], queries[q:q + 1], 3)] if ids else []
    assert hits(found) == want
    assert {(r["complete"], r["rows_met"], r["rows_total"]) for r in met.collect()} == {(True, 120, 120)}


def test_index_of_nothing_of_zeros_and_with_text_ids(spark):
    data = vectors(30)
    corpus = corpus_frame(spark, data).withColumn("id", F.concat(F.lit("v"), F.col("id").cast("string")))
    assert search_index(build_index(corpus.limit(0)), query_frame(spark, data))[0].count() == 0
    assert search_index(build_index(corpus), query_frame(spark, data).limit(0))[0].count() == 0
    zeros = build_index(corpus_frame(spark, np.zeros((4, 3))))
    assert [(r["id"], r["distance"]) for r in search_index(zeros, query_frame(spark, vectors(1, dim=3)), 2)[0].orderBy("rank").collect()] == [(0, 1.0), (1, 1.0)]
    one = top_k_approx(corpus, query_frame(spark, data), 1)
    assert sorted((r["query_id"], r["id"]) for r in one.collect()) == [(n, f"v{n}") for n in range(30)]


def test_clean_text(spark):
    values = ["  foo  ", "", "nan", "   ", None, "bar", "NaN", " None\n", "　x\t", "none of it"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    assert [r["t"] for r in retrieval.clean_text(df, "t").collect()] == ["foo", "bar", "x", "none of it"]


def test_embedding_is_unit_length_and_follows_the_words(spark):
    df = spark.createDataFrame(
        [("the rook moves far",), ("The  rook moves, far!",), ("entirely other words",), ("局面の評価",), (None,), ("",)],
        "t string",
    )
    rows = [np.array(r["embedding"]) for r in embed(df, "t").collect()]
    assert {len(v) for v in rows} == {256}
    assert [round(float(np.linalg.norm(v)), 5) for v in rows] == [1, 1, 1, 1, 0, 0]
    assert np.allclose(rows[0], rows[1]) and rows[0] @ rows[2] < 0.5


def test_rare_terms_weigh_more(spark):
    texts = [("common rare",), ("common",), ("common",), ("rare",), ("common other",)]
    df = spark.createDataFrame(texts, "t string")
    asked = spark.createDataFrame([("common rare",)], "t string")

    def closeness(weights):
        pair, common, rare = (
            np.array(embed(d, "t", weights=weights).first()["embedding"])
            for d in (asked, df.filter("t = 'common'"), df.filter("t = 'rare'"))
        )
        return pair @ rare - pair @ common

    assert closeness(term_weights(df, "t")) > closeness(None) + 0.1


def test_model_gets_batches_and_is_loaded_once_per_task(spark):
    df = spark.createDataFrame([(n, None if n == 3 else f"text {n}") for n in range(70)], "n int, t string").coalesce(1)
    calls = spark.sparkContext.accumulator(0)
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)

        def encode(texts):
            assert len(texts) <= 32
            calls.add(1)
            return np.array([[len(t), 1.0] for t in texts])

        return encode

    rows = {r["n"]: r["embedding"] for r in embed_with(df, "t", load).collect()}
    assert rows[3] is None and rows[0] == [6.0, 1.0] and rows[10] == [7.0, 1.0] and len(rows) == 70
    assert (loads.value, calls.value) == (1, 3)


def test_model_is_loaded_once_in_a_worker_and_gets_texts_of_a_length(spark):
    texts = [(n, "x" * (n * 37 % 101)) for n in range(900)]
    df = spark.createDataFrame(texts, "n int, t string").repartition(16)
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return lambda found: np.array([[len(t)] for t in found])

    for _ in range(2):
        rows = embed_with(df, "t", load).collect()
        assert {r["n"]: r["embedding"] for r in rows} == {n: [float(len(t))] for n, t in texts}
    # Two runs of 16 tasks, on 4 cores.
    assert 1 <= loads.value <= 4

    def ordered():
        last = [0]

        def encode(found):
            assert last[0] <= min(map(len, found))
            last[0] = max(map(len, found))
            return np.array([[1.0]] * len(found))

        return encode

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert embed_with(df.coalesce(1), "t", ordered).count() == 900
        assert embed_with(df.coalesce(1), "t", lambda: lambda found: np.array([[1.0]] * len(found)), buffer_bytes=1).select("n").distinct().count() == 900
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


TERM_TEXTS = ["The rook, the ROOK moves", "one", "", None, "局面の評価 abc 1二", "a a a a b"]


def plain_terms(text):
    import regex

    words = regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[\p{L}\p{N}]+", (text or "").lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_terms_are_counted_in_the_row(spark):
    df = spark.createDataFrame(list(enumerate(TERM_TEXTS)), "k int, t string")
    counted = count_terms(df, "k", "t")
    got = {(r["k"], r["term"]): r["n"] for r in counted.collect()}
    want = {(k, term): n for k, text in enumerate(TERM_TEXTS) for term, n in Counter(plain_terms(text)).items()}
    assert got == want
    plan = counted._jdf.queryExecution()
    assert "Exchange" not in plan.executedPlan().toString()
    # The text is cut once, here and ahead of the hashed vectors.
    assert plan.optimizedPlan().toString().count("regexp_extract_all") == 1
    assert embed(df, "t")._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_hashed_vectors_equal_counts_worked_out_by_hand(spark):
    df = spark.createDataFrame([(t,) for t in TERM_TEXTS], "t string")
    place = HashingTF(numFeatures=256).indexOf
    every = [Counter(map(place, plain_terms(text))) for text in TERM_TEXTS]
    seen = Counter(bucket for counts in every for bucket in counts)
    weights = {bucket: np.log((len(TERM_TEXTS) + 1) / (n + 1)) for bucket, n in seen.items()}
    for given, weight in ((None, lambda b: 1.0), (term_weights(df, "t"), weights.get)):
        for row, counts in zip(embed(df, "t", weights=given).collect(), every):
            want = np.zeros(256)
            for bucket, n in counts.items():
                want[bucket] = n * weight(bucket)
            want /= np.linalg.norm(want) or 1
            np.testing.assert_allclose(row["embedding"], want, atol=1e-6)


def test_merge_embeds_what_is_new_or_changed(spark, tmp_path, table):
    path = f"{tmp_path}/c"

    def embedder(mark):
        """Vectors that tell in which run they were made."""
        return lambda df, text: embed_with(df, text, lambda: lambda texts: np.array([[len(t), mark] for t in texts]))

    def entries(rows):
        df = spark.createDataFrame(rows, "n int, t string, m string")
        return retrieval.entries(df, "c", F.col("n").cast("string"), "t", ["m"])

    def held():
        return {r["id"]: (r["document"], r["metadata"]["m"], r["embedding"]) for r in spark.read.table(table).collect()}

    first = [(n, f"text {n}", "a") for n in range(200)]
    assert retrieval.merge_collection(entries(first), table, path, embedder(1), "one") == Merged(200, 0, 0)
    # One text changed, one gone, one new, one with other metadata only; a text that moved to another id is new there.
    now = [(n, "changed" if n == 7 else text, "b" if n == 8 else m) for n, text, m in first if n != 9] + [(500, "new", "a"), (501, "text 3", "a")]
    assert retrieval.merge_collection(entries(now), table, path, embedder(2), "one") == Merged(3, 198, 1)
    assert held() == {str(n): (t, m, [float(len(t)), 2.0 if n in (7, 500, 501) else 1.0]) for n, t, m in now}
    assert retrieval.merge_collection(entries(now), table, path, embedder(3), "one") == Merged(0, 201, 0)
    # Vectors of another model are of no use.
    assert retrieval.merge_collection(entries(now[:5]), table, path, embedder(4), "two") == Merged(5, 0, 196)
    assert retrieval.merge_collection(entries(now).limit(0), table, path, embedder(5), "two") is None
    assert {vector[1] for *_, vector in held().values()} == {4.0}


def test_collection_rows_and_replacement(spark, tmp_path, table):
    df = spark.createDataFrame([("g", 7, "text"), ("g", 8, " nan ")], "game_id string, move_number int, search_text string")
    collection = retrieval.build_collection(
        df, "positions", retrieval.position_id("game_id", "move_number"), "search_text", ["game_id", "move_number"]
    )
    path = f"{tmp_path}/c"
    assert retrieval.replace_collection(collection, table, path)
    row = spark.read.table(table).collect()
    assert [(r["collection"], r["id"], r["document"], r["metadata"]) for r in row] == [
        ("positions", "g__move0007", "text", {"game_id": "g", "move_number": "7"})
    ]
    assert not retrieval.replace_collection(collection.limit(0), table, path)
    assert spark.read.table(table).count() == 1


@pytest.fixture
def collections(spark):
    rows = [
        ("a", "1", "near", {"m": "1"}, [1.0, 0.0]), ("a", "2", "far", {"m": None}, [0.0, 1.0]),
        ("b", "1", "other", {"m": "3"}, [1.0, 0.1]),
    ]
    return spark.createDataFrame(rows, f"collection string, id string, document string, metadata map<string,string>, {VECTOR}")


@pytest.mark.parametrize("bound", [0, 1_000])
def test_search_by_collection_and_prompts(spark, collections, bound, monkeypatch):
    monkeypatch.setattr(retrieval, "BROADCAST_HITS", bound)
    asked = [(1, "why?", "a", [1.0, 0.0]), (2, "how?", "b", [1.0, 0.0]), (3, "who?", "missing", [1.0, 0.0])]
    queries = spark.createDataFrame(asked, f"query_id int, question string, collection string, {VECTOR}")
    found = retrieval.search(collections, queries, k=2)
    assert sorted((r["query_id"], r["rank"], r["text"]) for r in found.collect()) == [(1, 1, "near"), (1, 2, "far"), (2, 1, "other")]
    prompts = {r["query_id"]: r for r in retrieval.build_prompts(queries, found).collect()}
    assert prompts[1]["prompt"] == (
        "以下の将棋の棋譜情報を参考に、質問に答えてください。\n質問: why?\n参考情報:\n"
        "ドキュメント 1:\nnear\nメタデータ: {'m': '1'}\n\nドキュメント 2:\nfar\nメタデータ: {'m': None}\n回答:"
    )
    assert prompts[1]["documents"] == ["near", "far"] and prompts[1]["answer"] is None
    assert (prompts[3]["prompt"], prompts[3]["documents"]) == (None, [])
    assert prompts[3]["answer"] == retrieval.NOTHING_FOUND


def test_route_by_words(spark):
    df = spark.createDataFrame([(1, "何手目?"), (2, "矢倉の評価は?")], "query_id int, question string")
    found = sorted((r["query_id"], r["collection"], r["hits"]) for r in retrieval.route(df, "question").collect())
    assert found == [(1, "positions", 3), (2, "floodgate_positions", 2), (2, "joseki_knowledge", 2), (2, "positions", 3)]
    assert len(ROUTES) == 3


@pytest.mark.parametrize("word_bytes", [1 << 20, 40_000])
def test_route_by_ten_thousand_words(spark, word_bytes):
    """One pass or several; the plan does not grow with the words."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcé漢"), rng.integers(1, 7))) for _ in range(10_000)]
    rules = [(f"c{n % 40}", n % 5 + 1, word) for n, word in enumerate(words)] + [("all", 2, None), ("all", 1, ""), ("c1", 9, "zz")]
    texts = ["".join(rng.choice(list("abcé漢 x"), 60)) for _ in range(50)] + [None, "", "zz"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, question string")
    table = spark.createDataFrame(rules, "collection string, hits int, word string")
    routed = route_by_rules(queries, "question", table, word_bytes)
    want = set()
    for number, text in enumerate(texts):
        called = {}
        for collection, hits, word in rules:
            if not word or (text and word in text):
                called[collection] = max(hits, called.get(collection, 0))
        want |= {(number, collection, hits) for collection, hits in called.items()}
    got = [(r["query_id"], r["collection"], r["hits"]) for r in routed.collect()]
    assert len(got) == len(want) and set(got) == want
    few = route_by_rules(queries, "question", table.limit(5))
    plan = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert word_bytes < 1 << 20 or abs(plan(routed) - plan(few)) <= 1


def test_routed_search_takes_the_hits_of_each_route(spark, collections):
    asked = [(1, "a", 1, [1.0, 0.0]), (1, "b", 2, [1.0, 0.0])]
    queries = spark.createDataFrame(asked, f"query_id int, collection string, hits int, {VECTOR}")
    found = retrieval.search(collections, queries, k=2)
    assert sorted((r["collection"], r["rank"], r["text"]) for r in found.collect()) == [("a", 1, "near"), ("b", 1, "other")]


def test_chunks_cover_the_whole_text(spark):
    long_line = "".join(f"{n:04d}。" for n in range(301))
    text = f"== 見出し ==\n# 題\n短い行\n\n本文です。\r\n{long_line}\n" + "あ" * 31
    df = spark.createDataFrame([("k", text), ("e", ""), ("n", None)], "k string, t string")
    found = retrieval.chunk(df, "k", "t").orderBy("chunk_index").collect()
    assert [r["content"] for r in found] == ["短い行", "本文です。", *[long_line[i:i + 500] for i in range(0, 1505, 500)], "あ" * 31]
    assert [r["id"] for r in found][:2] == ["k__chunk0000", "k__chunk0001"]


def test_metadata_text(spark):
    df = spark.sql("SELECT map('a', '1', 'b', CAST(NULL AS STRING)) AS m")
    assert df.select(metadata_text(F.col("m")).alias("t")).first()["t"] == "{'a': '1', 'b': None}"


def test_nearest_holds_k_hits_and_few_distances_at_a_time(monkeypatch):
    """Many short lists, as an index has: what is held does not grow with the rows that are met."""
    monkeypatch.setattr(blocks, "BLOCK_CELLS", 4_000)
    data, queries = vectors(3_000, seed=8), blocks.unit(vectors(200, seed=9).astype(np.float64))
    data[100:400] = data[0]
    found = blocks.Nearest(200, 3)
    widest = []
    smallest = blocks._smallest
    monkeypatch.setattr(blocks, "_smallest", lambda distance, k: widest.append(distance.size) or smallest(distance, k))
    for ids in np.array_split(np.random.default_rng(1).permutation(3_000), 500):
        found.meet(queries, np.arange(200), ids, blocks.unit(data[ids].astype(np.float64)))
        assert found.ids.size == found.distance.size == 600
    q, ids, distance = found.hits()
    assert list(zip(q, ids, distance)) == [(q, i, d) for q, _, i, d in brute(data, queries, 3)]
    whole = blocks.Nearest(200, 3)
    whole.meet(queries, np.arange(200), np.arange(3_000), blocks.unit(data.astype(np.float64)))
    assert [x.tolist() for x in whole.hits()] == [q.tolist(), ids.tolist(), distance.tolist()] and max(widest) <= 4_000


def test_nearest_takes_text_ids_and_a_limit():
    data = blocks.unit(vectors(40, seed=3).astype(np.float64))
    names = np.array([f"v{n:02d}" for n in range(40)], object)
    want = [(q, names[i], d) for q, _, i, d in brute(data, data[:5], 40) if d <= 0.5]
    found = blocks.Nearest(5, 40, np.full(5, 0.5))
    for part in np.array_split(np.arange(40), 6):
        found.meet(data[:5], np.arange(5), names[part], data[part])
    assert list(zip(*found.hits())) == want


def test_queries_are_copied_to_cells_not_to_tiles(spark, monkeypatch):
    """Without structure every query meets every row; its copies must not grow with the number of tiles."""
    copies = []
    probes = vector_index._probes
    monkeypatch.setattr(vector_index, "_probes", lambda *args: copies.append(probes(*args)) or copies[-1])
    data = vectors(1_600, dim=32, seed=2)
    found = top_k(corpus_frame(spark, data), query_frame(spark, data[:20]), 3, query_bytes=0, tile_rows=4)
    assert hits(found) == brute(data, data[:20], 3)
    assert max(probe.count() for probe in copies) <= 20 * 2 * vector_index.CELLS


def test_pruned_search_reads_its_corpus_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(n):
        read.add(1)
        return n

    data = clustered(200)
    corpus = corpus_frame(spark, data).withColumn("id", F.udf(counted, "bigint")("id"))
    found, met = top_k_pruned(corpus, query_frame(spark, data[:5]), 3, tile_rows=10)
    assert hits(found) == brute(data, data[:5], 3) and met.count() == 5 and read.value == 200


def test_nearest_looks_at_most_rows_in_single_precision():
    """The pairs of vectors without structure: a block of them costs half the memory, and its hits stay exact."""
    data, queries = (blocks.unit(vectors(2_048, dim=64, seed=seed).astype(np.float64)) for seed in (11, 12))
    queries, close = queries[:512], data[:40] + 1e-7 * vectors(40, dim=64, seed=13)
    data[1_000:1_040] = blocks.unit(close)
    found = blocks.Nearest(512, 5)
    found.meet(queries, np.arange(512), np.arange(2_048), data)
    tracemalloc.start()
    found.meet(queries, np.arange(512), np.arange(2_048, 4_096), data)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # A million distances of 4 bytes, and which of them are near.
    assert held < 8 * 512 * 2_048
    q, ids, distance = found.hits()
    both = np.concatenate([data, data])
    assert list(zip(q, ids, distance)) == [(q, i, d) for q, _, i, d in brute(both, queries, 5)]


def test_index_search_leaves_no_rows_of_queries_on_the_driver(spark):
    """Several sets: what is returned reads the shared folder, its plan is the same for any number of sets."""
    data = clustered(120)
    index, asked = build_index(corpus_frame(spark, data)), query_frame(spark, data)
    nodes = []
    for query_bytes in (1 << 20, 8 * data.shape[1] * 20):
        found, met = search_index(index, asked, 3, step=1.0, query_bytes=query_bytes)
        assert hits(found) == brute(data, data, 3) and met.filter("complete").count() == 120
        plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (found, met)]
        assert not any(kind in plan for plan in plans for kind in ("LocalRelation", "LogicalRDD", "Union"))
        nodes.append([len(plan.splitlines()) for plan in plans])
    assert nodes[0] == nodes[1]


def test_queries_of_one_name_are_taken_in_sets_too(spark, monkeypatch):
    sets = []
    probe = vector_index._probe
    monkeypatch.setattr(vector_index, "_probe", lambda *args: sets.append(len(next(a for a in args if isinstance(a, tuple))[0])) or probe(*args))
    data = vectors(60, seed=4)
    asked = query_frame(spark, data).withColumn("query_id", F.lit(7).cast("bigint"))
    found, met = search_index(build_index(corpus_frame(spark, data)), asked, 1, step=1.0, query_bytes=8 * data.shape[1] * 6)
    assert sorted(r["id"] for r in found.collect()) == list(range(60)) and met.count() == 60
    assert sum(sets) == 60 and max(sets) <= 20


@pytest.mark.parametrize("way", ["index", "scan"])
def test_a_set_of_queries_is_no_python_objects_on_the_driver(spark, way):
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    n, dim = 20_000, 64
    data = vectors(40, dim=dim, seed=5)
    shifted = F.transform("embedding", lambda x: (x + F.col("n") % 97 / 1_000).cast("float"))
    asked = query_frame(spark, data).crossJoin(spark.range(n // 40).withColumnRenamed("id", "n"))
    asked = asked.select((F.col("query_id") * n + F.col("n")).alias("query_id"), shifted.alias("embedding"))
    corpus = corpus_frame(spark, data)
    index = build_index(corpus) if way == "index" else None
    tracemalloc.start()
    try:
        found = search_index(index, asked, 1, step=1.0)[0] if index else top_k(corpus, asked, 1)
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    assert found.count() == n
    # Twice the vectors as they come; as numbers in double precision they were four times that, as Python's thirty times.
    assert held < 2 * 4 * n * dim + (4 << 20)
