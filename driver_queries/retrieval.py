"""V1–V10: retrieval over text collections."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from driver_queries.common import read, read_spread
from seqlake.operators import retrieval
from seqlake.operators.embedding import count_terms, embed, embed_with, term_weights
from seqlake.operators.nearest import top_k
from seqlake.operators.features import build_features, build_feed_features, build_knowledge_features
from seqlake.operators.ordered import with_bounds
from seqlake.operators.retrieval import Route
from seqlake.operators.routing import route_by_rules
from seqlake.operators.vector_index import build_index, open_index, publish_index, search_index, top_k_pruned
from seqlake.plans import collections, flows
from seqlake.session import scratch_path
from seqlake.sources.tables import publish
from seqlake.spec import Layers, SequenceSpec

WORD_ROUTES = (
    Route("all", 3),
    Route("english", 2, ("the ", "with ")),
    Route("french", 2, ("le ", "eau")),
    Route("absent", 2, ("and ",)),
)


def v1(spark, folder):
    """Every text with blanks around it; beside it, rows that stand for no text under three names."""
    documents = read_spread(spark, folder, "documents")
    padded = documents.select("doc_id", F.concat(F.lit("\t "), "text", F.lit(" \n")).alias("text"))
    junk = F.element_at(F.array(F.lit(" None\n"), F.lit("NaN"), F.lit("  ")), (F.col("doc_id") % 3 + 1).cast("int"))
    return retrieval.clean_text(padded.unionByName(documents.select("doc_id", junk.alias("text"))), "text")


def v2_terms(spark, folder):
    """What ``embed`` counts: words and pairs of words."""
    return count_terms(read_spread(spark, folder, "documents"), "doc_id", "text")


def v2(spark, folder):
    embedded = embed(read_spread(spark, folder, "documents"), "text")
    return embedded.select("doc_id", "embedding")


def v2_weighted(spark, folder):
    documents = read_spread(spark, folder, "documents")
    embedded = embed(documents, "text", weights=term_weights(documents, "text"))
    return embedded.select("doc_id", "embedding")


def _letter_counts():
    """Stands for loading a model: its vectors count the letters a to h."""
    return lambda texts: np.array([[t.count(letter) for letter in "abcdefgh"] for t in texts])


def v2_model(spark, folder):
    embedded = embed_with(read_spread(spark, folder, "documents").select("doc_id", "text"), "text", _letter_counts)
    parts = [F.col("embedding")[i].cast("int").alias(f"n_{letter}") for i, letter in enumerate("abcdefgh")]
    return embedded.select("doc_id", *parts)


def _no_vectors(df, text):
    return df.withColumn("embedding", F.lit(None).cast("array<float>"))


def v3(spark, folder):
    rows = read(spark, folder, "conversations")
    collection = retrieval.build_collection(
        rows, "positions", retrieval.position_id("conv_id", "turn"), "text",
        ["conv_id", "turn", "role"], _no_vectors,
    )
    entries = F.concat_ws(",", F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return collection.select("collection", "id", "document", entries.alias("metadata"))


def v3_collections(spark, folder):
    """The three Gold tables from the given ones, and the collections built from them."""
    layers = Layers(gold=f"gold_{uuid.uuid4().hex[:12]}", location=scratch_path(spark, "collections"))
    flows.create_schema(spark, layers, "gold")
    role = F.col("role")
    positions = read(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("game_id"), F.col("turn").cast("int").alias("move_number"),
        F.col("text").alias("sfen"), role.alias("move_usi"),
        F.when(role == "user", "black").when(role == "assistant", "white").alias("player"),
        F.when(F.col("turn") % 3 == 0, role).otherwise("none").alias("best_move"), F.length("text").alias("score_cp"),
    )
    documents = read_spread(spark, folder, "documents")
    feed = documents.select(
        F.col("doc_id").cast("string").alias("game_id"), F.lit(0).alias("move_number"), F.col("lang").alias("sfen"),
        F.col("source").alias("move_usi"), F.lit("black").alias("player"),
    )
    articles = documents.select(F.col("doc_id").cast("string").alias("strategy"), F.col("text").alias("content"), "source")
    for name, gold in (
        ("position_features", build_features(positions, with_bounds(positions, SequenceSpec()))),
        ("floodgate_position_features", build_feed_features(feed)),
        ("joseki_features", build_knowledge_features(articles)),
    ):
        publish(gold, layers.table("gold", name), layers.path("gold", name))
    built = collections.build_collections(spark, layers, embedder=lambda df, text: embed_with(df, text, _letter_counts))
    entries = F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    vector = F.transform("embedding", lambda x: x.cast("int").cast("string"))
    every = [spark.read.table(collections.collection_table(layers, name)[0]) for name in built]
    return every[0].unionByName(every[1]).unionByName(every[2]).select(
        "collection", "id", "document", F.concat_ws(",", entries).alias("metadata"), F.concat_ws(",", vector).alias("vector")
    )


def _merged(spark, folder):
    """A collection of all turns, then brought up to other turns: some changed, some gone, some new."""
    table, path = f"merged_{uuid.uuid4().hex}", scratch_path(spark, "merged")

    def embedder(df, text):
        return embed_with(df, text, _letter_counts)

    rows = read(spark, folder, "conversations").withColumn("position", F.col("turn"))
    changed = rows.filter("conv_id % 50 != 7").withColumn(
        "text", F.when(F.col("conv_id") % 20 == 3, F.concat("text", F.lit(" abc"))).otherwise(F.col("text"))
    )
    more = rows.filter("conv_id % 25 = 1").withColumn("position", F.col("turn") + 5000)
    for now in (rows, changed.unionByName(more)):
        found = retrieval.entries(now, "positions", retrieval.position_id("conv_id", "position"), "text", ["role"])
        report = retrieval.merge_collection(found, table, path, embedder, "letters")
    return spark.read.table(table), report


def v3_merge(spark, folder):
    collection, _ = _merged(spark, folder)
    vector = F.transform("embedding", lambda x: x.cast("int").cast("string"))
    return collection.select("id", "document", F.col("metadata")["role"].alias("role"), F.concat_ws(",", vector).alias("vector"))


def v3_merge_counts(spark, folder):
    _, report = _merged(spark, folder)
    return spark.createDataFrame([(report.embedded, report.kept, report.gone)], "embedded bigint, kept bigint, gone bigint")


def _vectors(spark, folder):
    return read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _vector_queries(spark, folder):
    return read(spark, folder, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def v4(spark, folder):
    return top_k(_vectors(spark, folder), _vector_queries(spark, folder))


def v4_tiles(spark, folder):
    """The way beyond the size bound of the queries: both sides in tiles."""
    return top_k(_vectors(spark, folder), _vector_queries(spark, folder), query_bytes=0, tile_rows=300)


def _letter_vectors(df, id, name):
    """How often each of the letters a to h is in a text: vectors that lie close together."""
    count = lambda letter: F.length("text") - F.length(F.replace("text", F.lit(letter)))
    letters = F.array(*[count(letter).cast("float") for letter in "abcdefgh"])
    return df.select(F.col(id).alias(name), letters.alias("embedding"))


def _pruned(spark, folder):
    corpus = _letter_vectors(read_spread(spark, folder, "documents"), "doc_id", "id")
    queries = _letter_vectors(read(spark, folder, "benchmark"), "item_id", "query_id")
    return top_k_pruned(corpus, queries, tile_rows=8)


def v4_pruned(spark, folder):
    """The benchmark's texts among the documents, by their letters: exact, most clusters skipped."""
    return _pruned(spark, folder)[0]


def v4_skipped(spark, folder):
    """What the exact search above did not have to look at."""
    met = _pruned(spark, folder)[1]
    return met.agg(
        F.max("rows_total").alias("rows"), F.count(F.lit(1)).alias("queries"),
        (F.sum("rows_met") < 0.5 * F.sum("rows_total")).alias("skips_half"),
    )


def _indexed(spark, folder):
    """An index, published, opened again by its name, and asked with every vector."""
    schema = f"index_{uuid.uuid4().hex[:12]}"
    path = scratch_path(spark, "index")
    spark.sql(f"CREATE SCHEMA {schema} LOCATION '{path}'")
    publish_index(build_index(_vectors(spark, folder)), f"{schema}.vectors", path)
    return search_index(open_index(spark, f"{schema}.vectors"), _vector_queries(spark, folder))


def v5(spark, folder):
    return _indexed(spark, folder)[0]


def v5_measured(spark, folder):
    """Recall against the exact answer, and the share of rows a query met."""
    near, met = _indexed(spark, folder)
    keys = ["query_id", "id"]
    exact = v4(spark, folder).select(*keys, F.lit(1).alias("wanted"))
    both = exact.join(near.select(*keys, F.lit(1).alias("found")), keys, "full")
    hits = both.agg(
        F.count("found").alias("hits"),
        (F.count_if(F.col("found").isNotNull() & F.col("wanted").isNotNull()) / F.count("wanted")).alias("recall"),
    )
    effort = met.agg(
        F.count(F.lit(1)).alias("queries"), F.count_if("complete").alias("complete"),
        (F.sum("rows_met") / F.sum("rows_total")).alias("rows_met"),
    )
    names = ["queries", "hits", "complete", "recall", "rows_met"]
    # One row each.
    return hits.unionByName(effort, allowMissingColumns=True).agg(*[F.max(name).alias(name) for name in names])


def v5_recall(spark, folder):
    """``V5_recall_measured`` against what is asked of it: 90 % of the hits from under 20 % of the rows."""
    return v5_measured(spark, folder).select(
        "queries", "hits", (F.col("recall") >= 0.9).alias("recall_of_90_percent"), (F.col("rows_met") < 0.2).alias("met_under_20_percent")
    )


def _questions(spark, folder):
    """Each benchmark text asks with the vector of the same number."""
    vectors = read(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")
    return read(spark, folder, "benchmark").join(vectors, "item_id", "left").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question"), "embedding",
        F.concat(F.lit("label"), F.col("label").cast("string")).alias("collection"),
    )


def _asked(questions):
    """Those that have a vector to search with."""
    return questions.filter(F.col("embedding").isNotNull())


def _collections(spark, folder):
    """One collection per label."""
    number = F.col("vec_id").cast("string")
    return read(spark, folder, "embeddings").select(
        F.concat(F.lit("label"), F.col("label").cast("string")).alias("collection"),
        F.col("vec_id").alias("id"),
        F.concat(F.lit("vector "), number).alias("document"),
        F.create_map(F.lit("id"), number, F.lit("label"), F.col("label").cast("string")).alias("metadata"),
        "embedding",
    )


def v6(spark, folder):
    questions = _questions(spark, folder)
    hits = retrieval.search(_collections(spark, folder), _asked(questions), k=3)
    prompts = retrieval.build_prompts(questions, hits)
    return prompts.select("query_id", "prompt", "answer", F.array_join("documents", "|").alias("documents"))


def v6_ask(spark, folder):
    """From turns and questions to prompts, with vectors SQL can state."""

    def embedder(df, text):
        return embed_with(df, text, _letter_counts)

    collection = retrieval.build_collection(
        read(spark, folder, "conversations"), "positions", retrieval.position_id("conv_id", "turn"), "text",
        ["role"], embedder,
    )
    questions = read(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )
    prompts = retrieval.ask(questions, collection, 3, embedder=embedder)
    return prompts.select("query_id", "prompt", F.size("documents").alias("documents"))


def v7(spark, folder):
    """Every question goes to a collection that does not exist."""
    questions = _questions(spark, folder).withColumn("collection", F.lit("absent"))
    prompts = retrieval.build_prompts(questions, retrieval.search(_collections(spark, folder), _asked(questions)))
    return prompts.select("query_id", "prompt", "answer", F.size("documents").alias("documents"))


def v8(spark, folder):
    """The collection of label 3 is missing."""
    collections = _collections(spark, folder).filter("collection != 'label3'")
    hits = retrieval.search(collections, _asked(_questions(spark, folder)))
    return hits.select("query_id", "collection", "rank", "text", F.col("metadata")["label"].alias("label"), "distance")


def v9(spark, folder):
    questions = read_spread(spark, folder, "documents").select("doc_id", "text")
    return retrieval.route(questions, "text", WORD_ROUTES).select("doc_id", "collection", "hits")


def _rules(spark, folder):
    """Every word of the benchmark calls for a collection of its length; one rule holds for all."""
    words = read(spark, folder, "benchmark").select(F.explode(F.split("text", r"[ \n]+")).alias("word")).filter("word != ''").distinct()
    size = F.length("word")
    named = words.select(F.concat(F.lit("length"), size.cast("string")).alias("collection"), (size % 3 + 1).alias("hits"), "word")
    return named.unionByName(spark.createDataFrame([("all", 4, None)], "collection string, hits int, word string"))


def v9_rules(spark, folder):
    documents = read_spread(spark, folder, "documents").select("doc_id", "text")
    return route_by_rules(documents, "text", _rules(spark, folder)).select("doc_id", "collection", "hits")


def v9_search(spark, folder):
    """Routed questions, each collection searched for its own number of hits."""
    every = _collections(spark, folder)
    english = every.filter(F.col("collection") < "label5").withColumn("collection", F.lit("english"))
    french = every.filter(F.col("collection") >= "label5").withColumn("collection", F.lit("french"))
    collections = every.withColumn("collection", F.lit("all")).unionByName(english).unionByName(french)
    questions = _asked(_questions(spark, folder)).drop("collection")
    routed = retrieval.route(questions, "question", WORD_ROUTES)
    hits = retrieval.search(collections, routed, k=3)
    return hits.select("query_id", "collection", "rank", "text", "distance")


def v10(spark, folder):
    return retrieval.chunk(read_spread(spark, folder, "documents"), "doc_id", "text")


LETTERS_SQL = "[" + ", ".join(
    f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE)" for c in "abcdefgh"
) + "]"
CHUNK_SQL = """
        WITH lines AS (
          SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\\r+$', '')) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
        body AS (SELECT * FROM lines WHERE line != '' AND NOT regexp_matches(line, '^(=+[^=]|#+ )')),
        pieces AS (
          SELECT doc_id, n, p, substr(line, CAST(p * 500 + 1 AS BIGINT), 500) AS content
          FROM (SELECT *, unnest(range(0, (length(line) - 1) // 500 + 1)) AS p FROM body)),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n, p) - 1 AS i FROM pieces)
        SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, format('{}__chunk{:04d}', CAST(doc_id AS VARCHAR), i) AS id, content
        FROM numbered"""
DOCUMENT_LETTERS_SQL = "concat_ws(',', " + ", ".join(
    f"length(document) - length(replace(document, '{c}', ''))" for c in "abcdefgh"
) + ")"
# Cosines are taken in double precision on both sides, then rounded.
PAIRS_SQL = """
vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (
  SELECT {query} AS query_id, {columns} c.vec_id AS id,
         round(1 - list_cosine_similarity({vector}, c.e), 6) + 0.0 AS distance
  FROM {queries} JOIN vectors c ON {on}),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY {partition} ORDER BY distance, id) AS INTEGER) AS rank FROM pairs)
"""
TOP_K_SQL = "WITH" + PAIRS_SQL.format(
    query="q.vec_id", columns="", vector="q.e", queries="vectors q", on="true", partition="query_id"
) + "SELECT query_id, rank, id, distance FROM ranked WHERE rank <= 5"
QUESTIONS_SQL = """
questions AS (
  SELECT b.item_id, b.text, CAST(e.embedding AS DOUBLE[]) AS e, e.label
  FROM benchmark b LEFT JOIN embeddings e ON b.item_id = e.vec_id),
"""
HITS_SQL = "WITH" + QUESTIONS_SQL + PAIRS_SQL.format(
    query="q.item_id", columns="q.label, ", vector="q.e", queries="questions q",
    on="q.label = c.label", partition="query_id",
)

QUERIES = {
    "V1_clean_text": v1,
    "V2_terms": v2_terms,
    "V2_embed": v2,
    "V2_embed_weighted": v2_weighted,
    "V2_embed_with_model": v2_model,
    "V3_build_collection": v3,
    "V3_collections": v3_collections,
    "V3_merge": v3_merge,
    "V3_merge_counts": v3_merge_counts,
    "V4_top_k": v4,
    "V4_top_k_tiles": v4_tiles,
    "V4_pruned": v4_pruned,
    "V4_skipped": v4_skipped,
    "V5_top_k_approx": v5,
    "V5_recall": v5_recall,
    "V5_recall_measured": v5_measured,
    "V6_prompts": v6,
    "V6_ask": v6_ask,
    "V7_no_hits": v7,
    "V8_search": v8,
    "V9_route": v9,
    "V9_route_by_rules": v9_rules,
    "V9_routed_search": v9_search,
    "V10_chunk": v10,
}

ORACLES = {
    "V1_clean_text": """
        SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents
        """,
    "V2_terms": """
        WITH texts AS (
          SELECT doc_id, regexp_extract_all(lower(text), '\\p{Han}|\\p{Hiragana}|\\p{Katakana}|[\\p{L}\\p{N}]+') AS w FROM documents),
        terms AS (
          SELECT doc_id, unnest(w) AS term FROM texts
          UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM texts, unnest(range(1, len(w))) t(i))
        SELECT doc_id, term, count(*) AS n FROM terms GROUP BY ALL""",
    "V2_embed_with_model": "SELECT doc_id, "
    + ", ".join(f"CAST(length(text) - length(replace(text, '{c}', '')) AS INTEGER) AS n_{c}" for c in "abcdefgh")
    + " FROM documents",
    "V5_recall": """
        SELECT count(*) AS queries, 5 * count(*) AS hits, true AS recall_of_90_percent, true AS met_under_20_percent
        FROM embeddings""",
    "V3_build_collection": """
        SELECT 'positions' AS collection, format('{}__move{:04d}', CAST(conv_id AS VARCHAR), turn) AS id,
               regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS document,
               'conv_id=' || conv_id || ',turn=' || turn || ',role=' || role AS metadata
        FROM conversations
        WHERE lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) NOT IN ('', 'nan', 'none')""",
    "V3_collections": f"""
        WITH signed AS (
          SELECT *, CASE WHEN role = 'assistant' THEN -length(text) ELSE length(text) END AS score FROM conversations),
        changed AS (SELECT *, score - lag(score) OVER (PARTITION BY conv_id ORDER BY turn) AS delta FROM signed),
        positions AS (
          SELECT *, CASE WHEN turn % 3 = 0 THEN role ELSE 'none' END AS best,
                 CASE WHEN turn = 0 THEN 'start' WHEN turn % 3 = 0 THEN 'best' WHEN abs(delta) >= 200 THEN 'blunder' ELSE 'normal' END AS quality
          FROM changed),
        entries AS (
          SELECT 'positions' AS collection, format('{{}}__move{{:04d}}', CAST(conv_id AS VARCHAR), turn) AS id,
                 '局面: ' || text || ' 指し手: ' || role || ' 推奨手: ' || best || ' 評価値: ' || length(text) || 'cp' AS document,
                 concat_ws(',', concat_ws('=', 'game_id', conv_id), concat_ws('=', 'move_number', turn), concat_ws('=', 'sfen', text),
                   concat_ws('=', 'move_usi', role),
                   concat_ws('=', 'player', CASE role WHEN 'user' THEN 'black' WHEN 'assistant' THEN 'white' END),
                   concat_ws('=', 'move_quality', quality), concat_ws('=', 'score_cp', length(text))) AS metadata
          FROM positions
          UNION ALL
          SELECT 'floodgate_positions', CAST(doc_id AS VARCHAR) || '__move0000', '局面: ' || lang || ' 指し手: ' || source,
                 concat_ws(',', concat_ws('=', 'game_id', doc_id), 'move_number=0', concat_ws('=', 'sfen', lang),
                   concat_ws('=', 'move_usi', source), 'player=black')
          FROM documents
          UNION ALL
          SELECT 'joseki_knowledge', c.id, regexp_replace(c.content, '^\\s+|\\s+$', '', 'g'),
                 concat_ws(',', concat_ws('=', 'strategy', doc_id), concat_ws('=', 'chunk_index', chunk_index), concat_ws('=', 'source', source))
          FROM ({CHUNK_SQL}) c JOIN documents USING (doc_id))
        SELECT *, {DOCUMENT_LETTERS_SQL} AS vector FROM entries
        WHERE document IS NOT NULL AND lower(document) NOT IN ('', 'nan', 'none')""",
    "V3_merge": f"""
        WITH turns AS (
          SELECT conv_id, turn AS position, role, CASE WHEN conv_id % 20 = 3 THEN text || ' abc' ELSE text END AS text
          FROM conversations WHERE conv_id % 50 != 7
          UNION ALL SELECT conv_id, turn + 5000, role, text FROM conversations WHERE conv_id % 25 = 1),
        entries AS (
          SELECT format('{{}}__move{{:04d}}', CAST(conv_id AS VARCHAR), position) AS id, role,
                 regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS document FROM turns)
        SELECT id, document, role, {DOCUMENT_LETTERS_SQL} AS vector FROM entries
        WHERE lower(document) NOT IN ('', 'nan', 'none')""",
    "V3_merge_counts": """
        SELECT count(*) FILTER (conv_id % 50 != 7 AND conv_id % 20 = 3) + count(*) FILTER (conv_id % 25 = 1) AS embedded,
               count(*) FILTER (conv_id % 50 != 7 AND conv_id % 20 != 3) AS kept, count(*) FILTER (conv_id % 50 = 7) AS gone
        FROM conversations
        WHERE lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) NOT IN ('', 'nan', 'none')""",
    "V4_top_k": TOP_K_SQL,
    "V4_top_k_tiles": TOP_K_SQL,
    "V4_pruned": f"""
        WITH d AS (SELECT doc_id, {LETTERS_SQL} AS e FROM documents),
        q AS (SELECT item_id, {LETTERS_SQL} AS e FROM benchmark),
        pairs AS (
          SELECT item_id AS query_id, doc_id AS id, round(1 - coalesce(nullif(list_cosine_similarity(q.e, d.e), 'nan'), 0), 6) + 0.0 AS distance
          FROM q JOIN d ON true)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank, id, distance
        FROM pairs QUALIFY rank <= 5""",
    "V4_skipped": """
        SELECT (SELECT count(*) FROM documents) AS rows, count(*) AS queries, true AS skips_half FROM benchmark""",
    "V6_ask": f"""
        WITH docs AS (
          SELECT format('{{}}__move{{:04d}}', CAST(conv_id AS VARCHAR), turn) AS id, role,
                 regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations),
        d AS (SELECT *, {LETTERS_SQL} AS e FROM docs),
        q AS (SELECT *, {LETTERS_SQL} AS e FROM benchmark),
        pairs AS (
          SELECT q.item_id, q.text AS question, d.id, d.role, d.text,
                 round(1 - list_cosine_similarity(q.e, d.e), 6) + 0.0 AS distance FROM q JOIN d ON true),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, id) AS rank FROM pairs)
        SELECT item_id AS query_id, CAST(count(*) AS INTEGER) AS documents,
               '以下の将棋の棋譜情報を参考に、質問に答えてください。' || chr(10) || '質問: ' || min(question) || chr(10)
                 || '参考情報:' || chr(10)
                 || string_agg('ドキュメント ' || rank || ':' || chr(10) || text || chr(10)
                      || 'メタデータ: {{''role'': ''' || role || '''}}', chr(10) || chr(10) ORDER BY rank)
                 || chr(10) || '回答:' AS prompt
        FROM ranked WHERE rank <= 3 GROUP BY item_id""",
    "V7_no_hits": """
        SELECT item_id AS query_id, CAST(NULL AS VARCHAR) AS prompt,
               '関連する情報が見つかりませんでした。' AS answer, 0 AS documents
        FROM benchmark""",
    "V6_prompts": HITS_SQL + """,
        blocks AS (
          SELECT query_id,
                 string_agg('ドキュメント ' || rank || ':' || chr(10) || 'vector ' || id || chr(10)
                   || 'メタデータ: {''id'': ''' || id || ''', ''label'': ''' || label || '''}',
                   chr(10) || chr(10) ORDER BY rank) AS body,
                 string_agg('vector ' || id, '|' ORDER BY rank) AS documents
          FROM ranked WHERE rank <= 3 GROUP BY query_id)
        SELECT q.item_id AS query_id,
               '以下の将棋の棋譜情報を参考に、質問に答えてください。' || chr(10) || '質問: ' || q.text || chr(10)
                 || '参考情報:' || chr(10) || b.body || chr(10) || '回答:' AS prompt,
               CASE WHEN b.query_id IS NULL THEN '関連する情報が見つかりませんでした。' END AS answer,
               coalesce(b.documents, '') AS documents
        FROM questions q LEFT JOIN blocks b ON q.item_id = b.query_id""",
    "V8_search": HITS_SQL + """
        SELECT query_id, 'label' || label AS collection, rank, 'vector ' || id AS text,
               CAST(label AS VARCHAR) AS label, distance
        FROM ranked WHERE rank <= 5 AND label != 3""",
    "V9_route": """
        SELECT doc_id, 'all' AS collection, 3 AS hits FROM documents
        UNION ALL SELECT doc_id, 'english', 2 FROM documents WHERE regexp_matches(text, 'the |with ')
        UNION ALL SELECT doc_id, 'french', 2 FROM documents WHERE regexp_matches(text, 'le |eau')
        UNION ALL SELECT doc_id, 'absent', 2 FROM documents WHERE regexp_matches(text, 'and ')""",
    "V9_route_by_rules": """
        WITH words AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \\n]+')) AS word FROM benchmark)
        SELECT DISTINCT doc_id, 'length' || length(word) AS collection, CAST(length(word) % 3 + 1 AS INTEGER) AS hits
        FROM documents JOIN words ON word != '' AND contains(text, word)
        UNION ALL SELECT doc_id, 'all', 4 FROM documents""",
    "V9_routed_search": "WITH" + QUESTIONS_SQL + """
        routed AS (
          SELECT *, 'all' AS collection, 3 AS hits FROM questions
          UNION ALL SELECT *, 'english', 2 FROM questions WHERE regexp_matches(text, 'the |with ')
          UNION ALL SELECT *, 'french', 2 FROM questions WHERE regexp_matches(text, 'le |eau')),
        """ + PAIRS_SQL.format(
            query="q.item_id", columns="q.collection, q.hits, ", vector="q.e", queries="routed q",
            on="q.e IS NOT NULL AND (q.collection = 'all' OR (q.collection = 'english') = (c.label < 5))",
            partition="query_id, collection",
        ) + "SELECT query_id, collection, rank, 'vector ' || id AS text, distance FROM ranked WHERE rank <= hits",
    "V10_chunk": CHUNK_SQL,
}
