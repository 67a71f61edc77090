"""Text collections: cleaning, building, searching, and prompts from the hits."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from seqlake.functions.arrays import explode_with_place
from seqlake.functions.text import CHUNK_CHARS, NO_TEXT, chunks, metadata_map, metadata_text, strip
from seqlake.operators.embedding import embed
from seqlake.operators.nearest import TOP_K, top_k
from seqlake.session import shared_dir
from seqlake.sources.tables import notes_of, publish

# The prompt, its numbered blocks, and the answer when nothing was found.
PROMPT = ("以下の将棋の棋譜情報を参考に、質問に答えてください。\n質問: ", "\n参考情報:\n", "\n回答:")
BLOCK = ("ドキュメント ", ":\n", "\nメタデータ: ")
NOTHING_FOUND = "関連する情報が見つかりませんでした。"

BROADCAST_HITS = 500_000
_MODEL = "model"


@dataclass(frozen=True)
class Route:
    """A collection to search, how many hits to take, and the words that call for it."""

    collection: str
    hits: int
    words: Sequence[str] = ()


# The collections and the words that call for them.
ROUTES = (
    Route("positions", 3),
    Route("joseki_knowledge", 2, (
        "戦法", "定跡", "矢倉", "四間飛車", "棒銀", "振り飛車", "囲い", "手筋")),
    Route("floodgate_positions", 2, (
        "形勢", "評価", "有利", "不利", "互角", "比較", "強豪", "エンジン")),
)


def clean_text(df: DataFrame, text: str) -> DataFrame:
    """Strip the text and drop the rows that have none."""
    stripped = df.withColumn(text, strip(F.col(text)))
    return stripped.filter(F.col(text).isNotNull() & ~F.lower(text).isin(*NO_TEXT))


def entries(
    df: DataFrame, name: str, id: Column, text: str, metadata: Mapping[str, Column] | list[str]
) -> DataFrame:
    """``collection, id, document, metadata`` of the rows that have a text."""
    return clean_text(df, text).select(
        F.lit(name).alias("collection"),
        id.alias("id"),
        F.col(text).alias("document"),
        metadata_map(metadata).alias("metadata"),
    )


def build_collection(
    df: DataFrame,
    name: str,
    id: Column,
    text: str,
    metadata: Mapping[str, Column] | list[str],
    embedder: Callable[[DataFrame, str], DataFrame] = embed,
) -> DataFrame:
    """``collection, id, document, metadata, embedding`` of the rows that have a text."""
    return embedder(entries(df, name, id, text, metadata), "document")


def position_id(key: str, order: str) -> Column:
    return F.format_string("%s__move%04d", F.col(key).cast("string"), F.col(order))


def chunk_id(key: str, index: str) -> Column:
    return F.format_string("%s__chunk%04d", F.col(key).cast("string"), F.col(index))


def replace_collection(collection: DataFrame, table: str, path: str | None = None) -> bool:
    """Publish the collection in place of the old one; an empty one is skipped."""
    if collection.isEmpty():
        return False
    publish(collection, table, path)
    return True


@dataclass(frozen=True)
class Merged:
    """Entries that were embedded, that kept their vector, and that are gone."""

    embedded: int
    kept: int
    gone: int


def merge_collection(
    fresh: DataFrame,
    table: str,
    path: str | None = None,
    embedder: Callable[[DataFrame, str], DataFrame] = embed,
    model: str = "default",
) -> Merged | None:
    """Bring a published collection up to ``fresh`` (``entries``): embed new and changed documents only.

    An entry whose id and document, by its SHA-256, are in the table keeps its vector; its metadata is that of
    ``fresh``. Entries that ``fresh`` does not have are gone. ``model`` names what the embedder makes: a table made by
    another one is built anew. The table becomes what a full build would give, as a new version; an empty ``fresh`` is
    skipped. Vectors and hashes are shuffled by id, documents of kept entries with their own row.
    """
    if fresh.isEmpty():
        return None
    spark = fresh.sparkSession
    name = {_MODEL: model}
    known = spark.catalog.tableExists(table) and notes_of(spark, table).get(_MODEL) == model
    if not known:
        gone = spark.read.table(table).select("id").join(fresh.select("id"), "id", "left_anti").count() if spark.catalog.tableExists(table) else 0
        counted, seen = _counted(fresh, "embedded")
        publish(embedder(counted, "document"), table, path, notes=lambda: name)
        return Merged(seen.get["embedded"], 0, gone)
    digest = F.sha2("document", 256)
    old = spark.read.table(table).select(F.col("id"), digest.alias("_digest"), F.struct("embedding").alias("_old"))
    old = old.dropDuplicates(["id", "_digest"])
    marked = fresh.withColumn("_digest", digest).join(old, ["id", "_digest"], "left")
    columns = [F.col(column) for column in fresh.columns]
    changed, embedded = _counted(marked.filter(F.col("_old").isNull()).select(columns), "embedded")
    same, kept = _counted(marked.filter(F.col("_old").isNotNull()).select(*columns, F.col("_old.embedding").alias("embedding")), "kept")
    gone = spark.read.table(table).select("id").join(fresh.select("id"), "id", "left_anti").count()
    publish(embedder(changed, "document").unionByName(same), table, path, notes=lambda: name)
    return Merged(embedded.get["embedded"], kept.get["kept"], gone)


def _counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias(name)), seen


def search(
    collections: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    finder: Callable[..., DataFrame] = top_k,
) -> DataFrame:
    """``query_id, collection, rank, text, metadata, distance`` of each query's hits.

    ``queries`` has ``query_id, collection, embedding``, and ``hits`` when a query takes fewer than
    k. A collection that is missing or empty gives no hits.
    """
    hits = finder(collections, queries, k, on="collection")
    if "hits" in queries.columns:
        wanted = queries.select("query_id", "collection", "hits")
        hits = hits.join(wanted, ["query_id", "collection"]).filter(F.col("rank") <= F.col("hits"))
    return with_documents(hits, collections, queries.count() * k)


def with_documents(hits: DataFrame, collections: DataFrame, most_hits: int) -> DataFrame:
    """Add text and metadata to hits; ``most_hits`` is an upper bound of their number.

    A bounded number of hits goes to the tasks that read the documents, which then need no shuffle.
    """
    documents = collections.select("collection", "id", F.col("document").alias("text"), "metadata")
    if most_hits <= BROADCAST_HITS:
        hits = F.broadcast(hits)
    return documents.join(hits, ["collection", "id"]).select(
        "query_id", "collection", "rank", "text", "metadata", "distance"
    )


def build_prompts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``query_id, prompt, answer, documents`` for each question.

    The prompt holds the question and its hits in rank order. Without hits there is no prompt: the
    answer is the fixed message and the documents are empty. A query has at most k hits per
    collection, so the list of its hits stays short.
    """
    hit = F.struct("rank", "text", metadata_text(F.col("metadata")).alias("metadata"))
    per_query = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(hit)).alias("_hits"))

    def block(hit: Column, place: Column) -> Column:
        number = (place + 1).cast("string")
        return F.concat(
            F.lit(BLOCK[0]), number, F.lit(BLOCK[1]), hit["text"], F.lit(BLOCK[2]), hit["metadata"]
        )

    blocks = F.array_join(F.transform("_hits", block), "\n\n")
    found = F.col("_hits").isNotNull()
    prompt = F.concat(F.lit(PROMPT[0]), "question", F.lit(PROMPT[1]), blocks, F.lit(PROMPT[2]))
    return queries.join(per_query, "query_id", "left").select(
        "query_id",
        F.when(found, prompt).alias("prompt"),
        F.when(~found, NOTHING_FOUND).alias("answer"),
        F.coalesce(F.transform("_hits", lambda h: h["text"]), F.array().cast("array<string>")).alias("documents"),
    )


def ask(
    questions: DataFrame,
    collections: DataFrame,
    k: int = TOP_K,
    collection: str = "positions",
    embedder: Callable[[DataFrame, str], DataFrame] = embed,
) -> DataFrame:
    """From ``query_id, question`` to prompts: embed, search one collection, put the prompts together.

    The embedder must be the one the collection was built with; ``collections`` is a published table.
    """
    # Cut here, or the questions would be embedded for each step of the search.
    shared_dir(questions.sparkSession)
    queries = embedder(questions.withColumn("collection", F.lit(collection)), "question").checkpoint()
    return build_prompts(questions, search(collections, queries, k))


def route(queries: DataFrame, text: str, routes: Sequence[Route] = ROUTES) -> DataFrame:
    """One row per question and collection it calls for, with ``hits``, the number to take."""
    called = [
        F.when(
            reduce(or_, [F.contains(F.col(text), F.lit(word)) for word in r.words], F.lit(not r.words)),
            F.struct(F.lit(r.collection).alias("collection"), F.lit(r.hits).alias("hits")),
        )
        for r in routes
    ]
    routed = queries.select("*", F.inline_outer(F.array(*called)))
    return routed.filter(F.col("collection").isNotNull())


def chunk(df: DataFrame, key: str, text: str, max_chars: int = CHUNK_CHARS) -> DataFrame:
    """``key, chunk_index, id, content``: the paragraphs of each article."""
    pieces = explode_with_place(df, [key], chunks(F.col(text), max_chars), "chunk_index", "content")
    return pieces.select(
        key, "chunk_index", chunk_id(key, "chunk_index").alias("id"), "content"
    )
