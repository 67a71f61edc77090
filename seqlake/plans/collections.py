"""The three text collections, built from the Gold tables and published whole."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.functions.arrays import explode_with_place
from seqlake.functions.text import CHUNK_CHARS, chunks
from seqlake.operators.embedding import embed
from seqlake.operators.retrieval import Merged, chunk_id, entries, merge_collection, position_id, replace_collection
from seqlake.spec import Layers


@dataclass(frozen=True)
class Source:
    """The Gold table of a collection, the columns its hits show, and whether its texts are cut into chunks."""

    table: str
    metadata: Sequence[str]
    chunked: bool = False


# Collections, their tables and the metadata of an entry.
SOURCES: Mapping[str, Source] = {
    "positions": Source(
        "position_features", ("game_id", "move_number", "sfen", "move_usi", "player", "move_quality", "score_cp")
    ),
    "floodgate_positions": Source(
        "floodgate_position_features", ("game_id", "move_number", "sfen", "move_usi", "player")
    ),
    "joseki_knowledge": Source("joseki_features", ("strategy", "chunk_index", "source"), chunked=True),
}


def collection_table(layers: Layers, name: str) -> tuple[str, str | None]:
    return layers.table("gold", f"collection_{name}"), layers.path("gold", f"collection_{name}")


def entries_of(gold: DataFrame, name: str, max_chars: int = CHUNK_CHARS) -> DataFrame:
    """The entries of collection ``name`` from its Gold table, without vectors: one per position, or per chunk of an article."""
    source = SOURCES[name]
    text, key = "search_text", position_id("game_id", "move_number")
    if source.chunked:
        pieces = chunks(F.col(text), max_chars)
        gold = explode_with_place(gold, ["strategy", "source"], pieces, "chunk_index", text)
        key = chunk_id("strategy", "chunk_index")
    metadata: dict[str, Column] = {column: F.col(column) for column in source.metadata}
    return entries(gold, name, key, text, metadata)


def collection_of(
    gold: DataFrame, name: str, embedder: Callable[[DataFrame, str], DataFrame] = embed, max_chars: int = CHUNK_CHARS
) -> DataFrame:
    """The entries of collection ``name`` with their vectors."""
    return embedder(entries_of(gold, name, max_chars), "document")


def build_collections(
    spark: SparkSession,
    layers: Layers,
    names: Sequence[str] = tuple(SOURCES),
    embedder: Callable[[DataFrame, str], DataFrame] = embed,
) -> list[str]:
    """Publish the collections and name those that were; absent or empty sources are skipped."""
    built = []
    for name in names:
        gold = layers.table("gold", SOURCES[name].table)
        if not spark.catalog.tableExists(gold):
            continue
        if replace_collection(collection_of(spark.read.table(gold), name, embedder), *collection_table(layers, name)):
            built.append(name)
    return built


def update_collections(
    spark: SparkSession,
    layers: Layers,
    names: Sequence[str] = tuple(SOURCES),
    embedder: Callable[[DataFrame, str], DataFrame] = embed,
    model: str = "default",
) -> dict[str, Merged]:
    """As ``build_collections``, but only new and changed entries are embedded; what was done, by collection."""
    done = {}
    for name in names:
        gold = layers.table("gold", SOURCES[name].table)
        if spark.catalog.tableExists(gold):
            merged = merge_collection(entries_of(spark.read.table(gold), name), *collection_table(layers, name), embedder, model)
            if merged is not None:
                done[name] = merged
    return done
