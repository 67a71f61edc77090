"""Column roles, table schemas and layer names."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column names and types of the tables.
POSITIONS_SCHEMA = T.StructType([
    T.StructField("game_id", T.StringType()),
    T.StructField("move_number", T.IntegerType()),
    T.StructField("sfen", T.StringType()),
    T.StructField("prev_sfen", T.StringType()),
    T.StructField("move_usi", T.StringType()),
    T.StructField("player", T.StringType()),
    T.StructField("black_player", T.StringType()),
    T.StructField("white_player", T.StringType()),
    T.StructField("best_move", T.StringType()),
    T.StructField("score_cp", T.IntegerType()),
    T.StructField("pv", T.StringType()),
])
FEED_RAW_SCHEMA = T.StructType([
    T.StructField("game_id", T.StringType()),
    T.StructField("csa", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("source", T.StringType()),
])
ARTICLE_RAW_SCHEMA = T.StructType([
    T.StructField("strategy", T.StringType()),
    T.StructField("raw_content", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("source", T.StringType()),
])
FEED_POSITIONS_SCHEMA = T.StructType([
    T.StructField("game_id", T.StringType()),
    T.StructField("move_number", T.IntegerType()),
    T.StructField("sfen", T.StringType()),
    T.StructField("move_usi", T.StringType()),
    T.StructField("player", T.StringType()),
    T.StructField("black_player", T.StringType()),
    T.StructField("white_player", T.StringType()),
])
INITIAL_SFEN = "lnsgkgsnl/1r5b1/ppppppppp/9/9/9/PPPPPPPPP/1B5R1/LNSGKGSNL b - 1"

# Row expectations per table.
EXPECTATIONS = {
    "positions": {
        "valid_game_id": "game_id IS NOT NULL",
        "valid_move_number": "move_number >= 0",
        "valid_player": "player IN ('black', 'white')",
    },
    "floodgate_positions": {
        "valid_game_id": "game_id IS NOT NULL",
        "valid_move_number": "move_number >= 0",
        "valid_player": "player IN ('black', 'white')",
    },
    "joseki_knowledge": {
        "strategy_not_null": "strategy IS NOT NULL",
        "content_not_null": "content IS NOT NULL",
        "source_not_null": "source IS NOT NULL",
    },
    "position_features": {
        "valid_move_quality": "move_quality IN ('start', 'best', 'blunder', 'normal')",
    },
    "game_summary": {
        "final_score_not_null": "final_score_cp IS NOT NULL",
        "valid_players": "black_player IS NOT NULL AND white_player IS NOT NULL",
    },
    "floodgate_position_features": {"search_text_not_null": "search_text IS NOT NULL"},
    "joseki_features": {"search_text_not_null": "search_text IS NOT NULL"},
}


@dataclass(frozen=True)
class SequenceSpec:
    """Which columns hold the key, the order and the scored attributes of a sequence.

    ``order`` is an integer column, unique inside a key (``dedupe`` first). Keys of more than
    ``bucket_rows`` rows are cut at ``cuts``, orders that ``cut_ranges`` has drawn from them, so that no
    window ever holds a whole hot key. ``max_order`` states a known upper bound of an order that is never
    negative (``with_bounds`` reads it): keys are then cut every ``bucket_rows`` values (``fit_buckets``
    finds the width for orders with wide gaps). A bound below ``bucket_rows``, or ``short_keys`` where no key
    turned out to be long, makes one bucket per key enough, which saves the pass over the bucket borders.
    """

    key: str = "game_id"
    order: str = "move_number"
    actor: str = "player"
    score: str = "score_cp"
    first_actor: str = "black"
    second_actor: str = "white"
    first_name: str = "black_player"
    second_name: str = "white_player"
    state: str = "sfen"
    prev_state: str = "prev_sfen"
    move: str = "move_usi"
    best: str = "best_move"
    bucket_rows: int = 100_000
    max_order: int | None = None
    cuts: DataFrame | None = field(default=None, compare=False, repr=False)
    short_keys: bool = False

    @property
    def one_bucket(self) -> bool:
        return self.short_keys or self.max_order is not None and self.max_order < self.bucket_rows

    def with_max_order(self, max_order: int | None) -> SequenceSpec:
        return replace(self, max_order=max_order)


@dataclass(frozen=True)
class Layers:
    """Schema of each layer, and the folder of its tables (``None`` leaves it to the catalog)."""

    landing: str = "landing"
    bronze: str = "bronze"
    silver: str = "silver"
    gold: str = "gold"
    catalog: str | None = None
    location: str | None = None

    def schema(self, layer: str) -> str:
        name = getattr(self, layer)
        return f"{self.catalog}.{name}" if self.catalog else name

    def table(self, layer: str, name: str) -> str:
        return f"{self.schema(layer)}.{name}"

    def path(self, layer: str, name: str) -> str | None:
        return f"{self.location}/{getattr(self, layer)}/{name}" if self.location else None
