"""Gold tables: features per row and one summary per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.functions import scoring
from seqlake.operators.ordered import BUCKET, measured, null_first, row_rank, with_bucket, with_previous
from seqlake.spec import SequenceSpec

SPEC = SequenceSpec()


def with_turn_score(df: DataFrame, spec: SequenceSpec = SPEC) -> DataFrame:
    return df.withColumn("score_from_turn", scoring.turn_score(spec))


def with_delta(
    df: DataFrame, spec: SequenceSpec = SPEC, keep_bucket: bool = False
) -> DataFrame:
    """Change of ``score_from_turn`` from the preceding row of the key, null on the first."""
    rows = with_previous(df, spec, {"_previous_score": "score_from_turn"}, keep_bucket)
    return _with_change(rows).drop("_previous_score")


def _with_change(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score_delta", F.col("score_from_turn") - F.col("_previous_score"))


def with_scores(
    df: DataFrame,
    spec: SequenceSpec = SPEC,
    threshold: int = scoring.JUMP_THRESHOLD,
    keep_bucket: bool = False,
) -> DataFrame:
    """Turn score, its change and the jump flag: what both Gold tables need.

    Row 0 carries the first actor's name while its score is the one before any move, so the first
    change of a key mixes both sides; that is how the tables define it.
    """
    scored = with_delta(with_turn_score(df, spec), spec, keep_bucket)
    return scored.withColumn("is_blunder", scoring.is_jump("score_delta", threshold))


def with_match(
    df: DataFrame, spec: SequenceSpec = SPEC, compare_to: str = "same"
) -> DataFrame:
    """``is_best_move``: the move equals the best move of the same row, or of the previous one."""
    other = _compared(spec, compare_to)
    rows = df if other == spec.best else with_previous(df, spec, {other: spec.best})
    return rows.withColumn("is_best_move", scoring.matches(spec.move, other)).select(
        *df.columns, "is_best_move"
    )


def _compared(spec: SequenceSpec, compare_to: str) -> str:
    columns = {"same": spec.best, "previous": "_previous_best"}
    if compare_to not in columns:
        raise ValueError(f"compare_to must be 'same' or 'previous', not {compare_to!r}")
    return columns[compare_to]


def with_label(df: DataFrame, spec: SequenceSpec = SPEC) -> DataFrame:
    return df.withColumn("move_quality", scoring.label(spec.order, "is_best_move", "is_blunder"))


def build_features(
    df: DataFrame,
    spec: SequenceSpec = SPEC,
    compare_to: str = "same",
    threshold: int = scoring.JUMP_THRESHOLD,
) -> DataFrame:
    """``position_features``: the input columns and six feature columns, row for row.

    All that is looked up in the previous row comes with one shuffle.
    """
    other = _compared(spec, compare_to)
    look_back = {"_previous_score": "score_from_turn"}
    if other != spec.best:
        look_back[other] = spec.best
    rows = _with_change(with_previous(with_turn_score(df, spec), spec, look_back))
    featured = with_label(
        rows.withColumns({
            "is_blunder": scoring.is_jump("score_delta", threshold),
            "is_best_move": scoring.matches(spec.move, other),
        }),
        spec,
    )
    return featured.withColumn("search_text", scoring.position_text(spec)).select(
        *df.columns,
        "score_from_turn",
        "score_delta",
        "is_best_move",
        "is_blunder",
        "move_quality",
        "search_text",
    )


def final_score(spec: SequenceSpec = SPEC):
    """Aggregate: the last non-null score of the key."""
    return F.expr(
        f"max_by(`{spec.score}`, {null_first(spec.order)}) FILTER (WHERE `{spec.score}` IS NOT NULL)"
    )


def count_jumps(actor: str, spec: SequenceSpec = SPEC):
    """Aggregate: jumps of one actor, 0 when there is none."""
    return F.sum(
        F.when((F.col(spec.actor) == actor) & F.col("is_blunder"), 1).otherwise(0)
    )


def _entries(spec: SequenceSpec):
    return F.sort_array(F.collect_list(F.struct(F.col(spec.order), F.col(spec.score))))


def _as_json(entries: str, keep_nulls: bool):
    return F.to_json(entries, {"ignoreNullFields": "false"} if keep_nulls else {})


def series_parts(
    df: DataFrame, spec: SequenceSpec = SPEC, keep_nulls: bool = False
) -> DataFrame:
    """The score series of every key as JSON arrays, one per bucket: whole at any key length."""
    return (
        with_bucket(df, spec).groupBy(spec.key, F.col(BUCKET).alias("part"))
        .agg(_entries(spec).alias("_entries"))
        .select(
            spec.key,
            "part",
            F.size("_entries").alias("entries"),
            _as_json("_entries", keep_nulls).alias("series_json"),
        )
    )


def _joined_series():
    """Aggregate: the JSON arrays of the parts as one array."""
    inner = F.expr("substr(series_json, 2, length(series_json) - 2)")
    texts = F.transform(
        F.sort_array(F.collect_list(F.struct("part", inner.alias("text")))), lambda p: p["text"]
    )
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def series_json(
    df: DataFrame, spec: SequenceSpec = SPEC, keep_nulls: bool = False
) -> DataFrame:
    """One JSON array per key, whole; if a cell cannot hold it, Spark fails.

    ``series_parts`` holds a series of any length.
    """
    if spec.one_bucket:
        per_key = df.groupBy(spec.key).agg(_entries(spec).alias("_entries"))
        return per_key.select(spec.key, _as_json("_entries", keep_nulls).alias("score_series_json"))
    return series_parts(df, spec, keep_nulls).groupBy(spec.key).agg(_joined_series().alias("score_series_json"))


def summarise(
    scored: DataFrame,
    spec: SequenceSpec = SPEC,
    keep_nulls: bool = False,
) -> DataFrame:
    """``game_summary`` from rows that already carry ``is_blunder``.

    Rows that keep their bucket are still hashed by (key, bucket): then the first grouping needs
    no shuffle, and the second one moves one row per bucket.
    """
    first, second = f"{spec.first_actor}_blunders", f"{spec.second_actor}_blunders"
    final = f"final_{spec.score}"
    rows = scored if spec.one_bucket or BUCKET in scored.columns else with_bucket(scored, spec)
    per_bucket = rows.groupBy(
        spec.key, *([] if spec.one_bucket else [F.col(BUCKET).alias("part")])
    ).agg(
        F.min_by(spec.first_name, row_rank(spec)).alias(spec.first_name),
        F.min_by(spec.second_name, row_rank(spec)).alias(spec.second_name),
        F.max(spec.order).alias("total_moves"),
        final_score(spec).alias(final),
        count_jumps(spec.first_actor, spec).alias(first),
        count_jumps(spec.second_actor, spec).alias(second),
        _entries(spec).alias("_entries"),
    )
    per_bucket = per_bucket.withColumn("series_json", _as_json("_entries", keep_nulls)).drop("_entries")
    if spec.one_bucket:
        return per_bucket.withColumnRenamed("series_json", "score_series_json")

    place = F.expr(null_first("part"))
    return (
        per_bucket.groupBy(spec.key)
        .agg(
            F.min_by(spec.first_name, place).alias(spec.first_name),
            F.min_by(spec.second_name, place).alias(spec.second_name),
            F.max("total_moves").alias("total_moves"),
            F.expr(
                f"max_by(`{final}`, {null_first('part')}) FILTER (WHERE `{final}` IS NOT NULL)"
            ).alias(final),
            F.sum(first).alias(first),
            F.sum(second).alias(second),
            _joined_series().alias("score_series_json"),
        )
    )


def build_summary(
    df: DataFrame,
    spec: SequenceSpec = SPEC,
    threshold: int = scoring.JUMP_THRESHOLD,
    keep_nulls: bool = False,
) -> DataFrame:
    """``game_summary``: names, length, last score, jumps per actor and the score series."""
    spec = measured(df, spec)
    scored = with_scores(df, spec, threshold, keep_bucket=True)
    return summarise(scored, spec, keep_nulls)


def build_feed_features(df: DataFrame, spec: SequenceSpec = SPEC) -> DataFrame:
    return df.withColumn("search_text", scoring.feed_text(spec))


def build_knowledge_features(df: DataFrame) -> DataFrame:
    return df.withColumn("search_text", F.col("content"))
