"""Exact top-k search over 64-bit codes by multi-index hashing.

A code is cut into segments, and the index has a row (segment, value, code) for each. If two codes differ
in at most segments x (r + 1) - 1 bits, some segment differs in at most r. So in round r each open query
looks up all values at distance r from each of its segments, and every code met is verified by its whole
Hamming distance. Once the k-th smallest distance is at most segments x (r + 1) - 1, no unseen code can be
nearer or tie with it, and the query is closed. The last radius covers every code.

Equal codes are one index entry and one query, with their number and the smallest ids, so neither a vector
that a third of all rows share nor its queries multiply. Ties go to the smallest id.

Defined cases: rows without an id or without an embedding have no code: they are neither found nor answered;
null components count as not positive; a query's own id is no answer to it; with fewer than k other rows all
are returned; repeated rows of an id count once, with the smallest code; further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import stored
from seqlake.session import spread

BITS = 64
SEGMENT_BITS = 16
SEGMENTS = BITS // SEGMENT_BITS
K = 10


def sign_codes(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, code): bit i is set if an odd number of the components i, i + 64, ... are positive."""
    place = lambda i: F.pmod(i, F.lit(BITS)).cast("int")
    bit = lambda x, i: F.call_function("shiftleft", F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint"), place(i))
    bits = F.transform(F.col(vector), bit)
    code = F.aggregate(bits, F.lit(0).cast("bigint"), lambda code, one: code.bitwiseXOR(one))
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.when(F.col(vector).isNotNull(), code).alias("code"))
    return rows.filter("id IS NOT NULL AND code IS NOT NULL").groupBy("id").agg(F.min("code").alias("code"))


def _shifted(code, segment: int):
    return F.shiftrightunsigned(code, segment * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)).cast("int")


def _by_segment(frame: DataFrame, column: str) -> DataFrame:
    """A row for each segment of ``column``, with the other columns."""
    values = F.array(*[F.struct(F.lit(s).alias("segment"), _shifted(F.col(column), s).alias("value")) for s in range(SEGMENTS)])
    return frame.select("*", F.explode(values).alias("x")).select(*frame.columns, "x.segment", "x.value")


def _masks(radius: int) -> Column:
    """All segment values with ``radius`` bits, as one constant."""
    values = [str(sum(1 << bit for bit in bits)) for bits in combinations(range(SEGMENT_BITS), radius)]
    return F.split(F.lit(",".join(values)), ",").cast("array<int>")


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, id, distance) of the ``k`` rows nearest to each query; both sides have (id, code)."""
    spark = rows.sparkSession
    # More than the k smallest ids of a code are never needed, and one for the query itself.
    by_id = Window.partitionBy("code").orderBy("id")
    fewest = rows.withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= k + 1)
    codes = stored(fewest.groupBy("code").agg(F.collect_list("id").alias("ids")), "codes")
    index = stored(_by_segment(codes.select("code", F.size("ids").alias("n")), "code"), "index")
    needed = min(k + 1, codes.agg(F.sum(F.size("ids"))).first()[0] or 0)
    opened = stored(queries.select(F.col("code").alias("query"), F.lit(BITS).alias("kth")).distinct(), "queries")
    found = spark.createDataFrame([], "query bigint, code bigint, n int, distance int")
    answers = found
    nearer = Window.partitionBy("query").orderBy("distance").rowsBetween(Window.unboundedPreceding, -1)
    for radius in range(SEGMENT_BITS + 1):
        # Dealt out first: the open queries lie in a small file, their probes are many.
        probes = _by_segment(spread(opened), "query").withColumn("mask", F.explode(_masks(radius)))
        met = (
            probes.select("query", "kth", "segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
            # The planner takes the probes for small: it doesn't see how many values each query looks up.
            .join(index.hint("merge"), ["segment", "value"])
            .withColumn("distance", F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).cast("int"))
            .filter("distance <= kth")
            .select("query", "code", "n", "distance")
        )
        known = stored(found.unionByName(met).distinct(), "known")
        # At most 65 distances of a query decide how far its k-th answer is.
        histogram = known.groupBy("query", "distance").agg(F.sum("n").alias("n"))
        kth = (
            histogram.withColumn("nearer", F.coalesce(F.sum("n").over(nearer), F.lit(0)))
            .filter(F.col("nearer") < needed)
            .groupBy("query")
            .agg(F.max("distance").alias("far"), F.sum("n").alias("met"))
        )
        limits = stored(
            opened.join(kth, "query", "left").select(
                "query",
                F.when(F.col("met") >= needed, F.col("far")).otherwise(F.lit(BITS)).alias("kth"),
                F.coalesce((F.col("met") >= needed) & (F.col("far") <= SEGMENTS * (radius + 1) - 1), F.lit(False)).alias("closed"),
            ),
            "limits",
        )
        found = known.join(limits, "query").filter("distance <= kth").select("query", "code", "n", "distance", "closed")
        found = stored(found, "found")
        answers = answers.unionByName(found.filter("closed").drop("closed"))
        opened, found = limits.filter("NOT closed").select("query", "kth"), found.filter("NOT closed").drop("closed")
        if opened.isEmpty():
            break
    ranked = Window.partitionBy("query_id").orderBy("distance", "id")
    return (
        queries.select(F.col("id").alias("query_id"), F.col("code").alias("query"))
        .join(answers, "query")
        .join(codes, "code")
        .select("query_id", "distance", F.explode("ids").alias("id"))
        .filter("id != query_id")
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "id", "distance")
    )
