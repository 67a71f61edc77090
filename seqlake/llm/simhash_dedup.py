"""Near duplicates by 64-bit SimHash and covering locality-sensitive hashing.

Each bit position carries a nonzero vector of radius + 1 bits. For every nonzero vector v there is a
table, and its mask keeps the positions whose vector has an odd inner product with v. Positions that
two fingerprints differ in give at most ``radius`` equations on v, so some nonzero v solves them: any
pair within the radius agrees on at least one mask. Nothing is missed.

Inside a bucket two fingerprints differ outside the mask only. No pairs are formed: for radius 2 each
fingerprint names itself and its one-bit variants outside the mask, and whoever names the same variant
is within two bits. Rows grow with the fingerprints, not with the square of a bucket.

Defined cases: null, empty or blank text has fingerprint zero, linked like any other; texts of one or
two words are one shingle; equal texts and repeated rows share a fingerprint; a row without doc_id gets
its fingerprint, and the component of it (null if no row with an id is in it); further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import slices, stored
from seqlake.llm.components import components

BITS = 64
SHINGLE = 3
SEED = 42
# Shingles whose bits are counted at a time.
_BLOCK = 1 << 17


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``size`` words of the text, A-Z in lower case."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(tokens) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, len(tokens) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), _BLOCK):
        block = hashes[start : start + _BLOCK].astype("<u8")
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    if not len(hashes):
        return 0
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the signed 64-bit ``print`` of every row."""

    def work(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                prints = [fingerprint(shingle_hashes(text)) for text in batch.column("text").to_pylist()]
                signed = np.array(prints, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(signed)], names=["doc_id", "print"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id bigint, print bigint")


def covering_masks(radius: int = 2) -> list[int]:
    """The 2^(radius + 1) - 1 masks, as signed 64-bit numbers."""
    vectors = 1 << (radius + 1)
    masks = []
    for v in range(1, vectors):
        mask = sum(1 << bit for bit in range(BITS) if bin((bit % (vectors - 1) + 1) & v).count("1") % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _one_bits(mask: int) -> list[int]:
    """Zero, and each single bit outside the mask, as signed numbers."""
    bits = [1 << bit for bit in range(BITS) if not mask >> bit & 1]
    return [0] + [bit - (1 << 64) if bit >> 63 else bit for bit in bits]


def near_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join all distinct ``print`` values within two bits of each other."""
    masks = covering_masks(2)
    tables = F.array(*[
        F.struct(F.lit(number).alias("table"), F.col("print").bitwiseAND(F.lit(mask)).alias("bucket"))
        for number, mask in enumerate(masks)
    ])
    placed = prints.select("print", F.explode(tables).alias("x")).select("print", "x.table", "x.bucket")
    # Buckets of one fingerprint link nothing.
    crowded = placed.groupBy("table", "bucket").agg(F.min("print").alias("low"), F.max("print").alias("high"))
    crowded = crowded.filter("low < high").select("table", "bucket")
    flips = F.array(*[F.array(*[F.lit(bit) for bit in _one_bits(mask)]) for mask in masks])
    named = (
        placed.join(crowded, ["table", "bucket"])
        .select("print", F.explode(F.element_at(flips, F.col("table") + 1)).alias("flip"))
        .select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("variant"))
        .distinct()
    )
    least = named.groupBy("variant").agg(F.min("print").alias("b"), F.max("print").alias("c")).filter("b < c")
    return named.join(least, "variant").filter("print > b").select(F.col("print").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row."""
    rows = stored(fingerprints(docs), "prints")
    distinct = stored(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    groups = components(near_links(distinct.select("print")))
    labelled = distinct.join(groups, distinct["print"] == groups["node"], "left").select(
        "print", "least", F.coalesce("component", "print").alias("component")
    )
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = labelled.join(ids, "component").select("print", "component_id")
    return rows.join(named, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one row of each group: one with the smallest doc_id.

    Rows without doc_id stay.
    """
    groups = near_duplicates(docs)
    first = groups.filter("doc_id = component_id").select("doc_id").distinct()
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{name}`") for name in names]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"))
    kept = rows.filter("doc_id IS NOT NULL").join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(rows.filter("doc_id IS NULL")).select("row.*")
