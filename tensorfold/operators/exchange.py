"""Shards, copies and pushes as a ``rank`` column; concatenation within and across ranks.

A rank is a label. Rows move only where a caller groups by it or asks for :func:`colocate`.
"""

from __future__ import annotations

from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorfold.errors import DimMismatch
from tensorfold.functions.shapes import ceil_div
from tensorfold.operators.indexing import ranks


def shard(df: DataFrame, index: Column, size: int | Column, world: int) -> DataFrame:
    """Adds the rank that holds a place of the sharded dimension: blocks of ceil(size / world)."""
    block = F.lit(ceil_div(size, world)) if isinstance(size, int) else F.ceil(size / world)
    return df.withColumn("rank", F.lit(0).cast("bigint") if world == 1 else F.floor(index / F.greatest(block, F.lit(1))).cast("bigint"))


def shard_ranges(spark, size: int, world: int) -> DataFrame:
    """(rank, lo, hi) with hi excluded; ranks past the end have empty ranges."""
    block = ceil_div(size, world)
    r = ranks(spark, world)
    return r.select("rank", F.least(F.col("rank") * block, F.lit(size)).alias("lo"), F.least((F.col("rank") + 1) * block, F.lit(size)).alias("hi"))


def slice_vector(vec: Column, size: int, world: int) -> Column:
    """Of a row's vector, an array with each rank's (rank, elements) along the last dimension."""
    block = ceil_div(size, world)
    return F.array(*[F.struct(F.lit(r).cast("bigint").alias("rank"), F.slice(vec, r * block + 1, block).alias("part")) for r in range(world)])


def broadcast(df: DataFrame, world: int) -> DataFrame:
    """Every row on every rank; the rows are expanded in place, without an exchange."""
    return df.withColumn("rank", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(world - 1).cast("bigint"))))


def push(df: DataFrame, dst: Column, world: int) -> DataFrame:
    """The rows on their destination only."""
    return df.withColumn("rank", F.lit(0).cast("bigint") if world == 1 else dst.cast("bigint"))


def per_rank(df: DataFrame, world: int, *aggs: Column, fill: dict | None = None) -> DataFrame:
    """Aggregates by rank, with a row for each rank, also the empty ones."""
    out = ranks(df.sparkSession, world).join(df.groupBy("rank").agg(*aggs), "rank", "left")
    return out.fillna(fill) if fill else out


def concat(parts: list[DataFrame]) -> DataFrame:
    """Rows of tensors one after another: ``part`` is the tensor's place in the list, ``i`` the row's place in the tensor."""
    return reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(k).cast("bigint")) for k, p in enumerate(parts)])


def require_same_extents(shapes: list[list[int]], dim: int) -> None:
    rest = {tuple(n for d, n in enumerate(s) if d != dim) for s in shapes}
    if len(rest) > 1:
        raise DimMismatch(f"extents besides dimension {dim} differ: {sorted(rest)}")


def multi_cols(parts: list[tuple[DataFrame, int]], world: int) -> DataFrame:
    """Each tensor sharded, then joined within the rank: rank r holds its part of the first, then of the second, and so on.

    ``parts`` are (rows with their place ``i``, extent). The place in the rank follows from the extents alone, so nothing is sorted.
    """
    out, blocks = [], [ceil_div(n, world) for _, n in parts]
    for k, (df, n) in enumerate(parts):
        df = shard(df, F.col("i"), n, world)
        before = [F.least(F.greatest(F.lit(m) - F.col("rank") * b, F.lit(0)), F.lit(b)) for (_, m), b in zip(parts[:k], blocks, strict=False)]
        out.append(df.withColumn("pos", sum(before, F.lit(0)).cast("bigint") + F.col("i") - F.col("rank") * blocks[k]))
    return concat(out)


def joined(parts: list[tuple[DataFrame, list[int]]], dim: int, world: int = 1) -> DataFrame:
    """Element rows of n-d tensors, each sharded along ``dim`` and joined along it within the rank.

    ``parts`` are (element rows with their place ``pos``, shape). Rank and place in the rank's joined tensor follow from the extents by arithmetic, so nothing
    moves. With one rank this is concatenation along any dimension.
    """
    require_same_extents([s for _, s in parts], dim)
    blocks = [ceil_div(s[dim], world) for _, s in parts]
    rank = F.col("rank")
    widths = [F.least(F.greatest(F.lit(s[dim]) - rank * b, F.lit(0)), F.lit(b)) for (_, s), b in zip(parts, blocks, strict=True)]
    whole, out, before = sum(widths, F.lit(0)), [], F.lit(0)
    for (df, shape), block, width in zip(parts, blocks, widths, strict=True):
        n, inner = shape[dim], max(1, prod(shape[dim + 1 :]))
        at = F.pmod(F.expr(f"pos div {inner}"), F.lit(n))
        placed = df.withColumn("rank", F.lit(0).cast("bigint") if world == 1 else F.floor(at / block).cast("bigint"))
        place = (F.expr(f"pos div {n * inner}") * whole + before + at - rank * block) * inner + F.expr(f"pos % {inner}")
        out.append(placed.withColumn("pos", place.cast("bigint")))
        before = before + width
    return concat(out)


def colocate(df: DataFrame, world: int) -> DataFrame:
    """Rows of a rank in the same partition, for a consumer that works rank by rank."""
    return df.repartition(world, "rank")
