"""Which rank reads which file, in which batch, in which blocks."""

from __future__ import annotations

import os
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorfold.functions.shapes import ceil_div
from tensorfold.operators.indexing import running

PAGE = 4096


def round_robin(files: list[str], world: int, by_name: bool = False) -> dict[int, list[str]]:
    """Files dealt to ranks in turn, in the order given or by base name."""
    files = sorted(files, key=os.path.basename) if by_name else files
    return {r: files[r::world] for r in range(world)}


def batches(files: list[str], world: int) -> list[list[str]]:
    """Chunks of as many files as ranks; the i-th file of a chunk goes to rank i."""
    return [files[i : i + world] for i in range(0, len(files), world)]


def interleave(by_rank: dict[int, list[str]]) -> list[tuple[int, int, str]]:
    """(ordinal, rank, path): a file for each rank, then the next for each."""
    most = max(map(len, by_rank.values()), default=0)
    return [(k, r, by_rank[r][k]) for k in range(most) for r in sorted(by_rank) if k < len(by_rank[r])]


def local_index(by_rank: dict[int, list[str]]) -> dict[str, tuple[int, int]]:
    """path -> (rank, place among the rank's files by path)."""
    return {p: (r, k) for r, paths in by_rank.items() for k, p in enumerate(sorted(paths))}


def tag_bits(n_files: int) -> int:
    return ceil(log2(n_files + 1))


def place(files: DataFrame, key: str, world: int, out: str = "i") -> DataFrame:
    """Adds each file's place in the order of a key, its rank and its ordinal on that rank."""
    return running(files, key, 1, out).withColumns({"rank": F.col(out) % world, "ordinal": F.expr(f"{out} div {world}")})


def rank_totals(files: DataFrame, size: str, world: int, rank: str = "rank") -> DataFrame:
    """(rank, nfiles, nbytes, max_file) of placed files, for each rank that has some."""
    return files.groupBy(F.col(rank).alias("rank")).agg(F.count("*").alias("nfiles"), F.sum(size).alias("nbytes"), F.max(size).alias("max_file")).where(F.col("rank") < world)


def block_ranges(length: Column, block: int) -> Column:
    """An array of (block, off, len) that covers a length; empty for nothing."""
    n = F.ceil(length / block).cast("bigint")
    steps = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(steps, lambda k: F.struct(k.alias("block"), (k * block).alias("off"), F.least(F.lit(block).cast("bigint"), length - k * block).alias("len")))


def aligned_window(off: Column, length: Column, page: int = PAGE) -> dict[str, Column]:
    """The page-aligned window around a byte range: bytes before it, after it and in all."""
    head = off % page
    tail = F.pmod(-(length + head), F.lit(page))
    return {"head": head, "tail": tail, "aligned_len": length + head + tail}


def block_size(sizes: list[int], threads: int, world: int, buffer: int) -> int:
    """Bytes a block: the largest file where files outnumber threads, else an even share in whole buffers."""
    if not sizes or len(sizes) >= threads:
        return max(sizes, default=0)
    share = sum(sizes) // max(1, world) // max(1, threads)
    return ceil_div(share, buffer) * buffer


def thread_buffer_kib(buffer_kib: int, threads: int) -> int:
    return ceil_div(buffer_kib, threads)


def batches_in_memory(queue_size: int) -> int:
    """How many batches a pipeline holds at once: -1 means one, 0 two, more one besides the queue."""
    return 1 if queue_size < 0 else queue_size + 1 if queue_size else 2
