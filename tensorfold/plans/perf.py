"""Measures of loading: by Spark's tasks, and by memory maps of the same files as the baseline."""

from __future__ import annotations

import os
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tensorfold.functions.shapes import shard_bounds
from tensorfold.operators.catalog import dim_rule
from tensorfold.sources.archive import discover, header_of, read_blocks

TIMINGS = "rank bigint, t0 double, t1 double, nbytes bigint"


def metered(blocks: DataFrame, name: str = "read") -> tuple[DataFrame, Observation]:
    """The same blocks with a gauge: after an action, the bytes and blocks that passed and the largest block, which bounds a task's buffer."""
    seen = Observation(name)
    size = F.octet_length("payload")
    return blocks.observe(seen, F.coalesce(F.sum(size), F.lit(0)).alias("nbytes"), F.count("*").alias("blocks"), F.coalesce(F.max(size), F.lit(0)).alias("largest")), seen


def read_timings(spark: SparkSession, paths: str | list[str], world: int = 1, block_bytes: int = 16 << 20) -> DataFrame:
    """(rank, t0, t1, nbytes) of each partition of an archive read; the bytes are summed up where they are read. Files go to ranks in turn."""
    files = discover(paths)
    where = spark.createDataFrame([(p, k % world) for k, p in enumerate(files)], "path string, rank bigint")

    def run(batches):
        seen: dict[str, list] = {}
        for b in batches:
            now = time.time()
            for path, payload in zip(b.column("path").to_pylist(), b.column("payload"), strict=True):
                own = seen.setdefault(path, [now, now, 0])
                own[1], own[2] = time.time(), own[2] + payload.as_buffer().size
        yield pa.RecordBatch.from_pylist([{"path": p, "t0": a, "t1": z, "nbytes": n} for p, (a, z, n) in seen.items()], pa.schema([("path", pa.string()), ("t0", pa.float64()), ("t1", pa.float64()), ("nbytes", pa.int64())]))

    read = read_blocks(spark, files, block_bytes=block_bytes).mapInArrow(run, "path string, t0 double, t1 double, nbytes bigint")
    return read.join(where, "path").select("rank", "t0", "t1", "nbytes")


def mapped_shard(path: str, rank: int, world: int, dims: dict[str, int]) -> int:
    """Bytes of a rank's parts of a file's tensors, each copied out of a memory map; tensors without a dimension go whole."""
    h = header_of(path)
    data = np.memmap(path, np.uint8, "r")
    total = 0
    for x in h.entries:
        raw = data[h.header_length + x.start : h.header_length + x.end]
        dim = dims.get(x.name, -1)
        if dim >= 0 and x.nelem:
            lo, hi = shard_bounds(x.shape[dim], world)[rank]
            outer = int(np.prod(x.shape[:dim]))
            below = x.nbytes // outer // x.shape[dim] if x.nbytes % (outer * x.shape[dim]) == 0 else 0
            raw = raw.reshape(outer, x.shape[dim], below)[:, lo:hi] if below else raw
        total += np.array(raw).size
    return total


def mapped_timings(spark: SparkSession, paths: str | list[str], world: int = 1, rules: list[tuple[str, int]] | None = None) -> DataFrame:
    """(rank, t0, t1, nbytes) of the memory-map baseline, a task a rank: every rank copies its part of every file's tensors."""
    files = discover(paths)
    names = [(p, x.name) for p in files for x in header_of(p).entries]
    found = spark.createDataFrame(names or [("", "")], "path string, name string").withColumn("dim", dim_rule(F.col("name"), rules or []))
    dims: dict[str, dict[str, int]] = {}
    for r in found.collect():
        dims.setdefault(r["path"], {})[r["name"]] = r["dim"]

    def run(batches):
        for b in batches:
            for rank in b.column(0).to_pylist():
                t0 = time.time()
                n = sum(mapped_shard(p, rank, world, dims[p]) for p in files)
                yield pa.RecordBatch.from_pylist([{"rank": rank, "t0": t0, "t1": time.time(), "nbytes": n}], pa.schema([("rank", pa.int64()), ("t0", pa.float64()), ("t1", pa.float64()), ("nbytes", pa.int64())]))

    return spark.range(0, world, 1, world).mapInArrow(run, TIMINGS)


def drop_cache(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, nbytes) of the distinct files behind the paths; the machines that tasks run on are asked to forget their pages."""
    files = sorted({os.path.realpath(p) for p in discover(paths)})

    def run(batches):
        for b in batches:
            sizes = []
            for p in b.column(0).to_pylist():
                fd = os.open(p, os.O_RDONLY)
                try:
                    sizes.append(os.fstat(fd).st_size)
                    if hasattr(os, "posix_fadvise"):
                        os.posix_fadvise(fd, 0, 0, os.POSIX_FADV_DONTNEED)
                finally:
                    os.close(fd)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["path", "nbytes"])

    return spark.createDataFrame([(p,) for p in files], "path string").mapInArrow(run, "path string, nbytes bigint")
