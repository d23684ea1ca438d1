"""Steps that several operators share: written intermediate tables, connected components, bounded filters."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import uuid
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorfold.plans.workspace import workspace

#: Stands in for a null id, after all others.
LAST_ID = (1 << 63) - 1


#: Paths of tables written since the last scratch began, by scratch.
_made: list[list[str]] = []


def written(df: DataFrame, what: str = "step") -> DataFrame:
    """The rows as a Parquet table in the workspace, read again: it cuts the lineage and survives lost executors.

    Shuffle files of what led there are let go once nothing on the driver refers to them.
    """
    spark = df.sparkSession
    path = f"{workspace(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    for made in _made:
        made.append(path)
    del df
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Has the driver drop plans that nothing refers to, and with them their shuffle files: else these stay on the executors' disks until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing lazy reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.written_path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes, at its end, every table written within, but for those whose path is added to the set it gives."""
    kept: set[str] = set()
    made: list[str] = []
    _made.append(made)
    try:
        yield kept
    finally:
        _made.remove(made)
        for path in made:
            if path not in kept:
                _delete(spark, path)


def batched(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of an Arrow batch, so that long texts don't fill a worker's memory; a bound that the session was given stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = spark.conf.get(key, None)
    if now is None or now in _bounds.get(spark.sparkContext.applicationId, ()):
        spark.conf.set(key, rows)
        _bounds.setdefault(spark.sparkContext.applicationId, set()).add(str(rows))


_bounds: dict[str, set[str]] = {}


def lean(function):
    """A function of Arrow batches that gives freed memory back at its end: the next stage's tasks run in the same workers."""

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return run


def identified(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc, fp, text, ...): an id without nulls and the text's fingerprint, which together name a row; rows alike in both are alike in all that is computed from them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("fp"), text.alias("text"), *keep)


def original_id(doc: Column) -> Column:
    return F.when(doc != LAST_ID, doc)


def joined_left(rows: DataFrame, small: DataFrame, key: str, entries: int, most: int, *deal_by: str, salts: int = 16) -> DataFrame:
    """Rows with the columns of a table that has one row for each key. The table is broadcast while it has at most ``most`` entries; beyond
    that both are dealt by key and salt, so that a key with very many rows is ``salts`` tasks' work, and Spark splits those further."""
    if entries <= most:
        return rows.join(F.broadcast(small), key, "left")
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(*deal_by), F.lit(salts)).cast("int"))
    return dealt.join(salted.hint("merge"), [key, "__salt"], "left").drop("__salt")


LINKS_A_TASK = 200_000


def _stars(batches):
    """Each node of a task's links with the smallest one that they lead to, but for that one."""
    parent: dict[int, int] = {}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    nodes = sorted(x for x in parent if parent[x] != x)
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that links lead to, for every node of a link between different nodes but that smallest one.

    Links are dealt to tasks of about ``LINKS_A_TASK``, and each leaves a star for each of its own components. Where one task holds all, that is the
    answer. Else alternating large-star and small-star steps (Kiveris et al., 2014) over written tables; each step is a map-side
    combined minimum by node and a join, so a node with very many links is split, not gathered.
    """
    spark = edges.sparkSession
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = written(e, "links")
    n = ceil(e.count() / LINKS_A_TASK)
    if n <= 1:
        return written(e.coalesce(1).mapInArrow(_stars, "u bigint, v bigint"), "links").select(F.col("u").alias("node"), F.col("v").alias("component"))
    e = written(e.repartition(n, "u", "v").mapInArrow(_stars, "u bigint, v bigint").distinct(), "links")
    last = old = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.least("m", "k").alias("v"))
        tops = both.groupBy("u").agg(F.min("v").alias("v")).where("v < u")
        e = large.unionByName(tops).distinct()
        low = e.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = e.join(low, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = written(small.where("u <> v").distinct(), "links")
        if old is not None:
            discard(old)
        old = e
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        last = now


class BitFilter:
    """A Bloom filter of fixed size over 64-bit hashes. False positives only; when full it passes everything and the exact join after it decides alone."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(h: np.ndarray, n_bits: int) -> list[np.ndarray]:
        h = h.view(np.uint64)
        return [((h >> np.uint64(s)) & np.uint64(n_bits - 1)).astype(np.int64) for s in (0, 30)]

    def passes(self, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for p in self.places(h, len(self.words) * 64):
            ok &= (self.words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
        return ok

    @classmethod
    def of(cls, hashes: DataFrame, column: str, n_bits: int = 1 << 26) -> BitFilter:
        """Bits are set by tasks and joined by word, so the driver gets ``n_bits / 64`` longs at most (8 MB by default), whatever the input."""

        def bits(batches):
            own = np.zeros(n_bits // 64, np.uint64)
            for b in batches:
                for p in cls.places(b.column(0).to_numpy(zero_copy_only=False), n_bits):
                    np.bitwise_or.at(own, p >> 6, np.uint64(1) << (p & 63).astype(np.uint64))
            at = np.flatnonzero(own)
            for i in range(0, len(at), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 50_000]), pa.array(own[at[i : i + 50_000]].view(np.int64))], names=["word", "bits"])

        found = hashes.select(column).mapInArrow(bits, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
        words = np.zeros(n_bits // 64, np.uint64)
        got = found.toArrow()
        words[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
        return cls(words)
