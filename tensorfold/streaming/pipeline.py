"""Batches of files as a stream: one micro-batch a batch of files, in list order.

Offsets are batch numbers, so a restarted query goes on after the last committed batch; Spark holds a batch at a time.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorfold.plans.config import Config, load_config, logger, source
from tensorfold.plans.placement import batches_in_memory
from tensorfold.sources.archive import discover, read_stream


@contextmanager
def timed(what: str, threshold_ms: float = 0.0):
    """Logs how long a block took, if it took at least the threshold."""
    began = time.perf_counter()
    yield
    if (ms := (time.perf_counter() - began) * 1e3) >= threshold_ms:
        logger().debug("%s took %.1f ms", what, ms)


def for_each_batch(spark: SparkSession, paths: str | list[str], handle: Callable[[DataFrame, int], None], checkpoint: str, world_size: int = 1) -> None:
    """Calls ``handle(tensors, batch)`` for every batch of files in order, and returns after the last."""
    n = -(-len(discover(paths)) // world_size)
    done = {"n": 0}

    def one(df: DataFrame, epoch: int) -> None:
        with timed(f"batch {epoch}"):
            handle(df, epoch)
        done["n"] = epoch + 1

    query = read_stream(spark, paths, world_size).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
    try:
        while done["n"] < n and query.isActive:
            query.processAllAvailable()
        if query.exception():
            raise query.exception()
    finally:
        query.stop()


def batch_metrics(tensors: DataFrame) -> DataFrame:
    """(batch, rank, files, tensors, nbytes) of streamed or placed tensors."""
    return tensors.groupBy("batch", "rank").agg(F.countDistinct("path").alias("files"), F.count("*").alias("tensors"), F.sum(F.octet_length("payload")).alias("nbytes"))


Tensor = tuple[int, str, str, list[int], bytes]


def _batch(spark: SparkSession, k: int, group: list[str], config: Config) -> Iterator[Tensor]:
    """A batch's tensors in the order of its files and of each file, a partition at a time: blocks come in that order, so nothing is sorted."""
    last, parts = None, []
    for r in source(config.source)(spark, group, config).toLocalIterator():
        if last is not None and (r["path"], r["name"]) != (last["path"], last["name"]):
            yield k, last["name"], last["dtype"], list(last["shape"]), b"".join(parts)
            parts = []
        parts.append(bytes(r["payload"]))
        last = r
    if last is not None:
        yield k, last["name"], last["dtype"], list(last["shape"]), b"".join(parts)


def iterate(spark: SparkSession, paths: str | list[str], world_size: int = 1, config: Config | None = None) -> Iterator[Tensor]:
    """(batch, name, dtype, shape, bytes) of every tensor, by batch, rank and place in the file, on the driver.

    With the pipeline on, a thread loads batches ahead: ``batches_in_memory(queue_size)`` of them are held at once. Without it a
    partition is held at a time.
    """
    files = discover(paths)
    config = config or load_config()
    groups = [files[k : k + world_size] for k in range(0, len(files), world_size)]
    if config.pipeline_options()["queue_size"] < 0:
        for k, group in enumerate(groups):
            yield from _batch(spark, k, group, config)
            progress(k + 1, len(groups), config)
        return
    ready: queue.Queue = queue.Queue(max(1, batches_in_memory(config.queue_size) - 1))
    stop = threading.Event()

    def put(item) -> bool:
        while not stop.is_set():
            try:
                ready.put(item, timeout=0.2)
                return True
            except queue.Full:
                continue
        return False

    def load():
        try:
            for k, group in enumerate(groups):
                if not put(list(_batch(spark, k, group, config))):
                    return
            put(None)
        except BaseException as e:  # the consumer raises it
            put(e)

    worker = threading.Thread(target=load, daemon=True, name="tensorfold-producer")
    worker.start()
    try:
        done = 0
        while (got := ready.get()) is not None:
            if isinstance(got, BaseException):
                raise got
            yield from got
            progress(done := done + 1, len(groups), config)
    finally:
        stop.set()
        worker.join()


def progress(done: int, total: int, config: Config) -> None:
    """A line for each batch on the driver, which alone speaks for all ranks, if the configuration wants it."""
    if config.show_progress:
        logger(config).info("%3d%% | %d of %d batches", 100 * done // max(total, 1), done, total)


def stamp(seconds: float) -> str:
    """Seconds since 1970 as local time with milliseconds."""
    return time.strftime("%Y-%m-%d %H:%M:%S", time.localtime(seconds)) + f".{int(seconds % 1 * 1000):03d}"


def stamp_of(seconds: Column) -> Column:
    """The same as a column, in the session's time zone."""
    return F.date_format(F.timestamp_millis(F.floor(seconds * 1000).cast("bigint")), "yyyy-MM-dd HH:mm:ss.SSS")


def bandwidth(timings: DataFrame, rank: str, begin: str, end: str, nbytes: str, by: list[str] | None = None) -> DataFrame:
    """First begin, last end, bytes, ranks and GiB a second: of all ranks, or of each group. Begin and end are in seconds."""
    gib = F.col("nbytes") / (1 << 30) / (F.col("t1") - F.col("t0"))
    return timings.groupBy(*(by or [])).agg(F.min(begin).alias("t0"), F.max(end).alias("t1"), F.sum(nbytes).alias("nbytes"), F.countDistinct(rank).alias("ranks")).withColumn("gib_s", F.when(F.col("t1") > F.col("t0"), gib))
