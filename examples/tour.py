"""The engine in four short runs: one process, two ranks, a session used again, and iteration by configuration. `python examples/tour.py` prints what each gives."""

from __future__ import annotations

import sys
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tensorfold.operators import tensors as T
from tensorfold.plans.config import Config
from tensorfold.plans.session import open_tensors
from tensorfold.sources.archive import discover, write_archive
from tensorfold.streaming.pipeline import iterate


def samples(spark: SparkSession, folder: str) -> list[str]:
    """Two archives, a and b, of one F16 [16, 8] tensor each whose row i is filled with i."""
    rows = spark.range(16).select(F.col("id").alias("i"), F.array_repeat(F.col("id").cast("double"), 8).alias("v"))
    for x in "ab":
        write_archive(T.pack_vectors(rows, f"{x}0", "i", "v", 8, 16, "F16"), f"{folder}/{x}", 1, {"sample": x}, "overwrite")
    return [f"{folder}/a", f"{folder}/b"]


def single(spark: SparkSession, paths: list[str]) -> float:
    """The sum of a tensor's values."""
    with open_tensors(spark, paths) as t:
        return t.tensor("a0").agg(F.sum("value")).first()[0]


def parallel(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """On two ranks: the first tensor whole on each, the second one's columns dealt."""
    t = open_tensors(spark, paths, world_size=2)
    return t.sharded("a0", -1), t.sharded("b0", 1)


def reuse(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """The names of one file's tensors, then of another's, in the same session."""
    out = []
    with open_tensors(spark, paths[0]) as t:
        out.append(t.keys())
        t.reset({0: discover(paths[1])})
        out.append(t.keys())
    return out


def by_configuration(spark: SparkSession, paths: list[str]) -> list[tuple[int, str, int]]:
    """(batch, name, bytes) of all tensors, a file a batch, the next one loaded while this one is looked at."""
    return [(k, name, len(raw)) for k, name, _, _, raw in iterate(spark, paths, 1, Config(queue_size=1, show_progress=False))]


if __name__ == "__main__":
    session = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
    with tempfile.TemporaryDirectory() as top:
        made = samples(session, top)
        print(single(session, made), [x.groupBy("rank").count().collect() for x in parallel(session, made)], reuse(session, made), by_configuration(session, made))
