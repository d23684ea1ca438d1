"""Shards by jump consistent hashing (Lamping and Veach, 2014): the id and the number of shards decide, without a table.

A document's key is its doc_id, hashed; when one shard is appended, only rows that move into it change place. Slots number a
shard's rows without gaps: rows are dealt to chunks of about ``CHUNK_ROWS`` by hash, counted by shard and chunk, and numbered within the chunk
after the chunks before it, so no task holds a whole shard.

Contract. A null text has size 16 and the checksum of no bytes; a null doc_id is a key like any other. Rows with equal doc_ids share a
shard; rows alike in id, checksum and size stand in any order there. A text of any length is measured whole. Other columns pass through ``write``. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorfold.llm.frames import written

SHARDS = 40
OVERHEAD = 16
CHUNK_ROWS = 100_000
FILE_BYTES = 512 << 20
# Fixed values of the published algorithm.
MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Each 64-bit key's shard. All keys jump at once, until the last has passed the end."""
    key = keys.view(np.uint64).copy()
    place, at = np.zeros(len(key), np.int64), np.arange(len(key))
    while len(at):
        key = key * MULTIPLIER + np.uint64(1)
        ahead = ((place[at] + 1) * (float(1 << 31) / ((key >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        on = ahead < shards
        at, key = at[on], key[on]
        place[at] = ahead[on]
    return place


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64), shards).astype(np.int32))

    return place(key)


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(raw) + OVERHEAD).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    key = F.xxhash64("doc_id")
    rows = written(rows.withColumn("shard", shard_of(key, shards)).withColumn("grown_shard", shard_of(key, shards + 1)), "shards")
    chunks = max(1, -(-rows.count() // (shards * CHUNK_ROWS)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit(1)), F.lit(chunks)))
    counts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("shard", "chunk", (F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size")) - 1
    numbered = rows.withColumn("inside", inside).join(before, ["shard", "chunk"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("inside")).cast("bigint").alias("slot"), "grown_shard")


def free_name(docs: DataFrame, name: str) -> str:
    """The name, with underscores after it while a column of the table has it (in any case of letters)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def write(docs: DataFrame, path: str, shards: int = SHARDS, files_per_shard: int | None = None) -> str:
    """The rows as Parquet files, a folder a shard; a shard's rows are spread over its files by id and text, by default one for each ``FILE_BYTES`` of texts.

    Returns the name of the folders' column: ``shard``, or a free one if the table has a column of that name, which is written as it is.
    """
    if files_per_shard is None:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("bigint") + OVERHEAD)).first()[0] or 0
        files_per_shard = max(1, -(-size // (shards * FILE_BYTES)))
    name = free_name(docs, "shard")
    placed = docs.withColumn(name, shard_of(F.xxhash64(F.col("doc_id").cast("bigint")), shards))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(files_per_shard))
    placed.repartition(shards * files_per_shard, name, part).write.partitionBy(name).parquet(path)
    return name
