"""Places in a global order without sending all rows to one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, key: str, amount: Column | int = 1, out: str = "pos", buckets: int | None = None) -> DataFrame:
    """Adds, for each row, the sum of ``amount`` over all rows with a smaller key (a unique, sortable column of numbers).

    Rows are dealt to ranges of the key; the ranges' totals (one row each, so bounded by ``buckets``) are summed and joined
    back, and within a range a window counts on. One shuffle of the rows; nulls in the key come first, as one range.
    """
    n = buckets or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10_000)).first()[0] or []
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else None
    bucket = F.lit(0) if cuts is None else F.coalesce(F.size(F.filter(cuts, lambda c: c < F.col(key))), F.lit(-1))
    dealt = df.withColumn("__bucket", bucket).withColumn("__amount", F.lit(amount).cast("bigint"))
    totals = dealt.groupBy("__bucket").agg(F.sum("__amount").alias("__total"))
    before = totals.select(F.col("__bucket"), (F.sum("__total").over(Window.orderBy("__bucket")) - F.col("__total")).alias("__before"))
    inside = F.sum("__amount").over(Window.partitionBy("__bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__amount")
    placed = dealt.withColumn("__inside", inside).join(F.broadcast(before), "__bucket")
    return placed.withColumn(out, F.col("__before") + F.col("__inside")).drop("__bucket", "__amount", "__inside", "__before")


def numbered(df: DataFrame, out: str = "pos") -> tuple[DataFrame, int]:
    """Adds each row's place in the order of the frame's partitions and of the rows in them, and tells the count of rows.

    Nothing is shuffled: a first pass counts the partitions' rows (a number each on the driver), so the frame must deal its rows alike twice, as a scan of files does.
    """
    counts = dict(df.groupBy(F.spark_partition_id()).count().collect())
    before = [0, *accumulate(counts.get(p, 0) for p in range(max(counts, default=0) + 1))]
    key = F.monotonically_increasing_id()
    return df.withColumn("__key", key).withColumn(out, F.lit(before)[F.shiftright("__key", 33).cast("int")] + F.col("__key").bitwiseAND((1 << 33) - 1)).drop("__key"), before[-1]


def ranks(spark, world: int) -> DataFrame:
    return spark.range(world).withColumnRenamed("id", "rank")
