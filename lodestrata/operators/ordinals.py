"""Row numbers and running sums without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def ranged(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """The rows in ranges of ``order``, written once, with the range's number in ``__range``; without ``ranges``, Spark's number of shuffle partitions at most."""
    from lodestrata.sources import storage

    path = storage.scratch(df.sparkSession, "ordinals")
    made = df.repartitionByRange(*((ranges,) if ranges else ()), *order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id())
    made.write.parquet(path)
    return df.sparkSession.read.schema(made.schema).parquet(path)


def _before(sums: DataFrame, order: list[str], value: str, out: str, ranges: int | None = None) -> DataFrame:
    """Exclusive running sum of ``value`` over all rows in ``order``: sorted ranges, written once, and the totals of the ranges before each."""
    held = ranged(sums, order, ranges)
    # one row for each range
    totals = held.groupBy("__range").agg(F.sum(value).alias("__total"))
    starts = totals.select("__range", (F.sum("__total").over(Window.orderBy("__range")) - F.col("__total")).alias("__start"))
    if ranges:
        held = held.repartitionById(ranges, "__range")
    # by rows, so that equal keys have places of their own
    inner = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return held.join(F.broadcast(starts), "__range").withColumn(out, F.col("__start") + F.sum(value).over(inner) - F.col(value)).drop("__range", "__start")


def running_sum(df: DataFrame, value: str, out: str, order: list[str | Column], partition: list[str], chunk: Column) -> DataFrame:
    """Exclusive running sum of ``value`` over ``order`` within ``partition``, by sums of chunks first.

    ``chunk`` must not decrease along the order and should hold a bounded number of
    rows. Chunks are summed over ranges of them, so that neither a chunk's rows nor all
    chunks of a partition meet in one task.
    """
    keyed = df.withColumn("__chunk", chunk)
    sums = keyed.groupBy(*partition, "__chunk").agg(F.sum(value).alias("__sum"))
    before = _before(sums, [*partition, "__chunk"], "__sum", "__at")
    if partition:
        # a partition's own sums begin at its first chunk
        first = before.groupBy(*partition).agg(F.min_by("__at", "__chunk").alias("__base")).toDF(*(f"__p{i}" for i in range(len(partition))), "__base")
        same = F.lit(True)
        for i, c in enumerate(partition):
            same = same & F.col(c).eqNullSafe(F.col(f"__p{i}"))
        before = before.join(first, same).withColumn("__at", F.col("__at") - F.col("__base")).drop("__base", *(f"__p{i}" for i in range(len(partition))))
    before = before.drop("__sum").toDF(*(f"__q{i}" for i in range(len(partition))), "__chunk_of", "__at")
    same = F.col("__chunk") == F.col("__chunk_of")
    for i, c in enumerate(partition):
        same = same & F.col(c).eqNullSafe(F.col(f"__q{i}"))
    inner = Window.partitionBy(*partition, "__chunk").orderBy(*order)
    joined = keyed.join(before, same)
    return joined.withColumn(out, F.col("__at") + F.sum(value).over(inner) - F.col(value)).drop("__chunk", "__at", "__chunk_of", *(f"__q{i}" for i in range(len(partition))))


def with_ordinal(df: DataFrame, out: str, file: str, at: str) -> DataFrame:
    """Number rows from 0 by (file, at), ``at`` being an increasing 64-bit row mark."""
    one = df.withColumn("__one", F.lit(1).cast("long"))
    marked = one.withColumn("__c", F.struct(F.col(file), F.expr(f"{at} div {CHUNK}")))
    return running_sum(marked, "__one", out, [file, at], [], F.col("__c")).drop("__one", "__c")


def numbered(df: DataFrame, order: list[str], out: str, ranges: int | None = None) -> DataFrame:
    """Number rows from 0 in ``order``, by sorted ranges."""
    return _before(df.withColumn("__one", F.lit(1).cast("long")), order, "__one", out, ranges).drop("__one")
