"""Exact positions in any order, without a task that holds a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.sources.shared import new_folder


def with_ordinal(df: DataFrame, key: str, order: list[str | Column], rank: str) -> DataFrame:
    """Append ``rank``, 1-based by ``order`` within ``key`` (never null).

    Rows are dealt into ranges of (key, order) at splitters that Spark samples, so ranges are even whatever the values are; each range is ranked by itself and shifted by the
    rows of its key in the ranges before it. The ranges are written to the shared folder, as splitters would be sampled anew in each run over them. Ties
    come in any order, but each has a position of its own.
    """
    spark, own = df.sparkSession, df.columns
    by = [o if isinstance(o, Column) else F.col(o) for o in order]
    names = [f"__by{i}" for i in range(len(by))]
    keyed = df.withColumns(dict(zip(names, by, strict=True))).withColumn("__tie", F.xxhash64(F.monotonically_increasing_id()))
    path = new_folder(spark, "ranges")
    keyed.repartitionByRange(key, *names, "__tie").withColumn("__range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(key, "__range").agg(F.count(F.lit(1)).alias("__n")).select(key, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(key, "__range").orderBy(*names, "__tie"))
    return dealt.withColumn("__in", inside).join(starts, [key, "__range"]).select(*own, (F.col("__start") + F.col("__in")).alias(rank))
