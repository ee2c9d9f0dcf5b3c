"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import cut, look_up


def components(edges: DataFrame, rows: int, plain: int = 1_000_000) -> DataFrame:
    """``(node, component)`` for each node of the undirected ``edges`` (a, b); component is the smallest node reachable.

    Every round makes each node point at the smallest neighbour it knows and
    hooks its other neighbours there; neighbours are only ever reduced to a
    minimum, never gathered. ``rows`` is a bound on the edges. With over ``plain`` edges, where a task could have too much to read, the neighbours of a node of very many are dealt over copies of it. The edge table is checkpointed after each round,
    and rounds grow with the logarithm of the longest path: each but the last lowers some node's minimum, so they end. Loops (a = b) and
    repeated edges change nothing; without edges the result is empty.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows)

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(now)
    if not before[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        rows = 2 * before[0]
        salted = before[0] > plain

        def meet(rows: DataFrame, least: DataFrame) -> DataFrame:
            return look_up(rows, least, ["a"], "n", 2 * before[0]) if salted else rows.join(least, "a")  # noqa: B023 (used in this round only)

        both = now.union(now.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("a", "m"))
        least = cut(least, rows) if salted else least
        large = meet(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # each node also keeps its own minimum
        large = large.union(least.filter("m <> a").select("a", F.col("m").alias("b"))).distinct()
        large = cut(large, rows) if salted else large
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        low = cut(low, rows) if salted else low
        small = meet(large, low).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct(), rows)
        after = mark(now)
        if after == before:
            return now.union(now.select("b", "b").distinct()).toDF("node", "component")
        before = after
