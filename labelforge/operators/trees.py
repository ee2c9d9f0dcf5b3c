"""Trees from tables of (node, parent): paths by pointer doubling, and taxonomy edits on paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.functions.paths import SEPARATOR
from labelforge.sources.shared import new_folder


class Cycle(ValueError):
    """Nodes whose ancestors lead back to themselves."""


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(id, path, depth, root) of the ``nodes`` (id, parent, label): labels from the root down.

    Each round a node's pointer to an ancestor jumps to what that one points at, and the labels passed are put before its own, so rounds grow with the logarithm of the
    depth, and no task holds a subtree. A parent that is null or no node makes its child a root. An id that is there twice is an error. After as many rounds as a path through all nodes could need, what still
    points somewhere is on a cycle or below one: ``Cycle``.
    """
    spark, folder = nodes.sparkSession, new_folder(nodes.sparkSession, "tree")
    once = nodes.groupBy("id").agg(F.max(F.struct("parent", "label")).alias("n"), F.count(F.lit(1)).alias("held"))
    label = F.when(F.col("held") > 1, F.raise_error(F.concat(F.lit("two nodes with the id "), F.col("id").cast("string"))).cast("string")).otherwise(F.col("n.label"))
    every = once.filter("id is not null").select("id", F.col("n.parent").alias("parent"), label.alias("path"))
    known = every.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    rows = every.join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("up"), "path", F.lit(1).alias("depth"), F.coalesce(F.when(F.col("known"), F.col("parent")), F.col("id")).alias("root"))
    now, number = _stored(rows, f"{folder}/0"), 0
    n = now.count()
    while not now.filter("up is not null").isEmpty():
        if 1 << number > n:
            some = [r.id for r in now.filter("up is not null").select("id").limit(5).collect()]
            raise Cycle(f"on a cycle or below one: {some}")
        above = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("before"), F.col("depth").alias("more"), F.col("root").alias("top"))
        met = now.join(above, "up", "left")
        path = F.when(F.col("before").isNull(), F.col("path")).otherwise(F.concat("before", F.lit(SEPARATOR), "path"))
        number += 1
        now = _stored(met.select("id", F.col("next").alias("up"), path.alias("path"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("top", "root").alias("root")), f"{folder}/{number}")
    return now.select("id", "path", "depth", "root")


def without_subtrees(paths: DataFrame, cut: DataFrame) -> DataFrame:
    """``paths`` (path, ...) without those of ``cut`` (path) and all below them: an equi-join on prefixes."""
    from labelforge.functions.paths import proper_prefixes

    above = paths.select("path", F.explode(F.concat(F.array("path"), proper_prefixes(F.col("path")))).alias("__above"))
    gone = above.join(cut.select(F.col("path").alias("__above")).distinct(), "__above").select("path").distinct()
    return paths.join(gone, "path", "left_anti")
