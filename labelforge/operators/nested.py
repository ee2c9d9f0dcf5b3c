"""Ancestry by nested intervals: each taxonomy node has a pre-order number and that of its last descendant.

Ancestry is then containment of whole numbers (``a.pre < d.pre <= a.last``): labels carry two numbers instead of a path through shuffles, no
prefixes are built or compared, and a book's labels meet in one grouping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.functions import paths as P
from labelforge.operators.ordinals import with_ordinal

KEY = ["isbn13", "field"]


def interval_index(nodes: DataFrame) -> DataFrame:
    """(kind, path, pre, last) of the distinct ``nodes`` (kind, path). Ordered part by part, a subtree is without gaps, so ``last`` follows from its size. A path whose ancestors are no nodes is a root."""
    every = nodes.select("kind", "path").distinct()
    numbered = with_ordinal(every, "kind", [P.parts(F.col("path"))], "pre")
    covers = every.select("kind", F.explode(F.concat(F.array("path"), P.proper_prefixes(F.col("path")))).alias("path"))
    sizes = covers.groupBy("kind", "path").agg(F.count(F.lit(1)).alias("size"))
    return numbered.join(sizes, ["kind", "path"]).select("kind", "path", F.col("pre").cast("int").alias("pre"), (F.col("pre") + F.col("size") - 1).cast("int").alias("last"))


def coded(labels: DataFrame, index: DataFrame) -> DataFrame:
    """(isbn13, field, m, pre, last) of ``labels`` (isbn13, m, field, path). A label that is not in the index is an error."""
    found = labels.join(index.withColumnRenamed("kind", "field"), ["field", "path"], "left")
    known = F.when(F.col("pre").isNull(), F.raise_error(F.concat(F.lit("not in the index: "), F.col("path"))).cast("int")).otherwise(F.col("pre"))
    return found.select(*KEY, "m", known.alias("pre"), "last")


def _named(rows: DataFrame, index: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with numbers in ``columns`` replaced by their paths."""
    for c in columns:
        names = index.select(F.col("kind").alias("field"), F.col("pre").alias(c), F.col("path").alias("__path"))
        rows = rows.join(names, ["field", c]).withColumn(c, F.col("__path")).drop("__path")
    return rows


def ancestor_pairs(labels: DataFrame, index: DataFrame) -> DataFrame:
    """(isbn13, field, m_a, m_b, ancestor, descendant) across models."""
    held = coded(labels, index).groupBy(*KEY).agg(F.collect_list(F.struct("pre", "last", "m")).alias("all"))
    pairs = held.select(*KEY, F.col("all"), F.explode("all").alias("u"))
    below = F.expr("filter(all, d -> d.m <> u.m and d.pre > u.pre and d.pre <= u.last)")
    rows = pairs.select(*KEY, "u", F.explode(below).alias("d")).select(*KEY, F.least("u.m", "d.m").alias("m_a"), F.greatest("u.m", "d.m").alias("m_b"), F.col("u.pre").alias("ancestor"), F.col("d.pre").alias("descendant"))
    return _named(rows, index, "ancestor", "descendant").select(*KEY, "m_a", "m_b", "ancestor", "descendant")


#: Steps over a book's labels ``all`` (pre, last, m): bit m of ``exact`` tells that model m chose the node, of ``under`` that it chose the node or one below it.
_STEPS = {
    "nodes": "array_distinct(transform(all, x -> struct(x.pre as pre, x.last as last)))",
    "votes": """transform(nodes, v -> struct(v.pre as pre, v.last as last, aggregate(all, 0L, (s, x) -> s | if(x.pre = v.pre, shiftleft(1L, x.m), 0L)) as exact,
        aggregate(all, 0L, (s, x) -> s | if(x.pre >= v.pre and x.pre <= v.last, shiftleft(1L, x.m), 0L)) as under))""",
    "strong": "filter(votes, v -> bit_count(v.under) >= 2)",
    "canonical": "transform(filter(strong, p -> not exists(strong, o -> o.pre > p.pre and o.pre <= p.last)), p -> p.pre)",
}


def book_consensus(labels: DataFrame, index: DataFrame) -> DataFrame:
    """(isbn13, field, votes, canonical) in numbers: the same decisions as ``consensus.book_consensus``, by one grouping. Models are whole numbers from 0 to 62."""
    held = coded(labels, index).groupBy(*KEY).agg(F.collect_list(F.struct("pre", "last", "m")).alias("all"))
    for name, step in _STEPS.items():
        held = held.withColumn(name, F.expr(step))
    return held.select(*KEY, "votes", "canonical")


def canonical(labels: DataFrame, index: DataFrame) -> DataFrame:
    """(isbn13, field, path): see ``consensus.canonical``."""
    return _named(book_consensus(labels, index).select(*KEY, F.explode("canonical").alias("path")), index, "path").select(*KEY, "path")


def hierarchical_candidates(labels: DataFrame, index: DataFrame) -> DataFrame:
    """(isbn13, field, path, supporters): see ``consensus.hierarchical_candidates``."""
    rows = book_consensus(labels, index).select(*KEY, F.explode("votes").alias("v")).filter("bit_count(v.exact) < 2 and bit_count(v.under) >= 2")
    models = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.getbit(F.col("v.under"), i) == 1)
    return _named(rows.select(*KEY, F.col("v.pre").alias("path"), models.alias("supporters")), index, "path").select(*KEY, "path", "supporters")
