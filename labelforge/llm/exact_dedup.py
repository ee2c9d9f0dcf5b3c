"""Exact dedup by skew-safe combining.

Rows whose digest occurs once (counted with local combining) are groups by
themselves. The lookup of the others is a sort-merge join whatever the size, salted for digests of very
many rows, so a text is moved once for it. Other copies are combined three times, each time as a group of equal
``(digest, content)`` so that full contents are compared, never digests alone:

1. locally: Spark's partial aggregation leaves a row for each content and map task;
2. salted: those rows meet by digest, content and a salt (their input
   partition modulo ``salts``), so a content with a third of all rows is
   spread over ``salts`` tasks;
3. globally: the salt winners, at most ``salts`` for a content, meet by digest.

Defined results: a null text is an empty text; a null id is below all others
and stays only if the group has no other id; repeated rows (same id, same
text) belong to one group and each is counted; an empty table gives an empty
result. ``kept`` is true on each row that bears the group's largest id.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import cut, fresh, look_up, text_of


def _digest(text):
    return F.unhex(F.sha2(text, 256))


def combine(rows: DataFrame, measures: list, merges: list, salts: int) -> DataFrame:
    """One row for each distinct ``(__digest, __text)`` of ``rows``."""
    keys = ["__digest", "__text"]
    salted = rows.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy(*keys, "__salt").agg(*measures)
    return salted.drop("__salt").repartition("__digest").groupBy(*keys).agg(*merges)


def assign_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, salts: int = 64, digest=_digest, with_text: bool = False) -> DataFrame:
    """Each row's group: ``id_col``, the columns ``keep``, ``digest``, ``keep_id``, ``group_size``, ``kept``
    and, ``with_text``, ``content`` (the text, or an empty one for null).

    The largest id of a group stays. ``digest`` makes the grouping key from
    the text column; groups that share a digest but differ in content are
    told apart by content.
    """
    keep = list(keep or [])
    named = [F.col(f"`{id_col}`").alias("__id"), *[F.col(f"`{c}`").alias(f"__kept_{i}") for i, c in enumerate(keep)]]
    rows = docs.select(*named, text_of(text_col).alias("__text")).withColumn("__digest", digest(F.col("__text")))
    # A digest that occurs once needs no comparison of contents.
    repeated = cut(rows.groupBy("__digest").agg(F.count(F.lit(1)).alias("__size")).filter("__size > 1"))
    n_rows = docs.count()
    groups = combine(
        look_up(rows, repeated, ["__digest"], "__size", n_rows, "left_semi"),
        [F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__size")],
        [F.max("__keep").alias("__keep"), F.sum("__size").alias("__size")],
        salts,
    )
    # Singletons need no lookup, so only groups of copies are joined to the rows.
    by_digest = groups.groupBy("__digest").agg(
        F.count(F.lit(1)).alias("__contents"), F.max("__keep").alias("__keep"), F.max("__size").alias("__size")
    )
    multi = cut(by_digest.filter("__contents > 1 or __size > 1"))
    if multi.filter("__contents > 1").isEmpty():
        found = look_up(rows if with_text else rows.drop("__text"), multi.drop("__contents"), ["__digest"], "__size", n_rows, "left")
    else:  # some digest stands for several contents, so rows find their group by content
        found = look_up(rows, cut(groups), ["__digest", "__text"], "__size", n_rows, "left")
    keep_id = F.when(F.col("__size").isNull(), F.col("__id")).otherwise(F.col("__keep"))
    return found.select(
        F.col("__id").alias(id_col),
        *[F.col(f"__kept_{i}").alias(c) for i, c in enumerate(keep)],
        F.col("__digest").alias("digest"),
        keep_id.alias("keep_id"),
        F.coalesce(F.col("__size"), F.lit(1)).cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(keep_id).alias("kept"),
        *([F.col("__text").alias("content")] if with_text else []),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each distinct text, that with the largest id.

    Repeated rows leave one row: of equal ids, the one whose other columns are largest in order. Runs the same three
    combining steps with the row itself carried along, so no join back is needed. Columns of a type without an
    order (maps, variants) are ranked by their text.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    (is_null,) = fresh(docs, "__null")
    lead = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").isNull().alias(is_null)]
    row = F.struct(*lead, *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    rows = docs.select(row.alias("__row"), text_of(text_col).alias("__text")).withColumn("__digest", _digest(F.col("__text")))
    unordered = {c for c in others if re.search(r"map<|variant", docs.schema[c].dataType.simpleString())}
    rank = F.struct(*[F.col(f"__row.{n}") for n in ("id", is_null)], *[F.col(f"__row.c{i}").cast("string") if c in unordered else F.col(f"__row.c{i}") for i, c in enumerate(others)])
    best = F.max_by("__row", rank) if unordered else F.max("__row")
    kept = combine(rows, [best.alias("__row")], [best.alias("__row")], salts)
    back = {id_col: F.col("__row.id"), text_col: F.when(F.col(f"__row.`{is_null}`"), F.lit(None)).otherwise(F.col("__text"))}
    back |= {c: F.col(f"__row.c{i}") for i, c in enumerate(others)}
    return kept.select(*[back[c].alias(c) for c in docs.columns])
