"""Release of consensus labels, as a batch job that may be run for some blocks of books.

Reads annotations (the tables from which books, models and labels come), decides for each path that any model chose whether it is canonical, goes to review, is settled by the canonical paths or
pruned as a majority above one of them, and writes the decisions with their votes.

    python -m jobs.label_release --data DIR --out DIR [--config jobs/label_release.json] [--blocks 3,4]

Output: ``OUT``, partitioned by field and block (``books_per_block`` books by isbn13). Partitions are overwritten dynamically, so a rerun gives the same result and a run for some blocks leaves the others as they are. A
partition of a block that has no label any more stays until it is removed. After writing, a path that is there twice or has an unknown outcome is an error.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge import fixtures as X
from labelforge.operators import consensus as C
from labelforge.operators import expectations as E

log = logging.getLogger("jobs.label_release")
COLUMNS = ["isbn13", "path", "votes", "outcome", "reason", "field", "block"]
OUTCOMES = ("canonical", "review", "settled", "pruned")
DEFAULTS = {"books_per_block": 10_000, "review_reasons": list(C.REVIEWED)}


def decided(labels: DataFrame, review_reasons: list[str]) -> DataFrame:
    """(isbn13, field, path, votes, outcome, reason) of each path that a model chose, by one grouping of a book's paths."""
    held = C.book_consensus(labels)
    reason = F.expr("get(filter(review, r -> r.path = v.path), 0).reason")
    is_canonical = F.expr("array_contains(canonical, v.path)")
    rows = held.select("isbn13", "field", "canonical", "review", F.explode("votes").alias("v")).withColumn("reason", F.coalesce(reason, F.lit("")))
    outcome = F.when(is_canonical, "canonical").when(F.col("reason").isin(*review_reasons), "review").when(F.col("reason") != "", "settled").otherwise("pruned")
    return rows.select("isbn13", "field", "v.path", F.expr("bigint(bit_count(v.exact))").alias("votes"), outcome.alias("outcome"), "reason")


def run(spark: SparkSession, data: str, out: str, config: dict | None = None, blocks: list[int] | None = None) -> dict[str, int]:
    """One run; rows written by outcome."""
    options = DEFAULTS | (config or {})
    block = F.expr(f"isbn13 div {options['books_per_block']}")
    labels = X.labels(spark, data)
    if blocks is not None:
        labels = labels.filter(block.isin(*blocks))
    rows = decided(labels, options["review_reasons"]).withColumn("block", block)
    rows.select(*COLUMNS).repartition("field", "block").write.partitionBy("field", "block").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(out)
    back = released(spark, out) if blocks is None else released(spark, out).filter(F.col("block").isin(*blocks))
    E.enforce(back.groupBy("isbn13", "field", "path").count().filter("count > 1"), "a path is there twice")
    E.enforce(E.outside_domain(back, {"outcome": OUTCOMES}), "an unknown outcome")
    counts = {r.outcome: r["count"] for r in back.groupBy("outcome").count().collect()}
    log.info("read labels from %s (%s); wrote %s to %s", data, "all blocks" if blocks is None else f"blocks {blocks}", counts, out)
    return counts


def released(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).select(*COLUMNS[:5], "field", F.col("block").cast("long").alias("block"))


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    args.add_argument("--data", required=True)
    args.add_argument("--out", required=True)
    args.add_argument("--config", help="JSON with books_per_block and review_reasons; read through Spark")
    args.add_argument("--blocks", help="blocks to release, by number, with commas; all if left out")
    asked = args.parse_args()
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("label_release").getOrCreate()
    try:
        config = spark.read.json(asked.config, multiLine=True).first().asDict() if asked.config else None
        run(spark, asked.data, asked.out, config, [int(b) for b in asked.blocks.split(",")] if asked.blocks else None)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
