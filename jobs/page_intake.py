"""Intake of collected pages, as an incremental job.

Collectors drop page files (page_id, url, html) into a folder. Each run takes the files that no earlier run has taken, by a file stream with a checkpoint, and
appends what reviewers need of each page: host, language, whether it is usable, cleaned title, tags of its links, sizes. A page that is delivered again gets a new row; ``current`` gives
each page as last delivered. Then coverage (pages by language, host and status) is written anew for the languages that there are.

    python -m jobs.page_intake --pages DIR --out DIR --state DIR [--config jobs/page_intake.json]

Output: ``OUT/evidence``, partitioned by status and lang, written by Spark's file sink (each batch once, whatever is retried), and ``OUT/coverage``, partitioned by lang. A rerun without new files adds nothing. Paths may be
remote; pages, output and state (the stream's checkpoint) are only touched through Spark. ``out`` and ``state`` belong together: remove both to start anew.

A null or blank page is ``empty``; a page without a title is ``untitled``; a page of a bot check is ``blocked``; without a lang attribute the language is ``und``.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.functions import text as T
from labelforge.operators import pages as G

log = logging.getLogger("jobs.page_intake")
PAGES = "page_id long, url string, html string"
EVIDENCE = ["page_id", "host", "title", "tags", "n_tags", "n_links", "n_bytes", "status", "lang"]
DEFAULTS = {"files_per_batch": 64, "noise_tags": []}


def _tags(links: Column, noise: list[str]) -> Column:
    """Texts of links, cleaned, the first of each case key, without noise tags."""
    texts = T.dedup_folded(F.transform(links, lambda x: x["text"]))
    return F.filter(texts, lambda t: ~T.fold(t).isin(*T.NOISE_TAGS, *noise))


def evidence(pages: DataFrame, noise: list[str]) -> DataFrame:
    """``EVIDENCE`` of each page; other columns of ``pages`` but url and html are kept."""
    html = F.coalesce("html", F.lit(""))
    rest = [c for c in pages.columns if c not in ("page_id", "url", "html")]
    found = pages.select(
        "page_id",
        *rest,
        F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^https?://([^/:?#]+)", 1)).alias("host"),
        T.clean_html(G.title(html)).alias("title"),
        G.links(html).alias("links"),
        F.octet_length(html).cast("long").alias("n_bytes"),
        G.blocked(html).alias("blocked"),
        T.clean(html).isNull().alias("blank"),
        F.coalesce(F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})\b", 1)), F.lit("")), F.lit("und")).alias("lang"),
    )
    status = F.when(F.col("blank"), "empty").when(F.col("blocked"), "blocked").when(F.col("title").isNull(), "untitled").otherwise("usable")
    told = found.withColumn("status", status).withColumn("t", _tags(F.col("links"), noise))
    return told.select(*rest, "page_id", "host", "title", F.array_join("t", " | ").alias("tags"), F.size("t").cast("long").alias("n_tags"), F.size("links").cast("long").alias("n_links"), "n_bytes", "status", "lang")


def current(spark: SparkSession, out: str) -> DataFrame:
    """``EVIDENCE`` of each page as it was last delivered."""
    others = [c for c in EVIDENCE if c != "page_id"]
    rows = spark.read.parquet(f"{out}/evidence")
    last = rows.groupBy("page_id").agg(F.max_by(F.struct(*others), F.struct("delivered", "file")).alias("r"))
    return last.select("page_id", "r.*").select(*EVIDENCE)


def _count(spark: SparkSession, path: str) -> int:
    try:
        return spark.read.parquet(path).count()
    except AnalysisException:  # nothing has been written yet
        return 0


def run(spark: SparkSession, pages: str, out: str, state: str, config: dict | None = None) -> dict[str, int]:
    """One run; what it read and wrote."""
    options = DEFAULTS | (config or {})
    before = _count(spark, f"{out}/evidence")
    source = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", options["files_per_batch"]).parquet(pages)
    new = source.select("*", F.col("_metadata.file_modification_time").alias("delivered"), F.col("_metadata.file_path").alias("file"))
    sink = evidence(new, options["noise_tags"]).writeStream.format("parquet").partitionBy("status", "lang").option("path", f"{out}/evidence").option("checkpointLocation", state)
    query = sink.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    read = sum(p["numInputRows"] if isinstance(p, dict) else p.numInputRows for p in query.recentProgress)
    written = _count(spark, f"{out}/evidence") - before
    if written or before:
        coverage = current(spark, out).groupBy("lang", "host", "status").agg(F.count(F.lit(1)).alias("pages"), F.count("title").alias("titled"), F.sum("n_tags").alias("tags"))
        coverage.repartition("lang").write.partitionBy("lang").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{out}/coverage")
    log.info("read %d new pages from %s; wrote %d rows to %s/evidence, which has %d", read, pages, written, out, before + written)
    return {"read": read, "written": written, "held": before + written}


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("pages", "out", "state"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config", help="JSON with files_per_batch and noise_tags; read through Spark")
    asked = args.parse_args()
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("page_intake").getOrCreate()
    try:
        config = spark.read.json(asked.config, multiLine=True).first().asDict() if asked.config else None
        run(spark, asked.pages, asked.out, asked.state, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
