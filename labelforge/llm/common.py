"""Shared pieces of the corpus operators: checkpoints, texts, skew-safe ranks."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a missing setting is an error, since a machine-local folder would
    not be seen by other executors.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="labelforge-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


#: Rows of a few numbers each that one file of a checkpoint may hold.
ROWS_PER_FILE = 100_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    ``rows`` is a bound on the rows of a narrow table: it goes into a file for each ``ROWS_PER_FILE`` of them (2 at least) instead of
    one for each shuffle partition, most of which would be nearly empty.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(max(2, -(-rows // ROWS_PER_FILE)))).checkpoint(eager=True)


#: Rows that Python gets at a time: whole texts may be long, and both sides hold a batch in memory.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. Arrow batches of the session are made no larger than ``BATCH_ROWS`` rows."""
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(most)) <= BATCH_ROWS:
        spark.conf.set(most, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The whole text; null counts as empty."""
    col = F.col(f"`{column}`") if isinstance(column, str) else column
    return F.coalesce(col, F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that do not clash with a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


#: A key's rows are dealt over copies of it so that none has more than one in ``COPY_SHARE`` of all rows, or than ``COPY_ROWS``.
COPY_SHARE, COPY_ROWS = 200, 1_000_000


def copies_of(size: Column, n_rows: int, share: int = COPY_SHARE) -> Column:
    """How many copies of a key with ``size`` of ``n_rows`` rows these are dealt over; most keys have one."""
    return F.greatest(F.ceil(size * share / max(1, n_rows)), F.ceil(size / COPY_ROWS), F.lit(1)).cast("int")


def look_up(rows: DataFrame, found: DataFrame, on: list[str], size: str, n_rows: int, how: str = "inner", share: int = COPY_SHARE, own: bool = False) -> DataFrame:
    """``rows`` joined to the table ``found`` on the columns ``on``; ``size`` tells how many of the ``n_rows`` rows each key of ``found`` meets.

    Keys with over one in ``share`` of the rows, or over ``COPY_ROWS`` of them, are known to
    every task: a broadcast of fewer than ``share`` + ``n_rows`` / ``COPY_ROWS`` keys. Their rows are dealt over as many copies of the key as that takes. With ``own``
    the rows have a column ``size`` too, which tells the same, and nothing has to be known. The join itself is
    a sort-merge join at every size: what it moves grows with the rows, and with nothing else.
    """
    copies, salt = fresh(rows.select("*", *[F.lit(0).alias(c) for c in found.columns if c not in rows.columns]), "__copies", "__salt")
    dealt_to = copies_of(F.col(size), n_rows, share)
    by = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if c not in on][:1], F.spark_partition_id())
    marks = found.withColumn(copies, dealt_to).filter(F.col(copies) > 1).groupBy(*on).agg(F.max(copies).alias(copies))
    if own:
        dealt = rows.withColumn(salt, F.pmod(by, dealt_to).cast("int")).drop(size)
    else:
        dealt = rows.join(F.broadcast(marks), on, "left").withColumn(salt, F.coalesce(F.pmod(by, F.col(copies)), F.lit(0)).cast("int")).drop(copies)
    # rows of ``found`` that share a key have one size
    each = found.withColumn(salt, F.explode(F.sequence(F.lit(0), dealt_to - 1)))
    return dealt.join(each.hint("merge"), [*on, salt], how).drop(salt)


def rank_within(df: DataFrame, key: str, order: list[str], rank: str, rows_per_bucket: int = 50_000, least_buckets: int = 64, ranges: str | None = None) -> DataFrame:
    """Append ``rank``: 0-based, gapless position of each row among those with its ``key``.

    A key may hold most rows, so its rows are dealt over hash buckets first.
    Bucket sizes are added up per key (a table of keys x buckets) and each row
    gets its bucket's start plus its row number there. The order within a key
    is by bucket, then ``order``. ``key`` must not be null. ``ranges`` names a
    column that deals rows instead of the hash; if it rises with
    ``order``, so do ranks.
    """
    bucket, number, start, n = fresh(df, "__bucket", "__number", "__start", "__n")
    if ranges:
        dealt = df.withColumn(bucket, F.col(f"`{ranges}`"))
    else:
        buckets = max(least_buckets, -(-df.count() // rows_per_bucket))
        dealt = df.withColumn(bucket, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in order]), F.lit(buckets)))
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(key, bucket)
        .agg(F.count(F.lit(1)).alias(n))
        .select(key, bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long").alias(start))
    )
    inside = Window.partitionBy(key, bucket).orderBy(*[F.col(f"`{c}`") for c in order])
    numbered = dealt.withColumn(number, F.row_number().over(inside))
    return numbered.join(starts, [key, bucket]).withColumn(rank, F.col(start) + F.col(number) - 1).drop(bucket, number, start)


def slices(values: list, most: int, size=len) -> Iterator[tuple[int, int]]:
    """Ranges of ``values`` whose sizes add up to ``most`` or that hold one value."""
    first = total = 0
    for i, v in enumerate(values):
        n = size(v)
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(values):
        yield first, len(values)
