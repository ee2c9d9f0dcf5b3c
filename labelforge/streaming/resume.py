"""The resumable run as a stream: new tasks come from a folder, each micro-batch asks for what the checkpoint lacks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from labelforge.plans import runner
from labelforge.sources.tables import read_checkpoint

TASK = "isbn13 string, provider string, model string, prompt string"


def task_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(TASK).json(folder)


def start(tasks: DataFrame, table: str, stream_checkpoint: str, provider: runner.Provider | None = None, taxonomy: DataFrame | None = None, candidates: DataFrame | None = None):
    """Append answers to ``table`` for each micro-batch; repeated tasks and replayed batches ask nothing twice.

    Each call is a run: a daily quota that is found spent pauses its model until the run ends. With ``taxonomy`` (kind, path) answers are validated before they
    are kept, also against each book's ``candidates`` (isbn13, kind, path) if these are given, so that a later run asks again for what was invalid.
    """
    run = uuid.uuid4().hex

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        held = read_checkpoint(spark, table, runner.CHECKPOINT)
        new = runner.pending(df.dropDuplicates(["isbn13", "provider", "model"]), held, runner.spent_models(held, run))
        rows = runner.parsed(runner.ask(new, provider), run)
        if taxonomy is not None:
            # a provider is asked once: validation reads the answers several times
            rows = rows.persist()
            try:
                rows.count()
                runner.validated(rows, taxonomy, candidates).write.mode("append").parquet(table)
            finally:
                rows.unpersist()
        else:
            rows.write.mode("append").parquet(table)

    return tasks.writeStream.foreachBatch(batch).option("checkpointLocation", stream_checkpoint).trigger(availableNow=True).start()
