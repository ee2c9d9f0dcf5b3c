"""Quota pauses as stream state: a model that has spent its quota waits, and a timer ends the wait.

Tasks arrive in a stream. For each provider, model and bucket of books the state holds until when the model is paused, the tasks that wait for it, and the books it has answered. A
quota error pauses the group; that task and all that come meanwhile wait in the state, through restarts, and are asked when the timer fires. Each bucket finds out about a spent
quota by one call of its own, so ``buckets`` is how many calls a spent quota costs, and how many tasks may ask one model at a time.

A task that comes again is asked again only if it has no answer yet. If a micro-batch is lost before it is committed, its calls are made again, and its rows replace what it had written (``start``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from labelforge.functions.text import is_quota
from labelforge.plans import runner

STATE = "until long, waiting string, answered string"


def with_pauses(tasks: DataFrame, pause_seconds: float, provider: runner.Provider | None = None, buckets: int = 8, max_tokens: int = 350) -> DataFrame:
    """Answers (isbn13, model, provider, raw, error) to the stream ``tasks`` (isbn13, provider, model, prompt); errors other than a spent quota are answers too, but may be asked for again."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, model, _ = key
        until, waiting, answered = state.get if state.exists else (0, "[]", "[]")
        queue, done = dict(json.loads(waiting)), set(json.loads(answered))
        if not state.hasTimedOut:
            for frame in frames:
                queue |= {i: p for i, p in zip(frame["isbn13"], frame["prompt"], strict=True) if i not in done}
        now = state.getCurrentProcessingTimeMs()
        rows = []
        if now >= until:
            for isbn13 in list(queue):
                raw = error = None
                try:
                    raw = (provider or runner.provider_for(name))(queue[isbn13], name, model, max_tokens)
                    done.add(isbn13)
                except Exception as e:  # whatever a provider raises is a recorded error, not a lost task
                    error = str(e) or type(e).__name__
                    if is_quota(error):
                        until = now + int(pause_seconds * 1000)
                        break
                del queue[isbn13]
                rows.append((isbn13, model, name, raw, error))
        state.update((until, json.dumps(list(queue.items())), json.dumps(sorted(done))))
        if queue:
            state.setTimeoutDuration(max(1, until - now))
        if rows:
            yield pd.DataFrame(rows, columns=["isbn13", "model", "provider", "raw", "error"])

    bucket = F.pmod(F.xxhash64("isbn13"), F.lit(buckets))
    keyed = tasks.select("isbn13", "provider", "model", "prompt", bucket.alias("bucket"))
    return keyed.groupBy("provider", "model", "bucket").applyInPandasWithState(step, runner.RAW, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def start(answers: DataFrame, table: str, stream_checkpoint: str, every: str = "10 seconds", run: str = ""):
    """Parsed answers into ``table``, a partition for each micro-batch, which a replay overwrites. Runs until it is stopped: timers need batches without data too."""

    def batch(df: DataFrame, number: int) -> None:
        rows = runner.parsed(df, run).withColumn("batch", F.lit(number))
        rows.write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(table)

    return answers.writeStream.foreachBatch(batch).option("checkpointLocation", stream_checkpoint).outputMode("append").trigger(processingTime=every).start()
