"""Quota pauses: held in state, ended by a timer, kept through a restart; nothing answered is asked again."""

import time

from labelforge.streaming import quota, resume


def until(ready, seconds=300):
    end = time.time() + seconds
    while not ready():
        assert time.time() < end, "the stream didn't get there"
        time.sleep(0.3)


def test_pause_ends_by_its_timer(spark, tmp_path):
    folder, table, state, log, spent = (str(tmp_path / n) for n in ("tasks", "table", "state", "log", "spent"))

    def answer(prompt, provider, model, max_tokens):
        import os

        with open(log, "a") as f:
            f.write(f"{model} {prompt}\n")
        if model == "m" and os.path.exists(spent):
            raise RuntimeError("429: tokens per day")
        return '{"genre_paths": ["F"], "metadata_paths": []}' if prompt != "bad" else "oops"

    def calls(model="m"):
        try:
            return [line.split()[1] for line in open(log) if line.startswith(model)]
        except FileNotFoundError:
            return []

    def held():
        try:
            return sorted((r.isbn13, r.model, r.status) for r in spark.read.parquet(table).collect())
        except Exception:
            return []

    def put(*rows):
        spark.createDataFrame(rows, resume.TASK).coalesce(1).write.mode("append").json(folder)

    def go():
        return quota.start(quota.with_pauses(resume.task_stream(spark, folder), 20, answer, buckets=1), table, state, "1 second")

    open(spent, "w").close()
    put(("1", "p", "m", "a1"), ("2", "p", "m", "a2"), ("3", "p", "n", "b3"), ("4", "p", "n", "bad"))
    query = go()
    try:
        until(lambda: len(held()) == 2)
        assert held() == [("3", "n", "success"), ("4", "n", "error")] and len(calls()) == 1
        paused = time.time()
        put(("5", "p", "m", "a5"), ("3", "p", "n", "b3"))  # one more waits; an answered one isn't asked again
        time.sleep(2)
        assert len(calls()) == 1 and calls("n") == ["b3", "bad"]
    finally:
        query.stop()
    import os

    os.remove(spent)
    query = go()  # the wait outlives the restart
    try:
        until(lambda: len(held()) == 5)
        assert time.time() - paused > 10
        assert held() == [("1", "m", "success"), ("2", "m", "success"), ("3", "n", "success"), ("4", "n", "error"), ("5", "m", "success")]
        assert sorted(calls()) == sorted(["a1", "a1", "a2", "a5"]) and calls("n") == ["b3", "bad"]
    finally:
        query.stop()
