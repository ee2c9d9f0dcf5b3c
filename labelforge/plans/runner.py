"""Resumable provider runs: pending tasks, calls, strict parsing, checkpoint.

A provider is a function (prompt, provider, model, max_tokens) -> str. Calls
happen in ``mapInPandas``, one per task and in partition order. Results go to a
checkpoint table keyed by (isbn13, model); a rerun asks only for what that lacks.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.functions import responses as R
from labelforge.functions.text import is_quota, quota_exhausted
from labelforge.plans import prompts

Provider = Callable[[str, str, str, int], str]
PROVIDERS: dict[str, Provider] = {}
RAW = "isbn13 string, model string, provider string, raw string, error string"
CHECKPOINT = "isbn13 string, model string, provider string, status string, genre_paths array<string>, metadata_paths array<string>, error string, run string"


class RateLimited(Exception):
    """A provider's refusal that a later try may not meet; ``after`` are the seconds it asks to wait."""

    def __init__(self, after: float | None = None):
        super().__init__("429")
        self.after = after


def register_provider(name: str, provider: Provider) -> None:
    PROVIDERS[name] = provider


def provider_for(name: str) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}")
    return PROVIDERS[name]


def with_retry(provider: Provider, most: int = 3, sleep: Callable[[float], None] = time.sleep) -> Provider:
    """Retries after rate limits (the wait asked for, or 2^n, and 2 s) and lost connections (2^n)."""

    def call(prompt: str, name: str, model: str, max_tokens: int) -> str:
        for n in range(most + 1):
            try:
                return provider(prompt, name, model, max_tokens)
            except RateLimited as e:
                if n == most:
                    raise
                sleep((2.0**n if e.after is None else e.after) + 2)
            except ConnectionError:
                if n == most:
                    raise
                sleep(2.0**n)
        raise AssertionError

    return call


class TooLong(Exception):
    """An answer that was cut at its limit of tokens."""


def unwrapped(response: dict) -> str:
    """The text of a chat completion; a refusal of the service, an answer without text and one that was cut are errors."""
    if response.get("error"):
        raise RuntimeError(str(response["error"].get("message", response["error"]) if isinstance(response["error"], dict) else response["error"]))
    choices = response.get("choices") or []
    if not choices:
        raise RuntimeError("no choices in the response")
    if choices[0].get("finish_reason") == "length":
        raise TooLong("finish_reason=length")
    content = (choices[0].get("message") or {}).get("content")
    if not content:
        raise RuntimeError("no content in the response")
    return content


def with_corrections(provider: Provider, check: Callable[[str], str | None], longest: int = 700) -> Provider:
    """A cut answer is asked for again with ``longest`` tokens; one that ``check`` finds wrong is asked for once more with what is wrong.

    ``check`` gives the error of an answer, or None. An answer wrong twice is returned as it is, for the parser to record.
    """

    def call(prompt: str, name: str, model: str, max_tokens: int) -> str:
        try:
            raw = provider(prompt, name, model, max_tokens)
        except (TooLong, RuntimeError) as e:
            if "finish_reason=length" not in str(e):
                raise
            raw = provider(prompt, name, model, longest)
        error = check(raw)
        return raw if error is None else provider(prompts.correction(prompt, error), name, model, max_tokens)

    return call


def spent_models(checkpoint: DataFrame, run: str) -> DataFrame:
    """(provider, model) whose daily quota an earlier batch of this ``run`` found spent. Rows of other runs pause nothing."""
    return checkpoint.filter((F.col("run") == run) & quota_exhausted(F.col("error"))).select("provider", "model").distinct()


def pending(tasks: DataFrame, checkpoint: DataFrame, spent: DataFrame | None = None) -> DataFrame:
    """Tasks (isbn13, provider, model, prompt) without a success of the same provider and model; none of models in ``spent``."""
    if spent is not None:
        tasks = tasks.join(spent, ["provider", "model"], "left_anti")
    done = checkpoint.filter("status = 'success'").select("isbn13", "provider", "model")
    return tasks.join(done, ["isbn13", "provider", "model"], "left_anti")


def ask(tasks: DataFrame, provider: Provider | None = None, max_tokens: int = 350) -> DataFrame:
    """(isbn13, model, provider, raw, error). After a daily quota is spent, a partition passes over that model's other tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spent: set[str] = set()
        for b in batches:
            rows = []
            for isbn13, model, name, prompt in zip(b["isbn13"], b["model"], b["provider"], b["prompt"], strict=True):
                if model in spent:
                    continue
                raw = error = None
                try:
                    raw = (provider or provider_for(name))(prompt, name, model, max_tokens)
                except Exception as e:  # whatever a provider raises is a recorded error, not a lost task
                    error = str(e) or type(e).__name__
                    if is_quota(error):
                        spent.add(model)
                rows.append((isbn13, model, name, raw, error))
            yield pd.DataFrame(rows, columns=["isbn13", "model", "provider", "raw", "error"])

    return tasks.select("isbn13", "model", "provider", "prompt").mapInPandas(run, RAW)


def parsed(answers: DataFrame, run: str = "") -> DataFrame:
    """Answers as checkpoint rows of a ``run``: strict parsing; an error keeps a preview of 1,500 characters."""
    r = answers.withColumn("r", R.strict_annotation(F.col("raw")))
    failed = F.coalesce(F.col("error"), F.when(F.col("r.error").isNotNull(), F.concat(F.col("r.error"), F.lit(": "), F.substring(F.coalesce("raw", F.lit("")), 1, 1500))))
    empty = F.array().cast("array<string>")
    return r.select("isbn13", "model", "provider", F.when(failed.isNull(), "success").otherwise("error").alias("status"), *[F.coalesce(F.when(failed.isNull(), F.col(f"r.{c}")), empty).alias(c) for c in ("genre_paths", "metadata_paths")], failed.alias("error"), F.lit(run).alias("run"))


def validated(answers: DataFrame, taxonomy: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Parsed answers (see ``parsed``) held against the taxonomy (kind, path) and each book's candidates (isbn13, kind, path).

    Paths are trimmed and named once. The first rule broken makes the row an error: invalid_genre, invalid_metadata,
    genre_outside_candidates, metadata_outside_candidates, both_roots.
    """
    tidy = lambda c: F.array_distinct(F.filter(F.transform(c, lambda p: F.trim(p)), lambda p: p != "")).alias(c)
    rows = answers.withColumns({c: tidy(c) for c in ("genre_paths", "metadata_paths")})
    key = ["isbn13", "provider", "model"]
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_paths").alias("all")) for k in ("genre", "metadata")])
    paths = rows.filter("status = 'success'").select(*key, F.inline(kinds)).select(*key, "kind", F.explode("all").alias("path"))
    rank = F.when(F.col("kind") == "genre", 0).otherwise(1)
    broken = paths.join(taxonomy.select("kind", "path"), ["kind", "path"], "left_anti").select(*key, rank.alias("rank"), F.concat("kind", F.lit(": "), "path").alias("what"), F.concat(F.lit("invalid_"), "kind").alias("rule"))
    if candidates is not None:
        outside = paths.join(candidates.select("isbn13", "kind", "path"), ["isbn13", "kind", "path"], "left_anti").select(*key, (rank + 2).alias("rank"), F.concat("kind", F.lit(": "), "path").alias("what"), F.concat("kind", F.lit("_outside_candidates")).alias("rule"))
        broken = broken.unionByName(outside)
    first = broken.groupBy(*key).agg(F.min(F.struct("rank", "rule", "what")).alias("first"))
    roots = F.array_distinct(F.filter(F.transform("genre_paths", lambda p: F.split(p, " / ")[0]), lambda r: r.isin("Fiction", "Nonfiction")))
    rule = F.coalesce(F.concat("first.rule", F.lit(": "), "first.what"), F.when(F.size(roots) > 1, "both_roots"))
    judged = rows.join(first, key, "left").withColumn("rule", F.when(F.col("status") == "success", rule))
    empty = F.array().cast("array<string>")
    ok = F.col("rule").isNull()
    kept = {c: F.when(ok, F.col(c)).otherwise(empty).alias(c) for c in ("genre_paths", "metadata_paths")}
    return judged.select("isbn13", "model", "provider", F.when(ok, F.col("status")).otherwise("error").alias("status"), *kept.values(), F.coalesce("rule", "error").alias("error"), *[c for c in answers.columns if c == "run"])


def resolve_debates(books: DataFrame, candidates: DataFrame, taxonomy: DataFrame, provider: Provider, name: str, model: str, max_tokens: int = 700) -> DataFrame:
    """Book-level debates: candidates, question, answer, strict parsing, validation; checkpoint rows with the candidates asked about.

    ``books``: (isbn13, title, filtered_tags, annotations), where annotations is a text of the annotators' choices.
    """
    held = candidates.groupBy("isbn13").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("path")))).alias(f"candidate_{k}_paths") for k in ("genre", "metadata")])
    empty = F.array().cast("array<string>")
    asked = books.join(held, "isbn13", "left").withColumns({c: F.coalesce(c, empty) for c in ("candidate_genre_paths", "candidate_metadata_paths")})
    tasks = asked.select("isbn13", F.lit(name).alias("provider"), F.lit(model).alias("model"), prompts.resolve(F.col("title"), F.col("filtered_tags"), F.col("candidate_genre_paths"), F.col("candidate_metadata_paths"), F.col("annotations")).alias("prompt"))
    found = validated(parsed(ask(tasks, provider, max_tokens)), taxonomy, candidates)
    return found.join(asked.select("isbn13", "candidate_genre_paths", "candidate_metadata_paths"), "isbn13")


def refreshed(records: DataFrame, books: DataFrame, models: list[str]) -> DataFrame:
    """Checkpoint records (isbn13, title, filtered_tags, annotations map) with the annotations of ``models`` only, and title and tags as ``books`` (isbn13, title, filtered_tags) has them now."""
    now = books.select("isbn13", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("filtered_tags", F.array().cast("array<string>")).alias("filtered_tags"))
    kept = records.select("isbn13", F.map_filter("annotations", lambda k, _: k.isin(*models)).alias("annotations"))
    kind = records.schema["annotations"].dataType.simpleString()
    return now.join(kept, "isbn13", "left").withColumn("annotations", F.coalesce("annotations", F.expr("map()").cast(kind)))


def collect_step(wanted: DataFrame, done: DataFrame, failed: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One step of a resumable collection: (done, failed) after ``fetched`` (isbn13, ..., error).

    Ids that are done are not taken again; a success removes an earlier failure, a new failure replaces it.
    """
    from labelforge.sources.tables import upsert

    new = fetched.join(wanted.select("isbn13"), "isbn13", "left_semi").join(done.select("isbn13"), "isbn13", "left_anti")
    good, bad = new.filter("error is null").drop("error"), new.filter("error is not null").select("isbn13", "error")
    left = failed.join(good.select("isbn13"), "isbn13", "left_anti")
    return done.unionByName(good), upsert(left, bad, ["isbn13"])


def annotatable(books: DataFrame) -> DataFrame:
    """The books that have tags; the others are told by ``without_tags``."""
    return books.filter("coalesce(size(filtered_tags), 0) > 0")


def without_tags(books: DataFrame, models: list[tuple[str, str]]) -> DataFrame:
    """Checkpoint rows of books without tags: ``no_filtered_tags`` for each (provider, model)."""
    pairs = F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(m).alias("model")) for p, m in models])
    empty = F.array().cast("array<string>")
    rows = books.filter("coalesce(size(filtered_tags), 0) <= 0").select("isbn13", F.inline(pairs))
    return rows.select("isbn13", "model", "provider", F.lit("no_filtered_tags").alias("status"), empty.alias("genre_paths"), empty.alias("metadata_paths"), F.lit(None).cast("string").alias("error"), F.lit("").alias("run"))


annotation_prompt = prompts.annotate


def filter_fail_open(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """(isbn13, status, tags): a failed filter call keeps all candidates. ``candidates``: (isbn13, tags); ``answers``: (isbn13, error, kept)."""
    rows = candidates.join(answers, "isbn13", "left")
    status = F.when(F.size("tags") == 0, "no_candidates").when(F.col("error").isNotNull() | F.col("kept").isNull(), "error").otherwise("success")
    return rows.select("isbn13", status.alias("status"), F.when(status == "success", F.col("kept")).otherwise(F.col("tags")).alias("tags"))


def until_done(step: Callable[[], int], target: int = 0, rounds: int = 30, stalled: int = 3) -> list[int]:
    """Runs ``step``, which returns what is left, until that is ``target``, or it has not fallen for ``stalled`` rounds."""
    left: list[int] = []
    while len(left) < rounds and (not left or left[-1] > target):
        left.append(step())
        if len(left) > stalled and left[-1] >= left[-1 - stalled]:
            break
    return left
