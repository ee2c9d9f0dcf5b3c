"""Expectations on tables: each gives its violations as rows; ``enforce`` turns rows into an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Violated(ValueError):
    """An expectation that does not hold."""


def enforce(violations: DataFrame, what: str, shown: int = 5) -> None:
    """Raises ``Violated`` with a few rows if there are any."""
    rows = violations.limit(shown).collect()
    if rows:
        raise Violated(f"{what}: {[r.asDict() for r in rows]}")


def keys_equal(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): keys that only ``a`` or only ``b`` has."""
    one, two = a.select(*keys).distinct().withColumn("a", F.lit(True)), b.select(*keys).distinct().withColumn("b", F.lit(True))
    return one.join(two, keys, "full").filter("a is null or b is null").select(*keys, F.when(F.col("a").isNull(), "right only").otherwise("left only").alias("side"))


def inner_or_missing(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The inner join of ``a`` and ``b``, and the keys of ``a`` that ``b`` lacks, which must be none."""
    return a.join(b, keys), a.select(*keys).distinct().join(b, keys, "left_anti")


def joined(a: DataFrame, b: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The inner join; a key of ``a`` that ``b`` lacks is an error."""
    found, missing = inner_or_missing(a, b, keys)
    enforce(missing, what)
    return found


def outside_domain(df: DataFrame, domains: dict[str, tuple]) -> DataFrame:
    """(column, value, n): values that a column may not have; null is one."""
    found = [df.groupBy(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).filter(~F.coalesce(F.col("value").isin(*map(str, allowed)), F.lit(False))) for c, allowed in domains.items()]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def counts_differ(counts: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(name, n, expected) of the rows of ``counts`` (name, n) that differ from what a caller expects, or are missing."""
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).cast("long").alias("expected")) for k, v in expected.items()])
    wanted = counts.sparkSession.range(1).select(F.inline(pairs))
    return wanted.join(counts, "name", "left").select("name", "n", "expected").filter(~F.col("n").eqNullSafe(F.col("expected")))


def partition_incomplete(whole: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, parts): keys of ``whole`` that are not in exactly one part, and keys of parts that ``whole`` lacks."""
    dealt = None
    for name, part in parts.items():
        rows = part.select(key, F.lit(name).alias("part"))
        dealt = rows if dealt is None else dealt.unionByName(rows)
    held = dealt.groupBy(key).agg(F.array_sort(F.collect_list("part")).alias("parts"))  # a row for each time a part names the key
    both = whole.select(key).distinct().withColumn("known", F.lit(True)).join(held, key, "full")
    return both.filter("known is null or parts is null or size(parts) <> 1").select(key, F.coalesce(F.array_join("parts", ","), F.lit("")).alias("parts"))


def out_of_bounds(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.filter(~F.col(column).between(low, high) | F.col(column).isNull())


def rounds_incomplete(open_: DataFrame, first: DataFrame) -> DataFrame:
    """(debate_id, support_count, answers): disputes whose first round has not as many successful answers as supporters."""
    told = first.filter("decision is not null").groupBy("debate_id").agg(F.count(F.lit(1)).alias("answers"))
    rows = open_.select("debate_id", "support_count").join(told, "debate_id", "left").fillna(0, ["answers"])
    return rows.filter("answers <> support_count")


def audit(final: DataFrame, manual: DataFrame, violations: DataFrame, top: int = 20) -> dict:
    """The report of an audit: counts, methods, the most frequent paths and the violations by check.

    ``final``: (isbn13, genre, metadata, method); ``manual``: (isbn13). Each part is an aggregate of bounded size.
    """
    ids = final.select("isbn13").unionAll(manual.select("isbn13"))
    total, unique = ids.agg(F.count(F.lit(1)), F.count_distinct("isbn13")).first()
    report = {"resolved_records": final.count(), "manual_review_records": manual.count(), "total_accounted": total, "unique_isbns": unique, "duplicate_isbn_occurrences": total - unique}
    report |= {r["check"]: r["n"] for r in violations.collect()}  # a row for each check
    report["resolution_methods"] = {r["method"]: r["n"] for r in final.groupBy("method").agg(F.count(F.lit(1)).alias("n")).orderBy("method").collect()}
    for field in ("genre", "metadata"):
        counts = final.select(F.explode(field).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path").limit(top)
        report[f"top_{field}_paths"] = [(r["path"], r["n"]) for r in counts.collect()]
    return report


#: Counts of a report that must be zero.
ZERO = ("duplicate_isbn_occurrences", "duplicate_final", "final_and_manual", "empty_final", "invalid_genre", "invalid_metadata", "both_roots")


def enforce_audit(report: dict) -> None:
    bad = {k: report[k] for k in ZERO if report.get(k)}
    if bad:
        raise Violated(f"audit: {bad}")
