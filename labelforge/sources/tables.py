"""Sources, sinks and checkpoint tables."""

from __future__ import annotations

import json
import os
import tempfile
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelforge.operators.expectations import joined


def read_isbns(spark: SparkSession, path: str, column: str = "Isbn-13") -> DataFrame:
    """Non-empty, trimmed ISBNs of a CSV with a header; a byte-order mark does no harm. A missing column is an error."""
    df = spark.read.csv(path, header=True)
    if column not in df.columns:
        raise ValueError(f"no column {column!r} in {path}: {df.columns}")
    return df.select(F.trim(F.col(f"`{column}`")).alias("isbn13")).filter("isbn13 <> ''")


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, limit: int | None = None) -> DataFrame:
    """CSV with header, quoted and multi-line cells, as strings or by ``schema``; an empty table is an error. ``limit`` takes the first rows of the file."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df if limit is None else df.limit(limit)


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that hold one JSON array each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_checkpoint(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A checkpoint table; a folder that isn't there is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_json_checkpoint(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Checkpoint files that hold a JSON list each; one that is missing, can't be parsed or is no list is empty."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    texts = spark.read.text(path, wholetext=True)
    kind = (schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).simpleString()
    return texts.filter(F.rlike("value", F.lit(r"(?s)^\s*\[.*\]\s*$"))).select(F.inline(F.from_json("value", f"array<{kind}>", {"mode": "PERMISSIVE"})))


def read_keyed(spark: SparkSession, folder: str, schema: str = "isbn13 string, source_genres map<string,array<string>>, genre_union array<string>, provenance map<string,array<string>>", keys: DataFrame | None = None) -> DataFrame:
    """A JSON file for each key in ``folder``, read in one scan; a missing id is the file's name, missing fields are empty.

    With ``keys`` (isbn13) only these are read, and one without a file is an error.
    """
    name = F.regexp_extract(F.url_decode(F.input_file_name()), r"([^/]+)\.json$", 1)
    found = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*.json").withColumn("__name", name)
    empty = {"isbn13": F.col("__name"), "source_genres": F.expr("map()").cast("map<string,array<string>>"), "genre_union": F.array().cast("array<string>"), "provenance": F.expr("map()").cast("map<string,array<string>>")}
    rows = found.select(*[F.coalesce(F.col(c), empty[c]).alias(c) if c in empty else F.col(c) for c in found.columns if c != "__name"])
    return rows if keys is None else joined(keys.select("isbn13").distinct(), rows, ["isbn13"], f"{folder}: no file")


def read_frozen(spark: SparkSession, path: str, expected: dict[str, tuple[str, int]]) -> DataFrame:
    """A frozen snapshot; ``expected`` names counts, each a condition in SQL and the number of rows that must meet it."""
    df = spark.read.parquet(path)
    got = df.agg(*[F.count_if(F.expr(where)).alias(name) for name, (where, _) in expected.items()]).first()
    wrong = {name: (got[name], n) for name, (_, n) in expected.items() if got[name] != n}
    if wrong:
        raise ValueError(f"{path}: counts and what was expected: {wrong}")
    return df


def read_text_evidence(spark: SparkSession, glob: str) -> DataFrame:
    """(isbn13, kind, source, text) of files "ISBN b|r SOURCE N.txt"; blank texts go."""
    name = F.regexp_extract(F.url_decode(F.input_file_name()), r"([^/]+)\.txt$", 1)
    files = spark.read.text(glob, wholetext=True).select(name.alias("name"), F.trim("value").alias("value")).filter("value <> ''")
    part = lambda i: F.regexp_extract("name", r"^(\S+) ([br]) (.*) \S+$", i)
    source = F.initcap(part(3))
    return files.select("name", part(1).alias("isbn13"), part(2).alias("kind"), source.alias("source"), F.concat(F.lit("["), source, F.lit("] "), F.col("value")).alias("text"))


def flatten_tree(tree: dict | list, above: tuple[str, ...] = ()) -> list[str]:
    """Paths of all nodes of a tree of dicts and lists, in pre-order."""
    found = []
    for name in tree:
        parts = (*above, name)
        found.append(" / ".join(parts))
        if isinstance(tree, dict):
            found += flatten_tree(tree[name], parts)
    return found


def taxonomy_table(spark: SparkSession, genre_json: str, metadata_json: str, metadata_root: str = "Book_Metadata_Hierarchy") -> DataFrame:
    """(kind, path, seq) of two trees given as JSON text; the metadata tree's own root is taken off."""
    strip = f"{metadata_root} / "
    rows = [("genre", p, i) for i, p in enumerate(flatten_tree(json.loads(genre_json)))]
    rows += [("metadata", p.removeprefix(strip), i) for i, p in enumerate(flatten_tree(json.loads(metadata_json))) if p != metadata_root]
    return spark.createDataFrame(rows, "kind string, path string, seq int")


def repaired_text(text: str, literals: dict[str, str] | None = None) -> str:
    """A hand-edited tree without marks, comments and trailing commas; ``literals`` are texts to put right, each with what stands for it."""
    import re

    for wrong, right in (literals or {}).items():
        text = text.replace(wrong, right)
    text = text.replace("�", "").replace("’", "'").replace("‘", "'")
    text = re.sub(r"(?m)^\s*\[RM#\].*$|\[RM#\]|///.*$", "", text)
    return re.sub(r",(\s*[}\]])", r"\1", text)


def repaired_json(text: str, literals: dict[str, str] | None = None) -> dict:
    """The first JSON object of a hand-edited tree (see ``repaired_text``)."""
    text = repaired_text(text, literals)
    return json.JSONDecoder().raw_decode(text[text.index("{") :])[0]


def repair_diagnostics(text: str, literals: dict[str, str] | None = None, around: int = 3) -> dict | None:
    """None if the repaired text parses, else the error with its line and the lines around it."""
    text = repaired_text(text, literals)
    try:
        json.JSONDecoder().raw_decode(text[text.index("{") :])
    except (json.JSONDecodeError, ValueError) as e:
        offset = text.index("{") if "{" in text else 0
        line = text.count("\n", 0, offset + getattr(e, "pos", 0)) + 1
        lines = text.splitlines()
        return {"error": getattr(e, "msg", str(e)), "line": line, "context": [(i, lines[i - 1]) for i in range(max(1, line - around), min(len(lines), line + around) + 1)]}
    return None


def without_subtree(taxonomy: DataFrame, path: str) -> DataFrame:
    return taxonomy.filter((F.col("path") != path) & ~F.startswith("path", F.lit(f"{path} / ")))


def with_subtree(taxonomy: DataFrame, kind: str, parent: str, tree: dict | list) -> DataFrame:
    """``taxonomy`` (kind, path) with a tree of new nodes below ``parent`` ("": as roots); paths that are there stay once."""
    rows = [(kind, f"{parent} / {p}" if parent else p) for p in flatten_tree(tree)]
    return taxonomy.select("kind", "path").unionByName(taxonomy.sparkSession.createDataFrame(rows, "kind string, path string")).distinct()


def edited(taxonomy: DataFrame, removed: list[tuple[str, str]], added: list[tuple[str, str, dict | list]]) -> DataFrame:
    """``taxonomy`` after edits: subtrees (kind, path) go, then trees (kind, parent, tree) come."""
    for kind, path in removed:
        taxonomy = taxonomy.filter((F.col("kind") != kind) | ((F.col("path") != path) & ~F.startswith("path", F.lit(f"{path} / "))))
    for kind, parent, tree in added:
        taxonomy = with_subtree(taxonomy, kind, parent, tree)
    return taxonomy


def json_cell(value):
    """A struct, map or array column as JSON with sorted keys, a space after commas and colons, and characters as they are."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False), na_action="ignore")

    return run(F.to_json(value, {"ignoreNullFields": "false"}))


def write_json_array(df: DataFrame, path: str, indent: int = 2) -> int:
    """One local JSON array, for readers that take no JSON lines: rows come to the driver one partition at a time. Returns their number."""
    n = 0
    with atomic(path) as f:
        for n, row in enumerate(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator(), 1):
            text = json.dumps(json.loads(row[0]), indent=indent, ensure_ascii=False)
            f.write(("[\n" if n == 1 else ",\n") + "\n".join(" " * indent + line for line in text.splitlines()))
        f.write("\n]\n" if n else "[]\n")
    return n


@contextmanager
def atomic(path: str):
    """A local file to write that takes the place of ``path`` when all is written; after an error ``path`` is as it was."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder, prefix=".part-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            yield f
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def replace_table(df: DataFrame, path: str) -> None:
    """Writes ``df`` beside the table ``path``, then puts it in its place; a failed write leaves the table as it was. ``df`` may read the table."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    hadoop = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = hadoop(path).getFileSystem(conf)
    new, old = f"{path}.new", f"{path}.old"
    if not fs.exists(hadoop(path)) and fs.exists(hadoop(old)):
        fs.rename(hadoop(old), hadoop(path))  # a run ended between the two renames
    fs.delete(hadoop(new), True)
    df.write.parquet(new)
    fs.delete(hadoop(old), True)
    if fs.exists(hadoop(path)):
        fs.rename(hadoop(path), hadoop(old))
    fs.rename(hadoop(new), hadoop(path))
    fs.delete(hadoop(old), True)


def report_text(title: str, counts: DataFrame) -> str:
    """The columns of a one-row table of counts as lines of text."""
    row = counts.first().asDict()
    wide = max(map(len, row), default=0)
    return "\n".join([title, "=" * len(title), *(f"{k.ljust(wide)}  {v}" for k, v in row.items())]) + "\n"


def observed(df: DataFrame, name: str, **metrics):
    """``df`` and an Observation whose ``get`` has the metrics (aggregate columns) once an action on it has run."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, *[m.alias(k) for k, m in metrics.items()]), seen


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"', nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_csv_if_any(df: DataFrame, path: str) -> bool:
    if df.isEmpty():
        return False
    write_csv(df, path)
    return True


def write_by(df: DataFrame, path: str, column: str) -> None:
    """A folder for each value of ``column``."""
    df.write.mode("overwrite").partitionBy(column).json(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with rows of the same keys replaced by those of ``new``, and the rest of ``new``."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def latest(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The last row of each key."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), sequence).alias("r")).select(*keys, "r.*")
