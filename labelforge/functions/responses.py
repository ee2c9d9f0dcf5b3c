"""Parsers and validators of model responses as column expressions.

JSON syntax is tested by a pandas UDF around ``json.loads``, since the JVM's
parser lets text after an object pass; field access stays in the JVM, but for
debate replies, whose fields come from the same parse.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

PATHS = "struct<genre_paths:array<string>,metadata_paths:array<string>>"


def _kind(value) -> str:
    if isinstance(value, list):
        return "list" if all(isinstance(x, str) for x in value) else "mixed"
    return "string" if isinstance(value, str) else "other"


@F.pandas_udf(StringType())
def shape(text: pd.Series) -> pd.Series:
    """"bad", "other" (no object) or "object" with the kinds of the two path fields."""

    def one(raw):
        if raw is None:
            return None
        try:
            found = json.loads(raw)
        except ValueError:
            return "bad"
        if not isinstance(found, dict):
            return "other"
        return "object:" + ",".join(f"{k}={_kind(found[k])}" for k in ("genre_paths", "metadata_paths") if k in found)

    return text.map(one, na_action="ignore")


def unfenced(raw: Column) -> Column:
    """Without a Markdown fence around all of it."""
    text = F.regexp_replace(F.trim(raw), r"^(?i)```(?:json)?[ \t]*\r?\n", "")
    return F.trim(F.when(F.startswith(F.trim(raw), F.lit("```")), F.regexp_replace(text, r"\r?\n?[ \t]*```$", "")).otherwise(F.trim(raw)))


def braces(text: Column) -> Column:
    """From the first opening to the last closing brace; null if there is no such span."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def strict_annotation(raw: Column) -> Column:
    """Struct of ``error`` (the first rule broken, else null) and the paths. Explicit empty lists are valid."""
    body = braces(unfenced(raw))
    form = shape(body)
    has = lambda k: F.contains(form, F.lit(f"{k}="))
    error = (
        F.when(raw.isNull() | (F.trim(raw) == ""), "empty_response")
        .when(body.isNull(), "incomplete_or_non_json")
        .when(form == "bad", "malformed_json")
        .when(form == "other", "not_an_object")
        .when(~(has("genre_paths") & has("metadata_paths")), "missing_keys")
        .when(F.rlike(form, F.lit("genre_paths=(string|other)")), "genre_paths_not_list")
        .when(F.rlike(form, F.lit("metadata_paths=(string|other)")), "metadata_paths_not_list")
        .when(F.contains(form, F.lit("genre_paths=mixed")), "genre_paths_not_strings")
        .when(F.contains(form, F.lit("metadata_paths=mixed")), "metadata_paths_not_strings")
    )
    parsed = F.when(error.isNull(), F.from_json(body, PATHS))
    return F.struct(error.alias("error"), parsed["genre_paths"].alias("genre_paths"), parsed["metadata_paths"].alias("metadata_paths"))


def lenient_object(raw: Column) -> Column:
    """A fenced block's object, else the outermost braces; "{}" where that is no JSON."""
    fenced = F.nullif(F.regexp_extract(raw, r"(?is)```json\s*(\{.*?\})\s*```", 1), F.lit(""))
    body = F.coalesce(fenced, braces(raw))
    return F.when(F.startswith(shape(body), F.lit("object")), body).otherwise(F.lit("{}"))


def _text(value) -> str | None:
    """A string, or another value's JSON; half a surrogate pair, which JSON may escape and UTF-8 can't hold, becomes "?"."""
    if value is None:
        return None
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return text.encode("utf-8", "replace").decode()


def _reply(raw: str) -> dict | None:
    """The fields of the object from the first opening to the last closing brace, ``object`` false if that is no JSON; None without such a span. A fence holds no brace."""
    start, end = raw.find("{"), raw.rfind("}")
    if start < 0 or end < start:
        return None
    try:
        found = json.loads(raw[start : end + 1])
    except (ValueError, RecursionError):
        return {"object": False}
    tags = found.get("evidence_tags")
    texts = [_text(x) for x in tags] if isinstance(tags, list) else []
    return {
        "object": True,
        "listed": tags is None or isinstance(tags, list),
        "decision": (_text(found.get("decision")) or "").strip(" ").upper(),
        "evidence_tags": [x.strip(" ") for x in texts if x and x.strip(" ")],
        "justification": (_text(found.get("justification")) or "").strip(" "),
    }


REPLY = StructType().add("object", BooleanType()).add("listed", BooleanType()).add("decision", StringType()).add("evidence_tags", ArrayType(StringType())).add("justification", StringType())
ARROW_REPLY = pa.struct({"object": pa.bool_(), "listed": pa.bool_(), "decision": pa.string(), "evidence_tags": pa.list_(pa.string()), "justification": pa.string()})


@F.arrow_udf(ArrayType(REPLY))
def reply_fields(raws: pa.Array) -> pa.Array:
    """``_reply`` of each text of an array; texts that are equal within a batch are parsed once."""
    held = raws.flatten().dictionary_encode()
    found = pa.array([_reply(x) for x in held.dictionary.to_pylist()], ARROW_REPLY).take(held.indices)
    ends = np.cumsum(raws.value_lengths().fill_null(0), dtype=np.int32)
    return pa.ListArray.from_arrays(np.append(np.int32(0), ends), found, mask=raws.is_null())


def debate_replies(raws: Column, allowed: list[str], tags: Column) -> Column:
    """For each of an array of replies to one debate, in order: struct of error, decision, evidence_tags and justification. A reply is parsed once, whatever is asked of it; no rows have to be grouped."""

    def judged(x: Column) -> Column:
        error = (
            F.when(x["object"].isNull(), "no_object")
            .when(~x["object"], "not_an_object")
            .when(~x["decision"].isin(allowed), "bad_decision")
            .when(~x["listed"], "evidence_not_list")
            .when(F.size(F.array_except(x["evidence_tags"], tags)) > 0, "unknown_evidence")
            .when(x["justification"] == "", "no_justification")
        )
        return F.struct(error.alias("error"), x.alias("said"))

    def told(x: Column) -> Column:
        return F.struct(x["error"].alias("error"), *[F.when(x["error"].isNull(), x["said"][c]).alias(c) for c in ("decision", "evidence_tags", "justification")])

    return F.transform(F.transform(reply_fields(raws), judged), told)


def debate_reply(raw: Column, allowed: list[str], tags: Column) -> Column:
    """``debate_replies`` of one reply."""
    return debate_replies(F.array(raw), allowed, tags)[0]


def annotation_error(genres: Column, metadata: Column, all_genres: Column, all_metadata: Column, allowed_genres: Column | None = None, allowed_metadata: Column | None = None) -> Column:
    """The first rule that a parsed annotation breaks, else null."""
    roots = F.array_distinct(F.filter(F.transform(genres, lambda p: F.split(p, " / ")[0]), lambda r: r.isin("Fiction", "Nonfiction")))
    rules = F.when(F.size(F.array_except(genres, all_genres)) > 0, "invalid_genre").when(F.size(F.array_except(metadata, all_metadata)) > 0, "invalid_metadata")
    if allowed_genres is not None:
        rules = rules.when(F.size(F.array_except(genres, allowed_genres)) > 0, "genre_outside_candidates").when(F.size(F.array_except(metadata, allowed_metadata)) > 0, "metadata_outside_candidates")
    return rules.when(F.size(roots) > 1, "both_roots")
