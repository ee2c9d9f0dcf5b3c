"""Text normalisation as column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Language codes, publication places, noise tags, words that don't count in scoring.
LANGUAGES = {
    "eng": "English", "fre": "French", "fra": "French", "ger": "German", "deu": "German", "spa": "Spanish",
    "ita": "Italian", "hin": "Hindi", "jpn": "Japanese", "kor": "Korean", "chi": "Chinese", "zho": "Chinese",
}
PLACES = {
    "new york": "United States", "new york, n.y.": "United States", "new york, ny": "United States", "boston": "United States",
    "chicago": "United States", "san francisco": "United States", "london": "United Kingdom", "oxford": "United Kingdom",
    "cambridge": "United Kingdom", "toronto": "Canada", "montreal": "Canada", "new delhi": "India", "delhi": "India",
    "mumbai": "India", "bombay": "India", "kolkata": "India", "calcutta": "India", "chennai": "India", "madras": "India",
}
NOISE_TAGS = [
    "to-read", "currently-reading", "owned", "favorites", "favourites", "favorite-books", "books-i-own", "ebook", "ebooks",
    "kindle", "kindle ebooks", "audiobook", "audiobooks", "paperback", "hardcover",
]
SCORING_STOP_WORDS = [
    "fiction", "nonfiction", "book", "books", "story", "stories", "form", "general", "context", "metadata", "audience",
    "textual", "narrative", "thematic",
]


def collapse(x: Column) -> Column:
    """White space (in the Unicode sense) collapsed to single spaces, trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def clean(x: Column) -> Column:
    """Collapsed text; blank is null."""
    return F.nullif(collapse(x), F.lit(""))


def clean_or_empty(x: Column) -> Column:
    return F.coalesce(collapse(x), F.lit(""))


@F.pandas_udf(StringType())
def unescape(x: pd.Series) -> pd.Series:
    """HTML entities resolved; the JVM has no such function."""
    return x.map(html.unescape, na_action="ignore")


def clean_html(x: Column) -> Column:
    """Entities resolved, then ``clean``; texts without an ampersand skip Python's work."""
    return clean(F.when(F.contains(x, F.lit("&")), unescape(x)).otherwise(x))


def fold(x: Column) -> Column:
    """Case key: full upper case, then lower case, so that ß equals ss. The step between keeps the optimizer from dropping the upper case."""
    return F.lower(F.replace(F.upper(x), F.lit("ẞ"), F.lit("SS")))


def dedup_folded(values: Column) -> Column:
    """Cleaned, non-empty values, the first of each case key kept, in order."""
    cleaned = F.filter(F.transform(values, clean), lambda x: x.isNotNull())
    return F.aggregate(
        cleaned,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: fold(y) == fold(x)), acc).otherwise(F.concat(acc, F.array(x))),
    )


def split_pipe(x: Column) -> Column:
    return dedup_folded(F.split(F.coalesce(x, F.lit("")), r"\|"))


def join_pipe(values: Column) -> Column:
    return F.array_join(dedup_folded(F.coalesce(values, F.array().cast("array<string>"))), " | ")


def tokens(x: Column) -> Column:
    """Distinct runs of ASCII letters and digits of the case-folded text."""
    return F.array_distinct(F.regexp_extract_all(fold(x), F.lit("[a-z0-9]+"), 0))


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for pair in table.items() for v in pair])


def language_name(code: Column) -> Column:
    """Name of a known code, else the value itself; empty is null."""
    return F.when(code == "", F.lit(None)).otherwise(F.coalesce(_lookup(LANGUAGES)[F.lower(code)], code))


def language_label(x: Column) -> Column:
    """Without a leading label "Language"."""
    return clean(F.regexp_replace(x, r"(?i)^language\s*[:\-]?\s*", ""))


def country_of(places: Column) -> Column:
    """Country of the first place that is known, or starts with a known place and " :"."""
    key = lambda p: F.regexp_replace(fold(clean_or_empty(p)), r"^[ .]+|[ .]+$", "")

    def one(p: Column) -> Column:
        k = key(p)
        begun = [F.when(F.startswith(k, F.lit(f"{place} :")), F.lit(country)) for place, country in PLACES.items()]
        return F.coalesce(_lookup(PLACES)[k], *begun)

    return F.element_at(F.concat(F.filter(F.transform(places, one), lambda c: c.isNotNull()), F.array(F.lit(None).cast("string"))), 1)


def has_value(x: Column) -> Column:
    return x.isNotNull() & (x != "")


def https(x: Column) -> Column:
    return F.regexp_replace(x, "^http://", "https://")


def debate_id(isbn13: Column, kind: Column, path: Column) -> Column:
    return F.concat_ws("__", isbn13.cast("string"), kind, path)


def quota_exhausted(error: Column) -> Column:
    low = F.lower(error)
    return F.contains(low, F.lit("429")) & (F.contains(low, F.lit("tokens per day")) | F.contains(low, F.lit("(tpd)")))


def is_quota(error: str) -> bool:
    """``quota_exhausted`` of a text at hand, where a provider is being called."""
    low = error.lower()
    return "429" in low and ("tokens per day" in low or "(tpd)" in low)


def strip_root(path: Column, root: str) -> Column:
    return F.regexp_replace(path, f"^{root} / ", "")
