"""Merging an edition's API record, edition, work and author records, given as JSON texts, into one source record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.functions import text as T

# Hosts of links and covers.
HOST, COVERS = "https://openlibrary.org", "https://covers.openlibrary.org/b/id/"


def _items(value: Column) -> Column:
    """Items of a JSON list as texts; anything else is an empty list."""
    return F.coalesce(F.when(F.startswith(F.ltrim(value), F.lit("[")), F.from_json(value, "array<string>")), F.array().cast("array<string>"))


def _is_object(value: Column) -> Column:
    return F.startswith(F.ltrim(value), F.lit("{"))


def description(value: Column) -> Column:
    """A text, or the ``value`` of an object."""
    return T.clean(F.when(_is_object(value), F.get_json_object(value, "$.value")).otherwise(value))


def names(value: Column) -> Column:
    """Names of a list's objects and its texts, the first of each case key."""
    return T.dedup_folded(F.transform(_items(value), lambda x: F.when(_is_object(x), F.get_json_object(x, "$.name")).otherwise(x)))


def keys(value: Column) -> Column:
    """Keys of a list's objects."""
    return T.dedup_folded(F.transform(_items(value), lambda x: F.when(_is_object(x), F.get_json_object(x, "$.key"))))


def edition_key(book: Column) -> Column:
    """From the first identifier, else from the record's URL without its query."""
    known = F.try_element_at(_items(F.get_json_object(book, "$.identifiers.openlibrary")), F.lit(1))
    url = T.clean(F.get_json_object(book, "$.url"))
    tail = F.when(F.contains(url, F.lit("/books/")), F.split_part(F.concat(F.lit("/"), F.element_at(F.split(url, f"{HOST}/", 2), -1)), F.lit("?"), F.lit(1)))
    return F.coalesce(F.concat(F.lit("/books/"), known), tail)


def cover(edition: Column, book: Column) -> Column:
    """From the edition's first cover number if it is positive, else the largest cover of the record."""
    first = F.try_element_at(_items(F.get_json_object(edition, "$.covers")), F.lit(1)).try_cast("long")
    given = [F.nullif(F.get_json_object(book, f"$.cover.{size}"), F.lit("")) for size in ("large", "medium", "small")]
    return F.coalesce(F.when(first > 0, F.concat(F.lit(COVERS), first.cast("string"), F.lit("-L.jpg"))), T.clean(F.coalesce(*given)))


def subjects(work: Column, edition: Column, book: Column) -> Column:
    """Subjects of the work, the edition and the record, the first of each case key."""
    return T.dedup_folded(F.concat(_items(F.get_json_object(work, "$.subjects")), _items(F.get_json_object(edition, "$.subjects")), names(F.get_json_object(book, "$.subjects"))))


def languages(edition: Column, book: Column) -> Column:
    """Names of the edition's language codes, else those of the record."""
    codes = F.transform(keys(F.get_json_object(edition, "$.languages")), lambda k: T.language_name(F.element_at(F.split(k, "/"), -1)))
    found = T.dedup_folded(codes)
    return F.when(F.size(found) > 0, found).otherwise(names(F.get_json_object(book, "$.languages")))


def merged(records: DataFrame) -> DataFrame:
    """Source records from ``records`` (isbn13, book, edition, work, author_names): JSON texts, null where a record is missing.

    ``author_names`` are those fetched for the edition's author keys, used where the record names no author.
    """
    book, edition, work = F.col("book"), F.col("edition"), F.col("work")
    of = F.get_json_object
    authors = names(of(book, "$.authors"))
    places = names(of(book, "$.publish_places"))
    places = F.when(F.size(places) > 0, places).otherwise(T.dedup_folded(_items(of(edition, "$.publish_places"))))
    first = lambda x: F.try_element_at(x, F.lit(1))
    publisher = F.coalesce(first(names(of(book, "$.publishers"))), first(T.dedup_folded(_items(of(edition, "$.publishers")))))
    spoken = languages(edition, book)
    return records.select(
        "isbn13",
        F.coalesce(T.clean(of(book, "$.title")), T.clean(of(edition, "$.title"))).alias("title"),
        F.when(F.size(authors) > 0, authors).otherwise(T.dedup_folded(F.coalesce("author_names", F.array().cast("array<string>")))).alias("authors"),
        publisher.alias("publisher"),
        T.country_of(places).alias("country"),
        places.alias("publication_place"),
        F.coalesce(T.clean(of(book, "$.publish_date")), T.clean(of(edition, "$.publish_date"))).alias("date_of_publication"),
        F.when(F.size(spoken) > 0, F.array_join(spoken, ", ")).alias("language"),
        of(edition, "$.number_of_pages").try_cast("int").alias("number_of_pages"),
        T.clean(of(edition, "$.physical_format")).alias("physical_format"),
        F.coalesce(description(of(work, "$.description")), description(of(edition, "$.description"))).alias("blurb"),
        cover(edition, book).alias("cover_url"),
        subjects(work, edition, book).alias("tags"),
        edition_key(book).alias("edition_key"),
        first(keys(of(edition, "$.works"))).alias("work_key"),
    )
