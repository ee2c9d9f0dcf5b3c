"""Merging source records, tag evidence, and candidate retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.functions import paths as P
from labelforge.functions import text as T

SOURCES = ("OpenLibrary", "Goodreads", "Amazon")


def latest_records(records: DataFrame) -> DataFrame:
    """The last record of each (isbn13, source)."""
    others = [c for c in records.columns if c not in ("isbn13", "source")]
    return records.groupBy("isbn13", "source").agg(F.max_by(F.struct(*others), "ingest_seq").alias("r")).select("isbn13", "source", "r.*")


def merged(records: DataFrame, isbns: DataFrame | None = None) -> DataFrame:
    """One row for each book: a struct column for each source (null where it has no record).

    ``isbns`` (isbn13) are the books asked for; those without any record stay, others go. Without it every book with a record is there.
    """
    fields = [c for c in records.columns if c not in ("isbn13", "source", "ingest_seq")]
    found = latest_records(records).groupBy("isbn13").pivot("source", list(SOURCES)).agg(F.first(F.struct(*fields)))
    return found if isbns is None else isbns.select("isbn13").join(found.hint("merge"), "isbn13", "left")  # whole records are not broadcast


def first_value(field: str, cleaned: bool = True, order: tuple[str, ...] = SOURCES) -> tuple[Column, Column]:
    """(value, source) of the first source that has one; texts are cleaned before the choice."""
    value = lambda s: T.clean(F.col(s)[field]) if cleaned else F.col(s)[field]
    return F.coalesce(*map(value, order)), F.coalesce(*[F.when(value(s).isNotNull(), F.lit(s)) for s in order])


def available_sources() -> Column:
    return F.filter(F.array(*[F.when(F.col(s).isNotNull(), F.lit(s)) for s in SOURCES]), lambda x: x.isNotNull())


#: Fields that are texts, with the order of sources for each.
TEXTS = dict.fromkeys(("title", "publisher", "country", "date_of_publication", "language", "physical_format"), SOURCES) | {"cover_url": ("Goodreads", "Amazon", "OpenLibrary")}


def first_list(field: str, order: tuple[str, ...] = SOURCES) -> Column:
    """The first source's list that is not empty, cleaned, the first of each case key; else an empty list."""
    lists = [F.when(F.size(F.col(s)[field]) > 0, T.dedup_folded(F.col(s)[field])) for s in order]
    return F.coalesce(*lists, F.array().cast("array<string>"))


def merged_lists(*lists: Column) -> Column:
    """All lists after one another, cleaned, the first of each case key."""
    none = F.array().cast("array<string>")
    return T.dedup_folded(F.concat(*[F.coalesce(x, none) for x in lists]))


def _told(values: Column, source: str) -> Column:
    texts = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), T.clean), lambda x: x.isNotNull())
    return F.transform(texts, lambda x: F.struct(F.lit(source).alias("source"), x.alias("text")))


def blurbs() -> Column:
    """(source, text) of each source's blurb."""
    return F.concat(*[_told(F.array(F.col(s)["blurb"]), s) for s in SOURCES])


def reviews() -> Column:
    """(source, text) of each source's reviews, repeated ones too."""
    return F.concat(*[_told(F.col(s)["reviews"], s) for s in SOURCES])


def master(records: DataFrame, isbns: DataFrame | None = None) -> DataFrame:
    """A book's merged record: fields with the source each came from, available_sources, source_count, genre evidence by source, blurbs and reviews.

    Fields that ``records`` lacks are left out.
    """
    has = set(records.columns)
    texts = {f: first_value(f, order=order) for f, order in TEXTS.items() if f in has}
    pages = first_value("number_of_pages", cleaned=False)
    named = texts | {"number_of_pages": pages}
    lists = [first_list(f).alias(f) for f in ("authors", "publication_place") if f in has]
    told = [column().alias(name) for name, column, field in (("blurbs", blurbs, "blurb"), ("reviews", reviews, "reviews")) if field in has]
    return merged(records, isbns).select(
        "isbn13",
        *[v.alias(k) for k, (v, _) in named.items()],
        *[s.alias(f"{k}_source") for k, (_, s) in named.items()],
        *lists,
        available_sources().alias("available_sources"),
        F.size(available_sources()).cast("long").alias("source_count"),
        *[T.dedup_folded(F.coalesce(F.col(s)["tags"], F.array().cast("array<string>"))).alias(f"{s.lower()}_genres") for s in SOURCES],
        *told,
    )


def flat_master(found: DataFrame) -> DataFrame:
    """The 17 text columns of a master table; lists are joined by " | " and missing values are blank."""
    blank = lambda c: F.coalesce(T.clean(F.col(c).cast("string")), F.lit("")).alias(c)
    texts = lambda c: T.join_pipe(F.transform(c, lambda x: x["text"])).alias(c)
    lists = lambda c: T.join_pipe(F.col(c)).alias(c)
    return found.select(
        "isbn13", blank("title"), lists("authors"), blank("publisher"), blank("country"), lists("publication_place"), blank("date_of_publication"), blank("language"),
        blank("number_of_pages"), blank("physical_format"), *[lists(f"{s.lower()}_genres") for s in SOURCES], texts("blurbs"), texts("reviews"), lists("available_sources"), "source_count",
    )


def _source_tags(records: DataFrame) -> DataFrame:
    """(isbn13, r, source, key, pos, tag): each source's cleaned tags, the first of each case key."""
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    rows = latest_records(records).select("isbn13", "source", rank.alias("r"), F.posexplode("tags").alias("pos", "raw")).withColumn("tag", T.clean(F.col("raw"))).filter("tag is not null")
    first = rows.groupBy("isbn13", "source", "r", T.fold(F.col("tag")).alias("key")).agg(F.min(F.struct("pos", "tag")).alias("first"))
    return first.select("isbn13", "r", "source", "key", "first.pos", "first.tag")


def tag_provenance(records: DataFrame) -> DataFrame:
    """(isbn13, tag, sources): the sources that have exactly this spelling, in order of sources."""
    held = _source_tags(records).groupBy("isbn13", "tag").agg(F.array_sort(F.collect_set(F.struct("r", "source"))).alias("s"))
    return held.select("isbn13", "tag", F.array_join(F.transform("s", lambda x: x["source"]), ",").alias("sources"))


def merged_tags(records: DataFrame) -> DataFrame:
    """(isbn13, tag): of each case key the first spelling, in order of sources."""
    return _source_tags(records).groupBy("isbn13", "key").agg(F.min_by("tag", F.struct("r", "pos")).alias("tag")).select("isbn13", "tag")


# Fixed value: why a noise tag goes.
NOISE_REASON = "Deterministic removal: format, reading-status, or storefront noise."


def noise_split(tags: DataFrame) -> DataFrame:
    """(isbn13, tag, noise, reason): noise tags carry the fixed reason."""
    noise = T.fold(F.trim("tag")).isin(T.NOISE_TAGS)
    return tags.select("isbn13", "tag", noise.alias("noise"), F.when(noise, NOISE_REASON).alias("reason"))


def validated_filter(candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """Closed-set filtering: (isbn13, tag, kept, reason).

    ``candidates``: (isbn13, tag); ``replies``: (isbn13, tag, action, reason), in any case. Keep beats
    remove, tags not mentioned stay, invented tags are ignored, a blank reason gets the fixed one.
    """
    said = replies.groupBy("isbn13", T.fold(F.trim("tag")).alias("key")).agg(F.max(F.col("action") == "keep").alias("keep"), F.max(F.when(F.col("action") == "remove", F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit("Removed by filtering model.")))).alias("reason"))
    joined = candidates.withColumn("key", T.fold(F.col("tag"))).join(said, ["isbn13", "key"], "left")
    kept = F.coalesce("keep", F.lit(False)) | F.col("reason").isNull()
    return joined.select("isbn13", "tag", kept.alias("kept"), F.when(~kept, F.col("reason")).alias("reason"))


def candidate_scores(tags: DataFrame, taxonomy: DataFrame, strict_leaf: bool = False) -> DataFrame:
    """(isbn13, kind, path, score): best score over a book's tags, by equi-joins on leaf and token.

    1 if a tag equals the leaf but for case; else the F1 of their tokens
    without stop words. Paths that share no token score 0 and are left out.
    """
    leaf = F.element_at(P.parts(F.col("path")), -1) if strict_leaf else P.loose_leaf(F.col("path"))
    free = lambda x: F.array_except(T.tokens(x), F.array(*map(F.lit, T.SCORING_STOP_WORDS)))
    nodes = taxonomy.select("kind", "path", T.fold(leaf).alias("leaf"), free(leaf).alias("leaf_tokens"))
    asked = tags.select("isbn13", "tag").distinct().select("isbn13", "tag", T.fold(F.trim("tag")).alias("leaf"), free(F.col("tag")).alias("tag_tokens"))
    exact = asked.join(nodes, "leaf").select("isbn13", "kind", "path", F.lit(1.0).alias("score"))
    words = nodes.select("kind", "path", F.size("leaf_tokens").alias("nl"), F.explode("leaf_tokens").alias("token"))
    # Paths per distinct tag, not per book: tags recur across books.
    distinct = asked.select("tag", "tag_tokens").distinct()
    shared = distinct.select("tag", F.size("tag_tokens").alias("nt"), F.explode("tag_tokens").alias("token")).join(words, "token").groupBy("tag", "nt", "kind", "path", "nl").agg(F.count(F.lit(1)).alias("n"))
    f1 = F.col("n") * 2.0 / (F.col("nl") + F.col("nt"))
    partial = asked.select("isbn13", "tag").join(shared.select("tag", "kind", "path", f1.alias("score")), "tag").select("isbn13", "kind", "path", "score")
    return exact.unionByName(partial).groupBy("isbn13", "kind", "path").agg(F.max("score").alias("score"))


def candidates(tags: DataFrame, taxonomy: DataFrame, limits: dict[str, int], least: float = 0.48) -> DataFrame:
    """(isbn13, kind, path): the best paths by (score, path) descending; genres of a root without evidence go, roots with evidence are added after the cut."""
    from pyspark.sql import Window

    by = Window.partitionBy("isbn13", "kind").orderBy(F.col("score").desc(), F.col("path").desc())
    limit = F.create_map(*[F.lit(v) for kv in limits.items() for v in kv])[F.col("kind")]
    top = candidate_scores(tags, taxonomy).filter(F.col("score") >= least).withColumn("k", F.row_number().over(by)).filter(F.col("k") <= limit).select("isbn13", "kind", "path")
    flags = tags.groupBy("isbn13").agg(*[F.max(F.array_contains(T.tokens(F.col("tag")), w)).alias(w) for w in ("fiction", "nonfiction", "non")])
    non = F.col("nonfiction") | (F.col("non") & F.col("fiction"))
    roots = flags.select("isbn13", F.when(~F.col("fiction") & ~non, F.array(F.lit("Fiction"), F.lit("Nonfiction"))).otherwise(F.filter(F.array(F.when(F.col("fiction"), "Fiction"), F.when(non, "Nonfiction")), lambda x: x.isNotNull())).alias("roots"))
    root = F.split("path", " / ")[0]
    kept = top.join(roots, "isbn13").filter((F.col("kind") != "genre") | ~root.isin("Fiction", "Nonfiction") | F.array_contains("roots", root)).select("isbn13", "kind", "path")
    return kept.unionByName(roots.select("isbn13", F.lit("genre").alias("kind"), F.explode("roots").alias("path"))).distinct()
