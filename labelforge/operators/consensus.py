"""Path-level hierarchical consensus, dispute profiles and book-level routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelforge.fixtures import FIELDS, MODELS
from labelforge.functions import paths as P
from labelforge.operators import agreement as A
from labelforge.operators.ordinals import with_ordinal

CATEGORIES = ("unanimous", "majority", "hierarchical_singleton", "isolated_singleton")
KEY = ["isbn13", "field"]
#: Reasons for which a single vote goes to review.
REVIEWED = ("isolated_singleton", "singleton_extra_specificity")


def tiers(labels: DataFrame) -> DataFrame:
    """(isbn13, field, path, votes, tier): votes 3 is unanimous, 2 a majority."""
    votes = F.col("votes")
    return A.path_support(labels).select(*KEY, "path", "votes", F.when(votes == 3, "unanimous").when(votes == 2, "majority").otherwise("single").alias("tier"))


def with_ancestors(rows: DataFrame) -> DataFrame:
    """``rows`` with ``above``: strict prefixes of path."""
    return rows.withColumn("above", P.proper_prefixes(F.col("path")))


#: Steps over a book's few paths (annotators times labels): each adds a column to those before it. A path is
#: strong if two or more models chose it or a path below it; the deepest strong paths are canonical, since a strong path
#: above another is either a candidate that is not the most specific or an accepted path that is pruned.
_STEPS = {
    "strong": "transform(filter(votes, v -> bit_count(v.under) >= 2), v -> v.path)",
    "canonical": "filter(strong, p -> not exists(strong, o -> startswith(o, concat(p, ' / '))))",
    "review": """transform(filter(votes, v -> bit_count(v.exact) = 1), v -> struct(v.path as path, cast(length(bin(v.exact)) - 1 as int) as m, case
        when array_contains(canonical, v.path) then 'singleton_hierarchy_supported_canonical'
        when exists(canonical, c -> startswith(c, concat(v.path, ' / '))) then 'singleton_redundant_ancestor'
        when exists(canonical, c -> startswith(v.path, concat(c, ' / '))) then 'singleton_extra_specificity'
        else 'isolated_singleton' end as reason))""",
}


def _models(mask: str):
    """The models of a mask, in order."""
    return F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.getbit(F.col(mask), i) == 1)


def path_masks(labels: DataFrame) -> DataFrame:
    """(isbn13, field, path, exact, under) of each observed path: bit m tells that model m chose it, or it or a path below it. Models are whole numbers from 0 to 62."""
    bit = F.expr("shiftleft(1L, m)")
    at = F.explode(F.concat(F.array(F.struct(F.col("path").alias("path"), F.lit(True).alias("own"))), F.transform(P.proper_prefixes(F.col("path")), lambda p: F.struct(p.alias("path"), F.lit(False).alias("own")))))
    rows = labels.select(*KEY, bit.alias("bit"), at.alias("at")).select(*KEY, "at.path", "at.own", "bit")
    return rows.groupBy(*KEY, "path").agg(F.expr("bit_or(if(own, bit, 0L))").alias("exact"), F.expr("bit_or(bit)").alias("under")).filter("exact <> 0")


def book_consensus(labels: DataFrame) -> DataFrame:
    """(isbn13, field, votes, strong, canonical, review): all path decisions of a book; labels that are dealt by book need no further shuffle."""
    held = path_masks(labels).groupBy(*KEY).agg(F.collect_list(F.struct("path", "exact", "under")).alias("votes"))
    for name, step in _STEPS.items():
        held = held.withColumn(name, F.expr(step))
    return held


def _consensus(rows: DataFrame) -> DataFrame:
    """``book_consensus`` of labels; what is one already stays."""
    return rows if "canonical" in rows.columns else book_consensus(rows)


def ancestor_support(labels: DataFrame) -> DataFrame:
    """(isbn13, field, path, supporters): models that chose an observed path or one below it."""
    return path_masks(labels).select(*KEY, "path", _models("under").alias("supporters"))


def hierarchical_candidates(labels: DataFrame) -> DataFrame:
    """Observed paths without an exact majority that two or more models support, counting choosers of descendants; unobserved common ancestors never appear."""
    return path_masks(labels).filter("bit_count(exact) < 2 and bit_count(under) >= 2").select(*KEY, "path", _models("under").alias("supporters"))


def pruned(rows: DataFrame) -> DataFrame:
    """(isbn13, field, path) of ``rows`` without those that have a strict descendant among them, by one grouping of a book's paths."""
    held = rows.groupBy(*KEY).agg(F.collect_set("path").alias("paths"))
    return held.select(*KEY, F.explode(P.without_redundant_ancestors(F.col("paths"))).alias("path"))


def canonical(labels: DataFrame) -> DataFrame:
    """(isbn13, field, path): exact majorities and the most specific hierarchical candidates that add something, pruned."""
    return _consensus(labels).select(*KEY, F.explode("canonical").alias("path"))


def singleton_review(labels: DataFrame) -> DataFrame:
    """(isbn13, field, path, m, reason) for each path with one vote."""
    return _consensus(labels).select(*KEY, F.inline("review"))


def resolved_table(labels: DataFrame) -> DataFrame:
    """(isbn13, field, path, m, reason, canonical_paths) of single votes that need no review, beside what their book keeps."""
    settled = ("singleton_hierarchy_supported_canonical", "singleton_redundant_ancestor")
    rows = book_consensus(labels).select(*KEY, F.concat_ws(" | ", F.array_sort("canonical")).alias("canonical_paths"), F.inline("review"))
    return rows.filter(F.col("reason").isin(*settled)).select(*KEY, "path", "m", "reason", "canonical_paths")


def all_abstain(presence: DataFrame, labels: DataFrame) -> DataFrame:
    """(isbn13, field) of books with a success where no model chose anything."""
    books = A.successes(presence).select("isbn13").distinct().select("isbn13", F.explode(F.array(*map(F.lit, FIELDS))).alias("field"))
    return books.join(labels.select(*KEY).distinct(), KEY, "left_anti")


def stats(presence: DataFrame, labels: DataFrame) -> DataFrame:
    """(field, metric, n)."""
    count = lambda df, metric: df.groupBy("field", metric.alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    found = count(tiers(labels), F.concat(F.col("tier"), F.lit("_paths")))
    found = found.unionByName(count(hierarchical_candidates(labels), F.lit("hierarchical_paths"))).unionByName(count(canonical(labels), F.lit("canonical_paths")))
    return found.unionByName(count(singleton_review(labels), F.col("reason"))).unionByName(count(all_abstain(presence, labels), F.lit("all_models_abstain")))


def dispute_profile(labels: DataFrame) -> DataFrame:
    """(isbn13, field, path, votes, category, depth, voters): a lone path is hierarchical if another model has an ancestor or descendant of it."""
    related = A.ancestor_pairs(labels).select(*KEY, F.explode(F.array("ancestor", "descendant")).alias("path")).distinct().withColumn("related", F.lit(True))
    category = F.when(F.col("votes") == 3, CATEGORIES[0]).when(F.col("votes") == 2, CATEGORIES[1]).when(F.col("related"), CATEGORIES[2]).otherwise(CATEGORIES[3])
    return A.path_support(labels).join(related, [*KEY, "path"], "left").select(*KEY, "path", "votes", category.alias("category"), P.depth(F.col("path")).cast("long").alias("depth"), F.array_join(F.transform("voters", lambda v: v.cast("string")), ",").alias("voters"))


def dispute_rates(profile: DataFrame) -> DataFrame:
    """(field, category, n, rate): all categories listed."""
    spark = profile.sparkSession
    dim = spark.range(1).select(F.explode(F.array(*map(F.lit, FIELDS))).alias("field")).select("field", F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category"))
    n = F.coalesce("n", F.lit(0))
    counts = dim.join(profile.groupBy("field", "category").agg(F.count(F.lit(1)).alias("n")), ["field", "category"], "left").withColumn("n", n)
    total = F.sum("n").over(Window.partitionBy("field"))
    return counts.select("field", "category", "n", F.round(F.when(total == 0, 0.0).otherwise(F.col("n") / total), 6).alias("rate"))


def book_presence(presence: DataFrame, labels: DataFrame) -> DataFrame:
    """(field, category, books), with books where all abstain."""
    held = dispute_profile(labels).groupBy("field", "category").agg(F.count_distinct("isbn13").alias("books"))
    return held.unionByName(all_abstain(presence, labels).groupBy("field").agg(F.count(F.lit(1)).alias("books")).withColumn("category", F.lit("all_models_abstain")))


def adjudication_sheet(labels: DataFrame, reasons: tuple[str, ...] = REVIEWED) -> DataFrame:
    """Numbered cases for review with blank decision columns."""
    rows = singleton_review(labels).filter(F.col("reason").isin(*reasons)).persist()  # read twice: once to sample the ranges
    ranked = with_ordinal(rows, "field", ["isbn13", "path", "m"], "k")
    name = F.when(F.col("field") == "genre", "GENRE").otherwise("META")
    blank = [F.lit("").alias(c) for c in ("decision", "confidence", "rationale")]
    return ranked.select(F.concat(name, F.lit("-"), F.when(F.col("k") > 9999, F.col("k").cast("string")).otherwise(F.lpad(F.col("k").cast("string"), 4, "0"))).alias("case_id"), *KEY, "path", "m", "reason", *blank)


def book_routes(presence: DataFrame, labels: DataFrame, without_tags: DataFrame | None = None) -> DataFrame:
    """(isbn13, available, signatures, route): exact agreement of whole annotations. Books in ``without_tags`` (isbn13) were never annotated for lack of tags."""
    signed = A.label_sets(presence, labels).groupBy("isbn13", "genre", "metadata").agg(F.count(F.lit(1)).alias("n"))
    counted = signed.groupBy("isbn13").agg(F.sum("n").alias("available"), F.count(F.lit(1)).alias("signatures"))
    every = A.availability(presence).select("isbn13").join(counted, "isbn13", "left").fillna(0, ["available", "signatures"])
    a, s = F.col("available"), F.col("signatures")
    route = F.when(a < 2, "insufficient_models").when((a == 3) & (s == 1), "perfect_3_of_3").when((a == 3) & (s == 2), "agreement_2_of_3").when((a == 2) & (s == 1), "agreement_2_of_2").when(a == 3, "conflict_3_original_models").otherwise("conflict_2_original_models")
    if without_tags is not None:
        every = every.join(without_tags.select("isbn13").distinct().withColumn("bare", F.lit(True)), "isbn13", "left")
        route = F.when(F.col("bare"), "no_filtered_tags").otherwise(route)
    return every.select("isbn13", a.cast("long").alias("available"), s.cast("long").alias("signatures"), route.alias("route"))


def majority_signature(presence: DataFrame, labels: DataFrame) -> DataFrame:
    """(isbn13, genre, metadata, n): the most frequent whole annotation of a book, ties to the one that sorts last."""
    signed = A.label_sets(presence, labels).groupBy("isbn13", "genre", "metadata").agg(F.count(F.lit(1)).alias("n"))
    return signed.groupBy("isbn13").agg(F.max(F.struct("n", "genre", "metadata")).alias("s")).select("isbn13", "s.genre", "s.metadata", "s.n")


def shared_disputed(presence: DataFrame, labels: DataFrame) -> DataFrame:
    """(isbn13, field, path, kind, only_m): shared by all available models, else disputed; only_m if one model alone has it."""
    rows = A.path_support(labels).join(A.availability(presence), "isbn13")
    return rows.select(*KEY, "path", F.when(F.col("votes") == F.col("available"), "shared").otherwise("disputed").alias("kind"), F.when(F.col("votes") == 1, F.element_at("voters", 1)).alias("only_m"))


def path_conflicts(presence: DataFrame, labels: DataFrame) -> DataFrame:
    """Disputes of complete books: (debate_id, isbn13, annotation_type, path, support_count, models_for, models_against)."""
    from labelforge.functions.text import debate_id

    every = F.array(*map(F.lit, MODELS))
    rows = A.path_support(labels).join(A.complete_books(presence), "isbn13", "left_semi")
    kind = F.initcap("field")
    return rows.select(debate_id(F.col("isbn13"), kind, F.col("path")).alias("debate_id"), "isbn13", kind.alias("annotation_type"), "path", F.col("votes").alias("support_count"), F.col("voters").alias("models_for"), F.array_except(every, "voters").alias("models_against"))
