"""Agreement between annotators.

Inputs are a presence table (isbn13, m, status, abstain), which also knows
abstentions, and a long table of labels (isbn13, m, field, path). Everything
is keyed by (isbn13, field), so the aggregates and self-joins share that partitioning.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.fixtures import FIELDS, MODELS
from labelforge.functions import paths as P

EMPTY = "cast(array() as array<string>)"


def successes(presence: DataFrame) -> DataFrame:
    return presence.filter("status = 'success'").select("isbn13", "m")


def availability(presence: DataFrame) -> DataFrame:
    """(isbn13, available): books without a success have 0."""
    return presence.groupBy("isbn13").agg(F.count_if(F.col("status") == "success").alias("available"))


def complete_books(presence: DataFrame) -> DataFrame:
    return availability(presence).filter(F.col("available") == len(MODELS)).select("isbn13")


def model_bit():
    """The bit of a model, a whole number from 0 to 62, in a mask."""
    return F.when(F.col("m").between(0, 62), F.expr("shiftleft(1L, int(m))")).otherwise(F.raise_error(F.concat(F.lit("no model from 0 to 62: "), F.col("m").cast("string"))))


def path_support(labels: DataFrame) -> DataFrame:
    """(isbn13, field, path, votes, voters): distinct models for each exact path."""
    return labels.groupBy("isbn13", "field", "path").agg(F.array_sort(F.collect_set("m")).alias("voters")).withColumn("votes", F.size("voters").cast("long"))


def support_order(labels: DataFrame) -> DataFrame:
    """(isbn13, field, paths): a book's paths as an array of (path, votes), most votes first, then by path."""
    rows = path_support(labels).select("isbn13", "field", F.struct((-F.col("votes")).alias("by"), "path", "votes").alias("x"))
    return rows.groupBy("isbn13", "field").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.struct(x["path"].alias("path"), x["votes"].alias("votes"))).alias("paths"))


def support_groups(presence: DataFrame, labels: DataFrame) -> DataFrame:
    """(isbn13, field, k, paths): paths with support k for k from the number of successes down to 1, empty groups kept."""
    fields = F.array(*map(F.lit, FIELDS))
    every = availability(presence).filter("available > 0").select("isbn13", F.explode(fields).alias("field"), "available").select("isbn13", "field", F.explode(F.sequence(F.lit(1), F.col("available").cast("int"))).alias("k"))
    held = path_support(labels).groupBy("isbn13", "field", F.col("votes").cast("int").alias("k")).agg(F.array_join(F.array_sort(F.collect_list("path")), " | ").alias("paths"))
    return every.join(held, ["isbn13", "field", "k"], "left").withColumn("paths", F.coalesce("paths", F.lit("")))


def label_sets(presence: DataFrame, labels: DataFrame) -> DataFrame:
    """(isbn13, m, genre, metadata): sorted label sets of each success, empty for abstentions."""
    answered = successes(presence).repartition("isbn13").select("isbn13", "m", F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("path"), F.lit(True).alias("success"))
    rows = answered.unionByName(labels.select("isbn13", "m", "field", "path", F.lit(False).alias("success")))
    held = rows.groupBy("isbn13", "m").agg(F.max("success").alias("success"), *[F.array_sort(F.collect_set(F.when(F.col("field") == f, F.col("path")))).alias(f) for f in FIELDS])
    return held.filter("success").drop("success")


def model_pairs(sets: DataFrame) -> DataFrame:
    """Pairs of successful models of a book, the lower rank first; columns with suffix _a and _b. A book's sets meet in one grouping."""
    columns = ("m", *FIELDS)
    books = sets.groupBy("isbn13").agg(F.collect_list(F.struct(*columns)).alias("sets"))
    pairs = books.select("isbn13", "sets", F.explode("sets").alias("x")).select("isbn13", "x", F.explode(F.expr("filter(sets, y -> y.m > x.m)")).alias("y"))
    return pairs.select("isbn13", *[F.col(f"x.{c}").alias(f"{c}_a") for c in columns], *[F.col(f"y.{c}").alias(f"{c}_b") for c in columns])


def field_pairs(pairs: DataFrame) -> DataFrame:
    """(isbn13, m_a, m_b, field, a, b): a row for each field."""
    return pairs.select("isbn13", "m_a", "m_b", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_a").alias("a"), F.col(f"{f}_b").alias("b")) for f in FIELDS])))


def pairwise_exact(pairs: DataFrame) -> DataFrame:
    g, m = F.col("genre_a") == F.col("genre_b"), F.col("metadata_a") == F.col("metadata_b")
    return pairs.groupBy("m_a", "m_b").agg(F.count(F.lit(1)).alias("n"), F.count_if(g).alias("exact_genre"), F.count_if(m).alias("exact_metadata"), F.count_if(g & m).alias("exact_both"))


def pairwise_jaccard(pairs: DataFrame, empty: float | None) -> DataFrame:
    """Mean Jaccard similarity by field and pair; two empty sets count as ``empty``, or not at all if it is None."""
    scored = field_pairs(pairs).withColumn("j", P.jaccard(F.col("a"), F.col("b"), empty))
    return scored.groupBy("field", "m_a", "m_b").agg(F.count(F.lit(1)).alias("n"), F.count("j").alias("contributing"), F.round(F.avg("j"), 6).alias("mean_jaccard"))


def complete_sets(presence: DataFrame, labels: DataFrame) -> DataFrame:
    """(isbn13, field, union, common, sizes): of books that all models annotated."""
    of = lambda f: F.col("field") == f
    paths = labels.groupBy("isbn13", "field", "path").agg(F.bit_or(model_bit()).alias("voters"))
    whole = F.bit_count("voters") == len(MODELS)
    counts = paths.groupBy("isbn13").agg(*[x for f in FIELDS for x in (F.count_if(of(f)).alias(f"union_{f}"), F.count_if(of(f) & whole).alias(f"common_{f}"))])
    books = complete_books(presence).join(counts, "isbn13", "left").fillna(0)
    return books.select("isbn13", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"union_{f}").alias("union"), F.col(f"common_{f}").alias("common")) for f in FIELDS])))


def three_way(presence: DataFrame, labels: DataFrame) -> DataFrame:
    """(isbn13, field, exact, jaccard) of complete books; nothing chosen by any model is agreement."""
    s = complete_sets(presence, labels)
    return s.select("isbn13", "field", (F.col("union") == F.col("common")).alias("exact"), F.when(F.col("union") == 0, 1.0).otherwise(F.col("common") / F.col("union")).alias("jaccard"))


def by_field(three: DataFrame) -> DataFrame:
    first = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    return three.groupBy("isbn13").agg(*[first(f, c).alias(f"{c}_{f}") for f in FIELDS for c in ("exact", "jaccard")])


def ancestor_pairs(labels: DataFrame) -> DataFrame:
    """(isbn13, field, m_a, m_b, ancestor, descendant) across models: an equi-join on exploded strict prefixes."""
    down = labels.select("isbn13", "field", F.col("m").alias("m_d"), F.col("path").alias("descendant"), F.explode(P.proper_prefixes(F.col("path"))).alias("ancestor"))
    up = labels.select("isbn13", "field", F.col("m").alias("m_u"), F.col("path").alias("ancestor"))
    return down.join(up, ["isbn13", "field", "ancestor"]).filter("m_d <> m_u").select("isbn13", "field", F.least("m_d", "m_u").alias("m_a"), F.greatest("m_d", "m_u").alias("m_b"), "ancestor", "descendant")


def hierarchy_pair_counts(presence: DataFrame, labels: DataFrame) -> DataFrame:
    """By field and pair: books compared, books with a relation, relations."""
    books = model_pairs(label_sets(presence, labels)).select("isbn13", "m_a", "m_b", F.explode(F.array(*map(F.lit, FIELDS))).alias("field"))
    related = ancestor_pairs(labels).groupBy("isbn13", "field", "m_a", "m_b").agg(F.count(F.lit(1)).alias("relations"))
    return books.join(related, ["isbn13", "field", "m_a", "m_b"], "left").groupBy("field", "m_a", "m_b").agg(F.count(F.lit(1)).alias("books"), F.count("relations").alias("books_related"), F.coalesce(F.sum("relations"), F.lit(0)).alias("relations"))


def path_pairs(pairs: DataFrame) -> DataFrame:
    """(isbn13, field, m_a, m_b, path_a, path_b, similarity): all path pairs of a book's model pair."""
    rows = field_pairs(pairs).select("isbn13", "field", "m_a", "m_b", F.explode("a").alias("path_a"), "b").select("isbn13", "field", "m_a", "m_b", "path_a", F.explode("b").alias("path_b"))
    return rows.withColumn("similarity", P.path_similarity(F.col("path_a"), F.col("path_b")))


def symmetric_similarity(pairs: DataFrame) -> DataFrame:
    """Per book, field and pair: best-match similarity in both directions, averaged; null if both sets are empty, 0 if one is.

    Sets are small arrays, so this is a projection without a shuffle.
    """

    def best(source, target):
        each = F.transform(source, lambda x: F.array_max(F.transform(target, lambda y: P.path_similarity(x, y))))
        return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(source)

    a, b = F.col("a"), F.col("b")
    score = F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(None)).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise((best(a, b) + best(b, a)) / 2)
    some = lambda f: F.exists(a, lambda x: F.exists(b, lambda y: f(x, y)))
    return field_pairs(pairs).select(
        "isbn13", "field", "m_a", "m_b", score.cast("double").alias("similarity"),
        ((F.size(a) == 0) & (F.size(b) == 0)).alias("joint_abstention"),
        ((F.size(a) == 0) != (F.size(b) == 0)).alias("one_sided_abstention"),
        some(P.ancestor_related).alias("ancestor_relation"),
        F.arrays_overlap(a, b).alias("exact_overlap"),
        some(lambda x, y: P.common_prefix_depth(x, y) == 0).alias("zero_prefix_pair"),
    )


def prefix_rows(labels: DataFrame) -> DataFrame:
    """(isbn13, field, m, path, n, depth, prefix): each label's prefixes, itself included; n is its depth."""
    own = F.filter(F.transform(F.split("path", P.SEPARATOR), lambda x: F.trim(x)), lambda x: x != "")
    rows = labels.select("isbn13", "field", "m", "path", own.alias("own")).withColumn("n", F.size("own"))
    every = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice("own", 1, i), P.SEPARATOR).alias("prefix")))
    return rows.filter("n > 0").select("isbn13", "field", "m", "path", "n", F.inline(every))


def best_matches(labels: DataFrame) -> DataFrame:
    """(isbn13, field, m, other, path, best, exact, related, same_root): each label's best match among another model's labels, through an index of prefixes.

    The index has, for each prefix and model, the depth of the shortest and of the longest path under it and how many there are. Of the paths that share the first d parts with
    a label of n parts, the shortest, of s parts, is the most similar: 2d / (n + s). So a label meets each of its prefixes once, not each of the other's labels. ``same_root``: how many of the
    other's labels share the root. A label that shares no root with any has no row.
    """
    rows = prefix_rows(labels).repartition("isbn13", "field", "prefix")
    index = rows.groupBy("isbn13", "field", "prefix", F.col("m").alias("other")).agg(F.min("n").alias("short"), F.max("n").alias("long"), F.count(F.lit(1)).alias("under"))
    met = rows.join(index, ["isbn13", "field", "prefix"]).filter("m <> other").repartition("isbn13")
    whole, depth, n = F.col("depth") == F.col("n"), F.col("depth"), F.col("n")
    return met.groupBy("isbn13", "field", "m", "other", "path").agg(
        F.max(2.0 * depth / (n + F.col("short"))).alias("best"),
        F.max(whole & (F.col("short") == n)).alias("exact"),
        F.max(F.when(whole, F.col("long") > n).otherwise(F.col("short") == depth)).alias("related"),
        F.max(F.when(depth == 1, F.col("under"))).alias("same_root"),
    )


def similarity_by_prefixes(presence: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``symmetric_similarity`` from ``best_matches``: by book, all facts about its pairs of models meet in one row."""
    facts = best_matches(labels).groupBy("isbn13", "field", "m", "other").agg(F.sum("best").alias("total"), F.max("exact").alias("exact"), F.max("related").alias("related"), F.min("same_root").alias("same_root"), F.count(F.lit(1)).alias("met"))
    facts = facts.groupBy("isbn13").agg(F.collect_list(F.struct("field", "m", "other", "total", "exact", "related", "same_root", "met")).alias("facts"))
    sizes = labels.groupBy("isbn13", "field", "m").agg(F.count_distinct("path").alias("n")).groupBy("isbn13").agg(F.collect_list(F.struct("field", "m", "n")).alias("sizes"))
    models = successes(presence).groupBy("isbn13").agg(F.array_sort(F.collect_set("m")).alias("models"))
    books = models.join(sizes, "isbn13", "left").join(facts, "isbn13", "left")
    pairs = books.select("isbn13", "models", "sizes", "facts", F.explode("models").alias("m_a")).select("*", F.explode(F.expr("filter(models, b -> b > m_a)")).alias("m_b"))
    rows = pairs.select("isbn13", "m_a", "m_b", "sizes", "facts", F.explode(F.array(*map(F.lit, FIELDS))).alias("field"))
    size = lambda m: F.expr(f"coalesce(get(filter(sizes, s -> s.field = field and s.m = {m}), 0).n, 0L)")
    fact = lambda m, o: F.expr(f"get(filter(facts, f -> f.field = field and f.m = {m} and f.other = {o}), 0)")
    rows = rows.select("isbn13", "field", "m_a", "m_b", size("m_a").alias("na"), size("m_b").alias("nb"), fact("m_a", "m_b").alias("ab"), fact("m_b", "m_a").alias("ba"))
    na, nb, none = F.col("na"), F.col("nb"), F.lit(0.0)
    mean = (F.coalesce("ab.total", none) / F.nullif(na, F.lit(0)) + F.coalesce("ba.total", none) / F.nullif(nb, F.lit(0))) / 2
    both = (na > 0) & (nb > 0)
    return rows.select(
        "isbn13", "field", "m_a", "m_b",
        F.when(both, mean).when((na > 0) | (nb > 0), 0.0).alias("similarity"),
        ((na == 0) & (nb == 0)).alias("joint_abstention"),
        ((na == 0) != (nb == 0)).alias("one_sided_abstention"),
        F.coalesce("ab.related", F.lit(False)).alias("ancestor_relation"),
        F.coalesce("ab.exact", F.lit(False)).alias("exact_overlap"),
        (both & ((F.coalesce("ab.met", F.lit(0)) < na) | (F.col("ab.same_root") < nb))).alias("zero_prefix_pair"),
    )


def hierarchy_summary(rows: DataFrame) -> DataFrame:
    """By field and pair; joint abstentions don't enter the mean."""
    flags = ("joint_abstention", "one_sided_abstention", "ancestor_relation", "exact_overlap", "zero_prefix_pair")
    return rows.groupBy("field", "m_a", "m_b").agg(F.count(F.lit(1)).alias("evaluated"), *[F.count_if(F.col(f)).alias(f) for f in flags], F.round(F.avg("similarity"), 6).alias("mean_similarity"))


def matching_weight(weights: np.ndarray) -> float:
    """Largest total of a one-to-one assignment between rows and columns; weights are not negative.

    The Hungarian method by shortest augmenting paths: rows enter one by one, potentials of rows and columns keep all reduced costs at zero or above, and
    each row's path to a free column is the shortest by reduced costs (a step over all columns at once). Time grows with rows^2 x columns.
    """
    w = np.asarray(weights, float)
    if w.shape[0] > w.shape[1]:
        w = w.T
    rows, columns = w.shape
    cost = w.max() - w
    of_row, of_column = np.zeros(rows), np.zeros(columns)
    owner = np.full(columns, -1)  # the row that has a column
    for new in range(rows):
        reach, came = np.full(columns, np.inf), np.full(columns, -1)
        done = np.zeros(columns, bool)
        row, at, total = new, -1, 0.0
        while True:
            through = total + cost[row] - of_row[row] - of_column
            better = ~done & (through < reach)
            reach[better], came[better] = through[better], at
            at = int(np.argmin(np.where(done, np.inf, reach)))
            total = reach[at]
            if owner[at] < 0:
                break
            done[at] = True
            row = owner[at]
        of_row[new] += total
        of_row[owner[done]] += total - reach[done]
        of_column[done] -= total - reach[done]
        while at >= 0:  # hand columns on along the path
            before = came[at]
            owner[at] = new if before < 0 else owner[before]
            at = before
    taken = np.flatnonzero(owner >= 0)
    return float(w[owner[taken], taken].sum())


def matching_weights(weights: np.ndarray) -> np.ndarray:
    """``matching_weight`` of many matrices of one shape at once: up to eight columns by the best total of each set of taken columns, row by row."""
    w = weights if weights.shape[1] <= weights.shape[2] else weights.transpose(0, 2, 1)
    if w.shape[2] > 8:
        return np.array([matching_weight(x) for x in w])
    best = {0: np.zeros(len(w))}
    for i in range(w.shape[1]):
        step: dict[int, np.ndarray] = {}
        for taken, total in best.items():
            for j in range(w.shape[2]):
                if not taken >> j & 1:
                    with_it, new = taken | 1 << j, total + w[:, i, j]
                    step[with_it] = np.maximum(step[with_it], new) if with_it in step else new
        best = step
    return np.max(list(best.values()), axis=0)


def one_to_one(pairs: DataFrame, where: str = "true") -> DataFrame:
    """Per book, field and pair: twice the weight of the best one-to-one matching over the sum of sizes; null and 0 as above. ``where``: a condition on the label sets a and b of the rows wanted."""

    def match(batches):
        for b in batches:
            found = np.zeros(len(b))
            for (na, nb), at in b.groupby(["na", "nb"]).indices.items():
                if na and nb:
                    found[at] = 2 * matching_weights(np.concatenate(b["flat"].to_numpy()[at]).reshape(len(at), na, nb)) / (na + nb)
                elif not na and not nb:
                    found[at] = np.nan
            b["similarity"] = found
            yield b[["isbn13", "field", "m_a", "m_b", "similarity"]]

    rows = field_pairs(pairs).filter(where)
    # a path as its prefixes, itself included: two paths share as many prefixes as leading parts
    prefixes = lambda side: F.transform(side, lambda x: P.prefixes(x))
    rows = rows.select("isbn13", "field", "m_a", "m_b", F.size("a").alias("na"), F.size("b").alias("nb"), prefixes(F.col("a")).alias("a"), prefixes(F.col("b")).alias("b"))
    total = lambda x, y: F.size(x) + F.size(y)
    alike = lambda x, y: F.when(total(x, y) == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total(x, y))
    flat = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: alike(x, y))))
    rows = rows.select("isbn13", "field", "m_a", "m_b", "na", "nb", flat.alias("flat"))
    kind = rows.schema["isbn13"].dataType.simpleString()
    found = rows.mapInPandas(match, f"isbn13 {kind}, field string, m_a int, m_b int, similarity double")
    return found.withColumn("similarity", F.round(F.nanvl("similarity", F.lit(None).cast("double")), 6))


def one_to_one_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("field", "m_a", "m_b").agg(F.count(F.lit(1)).alias("books"), F.count("similarity").alias("evaluated"), F.round(F.avg("similarity"), 6).alias("mean_similarity"))
