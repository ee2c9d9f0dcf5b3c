"""Hierarchical label paths as column expressions; a path is its parts joined by " / "."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = " / "


def parts(path: Column) -> Column:
    """Parts of a path, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(path, SEPARATOR), lambda x: F.trim(x)), lambda x: x != "")


def depth(path: Column) -> Column:
    return F.size(parts(path))


def loose_leaf(path: Column) -> Column:
    """Last non-empty part after splitting at bare slashes, as candidate scoring does."""
    pieces = F.filter(F.transform(F.split(path, "/"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(pieces) > 0, F.element_at(pieces, -1)).otherwise(path)


def is_strict_ancestor(a: Column, d: Column) -> Column:
    return F.startswith(d, F.concat(a, F.lit(SEPARATOR)))


def ancestor_related(a: Column, b: Column) -> Column:
    return is_strict_ancestor(a, b) | is_strict_ancestor(b, a)


def proper_prefixes(path: Column) -> Column:
    """Strict ancestors of a path; none for a root (``sequence`` would count down there)."""
    p = parts(path)
    return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.array_join(F.slice(p, 1, i), SEPARATOR))).otherwise(F.array().cast("array<string>"))


def prefixes(path: Column) -> Column:
    """A path's prefixes, itself included; none of a path without parts."""
    p = parts(path)
    return F.when(F.size(p) > 0, F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, 1, i), SEPARATOR))).otherwise(F.array().cast("array<string>"))


def common_prefix_depth(a: Column, b: Column) -> Column:
    """Number of leading parts that two paths share."""
    same = F.zip_with(parts(a), parts(b), lambda x, y: x.eqNullSafe(y))
    start = F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok"))
    step = lambda s, x: F.struct((s["d"] + F.when(s["ok"] & x, 1).otherwise(0)).alias("d"), (s["ok"] & x).alias("ok"))
    return F.aggregate(same, start, step, lambda s: s["d"])


def path_similarity(a: Column, b: Column) -> Column:
    """Prefix Dice: twice the common depth over the sum of depths; 1 if both are empty."""
    total = depth(a) + depth(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * common_prefix_depth(a, b) / total)


def without_redundant_ancestors(paths: Column) -> Column:
    """Drop each path that has a strict descendant in the array; sorted."""
    return F.array_sort(F.filter(F.array_distinct(paths), lambda p: ~F.exists(paths, lambda q: is_strict_ancestor(p, q))))


def jaccard(a: Column, b: Column, empty: float | None = None) -> Column:
    """Jaccard similarity of two arrays as sets; ``empty`` if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / union)
