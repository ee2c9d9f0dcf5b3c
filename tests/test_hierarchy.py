"""Matching, prefix index, nested intervals and ordinals against plain versions."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelforge.operators import agreement as A
from labelforge.operators import consensus as C
from labelforge.operators import debate as D
from labelforge.operators import nested as N
from labelforge.operators.ordinals import with_ordinal

KIND = "isbn13 long, m int, field string, path string"


def test_matching_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(400):
        n, m = rng.integers(1, 8, 2)
        w = rng.integers(0, 4, (n, m)) / rng.integers(1, 4) if rng.random() < 0.5 else rng.random((n, m))
        few = w if n <= m else w.T
        if few.shape == (7, 7) and rng.random() < 0.8:
            continue
        best = max(sum(few[i, p] for i, p in enumerate(perm)) for perm in itertools.permutations(range(few.shape[1]), few.shape[0]))
        assert abs(A.matching_weight(w) - best) < 1e-9


def test_matching_of_a_hundred():
    began = time.perf_counter()
    w = np.random.default_rng(2).random((100, 100))
    found = A.matching_weight(w)
    assert time.perf_counter() - began < 1 and 95 < found < 100
    assert A.matching_weight(np.eye(100)) == 100 and A.matching_weight(np.zeros((100, 3))) == 0


def random_labels(seed, books=60, roots=3, depth=4):
    """Labels in small trees, so that ancestors, equal paths and shared roots are frequent."""
    rng = random.Random(seed)
    rows = set()
    for b, m, field in itertools.product(range(books), range(3), ("genre", "metadata")):
        for _ in range(rng.choice([0, 1, 2, 3])):
            parts = [rng.choice("ABC"[:roots]), *(rng.choice(["x", "y", "x y", "é"]) for _ in range(rng.randint(0, depth - 1)))]
            rows.add((b, m, field, " / ".join(parts)))
    return sorted(rows)


@pytest.fixture(scope="module", params=[1, 2])
def tables(spark, request):
    labels = spark.createDataFrame(random_labels(request.param), KIND)
    presence = spark.createDataFrame([(b, m, "error" if (b + m) % 11 == 0 else "success", False) for b in range(62) for m in range(3)], "isbn13 long, m int, status string, abstain boolean")
    able = presence.filter("status = 'success'").select("isbn13", "m")
    return presence, labels.join(able, ["isbn13", "m"]).select("isbn13", "m", "field", "path")


def rows_of(df, *columns):
    return sorted(map(repr, df.select(*(columns or sorted(df.columns))).collect()))


def test_prefix_index_equals_all_pairs(tables):
    presence, labels = tables
    all_pairs = A.symmetric_similarity(A.model_pairs(A.label_sets(presence, labels))).withColumn("similarity", F.round("similarity", 9))
    by_prefix = A.similarity_by_prefixes(presence, labels).withColumn("similarity", F.round("similarity", 9))
    assert rows_of(by_prefix) == rows_of(all_pairs) and by_prefix.filter("zero_prefix_pair and ancestor_relation").count() > 0


def test_intervals(tables):
    _, labels = tables
    index = N.interval_index(labels.select(F.col("field").alias("kind"), "path")).collect()
    for kind in ("genre", "metadata"):
        nodes = sorted((r for r in index if r.kind == kind), key=lambda r: r.path.split(" / "))
        assert [r.pre for r in nodes] == list(range(1, len(nodes) + 1))
        for a, d in itertools.product(nodes, nodes):
            assert (a.pre < d.pre <= a.last) == d.path.startswith(a.path + " / ")


def test_nested_operators_equal_those_on_strings(tables):
    _, labels = tables
    index = N.interval_index(labels.select(F.col("field").alias("kind"), "path"))
    columns = ["isbn13", "field", "m_a", "m_b", "ancestor", "descendant"]
    assert rows_of(N.ancestor_pairs(labels, index), *columns) == rows_of(A.ancestor_pairs(labels), *columns)
    assert rows_of(N.canonical(labels, index)) == rows_of(C.canonical(labels))
    assert rows_of(N.hierarchical_candidates(labels, index)) == rows_of(C.hierarchical_candidates(labels))
    with pytest.raises(Exception, match="not in the index"):
        N.coded(labels, index.filter("path not like 'A%'")).collect()


def test_ordinals_with_an_outlier_ties_and_repeats(spark):
    rows = [("k", 10**13, "z")] + [("k", i % 500, "p") for i in range(3000)] + [("other", 5, None)] * 40
    df = spark.createDataFrame(rows, "key string, n long, p string").repartition(5)
    found = with_ordinal(df, "key", ["n", "p"], "rank").collect()
    for key in ("k", "other"):
        own = sorted((r for r in found if r.key == key), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert [r.n for r in own] == sorted(r.n for r in own)
    assert with_ordinal(df.limit(0), "key", ["n"], "rank").count() == 0


def test_violations_count_books_and_records(spark):
    kind = "isbn13 long, genre array<string>, metadata array<string>"
    final = spark.createDataFrame([(1, ["Fiction", "Nonfiction / x"], ["M"]), (1, ["Fiction"], []), (2, [], []), (3, ["Odd", "Odder"], ["Odd"]), (None, None, ["M"])], kind)
    manual = spark.createDataFrame([(1,), (9,), (None,)], "isbn13 long")
    taxonomy = spark.createDataFrame([("genre", "Fiction"), ("genre", "Nonfiction / x"), ("metadata", "M")], "kind string, path string")
    assert {r.check: r.n for r in D.violations(final, manual, taxonomy).collect()} == {"duplicate_final": 1, "final_and_manual": 1, "empty_final": 1, "invalid_genre": 1, "invalid_metadata": 1, "both_roots": 1}
    none = D.violations(final.limit(0), manual.limit(0), taxonomy)
    assert {r.n for r in none.collect()} == {0} and none.count() == 6


def test_trees_by_pointer_doubling(spark):
    from labelforge.operators import trees

    kind = "id long, parent long, label string"
    chain = [(i, i - 1 if i else None, f"n{i}") for i in range(40)]
    found = {r.id: r for r in trees.tree_paths(spark.createDataFrame([*chain, (100, 99, "orphan"), (101, 100, None)], kind)).collect()}
    assert found[39].path == " / ".join(f"n{i}" for i in range(40)) and (found[39].depth, found[39].root) == (40, 0)
    assert (found[100].path, found[100].depth, found[101].root) == ("orphan", 1, 100)
    assert trees.tree_paths(spark.createDataFrame([], kind)).count() == 0
    with pytest.raises(trees.Cycle):
        trees.tree_paths(spark.createDataFrame([(1, 2, "a"), (2, 3, "b"), (3, 1, "c"), (4, 3, "d"), (5, None, "e")], kind))
    with pytest.raises(trees.Cycle):
        trees.tree_paths(spark.createDataFrame([(1, 1, "a")], kind))
    with pytest.raises(Exception, match="two nodes"):
        trees.tree_paths(spark.createDataFrame([(1, None, "a"), (1, None, "b")], kind)).collect()
    paths = spark.createDataFrame([("A",), ("A / b",), ("A b",), ("C / d",), ("C",)], "path string")
    assert sorted(r.path for r in trees.without_subtrees(paths, spark.createDataFrame([("A",), ("C / d",)], "path string")).collect()) == ["A b", "C"]
