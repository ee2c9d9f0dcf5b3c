"""Recall of the pipeline's near-dedup against all pairs, by exact counts of shared shingles."""

import sys
from collections import Counter, defaultdict

from labelforge.llm import simhash
from labelforge.llm.common import table

TEST_DIR = "/root/testdata/sf0.01"


def exact_components(texts: dict[int, str | None], width: int = 5, similarity: float = 0.8) -> tuple[int, dict[int, int]]:
    """Number of pairs at the similarity or above, and each linked id's component: each document meets all that share a shingle with it."""
    sets = {i: set(simhash.shingle_hashes(simhash._words(t), width).tolist()) for i, t in texts.items()}
    holders = defaultdict(list)
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    pairs = 0
    for i in sorted(sets):
        shared = Counter()
        for s in sets[i]:
            shared.update(holders[s])
            holders[s].append(i)
        for j, n in shared.items():
            if n + 1e-6 >= similarity * (len(sets[i]) + len(sets[j]) - n):
                pairs += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return pairs, {i: find(i) for i in list(root)}


def measured(spark, sf_dir: str) -> dict:
    docs = table(spark, sf_dir, "documents")
    pairs, due = exact_components({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    found = {r["id"]: r["component"] for r in simhash.near_copies(docs).collect()}
    gone, dropped = {i for i, c in due.items() if i != c}, {i for i, c in found.items() if i != c}
    return {"pairs": pairs, "due": len(gone), "found": len(gone & dropped), "wrong": len(dropped - gone), "components equal": found == {i: c for i, c in due.items() if Counter(due.values())[c] > 1} if len(due) < 3000 else None}


def test_recall_against_all_pairs(spark):
    told = measured(spark, TEST_DIR)
    assert told["due"] > 20 and told["wrong"] == 0 and told["found"] >= 0.9 * told["due"], told


if __name__ == "__main__":  # python tests/llm/test_recall.py DIR
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[6]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "12").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    print(measured(session, sys.argv[1]))
