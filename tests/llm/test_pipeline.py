"""run() of corpus_pipeline against brute force on a small table."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    from labelforge.llm import packing, queries

    rng = random.Random(2)
    words = ["".join(rng.choices("aeinrst", k=rng.randint(2, 7))) for _ in range(200)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, text(rng.randint(20, 200)), "en" if i % 4 else "de", f"src{i % 3}", 1) for i in range(60)]
    long = text(300).split()
    rows += [(100 + i, " ".join([*long[: 20 * i + 1], "changed", *long[20 * i + 2 :]]), "en", "src0", 1) for i in range(5)]
    rows += [(200 + i, rows[3][1], "en", "src1", 1) for i in range(10)] + [(300, None, "en", None, 1), (301, "123 ...", "de", "src1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    kept = {i for i, *_ in rows} - {300, 301} - {3, *range(200, 209)} - {101, 102, 103, 104}
    out = pipeline.run(spark, str(tmp_path)).collect()
    tokens = packing.chunks(queries.tokenizer("word_bpe_49k.json"))
    by_id = {r[0]: r[1] for r in rows}
    assert {r["doc_id"] for r in out} == kept
    for i in kept:
        assert sum(r["length"] for r in out if r["doc_id"] == i) == len(tokens.ids(by_id[i])) // 4 + 1


def test_mixing_order_is_kept(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a b", "en", f"src{i % 5}", 3) for i in range(500)], "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.mixed(spark, docs, "")
    assert out.columns == docs.columns
    first = [r["source"] for r in out.collect()[:96]]
    assert first.count("src0") == 48 and all(first.count(f"src{i}") in (0, 16) for i in range(1, 5))


def test_packing_takes_documents_in_the_order_of_mixing(spark, tmp_path):
    from collections import defaultdict

    rows = [(i, "a b c" if i % 2 else "a b " * 700, "en", f"src{i % 5}", 3) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    ordered = pipeline.mixed(spark, docs, "")
    want = {r["doc_id"]: i for i, r in enumerate(ordered.collect())}
    ordered.write.option("maxRecordsPerFile", 150).parquet(str(tmp_path / "mixing"))
    out = pipeline.packed(spark, spark.read.parquet(str(tmp_path / "mixing")), "").collect()
    by_length = defaultdict(list)
    for r in out:
        by_length[r["length"]].append((r["sequence_id"], r["offset"], want[r["doc_id"]]))
    for found in by_length.values():
        places = [place for _, _, place in sorted(found)]
        assert places == sorted(places)
    assert len({r["doc_id"] for r in out}) == 2000


SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SHAPE).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_awkward_rows_and_clashing_columns(spark, tmp_path):
    """Nulls everywhere, repeated rows and ids, and columns that bear the names which stages use themselves."""
    words = "the old house on the hill was painted green by two men from the town last summer while it rained".split()
    rows = [
        (None, " ".join(words), "en", None, None), (None, None, None, "src0", 1), (1, None, "en", "src0", 1), (2, "", None, None, None),
        (3, " ".join(words[3:]), "en", "src0", 5), (3, " ".join(reversed(words)), "en", "src1", 5),
        (4, "one two three", None, "src2", 3), (4, "one two three", None, "src2", 3), (5, "word " * 9000, "en", "src3", 2),
    ]
    clash = ["key", "digest", "component", "mix_pos", "mix_block", "__salt", "__text", "id", "length", "salt"]
    docs = spark.createDataFrame(rows, SHAPE).selectExpr("*", *[f"coalesce(doc_id, 0) + {i} as `{c}`" for i, c in enumerate(clash)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, counts = docs, []
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        counts.append(now.count())
        if i < 4:
            assert now.columns == docs.columns
    # three texts are null or empty; one row is repeated; no text is near another
    assert counts[:4] == [6, 5, 5, 5]
    assert {r["doc_id"] for r in now.collect()} == {None, 3, 4, 5}
