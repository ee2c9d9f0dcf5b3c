"""Literal cases of the operators' rules."""

import itertools
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from labelforge.functions import paths as P
from labelforge.functions import responses as R
from labelforge.functions import text as T
from labelforge.operators import agreement as A
from labelforge.operators import consensus as C
from labelforge.operators import debate as D
from labelforge.operators import integration as I
from labelforge.operators import pages as G
from labelforge.plans import runner
from labelforge.sources import tables as S
from labelforge.streaming import resume


def value(spark, column, **literals):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) or v else F.array().cast("array<string>").alias(k) for k, v in literals.items()]) if literals else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def label_rows(spark, chosen, field="genre"):
    return spark.createDataFrame([(1, m, field, p) for m, paths in enumerate(chosen) for p in paths], "isbn13 long, m int, field string, path string")


@pytest.mark.parametrize(("a", "b", "strict"), [("F / A", "F / A", False), ("F / Art", "F / Arts", False), ("F", "F / A / B / C / D", True), ("F / Wonder/Magic", "F / Wonder/Magic / X", True), ("F / A / B", "F / A", False)])
def test_strict_ancestor(spark, a, b, strict):
    assert value(spark, P.is_strict_ancestor(F.col("a"), F.col("b")), a=a, b=b) is strict


def test_prefixes_and_leaf(spark):
    assert value(spark, P.proper_prefixes(F.lit("A"))) == []
    assert value(spark, P.proper_prefixes(F.lit("A / B / C"))) == ["A", "A / B"]
    assert value(spark, P.loose_leaf(F.lit("Fiction / Wonder/Magic Talees"))) == "Magic Talees"
    assert value(spark, P.parts(F.lit(" A /  / B "))) == ["A", "B"]


@pytest.mark.parametrize(("paths", "kept"), [([], []), (["A", "A / B", "A / B / C"], ["A / B / C"]), (["B / X", "A / B", "A", "B"], ["A / B", "B / X"]), (["A", "A"], ["A"])])
def test_redundant_ancestors(spark, paths, kept):
    assert value(spark, P.without_redundant_ancestors(F.col("p")), p=paths) == kept


@pytest.mark.parametrize(("a", "b", "s"), [("F / A / B", "F / A / C", 2 / 3), ("F", "F", 1.0), ("F", "G", 0.0), ("F", "F / T", 2 / 3)])
def test_path_similarity(spark, a, b, s):
    assert value(spark, P.path_similarity(F.lit(a), F.lit(b))) == pytest.approx(s)


def test_set_similarity(spark):
    presence = spark.createDataFrame([(1, m, "success", False) for m in range(3)], "isbn13 long, m int, status string, abstain boolean")
    labels = label_rows(spark, [["F / A", "F / B"], ["F / A / X"], []])
    pairs = A.model_pairs(A.label_sets(presence, labels))
    found = {(r["field"], r["m_a"], r["m_b"]): r for r in A.symmetric_similarity(pairs).collect()}
    assert found["genre", 0, 1]["similarity"] == pytest.approx(((0.8 + 0.4) / 2 + 0.8) / 2)
    assert found["genre", 0, 2]["similarity"] == 0.0 and found["genre", 0, 2]["one_sided_abstention"]
    assert found["metadata", 0, 1]["similarity"] is None and found["metadata", 0, 1]["joint_abstention"]
    one = {(r["field"], r["m_a"], r["m_b"]): r["similarity"] for r in A.one_to_one(pairs).collect()}
    assert one["genre", 0, 1] == pytest.approx(2 * 0.8 / 3, abs=1e-6) and one["genre", 1, 2] == 0.0 and one["metadata", 0, 1] is None


def test_matching_weight():
    for n, m in itertools.product(range(1, 5), repeat=2):
        w = [[((i * 7 + j * 5 + i * j) % 11) / 10 for j in range(m)] for i in range(n)]
        small, wide = (w, m) if n <= m else ([list(c) for c in zip(*w, strict=True)], n)
        best = max(sum(row[j] for row, j in zip(small, p, strict=True)) for p in itertools.permutations(range(wide), len(small)))
        assert A.matching_weight(w) == pytest.approx(best)


def test_jaccard_conventions(spark):
    assert value(spark, P.jaccard(F.col("a"), F.col("b")), a=[], b=[]) is None
    assert value(spark, P.jaccard(F.col("a"), F.col("b"), 1.0), a=[], b=[]) == 1.0
    assert value(spark, P.jaccard(F.array(F.lit("x")), F.col("b")), b=[]) == 0.0


@pytest.mark.parametrize(
    ("chosen", "canonical", "reasons"),
    [
        ([["F"], ["F / A"], []], {"F"}, {"F": "singleton_hierarchy_supported_canonical", "F / A": "singleton_extra_specificity"}),
        ([["F / A"], ["F / A"], ["F"]], {"F / A"}, {"F": "singleton_redundant_ancestor"}),
        ([["F / A"], ["F / B"], []], set(), {"F / A": "isolated_singleton", "F / B": "isolated_singleton"}),
        ([["F / A"], ["F / A"], ["F / A / B"]], {"F / A"}, {"F / A / B": "singleton_extra_specificity"}),
        ([[], [], []], set(), {}),
    ],
)
def test_consensus(spark, chosen, canonical, reasons):
    labels = label_rows(spark, chosen)
    assert {r["path"] for r in C.canonical(labels).collect()} == canonical
    assert {r["path"]: r["reason"] for r in C.singleton_review(labels).collect()} == reasons


def test_profile_looks_both_ways(spark):
    got = {r["path"]: r["category"] for r in C.dispute_profile(label_rows(spark, [["F"], ["F / A"], ["G"]])).collect()}
    assert got == {"F": "hierarchical_singleton", "F / A": "hierarchical_singleton", "G": "isolated_singleton"}


def test_decision_table_is_whole(spark):
    open_rows, first, second, want = [], [], [], {}
    for support in (1, 2):
        for r1 in itertools.product(("MAINTAIN", "RETRACT"), repeat=support):
            asked = 3 - support if "RETRACT" not in r1 else 0
            for r2 in itertools.product(("ACCEPT", "REJECT"), repeat=asked):
                k = f"{support}{r1}{r2}"
                open_rows.append((k, 1, "Genre", k, support))
                first += [(k, i, x) for i, x in enumerate(r1)]
                second += [(k, 2 - i, x) for i, x in enumerate(r2)]
                if "RETRACT" in r1:
                    want[k] = "REJECT" if set(r1) == {"RETRACT"} else "MANUAL"
                elif support == 1:
                    want[k] = r2[0] if len(set(r2)) == 1 else "MANUAL"
                else:
                    want[k] = "ACCEPT" if r2 == ("ACCEPT",) else "MANUAL"
    disputes = spark.createDataFrame(open_rows, "debate_id string, isbn13 long, annotation_type string, path string, support_count long")
    rounds = "debate_id string, m int, decision string"
    got = D.verdicts(disputes, spark.createDataFrame(first, rounds), spark.createDataFrame(second, rounds))
    assert {r["debate_id"]: r["verdict"] for r in got.collect()} == want
    broken = D.verdicts(disputes.limit(1), spark.createDataFrame([], rounds), spark.createDataFrame([], rounds))
    with pytest.raises(Exception, match="illegal debate state"):
        broken.collect()


@pytest.mark.parametrize(
    ("raw", "error"),
    [
        (None, "empty_response"), ("  ", "empty_response"), ("no object", "incomplete_or_non_json"), ('{"genre_paths": [', "incomplete_or_non_json"),
        ('{"a": 1} and {"b": 2}', "malformed_json"), ('{"genre_paths": []}', "missing_keys"), ('{"genre_paths": "x", "metadata_paths": []}', "genre_paths_not_list"),
        ('{"genre_paths": [], "metadata_paths": {}}', "metadata_paths_not_list"), ('{"genre_paths": ["a", 1], "metadata_paths": []}', "genre_paths_not_strings"),
        ('{"genre_paths": [], "metadata_paths": []}', None), ('```json\n{"genre_paths": ["a"], "metadata_paths": []}\n```', None), ('Well: {"genre_paths": [], "metadata_paths": ["b"]}.', None),
    ],
)
def test_strict_parser(spark, raw, error):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(R.strict_annotation(F.col("raw")).alias("r")).first()["r"]["error"] == error


def test_lenient_parser(spark):
    df = spark.createDataFrame([("x ```json\n{\"a\": 1}\n``` y",), ("{bad",), ("pre {\"b\": 2} post",), (None,)], "raw string")
    assert [r[0] for r in df.select(R.lenient_object(F.col("raw"))).collect()] == ['{"a": 1}', "{}", '{"b": 2}', "{}"]


def test_annotation_rules(spark):
    cols = "g array<string>, m array<string>"
    rows = [(["Fiction / A"], []), (["X"], ["Y"]), (["Fiction / A"], ["Y"]), (["Fiction / A", "Nonfiction"], []), (["Fiction / B"], [])]
    valid, meta, allowed = F.array(*map(F.lit, ["Fiction / A", "Fiction / B", "Nonfiction"])), F.array(F.lit("M")), F.array(F.lit("Fiction / A"), F.lit("Nonfiction"))
    got = spark.createDataFrame(rows, cols).select(R.annotation_error(F.col("g"), F.col("m"), valid, meta, allowed, meta)).collect()
    assert [r[0] for r in got] == [None, "invalid_genre", "invalid_metadata", "both_roots", "genre_outside_candidates"]


def test_text(spark):
    assert value(spark, T.clean(F.lit("  a b \n"))) == "a b"
    assert value(spark, T.clean(F.lit(" \t"))) is None and value(spark, T.clean_or_empty(F.lit(None).cast("string"))) == ""
    assert value(spark, T.clean_html(F.lit("a &amp;&nbsp;b"))) == "a & b"
    assert value(spark, T.fold(F.lit("Straße")) == T.fold(F.lit("STRASSE"))) is True
    assert value(spark, T.dedup_folded(F.array(*map(F.lit, [" A", "b", "a", "", "B ", "c"])))) == ["A", "b", "c"]
    assert value(spark, T.split_pipe(F.lit("x | X|y||z"))) == ["x", "y", "z"]
    assert value(spark, T.join_pipe(F.array(F.lit("a"), F.lit("A"), F.lit("b | c")))) == "a | b | c"
    assert value(spark, T.language_name(F.lit("ENG"))) == "English" and value(spark, T.language_name(F.lit("zz"))) == "zz" and value(spark, T.language_name(F.lit(""))) is None
    assert value(spark, T.language_label(F.lit("Language: English"))) == "English"
    assert value(spark, T.country_of(F.array(F.lit(" New  York : Harper"), F.lit("Delhi")))) == "United States"
    assert value(spark, T.country_of(F.array(F.lit("Yorkshire")))) is None
    assert value(spark, T.quota_exhausted(F.lit("Error 429: Tokens per day limit"))) is True
    assert value(spark, T.https(F.lit("http://x/http://"))) == "https://x/http://"


def test_candidates(spark):
    taxonomy = spark.createDataFrame([("genre", p) for p in ["Fiction", "Nonfiction", "Fiction / Short Stories", "Fiction / Teen Drama Club", "Nonfiction / Art", "Fiction / General Book"]] + [("metadata", "Audience / Teen")], "kind string, path string")
    tags = spark.createDataFrame([(1, "ART"), (1, "teen and young adult"), (2, "non-fiction art"), (3, "nonfiction art"), (4, "general story")], "isbn13 long, tag string")
    scores = {(r["isbn13"], r["path"]): r["score"] for r in I.candidate_scores(tags, taxonomy).collect()}
    assert scores[1, "Nonfiction / Art"] == 1.0 and scores[1, "Audience / Teen"] == pytest.approx(2 / 5)
    assert not any(i == 4 for i, _ in scores)
    got = {}
    for r in I.candidates(tags, taxonomy, {"genre": 80, "metadata": 60}).collect():
        got.setdefault(r["isbn13"], set()).add(r["path"])
    assert got[1] == {"Nonfiction / Art", "Fiction", "Nonfiction"}
    assert got[2] == {"Nonfiction / Art", "Fiction", "Nonfiction"}
    assert got[3] == {"Nonfiction / Art", "Nonfiction"}
    assert got[4] == {"Fiction", "Nonfiction"}


def test_merge(spark):
    rows = [
        Row(isbn13="1", source="OpenLibrary", ingest_seq=0, title="old", number_of_pages=5, tags=["A"]),
        Row(isbn13="1", source="OpenLibrary", ingest_seq=1, title="  ", number_of_pages=0, tags=["A", "b"]),
        Row(isbn13="1", source="Amazon", ingest_seq=2, title=" New  title", number_of_pages=9, tags=["a"]),
    ]
    df = spark.createDataFrame(rows, "isbn13 string, source string, ingest_seq int, title string, number_of_pages int, tags array<string>")
    r = I.master(df.withColumn("publisher", F.lit(None).cast("string"))).first()
    assert (r["title"], r["title_source"], r["number_of_pages"], r["number_of_pages_source"], r["publisher"]) == ("New title", "Amazon", 0, "OpenLibrary", None)
    assert r["available_sources"] == ["OpenLibrary", "Amazon"] and r["openlibrary_genres"] == ["A", "b"]
    assert {(r["tag"], r["sources"]) for r in I.tag_provenance(df).collect()} == {("A", "OpenLibrary"), ("a", "Amazon"), ("b", "OpenLibrary")}


def test_filter_validation(spark):
    tags = spark.createDataFrame([("1", t) for t in ("Drama", "drama club", "Kindle", "x")], "isbn13 string, tag string")
    said = spark.createDataFrame([("1", "DRAMA", "keep", None), ("1", "drama", "remove", "r"), ("1", "kindle ", "remove", " "), ("1", "made up", "keep", None)], "isbn13 string, tag string, action string, reason string")
    got = {r["tag"]: (r["kept"], r["reason"]) for r in I.validated_filter(tags, said).collect()}
    assert got == {"Drama": (True, None), "drama club": (True, None), "Kindle": (False, "Removed by filtering model."), "x": (True, None)}


def test_audit(spark):
    taxonomy = spark.createDataFrame([("genre", "Fiction"), ("genre", "Nonfiction"), ("metadata", "M")], "kind string, path string")
    final = spark.createDataFrame([(1, ["Fiction"], ["M"]), (2, ["bad"], []), (3, [], []), (4, ["Fiction", "Nonfiction"], ["worse"]), (4, ["Fiction"], [])], "isbn13 long, genre array<string>, metadata array<string>")
    manual = spark.createDataFrame([(1,)], "isbn13 long")
    got = {r["check"]: r["n"] for r in D.violations(final, manual, taxonomy).collect()}
    assert got == {"duplicate_final": 1, "final_and_manual": 1, "empty_final": 1, "invalid_genre": 1, "invalid_metadata": 1, "both_roots": 1}


def test_pages(spark):
    html = '<script type="application/ld+json">{bad</script><script type="application/ld+json">{"@graph": [{"@type": "Org"}, {"@type": "Book", "name": "N"}]}</script><div class="b c"><p>one <b>two</b></p></div><a href="/x/dp/1?q=2">z</a>'
    assert json.loads(value(spark, G.json_ld_book(F.lit(html))))["name"] == "N"
    assert value(spark, G.json_ld_book(F.lit("<p>"))) is None
    assert spark.createDataFrame([(html,)], "h string").select(G.select_text(F.col("h"), "div", "c")).first()[0] == ["one two"]
    assert value(spark, G.product_url(F.lit(html), "https://h")) == "https://h/x/dp/1"
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("Pages", "1"), ("PAGES ", "2"), ("Format", "x"))])
    assert value(spark, G.details(pairs)) == {"pages": "2", "format": "x"}
    assert value(spark, G.detail(G.details(pairs), "none", "format")) == "x"
    assert value(spark, G.reviews(F.array(*map(F.lit, ["short", "a" * 20, "a" * 20, "b" * 21])))) == ["a" * 20, "b" * 21]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "i.csv").write_text("﻿Isbn-13\n 978 \n\n979\n", encoding="utf-8")
    assert [r[0] for r in S.read_isbns(spark, str(tmp_path / "i.csv")).collect()] == ["978", "979"]
    with pytest.raises(ValueError, match="no column"):
        S.read_isbns(spark, str(tmp_path / "i.csv"), "other")
    (tmp_path / "a.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert S.read_json_array(spark, str(tmp_path / "a.json"), "a int").count() == 2
    assert S.read_checkpoint(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "978 b good reads 1.txt").write_text("text")
    (tmp_path / "978 r amazon 2.txt").write_text("  ")
    assert [tuple(r)[1:] for r in S.read_text_evidence(spark, str(tmp_path / "*.txt")).collect()] == [("978", "b", "Good Reads", "[Good Reads] text")]
    df = spark.createDataFrame([(1, 'a "q" | b\nc', None)], "k int, t string, n string")
    S.write_csv(df, str(tmp_path / "out"))
    assert [tuple(r) for r in S.read_csv(spark, str(tmp_path / "out")).collect()] == [("1", 'a "q" | b\nc', None)]
    assert not S.write_csv_if_any(df.limit(0), str(tmp_path / "no")) and not (tmp_path / "no").exists()
    tree = '{"Fiction": {"A": ["x", "y"]}, "Nonfiction": []}'
    table = S.taxonomy_table(spark, tree, '{"Book_Metadata_Hierarchy": {"P": ["q"]}}')
    assert [(r["kind"], r["path"]) for r in table.orderBy("kind", "seq").collect()] == [("genre", p) for p in ["Fiction", "Fiction / A", "Fiction / A / x", "Fiction / A / y", "Nonfiction"]] + [("metadata", "P"), ("metadata", "P / q")]
    assert S.without_subtree(table, "Fiction / A").count() == 4
    assert S.repaired_json('x {"a": [1, 2,], /// note\n "b’s": 1,} tail') == {"a": [1, 2], "b's": 1}


@pytest.fixture
def fake():
    def answer(prompt, provider, model, max_tokens):
        if "quota" in prompt:
            raise RuntimeError("429 tokens per day")
        return "oops" if "bad" in prompt else '{"genre_paths": ["F"], "metadata_paths": []}'

    return answer


def test_runner_resumes(spark, fake):
    tasks = spark.createDataFrame([("1", "p", "m", "ok"), ("2", "p", "m", "bad"), ("3", "p", "m", "quota"), ("4", "p", "m", "ok")], resume.TASK).coalesce(1)
    held = runner.parsed(runner.ask(tasks, fake))
    rows = {r["isbn13"]: r for r in held.collect()}
    assert set(rows) == {"1", "2", "3"} and rows["1"]["status"] == "success" and rows["1"]["genre_paths"] == ["F"]
    assert rows["2"]["error"].startswith("incomplete_or_non_json: oops")
    assert {r["isbn13"] for r in runner.pending(tasks, held).collect()} == {"2", "3", "4"}
    with pytest.raises(ValueError):
        runner.provider_for("nobody")
    waits, calls = [], iter([runner.RateLimited(3), ConnectionError(), None])

    def flaky(*_):
        if e := next(calls):
            raise e
        return "done"

    assert runner.with_retry(flaky, sleep=waits.append)("", "", "", 1) == "done" and waits == [5, 2]
    assert runner.until_done(iter([5, 4, 4, 4, 4]).__next__) == [5, 4, 4, 4, 4] and runner.until_done(iter([2, 0]).__next__) == [2, 0]


def test_stream_asks_once(spark, fake, tmp_path):
    folder, table, state = (str(tmp_path / n) for n in ("tasks", "table", "state"))
    tasks = spark.createDataFrame([("1", "p", "m", "ok"), ("1", "p", "m", "ok"), ("2", "p", "m", "ok")], resume.TASK)
    tasks.write.json(folder)
    for _ in range(2):
        resume.start(resume.task_stream(spark, folder), table, state, fake).awaitTermination()
        tasks.write.mode("append").json(folder)
    assert spark.read.parquet(table).count() == 2


def test_stream_pauses_for_its_run_and_validates(spark, tmp_path):
    folder, table, state = (str(tmp_path / n) for n in ("tasks", "table", "state"))
    asked = str(tmp_path / "asked")
    spent = {"m"}

    def answer(prompt, provider, model, max_tokens):
        with open(asked, "a") as f:
            f.write(f"{prompt}\n")
        if model in spent:
            raise RuntimeError("429: tokens per day")
        return f'{{"genre_paths": ["{prompt}"], "metadata_paths": []}}'

    taxonomy = spark.createDataFrame([("genre", "F")], "kind string, path string")
    tasks = lambda *rows: spark.createDataFrame(rows, resume.TASK).coalesce(1).write.mode("append").json(folder)
    go = lambda: resume.start(resume.task_stream(spark, folder), table, state, answer, taxonomy).awaitTermination()
    tasks(("1", "p", "m", "F"), ("2", "p", "m", "F"), ("3", "p", "n", "F"), ("4", "p", "n", "X"))
    go()
    held = {(r.isbn13, r.model): r for r in spark.read.parquet(table).collect()}
    assert {k: r.status for k, r in held.items()} == {("1", "m"): "error", ("3", "n"): "success", ("4", "n"): "error"} and held["4", "n"].error == "invalid_genre: genre: X"
    assert len(open(asked).read().split()) == 3  # each task once; the paused model's second task not at all
    # another run: the quota is there again, what succeeded isn't asked for
    spent.clear()
    tasks(("1", "p", "m", "F"), ("2", "p", "m", "F"), ("3", "p", "n", "F"), ("4", "p", "n", "F"))
    go()
    done = spark.read.parquet(table).filter("status = 'success'")
    assert sorted((r.isbn13, r.model) for r in done.collect()) == [("1", "m"), ("2", "m"), ("3", "n"), ("4", "n")]
    assert len(open(asked).read().split()) == 6
