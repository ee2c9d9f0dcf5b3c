"""Sources, sinks, expectations, provider runs and page parts on literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from labelforge.operators import debate as D
from labelforge.operators import expectations as E
from labelforge.operators import integration as I
from labelforge.operators import openlibrary as O
from labelforge.operators import pages as G
from labelforge.plans import prompts, runner
from labelforge.sources import tables as S


def test_json_checkpoint_is_empty_unless_a_list(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"isbn13": "1", "status": "success"},\n {"isbn13": "2"}]')
    for name, text in (("b", '{"isbn13": "3"}'), ("c", "[{"), ("d", "")):
        (tmp_path / f"{name}.json").write_text(text)
    rows = S.read_json_checkpoint(spark, str(tmp_path), "isbn13 string, status string").collect()
    assert sorted((r["isbn13"], r["status"]) for r in rows if r["isbn13"]) == [("1", "success"), ("2", None)]
    assert S.read_json_checkpoint(spark, str(tmp_path / "none"), "isbn13 string").count() == 0


def test_keyed_files(spark, tmp_path):
    (tmp_path / "978 1.json").write_text('{"genre_union": ["A"], "provenance": {"A": ["Amazon"]}}')
    (tmp_path / "9782.json").write_text('{"isbn13": "9782", "source_genres": null}')
    rows = {r["isbn13"]: r for r in S.read_keyed(spark, str(tmp_path)).collect()}
    some = sorted(rows)[:1]
    asked = lambda *ids: spark.createDataFrame([(i,) for i in ids], "isbn13 string")
    assert [r["isbn13"] for r in S.read_keyed(spark, str(tmp_path), keys=asked(*some, *some)).collect()] == some
    with pytest.raises(E.Violated, match="no file"):
        S.read_keyed(spark, str(tmp_path), keys=asked(*some, "not there"))
    assert rows["978 1"]["genre_union"] == ["A"] and rows["978 1"]["provenance"] == {"A": ["Amazon"]}
    assert rows["9782"]["genre_union"] == [] and rows["9782"]["source_genres"] == {}


def test_csv_limit(spark, tmp_path):
    (tmp_path / "a.csv").write_text("isbn13,title\n0012,x\n0013,y\n")
    assert [r["isbn13"] for r in S.read_csv(spark, str(tmp_path / "a.csv"), "isbn13 string, title string", limit=1).collect()] == ["0012"]


def test_json_array_is_atomic(spark, tmp_path):
    path = tmp_path / "out.json"
    df = spark.createDataFrame([(1, "é"), (2, None)], "id int, t string")
    assert S.write_json_array(df, str(path)) == 2
    assert json.loads(path.read_text()) == [{"id": 1, "t": "é"}, {"id": 2, "t": None}] and "é" in path.read_text()
    with pytest.raises(RuntimeError), S.atomic(str(path)) as f:
        f.write("half")
        raise RuntimeError
    assert json.loads(path.read_text())[0]["id"] == 1 and [p.name for p in tmp_path.iterdir()] == ["out.json"]
    assert S.write_json_array(df.limit(0), str(path)) == 0 and json.loads(path.read_text()) == []


def test_replaced_table_may_read_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    S.replace_table(spark.range(3), path)
    S.replace_table(spark.read.parquet(path).filter("id > 0"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2]
    with pytest.raises(Exception):
        S.replace_table(spark.read.parquet(path).select(F.raise_error(F.lit("no")).alias("id")), path)
    assert spark.read.parquet(path).count() == 2


def test_json_cell_report_and_metrics(spark):
    row = spark.sql("select named_struct('b', array('x', 'é'), 'a', 1) v").select(S.json_cell(F.col("v")).alias("c")).first()
    assert row["c"] == '{"a": 1, "b": ["x", "é"]}'
    assert S.report_text("Books", spark.sql("select 3 n, 12 others")) == "Books\n=====\nn       3\nothers  12\n"
    df, seen = S.observed(spark.range(5), "m", rows=F.count(F.lit(1)))
    df.collect()
    assert seen.get == {"rows": 5}


def test_frozen_snapshot(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "f"))
    assert S.read_frozen(spark, str(tmp_path / "f"), {"all": ("true", 10), "odd": ("id % 2 = 1", 5)}).count() == 10
    with pytest.raises(ValueError, match="odd"):
        S.read_frozen(spark, str(tmp_path / "f"), {"odd": ("id % 2 = 1", 4)})


def test_taxonomy_repair():
    text = '// x\n{"A�": {"it’s": [], "Teh": []},\n[RM#] gone\n "B": [] /// note\n}\n{"second": 1}'
    assert S.repaired_json(text, {"Teh": "The"}) == {"A": {"it's": [], "The": []}, "B": []}
    assert S.repair_diagnostics(text) is None
    found = S.repair_diagnostics('{"a": 1,\n "b" 2}')
    assert found["line"] == 2 and (2, ' "b" 2}') in found["context"]


def test_expectations(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    with pytest.raises(E.Violated, match="values"):
        E.enforce(E.outside_domain(df, {"v": ("a", "b")}), "values")
    E.enforce(E.outside_domain(df.filter("k = 1"), {"v": ("a",)}), "values")
    with pytest.raises(E.Violated):
        E.joined(df, df.filter("k = 1").select("k"), ["k"], "books")
    assert E.joined(df, df.select("k"), ["k"], "books").count() == 2
    assert E.out_of_bounds(df, "k", 0, 1).count() == 1
    assert E.partition_incomplete(df, {"x": df.filter("k = 1"), "y": df.filter("k = 2")}, "k").count() == 0


def test_audit_report(spark):
    from labelforge.operators import debate as D

    final = spark.createDataFrame([(1, ["Fiction / A", "Nonfiction"], ["M"], "debate_resolver"), (1, ["Fiction / A"], [], "agreement_2_of_3"), (2, [], [], "agreement_2_of_3")], "isbn13 int, genre array<string>, metadata array<string>, method string")
    manual = spark.createDataFrame([(2,), (3,)], "isbn13 int")
    taxonomy = spark.createDataFrame([("genre", "Fiction / A"), ("metadata", "M")], "kind string, path string")
    report = E.audit(final, manual, D.violations(final, manual, taxonomy))
    assert report["resolved_records"] == 3 and report["total_accounted"] == 5 and report["duplicate_isbn_occurrences"] == 2
    assert report["resolution_methods"] == {"agreement_2_of_3": 2, "debate_resolver": 1} and report["top_genre_paths"][0] == ("Fiction / A", 2)
    assert report["both_roots"] == 1 and report["empty_final"] == 1 and report["invalid_genre"] == 1 and report["final_and_manual"] == 1
    with pytest.raises(E.Violated, match="both_roots"):
        E.enforce_audit(report)
    E.enforce_audit(dict.fromkeys(E.ZERO, 0))


def test_unwrapped_responses():
    assert runner.unwrapped({"choices": [{"message": {"content": "x"}, "finish_reason": "stop"}]}) == "x"
    for bad in ({"error": {"message": "no"}}, {"choices": []}, {"choices": [{"message": {"content": ""}}]}):
        with pytest.raises(RuntimeError):
            runner.unwrapped(bad)
    with pytest.raises(runner.TooLong):
        runner.unwrapped({"choices": [{"finish_reason": "length", "message": {"content": "x"}}]})


def test_length_and_correction_retries():
    asked = []

    def provider(prompt, name, model, most):
        asked.append((prompt, most))
        if most < 700 and len(asked) == 1:
            raise runner.TooLong("finish_reason=length")
        return "bad" if len(asked) < 3 else "good"

    call = runner.with_corrections(provider, lambda raw: None if raw == "good" else "not good")
    assert call("q", "p", "m", 350) == "good"
    assert [most for _, most in asked] == [350, 700, 350]
    assert asked[2][0] == prompts.correction("q", "not good") and "not good" in asked[2][0]
    with pytest.raises(RuntimeError, match="other"):
        runner.with_corrections(lambda *_: (_ for _ in ()).throw(RuntimeError("other")), lambda raw: None)("q", "p", "m", 1)


def test_prompts_hold_their_data(spark):
    row = spark.sql("select 'T' t, array('x\"y') tags, array('A / B') g, array('M') m, 'P' p, 'notes' n")
    c = F.col
    texts = row.select(prompts.filter_tags(c("t"), c("n"), F.lit(None).cast("string"), c("tags")), prompts.annotate(c("t"), c("tags"), c("g"), c("m")), prompts.resolve(c("t"), c("tags"), c("g"), c("m"), c("n")), prompts.round1(c("p"), c("tags"), c("g")), prompts.round2(c("p"), c("tags"), c("g"))).first()
    assert all('["x\\"y"]' in t for t in texts) and all("notes" in texts[i] for i in (0, 2)) and '["A / B"]' in texts[1]
    assert "MAINTAIN" in texts[3] and "REJECT" in texts[4]


def test_validated_answers(spark):
    taxonomy = spark.createDataFrame([("genre", "Fiction"), ("genre", "Nonfiction"), ("genre", "Fiction / A"), ("metadata", "M")], "kind string, path string")
    shape = "isbn13 string, model string, provider string, status string, genre_paths array<string>, metadata_paths array<string>, error string"
    rows = [("1", [" Fiction ", "Fiction"], ["M"]), ("2", ["X"], ["Y"]), ("3", ["Fiction"], ["Y"]), ("4", ["Fiction / A"], []), ("5", ["Fiction", "Nonfiction"], []), ("6", [], [])]
    answers = spark.createDataFrame([(i, "m", "p", "success", g, d, None) for i, g, d in rows] + [("7", "m", "p", "error", [], [], "old")], shape)
    candidates = spark.createDataFrame([(i, "genre", p) for i in "1356" for p in ("Fiction", "Nonfiction")] + [("1", "metadata", "M")], "isbn13 string, kind string, path string")
    out = {r["isbn13"]: r for r in runner.validated(answers, taxonomy, candidates).collect()}
    assert out["1"]["status"] == "success" and out["1"]["genre_paths"] == ["Fiction"]
    assert {i: out[i]["error"] for i in "234567"} == {"2": "invalid_genre: genre: X", "3": "invalid_metadata: metadata: Y", "4": "genre_outside_candidates: genre: Fiction / A", "5": "both_roots", "6": None, "7": "old"}


def test_resolve_debates(spark):
    books = spark.createDataFrame([("1", "T", ["x"], "a: F"), ("2", "U", ["y"], None)], "isbn13 string, title string, filtered_tags array<string>, annotations string")
    taxonomy = spark.createDataFrame([("genre", "Fiction"), ("metadata", "M")], "kind string, path string")
    candidates = spark.createDataFrame([("1", "genre", "Fiction"), ("2", "genre", "Fiction")], "isbn13 string, kind string, path string")

    def provider(prompt, name, model, most):
        assert most == 700 and '["Fiction"]' in prompt
        return '{"genre_paths": ["Fiction"], "metadata_paths": []}' if "Title: T" in prompt else '{"genre_paths": ["Fiction"], "metadata_paths": ["M"]}'

    out = {r["isbn13"]: r for r in runner.resolve_debates(books, candidates, taxonomy, provider, "p", "m").collect()}
    assert out["1"]["status"] == "success" and out["1"]["candidate_genre_paths"] == ["Fiction"] and out["1"]["candidate_metadata_paths"] == []
    assert out["2"]["error"] == "metadata_outside_candidates: metadata: M"


def test_spent_models_are_not_asked_again(spark):
    tasks = spark.createDataFrame([("1", "p", "m", "q"), ("1", "p", "n", "q")], "isbn13 string, provider string, model string, prompt string")
    held = spark.createDataFrame([("9", "m", "p", "error", [], [], "429: tokens per day", "run 2")], runner.CHECKPOINT)
    assert [r["model"] for r in runner.pending(tasks, held, runner.spent_models(held, "run 2")).collect()] == ["n"]
    # the pause ends with the run
    assert sorted(r["model"] for r in runner.pending(tasks, held, runner.spent_models(held, "run 3")).collect()) == ["m", "n"]


def test_refreshed_records(spark):
    records = spark.sql("select '1' isbn13, 'old' title, array('o') filtered_tags, map('a', 'x', 'b', 'y') annotations")
    books = spark.createDataFrame([("1", "new", None), ("2", None, ["t"])], "isbn13 string, title string, filtered_tags array<string>")
    out = {r["isbn13"]: r.asDict() for r in runner.refreshed(records, books, ["b", "c"]).collect()}
    assert out["1"] == {"isbn13": "1", "title": "new", "filtered_tags": [], "annotations": {"b": "y"}}
    assert out["2"] == {"isbn13": "2", "title": "", "filtered_tags": ["t"], "annotations": {}}


def test_collect_step(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "isbn13 string")
    done, failed = spark.createDataFrame([("1", "t1")], "isbn13 string, title string"), spark.createDataFrame([("2", "old"), ("3", "old")], "isbn13 string, error string")
    fetched = spark.createDataFrame([("1", "again", None), ("2", "t2", None), ("3", None, "new"), ("9", "t9", None)], "isbn13 string, title string, error string")
    done, failed = runner.collect_step(ids("1", "2", "3"), done, failed, fetched)
    assert sorted(map(tuple, done.collect())) == [("1", "t1"), ("2", "t2")] and [tuple(r) for r in failed.collect()] == [("3", "new")]


def test_selectors():
    nodes = G._Tree('<div id="a" class="x y"><p>One <br>two<b>three</b></p><img src="s"></div><p data-k="v">Four</p>').nodes
    assert G.select(nodes, "#a p") == ["One two three"] and G.select(nodes, "div.x.y b, p[data-k=v]") == ["three", "Four"]
    assert G.select(nodes, "div p b") == ["three"] and G.select(nodes, "p div") == [] and G.select(nodes, "img", "src") == ["s"] and G.select(nodes, "#a", "title") == [None]


def test_product_details(spark):
    html = '<ul id="detailBullets_feature_div"><li>Publisher : A</li><li>publisher: B: c</li><li>blank:</li></ul><table id="productDetailsTable"><tr><th>Paperback</th><td>1,024 pages</td></tr></table>'
    df = spark.createDataFrame([(html,)], "html string").withColumn("f", G.picked(F.col("html"), G.AMAZON)).withColumn("d", G.details(G.detail_pairs(F.col("f"))))
    row = df.select("d", G.product_pages(F.col("d"), F.lit("9 pages")).alias("n")).first()
    assert row["d"] == {"publisher": "B: c", "paperback": "1,024 pages"} and row["n"] == 1024


def test_details_pair_within_a_row(spark):
    html = (
        '<table id="productDetailsTable"><tr><th>Product details</th></tr><tr><th>Publisher</th><td>Orb</td></tr><tr><th>Language</th><td>English</td></tr><tr><td>cell alone</td></tr>'
        "<tr><td>Pages: 10</td></tr><tr><th>Pages</th><td>20</td></tr><tr><th>Empty</th><td></td></tr><tr><th>a</th><td><b>x</b> <i>y</i></td><td>z</td></tr></table>"
    )
    df = spark.createDataFrame([(html,)], "html string").withColumn("f", G.picked(F.col("html"), G.AMAZON))
    assert df.select(G.details(G.detail_pairs(F.col("f"))).alias("d")).first()["d"] == {"publisher": "Orb", "language": "English", "pages": "20", "a": "x y"}


def test_links_in_any_quotes(spark):
    html = "<abbr href='/dp/no'>n</abbr><a class=\"x\" href='/dp/B1?tag=1'>one</a><A id=k HREF=/dp/B2>two</A><a data-href=\"/dp/B0\" href=\"/book/show/7?x\">b</a><a name='n'>no</a>"
    df = spark.createDataFrame([(html,)], "html string")
    row = df.select(G.links(F.col("html")).alias("l"), G.product_url(F.col("html"), "https://s").alias("p"), G.book_url(F.col("html"), "https://r").alias("b")).first()
    assert [tuple(x) for x in row.l] == [("/dp/B1?tag=1", "one"), ("/dp/B2", "two"), ("/book/show/7?x", "b")] and (row.p, row.b) == ("https://s/dp/B1", "https://r/book/show/7")


@pytest.mark.parametrize("kind", ['type="application/ld+json"', "type='application/ld+json'", "type=application/ld+json", 'data-x="a>b" TYPE = "application/ld+json" async'])
def test_json_ld_in_any_quotes(spark, kind):
    book = '{"@type": "Book", "name": "N"}'
    cases = {book: True, book + " trailing": False, "[1, " + book + "]": True, '{"@graph": [' + book + "]}": True, book[:-1]: False, '{"@type": ["Book"]}': False, "": False, '[{"@type": "Book"}] [': False}
    df = spark.createDataFrame([(i, f"<script {kind}>{c}</script>") for i, c in enumerate(cases)], "i int, html string")
    got = {r.i: r.b is not None for r in df.select("i", G.json_ld_book(F.col("html")).alias("b")).collect()}
    assert list(got.values()) == list(cases.values())
    both = f"<script type='application/json'>{book}</script><script {kind}>{{bad</script><script {kind}>{book}</script>"
    assert spark.createDataFrame([(both,)], "html string").select(G.json_ld_book(F.col("html")).alias("b")).first().b == book


def test_final_routing_by_debate_records(spark):
    routes = spark.createDataFrame([("P1", "perfect_3_of_3"), ("P2", "agreement_2_of_3"), ("D1", "conflict_3_original_models"), ("D2", "conflict_3_original_models"), ("D3", "conflict_2_original_models"), ("D4", "conflict_3_original_models"), ("I1", "insufficient_models"), ("N1", "no_filtered_tags")], "isbn13 string, route string")
    kind = "isbn13 string, status string, genre_paths array<string>, metadata_paths array<string>, provider string, model string"
    records = [("D1", "success", ["G"], ["M"], "groq", "big"), ("D2", "error", None, None, None, None), ("D3", "success", [], [], "groq", "big"), ("P1", "error", None, None, None, None)]
    got = {r[0]: tuple(r)[1:] for r in D.final_routing(routes, spark.createDataFrame(records, kind)).collect()}
    assert got == {
        "P1": ("final", "perfect_3_of_3_consensus", None, None), "P2": ("final", "agreement_2_of_3", None, None), "D1": ("final", "debate_resolver", "groq", "big"), "D2": ("manual", "debate_api_error", None, None),
        "D3": ("manual", "resolver_returned_empty", None, None), "D4": ("manual", "debate_not_run", None, None), "I1": ("manual", "insufficient_original_annotations", None, None), "N1": ("manual", "no_filtered_tags", None, None),
    }
    with pytest.raises(Exception, match="two debate records"):
        D.final_routing(routes, spark.createDataFrame(records[:1] * 2, kind)).collect()


def test_formats_by_priority(spark):
    texts = {"Kindle Edition or Paperback": "Kindle Edition", "Audiobooks": None, "mass market paperback": "Mass Market Paperback", "Paperback and Hardcover": "Hardcover", None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["f"] for r in df.select("t", G.format_of(F.col("t")).alias("f")).collect()} == texts


def test_openlibrary_parts(spark):
    one = lambda f, *texts: spark.createDataFrame([texts], ", ".join(f"c{i} string" for i in range(len(texts)))).select(f(*[F.col(f"c{i}") for i in range(len(texts))]).alias("v")).first()["v"]
    assert one(O.description, '{"value": " x  y "}') == "x y" and one(O.description, " z ") == "z"
    assert one(O.names, '[{"name": "A"}, "a", "B", {"x": 1}, {"name": " "}]') == ["A", "B"] and one(O.names, '{"name": "A"}') == []
    assert one(O.keys, '[{"key": "/works/1"}, "x"]') == ["/works/1"]
    assert one(O.edition_key, '{"url": "https://openlibrary.org/authors/1"}') is None
    assert one(O.cover, '{"covers": [0, 7]}', '{"cover": {"large": "", "small": "s"}}') == "s"


def test_provenance_is_by_exact_spelling(spark):
    records = spark.createDataFrame([(1, "OpenLibrary", 0, ["Magic", "magic", "Sea"]), (1, "Goodreads", 1, ["magic", "Sea"]), (1, "Amazon", 2, ["SEA"])], "isbn13 int, source string, ingest_seq int, tags array<string>")
    got = {r["tag"]: r["sources"] for r in I.tag_provenance(records).collect()}
    assert got == {"Magic": "OpenLibrary", "Sea": "OpenLibrary,Goodreads", "magic": "Goodreads", "SEA": "Amazon"}
    assert sorted(r["tag"] for r in I.merged_tags(records).collect()) == ["Magic", "Sea"]
