"""Steps whose time or memory must not grow faster than their input."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from labelforge import fixtures as X
from labelforge.functions import responses as R
from labelforge.operators import agreement as A
from labelforge.operators import consensus as C
from labelforge.operators import debate as D
from labelforge.operators import integration as I
from labelforge.operators import pages as G
from labelforge.plans import records, registry


def test_pages_are_dealt(spark, sf_dir, monkeypatch):
    """Pages made of one narrow file are parsed by many tasks."""
    monkeypatch.setattr(records, "PER_TASK", 20)
    for pages in (records._shop_pages, records._good_pages):
        df = pages(spark, sf_dir)
        held = [n for n in df.rdd.glom().map(len).collect() if n]
        assert sum(held) == X.read(spark, sf_dir, "part").count() and len(held) > 5 and max(held) < 60


def test_page_is_parsed_once(spark, monkeypatch):
    html = '<p id="a">One <b class="x y">two</b></p>three &amp; four<p id="">five'
    df = spark.createDataFrame([(html,), (None,), ("",)], "html string")
    spec = {"text": (None, ["b.x.y", "p"]), "id": ("id", ["p"])}
    rows = df.select(G.picked(F.col("html"), spec, "page").alias("f"), G.page_text(F.col("html")).alias("t")).collect()
    assert [r.f["page"] for r in rows] == [r.t for r in rows] == ["One two three & four five", "", ""]
    assert rows[0].f["text"] == [["two"], ["One two", "five"]] and rows[0].f["id"] == [["a", ""]]
    index = G.Index(G._Tree(html).nodes)
    assert G.select(index, "p", "id") == ["a", ""]
    monkeypatch.setattr(G, "_matches", None)  # the second field finds the elements that the first found
    assert G.select(index, "p") == ["One two", "five"]


def test_source_records_are_dealt(spark, sf_dir, monkeypatch):
    """Records of a book are made, sorted and merged in many tasks, behind one shuffle of the narrow table; whole records are not broadcast."""
    monkeypatch.setattr(X, "PER_TASK", 20)
    records_ = X.sources(spark, sf_dir)
    held = [n for n in records_.rdd.glom().map(len).collect() if n]
    assert len(held) > 5 and max(held) < 240
    plan = I.latest_records(records_)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    joined = I.merged(records_, X.wanted(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in joined and "SortMergeJoin" in joined


def _shuffles(df):
    """Shuffles by book in a plan."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(isbn13")


def test_labels_are_dealt_by_book_once(spark, sf_dir):
    """Lines are shuffled as narrow rows; labels, and what is grouped by book after them, stay where they are."""
    labels = X.labels(spark, sf_dir).repartition("isbn13")
    assert _shuffles(labels) == 2  # lines and orders
    assert _shuffles(C.book_consensus(labels)) == 2
    assert _shuffles(A.path_support(labels)) == 2


def test_matching_of_many(spark):
    rng = np.random.default_rng(3)
    for a, b in ((1, 1), (1, 5), (4, 1), (2, 2), (3, 5), (5, 3), (7, 8), (2, 9), (9, 3)):
        w = rng.integers(0, 7, (40, a, b)) / 6
        assert np.allclose(A.matching_weights(w), [A.matching_weight(x) for x in w])
    rows = [(1, 0, 1, ["A / B", "C"], [], ["A", " / "], ["D"]), (2, 0, 1, [], [], [], ["D"]), (3, 0, 2, ["A / B", "A"], [], ["A / B / C"], [])]
    pairs = spark.createDataFrame(rows, "isbn13 long, m_a int, m_b int, genre_a array<string>, metadata_a array<string>, genre_b array<string>, metadata_b array<string>")
    found = {(r.isbn13, r.field): r.similarity for r in A.one_to_one(pairs).collect()}
    assert found == {(1, "genre"): 0.333333, (1, "metadata"): 0.0, (2, "genre"): None, (2, "metadata"): 0.0, (3, "genre"): 0.533333, (3, "metadata"): None}
    assert [r.isbn13 for r in A.one_to_one(pairs, "size(a) = 2 and size(b) = 1").collect()] == [3]


def test_votes_may_name_their_book(spark):
    """Rounds with and without the book's number give the same verdicts."""
    open_ = spark.createDataFrame([("x", 1, "Genre", "A", 1, [0], [1, 2]), ("y", 2, "Genre", "B", 2, [0, 1], [2])], "debate_id string, isbn13 long, annotation_type string, path string, support_count long, models_for array<int>, models_against array<int>")
    first = spark.createDataFrame([("x", 1, 0, "MAINTAIN"), ("y", 2, 0, "RETRACT"), ("y", 2, 1, "MAINTAIN"), ("z", 3, 0, "RETRACT")], "debate_id string, isbn13 long, m int, decision string")
    second = spark.createDataFrame([("x", 1, 1, "ACCEPT"), ("x", 1, 2, "REJECT")], "debate_id string, isbn13 long, m int, decision string")
    named = D.verdicts(open_, first, second).orderBy("debate_id").collect()
    bare = D.verdicts(open_, first.drop("isbn13"), second.drop("isbn13")).orderBy("debate_id").collect()
    assert named == bare and [(r.debate_id, r.verdict) for r in named] == [("x", "MANUAL"), ("y", "MANUAL")]
    asked = [sorted((r.debate_id, r.isbn13, r.m) for r in D.round2_eligible(open_, f).collect()) for f in (first, first.drop("isbn13"))]
    assert asked == [[("x", 1, 1), ("x", 1, 2)]] * 2


def test_consensus_is_made_once(spark):
    labels = spark.createDataFrame([(1, 0, "genre", "A / B"), (1, 1, "genre", "A"), (1, 2, "genre", "C / D")], "isbn13 long, m int, field string, path string")
    held = C.book_consensus(labels)
    assert C.canonical(held).collect() == C.canonical(labels).collect() and len(C.singleton_review(held).collect()) == 3
    decided = spark.createDataFrame([(1, "genre", "C / D", "ACCEPT"), (1, "genre", "C", "ACCEPT"), (1, "genre", "E", "REJECT")], "isbn13 long, field string, path string, decision string")
    final = D.silver(held, decided)
    assert sorted((r.path, r.source) for r in D.provenance(final, held, decided).collect()) == [("A", "automatic_consensus"), ("C / D", "accepted_adjudication")]
    assert D.representation(final, decided).collect() == []
    assert [r.path for r in D.representation(final.filter("path = 'A'"), decided).orderBy("path").collect()] == ["C", "C / D"]


def test_replies_are_parsed_once(spark, sf_dir, monkeypatch):
    """Replies of a debate go to Python in one step and need no grouping; a text that recurs is read once."""
    df = registry.QUERIES["response_normalise"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "from_json" not in plan and "regexp" not in plan
    assert _shuffles(df) == 3 and "debate_id" not in "".join(x for x in plan.splitlines() if "Exchange" in x)  # lines, orders, who answered

    read, loads = [], R.json.loads
    monkeypatch.setattr(R.json, "loads", lambda x: read.append(x) or loads(x))
    texts = pa.array([["left out"], ['{"decision": "KEEP"}'] * 2, None, [], ['x {"decision": "keep"}', None, '{"decision": "KEEP"} .']])[1:]
    found = R.reply_fields.func(texts).to_pylist()
    assert [None if x is None else [r and r["decision"] for r in x] for x in found] == [["KEEP"] * 2, None, [], ["KEEP", None, "KEEP"]]
    assert len(read) == 3


def test_odd_replies(spark):
    ok = '{"decision": " maintain ", "evidence_tags": ["a", " b ", "", null], "justification": " so "}'
    expected = {
        ok: None, f"```json\n{ok}\n```": None, f"Sure: {ok} bye": None, f"[{ok}]": None, '{"decision": "RETRACT", "justification": 5}': None, '{"decision": "RETRACT", "evidence_tags": null, "justification": "\\ud83d"}': None,
        "": "no_object", "}{": "no_object", "{" * 300_000: "no_object", f"{ok} }}": "not_an_object", ok + ok: "not_an_object", '{"a":' * 100_000 + "1" + "}" * 100_000: "not_an_object", "{'decision': 'RETRACT'}": "not_an_object",
        "{}": "bad_decision", '{"decision": ["RETRACT"]}': "bad_decision", '{"decision": "RETRACT", "evidence_tags": "[a]", "justification": "x"}': "evidence_not_list", '{"decision": "RETRACT", "evidence_tags": [{"a": [1, 2]}]}': "unknown_evidence", '{"decision": "RETRACT", "justification": " "}': "no_justification",
    }
    rows = spark.createDataFrame([([*expected, None],)], "raws array<string>")
    tags = F.array(F.lit("a"), F.lit("b"))
    many = rows.select(R.debate_replies(F.col("raws"), ["MAINTAIN", "RETRACT"], tags).alias("r")).first().r
    assert [x.error for x in many] == [*expected.values(), "no_object"]
    assert tuple(many[0]) == (None, "MAINTAIN", ["a", "b"], "so") and [many[i].justification for i in (4, 5)] == ["5", "?"] and many[-1].evidence_tags is None
    single = rows.select(F.explode("raws").alias("raw")).select(R.debate_reply(F.col("raw"), ["MAINTAIN", "RETRACT"], tags).alias("r")).collect()
    assert [x.r for x in single] == many
