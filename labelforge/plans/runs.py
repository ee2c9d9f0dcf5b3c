"""Queries over runs and their records: provider calls, filtering, collection, refreshed records, trees and text values."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelforge import fixtures as X
from labelforge.functions import paths as P
from labelforge.functions import text as T
from labelforge.operators import agreement as A
from labelforge.operators import pages as G
from labelforge.operators import trees
from labelforge.plans import registry as Q
from labelforge.plans import runner
from labelforge.plans.registry import BASE, PAIRS, TAX, register
from labelforge.sources import tables as S
from labelforge.sources.shared import new_folder


def _echo(prompt: str, name: str, model: str, max_tokens: int) -> str:
    """A provider that answers with its prompt, in the form of a chat response."""
    return runner.unwrapped({"choices": [{"finish_reason": "stop", "message": {"content": prompt}}]})


@register("annotation_run", PAIRS + ",\n" + TAX[len(BASE) + 2 :], """SELECT isbn13, m, CASE isbn13%10 WHEN 0 THEN 'incomplete_or_non_json' WHEN 2 THEN 'missing_keys' WHEN 3 THEN 'genre_paths_not_list' WHEN 6 THEN 'genre_paths_not_strings' WHEN 7 THEN 'empty_response' WHEN 5 THEN 'success'
  ELSE CASE WHEN EXISTS (SELECT 1 FROM (SELECT unnest(genre) AS x) WHERE x NOT IN (SELECT path FROM tax WHERE kind='genre')) THEN 'invalid_genre'
  WHEN EXISTS (SELECT 1 FROM (SELECT unnest(metadata) AS x) WHERE x NOT IN (SELECT path FROM tax WHERE kind='metadata')) THEN 'invalid_metadata' ELSE 'success' END END AS result
  FROM sets WHERE len(genre)+len(metadata)>0 AND isbn13%17<>3 UNION ALL SELECT o_orderkey, m, 'no_filtered_tags' FROM orders, (SELECT unnest([0,1,2])::INT AS m) WHERE o_orderkey%17=3""")
def annotation_run(s, d):
    """A run of all models: books without tags are passed over, answers are parsed strictly and held against the taxonomy."""
    books = X.read(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("isbn13"), F.when(F.col("o_orderkey") % 17 == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("t"))).alias("filtered_tags"))
    bare = runner.without_tags(books, [("p", str(m)) for m in X.MODELS])
    asked = X.responses(s, d).select(F.col("isbn13").cast("string").alias("isbn13"), F.lit("p").alias("provider"), F.col("m").cast("string").alias("model"), F.col("raw").alias("prompt"))
    answers = runner.parsed(runner.ask(asked.join(runner.annotatable(books).select("isbn13"), "isbn13", "left_semi"), _echo))
    rows = runner.validated(answers, X.taxonomy(s, d)).unionByName(bare)
    result = F.when(F.col("status") == "error", F.split_part("error", F.lit(":"), F.lit(1))).otherwise(F.col("status"))
    return rows.select(F.col("isbn13").cast("long").alias("isbn13"), F.col("model").cast("int").alias("m"), result.alias("result"))


@register("filter_run", "", """SELECT p_partkey AS isbn13, CASE WHEN p_partkey%4=3 THEN 'no_candidates' WHEN p_partkey%4 IN (0,1) THEN 'error' ELSE 'success' END AS status,
  CASE p_partkey%4 WHEN 3 THEN '' WHEN 2 THEN string_split(p_name,' ')[1] ELSE array_to_string(string_split(p_name,' '),'|') END AS tags FROM part""")
def filter_run(s, d):
    """Tags after a filtering call; where it failed or gave nothing, all candidates stay."""
    k, words = F.col("p_partkey"), F.split("p_name", " ")
    parts = X.read(s, d, "part").select(k.alias("isbn13"), words.alias("words"), k)
    candidates = parts.select("isbn13", F.when(k % 4 == 3, F.array().cast("array<string>")).otherwise(F.col("words")).alias("tags"))
    answers = parts.filter(k % 4 != 1).select("isbn13", F.when(k % 4 == 0, F.lit("timeout")).alias("error"), F.when(k % 4 != 0, F.slice("words", 1, 1)).alias("kept"))
    return runner.filter_fail_open(answers, candidates).select("isbn13", "status", F.array_join("tags", "|").alias("tags"))


@register("collect_run", "", """SELECT p_partkey::VARCHAR AS isbn13, CASE p_partkey%6 WHEN 0 THEN 'done' WHEN 1 THEN 'done' WHEN 2 THEN 'done' WHEN 3 THEN 'failed' WHEN 4 THEN 'failed' END AS state,
  CASE p_partkey%6 WHEN 0 THEN 'earlier' WHEN 1 THEN 'fetched' WHEN 2 THEN 'fetched' WHEN 3 THEN 'new error' WHEN 4 THEN 'old error' END AS what FROM part WHERE p_partkey%6<5""")
def collect_run(s, d):
    """One step of a resumable collection: what is done stays as it is, a success ends an earlier failure, a new failure replaces it."""
    k = F.col("p_partkey")
    every = X.read(s, d, "part").select(k.cast("string").alias("isbn13"), k)
    done = every.filter(k % 6 == 0).select("isbn13", F.lit("earlier").alias("title"))
    failed = every.filter((k % 6).isin(1, 3, 4)).select("isbn13", F.lit("old error").alias("error"))
    fetched = every.filter((k % 6).isin(0, 1, 2, 3)).select("isbn13", F.when(k % 6 != 3, F.lit("fetched")).alias("title"), F.when(k % 6 == 3, F.lit("new error")).alias("error"))
    done, failed = runner.collect_step(every.select("isbn13"), done, failed, fetched)
    return done.select("isbn13", F.lit("done").alias("state"), F.col("title").alias("what")).unionByName(failed.select("isbn13", F.lit("failed").alias("state"), F.col("error").alias("what")))


@register("refreshed_records", "", """SELECT p_partkey AS isbn13, coalesce(CASE WHEN p_partkey%5<>0 THEN p_name END, '') AS title, CASE WHEN p_partkey%3=0 THEN '' ELSE p_type END AS tags,
  CASE WHEN p_partkey%4=0 THEN '' ELSE 'b=' || p_brand END AS annotations FROM part""")
def refreshed_records(s, d):
    """Checkpoint records brought up to date with their books; annotations of models that are not asked any more go."""
    k = F.col("p_partkey")
    parts = X.read(s, d, "part")
    records = parts.filter(k % 4 != 0).select(k.alias("isbn13"), F.lit("stale").alias("title"), F.array(F.lit("stale")).alias("filtered_tags"), F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.col("p_brand")).alias("annotations"))
    books = parts.select(k.alias("isbn13"), F.when(k % 5 != 0, F.col("p_name")).alias("title"), F.when(k % 3 != 0, F.array("p_type")).alias("filtered_tags"))
    found = runner.refreshed(records, books, ["b", "c"])
    pairs = F.transform(F.array_sort(F.map_keys("annotations")), lambda m: F.concat(m, F.lit("="), F.col("annotations")[m]))
    return found.select("isbn13", "title", F.array_join("filtered_tags", ",").alias("tags"), F.array_join(pairs, ",").alias("annotations"))


# Round trips through the sinks and sources, in a folder of their own.


@register("csv_round_trip", "", "SELECT doc_id, lang, strlen(text) AS n_bytes, md5(text) AS digest FROM documents")
def csv_round_trip(s, d):
    """Whole texts, with quotes, commas and line breaks, through CSV."""
    path = new_folder(s, "csv")
    S.write_csv(X.read(s, d, "documents").select("doc_id", "lang", "text"), path)
    back = S.read_csv(s, path, "doc_id long, lang string, text string")
    return back.select("doc_id", "lang", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("digest"))


@register("by_model_round_trip", PAIRS, "SELECT isbn13, m, array_to_string(genre, ' | ') AS genre, array_to_string(metadata, ' | ') AS metadata FROM sets")
def by_model_round_trip(s, d):
    """Label sets in a folder for each model."""
    path = new_folder(s, "models")
    S.write_by(A.label_sets(Q._p(s, d), Q._l(s, d)), path, "m")
    back = s.read.schema("isbn13 long, genre array<string>, metadata array<string>, m int").json(path)
    return back.select("isbn13", "m", *[F.array_join(c, " | ").alias(c) for c in X.FIELDS])


@register("checkpoint_round_trip", BASE, "SELECT isbn13, m, CASE WHEN isbn13%3=0 THEN 'new' ELSE status END AS status FROM p WHERE isbn13%5<>0 OR isbn13%3=0")
def checkpoint_round_trip(s, d):
    """A checkpoint table: empty where there is none, then replaced twice by what it holds and new rows of the same keys."""
    path, schema = new_folder(s, "checkpoint"), "isbn13 long, m int, status string"
    rows = X.presence(s, d).select("isbn13", "m", "status")
    for new in (rows.filter("isbn13 % 5 <> 0"), rows.filter("isbn13 % 3 = 0").withColumn("status", F.lit("new"))):
        S.replace_table(S.upsert(S.read_checkpoint(s, path, schema), new, ["isbn13", "m"]), path)
    return S.read_checkpoint(s, path, schema)


@register("frozen_snapshot", "", "SELECT p_partkey, p_name, p_size FROM part")
def frozen_snapshot(s, d):
    """A snapshot that is read only if it has the counts that its table had."""
    path = new_folder(s, "frozen")
    parts = X.read(s, d, "part").select("p_partkey", "p_name", "p_size")
    parts.write.parquet(path)
    wanted = {"all": "true", "small": "p_size < 10", "named": "p_name is not null"}
    counts = parts.agg(*[F.count_if(F.expr(where)).alias(n) for n, where in wanted.items()]).first()
    return S.read_frozen(s, path, {n: (where, counts[n]) for n, where in wanted.items()})


@register("json_cells", "", """SELECT p_partkey, '{"name": "' || p_name || '", "sizes": [' || p_size || ', null], "type": "é ' || p_type || '"}' AS cell FROM part""")
def json_cells(s, d):
    cell = F.struct(F.concat(F.lit("é "), "p_type").alias("type"), F.array("p_size", F.lit(None).cast("int")).alias("sizes"), F.col("p_name").alias("name"))
    return X.read(s, d, "part").select("p_partkey", S.json_cell(cell).alias("cell"))


@register("support_order", BASE, "SELECT isbn13, field, string_agg(path||' ('||votes||')', ' | ' ORDER BY votes DESC, path) AS paths FROM s GROUP BY 1, 2")
def support_order(s, d):
    told = lambda x: F.concat(x["path"], F.lit(" ("), x["votes"].cast("string"), F.lit(")"))
    return A.support_order(Q._l(s, d)).select("isbn13", "field", F.array_join(F.transform("paths", told), " | ").alias("paths"))


@register("tree_paths", """RECURSIVE nd AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey%101<>7 THEN o_orderkey//2 END AS parent, 'N'||(o_orderkey%7) AS label FROM orders),
  tr AS (SELECT id, label AS path, 1 AS depth, id AS root FROM nd WHERE parent IS NULL OR parent=id OR parent NOT IN (SELECT id FROM nd) UNION ALL
  SELECT nd.id, tr.path||' / '||nd.label, tr.depth+1, tr.root FROM nd JOIN tr ON nd.parent=tr.id WHERE nd.id<>nd.parent)""", "SELECT * FROM tr")
def tree_paths(s, d):
    """Paths of a forest of orders: each below the one of half its number, but for every 101st."""
    k = F.col("o_orderkey")
    up = F.expr("o_orderkey div 2")
    nodes = X.read(s, d, "orders").select(k.alias("id"), F.when((k % 101 != 7) & (up != k), up).alias("parent"), F.concat(F.lit("N"), (k % 7).cast("string")).alias("label"))
    return trees.tree_paths(nodes)


@register("text_values", "", """SELECT p_partkey AS k, CASE WHEN lower(p_name)=lower(p_type) THEN p_name ELSE p_name||','||p_type END AS pipe, p_type AS label, p_brand AS leaf, CASE WHEN p_partkey%2=0 THEN p_type ELSE 'Other / '||p_type END AS stripped,
  'https://x/http://'||p_partkey AS url, p_partkey%3=0 AS quota, 'https://shop/dp/'||p_partkey AS product, CASE WHEN p_partkey%4=0 THEN 'https://books/book/show/'||p_partkey END AS book FROM part""")
def text_values(s, d):
    """Lists between bars, labels, leaves of loose paths, roots taken off, addresses, spent quotas, links of search pages."""
    k, name, kind, key = F.col("p_partkey"), F.col("p_name"), F.col("p_type"), F.col("p_partkey").cast("string")
    label = F.when(k % 3 == 0, F.concat(F.lit("Language: "), kind)).when(k % 3 == 1, F.concat(F.lit("LANGUAGE - "), kind)).otherwise(F.concat(F.lit(" language  "), kind))
    error = F.when(k % 3 == 0, "Error 429: limit on Tokens per Day (TPD)").when(k % 3 == 1, "429: too many requests").otherwise("tokens per day")
    quote = F.when(k % 2 == 0, F.lit("'")).otherwise(F.lit('"'))
    book = F.when(k % 4 == 0, F.concat(F.lit("<a title=b href="), quote, F.lit("/book/show/"), key, F.lit("?q=1"), quote, F.lit(">b</a>"))).otherwise("")
    html = F.concat(F.lit("<link href='/dp/0'><a name=x>n</a>"), book, F.lit("<A class=p HREF="), quote, F.lit("/dp/"), key, F.lit("?ref=1"), quote, F.lit(">p</A><a href=/dp/9>later</a>"))
    return X.read(s, d, "part").select(
        k.alias("k"),
        F.array_join(T.split_pipe(F.concat(F.lit(" "), name, F.lit(" | |"), F.upper(name), F.lit("| "), kind)), ",").alias("pipe"),
        T.language_label(F.ltrim(label)).alias("label"),
        P.loose_leaf(F.concat(kind, F.lit("/ "), F.col("p_brand"), F.lit(" /"))).alias("leaf"),
        T.strip_root(F.concat(F.when(k % 2 == 0, "Root / ").otherwise("Other / "), kind), "Root").alias("stripped"),
        T.https(F.concat(F.lit("http://x/http://"), key)).alias("url"),
        T.quota_exhausted(error).alias("quota"),
        G.product_url(html, "https://shop").alias("product"),
        G.book_url(html, "https://books").alias("book"),
    )
