"""More queries: whole source records, pages, expectations, figures and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from labelforge import fixtures as X
from labelforge.functions import responses as R
from labelforge.operators import agreement as A
from labelforge.operators import consensus as C
from labelforge.operators import debate as D
from labelforge.operators import expectations as E
from labelforge.operators import integration as I
from labelforge.operators import openlibrary as O
from labelforge.operators import pages as G
from labelforge.plans import registry as Q
from labelforge.plans.registry import BASE, DEB, HIER, PAIRS, ROUTE, SILVER, SRC, TAX, THREE, register

# master records
FULL = (
    SRC
    + """,
wn AS (SELECT p_partkey::BIGINT AS isbn13 FROM part UNION ALL SELECT -p_partkey FROM part WHERE p_partkey%10=0 AND p_partkey>0),
pt AS (SELECT *, p_partkey%20<>0 AS gr, p_partkey%4<>0 AS am, p_partkey AS k FROM part),
fm AS (SELECT k AS isbn13, CASE WHEN k%4<>1 OR gr THEN p_brand ELSE '' END AS authors, CASE WHEN k%9=0 THEN 'India' ELSE '' END AS country, CASE WHEN k%2=0 THEN 'London' ELSE '' END AS publication_place,
      CASE WHEN k%5<>0 THEN '19'||(k%50+50) WHEN gr THEN 'May 1, 2001' ELSE '' END AS date_of_publication, CASE WHEN k%8<>0 THEN 'English' WHEN am THEN 'German' ELSE '' END AS language,
      CASE WHEN gr AND k%2=1 THEN 'Hardcover' WHEN am THEN 'Paperback' ELSE '' END AS physical_format, CASE WHEN gr AND k%3=0 THEN 'gr.jpg' WHEN am AND k%2=0 THEN 'am.jpg' ELSE 'ol.jpg' END AS cover_url,
      CASE WHEN gr AND k%3=0 THEN 'Goodreads' WHEN am AND k%2=0 THEN 'Amazon' ELSE 'OpenLibrary' END AS cover_source,
      concat_ws(' | ', CASE WHEN k%3=0 THEN 'Blurb one' END, CASE WHEN am THEN 'Blurb two' END) AS blurbs, concat_ws(' | ', CASE WHEN gr THEN 'Good book' END, CASE WHEN am THEN 'Fine' END) AS reviews FROM pt),
gn AS (SELECT isbn13, coalesce(string_agg(tag, ' | ' ORDER BY pos) FILTER (source='OpenLibrary'),'') AS openlibrary_genres, coalesce(string_agg(tag, ' | ' ORDER BY pos) FILTER (source='Goodreads'),'') AS goodreads_genres,
      coalesce(string_agg(tag, ' | ' ORDER BY pos) FILTER (source='Amazon'),'') AS amazon_genres FROM t1 GROUP BY 1)"""
)


def _master(s, d):
    return I.master(X.sources(s, d), X.wanted(s, d))


@register("flat_master", FULL, """SELECT wn.isbn13, coalesce(trim(title),'') AS title, coalesce(authors,'') AS authors, coalesce(publisher,'') AS publisher, coalesce(country,'') AS country, coalesce(publication_place,'') AS publication_place,
  coalesce(date_of_publication,'') AS date_of_publication, coalesce(language,'') AS language, coalesce(number_of_pages::VARCHAR,'') AS number_of_pages, coalesce(physical_format,'') AS physical_format,
  coalesce(openlibrary_genres,'') AS openlibrary_genres, coalesce(goodreads_genres,'') AS goodreads_genres, coalesce(amazon_genres,'') AS amazon_genres, coalesce(blurbs,'') AS blurbs, coalesce(reviews,'') AS reviews,
  coalesce(replace(available_sources, ',', ' | '),'') AS available_sources, coalesce(source_count,0) AS source_count
  FROM wn LEFT JOIN mas ON mas.isbn13=wn.isbn13 LEFT JOIN fm ON fm.isbn13=wn.isbn13 LEFT JOIN gn ON gn.isbn13=wn.isbn13""")
def flat_master(s, d):
    """The 17 columns of every book asked for, those in no source too."""
    return I.flat_master(_master(s, d))


@register("cover_provenance", FULL, "SELECT wn.isbn13, cover_url, cover_source AS cover_url_source FROM wn LEFT JOIN fm ON fm.isbn13=wn.isbn13")
def cover_provenance(s, d):
    return _master(s, d).select("isbn13", "cover_url", "cover_url_source")


@register("collected_texts", FULL, """SELECT k AS isbn13, 'blurb' AS kind, 'OpenLibrary' AS source, 'Blurb one' AS text FROM pt WHERE k%3=0 UNION ALL SELECT k, 'blurb', 'Amazon', 'Blurb two' FROM pt WHERE am
  UNION ALL SELECT k, 'review', 'Goodreads', 'Good book' FROM pt WHERE gr UNION ALL SELECT k, 'review', 'Goodreads', 'good book' FROM pt WHERE gr UNION ALL SELECT k, 'review', 'Amazon', 'Fine' FROM pt WHERE am""")
def collected_texts(s, d):
    m = _master(s, d)
    return m.select("isbn13", F.lit("blurb").alias("kind"), F.inline("blurbs")).unionByName(m.select("isbn13", F.lit("review").alias("kind"), F.inline("reviews")))


@register("evidence_columns", FULL, """SELECT count(*) AS books, count(*) FILTER (openlibrary_genres<>'') AS openlibrary_genres, count(*) FILTER (goodreads_genres<>'') AS goodreads_genres, count(*) FILTER (amazon_genres<>'') AS amazon_genres,
  count(*) FILTER (blurbs<>'') AS blurbs, count(*) FILTER (reviews<>'') AS reviews, count(*) FILTER (title IS NOT NULL) AS title, count(*) FILTER (language<>'') AS language
  FROM wn LEFT JOIN mas ON mas.isbn13=wn.isbn13 LEFT JOIN fm ON fm.isbn13=wn.isbn13 LEFT JOIN gn ON gn.isbn13=wn.isbn13""")
def evidence_columns(s, d):
    names = ["openlibrary_genres", "goodreads_genres", "amazon_genres", "blurbs", "reviews", "title", "language"]
    return flat_master(s, d).agg(F.count(F.lit(1)).alias("books"), *[F.count_if(F.col(c) != "").alias(c) for c in names])


@register("merged_lists", SRC, """, al AS (SELECT isbn13, tag, rank*1000+pos AS o FROM t1)
  SELECT isbn13, string_agg(tag, ' | ' ORDER BY o) AS tags FROM (SELECT isbn13, arg_min(tag, o) AS tag, min(o) AS o FROM al GROUP BY isbn13, lower(tag)) GROUP BY 1""")
def merged_lists(s, d):
    found = I.merged(X.sources(s, d))
    return found.select("isbn13", F.array_join(I.merged_lists(*[F.col(x)["tags"] for x in I.SOURCES]), " | ").alias("tags"))


@register("genre_union_missing", SRC, "SELECT -p_partkey::BIGINT AS isbn13 FROM part WHERE p_partkey%10=0 AND p_partkey>0")
def genre_union_missing(s, d):
    """Books asked for whose union of genres is missing, which a run would refuse."""
    return E.inner_or_missing(X.wanted(s, d), I.merged_tags(X.sources(s, d)).select("isbn13").distinct(), ["isbn13"])[1]


# pages
#: Pages that a task parses: a task takes about as many seconds however many pages there are.
PER_TASK = 5_000
GOOD = """gp AS (SELECT p_partkey AS k, p_name AS n, p_type AS t, p_brand AS b FROM part)"""


def _good_pages(s, d):
    k, n, t, b = F.col("p_partkey"), F.col("p_name"), F.col("p_type"), F.col("p_brand")
    book = F.concat(F.lit('{"@type":"Book","author":[{"name":" '), b, F.lit(' "},{"name":"'), F.upper(b), F.lit('"},"'), t, F.lit('"],"image":{"url":"","contentUrl":"'), b, F.lit('.jpg"},"description":"<p>On &amp; <b>'), n, F.lit('</b></p>"}'))
    script = (
        F.when(k % 4 == 0, book).when(k % 4 == 1, F.concat(F.lit('[{"@type":"Thing"},'), book, F.lit("]"))).when(k % 4 == 2, F.concat(F.lit('{"@type":"Page","@graph":[{"@type":"Thing"},'), book, F.lit("]}"))).otherwise(F.lit("{bad"))
    )
    html = F.concat(
        F.lit('<html><script type="application/ld+json">'), script, F.lit('</script><a class="x ContributorLink">By  '), t, F.lit('</a><a href="/author/show/1">by '), t, F.lit('</a><img class="ResponsiveImage" src="own.jpg">'),
        F.lit('<div class="a BookPageMetadataSection__genres"><span><a>'), n, F.lit("</a></span><a>"), F.upper(n), F.lit('</a><a>Magic</a></div><a href="/genres/x">Other</a>'),
        F.lit('<div data-testid="description">Told '), n, F.lit('</div><div class="ReviewText"><span class="Formatted">short</span><span class="Formatted">A review of '), n, F.lit(' at length</span></div>'),
    )
    return X.spread(X.read(s, d, "part"), "p_partkey", PER_TASK).select(k.alias("page_id"), html.alias("html"))


@register("reader_pages", GOOD, """SELECT k AS page_id, CASE WHEN k%4<>3 THEN b ELSE 'By '||t END AS authors, n||' | Magic' AS genres, CASE WHEN k%4<>3 THEN 'On & '||n ELSE 'Told '||n END AS blurb,
  CASE WHEN k%4<>3 THEN b||'.jpg' ELSE 'own.jpg' END AS cover, 'A review of '||n||' at length' AS reviews FROM gp""")
def reader_pages(s, d):
    rows = _good_pages(s, d).withColumn("book", G.json_ld_book(F.col("html"))).withColumn("f", G.picked(F.col("html"), G.GOODREADS))
    book, f = F.col("book"), F.col("f")
    return rows.select("page_id", F.array_join(G.goodreads_authors(book, f), " | ").alias("authors"), F.array_join(G.goodreads_genres(f), " | ").alias("genres"), G.goodreads_blurb(book, f).alias("blurb"), G.goodreads_cover(book, f).alias("cover"), F.array_join(G.reviews(F.flatten(f["reviews"])), " | ").alias("reviews"))


def _shop_pages(s, d):
    k, n, t, b = F.col("p_partkey"), F.col("p_name"), F.col("p_type"), F.col("p_brand")
    html = F.concat(
        F.lit("<h1><span>Other title</span></h1>"), F.when(k % 3 != 0, F.concat(F.lit('<span id="productTitle"> '), n, F.lit(" </span>"))).otherwise(""),
        F.lit('<div id="bylineInfo"><a class="a-link-normal contributorNameID">'), b, F.lit('</a><a class="a-link-normal">Follow</a><a class="a-link-normal">'), t, F.lit('</a></div>'),
        F.lit('<img id="landingImage" '), F.when(k % 2 == 0, F.concat(F.lit("data-a-dynamic-image='{\""), b, F.lit(".jpg\":[1,2],\"s.jpg\":[1]}'"))).otherwise(""), F.lit(' src="src.jpg">'),
        F.lit('<div id="wayfinding-breadcrumbs_feature_div"><a>Books</a><a> '), t, F.lit(' </a></div><div id="productDescription">'), F.when(k % 5 == 0, "too short").otherwise(F.concat(F.lit("A long description of the book "), n)), F.lit('</div><div id="aplus">What the maker says about it all</div>'),
        F.lit('<ul id="detailBullets_feature_div"><li><span>Print length :</span> <span>1,'), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(' pages</span></li><li>ISBN-13 : 978-'), F.lpad(k.cast("string"), 10, "0"), F.lit('</li></ul>'),
        F.lit('<table id="productDetailsTable"><tr><th>Publisher</th><td>'), b, F.lit('</td></tr></table><p>'), F.when(k % 4 == 0, "Paperback, also Kindle Edition").when(k % 4 == 1, "hardcover").when(k % 4 == 2, "Audiobooks").otherwise("Board Book"), F.lit('</p>'),
    )
    return X.spread(X.read(s, d, "part"), "p_partkey", PER_TASK).select(k.alias("page_id"), html.alias("html"))


@register("shop_pages", GOOD, """SELECT k AS page_id, CASE WHEN k%3<>0 THEN n ELSE 'Other title' END AS title, b||' | '||t AS authors, CASE WHEN k%2=0 THEN b||'.jpg' ELSE 'src.jpg' END AS cover, t AS genres,
  CASE WHEN k%5=0 THEN 'What the maker says about it all' ELSE 'A long description of the book '||n END AS description, b AS publisher, 1000+k%1000 AS pages,
  CASE k%4 WHEN 0 THEN 'Kindle Edition' WHEN 1 THEN 'Hardcover' WHEN 3 THEN 'Board Book' END AS format, CASE WHEN k%7=0 AND k>0 THEN 'ISBN mismatch: requested 9780000000000, page exposes 978'||lpad(k::VARCHAR,10,'0') END AS error FROM gp""")
def shop_pages(s, d):
    rows = _shop_pages(s, d).withColumn("f", G.picked(F.col("html"), G.AMAZON, "text")).withColumn("t", F.col("f")["text"])
    rows = rows.withColumn("d", G.details(G.detail_pairs(F.col("f")))).withColumn("isbn", G.isbn13(F.col("t")))
    f, t = F.col("f"), F.col("t")
    asked = F.when(F.col("page_id") % 7 == 0, "9780000000000").otherwise(F.col("isbn"))
    return rows.select("page_id", G.amazon_title(f).alias("title"), F.array_join(G.amazon_authors(f), " | ").alias("authors"), G.amazon_cover(f).alias("cover"), F.array_join(G.amazon_genres(f), " | ").alias("genres"), G.amazon_description(f).alias("description"), G.detail(F.col("d"), "publisher").alias("publisher"), G.product_pages(F.col("d"), t).cast("long").alias("pages"), G.format_of(t).alias("format"), G.mismatch(asked, F.col("isbn")).alias("error"))


@register("blocked_pages", "", "SELECT p_partkey AS page_id, p_partkey%4 IN (0,1,2) AS blocked FROM part")
def blocked_pages(s, d):
    k = F.col("p_partkey")
    html = F.when(k % 4 == 0, "<p>Enter the characters you see below</p>").when(k % 4 == 1, "Sorry, we just need to make sure you're not a robot.").when(k % 4 == 2, "TYPE THE CHARACTERS YOU SEE IN THIS IMAGE").otherwise("<p>You are not a robot, enter the characters</p>")
    return X.read(s, d, "part").select(k.alias("page_id"), G.blocked(html).alias("blocked"))


@register("library_records", GOOD, """SELECT k::VARCHAR AS isbn13, n AS title, CASE WHEN k%3=0 THEN t ELSE b END AS authors, 'United Kingdom' AS country, CASE WHEN k%2=0 THEN '/books/OL'||k||'M' ELSE '/books/OL1M/x' END AS edition_key,
  CASE WHEN k%4=0 AND k>0 THEN 'https://covers.openlibrary.org/b/id/'||k||'-L.jpg' WHEN k%4=1 THEN 'm.jpg' ELSE 's.jpg' END AS cover_url, 'Magic | '||n||' | Zoo' AS tags, CASE WHEN k%2=0 THEN 'd '||n ELSE 'own' END AS blurb,
  CASE WHEN k%5=0 THEN 'French, English' ELSE 'English' END AS language, 100+k%50 AS number_of_pages, '/works/W'||k AS work_key FROM gp""")
def library_records(s, d):
    k, n, t, b = F.col("p_partkey"), F.col("p_name"), F.col("p_type"), F.col("p_brand")
    key = k.cast("string")
    book = F.concat(
        F.lit('{"title":" '), n, F.lit('","url":"https://openlibrary.org/books/OL1M/x?y=1","publish_places":[{"name":"London"}],"subjects":[{"name":"Zoo"},{"name":"MAGIC"}]'),
        F.when(k % 3 != 0, F.concat(F.lit(',"authors":[{"name":"'), b, F.lit('"}]'))).otherwise(""), F.when(k % 2 == 0, F.concat(F.lit(',"identifiers":{"openlibrary":["OL'), key, F.lit('M"]}'))).otherwise(""),
        F.lit(',"cover":{'), F.when(k % 4 == 1, '"medium":"m.jpg",').otherwise(""), F.lit('"small":"s.jpg"}}'),
    )
    cover = F.when(k % 4 == 0, key).otherwise("-1")
    edition = F.concat(F.lit('{"covers":['), cover, F.lit('],"description":"own","works":[{"key":"/works/W'), key, F.lit('"}],"number_of_pages":'), (k % 50 + 100).cast("string"), F.lit(',"subjects":["'), n, F.lit('","magic"],"languages":['), F.when(k % 5 == 0, '{"key":"/languages/fre"},').otherwise(""), F.lit('{"key":"/languages/eng"}]}'))
    work = F.concat(F.lit('{"subjects":["Magic"]'), F.when(k % 2 == 0, F.concat(F.lit(',"description":{"value":" d '), n, F.lit(' "}'))).otherwise(""), F.lit("}"))
    records = X.read(s, d, "part").select(key.alias("isbn13"), book.alias("book"), edition.alias("edition"), work.alias("work"), F.array(t).alias("author_names"))
    return O.merged(records).select("isbn13", "title", F.array_join("authors", " | ").alias("authors"), "country", "edition_key", "cover_url", F.array_join("tags", " | ").alias("tags"), "blurb", "language", F.col("number_of_pages").cast("long").alias("number_of_pages"), "work_key")


# consensus and debates
@register("resolved_singletons", HIER, """SELECT rev.isbn13, rev.field, rev.path, m, reason, paths AS canonical_paths FROM rev JOIN (SELECT isbn13, field, string_agg(path, ' | ' ORDER BY path) AS paths FROM can GROUP BY ALL) USING (isbn13, field)
  WHERE reason IN ('singleton_hierarchy_supported_canonical','singleton_redundant_ancestor')""")
def resolved_singletons(s, d):
    return C.resolved_table(Q._l(s, d))


@register("debate_arrays", DEB, """SELECT dis.debate_id, coalesce(a.t,'') AS round1, coalesce(b.t,'') AS round2, coalesce(c.t,'') AS last FROM dis LEFT JOIN (SELECT debate_id, string_agg(m||decision, ',' ORDER BY m) AS t FROM r1 GROUP BY 1) a USING (debate_id)
  LEFT JOIN (SELECT debate_id, string_agg(m||decision, ',' ORDER BY m) AS t FROM r2 GROUP BY 1) b USING (debate_id) LEFT JOIN (SELECT debate_id, string_agg(m||decision, ',' ORDER BY m) AS t FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY 1) c USING (debate_id)""")
def debate_arrays(s, d):
    text = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat(x["m"].cast("string"), x["decision"])), ","), F.lit(""))
    last = F.array_join(F.transform(F.array_sort(F.map_entries("final_by_model")), lambda e: F.concat(e["key"].cast("string"), e["value"])), ",")
    return D.detail_arrays(*Q._debate(s, d)).select("debate_id", text(F.col("round1")).alias("round1"), text(F.col("round2")).alias("round2"), last.alias("last"))


@register("final_full_rows", DEB, """SELECT bc.*, coalesce(max(array_to_string(paths,' | ')) FILTER (annotation_type='Genre'),'') AS final_genre_paths, coalesce(max(array_to_string(paths,' | ')) FILTER (annotation_type='Metadata'),'') AS final_metadata_paths,
  coalesce(max(m0),'') AS m0_paths, coalesce(max(m1),'') AS m1_paths, coalesce(max(m2),'') AS m2_paths FROM bc LEFT JOIN ap ON ap.isbn13=bc.isbn13 LEFT JOIN (SELECT isbn13, string_agg(path,' | ' ORDER BY path) FILTER (m=0) AS m0,
  string_agg(path,' | ' ORDER BY path) FILTER (m=1) AS m1, string_agg(path,' | ' ORDER BY path) FILTER (m=2) AS m2 FROM (SELECT DISTINCT isbn13, m, path FROM l) GROUP BY 1) x ON x.isbn13=bc.isbn13 GROUP BY ALL""")
def final_full_rows(s, d):
    labels, judged = Q._l(s, d), D.verdicts(*Q._debate(s, d))
    return D.full_rows(Q._p(s, d), labels, judged)


@register("sorted_disputes", DEB, "SELECT n, isbn13, annotation_type, path FROM (SELECT row_number() OVER (ORDER BY isbn13, annotation_type, path) AS n, isbn13, annotation_type, path FROM dis) WHERE n<=50")
def sorted_disputes(s, d):
    """The first 50 disputes in the composite order, numbered."""
    top = Q._open(s, d).select("isbn13", "annotation_type", "path").orderBy("isbn13", "annotation_type", "path").limit(50)
    return top.withColumn("n", F.row_number().over(Window.orderBy("isbn13", "annotation_type", "path")).cast("long"))  # over 50 rows


@register("model_order", BASE, "SELECT isbn13, string_agg(m::VARCHAR, ',' ORDER BY CASE m WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END) AS models FROM (SELECT DISTINCT isbn13, m FROM l) GROUP BY 1")
def model_order(s, d):
    """Models of a book in a fixed order that is not theirs by name."""
    place = F.array_position(F.array(F.lit(2), F.lit(0), F.lit(1)), F.col("m"))
    held = Q._l(s, d).groupBy("isbn13").agg(F.array_sort(F.collect_set(F.struct(place.alias("k"), "m"))).alias("all"))
    return held.select("isbn13", F.array_join(F.transform("all", lambda x: x["m"].cast("string")), ",").alias("models"))


@register("pending_decisions", SILVER, "SELECT field, count(*) AS cases, count(*) FILTER (trim(d)='') AS pending FROM (SELECT field, CASE (isbn13+length(path))%4 WHEN 0 THEN ' ' WHEN 1 THEN '' ELSE 'ACCEPT' END AS d FROM hd) GROUP BY 1")
def pending_decisions(s, d):
    k = (F.col("isbn13") + F.length("path")) % 4
    sheet = C.singleton_review(Q._l(s, d)).filter(F.col("reason").isin(*C.REVIEWED)).withColumn("decision", F.when(k == 0, " ").when(k == 1, "").otherwise("ACCEPT"))
    return sheet.groupBy("field").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.trim("decision") == "").alias("pending"))


@register("review_batches", HIER, """SELECT field, (k+9)//10 AS batch, count(*) AS cases FROM (SELECT field, row_number() OVER (PARTITION BY field ORDER BY isbn13, path, m) AS k FROM rev WHERE reason IN ('isolated_singleton','singleton_extra_specificity')) GROUP BY 1,2""")
def review_batches(s, d):
    """Batches of ten cases, as a reviewer pauses after each tenth."""
    number = F.regexp_extract("case_id", r"(\d+)$", 1).cast("long")
    return C.adjudication_sheet(Q._l(s, d)).groupBy("field", F.expr("1").alias("_"), F.ceil(number / 10).alias("batch")).agg(F.count(F.lit(1)).alias("cases")).drop("_")


# figures: every bucket is there
@register("availability_bars", BASE, "SELECT g.available, count(av.available) AS books FROM (SELECT unnest([0,1,2,3]) AS available) g LEFT JOIN av ON av.available=g.available GROUP BY 1")
def availability_bars(s, d):
    every = s.range(4).select(F.col("id").alias("available"))
    counts = A.availability(Q._p(s, d)).groupBy("available").agg(F.count(F.lit(1)).alias("books"))
    return every.join(F.broadcast(counts), "available", "left").select(F.col("available").cast("int").alias("available"), F.coalesce("books", F.lit(0)).alias("books"))


@register("exact_rate_bars", THREE, """SELECT round(100.0*count(*) FILTER (g)/count(*),2) AS genre, round(100.0*count(*) FILTER (m)/count(*),2) AS metadata, round(100.0*count(*) FILTER (g AND m)/count(*),2) AS both_fields
  FROM (SELECT isbn13, bool_or(exact) FILTER (field='genre') AS g, bool_or(exact) FILTER (field='metadata') AS m FROM tw GROUP BY 1)""")
def exact_rate_bars(s, d):
    g, m = F.col("exact_genre"), F.col("exact_metadata")
    rate = lambda x: F.round(F.count_if(x) * 100.0 / F.count(F.lit(1)), 2)
    return A.by_field(A.three_way(Q._p(s, d), Q._l(s, d))).agg(rate(g).alias("genre"), rate(m).alias("metadata"), rate(g & m).alias("both_fields"))


OUTCOMES = ("perfect_3_of_3_consensus", "agreement_2_of_3", "agreement_2_of_2", "debate_resolver", "insufficient_original_annotations", "debate_not_run", "debate_api_error", "resolver_returned_empty", "no_filtered_tags")


@register("outcome_bars", ROUTE, f"SELECT g.method, count(x.method) AS n FROM (SELECT unnest({list(OUTCOMES)}) AS method) g LEFT JOIN {Q.FIN} x ON x.method=g.method GROUP BY 1")
def outcome_bars(s, d):
    every = s.range(1).select(F.explode(F.array(*map(F.lit, OUTCOMES))).alias("method"))
    return every.join(F.broadcast(Q.method_counts(s, d).drop("destination")), "method", "left").select("method", F.coalesce("n", F.lit(0)).alias("n"))


@register("status_progress", BASE, "SELECT m, count(*) FILTER (status='success') AS success, count(*) FILTER (status='error') AS error, count(*)-count(*) FILTER (status='success') AS remaining FROM p GROUP BY 1")
def status_progress(s, d):
    ok = F.col("status") == "success"
    return Q._p(s, d).groupBy("m").agg(F.count_if(ok).alias("success"), F.count_if(F.col("status") == "error").alias("error"), F.count_if(~ok).alias("remaining"))


@register("debate_status", BASE, "SELECT CASE WHEN available>=2 THEN 'debate' ELSE 'incomplete' END AS target, available, count(*) AS books FROM av GROUP BY 1,2")
def debate_status(s, d):
    return Q.debate_routing(s, d).groupBy("target", "available").agg(F.count(F.lit(1)).alias("books"))


@register("filter_counts", SRC, f"""SELECT isbn13, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS removed, count(*) AS tags FROM (SELECT n.isbn13, action IS NULL OR action='keep' AS kept FROM {Q.NOISY} n LEFT JOIN {Q.REPLIES} r ON r.isbn13=n.isbn13 AND r.tag=n.tag) GROUP BY 1""")
def filter_counts(s, d):
    return Q.filter_validation(s, d).groupBy("isbn13").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("removed"), F.count(F.lit(1)).alias("tags"))


@register("silver_counters", SILVER, """SELECT count(*) FILTER (field='genre') AS genre_labels, count(*) FILTER (field='metadata') AS metadata_labels, count(DISTINCT isbn13) FILTER (field='genre') AS genre_books, count(DISTINCT isbn13) FILTER (field='metadata') AS metadata_books,
  count(DISTINCT isbn13) AS books, (SELECT count(*) FROM hd WHERE decision='ACCEPT') AS accepted, (SELECT count(*) FROM hd WHERE decision='REJECT') AS rejected, (SELECT count(*) FROM hd WHERE decision='UNSURE') AS unresolved FROM sil""")
def silver_counters(s, d):
    _, decided, final = Q._silver(s, d)
    is_ = lambda f: F.col("field") == f
    books = final.groupBy("isbn13").agg(*[F.count_if(is_(f)).alias(f) for f in X.FIELDS])
    labels = books.agg(*[F.coalesce(F.sum(f), F.lit(0)).alias(f"{f}_labels") for f in X.FIELDS], *[F.count_if(F.col(f) > 0).alias(f"{f}_books") for f in X.FIELDS], F.count(F.lit(1)).alias("books"))
    said = decided.agg(*[F.count_if(F.col("decision") == v).alias(n) for v, n in (("ACCEPT", "accepted"), ("REJECT", "rejected"), ("UNSURE", "unresolved"))])
    return labels.crossJoin(F.broadcast(said))  # one row beside one row


@register("annotations_wide", PAIRS, """SELECT p.isbn13, max(status) FILTER (p.m=0) AS m0_status, max(array_to_string(genre,' | ')) FILTER (p.m=0) AS m0_genre, max(array_to_string(metadata,' | ')) FILTER (p.m=0) AS m0_metadata, max(CASE WHEN status='error' THEN 'failed' END) FILTER (p.m=0) AS m0_error,
  max(status) FILTER (p.m=2) AS m2_status, max(array_to_string(genre,' | ')) FILTER (p.m=2) AS m2_genre, max(array_to_string(metadata,' | ')) FILTER (p.m=2) AS m2_metadata, max(CASE WHEN status='error' THEN 'failed' END) FILTER (p.m=2) AS m2_error
  FROM p LEFT JOIN sets ON sets.isbn13=p.isbn13 AND sets.m=p.m GROUP BY 1""")
def annotations_wide(s, d):
    """Status, paths and error of two models side by side."""
    rows = Q._p(s, d).join(A.label_sets(Q._p(s, d), Q._l(s, d)), ["isbn13", "m"], "left")
    text = lambda f: F.first(F.array_join(f, " | "))
    wide = rows.groupBy("isbn13").pivot("m", [0, 2]).agg(F.first("status").alias("status"), text("genre").alias("genre"), text("metadata").alias("metadata"), F.first(F.when(F.col("status") == "error", "failed")).alias("error"))
    return wide.select("isbn13", *[F.col(f"{m}_{c}").alias(f"m{m}_{c}") for m in (0, 2) for c in ("status", "genre", "metadata", "error")])


# expectations
@register("key_set_difference", BASE, "SELECT isbn13, CASE WHEN available=0 THEN 'left only' ELSE 'right only' END AS side FROM av WHERE available=0 AND isbn13%2=0 OR available>0 AND isbn13%2=1 AND isbn13%5=0")
def key_set_difference(s, d):
    av = A.availability(Q._p(s, d))
    return E.keys_equal(av.filter("isbn13 % 2 = 0 or isbn13 % 5 <> 0 and available > 0"), av.filter("available > 0"), ["isbn13"])


@register("domain_violations", SILVER, "SELECT 'decision' AS \"column\", decision AS value, count(*) AS n FROM hd WHERE decision NOT IN ('ACCEPT','REJECT') GROUP BY 2 UNION ALL SELECT 'field', field, count(*) FROM hd WHERE field<>'genre' GROUP BY 2")
def domain_violations(s, d):
    return E.outside_domain(Q._silver(s, d)[1], {"decision": ("ACCEPT", "REJECT"), "field": ("genre",)})


@register("count_expectations", DEB, "SELECT verdict AS name, count(*) AS n, 7::BIGINT AS expected FROM ver GROUP BY 1 HAVING count(*)<>7 UNION ALL SELECT 'NONE', NULL, 1")
def count_expectations(s, d):
    """Counts that differ from those a caller states (here 7 of each verdict and one of a verdict that isn't there)."""
    counts = D.verdicts(*Q._debate(s, d)).groupBy(F.col("verdict").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return E.counts_differ(counts, {"ACCEPT": 7, "REJECT": 7, "MANUAL": 7, "NONE": 1})


@register("partition_check", BASE, "SELECT isbn13, CASE WHEN available=2 THEN 'debate,incomplete' ELSE '' END AS parts FROM av WHERE available=2 OR available<2 AND isbn13%3=0")
def partition_check(s, d):
    """Books that are not in exactly one of two parts (one part leaves books out, and both have those with two answers)."""
    av = A.availability(Q._p(s, d))
    return E.partition_incomplete(av, {"debate": av.filter("available >= 2"), "incomplete": av.filter("available <= 2 and not (available < 2 and isbn13 % 3 = 0)")}, "isbn13")


@register("rounds_incomplete", DEB, "SELECT dis.debate_id, support_count, count(r.m) AS answers FROM dis LEFT JOIN (SELECT * FROM r1 WHERE m<>1) r ON r.debate_id=dis.debate_id GROUP BY 1,2 HAVING count(r.m)<>support_count")
def rounds_incomplete(s, d):
    """Disputes without an answer of each supporter (model 1 has not answered)."""
    open_, first, _ = Q._debate(s, d)
    return E.rounds_incomplete(open_, first.filter("m <> 1"))


@register("conflicts_without_annotation", BASE, "SELECT isbn13 FROM av WHERE available=2 AND isbn13 NOT IN (SELECT isbn13 FROM p WHERE m=0 AND status='success')")
def conflicts_without_annotation(s, d):
    """Conflicts whose annotation table lacks their book, which a run would refuse."""
    conflicts = A.availability(Q._p(s, d)).filter("available = 2")
    return E.inner_or_missing(conflicts, Q._p(s, d).filter("m = 0 and status = 'success'").select("isbn13"), ["isbn13"])[1]


@register("once_each", ROUTE, f"SELECT count(*) AS books, count(DISTINCT isbn13) AS unique_books, count(*) FILTER (destination='final') AS final FROM {Q.FIN}")
def once_each(s, d):
    return Q.final_routing(s, d).agg(F.count(F.lit(1)).alias("books"), F.count_distinct("isbn13").alias("unique_books"), F.count_if(F.col("destination") == "final").alias("final"))


@register("audit_counts", PAIRS, """, fin AS (SELECT isbn13 FROM sets WHERE m=0 UNION ALL SELECT isbn13 FROM sets WHERE m=0 AND isbn13%97=0), man AS (SELECT DISTINCT isbn13 FROM p WHERE isbn13%11=0), al AS (SELECT * FROM fin UNION ALL SELECT * FROM man)
  SELECT (SELECT count(*) FROM fin) AS resolved, (SELECT count(*) FROM man) AS manual, count(*) AS total, count(DISTINCT isbn13) AS unique_isbns, count(*)-count(DISTINCT isbn13) AS duplicates FROM al""")
def audit_counts(s, d):
    final, manual = Q._records(s, d)
    ids = final.select("isbn13", F.lit(1).alias("f")).unionAll(manual.select("isbn13", F.lit(0).alias("f")))
    return ids.agg(F.count_if(F.col("f") == 1).alias("resolved"), F.count_if(F.col("f") == 0).alias("manual"), F.count(F.lit(1)).alias("total"), F.count_distinct("isbn13").alias("unique_isbns"), (F.count(F.lit(1)) - F.count_distinct("isbn13")).alias("duplicates"))


# taxonomy edits and responses
@register("taxonomy_edits", TAX, """SELECT kind, path FROM tax WHERE NOT (kind='genre' AND (path='Fiction' OR path LIKE 'Fiction / %')) UNION SELECT 'metadata', unnest(['Period','Period / Old','Period / Old / Very','Period / New'])""")
def taxonomy_edits(s, d):
    from labelforge.sources.tables import edited

    return edited(X.taxonomy(s, d), [("genre", "Fiction")], [("metadata", "", {"Period": {"Old": ["Very"], "New": []}})])


@register("answers_validated", PAIRS + ",\n" + TAX[len(BASE) + 2 :], """SELECT isbn13, m, CASE WHEN EXISTS (SELECT 1 FROM (SELECT unnest(genre) AS x) WHERE x NOT IN (SELECT path FROM tax WHERE kind='genre')) THEN 'invalid_genre'
  WHEN EXISTS (SELECT 1 FROM (SELECT unnest(metadata) AS x) WHERE x NOT IN (SELECT path FROM tax WHERE kind='metadata')) THEN 'invalid_metadata'
  WHEN EXISTS (SELECT 1 FROM (SELECT unnest(genre) AS x) WHERE length(x)%5=0) THEN 'genre_outside_candidates' ELSE 'success' END AS result FROM sets""")
def answers_validated(s, d):
    """Parsed answers against the taxonomy and candidates (genres whose length is no multiple of five, all metadata)."""
    from labelforge.plans.runner import validated

    sets = A.label_sets(Q._p(s, d), Q._l(s, d))
    answers = sets.select("isbn13", F.col("m").cast("string").alias("model"), F.lit("x").alias("provider"), F.lit("success").alias("status"), F.col("genre").alias("genre_paths"), F.col("metadata").alias("metadata_paths"), F.lit(None).cast("string").alias("error"))
    candidates = Q._l(s, d).select("isbn13", F.col("field").alias("kind"), "path").distinct().filter("kind = 'metadata' or length(path) % 5 <> 0")
    found = validated(answers, X.taxonomy(s, d), candidates)
    return found.select("isbn13", F.col("model").cast("int").alias("m"), F.when(F.col("status") == "success", "success").otherwise(F.split_part("error", F.lit(":"), F.lit(1))).alias("result"))


@register("parsed_paths", BASE, """, tx AS (SELECT isbn13, m, coalesce(list_sort(list(path) FILTER (field='genre')),[]) AS g, coalesce(list_sort(list(path) FILTER (field='metadata')),[]) AS d FROM l GROUP BY 1,2)
  SELECT isbn13, m, CASE WHEN isbn13%10 IN (1,4,8,9) THEN array_to_string(g,' | ') WHEN isbn13%10=5 THEN '' END AS genre_paths, CASE WHEN isbn13%10 IN (1,4,8,9) THEN array_to_string(d,' | ') WHEN isbn13%10=5 THEN '' END AS metadata_paths FROM tx""")
def parsed_paths(s, d):
    """What strict parsing of each response gives."""
    rows = X.responses(s, d).withColumn("r", R.strict_annotation(F.col("raw")))
    return rows.select("isbn13", "m", *[F.array_join(f"r.{c}", " | ").alias(c) for c in ("genre_paths", "metadata_paths")])


@register("one_to_one_pairs", PAIRS, """SELECT isbn13, field, m_a, m_b, round(2*greatest(s11+s22, s12+s21)/4, 6) AS similarity FROM (SELECT fp.isbn13, fp.field, fp.m_a, fp.m_b, max(similarity) FILTER (path_a=a[1] AND path_b=b[1]) AS s11,
  max(similarity) FILTER (path_a=a[2] AND path_b=b[2]) AS s22, max(similarity) FILTER (path_a=a[1] AND path_b=b[2]) AS s12, max(similarity) FILTER (path_a=a[2] AND path_b=b[1]) AS s21
  FROM fp JOIN sim USING (isbn13, field, m_a, m_b) WHERE len(a)=2 AND len(b)=2 GROUP BY fp.isbn13, fp.field, fp.m_a, fp.m_b)""")
def one_to_one_pairs(s, d):
    """One-to-one similarity of two paths with two paths, where SQL can name both matchings."""
    return A.one_to_one(Q._pairs(s, d), "size(a) = 2 and size(b) = 2")
