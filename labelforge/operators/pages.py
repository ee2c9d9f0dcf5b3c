"""Fields of pre-fetched book pages.

Regexes and JSON run as column expressions. Selectors need the tree of a page: one pandas UDF
(``picked``) parses a page once and returns what all selectors of a page kind find and, if asked, its text.
"""

from __future__ import annotations

import re
from functools import cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from labelforge.functions.text import clean, clean_html, dedup_folded, fold

# Phrases of blocked pages.
BLOCKED = ("enter the characters you see below", "sorry, we just need to make sure you're not a robot", "type the characters you see in this image")
# Formats of a product page; the first that the page names wins.
FORMATS = ("Mass Market Paperback", "Library Binding", "Kindle Edition", "Hardcover", "Paperback", "Audiobook", "Audio CD", "Board Book")
# Formats that stand beside a number of pages.
EDITIONS = ("Hardcover", "Paperback", "Mass Market Paperback", "Kindle Edition", "ebook", "Audiobook", "Audio CD", "Library Binding", "Board Book")
# Where the fields of the two kinds of pages are: field, attribute (None: text), selectors.
GOODREADS = {
    "authors": (None, ["a.ContributorLink, a[href*=/author/show/]"]),
    "genres": (None, ["div.BookPageMetadataSection__genres a", "div.BookPageMetadataSection__genreButton a", "span.BookPageMetadataSection__genreButton a", "div[data-testid=genresList] a"]),
    "blurb": (None, ["div.BookPageMetadataSection__description span.Formatted", "div.BookPageMetadataSection__description", "div[data-testid=description]"]),
    "cover": ("src", ["img.ResponsiveImage", "img.BookCover__image"]),
    "reviews": (None, ["section.ReviewText span.Formatted", "div.ReviewText span.Formatted", "article.ReviewCard span.Formatted"]),
}
AMAZON = {
    "authors": (None, ["#bylineInfo a.contributorNameID", "#bylineInfo a.a-link-normal", ".author a.a-link-normal"]),
    "title": (None, ["#productTitle", "#ebooksProductTitle", "h1 span"]),
    "description": (None, ["#bookDescription_feature_div", "#bookDescription_feature_div noscript", "#productDescription", "#productDescription_feature_div", "#aplus"]),
    "genres": (None, ["#wayfinding-breadcrumbs_feature_div a", "#wayfinding-breadcrumbs_container a"]),
    "reviews": (None, ["[data-hook=review-body] span", "[data-hook=review-body]"]),
    "cover_large": ("data-old-hires", ["#imgBlkFront", "#landingImage", "#ebooksImgBlkFront"]),
    "cover_dynamic": ("data-a-dynamic-image", ["#imgBlkFront", "#landingImage", "#ebooksImgBlkFront"]),
    "cover": ("src", ["#imgBlkFront", "#landingImage", "#ebooksImgBlkFront"]),
}
ROWS = ["#detailBullets_feature_div li", "#productDetailsTable tr", "#productDetails_detailBullets_sections1 tr", "#productDetails_techSpec_section_1 tr"]
# Texts of links that are no author or no genre.
NO_AUTHOR = ("visit amazon's store", "follow")
NO_GENRE = ("books", "kindle store")
AMAZON |= {"rows": (None, ROWS), "heads": ("<th>", ROWS), "cells": ("<td>", ROWS)}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


# the tree and its selectors


class _Tree(HTMLParser):
    """Elements in document order: (tag, attributes, parent, texts), where texts hold those of all inner elements; ``texts`` are those of the page."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple[str, dict, int, list[str]]] = []
        self.open: list[int] = []
        self.texts: list[str] = []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.nodes.append((tag, {k: v or "" for k, v in attrs}, self.open[-1] if self.open else -1, []))
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[i]][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        text = data.strip()
        if text:
            self.texts.append(text)
            for i in self.open:
                self.nodes[i][3].append(text)


@cache
def _compiled(selector: str) -> list[list[tuple]]:
    """Alternatives, each a chain of (tag, id, classes, attributes as (name, operator, value))."""
    found = []
    for chain in selector.split(","):
        steps = []
        for part in chain.split():
            attrs = re.findall(r"\[([\w-]+)(\*?=)([^\]]*)\]", part)
            bare = re.sub(r"\[[^\]]*\]", "", part)
            steps.append((re.match(r"[\w-]*", bare)[0], (re.findall(r"#([\w-]+)", bare) or [None])[0], re.findall(r"\.([\w-]+)", bare), attrs))
        found.append(steps)
    return found


def _fits(node: tuple, step: tuple) -> bool:
    tag, identifier, classes, attrs = step
    own = node[1]
    return (
        tag in ("", node[0])
        and identifier in (None, own.get("id"))
        and (not classes or set(classes) <= set(own.get("class", "").split()))
        and all(value in own.get(name, "") if op == "*=" else own.get(name) == value for name, op, value in attrs)
    )


def _matches(nodes: list[tuple], at: int, chain: list[tuple]) -> bool:
    if not _fits(nodes[at], chain[-1]):
        return False
    rest, up = len(chain) - 2, nodes[at][2]
    while rest >= 0 and up >= 0:
        rest -= _fits(nodes[up], chain[rest])
        up = nodes[up][2]
    return rest < 0


def _inside(nodes: list[tuple], at: int, tag: str) -> str | None:
    """Text of the first element of a tag inside an element, whose inner elements follow it directly."""
    held = {at}
    for i in range(at + 1, len(nodes)):
        if nodes[i][2] not in held:
            return None
        if nodes[i][0] == tag:
            return " ".join(nodes[i][3])
        held.add(i)
    return None


class Index(list):
    """Nodes of a page with the places of each id, class and tag, so that a selector looks at what its last step may be and nothing else."""

    def __init__(self, nodes: list[tuple]):
        super().__init__(nodes)
        self.found: dict[str, list[int]] = {}
        self.places: dict[tuple[str, str], list[int]] = {}
        for i, (tag, attrs, _, _) in enumerate(nodes):
            keys = [("tag", tag)]
            if "id" in attrs:
                keys.append(("id", attrs["id"]))
            if "class" in attrs:
                keys += {("class", c) for c in attrs["class"].split()}
            for key in keys:
                self.places.setdefault(key, []).append(i)

    def may_be(self, step: tuple) -> list[int] | range:
        """The fewest places that the id, the classes or the tag of a step leave."""
        tag, identifier, classes, _ = step
        if identifier is not None:
            return self.places.get(("id", identifier), [])
        keys = [("class", c) for c in classes] or ([("tag", tag)] if tag else [])
        return min((self.places.get(k, []) for k in keys), key=len) if keys else range(len(self))


def _hits(nodes: list[tuple], selector: str) -> list[int]:
    """Places of the elements that a selector finds; an index keeps them, as several fields may ask for other attributes of the same elements."""
    index = nodes if isinstance(nodes, Index) else Index(nodes)
    if selector not in index.found:
        index.found[selector] = sorted({i for chain in _compiled(selector) for i in index.may_be(chain[-1]) if _matches(nodes, i, chain)})
    return index.found[selector]


def select(nodes: list[tuple], selector: str, attribute: str | None = None) -> list[str | None]:
    """Texts (or an attribute; or, for "<tag>", the text of the first such element inside) of the elements that a selector finds, in document order."""
    hits = _hits(nodes, selector)
    if attribute is None:
        return [" ".join(nodes[i][3]) for i in hits]
    return [_inside(nodes, i, attribute[1:-1]) if attribute[0] == "<" else nodes[i][1].get(attribute) for i in hits]


def picked(html: Column, spec: dict, text: str | None = None) -> Column:
    """A struct with an array for each field of ``spec``: what each of its selectors finds, as an array of arrays; and, if ``text`` names a field for it, the page's text."""
    kinds = [f"`{name}` array<array<string>>" for name in spec] + [f"`{text}` string"] * (text is not None)

    @F.pandas_udf(", ".join(kinds))
    def run(pages: pd.Series) -> pd.DataFrame:
        found: dict[str, list] = {name: [] for name in spec} | ({} if text is None else {text: []})
        for p in pages:
            tree = _Tree(p or "")
            index = Index(tree.nodes)
            for name, (attribute, selectors) in spec.items():
                found[name].append([select(index, s, attribute) for s in selectors])
            if text is not None:
                found[text].append(" ".join(tree.texts))
        return pd.DataFrame(found)

    return run(html)


def select_text(html: Column, tag: str, cls: str | None = None) -> Column:
    """Texts of the elements of a tag (and class)."""
    return picked(html, {"found": (None, [f"{tag}.{cls}" if cls else tag])})["found"][0]


def _every(found: Column) -> Column:
    return F.flatten(found)


def _first(found: Column, least: int = 1) -> Column:
    """Of each selector's first element, the first text of ``least`` characters or more."""
    texts = F.transform(found, lambda x: clean(F.try_element_at(x, F.lit(1))))
    return F.try_element_at(F.filter(texts, lambda x: F.length(x) >= least), F.lit(1))


def page_text(html: Column) -> Column:
    """The text of a page, its pieces joined by spaces."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: " ".join(_Tree(page or "").texts))

    return run(html)


# any page


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)), F.lit(""))


#: An anchor: its href in quotes of either kind or none, behind any other attributes, and what it holds.
_ANCHOR = r"""(?is)<a(?:\s[^>]*?)?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)[^>]*>(.*?)</a\s*>"""


def _bare(value: Column) -> Column:
    """An attribute's value without its quotes."""
    return F.regexp_replace(value, "^[\"']|[\"']$", "")


def links(html: Column) -> Column:
    """(href, text) of each anchor."""
    href, text = (F.regexp_extract_all(html, F.lit(_ANCHOR), i) for i in (1, 2))
    return F.arrays_zip(F.transform(href, _bare).alias("href"), text.alias("text"))


def blocked(html: Column) -> Column:
    low = F.lower(html)
    found = F.lit(False)
    for phrase in BLOCKED:
        found = found | F.contains(low, F.lit(phrase))
    return found


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def reviews(texts: Column, least: int = 20, most: int = 5) -> Column:
    """The first ``most`` distinct reviews of ``least`` characters or more."""
    return F.slice(F.array_distinct(F.filter(F.transform(texts, clean), lambda t: F.length(t) >= least)), 1, most)


# pages with JSON-LD


#: A script of type JSON-LD: the type in quotes of either kind or none, among any other attributes.
_JSON_LD = r"""(?s)<(?i:script)(?:\s(?:[^>"']|"[^"]*"|'[^']*')*?)?\s(?i:type)\s*=\s*(?:"application/ld\+json"|'application/ld\+json'|application/ld\+json(?=[\s>]))(?:[^>"']|"[^"]*"|'[^']*')*>(.*?)</(?i:script)\s*>"""


def json_ld_book(html: Column) -> Column:
    """The first JSON-LD object of type Book, also in a list or inside an object's @graph; null if there is none.

    A script that is not one whole JSON value (cut, or with text after it) is passed over.
    """
    # the parser stops after a first value; inside an array and inside an object nothing may follow it
    whole = lambda s: F.try_parse_json(F.concat(F.lit("["), s, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), s, F.lit("}"))).isNotNull()
    scripts = F.filter(F.regexp_extract_all(html, F.lit(_JSON_LD), 1), whole)
    none = F.array().cast("array<string>")
    items = lambda s: F.when(F.startswith(F.ltrim(s), F.lit("[")), F.coalesce(F.from_json(s, "array<string>"), none)).otherwise(F.array(s))
    graph = lambda s: F.coalesce(F.from_json(F.get_json_object(s, "$.@graph"), "array<string>"), none)
    objects = F.flatten(F.transform(scripts, items))
    every = F.flatten(F.transform(objects, lambda s: F.concat(F.array(s), graph(s))))
    return F.try_element_at(F.filter(every, lambda s: F.get_json_object(s, "$.@type") == "Book"), F.lit(1))


def _named(value: Column) -> Column:
    """Names of an object or of a list's objects, cleaned, the first of each case key."""
    one = F.array(F.get_json_object(value, "$.name"))
    many = F.transform(F.from_json(value, "array<string>"), lambda x: F.when(F.startswith(F.ltrim(x), F.lit("{")), F.get_json_object(x, "$.name")))
    none = F.array().cast("array<string>")
    return dedup_folded(F.coalesce(F.when(F.startswith(value, F.lit("{")), one).when(F.startswith(value, F.lit("[")), many), none))


def goodreads_authors(book: Column, found: Column) -> Column:
    named = _named(F.get_json_object(book, "$.author"))
    return F.when(F.size(named) > 0, named).otherwise(dedup_folded(_every(found["authors"])))


def goodreads_genres(found: Column) -> Column:
    return dedup_folded(_every(found["genres"]))


def goodreads_blurb(book: Column, found: Column) -> Column:
    said = clean(F.get_json_object(book, "$.description"))
    return F.when(said.isNotNull(), clean(page_text(said))).otherwise(_first(found["blurb"]))


def goodreads_cover(book: Column, found: Column) -> Column:
    image = F.get_json_object(book, "$.image")
    inside = F.coalesce(F.nullif(F.get_json_object(book, "$.image.url"), F.lit("")), F.get_json_object(book, "$.image.contentUrl"))
    is_object, is_list = F.startswith(image, F.lit("{")), F.startswith(image, F.lit("["))
    return F.when(image.isNull() | is_list, _first(found["cover"])).when(is_object, clean(inside)).otherwise(clean(image))


def first_published(text: Column) -> Column:
    """A date such as "May 3, 1999", or a year."""
    return _group(text, r"(?i)first published\s+([A-Za-z]+\s+\d{1,2},\s+\d{4}|\d{4})")


def page_count(text: Column) -> Column:
    return _group(text, r"(?i)(\d{1,5})\s+pages\b").cast("int")


def edition_format(text: Column) -> Column:
    """The format named right after a number of pages, as the page spells it."""
    return _group(text, r"(?i)\d{1,5}\s+pages\s*,\s*(" + "|".join(EDITIONS) + ")")


# product pages


def _first_link(html: Column, part: str, host: str) -> Column:
    """The first link whose address holds ``part``, absolute and without its query."""
    href = F.try_element_at(F.filter(F.transform(links(html), lambda x: x["href"]), lambda h: F.contains(h, F.lit(part))), F.lit(1))
    bare = F.split_part(href, F.lit("?"), F.lit(1))
    return F.when(F.startswith(bare, F.lit("/")), F.concat(F.lit(host), bare)).otherwise(bare)


def product_url(html: Column, host: str) -> Column:
    """The first link to a product on a page of search results."""
    return _first_link(html, "/dp/", host)


def book_url(html: Column, host: str) -> Column:
    """The first link to a book on a page of search results."""
    return _first_link(html, "/book/show/", host)


def _without(texts: Column, words: tuple[str, ...]) -> Column:
    return dedup_folded(F.filter(F.transform(texts, clean), lambda t: ~fold(t).isin(*words)))


def amazon_authors(found: Column) -> Column:
    return _without(_every(found["authors"]), NO_AUTHOR)


def amazon_genres(found: Column) -> Column:
    return _without(_every(found["genres"]), NO_GENRE)


def amazon_title(found: Column) -> Column:
    return _first(found["title"])


def amazon_description(found: Column) -> Column:
    return _first(found["description"], 30)


def amazon_cover(found: Column) -> Column:
    """Of the images in order: the large one, else the first of its sizes, else its source."""
    image = lambda i: (F.try_element_at(found[c][i], F.lit(1)) for c in ("cover_large", "cover_dynamic", "cover"))
    choices = []
    for i in range(len(AMAZON["cover"][1])):
        large, sizes, source = image(i)
        choices += [clean(large), F.try_element_at(F.json_object_keys(sizes), F.lit(1)), clean(source)]
    return F.coalesce(*choices)


def detail_pairs(found: Column) -> Column:
    """(key, value) of each row of details, in their order: around its first colon, else its own heading and cell; a row with neither gives none."""
    rows = F.transform(F.arrays_zip(*[_every(found[c]).alias(c) for c in ("rows", "heads", "cells")]), lambda r: F.struct(clean(r["rows"]).alias("text"), r["heads"].alias("head"), r["cells"].alias("cell")))
    told = F.filter(rows, lambda r: r["text"].isNotNull() & (F.contains(r["text"], F.lit(":")) | (r["head"].isNotNull() & r["cell"].isNotNull())))
    split = lambda t: F.struct(F.split_part(t, F.lit(":"), F.lit(1)).alias("key"), F.regexp_extract(t, "(?s)^[^:]*:(.*)$", 1).alias("value"))
    return F.transform(told, lambda r: F.when(F.contains(r["text"], F.lit(":")), split(r["text"])).otherwise(F.struct(r["head"].alias("key"), r["cell"].alias("value"))))


def details(pairs: Column) -> Column:
    """Map of folded keys to values from an array of (key, value); later pairs win, blank ones don't count."""
    keyed = F.filter(F.transform(pairs, lambda p: F.struct(fold(clean(p["key"])).alias("key"), clean(p["value"]).alias("value"))), lambda p: p["key"].isNotNull() & p["value"].isNotNull())
    last = F.aggregate(keyed, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, p: F.concat(F.filter(acc, lambda q: q["key"] != p["key"]), F.array(p)))
    return F.map_from_entries(last)


def detail(found: Column, *names: str) -> Column:
    return F.coalesce(*[found[n] for n in names])


def product_pages(found: Column, text: Column) -> Column:
    """Number of pages: of the details, else of the page's text; thousands may have commas."""
    number = lambda x, end: F.replace(_group(x, r"(?i)(\d[\d,]*)\s+" + end), F.lit(","), F.lit("")).cast("int")
    return F.coalesce(number(detail(found, "print length", "paperback", "hardcover"), "pages?"), number(text, r"pages\b"))


def format_of(text: Column) -> Column:
    """The first known format, by priority, as whole words."""
    return F.coalesce(*[F.when(F.rlike(text, F.lit(rf"(?i)\b{f}\b")), F.lit(f)) for f in FORMATS])


def isbn13(text: Column) -> Column:
    """A labelled ISBN-13, digits only."""
    found = F.regexp_extract(text, r"(?i)isbn-?13\s*:?\s*([0-9][0-9\- ]{11,20})", 1)
    return F.nullif(F.substring(F.regexp_replace(found, "[^0-9]", ""), 1, 13), F.lit(""))


def mismatch(wanted: Column, on_page: Column) -> Column:
    """An error where a page names another ISBN-13 than the one asked for; a page that names none is no mismatch."""
    return F.when(on_page != wanted, F.concat(F.lit("ISBN mismatch: requested "), wanted, F.lit(", page exposes "), on_page))


def unescaped_title(html: Column) -> Column:
    return clean_html(title(html))
