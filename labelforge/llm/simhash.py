"""SimHash near-dedup by pigeonhole blocks.

Fingerprint: words of a text (ASCII letters lower-cased, split at ASCII white
space), shingles of ``width`` words with repeats, XXH64 (seed 42) of each; a
bit is 1 if it is set in over half of the hashes. Fewer words than ``width``
make one shingle of all; no word makes fingerprint 0, linked like any other.

Links: the 64 bits are split into ``max_distance + 2`` blocks. Two fingerprints
at ``max_distance`` or fewer differing bits agree in at least two blocks, so
distinct fingerprints are joined on each pair of blocks and verified by Hamming
distance. A bucket with more than ``dense`` fingerprints is not expanded into
pairs: each of its members names the values at ``max_distance / 2`` or fewer
bits from itself and is linked to the smallest member that names the same
value. Members that share such a value are at most ``max_distance`` apart and
any two that close do share one, so no link is lost and no other is added
(hence ``max_distance`` is even).

``near_copies`` serves pipelines that remove documents of a stated Jaccard similarity of
shingle sets. At 0.8 two fingerprints of 64 sign bits differ in about ten bits, more than a selective
pigeonhole split can hold, so its fingerprint has other components: ``BLOCKS`` blocks
of ``PER_BLOCK`` smallest hashes, each equal in both sets with the probability of their similarity.
Again pairs that share a block are verified by the Hamming distance of the components, at most ``MOST_APART``
of them, and then exactly on whole sets. At a similarity of exactly 0.8 a pair shares no block
with probability 3e-6, at 0.85 with 2e-8; it exceeds the distance with less than 1e-8. Nothing depends on the number of documents, and no group is
capped. Only as many pairs are compared as components need: each document meets the head of each of its blocks'
groups, the member that shares blocks with most others. What is not in the component of its group's head after that (strays) is compared with all members that are in other components; the last bits of the components go along in that join, so only pairs whose distance can be small enough leave it. Groups with over ``dense``
strays carry whole sets into the join, which then emits links alone.

Defined results: a null text is empty; repeated rows share a fingerprint; a
null id is kept but never names a component unless nothing else can; an
empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from labelforge.llm.common import copies_of, cut, look_up, text_of
from labelforge.llm.graph import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42


def _word_blocks(text: bytes, most: int = 1 << 22) -> Iterator[list[bytes]]:
    """Words of ``text``; long texts come in several lists."""
    if len(text) <= most:
        yield text.split()
        return
    block: list[bytes] = []
    for m in WORD.finditer(text):
        block.append(m[0])
        if len(block) == 200_000:
            yield block
            block = []
    yield block


def fingerprint(text: str | None, width: int = 3) -> int:
    tail: list[bytes] = []
    ones, total = np.zeros(64, np.int64), 0
    for block in _word_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        words = tail + block
        if len(words) < width:
            tail = words
            continue
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
        n = len(words) - width + 1
        hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += n
        tail = words[len(words) - width + 1 :]
    if not total:
        return xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Distinct hashes of shingles; fewer words than ``width`` are one shingle, no word is none."""
    if len(words) < width:
        words, width = [b" ".join(words)] if words else [], 1
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.unique(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


#: The fingerprint of ``near_copies``: blocks, 16-bit components of each, and how many may differ in all.
BLOCKS, PER_BLOCK, MOST_APART = 24, 4, 44
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, (BLOCKS * PER_BLOCK, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A signed 64-bit number for each block: its components side by side. ``hashes`` is not empty."""
    least = np.full((BLOCKS * PER_BLOCK, 1), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[None, at : at + 4096] * _ODD).min(axis=1, keepdims=True))
    # bits below the top, which small minima have in common
    return ((least >> np.uint64(20)) & np.uint64(0xFFFF)).astype("<u2").reshape(BLOCKS, PER_BLOCK).view("<i8").ravel()


def brief(of: np.ndarray) -> np.ndarray:
    """The last four bits of each component of a sketch, 16 components to a number. Briefs differ in no more components than sketches do."""
    bits = (of.view("<u2") & 15).astype(np.uint8)
    return (bits[::2] | bits[1::2] << 4).view("<i8")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp)``: fp is the fingerprint as a signed 64-bit number."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    source = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp long")


def _masks(bits: int) -> list[int]:
    """Signed 64-bit masks with up to ``bits`` ones."""
    ones = chain.from_iterable(combinations(range(64), k) for k in range(bits + 1))
    return [v - (1 << 64) if v >> 63 else v for v in (sum(1 << i for i in c) for c in ones)]


def _block_keys(max_distance: int) -> list[str]:
    """SQL for the values of each pair of blocks: masked bits with the pair's number in place of bits outside the pair."""
    n = max_distance + 2
    edges = [64 * i // n for i in range(n + 1)]
    keys = []
    for i, j in combinations(range(n), 2):
        parts = [f"(shiftrightunsigned(fp, {lo}) & {(1 << (hi - lo)) - 1}L)" for lo, hi in ((edges[i], edges[i + 1]), (edges[j], edges[j + 1]))]
        width = edges[j + 1] - edges[j]
        pair = len(keys)
        keys.append(f"(shiftleft({pair}L, 48) | shiftleft({parts[0]}, {width}) | {parts[1]})")
    return keys


def links(fps: DataFrame, n_fps: int, max_distance: int = 2, dense: int = 16) -> DataFrame:
    """``(a, b)``: links among ``n_fps`` distinct fingerprints, column ``fp``, whose components are those of all pairs at ``max_distance`` or fewer bits."""
    if max_distance not in (0, 2, 4):
        raise ValueError("max_distance is 0, 2 or 4")
    if not max_distance:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter("a <> b")
    keyed = fps.select("fp", F.explode(F.array(*map(F.expr, _block_keys(max_distance)))).alias("key"))
    n_keys = len(_block_keys(max_distance)) * n_fps
    shared = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), n_keys // 2)
    members = cut(look_up(keyed, shared, ["key"], "n", n_keys), n_keys)
    few = members.filter(F.col("n") <= dense)
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").filter(f"a > b and bit_count(a ^ b) <= {max_distance}").select("a", "b")
    many = members.filter(F.col("n") > dense).select("fp").distinct()
    masks = F.array(*map(F.lit, _masks(max_distance // 2)))
    named = many.select("fp", F.explode(masks).alias("mask")).select("fp", F.expr("fp ^ mask").alias("value"))
    least = named.groupBy("value").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).filter("b <> top").drop("top")
    stars = named.join(least, "value").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.union(stars).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_distance: int = 2, dense: int = 16) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``fp`` and ``component``, the smallest id reachable over links."""
    marked = cut(fingerprints(docs, id_col, text_col, width))
    n_rows = marked.count()
    distinct = cut(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")), n_rows)
    n_fps = distinct.count()
    joined = components(links(distinct.select("fp"), n_fps, max_distance, dense), n_fps)
    # fingerprints without a link are components of their own
    labelled = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    labelled = cut(labelled, n_fps)
    smallest = cut(labelled.groupBy("component").agg(F.min("least").alias("smallest"), F.count(F.lit(1)).alias("members")), n_fps)
    named = cut(look_up(labelled, smallest, ["component"], "members", n_fps).select("fp", "smallest", "rows"), n_fps)
    return look_up(marked, named, ["fp"], "rows", n_rows).select(F.col("id").alias(id_col), "fp", F.col("smallest").alias("component"))


def _with_facts(pairs: DataFrame, facts: DataFrame, n_pairs: int) -> DataFrame:
    """The table ``pairs`` (a, b) with the columns of the table ``facts`` (id, ...) for both ids, named so with ``_a`` and ``_b``.

    An id in very many pairs has its pairs dealt over copies of its facts (see ``look_up``).
    """
    found = pairs
    for side in ("b", "a"):
        counts = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
        hot = F.broadcast(counts.select(side, copies_of(F.col("n"), n_pairs).alias("copies")).filter("copies > 1"))
        dealt = found.join(hot, side, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("a", "b"), F.col("copies")), F.lit(0)).cast("int")).drop("copies")
        named = facts.select(*[F.col(c).alias(side if c == "id" else f"{c}_{side}") for c in facts.columns])
        each = named.join(hot, side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
        found = dealt.join(each.hint("merge"), [side, "salt"]).drop("salt")
    return found


def _apart(a: str, b: str) -> str:
    """SQL for the number of components in which two sketches differ: each of their numbers holds four."""
    return f"aggregate(zip_with({a}, {b}, (x, y) -> x ^ y), 0, (n, x) -> n + if(x = 0, 0, int(x & 65535L <> 0) + int(x & 4294901760L <> 0) + int(x & 281470681743360L <> 0) + int(shiftrightunsigned(x, 48) <> 0)))"


def _sized(a: str, b: str, similarity: float) -> str:
    """SQL for whether sets of two sizes can have the similarity."""
    return f"least({a}, {b}) + 1e-6D >= {similarity!r}D * greatest({a}, {b})"


def _brief_apart(a: str, b: str) -> str:
    """SQL for the number of components in which two briefs differ."""
    each = [f"{a}[{i}] ^ {b}[{i}]" for i in range(BLOCKS * PER_BLOCK // 16)]
    return " + ".join(f"bit_count((({x}) | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & {0x1111111111111111}L)" for x in each)


def _only(source: DataFrame, ids: DataFrame, slots: int = 1 << 22) -> DataFrame:
    """The rows (id, text) of ``source`` whose id is in ``ids``, a column id without repeats.

    Most other rows are passed over by a broadcast table of ``slots`` bits (slots / 64 rows at most) before the join, so that their
    texts aren't moved; where it is full, each text is moved once.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(slots))
    words = ids.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(slot % 64)))").alias("bits"))
    marked = source.select("id", "text", slot.alias("slot"))
    open_ = marked.join(F.broadcast(words), F.expr("slot div 64 = word and (shiftrightunsigned(bits, int(slot % 64)) & 1L) = 1L"), "left_semi")
    return open_.select("id", "text").join(ids.hint("merge"), "id")


def _sets(source: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """``(id, set, n, ends)``: shingle sets of the rows of ``source`` whose id is in ``asked``, their sizes and the distinct last 16 bits of their hashes."""

    def shingle(batches):
        for b in batches:
            sets = [shingle_hashes(_words(t.as_py()), width).view(np.int64) for t in b.column(1)]
            ends = [np.unique(s.astype(np.int16)) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64())), pa.array(list(map(len, sets)), pa.int32()), pa.array(ends, pa.list_(pa.int16()))], ["id", "set", "n", "ends"])

    return cut(_only(source, asked).mapInArrow(shingle, f"id {source.schema['id'].dataType.simpleString()}, set array<long>, n int, ends array<short>"))


def _near_sketches(pairs: DataFrame, n: int, marked: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` of the table ``pairs``, ``n`` of them, whose sizes and sketches allow the similarity."""
    facts = marked.select("id", "n", "sketch")
    return _with_facts(pairs, facts, n).filter(f"{_sized('n_a', 'n_b', similarity)} and {_apart('sketch_a', 'sketch_b')} <= {MOST_APART}").select("a", "b")


def _alike(candidates: DataFrame, n: int, source: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` of the table ``candidates``, at most ``n`` of them, whose shingle sets have the similarity.

    The ends of the hashes, a quarter of the bytes, are compared first. Two sets share at most as many hashes as they share ends, and as many as one of them loses where its own
    hashes have ends in common; so only pairs that this bound leaves move whole sets.
    """
    asked = cut(candidates.select(F.col("a").alias("id")).union(candidates.select("b")).distinct(), n)
    sets = _sets(source, asked, width)
    least = f"{similarity / (1 + similarity)!r}D * (n_a + n_b) - 1e-6D"
    short = sets.select("id", "n", "ends")
    shared = "size(array_intersect(ends_a, ends_b)) + least(n_a - size(ends_a), n_b - size(ends_b))"
    left = cut(_with_facts(candidates, short, n).filter(f"{shared} >= {least}").select("a", "b"), n)
    whole = sets.select("id", "n", "set")
    common = "size(array_intersect(set_a, set_b))"
    return cut(_with_facts(left, whole, n).filter(f"{common} > 0 and {common} >= {least}").select("a", "b"), n)


def _mixed(members: DataFrame, found: DataFrame, n_members: int) -> DataFrame:
    """Members (key, id, members, head) of the groups that are not one component in ``found``, with ``component`` and ``lead``, the component of the head."""
    labelled = cut(members.join(found.withColumnRenamed("node", "id").hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id")), n_members)
    open_ = labelled.groupBy("key").agg(F.max(F.when(F.col("id") == F.col("head"), F.col("component"))).alias("lead"), F.min("component").alias("least"), F.max("component").alias("top"), F.count(F.lit(1)).alias("size"))
    keys = cut(open_.filter("least <> top").select("key", "lead", "size"), n_members // 2)
    return cut(look_up(labelled.withColumnRenamed("members", "size"), keys, ["key"], "size", n_members, own=True).withColumnRenamed("size", "members"), n_members)


def _strays(open_: DataFrame, marked: DataFrame, source: DataFrame, n_members: int, width: int, dense: int, similarity: float) -> tuple[DataFrame, DataFrame | None]:
    """Pairs ``(a, b)`` of members of a group that are in two components, one of them not that of the group's head.

    Sizes, briefs and sketches go along, so that pairs whose sketches aren't close are told in the join and never written. The first
    result holds pairs whose sets are yet to be compared, of groups with up to ``dense`` strays. In larger ones whole sets go along too and the join compares them: it
    leaves links only, the second result, and a set is moved once for each of its groups, not for each of its pairs.
    """
    open_ = cut(open_.drop("head").join(marked.select("id", "n", "brief").hint("merge"), "id"))
    counts = cut(open_.filter("component <> lead").groupBy("key").agg(F.count(F.lit(1)).alias("strays"), F.first("members").alias("members")), n_members // 2)
    near = f"cx <> cy and {_sized('nx', 'ny', similarity)} and {_brief_apart('sx', 'sy')} <= {MOST_APART}"
    close = f"{near} and {_apart('kx', 'ky')} <= {MOST_APART}"

    def pairs(size: str, condition: str, sets: bool) -> DataFrame:
        rows = look_up(open_, counts.filter(size).drop("strays"), ["key"], "members", n_members, own=True)
        rows = rows.withColumn("sketch", F.lit(None).cast("array<long>")) if sets else rows.join(marked.select("id", "sketch").hint("merge"), "id")
        if sets:
            rows = cut(rows)
            # ids recur at most once a block, so no key is hot here
            rows = rows.join(_sets(source, rows.select("id").distinct(), width).select("id", "set").hint("merge"), "id")
        else:
            rows = rows.withColumn("set", F.lit(None))
        one = rows.filter("component <> lead").select("key", F.col("id").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("brief").alias("sx"), F.col("sketch").alias("kx"), F.col("set").alias("wx"), "members")
        two = rows.select(F.col("id").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("brief").alias("sy"), F.col("sketch").alias("ky"), F.col("set").alias("wy"), "key", "members")
        return look_up(two, one, ["key"], "members", n_members, share=1000, own=True).filter(condition).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))

    few = pairs(f"strays <= {dense}", close, False)
    if counts.filter(f"strays > {dense}").isEmpty():
        return few, None
    alike = f"size(array_intersect(wx, wy)) * {1 + similarity!r}D + 1e-6D >= {similarity!r}D * (size(wx) + size(wy))"
    return few, cut(pairs(f"strays > {dense}", f"{near} and {alike}", True).distinct())


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, dense: int = 64) -> DataFrame:
    """``(id, component)`` of the ids with a near copy: shingle sets of ``width`` words have a Jaccard similarity of ``similarity`` or more.

    The blocks serve similarities of 0.8 or more; a smaller one is an error.
    """
    if not 0.8 <= similarity <= 1:
        raise ValueError("similarity is 0.8 or more and at most 1")
    source = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text")).filter("id is not null")
    kind = source.schema["id"].dataType.simpleString()

    def mark(batches):
        for b in batches:
            at, sizes, sketches, briefs, digests = [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                hashes = shingle_hashes(_words(text.as_py()), width)
                if len(hashes):  # a text without words is similar to none
                    at.append(i)
                    sizes.append(len(hashes))
                    sketches.append(sketch(hashes))
                    briefs.append(brief(sketches[-1]))
                    digests.append(hashlib.md5(hashes.tobytes(), usedforsecurity=False).digest())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(sizes, pa.int32()), pa.array(sketches, pa.list_(pa.int64())), pa.array(briefs, pa.list_(pa.int64())), pa.array(digests, pa.binary())], ["id", "n", "sketch", "brief", "digest"])

    def step(pairs: DataFrame, known: DataFrame, told: bool) -> DataFrame:
        """Components of ``known`` links and the links among ``pairs``, whose sketches are close if that is ``told``."""
        asked = cut(pairs.distinct(), n_members)
        n = asked.count()
        if n and not told:
            asked = cut(_near_sketches(asked, n, marked, similarity), n)
        return cut(components(known.union(_alike(asked, n, source, width, similarity)) if n else known, n_rows), n_rows)

    marked = cut(source.mapInArrow(mark, f"id {kind}, n int, sketch array<long>, brief array<long>, digest binary"))
    # equal sets are linked to their smallest id and go on as one
    n_rows = marked.count()
    alike = cut(marked.groupBy("digest").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("members")).filter("members > 1"), n_rows)
    equal = cut(look_up(marked.select("id", "digest"), alike, ["digest"], "members", n_rows).filter("id <> b").select(F.col("id").alias("a"), "b").distinct(), n_rows)
    keyed = marked.join(equal.select(F.col("a").alias("id")).hint("merge"), "id", "left_anti").select("id", F.posexplode("sketch").alias("block", "value")).select("id", F.xxhash64("block", "value").alias("key"))
    groups = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), BLOCKS * n_rows // 2)
    shared = cut(look_up(keyed, groups, ["key"], "members", BLOCKS * n_rows), BLOCKS * n_rows)
    n_members = shared.count()
    # the head of a group is the member that meets most others: what copies were made from, rather than one of them
    weighed = shared.join(shared.groupBy("id").agg(F.sum("members").alias("weight")).hint("merge"), "id")
    heads = cut(weighed.groupBy("key").agg(F.max(F.struct("weight", "id"))["id"].alias("head"), F.first("members").alias("members")), n_members // 2)
    members = cut(look_up(shared, heads, ["key"], "members", n_members, own=True), n_members)
    found = step(members.filter("id <> head").select(F.greatest("id", "head").alias("a"), F.least("id", "head").alias("b")), equal, told=False)
    open_ = _mixed(members, found, n_members)
    if not open_.isEmpty():
        few, linked = _strays(open_, marked, source, n_members, width, dense, similarity)
        known = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = step(few, known if linked is None else known.union(linked), told=True)
    return found.select(F.col("node").alias("id"), "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` but those with a near copy of smaller id in their component, with all their columns.

    Rows with a null id stay; rows that repeat an id stay or go together (drop
    exact copies first). Texts are moved once, by a sort-merge join at every size.
    """
    groups = near_copies(docs, id_col, text_col, width, similarity)
    gone = cut(groups.filter("id <> component").select(F.col("id").alias("__gone")).distinct(), docs.count())
    known = docs.filter(F.col(f"`{id_col}`").isNotNull())
    return known.join(gone.hint("merge"), known[f"`{id_col}`"] == gone["__gone"], "left_anti").union(docs.filter(F.col(f"`{id_col}`").isNull()))
