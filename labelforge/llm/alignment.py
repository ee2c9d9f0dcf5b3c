"""Cross-tokenizer alignment by segment deduplication.

Two tokenizers, A (byte-level BPE) and B (sentencepiece BPE, which puts a space before a text), encode the same
bytes: a space and the text. Byte offsets where tokens of both end cut them into groups; an A and a B token whose byte ranges
overlap are linked.

1. A text is split before runs of white space where neither vocabulary can merge across (``cut_chars`` reads this from the
   vocabularies: no entry has the white-space character after another kind of character). So encoding the segments one by one gives
   the tokens of the whole text, and no group crosses a segment's start.
2. Documents are dealt into chunks of about ``chunk_bytes`` of text by a hash of id and text. Each chunk names its distinct segments; ``REGION``
   chunks are a region, and a region's distinct segments are tokenised and aligned once. Rows for a segment are bounded by
   that, whatever its share of the corpus.
3. Counts of linked id pairs are added up over all documents from the distinct segments.
4. Alignments, with the sums of those counts, are joined back to chunks; each chunk's documents are composed from them in order.

What moves is the text, twice, and each chunk's distinct segments; tokenizers run on distinct segments alone.

Defined results: a null or empty text, and one that B's normalisation changes (a text with U+2581, say), has no tokens: all figures are 0, its groups are
empty and it doesn't enter the counts. Strings of special tokens in a text are plain text. Repeated rows are counted and composed each; a null id is kept; an empty table gives an empty result;
other columns play no part.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
import uuid
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelforge.llm.common import ensure_checkpoint_dir, look_up, text_of

#: Chunks whose distinct segments are aligned together: 32 GB of text at the usual size of a chunk.
REGION = 4096
CHUNK_BYTES = 8 << 20
MARK = "▁"
#: White space at which a text may be cut, if the vocabularies allow it.
SPACES = " \n\t\r"


def byte_decoder() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, sizes of their entries in bytes, and the rule for cutting texts."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        to_byte = byte_decoder()
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.a_sizes = np.zeros(1 + max(vocab.values()), np.int64)
        for t, i in vocab.items():
            self.a_sizes[i] = len(t) if all(c in to_byte for c in t) else 0
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_sizes = np.array([1 if self.b.is_byte(i) else len(p.replace(MARK, " ").encode()) for i, p in pieces], np.int64)
        self.names = [str(i) for i in range(max(len(self.a_sizes), len(self.b_sizes)))]
        self.cuts = cut_chars(a_path, [p for i, p in pieces if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i)])
        others = f"[^\\S{re.escape(self.cuts)}]"
        self.segments = re.compile(rf"\s+(?:\S+(?:{others}\s*)?)*")

    def whole(self, text: str | None) -> bool:
        """True if B's tokens hold all bytes of the text: its normalisation changes nothing but spaces."""
        return bool(text) and MARK not in text and self.b.normalize(text) == MARK + text.replace(" ", MARK)

    def split(self, text: str) -> list[str]:
        return self.segments.findall(" " + text)

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B for segments, one after another. Those that end in white space, which would run into the next one's, come last and by themselves."""
        solid = sum(not s[-1].isspace() for s in segments)
        if any(s[-1].isspace() for s in segments[:solid]):
            raise ValueError("segments that end in white space come last")
        texts = ["".join(segments[:solid]), *segments[solid:]] if solid else segments
        a = [self.a.encode(t, add_special_tokens=False).ids for t in texts]
        # in a text that begins with a space, the one that B adds stands for it; else that is a token of its own
        b = [self.b.encode(t[1:]) if t[0] == " " else self.b.encode(t)[1:] for t in texts]
        return tuple(np.fromiter(itertools.chain.from_iterable(x), np.int64) for x in (a, b))


def cut_chars(a_path: str, b_pieces: list[str]) -> str:
    """Those of ``SPACES`` before which neither vocabulary can merge after another kind of character; a space must be among them.

    A must split into words by the byte-level rule, of which no alternative goes on from another character to white space, and have no
    normaliser. In B no piece may have a mark after another character; other white space must be in no piece at all, so that a space before it stays a token of its own.
    """
    with open(a_path, encoding="utf-8") as f:
        told = json.load(f)
    pre = told.get("pre_tokenizer") or {}
    if told.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("A must be a byte-level BPE without normaliser or added space")
    found = ""
    for c in SPACES:
        merges = any(re.search(f"[^{MARK}]{MARK}", p) for p in b_pieces) if c == " " else any(c in p for p in b_pieces)
        if not merges:
            found += c
    if " " not in found:
        raise ValueError("a vocabulary merges across spaces")
    return found


@cache
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def align(segments: list[str], a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Where segments, groups and links lie among their tokens' ids ``a`` and ``b``, all segments at once.

    Bytes between two neighbouring ends, of tokens of either side, belong to one A and one B token; two tokens that overlap have exactly one such
    stretch in common. So each end is a link, and each end on both sides closes a group. ``a_at``, ``b_at``, ``groups_at`` and ``links_at``: how many of these are done at each
    segment's end; ``group_a``, ``group_b``: how many tokens are done at each group's end; ``link_a``, ``link_b``: the ids of each link.
    """
    a_ends, b_ends = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
    ends = np.cumsum([len(s.encode()) for s in segments])
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    every = np.union1d(a_ends, b_ends)
    if not np.isin(ends, common).all() or every[-1] != ends[-1]:
        raise ValueError("a token of A or B crosses a segment's end")
    done = lambda x, at: np.searchsorted(x, at, side="right")
    return {
        "a_at": done(a_ends, ends), "b_at": done(b_ends, ends), "groups_at": done(common, ends), "links_at": done(every, ends),
        "group_a": done(a_ends, common), "group_b": done(b_ends, common),
        "link_a": a[np.searchsorted(a_ends, every)], "link_b": b[np.searchsorted(b_ends, every)],
    }


def _chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """``(chunk, id, text)``; null texts are empty."""
    text = text_of(text_col)
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    return rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(1 + total // chunk_bytes)).cast("int").alias("chunk"), "id", "text")


def distinct_segments(chunked: DataFrame, vocabs: tuple[str, str], region: int = REGION) -> DataFrame:
    """``(segment, n, chunks)``: a region's distinct segments, how often they occur in it and in which chunks."""

    def run(batches):
        p = pair(*vocabs)
        found: Counter[str] = Counter()
        at = None

        def told():
            names = list(found)
            for i in range(0, len(names), 10_000):
                part = names[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(part), pa.int32()), pa.array(part, pa.string()), pa.array([found[s] for s in part], pa.int64())], ["chunk", "segment", "n"])

        for b in batches:
            for chunk, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if chunk != at:
                    yield from told()
                    found.clear()
                    at = chunk
                if p.whole(t := text.as_py()):
                    found.update(p.split(t))
        yield from told()

    dealt = chunked.filter("text <> ''").select("chunk", "text").repartition("chunk").sortWithinPartitions("chunk")
    named = dealt.mapInArrow(run, "chunk int, segment string, n long")
    held = named.groupBy(F.expr(f"chunk div {region}").alias("region"), "segment").agg(F.sum("n").alias("n"), F.collect_list("chunk").alias("chunks"))
    return held.select("segment", "n", "chunks")


def aligned_segments(segments: DataFrame, vocabs: tuple[str, str]) -> DataFrame:
    """``segments`` with n_a, n_b, n_groups, ``groups`` (ids of A and B by group, as text) and ``a`` and ``b``, the ids of each link."""
    schema = "segment string, n long, chunks array<int>, n_a int, n_b int, n_groups int, groups string, a array<int>, b array<int>"

    def run(batches):
        p = pair(*vocabs)
        name = p.names.__getitem__

        for batch in batches:
            segments = batch.column(0).to_pylist()
            order = sorted(range(len(segments)), key=lambda i: segments[i][-1].isspace())
            segments = [segments[i] for i in order]
            batch = batch.take(pa.array(order))
            a, b = p.encode(segments)
            at = align(segments, a, b, p.a_sizes, p.b_sizes)
            a_names, b_names = list(map(name, a.tolist())), list(map(name, b.tolist()))
            bounds = (itertools.pairwise([0, *at[c].tolist()]) for c in ("group_a", "group_b"))
            texts = [f"{a_names[i] if j - i == 1 else ','.join(a_names[i:j])}|{b_names[k] if n - k == 1 else ','.join(b_names[k:n])}" for (i, j), (k, n) in zip(*bounds, strict=True)]
            groups = [";".join(texts[i:j]) for i, j in itertools.pairwise([0, *at["groups_at"].tolist()])]
            counts = [pa.array(np.diff(at[c], prepend=0), pa.int32()) for c in ("a_at", "b_at", "groups_at")]
            offsets = pa.array(np.concatenate([[0], at["links_at"]]), pa.int32())
            links = [pa.ListArray.from_arrays(offsets, pa.array(at[c], pa.int32())) for c in ("link_a", "link_b")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *counts, pa.array(groups, pa.string()), *links], ["segment", "n", "chunks", "n_a", "n_b", "n_groups", "groups", "a", "b"])

    return segments.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(a, b, count, best, held)``: links of each id pair over all documents, whether that is the highest of its B id, and how many links of segments hold it.

    A B id meets A's ids at most, so the window over it is bounded by A's vocabulary.
    """
    each = aligned.select("n", F.inline(F.arrays_zip("a", "b")))
    counts = each.groupBy("a", "b").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("held"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


#: Id pairs that are sent to every task (17 bytes each); with more, segments are joined to them.
MOST_SENT = 2_000_000


def with_sums(aligned: DataFrame, pairs: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """``aligned`` without its links, with n_best and count_sum."""
    spark = aligned.sparkSession
    kept = ["segment", "chunks", "n_a", "n_b", "n_groups", "groups"]
    if pairs.count() > most_sent:
        numbered = _stored(aligned.withColumn("sid", F.monotonically_increasing_id()), "numbered")
        each = numbered.select("sid", F.inline(F.arrays_zip("a", "b")))
        joined = look_up(each, pairs, ["a", "b"], "held", each.count())
        sums = joined.groupBy("sid").agg(F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
        return numbered.withColumn("n_links", F.size("a").cast("long")).join(sums.hint("merge"), "sid").select(*kept, "n_links", "n_best", "count_sum")
    table = pairs.select(F.expr("(bigint(a) << 32) | b").alias("key"), "count", "best").toArrow().sort_by("key")
    sent = spark.sparkContext.broadcast([table.column(c).to_numpy() for c in ("key", "count", "best")])

    def run(batches):
        keys, counts, best = sent.value
        for batch in batches:
            a, b = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in "ab")
            at = np.searchsorted(keys, a << 32 | b)
            n_links = batch.column("a").value_lengths().to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(n_links)])
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (best[at].astype(np.int64), counts[at])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *map(pa.array, [n_links, *sums])], [*kept, "n_links", "n_best", "count_sum"])

    kinds = {f.name: f.dataType.simpleString() for f in aligned.schema.fields}
    return aligned.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", n_links long, n_best long, count_sum long")


_FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def compose(chunked: DataFrame, facts: DataFrame, vocabs: tuple[str, str]) -> DataFrame:
    """``(id, n_a, ..., groups_sha256)``: documents from their segments' facts, chunk by chunk."""
    id_kind = chunked.schema["id"].dataType.simpleString()
    zeros = [F.lit(0).cast("long").alias(c) for c in _FIGURES]
    docs = chunked.select("chunk", F.lit(1).alias("kind"), "id", "text", F.lit("").alias("groups"), *zeros)
    known = facts.select(F.explode("chunks").alias("chunk"), F.lit(0).alias("kind"), F.lit(None).cast(id_kind).alias("id"), F.col("segment").alias("text"), "groups", *[F.col(c).cast("long").alias(c) for c in _FIGURES])
    # a chunk's segments come first, its documents after them
    dealt = known.unionByName(docs).repartition("chunk").sortWithinPartitions("chunk", "kind")

    def run(batches):
        p = pair(*vocabs)
        at, index, groups, parts, figures = None, {}, [], [], None
        for batch in batches:
            chunks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bounds = [0, *(np.flatnonzero((np.diff(chunks) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if chunks[lo] != at:
                    at, index, groups, parts, figures = chunks[lo], {}, [], [], None
                if kinds[lo] == 0:
                    index.update(zip(part.column(3).to_pylist(), range(len(groups), len(groups) + hi - lo), strict=True))
                    groups += part.column(4).to_pylist()
                    parts.append(np.column_stack([part.column(c).to_numpy() for c in _FIGURES]))
                    continue
                if figures is None:
                    figures = np.concatenate(parts) if parts else np.zeros((0, len(_FIGURES)), np.int64)
                    parts = []
                sums, digests = np.zeros((hi - lo, len(_FIGURES)), np.int64), []
                for i, text in enumerate(part.column(3)):
                    digest = ""
                    if p.whole(t := text.as_py()):
                        own = list(map(index.__getitem__, p.split(t)))
                        sums[i] = figures[own].sum(axis=0)
                        digest = hashlib.sha256(";".join(map(groups.__getitem__, own)).encode()).hexdigest()
                    digests.append(digest)
                yield pa.RecordBatch.from_arrays([part.column(2), *[pa.array(sums[:, c]) for c in range(len(_FIGURES))], pa.array(digests, pa.string())], ["id", *_FIGURES, "groups_sha256"])

    return dealt.mapInArrow(run, f"id {id_kind}, " + ", ".join(f"{c} long" for c in _FIGURES) + ", groups_sha256 string")


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: its lineage ends there."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, most_sent: int = MOST_SENT, region: int = REGION) -> DataFrame:
    """``id_col``, n_a, n_b, n_groups, n_links, n_best (links whose pair's count is the highest of its B id), count_sum (of the counts over links) and groups_sha256 of each row."""
    vocabs = (a_path, b_path)
    chunked = _chunked(docs, id_col, text_col, chunk_bytes)
    aligned = _stored(aligned_segments(distinct_segments(chunked, vocabs, region), vocabs), "aligned")
    pairs = _stored(pair_counts(aligned), "pairs")
    return compose(chunked, with_sums(aligned, pairs, most_sent), vocabs).withColumnRenamed("id", id_col)
