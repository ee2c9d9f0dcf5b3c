"""Packing by shortest-pack-first over the length histogram.

A document's token ids and a closing id are cut every ``size`` ids; the full
pieces fill sequences and the rests are packed. Only the histogram of piece
lengths (at most ``size`` rows) reaches the driver, which builds packing
patterns with counts: lengths go longest first, each into the packs that are
shortest so far if it fits there, else into new packs; a group of packs that is
only partly used is split in two. A length opens at most one group and splits
at most one, so there are at most ``2 * size`` patterns, and a pattern holds
fewer than ``sqrt(2 * size)`` distinct lengths, which bounds the slot table. Patterns go
back to the pieces by rank: the k-th piece of a length takes the k-th slot of
that length. Pieces of a length are ranked by hash; or, ``in_file_order``, as the
Parquet files of the documents hold them, so that of each length a pattern's earlier
sequences, and earlier patterns, hold earlier documents.

Defined results: a null or empty text is one piece with the closing id alone;
repeated rows are packed each; rows with a null id are packed like others; an
empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import cut, rank_within, text_of

#: Characters that Python's split() treats as white space and the tokenizer's \s doesn't.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
MOST_CACHED = 300_000
#: Characters that stay one character each, normalised or in lower case, with plain white space; their pre-tokens (fixed pattern of the tokenizer, for these characters).
PLAIN = re.compile("[\\t-\\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+").findall


class Chunks(dict):
    """Token ids, as bytes, of pre-tokens; emptied when it holds ``MOST_CACHED`` of them.

    A text of plain characters is split into its pre-tokens in lower case. In
    other texts that is done for each chunk between white space, and a chunk that
    is not plain is kept whole. What is new of a text is encoded in one call.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        """Encode parts in one call: each token belongs to the part that its offset lies in."""
        found = self.tokenizer.encode(" ".join(new), add_special_tokens=False)
        ids = np.asarray(found.ids, "<u4").tobytes()
        starts = np.cumsum([0, *(len(c) + 1 for c in new)])
        at = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
        edges = (4 * np.searchsorted(at, starts)).tolist()
        self.update(zip(new, (ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)), strict=True))

    def ids(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers.

        The tokenizer drops white space and none of its steps looks across
        it, so a text's ids are those of its chunks one after another. Special
        tokens are the exception: texts that may hold one are encoded as they are.
        """
        if "<|" in text or any(c in text for c in ODD):
            return self.encode(text)
        if len(self) > MOST_CACHED:
            self.clear()
        if PLAIN(text):
            parts = PARTS(text.lower())
        else:
            parts = list(chain.from_iterable(PARTS(c.lower()) if PLAIN(c) else (c,) for c in text.split()))
        new = [part for part in set(parts) if part not in self]
        if new:
            self.learn(new)
        return b"".join(map(self.__getitem__, parts))


@cache
def chunks(path: str) -> Chunks:
    return Chunks(path)


#: Place of a row in a folder of Parquet files as Spark writes it: by number of the part and of its file, then by row.
FILE, ROW = "_metadata.file_name", "_metadata.row_index"
PART = f"coalesce(try_cast(regexp_extract({FILE}, 'part-([0-9]+)', 1) as bigint), 0) * 100000 + coalesce(try_cast(regexp_extract({FILE}, '-c([0-9]+)[.]', 1) as bigint), 0)"


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", in_file_order: bool = False) -> DataFrame:
    """``(id, start, length, ids_crc32, doc_tokens)`` for each piece of each row, with ``part`` and ``row`` if ``in_file_order``."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        encoder = chunks(tokenizer)
        for b in batches:
            rows, columns = [], ([], [], [], [])
            for i, text in enumerate(b.column(1)):
                ids = memoryview(encoder.ids(text.as_py() or "") + end)
                tokens = len(ids) // 4
                for start in range(0, tokens, size):
                    part = ids[4 * start : 4 * (start + size)]
                    rows.append(i)
                    for column, value in zip(columns, (start, len(part) // 4, zlib.crc32(part), tokens), strict=True):
                        column.append(value)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *(pa.array(c, pa.int64()) for c in columns), *(c.take(at) for c in b.columns[2:])], names)

    places = [F.expr(PART).alias("part"), F.expr(ROW).alias("row")] if in_file_order else []
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", *(["part", "row"] if in_file_order else [])]
    source = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"), *places)
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:]))


def patterns(histogram: dict[int, int], size: int = 2048) -> list[tuple[list[tuple[int, int]], int]]:
    """``([(length, times), ...], packs)`` for each packing pattern."""
    packs: list[tuple[int, int, list, int]] = []  # fill, order of making, parts, number of packs: a heap, shortest first
    made = 0

    def put(fill: int, parts: list, n: int) -> None:
        nonlocal made
        made += 1
        heapq.heappush(packs, (fill, made, parts, n))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not packs or packs[0][0] + length > size:
                put(0, [], -(-left // (size // length)))
            fill, _, parts, n = heapq.heappop(packs)
            if n > left:
                put(fill, parts, n - left)
                n = left
            last, times = parts[-1] if parts else (0, 0)
            put(fill + length, [*parts[:-1], (length, times + 1)] if last == length else [*parts, (length, 1)], n)
            left -= n
    return [(parts, n) for _, _, parts, n in sorted(packs)]


def slots(found: list[tuple[list[tuple[int, int]], int]]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """For each length: (first rank, first sequence, packs, times, offset), by first rank."""
    out: dict[int, list] = {}
    given: dict[int, int] = {}
    first = 0
    for parts, n in found:
        offset = 0
        for length, times in parts:
            rank = given.get(length, 0)
            out.setdefault(length, []).append((rank, first, n, times, offset))
            given[length] = rank + n * times
            offset += length * times
        first += n
    return out


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", in_file_order: bool = False) -> DataFrame:
    """A row for each piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut_up = cut(pieces(docs, tokenizer, size, end_id, id_col, text_col, in_file_order))
    histogram = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # size rows at most
    plan = {k: np.asarray(v, np.int64).T for k, v in slots(patterns(histogram, size)).items()}

    def place(batches):
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (0, 1))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                starts, first, packs, times, base = plan[int(n)]
                k = np.searchsorted(starts, rank[at], "right") - 1
                inside = rank[at] - starts[k]
                # in order, a pack is filled before the next
                pack, nth = (inside // times[k], inside % times[k]) if in_file_order else (inside % packs[k], inside // packs[k])
                sequence[at] = first[k] + pack
                offset[at] = base[k] + nth * n
            yield pa.RecordBatch.from_arrays([*b.columns[2:], b.column(0), pa.array(sequence), pa.array(offset)], out)

    names = ["id", "start", "ids_crc32", "doc_tokens"]
    out = [*names, "length", "sequence_id", "offset"]
    kind = cut_up.schema["id"].dataType.simpleString()
    order, ranges = (["part", "row", "start"], "part") if in_file_order else (["id", "start", "ids_crc32"], None)
    ranked = rank_within(cut_up, "length", order, "rank", ranges=ranges).select("length", "rank", *names)
    placed = ranked.mapInArrow(place, f"id {kind}, " + ", ".join(f"{n} long" for n in out[1:]))
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
