"""Media columns: texts as grey PNG images, read back, and their cosine-transform hashes.

Encoder: bytes of the text, padded with zeros to a positive multiple of
``WIDTH``, are the 8-bit samples of an image ``WIDTH`` wide. Chunks IHDR, IDAT
(zlib) and IEND carry their checksums; the rows use the filter (none, sub or
up) with the smallest sum of absolute differences. Decoder: any non-interlaced
8-bit grey PNG; every chunk's checksum is tested and all five filters are
undone with numpy. Hash: rows and columns are averaged to 32 x 32, a
two-dimensional cosine transform is taken, and each of the 8 x 8 lowest
frequencies but the constant says whether it exceeds their median.

Defined results: a null or empty text is one row of zeros; equal texts give
equal bytes and hashes; repeated rows are encoded each; a null id is kept; a
null or damaged image raises on decoding; an empty table gives an empty result;
other columns play no part.
"""

from __future__ import annotations

import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import text_of

WIDTH = 64
GRID, LOW = 32, 8
# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def encode(payload: bytes, level: int = 6) -> bytes:
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    sub, up = pixels.copy(), pixels.copy()
    sub[:, 1:] -= pixels[:, :-1]
    up[1:] -= pixels[:-1]
    cost = [np.abs(x.view(np.int8).astype(np.int64)).sum() for x in (pixels, sub, up)]
    kind = int(np.argmin(cost))
    rows = np.empty((len(pixels), WIDTH + 1), np.uint8)
    rows[:, 0] = kind
    rows[:, 1:] = (pixels, sub, up)[kind]
    head = struct.pack(">IIBBBBB", WIDTH, len(pixels), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def chunks(data: bytes):
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) != size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        yield kind, body
        at += 12 + size


def _paeth_row(row: np.ndarray, above: np.ndarray) -> np.ndarray:
    out, left, corner = bytearray(row.tobytes()), 0, 0
    for i, (value, b) in enumerate(zip(row.tolist(), above.tolist(), strict=True)):
        p = left + b - corner
        pa_, pb, pc = abs(p - left), abs(p - b), abs(p - corner)
        guess = left if pa_ <= pb and pa_ <= pc else b if pb <= pc else corner
        left, corner = (value + guess) & 255, b
        out[i] = left
    return np.frombuffer(bytes(out), np.uint8)


def _average_row(row: np.ndarray, above: np.ndarray) -> np.ndarray:
    out, left = bytearray(row.tobytes()), 0
    for i, (value, b) in enumerate(zip(row.tolist(), above.tolist(), strict=True)):
        left = (value + ((left + b) >> 1)) & 255
        out[i] = left
    return np.frombuffer(bytes(out), np.uint8)


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Samples of filtered ``rows``, whose first column names each row's filter; runs of rows with one filter are undone at once."""
    kinds, data = rows[:, 0], rows[:, 1:]
    if len(kinds) and kinds.max() > PAETH:
        raise ValueError("unknown filter")
    out = np.empty_like(data)
    above = np.zeros(data.shape[1], np.uint8)
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if lo == hi:
            continue
        kind, part = kinds[lo], data[lo:hi]
        if kind == NONE:
            out[lo:hi] = part
        elif kind == SUB:
            np.cumsum(part, axis=1, dtype=np.uint8, out=out[lo:hi])
        elif kind == UP:
            np.cumsum(part, axis=0, dtype=np.uint8, out=out[lo:hi])
            out[lo:hi] += above
        else:
            for i in range(lo, hi):
                out[i] = above = (_average_row if kind == AVERAGE else _paeth_row)(data[i], above)
        above = out[hi - 1]
    return out


def decode(data: bytes) -> np.ndarray:
    """Samples of a grey 8-bit PNG, rows by columns."""
    head, packed, ended = None, [], False
    for kind, body in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit grey PNG without interlacing")
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    return unfilter(rows.reshape(head[1], head[0] + 1))


@cache
def _cosines(n: int = GRID, low: int = LOW) -> np.ndarray:
    k, i = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * i + 1) * k / (2 * n))


def _shrink(pixels: np.ndarray) -> np.ndarray:
    """Row averages over ``GRID`` bands (a band has one row at least)."""
    h = len(pixels)
    lo = np.arange(GRID) * h // GRID
    hi = np.maximum(lo + 1, (np.arange(GRID) + 1) * h // GRID)
    sums = np.concatenate([np.zeros((1, pixels.shape[1]), np.int64), np.cumsum(pixels, axis=0, dtype=np.int64)])
    return (sums[hi] - sums[lo]) / (hi - lo)[:, None]


def cosine_hash(pixels: np.ndarray) -> bytes:
    """64 bits: 63 low frequencies above their median, after a leading 0."""
    small = _shrink(_shrink(pixels).T).T
    waves = (_cosines() @ small @ _cosines().T).ravel()[1:]
    waves = np.round(waves, 6)
    return np.packbits(np.concatenate([[False], waves > np.median(waves)])).tobytes()


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 6) -> DataFrame:
    """``id_col``, ``n_bytes`` of the text and the binary column ``media``."""

    def run(batches):
        for b in batches:
            media = [encode(payload_of(t.as_py()), level) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), text_of(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def from_media(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """``stored`` with the binary columns ``payload`` (samples read back) and ``dct_hash``."""
    names = stored.columns
    at = names.index(media_col)

    def run(batches):
        for b in batches:
            payload, hashes = [], []
            for m in b.column(at):
                pixels = decode(m.as_py())
                payload.append(pixels.tobytes())
                hashes.append(cosine_hash(pixels))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(payload, pa.binary()), pa.array(hashes, pa.binary())], [*names, "payload", "dct_hash"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema)
    return stored.mapInArrow(run, f"{schema}, payload binary, dct_hash binary")
