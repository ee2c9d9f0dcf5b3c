"""WARC records in seekable Zstandard bundles.

A bundle is one binary value: independent Zstandard frames of whole WARC
records, then a skippable frame with the seek table of the public seekable
format (compressed and decompressed size of each frame, then frame count,
descriptor and magic number). An index maps each record to bundle, frame and
offset inside the decompressed frame, so a lookup decompresses one frame only.

Of records with equal payloads of at least ``least_bytes`` bytes, the one with the largest id is
the ``response``; the others become ``revisit`` records that name it and hold
no payload but its HTTP header with the full length. Payloads are compared in
full (see exact_dedup).

Defined results: a null payload is empty; repeated rows with the largest id
are all responses; a null id or url is written as an empty field and read back as null; an empty
table gives no bundles and an empty result; other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import text_of
from labelforge.llm.exact_dedup import assign_copies

# Fixed values of the seekable format: skippable frame, table footer.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
DATE = "2000-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def urn(identifier: int | None) -> str:
    return "" if identifier is None else f"<urn:x-record:{identifier}>"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(identifier: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit's payload is left out."""
    block = (HTTP % len(payload)).encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(identifier)}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + " ".join((url or "").split()),
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {SAME}", f"WARC-Refers-To: {urn(refers_to)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + END + block + END


def bundle(frames: list[bytes], level: int = 9) -> bytes:
    """Frames, each compressed by itself, and the seek table."""
    packed = [zstandard.ZstdCompressor(level=level).compress(f) for f in frames]
    table = b"".join(struct.pack("<II", len(p), len(f)) for p, f in zip(packed, frames, strict=True))
    table += FOOTER.pack(len(frames), 0, SEEKABLE)
    return b"".join(packed) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, from the footer alone."""
    n, flags, magic = FOOTER.unpack(data[-FOOTER.size :])
    if magic != SEEKABLE or flags & 0x80:
        raise ValueError("not a seekable bundle of this kind")
    at, start, found = len(data) - FOOTER.size - 8 * n, 0, []
    for i in range(n):
        packed, size = struct.unpack_from("<II", data, at + 8 * i)
        found.append((start, packed, size))
        start += packed
    return found


def frame(data: bytes, start: int, packed: int, size: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data[start : start + packed], max_output_size=size)


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block and end of the record at an offset of a frame."""
    stop = data.index(END, at)
    lines = data[at:stop].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    first = stop + len(END)
    last = first + int(fields["Content-Length"])
    return fields, data[first:last], last + len(END)


def identifier_of(field: str) -> int | None:
    return int(field[14:-1]) if field else None


def facts(fields: dict[str, str], block: bytes) -> dict:
    """What a record says, as read: ids, type, payload and its digest and full length."""
    head, _, payload = block.partition(END)
    size = int(head.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload doesn't match its digest")
    return {
        "id": identifier_of(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"] or None,
        "record_type": fields["WARC-Type"],
        "refers_to": identifier_of(fields.get("WARC-Refers-To", "")),
        "payload": None if revisit else payload,
        "payload_bytes": size,
        "payload_digest": digest,
    }


def write_bundles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least_bytes: int = 0, frame_bytes: int = 1 << 19, bundle_bytes: int = 1 << 22) -> DataFrame:
    """``(bundle, data, index)``: bundles of about ``bundle_bytes`` before compression.

    ``index`` lists (id, frame, offset) of each record. The id is a whole number.
    """
    marked = assign_copies(pages, id_col, text_col, keep=[url_col], with_text=True)

    def run(batches):
        frames: list[bytes] = []
        index: list[tuple] = []
        now, total, number = bytearray(), 0, 0
        part = TaskContext.get().partitionId()

        def close():
            nonlocal frames, index, total, number
            out = pa.RecordBatch.from_pylist([{"bundle": f"{part:06d}-{number:06d}", "data": bundle(frames), "index": index}], schema)
            frames, index, total, number = [], [], 0, number + 1
            return out

        for b in batches:
            for identifier, url, text, keep in zip(*(c for c in b.columns), strict=True):
                identifier, keep = identifier.as_py(), keep.as_py()
                payload = (text.as_py() or "").encode("utf-8", "surrogatepass")
                revisit = identifier != keep and len(payload) >= least_bytes
                index.append({"id": identifier, "frame": len(frames), "offset": len(now)})
                now += record(identifier, url.as_py(), payload, keep, revisit)
                if len(now) >= frame_bytes:
                    frames.append(bytes(now))
                    total += len(now)
                    now.clear()
                    if total >= bundle_bytes:
                        yield close()
        if now:
            frames.append(bytes(now))
        if frames:
            yield close()

    schema = pa.schema([("bundle", pa.string()), ("data", pa.binary()), ("index", pa.list_(pa.struct([("id", pa.int64()), ("frame", pa.int64()), ("offset", pa.int64())])))])
    source = marked.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col("content").alias("text"), F.col("keep_id").cast("long").alias("keep"))
    return source.mapInArrow(run, "bundle string, data binary, index array<struct<id:long,frame:long,offset:long>>")


RECORD = "bundle string, id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
_ARROW = pa.schema([("bundle", pa.string()), ("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def read_bundles(bundles: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record, read frame by frame through the seek table."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0), b.column(1), strict=True):
                raw = data.as_py()
                for start, packed, size in seek_table(raw):
                    text, at, rows = frame(raw, start, packed, size), 0, []
                    while at < len(text):
                        fields, block, at = parse(text, at)
                        row = facts(fields, block) | {"bundle": name.as_py()}
                        rows.append(row if with_payload else row | {"payload": None})
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return bundles.select("bundle", "data").mapInArrow(run, RECORD)


def _read_places(rows: DataFrame, with_payload: bool) -> DataFrame:
    """Records of ``rows`` (bundle, data, places): each at its (id, frame, offset), frame by frame. One that bears another id there is an error."""

    def run(batches):
        for b in batches:
            for name, data, places in zip(*b.columns, strict=True):
                raw, by_frame = data.as_py(), {}
                for p in places.as_py():
                    by_frame.setdefault(p["frame"], []).append((p["offset"], p["id"]))
                table = seek_table(raw)
                for k, entries in sorted(by_frame.items()):
                    text, found = frame(raw, *table[k]), []
                    for at, identifier in sorted(entries, key=lambda e: e[0]):
                        row = facts(*parse(text, at)[:2]) | {"bundle": name.as_py()}
                        if row["id"] != identifier:
                            raise ValueError(f"record {identifier} isn't where the index has it")
                        found.append(row if with_payload else row | {"payload": None})
                    yield pa.RecordBatch.from_pylist(found, _ARROW)

    return rows.mapInArrow(run, RECORD)


def read_indexed(bundles: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each entry of the bundles' indexes, read at its frame and offset."""
    return _read_places(bundles.select("bundle", "data", F.col("index").alias("places")), with_payload)


def look_up(bundles: DataFrame, wanted: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Records of the ids in ``wanted``: each is read from its own frame at its own offset."""
    entries = bundles.select("bundle", F.inline("index"))
    asked = wanted.select(F.col(id_col).cast("long").alias("id")).distinct()
    places = entries.join(asked, "id").groupBy("bundle").agg(F.collect_list(F.struct("id", "frame", "offset")).alias("places"))
    return _read_places(bundles.join(places, "bundle").select("bundle", "data", "places"), True)


def store(bundles: DataFrame, folder: str) -> DataFrame:
    """Write bundles as a table in ``folder``, which all executors share, and return the table as read back."""
    path = f"{folder}/bundles-{uuid.uuid4().hex}"
    bundles.write.parquet(path, compression="none")
    return bundles.sparkSession.read.parquet(path)
