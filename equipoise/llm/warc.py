"""WARC archives: writing a table as records, and a reader that salvages what a damaged archive still holds.

Every task writes archives of its own, one gzip member per record, into a folder that all executors share; only files
that a finished task reports are read, so a repeated task does no harm. The reader checks each record (member checksum,
header, length, digests). After a failed check it looks for the next member or version line that starts a valid record,
goes on there, and reports the bytes in between.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import suppress
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equipoise.llm.arrow import column, text_slices
from equipoise.sources.session import checkpoint, scratch_path

#: Fixed by the format.
VERSION, MAGIC = b"WARC/", b"\x1f\x8b\x08"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Archive bytes after which a task begins the next file; bytes that a reader fetches at once; salts of equal payloads.
FILE_BYTES, FETCH, SALTS = 256 << 20, 1 << 20, 32
#: Packed bytes that are inflated at once; content bytes between two states that a long member is inflated again from.
PIECE, SPACING = 1 << 16, 8 << 20
#: The date of records whose table has none, so that reruns write the same bytes.
DATE = "1970-01-01T00:00:00Z"


def digest32(data: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(key: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}"]
    head.append(f"WARC-Record-ID: <urn:row:{'' if key is None else quote(key, safe='')}>")
    if refers_to is not None:
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: <urn:row:{quote(refers_to, safe='')}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    head += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"WARC-Block-Digest: sha1:{digest32(block)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _uri(path: str) -> str:
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


def write_archives(df: DataFrame, folder: str, key: str, url: str | None, payload: str, min_bytes: int = 0, level: int = 3) -> DataFrame:
    """Write a record per row; a checkpointed table (path, records, bytes) of the archives.

    Of rows with equal payloads of ``min_bytes`` or more, the one with the smallest key is a response and the others
    revisit it; rows that share that key are all responses. A null payload is empty, a null key makes a response without
    an id. Other columns are not read. Equal payloads meet salted, so none gathers in one task.
    """
    data = F.coalesce(F.col(payload), F.lit(""))
    where = F.col(url) if url else F.lit(None).cast("string")
    rows = df.select(F.col(key).alias("_key"), where.alias("_url"), data.alias("_payload"), F.sha2(data, 256).alias("_same"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int"))
    equal = rows.where(F.col("_key").isNotNull() & (F.octet_length("_payload") >= min_bytes))
    salted = equal.groupBy("_same", "_salt").agg(F.min("_key").alias("_least"))
    first = salted.groupBy("_same").agg(F.min("_least").alias("_first"), F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_salts"))
    held = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.bit_get("_salts", s) == 1)
    first = first.select("_same", "_first", F.explode(held).alias("_salt"))
    long = F.octet_length("_payload") >= min_bytes
    refers = F.when(long & (F.col("_key") != F.col("_first")), F.col("_first")).cast("string")
    rows = rows.join(first, ["_same", "_salt"], "left").select(F.col("_key").cast("string").alias("_key"), "_url", "_payload", refers.alias("_refers"))
    folder = _uri(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        out, path, records, size = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

        try:
            for batch in text_slices(batches, "_payload"):
                bodies = column(batch, "_payload").cast(pa.large_binary()).to_pylist()
                for k, u, body, refers_to in zip(*(column(batch, c).to_pylist() for c in ("_key", "_url")), bodies, column(batch, "_refers").to_pylist(), strict=True):
                    if out is None:
                        system.create_dir(base, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        path, records, size = f"{folder}/{name}", 0, 0
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                    packer = zlib.compressobj(level, wbits=31)
                    member = packer.compress(record_bytes(k, u, body, refers_to)) + packer.flush()
                    out.write(member)
                    records, size = records + 1, size + len(member)
                    if size >= FILE_BYTES:
                        yield close()
                        out = None
            if out is not None:
                yield close()
                out = None
        finally:
            if out is not None:
                out.close()

    return checkpoint(rows.mapInArrow(write, "path string, records long, bytes long"))


class Record(NamedTuple):
    """A valid record: its place, its headers (lower-case names), its payload, and the payload's length when stored elsewhere."""

    start: int
    end: int
    headers: dict[str, str]
    payload: bytes
    payload_bytes: int


class Gap(NamedTuple):
    """Bytes that hold no valid record, and what failed first."""

    start: int
    end: int
    reason: str


class _Bad(Exception):
    pass


class _Source:
    """Random access to a file, or to bytes, with one fetched piece kept."""

    def __init__(self, read: object, size: int):
        self.read, self.size, self.at, self.piece, self.known = read, size, 0, b"", (0, -1)

    def get(self, start: int, n: int) -> bytes:
        n = max(0, min(n, self.size - start))
        if not (self.at <= start and start + n <= self.at + len(self.piece)):
            self.at, self.piece = start, self.read(min(max(n, FETCH), self.size - start), start)
        return self.piece[start - self.at : start - self.at + n]

    def blank(self, start: int) -> int:
        """The next place from ``start`` on where an empty line begins; the end if there is none. What was found is kept."""
        if not self.known[0] <= start <= self.known[1]:
            at, width, found = start, 4096, self.size
            while at < self.size:
                piece = self.get(at, width)
                if (i := piece.find(b"\r\n\r\n")) >= 0:
                    found = at + i
                    break
                at += max(1, len(piece) - 3)
                width = min(4 * width, FETCH)
            self.known = (start, found)
        return self.known[1]

    def find(self, start: int) -> int:
        """The next place from ``start`` on where a member or a version line may begin; the end if there is none."""
        while start < self.size:
            piece = self.get(start, FETCH)
            found = [i for i in (piece.find(MAGIC), piece.find(VERSION)) if i >= 0]
            if found:
                return start + min(found)
            if len(piece) <= len(VERSION):
                break
            start += len(piece) - len(VERSION) + 1
        return self.size


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Bad("header line without a colon")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _record(source: _Source, start: int, proof: bool) -> Record:
    """The record whose version line begins at ``start``; ``proof`` asks for a digest of its own content."""
    stop = source.blank(start) - start
    if start + stop >= source.size:
        raise _Bad("header does not end")
    if source.get(start, len(VERSION)) != VERSION:
        raise _Bad("no version line")
    lines = source.get(start, stop).split(b"\r\n")
    headers = _headers(lines[1:])
    if not headers.get("content-length", "").isdecimal():
        raise _Bad("no content length")
    begin, n = start + stop + 4, int(headers["content-length"])
    if begin + n + 4 > source.size:
        raise _Bad("record is cut off")
    block = source.get(begin, n + 4)
    block, tail = block[:n], block[n:]
    if tail != b"\r\n\r\n":
        raise _Bad("length does not fit")
    if headers.get("warc-block-digest", f"sha1:{digest32(block)}") != f"sha1:{digest32(block)}":
        raise _Bad("block digest differs")
    payload, stored = block, n
    if headers.get("content-type", "").startswith("application/http"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        if not blank:
            raise _Bad("HTTP header does not end")
        told = _headers(http.split(b"\r\n")[1:]).get("content-length", "")
        stored = int(told) if told.isdecimal() else len(payload)
    if headers.get("warc-type") != "revisit":
        stored = len(payload)
        if headers.get("warc-payload-digest", f"sha1:{digest32(payload)}") != f"sha1:{digest32(payload)}":
            raise _Bad("payload digest differs")
    if proof and "warc-block-digest" not in headers and ("warc-payload-digest" not in headers or headers.get("warc-type") == "revisit"):
        raise _Bad("no digest")
    return Record(start, begin + n + 4, headers, payload, stored)


def _inflate(source: _Source, at: int, unpacker: object) -> Iterator[tuple[int, bytes, object, str | None]]:
    """(place after a piece, its content, the state then, what failed) of a gzip member, up to its end or to where it fails.

    The piece that fails is taken byte by byte, so that all before the fault is there.
    """
    while not unpacker.eof:
        piece = source.get(at, PIECE)
        if not piece:
            yield at, b"", unpacker, "member is cut off"
            return
        before = unpacker.copy()
        try:
            content = unpacker.decompress(piece)
        except zlib.error as e:
            parts = []
            with suppress(zlib.error):
                for i in range(len(piece)):
                    parts.append(before.decompress(piece[i : i + 1]))
            yield at + len(parts), b"".join(parts), before, f"member: {e}"
            return
        at += len(piece)
        yield at - len(unpacker.unused_data), content, unpacker, None


class _Member:
    """The content of the gzip member at ``start``, by place; ``reason`` says what failed, if its checksum does not hold.

    A short content is kept. Of a long one, states are kept (40 KB each, one per ``SPACING`` bytes) from which it is
    inflated again, so that memory does not follow its length.
    """

    def __init__(self, source: _Source, start: int):
        self.packed, self.start, self.size, self.reason, self.end = source, start, 0, None, start
        self.states, self.places, parts = [(0, start, zlib.decompressobj(wbits=31))], [], []
        for at, content, state, self.reason in _inflate(source, start, self.states[0][2].copy()):
            self.size, self.end = self.size + len(content), at
            self.places.append((self.size, at))
            if parts is not None:
                parts.append(content)
                parts = parts if self.size <= FETCH else None
            if self.reason is None and self.size - self.states[-1][0] >= SPACING:
                self.states.append((self.size, at, state.copy()))
        self.content = None if parts is None else b"".join(parts)
        self.stream, self.held, self.at = iter(()), b"", self.size

    def read(self, n: int, i: int) -> bytes:
        if self.content is not None:
            return self.content[i : i + n]
        if not self.at <= i <= self.at + len(self.held) + SPACING:
            begin, at, state = self.states[bisect_right(self.states, i, key=lambda s: s[0]) - 1]
            self.stream, self.held, self.at = _inflate(self.packed, at, state.copy()), b"", begin
        past = max(0, min(i - self.at - FETCH, len(self.held)))  # a little of what is behind is kept for a step back
        self.held, self.at = self.held[past:], self.at + past
        parts, have = [self.held], self.at + len(self.held)
        while have < i + n and (found := next(self.stream, None)) is not None:
            if have <= i:  # nothing before i is asked for
                parts, self.at = [], have
            parts.append(found[1])
            have += len(found[1])
        self.held = b"".join(parts)
        return self.held[i - self.at : i - self.at + n]

    def after(self, used: int) -> int:
        """A place in the file behind which all content from ``used`` on lies."""
        i = bisect_right(self.places, used, key=lambda p: p[0])
        return max(self.start + 1, self.places[i - 1][1] if i else 0)


def salvage(source: _Source, proof: bool = False) -> Iterator[Record | Gap]:
    """Valid records and the gaps between them, in order. Offsets are those of the file (of the member, where packed).

    A member that is cut or ends wrongly gives the records before the fault whose digests hold, and a gap from the last
    place on that they do not need. ``proof`` takes only records that carry a digest of their own.
    """
    at, lost, reason = 0, None, ""
    while at < source.size:
        try:
            if source.get(at, len(MAGIC)) == MAGIC:
                member = _Member(source, at)
                used, waiting, seen = 0, [], False
                for x in salvage(_Source(member.read, member.size), proof or member.reason is not None):
                    here = x._replace(start=at, end=member.end)
                    if isinstance(x, Gap):
                        waiting.append(here)
                        continue
                    if lost is not None:
                        yield Gap(lost, at, reason)
                        lost = None
                    if member.reason is None:
                        yield from waiting
                    used, waiting, seen = x.end, [], True
                    yield here
                if not seen:
                    raise _Bad(member.reason or (waiting[0].reason if waiting else "member is empty"))
                if member.reason is None:
                    yield from waiting
                    at = member.end
                else:
                    lost, reason = member.after(used), member.reason
                    at = source.find(lost)
                continue
            found = _record(source, at, proof)
        except _Bad as e:
            if lost is None:
                lost, reason = at, str(e)
            at = source.find(at + 1)
            continue
        if lost is not None:
            yield Gap(lost, at, reason)
            lost = None
        yield found
        at = found.end
    if lost is not None:
        yield Gap(min(lost, source.size - 1), source.size, reason)


RECORDS = (
    "path string, start long, end long, error string, warc_type string, record_id string, target_uri string, "
    "refers_to string, payload_bytes long, payload_digest string, payload binary"
)


def read_archives(paths: DataFrame, path: str = "path", with_payload: bool = True, records: str | None = None) -> DataFrame:
    """One row per valid record, and one per quarantined gap (``error`` says why, the record columns are null).

    ``paths`` has a row per archive, packed (``.gz``, a member per record or one for all) or plain. ``record_id`` and
    ``refers_to`` are what :func:`write_archives` was given as keys, or the whole id of a record from elsewhere; for a
    revisit, ``payload_bytes`` and ``payload_digest`` are those of the full payload it stands for. A task holds one
    record at a time, also where one member packs them all; what such a member holds before a fault is recovered. A missing file or a null path fails; where a column ``records`` tells how many records an archive
    has, a gap in it or another number of records fails too.
    """
    schema = T._parse_datatype_string(RECORDS)
    names = [f.name for f in schema if with_payload or f.name != "payload"]

    def name(urn: str | None) -> str | None:
        urn = (urn or "").removeprefix("<").removesuffix(">")
        return (unquote(urn.removeprefix("urn:row:")) if urn.startswith("urn:row:") else urn) or None

    def rows(where: str) -> Iterator[dict]:
        system, at = fs.FileSystem.from_uri(_uri(where))
        with system.open_input_file(at) as f:
            for x in salvage(_Source(lambda n, i: f.read_at(n, i), f.size())):
                if isinstance(x, Gap):
                    yield {"path": where, "start": x.start, "end": x.end, "error": x.reason}
                else:
                    h = x.headers
                    yield {
                        "path": where, "start": x.start, "end": x.end, "warc_type": h.get("warc-type"),
                        "record_id": name(h.get("warc-record-id")), "target_uri": h.get("warc-target-uri"), "refers_to": name(h.get("warc-refers-to")),
                        "payload_bytes": x.payload_bytes, "payload_digest": h.get("warc-payload-digest", f"sha1:{digest32(x.payload)}").removeprefix("sha1:"), "payload": x.payload,
                    }

    kinds = {"start": pa.int64(), "end": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    arrow = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = column(batch, records).to_pylist() if records else [None] * batch.num_rows
            for where, wanted in zip(column(batch, path).to_pylist(), told, strict=True):
                held, size, valid = [], 0, 0
                for row in rows(where):
                    if wanted is not None and "error" in row:
                        raise ValueError(f"{where}: {row['error']} at {row['start']}")
                    valid += "error" not in row
                    held.append(row)
                    size += len(row.get("payload") or b"") if with_payload else 0
                    if len(held) >= 4096 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held, size = [], 0
                if wanted is not None and valid != wanted:
                    raise ValueError(f"{where}: {valid} records of {wanted}")
                if held:
                    yield pa.RecordBatch.from_pylist(held, arrow)

    return paths.select(path, *([records] if records else [])).mapInArrow(read, T.StructType([f for f in schema if f.name in names]))


def archive_round_trip(spark: SparkSession, df: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """Write ``df`` as archives in the shared folder and read them back: (key, payload_bytes, payload_digest, record_type, refers_to).

    Fails when an archive does not give back every record that was written.
    """
    kind = df.schema[key].dataType
    archives = write_archives(df, scratch_path(spark, "warc"), key, url, payload)
    records = read_archives(archives, with_payload=False, records="records")
    return records.select(
        F.col("record_id").cast(kind).alias(key), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to")
    )
