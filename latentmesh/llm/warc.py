"""WARC records as a chunked table.

``read`` streams WARC files: a payload larger than ``CHUNK_BYTES`` becomes rows
``record_id, chunk_no`` of at most that size, each with the SHA-256 of the
payload up to its end, so neither reader nor consumer holds a whole record.
``write`` makes one file of each partition, a gzip member for each record,
hashed and packed slice by slice from the column's own memory.

Files are opened by URI through Arrow's file systems, so they can lie on any
store that all executors reach.  Names of files are unique to the attempt and
only those of attempts that succeeded are returned, so a lost executor leaves
at most files that nobody reads.

``intact`` is null but in a record's last chunk.  There it is true if the
payload is as long as its header says and has the digest that the header gives
in SHA-256, SHA-1 or MD5, by hexadecimal digits or base 32; false if it is cut
short, has another digest or ends a gzip member that can't be unpacked or whose
checksum is wrong; and null if its length is right and there is no digest of these kinds to compare.
Of a damaged member what could be unpacked is given, a row without payload at
least, and reading goes on at the next member that begins a record.  What is no
record, and a record without a length (``total`` is null), is a row that isn't
intact; reading goes on where the next record begins.

Defined cases: a null payload is written as an empty one and an empty payload
is read as one chunk of no bytes.  A null id or address is left out of the
record's headers and read as null, and so is a foreign ``X-Page-ID`` that is no
whole number.  Addresses come back as they were, blanks and line breaks too.
Repeated rows give records of their own with equal ``record_id``, told apart by
``file`` and ``position``.  A header longer than ``HEADER_BYTES`` is no record.
An empty table gives no file and no rows.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import opened, shared_dir, whole_number, written

CHUNK_BYTES = 64 << 10
HEADER_BYTES = 1 << 20
_READ_BYTES = 64 << 10
_BATCH_BYTES = 8 << 20
_DATE = "1970-01-01T00:00:00Z"
_CHUNKS = pa.schema([
    ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("position", pa.int64()), ("chunk_no", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("total", pa.int64()), ("digest", pa.string()), ("intact", pa.bool_()), ("payload", pa.binary()),
])
CHUNKS_DDL = "record_id string, page_id long, url string, file string, position long, chunk_no int, start long, length int, total long, digest string, intact boolean, payload binary"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{payload_digest}')}>"


def _headers(page_id: int | None, url: str | None, digest: str, length: int) -> bytes:
    lines = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {_DATE}", f"WARC-Block-Digest: sha256:{digest}", "Content-Type: text/html", f"Content-Length: {length}"]
    if url is not None:
        plain = re.sub(r"\s+", " ", url).strip()
        lines.append(f"WARC-Target-URI: {plain}")
        if plain != url:
            lines.append(f"X-Page-URL: {urllib.parse.quote(url, safe='')}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _pack(page_id: int | None, url: str | None, payload: memoryview, put: Callable[[bytes], object]) -> None:
    """Puts a record out as a gzip member, a slice after the other."""
    slices = range(0, len(payload), _READ_BYTES)
    digest = hashlib.sha256()
    for at in slices:
        digest.update(payload[at : at + _READ_BYTES])
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    put(packer.compress(_headers(page_id, url, digest.hexdigest(), len(payload))))
    for at in slices:
        if packed := packer.compress(payload[at : at + _READ_BYTES]):
            put(packed)
    put(packer.compress(b"\r\n\r\n") + packer.flush())


def _writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        name, out, n = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c) for c in range(3))):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                _pack(page_id.as_py(), url.as_py(), memoryview(html.as_buffer() if html.is_valid else b""), out.write)
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "records": [n]})

    return run


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``page_id, url, html`` as WARC files; ``file, records`` of each, as a written table."""
    rows = opened(pages, "page_id", "url", "html")[0].select(whole_number("page_id").alias("page_id"), F.col("url").cast("string"), F.col("html").cast("string"))
    return written(rows.mapInArrow(_writer(folder), "file string, records long"), "warc-files")


class _Members:
    """The bytes of a file, unpacked if it consists of gzip members; None where a member couldn't be unpacked to its end."""

    def __init__(self, raw):
        self.raw, self.data, self.at, self.base, self.size = raw, b"", 0, 0, 0  # base: where the data begins in the file; size: what the member gave so far

    def _has(self, n: int) -> bool:
        """Whether ``n`` more bytes are there."""
        while len(self.data) - self.at < n:
            more = self.raw.read(_READ_BYTES)
            if not more:
                return False
            self.data, self.base, self.at = self.data[self.at :] + more, self.base + self.at, 0
        return True

    def _head(self) -> bool:
        """Goes past a member's header; False if there is none."""
        if not self._has(10) or self.data[self.at : self.at + 3] != b"\x1f\x8b\x08" or self.data[self.at + 3] & 0xE0:
            return False
        flags, n = self.data[self.at + 3], 10
        if flags & 4:
            if not self._has(n + 2):
                return False
            n += 2 + int.from_bytes(self.data[self.at + n : self.at + n + 2], "little")
        for flag in (8, 16):
            if flags & flag:
                while (end := self.data.find(b"\0", self.at + n)) < 0:
                    if len(self.data) - self.at > HEADER_BYTES or not self._has(len(self.data) - self.at + 1):
                        return False
                n = end + 1 - self.at
        n += 2 if flags & 2 else 0
        if not self._has(n):
            return False
        self.at += n
        return True

    def _seek(self) -> bool:
        """Goes to where a member may begin."""
        while True:
            found = self.data.find(b"\x1f\x8b\x08", self.at)
            if found >= 0:
                self.at = found
                return True
            self.at = max(self.at, len(self.data) - 2)
            if not self._has(len(self.data) - self.at + 1):
                return False

    def __iter__(self) -> Iterator[bytes | None]:
        packed = self._has(2) and self.data[:2] == b"\x1f\x8b" or not self.data.lstrip().startswith(b"WARC/") and b"\x1f\x8b\x08" in self.data
        if not packed:
            while self._has(1):
                yield self.data[self.at :]
                self.at = len(self.data)
            return
        lost = False  # after damage only a member that begins a record is one
        while self._has(1):
            start, self.size = self.base + self.at, 0
            if self._head():
                unpack, crc, begin = zlib.decompressobj(-15), 0, b""
                while not unpack.eof and self._has(1):
                    try:
                        out = unpack.decompress(memoryview(self.data)[self.at :], 4096 if self.size < 4096 else _READ_BYTES)
                    except zlib.error:
                        break
                    self.at = len(self.data) - len(unpack.unused_data if unpack.eof else unpack.unconsumed_tail)
                    crc, self.size = zlib.crc32(out, crc), self.size + len(out)
                    if lost:
                        begin += out
                        if len(begin) < 5 and not unpack.eof:
                            continue
                        if not begin.startswith(b"WARC/"):
                            break
                        out, lost = begin, False
                    if out:
                        yield out
                check = crc.to_bytes(4, "little") + (self.size & 0xFFFFFFFF).to_bytes(4, "little")
                if unpack.eof and not lost and self._has(8) and self.data[self.at : self.at + 8] == check:
                    self.at += 8
                    continue
            if not lost:
                yield None
            # unpacking may have run over the next member's beginning
            lost, self.at = True, max(start + 1 - self.base, 0)
            if not self._seek():
                return


class _Stream:
    """Unpacked bytes, a piece at a time, up to where a member is damaged."""

    def __init__(self, raw):
        self.members = _Members(raw)
        self.pieces, self.held, self.begin, self.at = iter(self.members), bytearray(), 0, 0
        self.cut, self.ended = False, False

    def more(self) -> bool:
        """False at a damaged member's end, until ``resume``, and at the end."""
        if self.cut or self.ended:
            return False
        piece = next(self.pieces, b"")
        if not piece:
            self.cut, self.ended = piece is None, piece is not None
            return False
        del self.held[: self.begin]
        self.begin = 0
        self.held += piece
        return True

    def resume(self) -> None:
        """Forgets what is left of a damaged member."""
        self.at += len(self.held) - self.begin
        self.held, self.begin, self.cut = bytearray(), 0, False

    def take(self, n: int) -> bytes:
        """At most ``n`` bytes, fewer only before a damage or the end."""
        while len(self.held) - self.begin < n and self.more():
            pass
        out = bytes(self.held[self.begin : self.begin + n])
        self.begin += len(out)
        self.at += len(out)
        return out

    def sound(self) -> bool:
        """Whether what comes next, but for blanks, isn't the end of a damaged member."""
        at = self.begin
        while True:
            while at < len(self.held):
                if self.held[at] not in b"\r\n":
                    return True
                at += 1
            at -= self.begin
            if not self.more():
                return not (self.cut and self.members.size)
            at += self.begin

    def line(self, most: int = HEADER_BYTES) -> bytes | None:
        """A line, or what there is before a damage or the end, or the first ``most`` bytes of a longer one; None if there is nothing."""
        seen = 0
        while (end := self.held.find(b"\n", self.begin + seen)) < 0:
            seen = len(self.held) - self.begin
            if seen >= most:
                return self.take(most)
            if not self.more():
                return self.take(seen) or None
        return self.take(end + 1 - self.begin)


_HASHES = {"sha1": hashlib.sha1, "md5": hashlib.md5}


def _agrees(told: str, digest: bytes) -> bool:
    return told.lower() == digest.hex() or told.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


def _damaged(position: int, **known: object) -> dict:
    return {"record_id": None, "page_id": None, "url": None, "total": None} | known | {"position": position, "chunk_no": 0, "start": 0, "length": 0, "digest": hashlib.sha256().hexdigest(), "intact": False, "payload": b""}


def records(stream: _Stream, chunk: int) -> Iterator[dict]:
    """The chunks of every record, in order."""
    while True:
        line = b"\n"
        while line is not None and not line.strip():
            position, line = stream.at, stream.line()
        if line is None:
            if stream.ended:
                return
            if not stream.members.size:  # nothing of the damaged member could be unpacked
                yield _damaged(position)
            stream.resume()
            continue
        if not line.startswith(b"WARC/"):
            yield _damaged(position)
            while line is not None and not line.startswith(b"WARC/"):
                line = stream.line()
            if line is None:
                if stream.ended:
                    return
                stream.resume()
                continue
            position = stream.at - len(line)
        headers, size = {}, 0
        while (line := stream.line()) is not None and line.strip() and size <= HEADER_BYTES:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
            size += len(line)
        page, length = headers.get("x-page-id", ""), headers.get("content-length", "")
        url = urllib.parse.unquote(headers["x-page-url"]) if "x-page-url" in headers else headers.get("warc-target-uri")
        total = int(length) if re.fullmatch(r"[0-9]{1,18}", length) else None
        base = {"record_id": headers.get("warc-record-id"), "page_id": int(page) if re.fullmatch(r"-?[0-9]{1,18}", page) else None, "url": url, "position": position, "total": total}
        if line is None or line.strip() or total is None:  # the header is cut off, too long or says no length
            yield _damaged(**base)
            if line is None and stream.ended:
                return
            if stream.cut:
                stream.resume()
            continue
        kind, _, told = headers.get("warc-block-digest", "").partition(":")
        sha, start, number = hashlib.sha256(), 0, 0
        check = sha if kind.lower() == "sha256" else _HASHES[kind.lower()]() if kind.lower() in _HASHES else None
        while True:
            want = min(chunk, total - start)
            data = stream.take(want)
            sha.update(data)
            if check is not None and check is not sha:
                check.update(data)
            last = start + len(data) >= total or len(data) < want
            sound = None
            if last:
                sound = False if start + len(data) < total or not stream.sound() else _agrees(told.strip(), check.digest()) if check is not None else None
            yield base | {"chunk_no": number, "start": start, "length": len(data), "digest": sha.hexdigest(), "intact": sound, "payload": data}
            start, number = start + len(data), number + 1
            if last:
                break
        if stream.cut and stream.members.size:
            stream.resume()


def _reader(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, path = _open(file)
                with store.open_input_stream(path, compression=None) as raw:
                    held, size = [], 0
                    for row in records(_Stream(raw), chunk):
                        held.append(row | {"file": file})
                        size += row["length"] + 256
                        if size >= _BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema=_CHUNKS)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=_CHUNKS)

    return run


def read(files: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """The chunks of all records of the files named in column ``file``; a task reads a file."""
    many = max(1, files.count())
    return files.select("file").repartition(many, "file").mapInArrow(_reader(chunk), CHUNKS_DDL)


def chunked(pages: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """``pages`` written as WARC files in the shared folder and read as chunks."""
    return read(write(pages, f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"), chunk)


def report(pages: DataFrame) -> DataFrame:
    """All chunks, with what doesn't depend on where the files lie."""
    return chunked(pages).select("record_id", "page_id", "url", "chunk_no", "start", "length", "total", "digest", "intact", F.replace(F.base64("payload"), F.lit("\r\n"), F.lit("")).alias("payload"))


SQL = f"""
WITH p AS (SELECT page_id, url, hex(encode(coalesce(html, ''))) AS h, sha1(unhex('{uuid.NAMESPACE_URL.hex}') || encode(coalesce(page_id::VARCHAR, 'None') || ':' || sha256(coalesce(html, '')))) AS u FROM pages),
c AS (SELECT *, len(h) // 2 AS total, unnest(range(greatest(1, (len(h) // 2 + {CHUNK_BYTES} - 1) // {CHUNK_BYTES}))) AS k FROM p)
SELECT '<urn:uuid:' || u[1:8] || '-' || u[9:12] || '-5' || u[14:16] || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', u[17]), 1) || u[18:20] || '-' || u[21:32] || '>' AS record_id,
  page_id, url, k::INTEGER AS chunk_no, k * {CHUNK_BYTES} AS start, least({CHUNK_BYTES}, total - k * {CHUNK_BYTES})::INTEGER AS length, total,
  sha256(unhex(substr(h, 1, (2 * least(total, (k + 1) * {CHUNK_BYTES}))::INTEGER))) AS digest,
  CASE WHEN (k + 1) * {CHUNK_BYTES} >= total THEN true END AS intact,
  base64(unhex(substr(h, (2 * k * {CHUNK_BYTES} + 1)::INTEGER, {2 * CHUNK_BYTES}))) AS payload
FROM c
"""
