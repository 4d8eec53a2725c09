"""WARC archives with an index first: write, index, then range-read what is selected.

Writing puts one gzip member per record into archives in the shared folder and
returns a row per record: file, offset, length, URL and digest.  Reading starts
from rows of that index: they are sorted by file and offset, neighbouring ranges are
coalesced into one read each, and every record is unpacked and its digest verified.

File names carry a random part for each task attempt and the index is committed by
Spark, so a task that is lost or repeated leaves at most a file that no index row names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from .common import Stash, column, shared_dir, stash

#: Begin a new archive beyond this many bytes.
ROLL = 512 << 20
#: Coalesce ranges with a gap of at most GAP bytes into reads of at most READ bytes.
GAP, READ = 64 << 10, 8 << 20
#: Index rows are dealt to readers by stretches of this many bytes of a file.
STRETCH = 32 << 20
#: Rows up to which the table of revisits is broadcast.
SMALL = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, record_id string"


class WarcError(ValueError):
    """An archive that does not hold what its index says."""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def uri_of(page: object) -> str:
    """A record's name for an id of any type; characters that a header can't hold are percent-encoded."""
    return "urn:page:" + quote(str(page), safe="") if page is not None else "urn:nopage"


def page_of(uri: str) -> str | None:
    """The id, as text, that :func:`uri_of` named."""
    return unquote(uri.removeprefix("urn:page:")) if uri.startswith("urn:page:") else None


def record(record_id: object, url: str | None, payload: bytes, refers_to: object, date: str = "1970-01-01T00:00:00Z") -> tuple[bytes, str]:
    """(a WARC/1.1 record, its payload digest): a response, or a revisit if ``refers_to`` is given."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{uri_of(record_id)}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{uri_of(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(record headers, HTTP headers, body) of one unpacked record; names in lower case."""

    def fields(lines: list[bytes]) -> dict[str, str]:
        return {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}

    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        raise WarcError("no WARC record")
    own = fields(lines[1:])
    block = rest[: int(own["content-length"])]
    if len(block) < int(own["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise WarcError("record cut short")
    http, _, body = block.partition(b"\r\n\r\n")
    return own, fields(http.split(b"\r\n")[1:]), body


def assign(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """(id, sha, refers_to): the rows that revisit an equal payload of a smaller id.

    Payloads are compared by SHA-1 and length.  Only digests are shuffled; counting combines
    before the shuffle, and the join on a hot digest can be split.
    """
    slim = pages.select(F.col(id_col).alias("id"), F.sha1(payload_col).alias("sha"), F.octet_length(payload_col).alias("n")).filter(F.col("n") >= least_bytes)
    least = slim.groupBy("sha", "n").agg(F.min("id").alias("refers_to"), F.count("*").alias("c")).filter("c > 1").drop("c")
    return slim.join(least, ["sha", "n"]).filter(F.col("refers_to").isNotNull() & ~F.col("id").eqNullSafe(F.col("refers_to"))).select("id", "sha", "refers_to").distinct()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes an archive record per row below ``folder`` and returns their index.

    A null payload is an empty one.  Of records with equal payloads of at least
    ``least_bytes``, that with the smallest id is the response; the others revisit it.  Rows
    equal in id and payload are the same kind of record.  A null id stays null in the index,
    and revisits if any equal payload has an id.  Ids may be of any type that has a text.  An empty table writes nothing.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    again = Stash(assign(rows, "id", "payload", least_bytes), "warc-again").df
    small = F.broadcast(again) if again.count() <= SMALL else again
    again = small.withColumnsRenamed({"id": "id_", "sha": "sha_"})
    typed = rows.join(again, F.col("id").eqNullSafe(F.col("id_")) & (F.sha1("payload") == F.col("sha_")), "left").select("id", "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pa.fs.FileSystem.from_uri(folder)
        out, path, at = None, "", 0
        try:
            for b in batches:
                rows = []
                for page, url, payload, refers in zip(*(column(b, c) for c in ("id", "url", "payload", "refers_to")), strict=True):
                    if out is None or at >= ROLL:
                        if out is not None:
                            out.close()
                        path, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                        system.create_dir(base, recursive=True)
                        out = system.open_output_stream(path, compression=None)
                    key = str(page.as_py()) if page.is_valid else None
                    plain, digest = record(key, url.as_py(), payload.as_py(), refers.as_py())
                    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                    coded = pack.compress(plain) + pack.flush()
                    out.write(coded)
                    rows.append((path, at, len(coded), url.as_py(), digest, key))
                    at += len(coded)
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return stash(typed.mapInArrow(run, INDEX), "warc-index")


def ranges(wanted: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, members) of coalesced reads over sorted (offset, length) ranges."""
    start = end = -1
    members: list[int] = []
    for i, (at, n) in enumerate(wanted):
        if members and (at - end > GAP or at + n - start > READ):
            yield start, end, members
            members = []
        if not members:
            start = end = at
        end = max(end, at + n)
        members.append(i)
    if members:
        yield start, end, members


def read(index: DataFrame, folder: str) -> DataFrame:
    """(record_id, url, record_type, refers_to, payload_bytes, digest, payload): the index's records, read back.

    A revisit has the size and digest of the payload that it stands for, and a null
    payload.  A record that differs from its index row raises :class:`WarcError`.
    """
    names = ["record_id", "url", "record_type", "refers_to", "payload_bytes", "digest", "payload"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = pa.fs.FileSystem.from_uri(folder)
        path, file = None, None
        for b in batches:
            files, offsets, lengths, digests = (column(b, c).to_pylist() for c in ("file", "offset", "length", "digest"))
            i = 0
            while i < len(files):
                j = next((k for k in range(i, len(files)) if files[k] != files[i]), len(files))
                if files[i] != path:
                    if file is not None:
                        file.close()
                    path, file = files[i], system.open_input_file(files[i])
                for start, end, members in ranges([(offsets[k], lengths[k]) for k in range(i, j)]):
                    file.seek(start)
                    data, rows = file.read(end - start), []
                    for k in members:
                        at = offsets[i + k] - start
                        own, http, body = parse(zlib.decompress(data[at : at + lengths[i + k]], 31))
                        said = own["warc-payload-digest"].removeprefix("sha1:")
                        fresh = own["warc-type"] == "response"
                        if said != digests[i + k] or fresh and base32_sha1(body) != said:
                            raise WarcError(f"digest of {own['warc-record-id']} differs")
                        bare = lambda x: page_of(x[1:-1])
                        rows.append((bare(own["warc-record-id"]), own.get("warc-target-uri"), own["warc-type"], None if fresh else bare(own["warc-refers-to"]), len(body) if fresh else int(http["content-length"]), base32_sha1(body) if fresh else said, body if fresh else None))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                i = j
        if file is not None:
            file.close()

    dealt = index.withColumn("stretch", F.floor(F.col("offset") / STRETCH)).repartition("file", "stretch").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "record_id string, url string, record_type string, refers_to string, payload_bytes long, digest string, payload binary")


def archive_folder(pages: DataFrame) -> str:
    """A new folder for archives, in the shared folder."""
    return f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"


#: The result of op8 in DuckDB's SQL, but for the base32 form of the digest, which is built digit by digit.
ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
s AS (
  SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS hex, b FROM p),
d AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
      (CAST('0x' || substr(hex || '0', 1 + (i * 5) // 4, 2) AS BIGINT) >> (3 - (i * 5) % 4)) & 31 AS INTEGER), 1)), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY b) AS least
  FROM s)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to
FROM d
"""
