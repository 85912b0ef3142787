"""WARC archives written and read by Spark tasks, and the chunked record table.

Writing: each task streams its records into one gzip-member-per-record file of the shared folder and reports the file's
name as a row; only reported files are read, so the leftovers of a lost or repeated task are never seen. Payloads pass to
the compressor in slices of the Arrow buffer. Reading: each file is one row of the manifest and is streamed; a record comes
out as rows (record, chunk number) of at most `chunk_bytes` payload bytes, each with the SHA-1 of the payload so far, so no
record is ever held whole.

Of records with equal payloads the one with the largest page_id is a response, the others are revisits that refer to it;
payloads below `min_revisit_bytes` are all responses. Equal payloads are found by length and SHA-1, computed by Spark
expressions; only payloads with two or more pages take part in a join, whose small side is broadcast only if a count proves
it small (beyond that pages shuffle by digest, and adaptive execution splits a digest with very many pages).

Edge cases: null html is an empty payload; rows that repeat the winning page_id with the same payload are all responses;
null page_id never wins over a number (if all are null, all are responses); null url has no target header and is read back
as null; an empty table gives no rows; extra columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incipit.scale import cut, shared_path, small

SLICE = 1 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
HEADERS = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest")


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of the text's UTF-8: 5 hex digits are 20 bits are 4 base32 letters."""
    digest = F.sha1(F.encode(text, "utf-8"))
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def typed(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """pages with html (never null), payload_bytes, payload_digest, record_type, refers_to."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), base32_sha1(html).alias("payload_digest"))
    shared = (
        pages.where(F.col("payload_bytes") >= min_revisit_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("winner"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    shared = small(cut(shared, "warc-shared"))
    revisit = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return pages.join(shared, ["payload_digest", "payload_bytes"], "left").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("winner")).alias("refers_to")
    )


def record_head(r: dict) -> bytes:
    """WARC and HTTP headers of a record; the payload follows in responses."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_bytes']}\r\n\r\n".encode()
    response = r["record_type"] == "response"
    lines = ["WARC/1.1", f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: <urn:page:{r['page_id']}>", f"WARC-Date: {DATE}"]
    if r["url"] is not None:
        lines.append("WARC-Target-URI: " + quote(r["url"], safe="!#$&'()*+,/:;=?@[]~"))
    lines.append(f"WARC-Payload-Digest: sha1:{r['payload_digest']}")
    if not response:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{r['refers_to']}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + r['payload_bytes'] * response}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(records: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write records (see typed()) below folder; returns the manifest: file, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        name, out, n = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            html = batch.column(batch.schema.get_field_index("html"))
            heads = batch.drop_columns(["html"]).to_pylist()
            if heads and out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            for head, payload in zip(heads, html, strict=True):
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(z.compress(record_head(head)))
                if head["record_type"] == "response":
                    view = memoryview(payload.as_buffer())
                    for at in range(0, len(view), SLICE):
                        out.write(z.compress(view[at : at + SLICE]))
                out.write(z.compress(b"\r\n\r\n") + z.flush())
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], ["file", "records"])

    return cut(records.select("html", *HEADERS).mapInArrow(run, "file string, records long"), "warc-manifest")


class _Unzipped:
    """A stream of gzip members as one stream of bytes, read by the piece."""

    def __init__(self, raw):
        self.raw, self.z, self.rest, self.have = raw, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        while True:
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
            data = self.rest or self.raw.read(1 << 16)  # what is left after a member is copied: keep it short
            if not data:
                return False
            got = self.z.decompress(data, SLICE)
            self.rest = self.z.unconsumed_tail
            if got:
                self.have += got
                return True

    def line_block(self) -> bytes:
        """Up to and with the next empty line; b"" at the end."""
        while (at := self.have.find(b"\r\n\r\n")) < 0:
            if not self.more():
                return b""
        block, self.have = self.have[: at + 4], self.have[at + 4 :]
        return block

    def bytes(self, n: int, piece: int) -> Iterator[bytes]:
        while n:
            while not self.have or len(self.have) < min(n, piece):
                if not self.more():
                    raise ValueError("the archive ends inside a record")
            part, self.have = self.have[: min(n, piece)], self.have[min(n, piece) :]
            n -= len(part)
            yield part


def _fields(block: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in block.decode().split("\r\n")[1:] if line)


def _page(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name and name != "None" else None


def read_chunks(manifest: DataFrame, chunk_bytes: int = SLICE, with_data: bool = True) -> DataFrame:
    """The chunked record table: HEADERS, chunk_no, chunk_bytes, digest_so_far, is_last and, on request, data.

    A record has at least one row; the last one's digest_so_far is the digest of the payload in the archive (null for
    revisits, whose payload is elsewhere).
    """
    names = [*HEADERS, "chunk_no", "chunk_bytes", "digest_so_far", "is_last"] + ["data"] * with_data
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()] + [pa.binary()] * with_data

    def rows(stream: _Unzipped) -> Iterator[tuple]:
        while block := stream.line_block():
            warc, http = _fields(block), stream.line_block()
            n = int(warc["Content-Length"]) - len(http)
            url = warc.get("WARC-Target-URI")
            head = (_page(warc["WARC-Record-ID"]), None if url is None else unquote(url), warc["WARC-Type"], _page(warc.get("WARC-Refers-To")), int(_fields(http)["Content-Length"]), warc["WARC-Payload-Digest"].removeprefix("sha1:"))
            sha, left = hashlib.sha1(), n
            if not n:
                yield (*head, 0, 0, None if warc["WARC-Type"] == "revisit" else base64.b32encode(sha.digest()).decode(), True, b"")
            for k, part in enumerate(stream.bytes(n, chunk_bytes)):
                sha.update(part)
                left -= len(part)
                yield (*head, k, len(part), base64.b32encode(sha.digest()).decode(), not left, part)
            if stream.line_block() != b"\r\n\r\n":
                raise ValueError("no record end where the header says")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(file)
                held, size = [], 0
                with store.open_input_stream(path, compression=None) as raw:
                    for row in rows(_Unzipped(raw)):
                        held.append(row)
                        size += len(row[-1]) * with_data + 200
                        if size > 4 * SLICE:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(kinds)], names)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(kinds)], names)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk_no long, chunk_bytes long, digest_so_far string, is_last boolean" + ", data binary" * with_data
    # A row a file: spread the files over as many tasks as there are files, at most the session's shuffle partitions.
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file").repartition(parts, "file").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 0, chunk_bytes: int = SLICE, with_data: bool = False) -> DataFrame:
    """Write pages to archives in the shared folder and return the chunked record table read back from them."""
    folder = shared_path(pages.sparkSession, "warc")
    return read_chunks(write_archives(typed(pages, min_revisit_bytes), folder), chunk_bytes, with_data)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """One row a record: its last chunk. The digest is that of the bytes read; a revisit's is the one it names."""
    chunks = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return chunks.where("is_last").select("page_id", "payload_bytes", F.coalesce("digest_so_far", "payload_digest").alias("payload_digest"), "record_type", "refers_to")


def oracle() -> str:
    letter = lambda k, s: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {5 * k + 1}, 5))::bigint >> {s}) & 31) + 1)::bigint, 1)"
    b32 = " || ".join(letter(k, s) for k in range(8) for s in (15, 10, 5, 0))
    return f"""
    with p as (select page_id, coalesce(html, '') as html from pages),
    d as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as h from p),
    w as (select *, max(page_id) over (partition by h, payload_bytes) as winner from d)
    select page_id, payload_bytes, {b32} as payload_digest,
      case when winner is not null and page_id is distinct from winner then 'revisit' else 'response' end as record_type,
      case when winner is not null and page_id is distinct from winner then winner end as refers_to from w"""
