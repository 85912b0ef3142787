"""Archives: exact round trips, record types against brute force, chunking."""
import base64
import gzip
import hashlib
from collections import defaultdict

from incipit.llm import warc
from incipit.scale import shared_path

ROWS = [
    (1, "http://a/1", "same"), (2, "http://a/ü b", "same"), (3, None, "same"), (3, "http://a/3", "same"), (4, "x\r\ny", ""), (5, "http://a/5", None),
    (6, "http://a/6", "WARC/1.1\r\n\r\n\r\n\r\nx" * 3000), (7, "u", "é" * 250_000), (None, "n", "same"), (None, "n", "only null"), (None, "m", "only null"), (8, "h", "last"),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")


def want(rows, least=0):
    groups = defaultdict(list)
    for p, _, h in rows:
        groups[h or ""].append(p)
    out = []
    for p, u, h in rows:
        ids = [x for x in groups[h or ""] if x is not None]
        again = len((h or "").encode()) >= least and ids and p != max(ids)
        out.append((p, u, "revisit" if again else "response", max(ids) if again else None, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()))
    return sorted(out, key=str)


def test_round_trip(spark):
    for least in (0, 3):
        rows = warc.archive_pages(table(spark), least, chunk_bytes=1000, with_data=True).collect()
        assert sorted((tuple(r[c] for c in warc.HEADERS) for r in rows if r.is_last), key=str) == want(ROWS, least)
    whole = defaultdict(bytes)
    for r in sorted(rows, key=lambda r: r.chunk_no):
        assert len(r.data) == r.chunk_bytes <= 1000
        if r.page_id in (6, 7, 8):
            whole[r.page_id] += r.data
            assert r.digest_so_far == base64.b32encode(hashlib.sha1(whole[r.page_id]).digest()).decode()
    assert all(whole[p].decode() == h for p, _, h in ROWS if p in (6, 7, 8))
    assert all(r.digest_so_far == r.payload_digest for r in rows if r.is_last and r.record_type == "response")


def test_files_are_plain_warc(spark):
    folder = shared_path(spark, "warc")
    manifest = warc.write_archives(warc.typed(table(spark)).coalesce(1), folder).collect()
    assert sum(m.records for m in manifest) == len(ROWS)
    data = gzip.open(manifest[0].file.removeprefix("file://")).read()
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n")


def test_empty(spark):
    assert warc.archive_pages(table(spark, [])).count() == 0
