"""The archive of the driver's pages against plain Python, and its records against a reader of their format that shares nothing with the writer."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter, defaultdict

from pyspark.sql import SparkSession

from lodestar.llm import queries, warc
from lodestar.llm.shared import new_path

SF = "/root/testdata/sf0.001"


def b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of rows (page_id, html) with distinct ids."""
    largest: dict[bytes, int] = {}
    data = [(i, (h or "").encode()) for i, h in rows]
    for i, d in data:
        largest[d] = max(i, largest.get(d, i))
    return [(i, len(d), b32(d), *(("response", None) if largest[d] == i else ("revisit", largest[d]))) for i, d in data]


def parse(record: bytes) -> tuple[str, dict[str, str], bytes]:
    """Version, fields and block of one record, by the framing of the standard: lines end with CRLF, Content-Length counts the block, two CRLF follow."""
    head, found, rest = record.partition(b"\r\n\r\n")
    assert found
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    assert len(fields) == len(lines)
    n = int(fields["Content-Length"])
    assert rest[n:] == b"\r\n\r\n"
    return version, fields, rest[:n]


def test_index_of_the_driver_table(spark: SparkSession) -> None:
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = queries.op1_warc_archive(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == sorted(expected(pages))


def test_records_read_by_the_standard(spark: SparkSession) -> None:
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    rows += [(9000 + k, f"http://x.example/{k}", h) for k, h in enumerate(["", None, "ü\r\n\r\nWARC/1.1", rows[0][2], rows[0][2], "", "\x00\x01"])]
    path = new_path(spark, "warc")
    warc.write_archive(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path)
    want = {r[0]: r for r in expected([(i, h) for i, _, h in rows])}
    records = [(parse(bytes(r["record"])), bytes(r["payload"])) for r in warc.read_records(spark, path).collect()]
    ids = {fields["WARC-Record-ID"]: fields for (_, fields, _), _ in records}
    assert len(records) == len(rows) == len(ids)
    of_url, kinds = {i: u for i, u, _ in rows}, Counter()
    for (version, fields, block), payload in records:
        page, n, sha, kind, refers = want[int(fields["WARC-Page-ID"])]
        assert version == "WARC/1.1" and fields["WARC-Type"] == kind and fields["WARC-Target-URI"] == of_url[page]
        assert fields["WARC-Payload-Digest"] == f"sha1:{sha}" == f"sha1:{b32(payload)}" and len(payload) == n
        if kind == "response":
            status, *lines = block[: len(block) - n].decode().split("\r\n")
            assert status == "HTTP/1.1 200 OK" and f"Content-Length: {n}" in lines and lines[-2:] == ["", ""] and block[len(block) - n :] == payload
        else:
            assert block == b"" and ids[fields["WARC-Refers-To"]]["WARC-Page-ID"] == str(refers) and ids[fields["WARC-Refers-To"]]["WARC-Type"] == "response"
        kinds[kind] += 1
    assert kinds["revisit"] >= 4
    stored = defaultdict(int)
    for r in spark.read.parquet(f"{path}/payloads").collect():
        stored[bytes(r["payload"])] += 1
    assert set(stored.values()) == {1} and len(stored) == len({(h or "").encode() for _, _, h in rows})
