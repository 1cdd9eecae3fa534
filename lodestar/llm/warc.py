"""Content-addressed web archive (operator 1).

An archive is two tables in one folder. `payloads` holds each distinct payload once under its SHA-256; `headers`
holds the exact header block of every record (WARC headers, and the HTTP head for responses) with the digest of
the payload it stands for. Original records are rebuilt by joining the two on the digest.

Of the records with equal payloads of at least `min_revisit_bytes`, the one with the largest (page_id, url) is a
`response`; the others are `revisit` records that name it. Smaller payloads are all responses.

Defined cases: a null html is an empty payload; a null page_id is kept (and sorts below all others) and comes
back null; a null url becomes an empty target; line ends in a url are percent-encoded, as they would end the
header; of fully repeated rows one is the response and the rest revisit it; an empty table gives an empty archive;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.shared import discard, materialize

CRLF = "\r\n"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits are 4 groups of 40 bits, and conv() writes base 32 with digits 0-9A-V."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _lines(*pairs: tuple[str, Column | str]) -> Column:
    """Header lines; a null value leaves its line out."""
    parts = [F.coalesce(F.concat(F.lit(f"{k}: "), F.lit(v) if isinstance(v, str) else v.cast("string"), F.lit(CRLF)), F.lit("")) for k, v in pairs]
    return F.concat(*parts)


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one WARC record per row of pages(page_id, url, html) into the archive at path."""
    keyed = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    # Only keys are shuffled here; fully repeated rows are counted before the shuffle.
    heads = keyed.groupBy("digest", "page_id", "url", F.length("payload").alias("n_bytes"), base32_sha1(F.col("payload")).alias("sha1")).agg(F.count("*").alias("copies"))
    # Both are written before they are joined, so that Spark can split the rows of a digest that many records share.
    heads = materialize(heads, "heads")
    kept = materialize(heads.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first")), "first")
    records = (
        heads.join(kept, "digest")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .withColumn("is_first", F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url")) & (F.col("copy") == 1))
        .withColumn("revisit", ~F.col("is_first") & (F.col("n_bytes") >= min_revisit_bytes))
    )
    target = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF * 2))
    common = (
        ("WARC-Target-URI", target),
        ("WARC-Date", date),
        ("WARC-Record-ID", _uuid(F.hex("digest"), F.col("page_id"), F.col("url"), F.col("copy"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        ("WARC-Page-ID", F.col("page_id")),
    )
    response = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: response{CRLF}"),
        _lines(*common, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", F.length(http) + F.col("n_bytes"))),
        F.lit(CRLF),
        http,
    )
    revisit = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: revisit{CRLF}"),
        _lines(
            *common,
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _uuid(F.hex("digest"), F.col("first.page_id"), F.col("first.url"), F.lit(1))),
            ("WARC-Refers-To-Page-ID", F.col("first.page_id")),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", "0"),
        ),
        F.lit(CRLF),
    )
    records.select("digest", F.when(F.col("revisit"), revisit).otherwise(response).alias("header")).write.parquet(f"{path}/headers")
    # The payload of one record for each digest: whoever holds the hot digest, only one of its rows is left. Rows are joined by one
    # key, so that dropping fully repeated ones needs no further shuffle of payloads.
    row_key = lambda page, url: F.md5(F.to_json(F.struct(F.hex("digest").alias("d"), F.col(page).alias("p"), F.col(url).alias("u"))))
    keys = kept.select(row_key("first.page_id", "first.url").alias("row"))
    stored = keyed.select("digest", "payload", row_key("page_id", "url").alias("row")).join(keys, "row", "left_semi").dropDuplicates(["row"])
    stored.select("digest", "payload").write.parquet(f"{path}/payloads")
    discard(heads, kept)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads, each checked against the digest it is stored under."""
    stored = spark.read.schema("digest binary, payload binary").parquet(f"{path}/payloads")
    true = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    return stored.select("digest", F.when(true, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.hex("digest")))).alias("payload"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The stored header blocks with the fields that are read from them."""
    field = lambda name, of: F.nullif(F.regexp_extract("header", rf"\r\n{name}: ({of})\r\n", 1), F.lit(""))
    return spark.read.schema("digest binary, header string").parquet(f"{path}/headers").select(
        "digest",
        "header",
        field("WARC-Type", r"\w+").alias("record_type"),
        field("WARC-Payload-Digest", r"sha1:\w+").alias("said_digest"),
        field("WARC-Page-ID", r"-?\d+").cast("long").alias("page_id"),
        field("WARC-Refers-To-Page-ID", r"-?\d+").cast("long").alias("refers_to"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every original record: its fields, header, payload, and the exact bytes that a WARC file has of it."""
    joined = read_headers(spark, path).join(read_payloads(spark, path), "digest")
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.withColumn("record", F.concat(F.encode("header", "UTF-8"), body, F.lit((CRLF * 2).encode())))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, its payload measured and hashed in the store before the join, so no payload is moved."""
    sizes = read_payloads(spark, path).select("digest", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    said = F.concat(F.lit("sha1:"), F.col("payload_digest")) == F.col("said_digest")
    checked = F.when(said, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header's digest differs from its payload's")))
    return read_headers(spark, path).join(sizes, "digest").select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")
