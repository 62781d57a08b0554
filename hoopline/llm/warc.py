"""A content-addressed web archive: payloads once by digest, exact record headers apart, records by joins, and WARC files of them.

``write_archive`` makes two tables below a path: ``payloads`` (payload_digest, payload), one row for each distinct
payload, and ``headers`` (header, payload_digest), one WARC header block for each page, byte for byte. ``records`` joins them to whole records again;
``export_warc`` writes those as gzip WARC files of about ``FILE_BYTES``, ``read_warc`` reads such files, one at a time in a task, and ``read_records``
says what was read: every payload is digested again, and a record whose payload does not fit its header, or a revisit without its response, fails the read. Where records are not needed,
``read_archive`` reads the two tables alone.

Only responses hold a payload. Of pages with equal payloads of at least ``min_revisit`` bytes, that with the smallest page_id (null last, of repeated
rows exactly one) is a response and the others revisit it, so a payload that many responses share is shorter than that; such payloads are broadcast, at most 1,000 of them, and the
others are joined by a shuffle.

Null html is an empty payload, null url leaves its line out. Very long pages are records like others; an empty table makes an archive without records. CR and LF in a url are percent-encoded. Columns other than
page_id, url and html are not kept, whatever their names.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoopline.llm.common import read_table, saved, skewed_lookup
from hoopline.llm.exact_dedup import best_of_group, keep_one_copy, text_digest
from hoopline.session import scratch_path

MIN_REVISIT = 100
#: Bytes of a WARC file before it is packed, on average; and records that are handed on together.
FILE_BYTES, RECORDS_AT_A_TIME = 4 << 20, 100
DATE = "2000-01-01T00:00:00Z"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_archive(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, date: str = DATE) -> None:
    """``pages`` (page_id long, url, html) as an archive below ``path``; other columns are not kept."""
    pages = pages.select("page_id", "url", "html")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keep_one_copy(pages, "page_id", "html").select(text_digest(F.col("html")).alias("payload_digest"), payload.alias("payload")).write.option(
        "compression", "zstd"
    ).parquet(f"{path}/payloads")

    keyed = saved(
        pages.select(
            "page_id", "url", F.monotonically_increasing_id().alias("row_no"), F.octet_length(payload).cast("long").alias("n_bytes"), text_digest(F.col("html")).alias("payload_digest")
        ),
        "pages",
    )
    rank = F.struct(F.col("page_id").isNotNull().alias("known"), F.bitwise_not("page_id").alias("low"), "row_no")
    ranked = best_of_group(keyed, "payload_digest", rank)
    response = (F.col("n_bytes") < min_revisit) | (F.col("_best.row_no") == F.col("row_no"))
    name = lambda page_id: F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("unknown")), F.lit(">"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(response, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), name(F.bitwise_not(F.col("_best.low"))))),
        F.when(~response, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(response, F.col("n_bytes")).otherwise(0).cast("string")),
    ]
    header = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))
    ranked.select(header.alias("header"), "payload_digest").write.option("compression", "zstd").parquet(f"{path}/headers")


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    headers = spark.read.schema("header string, payload_digest string").parquet(f"{path}/headers")
    return headers, spark.read.schema("payload_digest string, payload binary").parquet(f"{path}/payloads")


def _field(name: str, pattern: str, end: str = "\\r\\n"):
    found = F.regexp_extract("header", f"\\r\\n{name}: {pattern}{end}", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: what its header says, and bytes and digest of its full payload as stored.

    Every payload is digested again; one that does not fit its name, or is missing, fails the read.
    """
    headers, payloads = _tables(spark, path)
    own = F.sha2("payload", 256)
    checked = saved(
        payloads.select(
            F.when(own == F.col("payload_digest"), own).otherwise(F.raise_error(F.concat(F.lit("payload does not fit its digest: "), F.col("payload_digest")))).alias("payload_digest"),
            F.octet_length("payload").cast("long").alias("payload_bytes"),
        ),
        "checked_payloads",
    )
    joined = skewed_lookup(headers, checked, "payload_digest")
    return joined.select(
        _field("WARC-Record-ID", "<urn:page:(-?[0-9]+)>").cast("long").alias("page_id"),
        _field("WARC-Target-URI", "([^\\r]*)").alias("url"),
        F.coalesce("payload_bytes", F.raise_error(F.lit("a payload is missing"))).alias("payload_bytes"),
        "payload_digest",
        _field("WARC-Type", "([a-z]+)").alias("record_type"),
        _field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
    )


def _is_response():
    return F.col("header").contains(f"{CRLF}WARC-Type: response{CRLF}")


def records(spark: SparkSession, path: str) -> DataFrame:
    """``header`` and ``payload`` of every record as archived; a revisit has no payload of its own."""
    headers, payloads = _tables(spark, path)
    responses = skewed_lookup(headers.filter(_is_response()), payloads, "payload_digest")
    missing = F.raise_error(F.concat(F.lit("a payload is missing: "), F.col("payload_digest")))
    whole = responses.select("header", F.coalesce("payload", missing.cast("binary")).alias("payload"))
    return whole.unionByName(headers.filter(~_is_response()).select("header", F.lit(b"").alias("payload")))


def export_warc(spark: SparkSession, path: str, target: str, file_bytes: int = FILE_BYTES) -> None:
    """The archive as gzip WARC files, each of about ``file_bytes`` before it is packed; a record ends with two line ends."""
    headers, _ = _tables(spark, path)
    mean = headers.agg(F.avg(F.length("header") + _field("Content-Length", "([0-9]+)", "\\r\\n").cast("long"))).first()[0] or 1
    whole = records(spark, path).select(F.concat("header", F.decode("payload", "UTF-8")).alias("value"))
    whole.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", max(1, int(file_bytes / mean))).text(target)


def _parsed(content: bytes) -> Iterator[tuple[str, bytes]]:
    """Header and payload of the records in a file, by their content lengths."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at) + 4
        header = content[at:end].decode()
        length = int(next(line for line in header.split(CRLF) if line.startswith("Content-Length: "))[16:])
        if content[end + length : end + length + 4] != b"\r\n\r\n":
            raise ValueError(f"A record does not end where its header says: {header}")
        yield header, content[end : end + length]
        at = end + length + 4


def read_warc(spark: SparkSession, target: str) -> DataFrame:
    """``header`` and ``payload`` of the records in WARC files, packed or not; a file is read by one task, some records at a time."""

    def parse(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                data = bytes(content)
                found = _parsed(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
                while some := list(islice(found, RECORDS_AT_A_TIME)):
                    yield pd.DataFrame({"header": [h for h, _ in some], "payload": [p for _, p in some]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(target).select("content")
    return files.mapInPandas(parse, "header string, payload binary")


def read_records(spark: SparkSession, target: str) -> DataFrame:
    """One row per record of the WARC files: what its header says, and bytes and digest of its full payload, those of revisits from the response that was read."""
    digest = F.sha2("payload", 256)
    told = _field("WARC-Payload-Digest", "sha256:([0-9a-f]+)")
    read = read_warc(spark, target).select(
        _field("WARC-Record-ID", "<urn:page:(-?[0-9]+)>").cast("long").alias("page_id"),
        _field("WARC-Target-URI", "([^\\r]*)").alias("url"),
        _field("WARC-Type", "([a-z]+)").alias("record_type"),
        _field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        F.when(~_is_response() | (told == digest), told).otherwise(F.raise_error(F.concat(F.lit("payload does not fit its record: "), "header"))).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("own_bytes"),
    )
    read = saved(read, "read_records")
    responses = read.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("own_bytes").alias("payload_bytes"))
    revisits = skewed_lookup(read.filter("record_type = 'revisit'"), saved(responses, "responses"), "payload_digest")
    found = F.coalesce("payload_bytes", F.raise_error(F.concat(F.lit("the response of a revisit is missing: "), F.col("payload_digest"))))
    both = read.filter("record_type = 'response'").withColumn("payload_bytes", F.col("own_bytes")).unionByName(revisits.withColumn("payload_bytes", found))
    return both.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """The whole ``pages`` table written as an archive, its records put together and written as WARC files, and these read back."""
    path, target = scratch_path(spark, "archive"), scratch_path(spark, "warc")
    write_archive(read_table(spark, sf_dir, "pages"), path)
    export_warc(spark, path, target)
    return read_records(spark, target).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
