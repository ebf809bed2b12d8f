"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response gives one metadata record (title, language, HTTP fields, links)
and one conversion record (its visible text, a block per line).  Both name the
response they were made from (refers-to id, address and date), carry its digest
and HTTP header lines, and name each other as concurrent.  Record ids are made
from the response's id and the kind, so reruns agree.

Only the reading of the markup runs in Python, per page; ids, digests, JSON and
the rendered record are built-in functions.  Nothing is shuffled.

Defined cases: null html is an empty payload with an empty conversion record; a
null url is an empty target; repeated pages give equal records; an empty table
gives none.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from casebook.llm.markup import read_page

CAPTURE_DATE = "2024-01-01T00:00:00Z"  # of tables that hold no date
LINKS = ArrayType(StructType([StructField("url", StringType()), StructField("text", StringType())]))
READ = StructType([
    StructField("title", StringType()), StructField("language", StringType()), StructField("links", LINKS), StructField("text", StringType()),
])
LINE = "\r\n"


@F.arrow_udf(READ)
def _read_udf(html: pa.Array) -> pa.Array:
    pages = [read_page(source or "") for source in html.to_pylist()]
    links = [[{"url": u, "text": t} for u, t in p.links] for p in pages]
    return pa.StructArray.from_arrays(
        [
            pa.array([p.title for p in pages], pa.string()), pa.array([p.language for p in pages], pa.string()),
            pa.array(links, pa.list_(pa.struct([("url", pa.string()), ("text", pa.string())]))),
            pa.array(["\n".join(p.lines) for p in pages], pa.string()),
        ],
        names=["title", "language", "links", "text"],
    )


def uuid_of(name: Column) -> Column:
    h = F.md5(name)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def digest_of(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, date: str = CAPTURE_DATE) -> DataFrame:
    """Response records of a table of pages."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    headers = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
        F.octet_length(html).cast("string"), F.lit(LINE + LINE),
    )
    return pages.select(
        F.col("page_id").alias("page_id"),
        uuid_of(F.concat_ws(" ", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url)).alias("record_id"),
        url.alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), html.alias("payload"),
        digest_of(html).alias("payload_digest"),
    )


def derive(records: DataFrame) -> DataFrame:
    """Two records per response: 'metadata' and 'conversion'."""
    read = records.withColumn("r", _read_udf.asNondeterministic()(F.col("payload")))
    ids = {kind: uuid_of(F.concat_ws(" ", F.lit(kind), F.col("record_id"))) for kind in ("metadata", "conversion")}
    facts = F.to_json(F.struct(
        F.col("target_uri").alias("uri"), F.col("date").alias("date"),
        F.element_at(F.split("http_headers", LINE), 1).alias("status"), F.col("payload_digest").alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_length"), F.col("r.title").alias("title"),
        F.col("r.language").alias("language"), F.size("r.links").cast("long").alias("n_links"), F.col("r.links").alias("links"),
    ))
    made = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/json").alias("content_type"),
                 ids["metadata"].alias("record_id"), ids["conversion"].alias("concurrent_to"), facts.alias("content")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain").alias("content_type"),
                 ids["conversion"].alias("record_id"), ids["metadata"].alias("concurrent_to"), F.col("r.text").alias("content")),
    )
    return read.select(
        "page_id", "target_uri", "date", "http_headers", "payload_digest", F.col("record_id").alias("refers_to"),
        F.explode(made).alias("m"),
    ).select(
        "page_id", "m.warc_type", "m.record_id", "refers_to", "m.concurrent_to", "target_uri", "date",
        F.col("http_headers").alias("source_headers"), F.col("payload_digest").alias("source_digest"), "m.content_type",
        digest_of(F.col("m.content")).alias("block_digest"), F.octet_length("m.content").cast("long").alias("content_length"), "m.content",
    )


def rendered(derived: DataFrame) -> DataFrame:
    """The records as WARC/1.1 text, one column `record`; write with format text, lineSep '' and gzip."""
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(LINE))
    return derived.select(F.concat(
        F.lit(f"WARC/1.1{LINE}"), field("WARC-Type", F.col("warc_type")), field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Date", F.col("date")), field("WARC-Target-URI", F.col("target_uri")),
        field("WARC-Refers-To", F.col("refers_to")), field("WARC-Refers-To-Target-URI", F.col("target_uri")),
        field("WARC-Refers-To-Date", F.col("date")), field("WARC-Concurrent-To", F.col("concurrent_to")),
        field("WARC-Source-Payload-Digest", F.col("source_digest")), field("WARC-Block-Digest", F.col("block_digest")),
        field("Content-Type", F.col("content_type")), field("Content-Length", F.col("content_length").cast("string")),
        F.lit(LINE), F.col("content"), F.lit(LINE + LINE),
    ).alias("record"))
