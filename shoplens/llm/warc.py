"""WARC archives: writing captures as linked records, and assembling the records into one row per capture."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoplens.llm.common import shared_folder, ship, with_defaults

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD = "id string, type string, concurrent_to string, uri string, refers_to string, headers map<string,string>, head int, block binary"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of binary ``data``."""
    letters = F.lit(_BASE32)

    def spell(digest: Column) -> Column:
        groups = []
        for i in range(8):  # five hex digits are four letters
            part = F.conv(F.substring(digest, i * 5 + 1, 5), 16, 10).cast("int")
            groups += [F.substring(letters, F.shiftright(part, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
        return F.concat(*groups)

    return F.element_at(F.transform(F.array(F.sha1(data)), spell), 1)  # hashed once


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", *parts))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-"), cut(13, 4), F.lit("-"), cut(17, 4), F.lit("-"), cut(21, 12), F.lit(">"))


def _record(fields: list[tuple[str, Column | None]], block: Column) -> Column:
    """A record without the two line ends that close it; fields that are null are left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))) for k, v in fields if v is not None]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.lit("WARC/1.1\r\n"), F.concat_ws("", *lines), size, block)


def write(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 6_000) -> None:
    """Write a request, a response or revisit and a metadata record for each row of ``page_id, url, html``.

    The payload is the html in UTF-8 (null: empty). Of captures with equal payloads of at least ``least_bytes`` bytes, that with the
    smallest page_id is a response with the whole payload, the others are revisits that name it and hold no payload. Rows with
    the same page_id are numbered and written one by one; if they are the first of their payload, the first number is the response. Null ids
    come last. Files are gzip-compressed text parts written by Spark, so lost tasks are redone, and any file
    system that Spark writes to will do; a part holds ``records_per_file`` records at most. White space in urls is escaped.
    """
    pages = with_defaults(pages, page_id="long", url="string", html="string")
    pages = pages.withColumn("html", F.coalesce("html", F.lit("")))
    pages = pages.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    # Rows that share an id are numbered; a row without one is known by its contents.
    pages = pages.withColumn("key", F.coalesce(F.col("page_id").cast("string"), F.concat_ws("/", F.lit("none"), "digest", "url")))
    number = F.row_number().over(Window.partitionBy("key").orderBy("digest", "url"))
    name = F.struct(F.coalesce("page_id", F.lit(2**63 - 1)).alias("page"), "key", "copy")
    slim = pages.select("key", "page_id", "digest", "url", "bytes").withColumn("copy", number)
    slim = slim.where(F.col("bytes") >= least_bytes).select("digest", name.alias("name"))
    firsts = slim.groupBy("digest").agg(F.min("name").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = slim.join(firsts, "digest").where("first != name").groupBy("name.key").agg(
        F.map_from_entries(F.collect_list(F.struct("name.copy", "first"))).alias("firsts")
    )
    # The payloads move once, to where their ids are.
    pages = pages.withColumn("copy", number).join(again, "key", "left")
    pages = pages.withColumn("name", name).withColumn("first", F.col("firsts")[F.col("copy")])
    revisit = F.col("first").isNotNull()

    def ident(what: str, of: str) -> Column:
        return _urn(F.lit(what), F.col(f"{of}.key"), F.col(f"{of}.copy").cast("string"))

    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20]", "%20"), F.lit(""))
    common = [("WARC-Target-URI", uri), ("WARC-Date", F.lit(date))]
    main = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", ident("capture", "name")), *common,
            ("Content-Type", F.lit("application/http; msgtype=response")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            ("WARC-Profile", F.when(revisit, _PROFILE)), ("WARC-Refers-To", F.when(revisit, ident("capture", "first"))),
        ],
        F.concat(F.lit(_HEAD), F.when(revisit, "").otherwise(F.col("html"))),
    )
    other = lambda kind, mime, block: _record(
        [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", ident(kind, "name")), *common, ("WARC-Concurrent-To", ident("capture", "name")), ("Content-Type", F.lit(mime))], block
    )
    request = other("request", "application/http; msgtype=request", F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\n\r\n")))
    about = F.concat_ws(
        "\r\n", F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string")),
        F.when(revisit & (F.col("first.page") != 2**63 - 1), F.concat(F.lit("refers-to-page: "), F.col("first.page").cast("string"))), F.lit(""),
    )
    records = pages.select(F.explode(F.array(request, main, other("metadata", "application/warc-fields", about))).alias("value"))
    (
        records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)
    )


def parse(data: bytes) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """(type, headers with lower-case names, block) of the records of an uncompressed archive."""
    at = 0
    while True:
        at = data.find(b"WARC/", at)
        if at < 0:
            return
        end = data.index(b"\r\n\r\n", at)
        headers = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            headers[key.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        yield headers.get("warc-type", ""), headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives under ``path``: ``id, type, concurrent_to, uri, refers_to, headers, head, block``; ``head`` is the length of the HTTP head. A file is one task's unit."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        from shoplens.llm.warc import parse

        names = ["id", "type", "concurrent_to", "uri", "refers_to", "headers", "head", "block"]
        kinds = [pa.string()] * 5 + [pa.map_(pa.string(), pa.string()), pa.int32(), pa.binary()]

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows, held = [], 0
                for kind, headers, block in parse(data):
                    rows.append((headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), headers.get("warc-refers-to"), list(headers.items()), block.find(b"\r\n\r\n") + 4, block))
                    held += len(block)
                    if held > 1 << 22:
                        yield flush(rows)
                        rows, held = [], 0
                if rows:
                    yield flush(rows)

    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``id, uri, record_type, refers_to, payload, payload_digest, request, metadata, response``.

    Requests and metadata are joined to the response or revisit that their ``WARC-Concurrent-To`` names; all three sides are
    keyed by that one identifier, which no two captures share, so there are no hot keys. A capture without one of the others has null there; a
    request or metadata record whose capture is missing gives no row. Repeated records of a kind for one capture give a row for each.
    ``payload`` is what follows the HTTP head (null for a revisit), and ``payload_digest`` is computed from it, or taken from the header of a revisit.
    """
    part = F.struct("id", "headers", "block")
    side = lambda kind: records.where(F.col("type") == kind).select(F.col("concurrent_to").alias("key"), part.alias(kind))
    main = records.where(F.col("type").isin("response", "revisit")).withColumn("key", F.col("id"))
    payload = F.when(F.col("type") == "response", F.substring("block", F.when(F.col("head") > 3, F.col("head") + 1).otherwise(F.lit(1)), F.octet_length("block")))
    main = main.select(
        "key", "uri", F.col("type").alias("record_type"), "refers_to", payload.alias("payload"),
        F.when(F.col("type") == "response", base32_sha1(payload)).otherwise(F.regexp_replace(F.col("headers")["warc-payload-digest"], "^sha1:", "")).alias("payload_digest"),
        F.struct("id", "headers").alias("response"),
    )
    return main.join(side("request"), "key", "left").join(side("metadata"), "key", "left").withColumnRenamed("key", "id")


def captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and assemble them. No rows give no captures."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/shoplens-{uuid.uuid4().hex}/warc"
    write(pages, path, least_bytes)
    return assemble(read(spark, path))


def op7_warc(spark, sf_dir: str) -> DataFrame:
    found = captures(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    about = F.expr("str_to_map(cast(metadata.block as string), '\r\n', ': ')")
    long = lambda key: F.col("about")[key].cast("long")
    found = found.withColumn("about", about)
    return found.select(
        long("page-id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), long("payload-bytes")).alias("payload_bytes"),
        "payload_digest", "record_type", long("refers-to-page").alias("refers_to"), "uri",
    )


OP7_SQL = """
WITH payloads AS (
  SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
         row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id) AS place,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))) & 31)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN first END AS refers_to, coalesce(url, '') AS uri
FROM payloads
"""
