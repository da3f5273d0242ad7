"""WARC archives of page captures, and the assembly of their transactions.

Writing: every page gives a request, a response (or a revisit, where another page of equal payload is the response) and a
metadata record; request and metadata name the response in ``WARC-Concurrent-To``.  Archives are gzip-compressed text files whose
rows are records and whose line separator is the record's end.

Reading: records are rows of a text scan whose separator is the first line of a record (no part of it repeats at a block's end), so files of any size stream
through a task.  Payloads that hold that very byte sequence are written in base64, so the cut is exact.  Blocks are taken by their
Content-Length.

Assembly: request and metadata records join the response by their concurrent-to identifiers, one nested row per capture.

Null html is an empty payload; a null url leaves out the target, line breaks in a url become spaces, and in a url that holds the
separator one letter of it is percent-encoded.  A revisit refers to the record id of its response.  Rows with a null page id are
captures like others, but refer to and are referred to by none with an id unless theirs is the only kind.  Repeated rows are
captures of their own (record ids hold a row number); the rows of the largest page id are all responses.  Empty tables give
archives without records.  Extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qacorpus.session import new_path

from .base import query, staged, table

VERSION, EOL = "WARC/1.1", "\r\n"
END = EOL + EOL
#: Payloads of fewer bytes are always stored.
REVISIT_BYTES = 1_000
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK" + EOL + "Content-Type: text/html; charset=utf-8"


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """Header lines of the fields that aren't null, an empty line and the block; the writer adds the record's end."""
    lines = [F.lit(VERSION), *[F.concat(F.lit(f"{name}: "), value) for name, value in fields]]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(EOL, *lines, length), F.lit(END), block)


def captures(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, row`` with digest, size, and page and row of the response that a revisit refers to.

    ``row`` is the row's place in the scan, which is the same whenever the same files are read.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.octet_length(payload).cast("long").alias("size"), F.sha1(F.encode(payload, "UTF-8")).alias("digest"),
                        F.monotonically_increasing_id().alias("row"))
    # counts are combined before the shuffle; only payloads that occur again are joined
    best = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("original")
    same = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.count("*").alias("n"), best)
    again = staged(same.where("n > 1 and original is not null").drop("n"), "payloads")
    revisit = F.col("original").isNotNull() & ~F.col("original.page_id").eqNullSafe(F.col("page_id"))
    return rows.join(again, ["digest", "size"], "left").withColumn("original", F.when(revisit, F.col("original")))


def write_archives(pages: DataFrame, path: str) -> None:
    """Three records per page (``page_id, url, html``) as gzip-compressed WARC files."""
    c = captures(pages)
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))

    def name(kind: str, of: Column = page, row: str = "row") -> Column:
        return F.format_string(f"<urn:capture:{kind}:%s:%s>", of, F.col(row).cast("string"))

    uri = F.replace(F.regexp_replace("url", r"[\r\n]+", " "), F.lit(VERSION), F.lit("%57ARC/1.1"))
    coded = F.contains(F.col("html"), F.lit(VERSION))
    body = F.when(coded, F.base64(F.encode("html", "UTF-8"))).otherwise(F.col("html"))
    head = F.when(coded, F.lit(HTTP + EOL + "Content-Transfer-Encoding: base64" + END)).otherwise(F.lit(HTTP + END))
    first = F.when(F.col("original").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    main = _record(
        [("WARC-Type", first), ("WARC-Record-ID", name("main")), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest),
         ("WARC-Refers-To", F.when(F.col("original").isNotNull(), name("main", F.col("original.page_id").cast("string"), "original.row"))),
         ("WARC-Profile", F.when(F.col("original").isNotNull(), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
         ("Content-Type", F.lit("application/http;msgtype=response"))],
        F.when(F.col("original").isNull(), F.concat(head, body)).otherwise(head),
    )
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", name("request")), ("WARC-Date", F.lit(DATE)), ("WARC-Concurrent-To", name("main")),
         ("WARC-Target-URI", uri), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1" + END)),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", name("metadata")), ("WARC-Date", F.lit(DATE)), ("WARC-Concurrent-To", name("main")),
         ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("pageId: "), page, F.lit(EOL + "payloadBytes: "), F.col("size").cast("string"), F.lit(EOL)),
    )
    records = c.select(F.explode(F.array(main, request, metadata)).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``type, record_id, concurrent_to, target_uri, digest, refers_to, block``: one row per record."""
    raw = spark.read.option("lineSep", VERSION + EOL).text(path)
    head = F.substring_index("value", END, 1)

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1), F.lit(""))

    cut = raw.where("value != ''").select(head.alias("head"), F.expr(f"substring(value, char_length(substring_index(value, '\\r\\n\\r\\n', 1)) + {1 + len(END)})").alias("rest"))
    bytes_ = F.substring(F.encode("rest", "UTF-8"), F.lit(1), field("Content-Length").cast("int"))
    return cut.where("head != ''").select(
        field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("record_id"), field("WARC-Concurrent-To").alias("concurrent_to"),
        field("WARC-Target-URI").alias("target_uri"), F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("digest"),
        field("WARC-Refers-To").alias("refers_to"), F.decode(bytes_, "UTF-8").alias("block"),
    )


def http_payload(block: Column) -> Column:
    """Payload of an HTTP block."""
    head = F.substring_index(block, END, 1)
    body = F.substr(block, F.char_length(head) + 1 + len(END))
    return F.when(F.contains(head, F.lit("Content-Transfer-Encoding: base64")), F.decode(F.unbase64(body), "UTF-8")).otherwise(body)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``record_id, response, request, metadata`` (request or metadata null where there is none)."""
    def side(kind: str) -> DataFrame:
        return records.where(F.col("type") == kind).select(F.col("concurrent_to").alias("record_id"), F.struct("target_uri", F.col("record_id").alias("id"), "block").alias(kind))

    payload = http_payload(F.col("block"))
    main = records.where(F.col("type").isin("response", "revisit")).select(
        "record_id", F.struct("type", "target_uri", "digest", "refers_to", payload.alias("payload")).alias("response")
    )
    return main.join(side("request"), "record_id", "left").join(side("metadata"), "record_id", "left")


def metadata_field(name: str) -> Column:
    return F.regexp_extract("metadata.block", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS original FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original <> page_id THEN original END AS refers_to FROM o
"""


@query("op7_warc_transactions", SQL)
def op7_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "llm-warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    # what is read again of a payload is its size and digest, taken before the joins
    rows = transactions(read_records(spark, path))
    page = metadata_field("pageId")
    told = metadata_field("payloadBytes").cast("long")
    stored = F.col("response.type") == "response"
    read = staged(rows.select(
        F.when(page != "-", page.cast("long")).alias("page_id"),
        F.when(stored, F.octet_length("response.payload").cast("long")).otherwise(told).alias("payload_bytes"),
        F.when(stored, F.sha1(F.encode("response.payload", "UTF-8"))).otherwise(F.col("response.digest")).alias("payload_digest"),
        F.col("response.type").alias("record_type"), "record_id", F.col("response.refers_to").alias("refers"),
    ), "captures")
    # only responses that a revisit names are joined: one row each, whatever the number of revisits
    named = staged(read.where("refers is not null").select(F.col("refers").alias("record_id")).distinct(), "named")
    known = named.join(read.where("record_type = 'response'").select("record_id", F.col("page_id").alias("refers_to")), "record_id")
    return read.join(known.withColumnRenamed("record_id", "refers"), "refers", "left").drop("refers", "record_id")
