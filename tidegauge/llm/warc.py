"""WARC archives of pages, and the assembly of what was captured together.

A page gives a request, a response (or, when its payload repeats another's, a revisit) and a metadata record. They are written as text files
whose line ends complete the records' own, compressed by gzip. Reading streams each archive by its Content-Length headers, so a
payload may hold anything. Request and metadata records name their response in WARC-Concurrent-To, as often as they like; by that they are
joined to it, one nested row for each capture. What is broken in an archive doesn't end the job: it is a record with a ``problem``.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.exact_dedup import maybe_among
from tidegauge.llm.shared import broadcast_if_small, new_path, text_or_empty, written

CRLF = "\r\n"
#: Payloads below are never written as revisits.
LEAST_REVISIT = 1000
#: Largest table of repeated payloads that is sent to all executors, in rows of about 100 bytes.
MOST_BROADCAST = 200_000
_TEXT = T.StringType()
_TYPES = {"record_type": _TEXT, "record_id": _TEXT, "concurrent_to": T.ArrayType(_TEXT), "refers_to_id": _TEXT, "target_uri": _TEXT, "date": _TEXT, "payload_digest": _TEXT, "payload_bytes": T.LongType(), "fields": T.MapType(_TEXT, _TEXT), "payload": T.BinaryType(), "problem": _TEXT}
RECORD = T.StructType([T.StructField(x, kind) for x, kind in _TYPES.items()])
KINDS = [pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 4, pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]
#: Bytes that are read at once, so that a length that isn't true takes no memory.
READ = 1 << 24


def _urn(kind: str, page: Column, row: Column) -> Column:
    """A record id from what identifies a row."""
    h = F.md5(F.concat_ws("|", F.lit(kind), page.cast("string"), row.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without the last of its line ends; headers without a value are left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))) for k, v in [*headers, ("Content-Length", F.octet_length(block).cast("string"))]]
    return F.concat(F.lit("WARC/1.1" + CRLF), F.concat_ws("", *lines), F.lit(CRLF), block, F.lit(CRLF))


def write_archive(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", captures_per_file: int = 5000, bytes_per_file: int = 1 << 29, max_filter_bytes: int = 64 << 20) -> None:
    """Writes three records for every row of df, in files of at most so many captures, and fewer where the longest page could make one larger than so many bytes.

    Payloads that occur once are told by a filter of bounded size and go straight to their file; only those that may be repeated are joined with
    what they repeat.

    Of rows with equal payloads of at least LEAST_REVISIT bytes, the one with the largest id is the response (tied: the one that is read first), the
    others revisit it. Null html counts as empty; null urls and ids leave their headers out. df is read once.
    """
    page, body = F.col(f"`{id_col}`"), text_or_empty(f"`{html_col}`")
    rows = df.select(page.alias("page"), F.regexp_replace(F.col(f"`{url_col}`").cast("string"), r"\s", "%20").alias("url"), body.alias("html"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("sha1", F.sha1("html"))
    rows = rows.withColumn("key", F.when(F.col("bytes") >= LEAST_REVISIT, F.sha2("html", 256)))
    rows = written(rows, "numbered")  # for a second scan of df may be split otherwise and so number rows otherwise
    longest = rows.agg(F.max("bytes").alias("n")).head()["n"] or 0
    captures_per_file = max(1, min(captures_per_file, bytes_per_file // (longest + 4000)))
    big = rows.select("row", "page", "key").filter("key is not null")
    first = F.max(F.struct("page", (-F.col("row")).alias("row"))).alias("first")
    found = written(big.groupBy("key").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.col("first.page").alias("to_page"), (-F.col("first.row")).alias("to_row")), "payloads")
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("to_page", df.schema[id_col].dataType), ("to_row", "long"))]
    probed = maybe_among(rows, found.select("key"), "key", max_filter_bytes)
    kept = [c for c in rows.columns if c != "key"]
    every = probed.filter("maybe").join(broadcast_if_small(found, MOST_BROADCAST), "key", "left").select(*kept, "to_page", "to_row").unionByName(probed.filter("not maybe").select(*kept, *none))
    revisit = F.col("to_row").isNotNull() & (F.col("to_row") != F.col("row"))
    own = _urn("response", F.col("page"), F.col("row"))
    host, rest = (F.regexp_extract("url", r"^[a-z]+://([^/?#]*)([^#]*)", i) for i in (1, 2))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    response = _record(
        [("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", F.when(revisit, _urn("response", F.col("to_page"), F.col("to_row")))), ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(http, F.when(revisit, "").otherwise(F.col("html"))),
    )
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", _urn("request", F.col("page"), F.col("row"))), *common, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.coalesce(F.when(rest != "", rest), F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Host: "), F.coalesce(host, F.lit("")), F.lit(CRLF * 2)))
    fields = F.concat_ws("", *(F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit(CRLF))) for k, v in (("page", F.col("page")), ("refers-to-page", F.when(revisit, F.col("to_page"))))))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn("metadata", F.col("page"), F.col("row"))), *common, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))], fields)
    lines = every.select(F.concat_ws(CRLF, request, response, metadata).alias("value"))
    lines.write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", captures_per_file).text(path)


def _block(f: BinaryIO, length: int) -> bytes:
    """So many bytes, or fewer at the end."""
    parts = []
    while length > 0 and (part := f.read(min(length, READ))):
        parts.append(part)
        length -= len(part)
    return b"".join(parts)


def _records(f: BinaryIO) -> Iterator[tuple[dict[str, list[str]], bytes, str | None]]:
    """Headers by lower-case name with all their values, block and problem of each record.

    A record without a usable length ends where the next one begins; bytes between records are a record without headers.
    """
    line = f.readline()
    while line:
        if line in (b"\r\n", b"\n"):
            line = f.readline()
            continue
        if not line.startswith(b"WARC/"):
            lost = 0
            while line and not line.startswith(b"WARC/"):
                lost += len(line)
                line = f.readline()
            yield {}, b"", f"{lost} bytes belong to no record"
            continue
        head: dict[str, list[str]] = {}
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head.setdefault(name.strip().lower(), []).append(value.strip())
        length = head.get("content-length", [""])[0]
        if re.fullmatch("[0-9]{1,18}", length):
            block = _block(f, int(length))
            left = int(length) - len(block)
            yield head, block, f"{left} bytes are missing" if left else None
            line = f.readline()
        else:
            lines = []
            while (line := f.readline()) and not line.startswith(b"WARC/"):
                lines.append(line)
            yield head, b"".join(lines).removesuffix(b"\r\n\r\n"), "no length"


def _named(text: bytes) -> dict[str, str]:
    """Lines of names and values; the last of a name."""
    return dict(re.findall(r"(?m)^([\w-]+):[ \t]*(.*?)\r?$", text.decode("utf-8", "replace")))


def parsed(f: BinaryIO, with_payload: bool) -> Iterator[tuple]:
    """Rows of RECORD, one record after the other from an uncompressed stream; where decompression fails, the last one tells it."""
    found = _records(f)
    while True:
        try:
            head, block, problem = next(found)
        except StopIteration:
            return
        except (EOFError, OSError, zlib.error) as e:
            yield (None, None, [], None, None, None, None, 0, [], None, f"broken compression: {e}")
            return

        def one(name: str, head: dict[str, list[str]] = head) -> str | None:
            return head[name][0] if name in head else None

        kind, content = one("warc-type"), one("content-type") or ""
        fields, payload = {}, block
        if content.startswith("application/http"):
            start, _, payload = block.partition(b"\r\n\r\n")
            fields = _named(start.partition(b"\n")[2])
        elif content == "application/warc-fields":
            fields = _named(block)
        if head and kind is None:
            problem = problem or "no type"
        if kind == "revisit":
            told = fields.get("Content-Length", "0")
            sha, n = (one("warc-payload-digest") or "").removeprefix("sha1:"), int(told) if re.fullmatch("[0-9]{1,18}", told) else 0
        else:
            sha, n = hashlib.sha1(payload).hexdigest(), len(payload)
        yield kind, one("warc-record-id"), head.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-target-uri"), one("warc-date"), sha, n, list(fields.items()), payload if with_payload and kind == "response" else None, problem


def read_archive(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Every record of the archives in a folder, as RECORD. Archives may be one gzip stream or one for each record. Payloads are those of responses.

    ``problem`` is null for sound records. Else it tells what is wrong: a block that is cut off (what is there is the payload), no usable length
    (the block ends where the next record begins), no type, bytes that belong to no record, or compression that is broken, where the rest
    of that archive can't be read. An empty archive has no records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                with gzip.open(io.BytesIO(cell.as_py())) as f:
                    rows: list[tuple] = []
                    size = 0
                    for row in parsed(f, with_payload):
                        rows.append(row)
                        size += 500 + len(row[9] or b"")
                        if size > 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=RECORD.names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=RECORD.names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row for each response or revisit: capture_id, target_uri, response, requests and metadata (records that name it in WARC-Concurrent-To).

    A record that names several captures is with each of them, one that names the same capture twice is there once. A capture without such
    records has empty lists; records that name no capture at hand are left out. Captures that share a record id are rows of their own, each
    with all records that name it, as are repeated rows; null ids are joined with nothing. Empty tables give empty results.
    """
    own = F.struct(*[c for c in RECORD.names if c not in ("concurrent_to", "target_uri")])
    captures = records.filter("record_type in ('response', 'revisit')").select(F.col("record_id").alias("capture_id"), "target_uri", own.alias("response"))
    with_ = records.filter("record_type in ('request', 'metadata')").withColumn("capture_id", F.explode(F.array_distinct("concurrent_to")))
    small = F.struct("record_id", "date", "fields")
    beside = with_.groupBy("capture_id").agg(F.collect_list(F.when(F.col("record_type") == "request", small)).alias("requests"), F.collect_list(F.when(F.col("record_type") == "metadata", small)).alias("metadata"))
    none = F.array().cast("array<struct<record_id:string,date:string,fields:map<string,string>>>")
    joined = captures.join(beside, "capture_id", "left")
    return joined.select("capture_id", "target_uri", "response", F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata"))


def capture_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", with_payload: bool = False) -> DataFrame:
    """Writes df's pages to archives in the shared folder, reads them again, and gives one nested row for each capture, with page and refers_to of df's id type.

    Repeated rows are captures of their own; of rows with equal payloads that tie in the largest id, the one read first is the response. Null html
    counts as empty, null ids and urls stay null; pages are written and read whole, however long (up to Spark's 2 GB a cell). An empty table gives
    an empty result; further columns are not read. Archives are parsed once, into a written table of records.
    """
    spark = df.sparkSession
    path = new_path(spark, "warc")
    write_archive(df, path, id_col, url_col, html_col)
    kind = df.schema[id_col].dataType
    found = assemble(written(read_archive(spark, path, with_payload), "records"))
    noted = F.try_element_at("metadata", F.lit(1))["fields"]
    return found.select(noted["page"].cast(kind).alias("page"), noted["refers-to-page"].cast(kind).alias("refers_to"), "*")


def query(spark, sf_dir: str) -> DataFrame:
    """All pages, through archives."""
    found = capture_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select(F.col("page").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"), "refers_to", "target_uri", F.size("requests").alias("n_requests"))


ORACLE = r"""
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS best FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < best THEN best END AS refers_to,
       url AS target_uri, 1 AS n_requests
FROM m
"""
