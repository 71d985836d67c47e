"""WARC archives with segmented records and revisits.

Writing: a page's payload is an HTTP response body in chunked transfer framing; blocks over ``SEGMENT`` bytes are cut
into a first record and continuation records. Records leave through Spark's text writer, whose line
separator is the CRLF CRLF that ends a WARC record, so that part files are committed like any other output and lie in
the folder that the cluster shares; ``RECORDS`` of at most ``SEGMENT`` bytes bound a file.

Reading: files are parsed by content length; continuation records are grouped by their origin's identifier, ordered by
segment number and checked against the total length; chunked framing is decoded, and a response's payload is checked against
its digest.

Defined results: a null html is an empty payload; of equal payloads of at least ``least`` bytes the one with the largest id is the
response and others revisit it; rows that repeat the response's id are responses too; a null id is smaller than
any other and never referred to unless all are null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm.lineage import Tables, shared_folder

SEGMENT = 1 << 16
RECORDS = 512
CHUNK = 1 << 13
END = b"\r\n\r\n"
#: Pages whose records a task holds at once.
SLICE = 256
#: Revisits up to which their list is broadcast to the pages; a longer one is joined.
BROADCAST = 1 << 18


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + CHUNK]), payload[i : i + CHUNK]) for i in range(0, len(payload), CHUNK)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of chunked transfer framing; ValueError if it is cut off or malformed."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunked framing is cut off")
        size = int(body[at:line].partition(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where it says")
        parts.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the CRLF CRLF after its block."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block


def _named(page: str) -> str:
    kind, _, name = page.partition(":")
    return f"{kind}:{quote(name, safe='')}"


def records(page: str, instance: int, url: str | None, payload: bytes, refers_to: str | None) -> Iterator[bytes]:
    """The records of one page. Ids (``page``, ``refers_to``) are "page:" and the id, or "null:"; ``instance`` tells rows with equal ids apart."""
    uri = f"<urn:sigspark:{_named(page)}:{instance:x}>"
    name = digest(payload)
    common = [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{name}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        common.append(("WARC-Target-URI", " ".join(url.split())))
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", uri), ("WARC-Refers-To", f"<urn:sigspark:{_named(refers_to)}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *common], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= SEGMENT:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", uri), *common], block)
        return
    for number, at in enumerate(range(0, len(block), SEGMENT), 1):
        part = [("WARC-Segment-Number", str(number))]
        if number > 1:
            part.append(("WARC-Segment-Origin-ID", uri))
        if at + SEGMENT >= len(block):
            part.append(("WARC-Segment-Total-Length", str(len(block))))
        own = [("WARC-Type", "response"), ("WARC-Record-ID", uri), *common] if number == 1 else [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{uri[:-1]}:{number}>"), ("WARC-Date", common[0][1])]
        yield record(own + part, block[at : at + SEGMENT])


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive."""
    at = 0
    while at < len(data):
        stop = data.find(END, at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError("not a WARC record")
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        first = stop + len(END)
        last = first + int(headers["content-length"])
        if data[last : last + len(END)] != END:
            raise ValueError("a record doesn't end where it says")
        yield headers, data[first:last]
        at = last + len(END)


def _page_of(uri: str) -> str | None:
    kind, name = uri.strip("<>").split(":")[2:4]
    return None if kind == "null" else unquote(name)


def roles(pages: DataFrame, least: int, id_col: str, html_col: str) -> DataFrame:
    """(page_id, sha, refers): rows that revisit, with the id that they refer to."""
    seen = pages.select(F.col(id_col).alias("p"), F.sha1(F.coalesce(F.col(html_col), F.lit("")).cast("binary")).alias("sha"), F.coalesce(F.octet_length(html_col), F.lit(0)).alias("size")).filter(F.col("size") >= least)
    first = seen.groupBy("sha").agg(F.max("p").alias("refers"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    return seen.join(first, "sha").filter(~F.col("p").eqNullSafe(F.col("refers"))).select("p", F.col("sha").alias("s"), "refers").distinct()


def write(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write the pages' records to compressed archives in ``folder``."""
    tables = Tables(pages.sparkSession)
    revisits = tables.cut(roles(pages, least, id_col, html_col))
    revisits = F.broadcast(revisits) if revisits.count() <= BROADCAST else revisits
    named = lambda c: F.when(F.col(c).isNull(), "null:").otherwise(F.concat(F.lit("page:"), F.col(c).cast("string")))
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html).alias("sha"))
    told = rows.join(revisits, F.col("page").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left").select(
        named("page").alias("page"),
        "url",
        "html",
        F.when(F.col("s").isNotNull(), named("refers")).alias("refers"),
        F.monotonically_increasing_id().alias("instance"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                page, url, payload, refers, instance = (c.to_pylist() for c in part.columns)
                out = [r for x in zip(page, instance, url, payload, refers, strict=True) for r in records(*x)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    lines = told.mapInArrow(work, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(folder)
    tables.drop()


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """(page_id string, payload_bytes, payload_digest, record_type, refers_to string[, payload]) of each record that isn't a continuation."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows = []
                for headers, block in parse(data):
                    origin = headers.get("warc-segment-origin-id", headers["warc-record-id"])
                    total = headers.get("warc-segment-total-length")
                    number = int(headers.get("warc-segment-number", 1))
                    told = headers.get("warc-payload-digest", "").rpartition(":")[2]
                    segment = (origin, number, int(total) if total else None, headers["warc-type"], told, headers.get("warc-refers-to"), block)
                    if "warc-segment-number" not in headers:  # whole: it is decoded here, so that only segments' bytes are shuffled
                        page, size, told, kind, refers, payload = joined([(*segment[:2], len(block), *segment[3:])])
                        segment = (origin, 0, size, kind, told, refers, payload)
                    rows.append(segment)
                columns = list(zip(*rows, strict=True)) if rows else [()] * 7
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["origin", "number", "total", "kind", "digest", "refers", "block"])

    def joined(segments: list[tuple]) -> tuple:
        """A record of its segments in order."""
        origin, _, _, kind, told, refers, _ = segments[0]
        if [s[1] for s in segments] != list(range(1, len(segments) + 1)):
            raise ValueError(f"segments of {origin} are missing or repeated")
        block, total = b"".join(s[6] for s in segments), segments[-1][2]
        if total != len(block):
            raise ValueError(f"{origin} has {len(block)} bytes of {total}")
        head, _, body = block.partition(END)
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
        if kind == "revisit":
            return _page_of(origin), int(fields[b"content-length"]), told, kind, _page_of(refers), None
        payload = dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
        if digest(payload) != told:
            raise ValueError(f"the payload of {origin} doesn't have its digest")
        return _page_of(origin), len(payload), told, kind, None, payload if with_payload else None

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            rows = []
            for segment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not segment[1]:
                    origin, _, size, kind, told, refers, payload = segment
                    rows.append((_page_of(origin), size, told, kind, refers, payload))
                    continue
                if held and held[0][0] != segment[0]:
                    rows.append(joined(held))
                    held = []
                held.append(segment)
            if rows:
                yield out(rows)
        if held:
            yield out([joined(held)])

    segments = files.mapInArrow(split, "origin string, number long, total long, kind string, digest string, refers string, block binary")
    found = segments.repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(assemble, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    return found if with_payload else found.drop("payload")


def round_trip(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The pages written to archives in the shared folder and read back, with ids of their own type."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder, least, id_col, url_col, html_col)
    kind = pages.schema[id_col].dataType
    return read(spark, folder).withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
