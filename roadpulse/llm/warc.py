"""WARC archives: writing, reading, and assembling transactions.

``captures_to_records`` makes the records of one capture: a request, a
response (or a revisit, if an equal payload of at least ``revisit_bytes`` bytes
is kept elsewhere) and a metadata record; request and metadata name the
response in WARC-Concurrent-To.  ``write_warc`` joins them by the blank lines
that end a record to texts of bounded bytes and writes each as a gzipped
file.  ``read_warc`` unpacks a file as a stream and cuts records by
Content-Length.  ``assemble`` joins request, response and metadata records
through their concurrent-to identifiers into one nested row per capture.

Edge cases: a null payload is empty.  Null URLs and ids leave their header or
field out.  Rows equal in id, URL and payload have the same record ids; they
come back as one capture with ``copies`` set, which the query expands again.
Among equal payloads every row with the largest id is a response, and a payload
whose rows all have null ids is never revisited.  A record that names no
capture, or one that is missing, is its own capture with the other parts null.
An empty table gives an archive without records.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from typing import BinaryIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored, table

END = "\r\n\r\n"
RECORD = ("record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
          "declared_digest string, content_type string, http_length long, payload_bytes long, payload_digest string, "
          "payload binary")


def _lines(*headers: Column) -> Column:
    """Header lines; a null header is left out."""
    return F.array_join(F.array(*headers), "\r\n")


def _header(name: str, value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    return F.concat(F.lit(f"{name}: "), value)


def _urn(kind: str, *parts: Column) -> Column:
    """A record id that depends on the capture alone, so that a rewritten file has the same ids."""
    full = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    h = F.md5(F.concat_ws("\n", F.lit(kind), *full))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in
                                                           ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def captures_to_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                        date: str = "2024-01-01T00:00:00Z", revisit_bytes: int = 1000) -> DataFrame:
    """One row per WARC record, in the column ``value``, without the blank lines that end it."""
    captures = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                            F.coalesce(F.col(payload_col), F.lit("")).alias("body")).withColumns(
        {"size": F.octet_length("body").cast("long"), "sha": F.sha1(F.col("body").cast("binary"))})
    # payloads met more than once, and the capture that keeps each
    equal = (captures.where((F.col("size") >= revisit_bytes) & F.col("id").isNotNull())
             .groupBy("sha", "size").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "url")).alias("kept"))
             .where("n > 1").select("sha", F.col("size").alias("_size"), "kept"))
    # stored, its true size tells Spark whether to broadcast it or to shuffle
    equal = stored(equal.withColumnRenamed("sha", "_sha"), "payloads")
    captures = captures.join(equal, (F.col("sha") == F.col("_sha")) & (F.col("size") == F.col("_size")), "left")
    revisit = F.coalesce(F.col("kept.id") > F.col("id"), F.lit(False))
    hub = _urn("response", F.col("id"), F.col("url"), F.col("sha"))
    held = _urn("response", F.col("kept.id"), F.col("kept.url"), F.col("sha"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("body")))
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-z]+://[^/?#]*([^#]*)", 1)
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-z]+://([^/?#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(path == "", F.lit("/")).otherwise(path), F.lit(" HTTP/1.1\r\nHost: "), host,
                     F.lit(END))
    about = F.array_join(F.array(_header("capture-id", F.col("id").cast("string")), _header("fetched-by", "export")), "\r\n")

    def record(kind: Column | str, own: Column, content: Column, content_type: str, *more: Column) -> Column:
        return F.concat(_lines(F.lit("WARC/1.1"), _header("WARC-Type", kind), _header("WARC-Record-ID", own),
                               _header("WARC-Date", date), _header("WARC-Target-URI", F.col("url")), *more,
                               _header("Content-Type", content_type),
                               _header("Content-Length", F.octet_length(content).cast("string"))), F.lit(END), content)

    digest = _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.upper("sha")))
    concurrent = _header("WARC-Concurrent-To", hub)
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    refers = F.when(revisit, _header("WARC-Refers-To", held))
    profile = F.when(revisit, _header("WARC-Profile",
                                      "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    return captures.select(F.explode(F.array(
        record("request", _urn("request", F.col("id"), F.col("url"), F.col("sha")), asked,
               "application/http; msgtype=request", concurrent),
        record(kind, hub, block, "application/http; msgtype=response", digest, refers, profile),
        record("metadata", _urn("metadata", F.col("id"), F.col("url"), F.col("sha")), about,
               "application/warc-fields", concurrent))).alias("value"))


def write_warc(records: DataFrame, path: str, file_bytes: int = 1 << 26) -> None:
    """Gzipped WARC files below ``path``, each of at most ``file_bytes`` bytes before compression, or of one larger record.

    A task joins its records to rows of that size, and every row becomes a file.
    """
    def run(batches):
        import pyarrow as pa
        held, size = [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.string())], ["value"])
        for batch in batches:
            for value in batch.column(0):
                value, own = value.as_py(), value.as_buffer().size + len(END)
                if held and size + own > file_bytes:
                    yield row()
                    held.clear()
                    size = 0
                held.append(value)
                size += own
        if held:
            yield row()

    (records.select("value").mapInArrow(run, "value string").write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", 1).text(path))


_FIELD = re.compile(rb"^([!-9;-~]+):[ \t]*(.*?)[ \t]*\r?$", re.M)


def _fields(head: bytes) -> dict[bytes, bytes]:
    return {name.lower(): value for name, value in _FIELD.findall(head)}


def parse_records(data: bytes | BinaryIO):
    """(headers, block) of each record of an archive, cut by Content-Length; one record is held at a time."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    at = 0
    while True:
        head = []
        while line := stream.readline():
            at += len(line)
            if line != b"\r\n":
                head.append(line)
            elif head:
                break
        if not head:
            return
        if not head[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record before byte {at}")
        fields = _fields(b"".join(head)[:-2])
        size = int(fields[b"content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("the last record is cut short")
        at += size
        yield fields, block


def read_warc(spark, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archive files below ``path``; ``payload`` is null unless ``payloads``."""
    def run(batches):
        import pyarrow as pa
        names = [c.split()[0] for c in RECORD.split(", ")]
        types = [pa.int64() if " long" in c else pa.binary() if " binary" in c else pa.string() for c in RECORD.split(", ")]
        for batch in batches:
            for k in range(batch.num_rows):
                data = batch.column(0)[k].as_py()
                stream, rows, held = io.BytesIO(data), [], 0
                if data[:2] == b"\x1f\x8b":
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
                for fields, block in parse_records(stream):
                    text = lambda name: fields[name].decode() if name in fields else None
                    length, payload = None, block
                    if text(b"content-type") and text(b"content-type").startswith("application/http"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        inner = _fields(head).get(b"content-length")
                        length = int(inner) if inner else None
                    digest = text(b"warc-payload-digest")
                    rows.append((text(b"warc-record-id"), text(b"warc-type"), text(b"warc-concurrent-to"),
                                 text(b"warc-refers-to"), text(b"warc-target-uri"), text(b"warc-date"),
                                 _hex(digest), text(b"content-type"), length, len(payload),
                                 hashlib.sha1(payload).hexdigest(), payload if payloads else None))
                    held += len(payload) if payloads else 0
                    if len(rows) >= 4096 or held >= 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def _hex(digest: str | None) -> str | None:
    """Bare lower-case hex of a sha1 digest header in hex or base 32."""
    if not digest or not digest.lower().startswith("sha1:"):
        return None
    value = digest[5:]
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: its id, ``response``, ``requests`` and ``metadata`` (arrays), and ``copies``.

    A response or revisit is the hub; other records belong to the hub that they
    name.  Copies of one record (same id) are kept once in the arrays.
    """
    part = F.struct(*records.columns)
    hub = F.col("type").isin("response", "revisit", "resource")
    keyed = records.select(F.coalesce(F.when(~hub, F.col("concurrent_to")), F.col("record_id")).alias("capture"),
                           F.col("type"), hub.alias("hub"), part.alias("part"))
    return keyed.groupBy("capture").agg(
        F.max(F.when(F.col("hub"), F.col("part"))).alias("response"),
        F.collect_set(F.when(F.col("type") == "request", F.col("part"))).alias("requests"),
        F.collect_set(F.when(F.col("type") == "metadata", F.col("part"))).alias("metadata"),
        F.greatest(F.count_if("hub"), F.lit(1)).alias("copies"))


def op3_warc_transactions(spark, sf_dir):
    """All ``pages`` written as WARC files, read back and assembled into captures."""
    path = scratch(spark, "warc")
    write_warc(captures_to_records(table(spark, sf_dir, "pages")), path)
    records = read_warc(spark, path)
    # a page's id is in its metadata record
    field = F.regexp_extract(F.col("payload").cast("string"), r"(?m)^capture-id: (-?\d+)\r?$", 1)
    slim = records.withColumn("payload", F.when(F.col("type") == "metadata", F.nullif(field, F.lit(""))))
    captures = stored(assemble(slim), "captures").select(
        F.col("capture"), F.col("copies"), F.get("metadata", F.lit(0))["payload"].cast("long").alias("page_id"),
        F.col("response.*"), F.get("requests", F.lit(0))["record_id"].alias("request_id"))
    revisit = F.col("type") == "revisit"
    own = captures.where("type is not null").select(
        "capture", "copies", "page_id", "target_uri", "request_id",
        F.when(revisit, F.col("http_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers_to").alias("held"))
    kept = (own.where("held is not null").select("held").distinct()
            .join(own.select(F.col("capture").alias("held"), F.col("page_id").alias("refers_to")), "held"))
    return (own.join(kept, "held", "left")
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "request_id"))
