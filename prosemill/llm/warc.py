r"""Operator 4, WARC: archives of transactions, written and assembled again.

Writing. Every page is a capture of three WARC/1.1 records: a request, a response or revisit, and a metadata record; the
first and the last name the second in WARC-Concurrent-To. Of pages with equal payloads (by SHA-256) of REVISIT_BYTES or
more, the one with the smallest page_id is the response and the others revisit it (identical-payload-digest profile), with
an empty body; they name its record in WARC-Refers-To, its url and date beside it. Records are built by SQL expressions and
compressed one by one, so that each is a gzip member. A task packs members into archives of ARCHIVE_BYTES at most (or one
record), which Spark's text writer puts into a file each, so they reach any file system and lost tasks are written again.
The writer needs a separator at the end: it is the last byte of the last member, which is a zero. Only the files' suffix
is Spark's (.txt instead of .warc.gz).

Reading. A task takes one archive at a time and inflates it record by record; blocks are cut by Content-Length, so a payload
may hold anything. Records are joined through the concurrent-to identifiers, by grouping on the identifier of the capture's
main record, into one nested row per capture. A revisit meets the response with its payload digest, which gives length and
page; many revisits of one payload are a join of two written tables, which Spark can split.

The payload of a null html is empty, and very long ones are records of their own archives. Rows that share a page_id are
captures of their own; all that carry the smallest page_id of a payload are responses, and its revisits leave WARC-Refers-To
out, as no record of them is the one. A null page_id comes after all others and refers_to is null where only such rows have
the payload. Equal urls are no key. Other columns of the pages are left out. An empty table gives no archives and an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm._spark import drop_path, ship, stage_path, staged

REVISIT_BYTES = 100
ARCHIVE_BYTES = 16_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def _utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def _clean(text: Column) -> Column:
    """A header value: no line breaks."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n\x00]", "%0A")


def _urn(key: Column, kind: str) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(kind), key))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], body: Column) -> Column:
    """One record as binary."""
    lines = [F.lit("WARC/1.1" + CRLF)]
    for name, value in headers:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit("")))
    head = F.concat(*lines, F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF))
    return F.concat(_utf8(head), body, _utf8(F.lit(CRLF + CRLF)))


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, digest, payload; where others share the payload, the smallest page_id that has it (first_page), its url (first_url) and rows (first_rows)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    payload = _utf8(F.coalesce("html", F.lit("")))
    rows = rows.withColumn("digest", F.sha2(payload, 256))
    by_page = rows.where(F.octet_length(payload) >= REVISIT_BYTES).groupBy("digest", "page_id").agg(F.count("*").alias("n"), F.min("url").alias("url"))
    shared = by_page.groupBy("digest").agg(F.min_by(F.struct("page_id", "url", "n"), "page_id").alias("first"), F.sum("n").alias("n")).where("n > 1 and first.page_id is not null")
    # a table of its own, so that Spark can split a frequent payload in the join
    shared = staged(shared.select("digest", F.col("first.page_id").alias("first_page"), F.col("first.url").alias("first_url"), F.col("first.n").alias("first_rows")), "payloads")
    out = rows.join(shared, "digest", "left").withColumn("payload", payload).drop("html")
    out._staged_path = shared._staged_path
    return out


def _archiver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compresses records and packs them into archives, without the last byte of each."""

    def archive(members: list[bytes]) -> pa.RecordBatch:
        if members[-1][-1]:  # the length of the last record, modulo 2**32, ends the archive: add an empty member
            members.append(gzip.compress(b"", mtime=0))
        return pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]], pa.binary())], ["value"])

    members, held = [], 0
    for batch in batches:
        for record in batch.column(0):
            member = gzip.compress(record.as_py(), 6, mtime=0)
            if members and held + len(member) > ARCHIVE_BYTES - 64:
                yield archive(members)
                members, held = [], 0
            members.append(member)
            held += len(member)
    if members:
        yield archive(members)


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes the pages' captures below path."""
    ship(pages.sparkSession)
    rows = captures(pages)
    path_of_shared = rows._staged_path
    is_revisit = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    # the only row with the smallest page_id has an identifier that its revisits can tell; the others' hold the row's number
    alone = F.concat_ws("-", F.col("first_page").cast("string"), "digest")
    own = F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "digest", F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumns({"revisits": is_revisit, "key": F.when(~is_revisit & (F.col("first_rows") == 1), alone).otherwise(own)})
    main, url, is_revisit = _urn(F.col("key"), "main"), _clean(F.col("url")), F.col("revisits")
    host = F.regexp_extract(url, r"^[a-z]+://([^/]*)", 1)
    request = _utf8(F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1" + CRLF + "Host: "), host, F.lit(CRLF + CRLF)))
    http = _utf8(F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF + CRLF)))
    common = [("WARC-Target-URI", url), ("WARC-Date", DATE)]
    records = F.array(
        _record([("WARC-Type", "request"), ("WARC-Record-ID", _urn(F.col("key"), "request")), ("WARC-Concurrent-To", main), *common, ("Content-Type", "application/http; msgtype=request")], request),
        _record(
            [
                ("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
                ("WARC-Record-ID", main),
                *common,
                ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
                ("WARC-Profile", F.when(is_revisit, F.lit(PROFILE))),
                ("WARC-Refers-To", F.when(is_revisit & (F.col("first_rows") == 1), _urn(alone, "main"))),
                ("WARC-Refers-To-Target-URI", F.when(is_revisit, _clean(F.col("first_url")))),
                ("WARC-Refers-To-Date", F.when(is_revisit, F.lit(DATE))),
                ("Content-Type", "application/http; msgtype=response"),
            ],
            F.when(is_revisit, http).otherwise(F.concat(http, F.col("payload"))),
        ),
        _record(
            [("WARC-Type", "metadata"), ("WARC-Record-ID", _urn(F.col("key"), "metadata")), ("WARC-Concurrent-To", main), *common, ("Content-Type", "application/warc-fields")],
            _utf8(F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))),
        ),
    )
    archives = rows.select(F.explode(records).alias("record")).mapInArrow(_archiver, "value binary").select(F.col("value").cast("string").alias("value"))
    archives.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    drop_path(pages.sparkSession, path_of_shared)


RECORD = "record_id string, capture_id string, type string, uri string, date string, digest string, refers_to string, page_id long, payload_bytes long, payload_digest string"


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an inflated stream, one at a time."""
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record where {first[:20]!r} stands")
        headers = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        stream.read(4)
        yield headers, block


def _fields(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    """The columns of RECORD, and the payload if it is asked for."""
    kind, record = headers["warc-type"], headers["warc-record-id"]
    page_id = size = digest = payload = None
    if kind == "metadata":
        lines = dict(x.split(": ", 1) for x in block.decode().split(CRLF) if x)
        page_id = int(lines["page-id"]) if lines.get("page-id") else None
    elif kind == "response":
        payload = block[block.find(b"\r\n\r\n") + 4 :]
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    row = (record, headers.get("warc-concurrent-to", record), kind, headers.get("warc-target-uri"), headers.get("warc-date"), headers.get("warc-payload-digest", "").removeprefix("sha256:") or None, headers.get("warc-refers-to"), page_id, size, digest)
    return row + (payload,) * with_payload


def _reader(with_payload: bool):
    schema = [("record_id", pa.string()), ("capture_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    schema += [("payload", pa.binary())] * with_payload

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), schema, strict=True)], [n for n, _ in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(content.as_buffer())
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw
                rows, held = [], 0
                for headers, block in parse(stream):
                    rows.append(_fields(headers, block, with_payload))
                    held += 500 + len(block) * with_payload
                    if held > 4_000_000:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One nested row per capture: capture_id, request, main (response or revisit), metadata."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")
    records = files.mapInArrow(_reader(with_payload), RECORD + (", payload binary" if with_payload else ""))

    def one(kinds: list[str], *fields: str) -> Column:
        return F.max(F.when(F.col("type").isin(*kinds), F.struct(*fields)))

    extra = ["payload"] * with_payload
    return records.groupBy("capture_id").agg(
        one(["request"], "record_id", "uri", "date").alias("request"),
        one(["response", "revisit"], "record_id", "type", "uri", "date", "digest", "refers_to", "payload_bytes", "payload_digest", *extra).alias("main"),
        one(["metadata"], "record_id", "page_id").alias("metadata"),
    )


def resolved(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest (of the full payload), record_type, refers_to (a page_id) and target_uri of captures in a written table."""
    main, page_id = F.col("main"), F.col("metadata.page_id").alias("page_id")
    responses = captures.where(main["type"] == "response").select(page_id, main["payload_bytes"].alias("payload_bytes"), main["payload_digest"].alias("payload_digest"), main["uri"].alias("target_uri"))
    known = staged(responses.groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"), F.min("page_id").alias("refers_to")), "responses")
    revisits = captures.where(main["type"] == "revisit").select(page_id, main["digest"].alias("payload_digest"), main["uri"].alias("target_uri")).join(known, "payload_digest", "left")
    out = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")
    both = responses.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")}).select(*out).unionByName(revisits.withColumn("record_type", F.lit("revisit")).select(*out))
    return both


def warc(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the pages as archives, reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri. The archives stay if a path is given."""
    spark = pages.sparkSession
    own = path or stage_path(spark, "warc")
    write_archives(pages, own)
    narrow = staged(read_archives(spark, own), "captures")
    if path is None:
        drop_path(spark, own)
    return resolved(narrow)
