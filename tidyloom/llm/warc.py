"""WARC archives: pages written as records that may be segmented and chunked, and read back.

A page is an HTTP response in chunked transfer coding; a block above a limit is cut into segments, the first in the
response record, the others in continuation records.  A payload that another page has too is a revisit record without a
body.  The reader parses each archive by its records' lengths, groups segments by the identifier of their origin
wherever they lie, orders them by number, verifies the total length, and only then decodes the transfer coding.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyloom.llm.common import scratch, ship, written

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE = 16 << 10, 4 << 10, 20_000
#: Most bytes of blocks in an archive, since each is read as one value.
ARCHIVE_BYTES = 1 << 28
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str, row: int | None = None) -> str:
    """``row`` tells apart pages that share an id and a payload."""
    name = f"{page_id}:{payload_digest}" if row is None else f"{page_id}:{payload_digest}:{row}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def encode_chunks(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i:i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def decode_chunks(body: bytes) -> bytes:
    """The payload of a body in chunked transfer coding; raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at:at + size])
        at += size + 2


def _record(fields: dict[str, object], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields.items() if v is not None),
             b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(page_id: int | None, url: str | None, payload: bytes, leader: int | None, segment_bytes: int,
            row: int | None = None, leader_row: int | None = None) -> list[bytes]:
    """The records of one page; ``leader`` is the page that has the payload already."""
    sha = digest(payload)
    own = record_id(page_id, sha, row)
    fields = {"WARC-Record-ID": own, "WARC-Date": DATE,
              "WARC-Target-URI": None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~"),
              "WARC-Payload-Digest": f"sha1:{sha}", "X-Page-Id": page_id,
              "Content-Type": "application/http; msgtype=response"}
    if leader is not None:
        return [_record({"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE,
                         "WARC-Refers-To": record_id(leader, sha, leader_row), **fields}, HEAD)]
    block = HEAD + encode_chunks(payload)
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        return [_record({"WARC-Type": "response", **fields}, block)]
    out = [_record({"WARC-Type": "response", "WARC-Segment-Number": 1, **fields}, parts[0])]
    for n, part in enumerate(parts[1:], 2):
        out.append(_record({
            "WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own}:{n}')}>",
            "WARC-Date": DATE, "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": n,
            "WARC-Segment-Total-Length": len(block) if n == len(parts) else None}, part))
    return out


def write(pages: DataFrame, path: str, min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES,
          id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write archives, gzip files of at most ``RECORDS_PER_FILE`` records and some ``ARCHIVE_BYTES``, to a new folder.

    Of equal payloads of at least ``min_revisit_bytes`` the page with the smallest id is the response; a null id is
    larger than any other, and among null ids alone each is a response.  A null payload is empty, a null address is left
    out.  Each row makes a record of its own: its identifier has the row's number in a written table.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = written(rows.withColumns({"sha": F.sha1("payload"), "row": F.monotonically_increasing_id()}), "pages")
    keys = rows.select("row", "page_id", "sha").where(F.octet_length("payload") >= min_revisit_bytes)
    # The first row of the smallest id; null ids are largest.
    leaders = keys.groupBy("sha").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias(
        "leader"), F.count("*").alias("n")).where("n > 1").select("sha", "leader.page_id", "leader.row")
    leaders = leaders.toDF("sha", "leader", "leader_row")
    # Only narrow rows meet at a payload that many pages share; the payloads move by row.
    later = keys.join(leaders, "sha").where("NOT page_id <=> leader").select("row", "leader", "leader_row")
    linked = rows.drop("sha").join(later, "row", "left")
    columns = ("page_id", "url", "payload", "leader", "row", "leader_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url, payload, leader, row, leader_row in zip(*(batch.column(c) for c in columns)):
                # The writer ends each line, and so each record, with the last of its line breaks.
                out += [r[:-2] for r in records(page_id.as_py(), url.as_py(), payload.as_py(), leader.as_py(),
                                                segment_bytes, row.as_py(), leader_row.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    made = linked.select(*columns).mapInArrow(run, "record binary")
    made.select(F.col("record").cast("string")).write.option("lineSep", "\r\n").option("compression", "gzip").option(
        "maxRecordsPerFile", max(1, min(RECORDS_PER_FILE, ARCHIVE_BYTES // segment_bytes))).text(path)


def parse(archive: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields, in lower case, and block of each record."""
    while True:
        line = archive.readline()
        while line in (b"\r\n", b"\n"):
            line = archive.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := archive.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = archive.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError("the archive ends within a record")
        yield fields, block


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    chunked = any(f.lower().startswith(b"transfer-encoding:") and b"chunked" in f.lower() for f in head.split(b"\r\n"))
    return decode_chunks(body) if chunked else body


def reassemble(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of segments ``number, total length, part``; raises ValueError if any is missing."""
    parts = {n: (total, part) for n, total, part in segments}
    if sorted(parts) != list(range(1, len(parts) + 1)):
        raise ValueError(f"segments {sorted(parts)} are not all")
    block = b"".join(parts[n][1] for n in sorted(parts))
    if parts[len(parts)][0] != len(block):
        raise ValueError(f"{len(block)} bytes, announced {parts[len(parts)][0]}")
    return block


_SEGMENTS = ("record_id string, page_id long, url string, record_type string, refers_id string, claimed string, "
             "payload_bytes long, payload_digest string, problem string, number int, total long, block binary")
RECORDS = ("record_id string, page_id long, url string, record_type string, refers_id string, payload binary, "
           "payload_bytes long, payload_digest string, problem string")


def _checked(segments: list[tuple[int, int | None, bytes]] | bytes, claimed: str | None
             ) -> tuple[bytes | None, int | None, str | None, str | None]:
    """Payload, its length, its digest and what is wrong, of a block or of its segments."""
    try:
        payload = payload_of(segments if isinstance(segments, bytes) else reassemble(segments))
        sha = digest(payload)
        if claimed not in (None, sha):
            raise ValueError(f"digest {sha}, announced {claimed}")
        return payload, len(payload), sha, None
    except ValueError as error:
        return None, None, None, str(error)


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per response or revisit record of all archives in a folder.

    ``payload_bytes`` and ``payload_digest`` are of the decoded payload; for a revisit they are null here, see
    `resolve`.  A record whose segments, framing or digest are wrong has a null payload and says so in ``problem``.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def open_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in (c for batch in batches for c in batch.column("content")):
            rows: list[tuple] = []
            for f, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
                page, kind = f.get("x-page-id"), f["warc-type"]
                claimed = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                found = None, None, None
                if number is None:
                    # A record in one piece is decoded here; only segments travel with their blocks.
                    payload, *found = _checked(block, claimed) if kind == "response" else (
                        None, None, claimed if kind == "revisit" else None, None)
                    block = payload if with_payload else None
                rows.append((f.get("warc-segment-origin-id", f["warc-record-id"]), int(page) if page else None,
                             f.get("warc-target-uri"), kind, f.get("warc-refers-to"), claimed, *found,
                             int(number) if number else 0, int(total) if total else None, block))
                if len(rows) >= 500:
                    yield _batch(rows, _SEGMENTS)
                    rows = []
            if rows:
                yield _batch(rows, _SEGMENTS)

    parts = files.mapInArrow(open_archives, _SEGMENTS)
    # A record is as large as a page; segments of one meet here, whichever archive they are in.
    first = F.col("record_type") != "continuation"
    grouped = parts.groupBy("record_id").agg(
        *(F.max(F.when(first, F.col(c))).alias(c) for c in ("page_id", "url", "record_type", "refers_id", "claimed",
                                                                  "payload_bytes", "payload_digest", "problem")),
        F.collect_list(F.struct("number", "total", "block")).alias("segments"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in (row for at in range(0, batch.num_rows, 100) for row in batch.slice(at, 100).to_pylist()):
                payload, size, sha, problem = None, r["payload_bytes"], r["payload_digest"], r["problem"]
                whole = [s["block"] for s in r["segments"] if s["number"] == 0]
                if whole:
                    payload = whole[0]
                elif r["record_type"] is None:
                    problem = "continuation records without their first"
                elif r["record_type"] == "response":
                    parts = [(s["number"], s["total"], s["block"]) for s in r["segments"]]
                    payload, size, sha, problem = _checked(parts, r["claimed"])
                rows.append((r["record_id"], r["page_id"], r["url"], r["record_type"], r["refers_id"],
                             payload if with_payload else None, size, sha, problem))
            if rows:
                yield _batch(rows, RECORDS)

    return grouped.mapInArrow(decode, RECORDS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)],
                                      [n for n, _ in fields])


def resolve(found: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, problem``: revisits with what they refer to."""
    found = written(found.drop("payload"), "records")
    target = found.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_n"))
    # Responses refer to nothing; in the join their missing keys would be one hot key.
    both = found.where("refers_id IS NOT NULL").join(target, "refers_id", "left")
    alone = found.where("refers_id IS NULL").select("*", F.lit(None).cast("long").alias("refers_to"),
                                                    F.lit(None).cast("long").alias("_n"))
    both = both.unionByName(alone)
    return both.select(
        "page_id", F.coalesce("payload_bytes", "_n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to",
        F.when((F.col("record_type") == "revisit") & F.col("_n").isNull(), F.coalesce("problem", F.lit(
            "refers to no response"))).otherwise(F.col("problem")).alias("problem"))


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES,
               **columns: str) -> DataFrame:
    """Write archives to the shared folder, read them back, and resolve revisits."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path, min_revisit_bytes, segment_bytes, **columns)
    return resolve(read(spark, path, with_payload=False))


#: What a round trip of ``pages`` returns, but for the digest's base 32, for which SQL has no function: here its 32
#: letters are looked up five bits at a time.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS sha FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(160), lambda i:
        ((instr('0123456789abcdef', sha[i // 4 + 1]) - 1) >> (3 - i % 4)) & 1), '') AS bits FROM p),
l AS (SELECT sha, min(page_id) AS leader FROM p GROUP BY sha)
SELECT page_id, octet_length(payload) AS payload_bytes, array_to_string(list_transform(range(32), lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda i:
           CAST(bits[5 * k + i + 1] AS INTEGER) << CAST(4 - i AS INTEGER))) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM leader THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM leader THEN leader END AS refers_to
FROM b JOIN l USING (sha)
"""
