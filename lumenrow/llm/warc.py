"""WARC archives: writing captures, reading records back, and assembling transactions.

Each capture is three records: a response (or a revisit, if its payload is
another capture's), the request and metadata, the last two concurrent to the
first. Archives are blobs of whole records in a table of the shared folder, so
that any store Spark writes to will do; each blob is a WARC 1.1 file with one
gzip member for each record, as readers expect of .warc.gz files.

A revisit names its original as its profile has it, by the payload's digest,
beside the original's address. Payloads don't go through joins by digest: those
under LEAST_SHARED bytes have no original, and for the others keys are spread.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, spread_join, stored

#: Payloads of fewer bytes are always stored whole.
LEAST_SHARED = 1000
#: Bytes of records after which an archive is closed.
ARCHIVE_BYTES = 4 << 20
#: Bytes given to the decompressor at a time.
FED_BYTES = 4096
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID(int=0)
_RECORD = "warc_type string, record_id string, concurrent_to string, refers_to_uri string, target_uri string, payload_digest string, payload binary"


def _record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _digest_header(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def _hex(header: str | None) -> str | None:
    """A digest header's value in lower-case hex."""
    return base64.b32decode(header.partition(":")[2]).hex() if header else None


def _line(text: str | None) -> str:
    """A header's value on one line."""
    return " ".join((text or "").split())


def capture_records(page_id: object, key: str, url: str | None, payload: bytes, original: str | None, revisit: bool) -> list[bytes]:
    """The response or revisit, request and metadata records of one capture. ``key`` tells repeated rows apart, ``original`` is the address of a revisit's original."""
    name = lambda part: f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{key}/{part}')}>"
    uri = ("WARC-Target-URI", _line(url) or "about:blank")
    main, sha1 = name("main"), hashlib.sha1(payload).digest()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    http = [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", _digest_header(sha1))]
    if revisit:
        first = _record("revisit", main, [uri, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To-Target-URI", _line(original) or "about:blank"), ("WARC-Refers-To-Date", DATE), *http], head)
    else:
        first = _record("response", main, [uri, *http], head + payload)
    request = _record("request", name("request"), [uri, ("WARC-Concurrent-To", main), ("Content-Type", "application/http;msgtype=request")], f"GET {uri[1]} HTTP/1.1\r\n\r\n".encode())
    fields = f"page-id: {'' if page_id is None else quote(str(page_id), safe='')}\r\npayload-bytes: {len(payload)}\r\n"
    metadata = _record("metadata", name("metadata"), [uri, ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")], fields.encode())
    return [first, request, metadata]


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        n = int(headers["content-length"])
        yield headers, archive[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def with_originals(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, payload, revisit and original: of equal payloads of LEAST_SHARED bytes or more the largest page_id is the original, the others revisit it (``original`` is its url)."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    small = F.octet_length("payload") < LEAST_SHARED
    large = rows.where(~small).withColumn("digest", F.sha1("payload"))
    shared = stored(large.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("best"), F.count("*").alias("n")).where("n > 1"), "originals")
    joined = spread_join(large, shared.select("digest", "best"), "digest", shared.select("digest", "n"), "left")
    revisit = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best.page_id"))
    whole = rows.where(small).select("page_id", "url", "payload", F.lit(False).alias("revisit"), F.lit(None).cast("string").alias("original"))
    return whole.unionByName(joined.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("best.url")).cast("string").alias("original")))


def write_archives(captures: DataFrame) -> DataFrame:
    """A stored table of archives from page_id, url, payload, revisit and original."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        run_key = 0
        for batch in bounded(batches):
            for row in batch.to_pylist():
                # repeated rows are numbered apart; archives of other tasks differ in the seed
                run_key += 1
                key = f"{row['page_id']}/{row['seed']}/{run_key}"
                for record in capture_records(row["page_id"], key, row["url"], row["payload"], row["original"], row["revisit"]):
                    held.append(gzip.compress(record, 1, mtime=0))
                    size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_pydict({"archive": [b"".join(held)]})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"archive": [b"".join(held)]})

    return stored(captures.withColumn("seed", F.spark_partition_id()).mapInArrow(run, "archive binary"), "archives")


def members(archive: bytes) -> Iterator[bytes]:
    """What each gzip member of an archive holds. Bytes are fed bit by bit, as those behind a member's end come back as a copy."""
    at = 0
    while at < len(archive):
        one, parts = zlib.decompressobj(31), []
        while not one.eof:
            if at >= len(archive):
                raise ValueError("the archive ends within a member")
            fed = archive[at : at + FED_BYTES]
            parts.append(one.decompress(fed))
            at += len(fed) - len(one.unused_data)
        yield b"".join(parts)


def read_records(archives: DataFrame) -> DataFrame:
    """One row per record of the archives, HTTP headers taken off the payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string()) for n in ("warc_type", "record_id", "concurrent_to", "refers_to_uri", "target_uri", "payload_digest")] + [("payload", pa.binary())])
        for batch in bounded(batches):
            for blob in batch.column(0):
                rows = []
                for h, block in (r for m in members(blob.as_py()) for r in parse(m)):
                    payload = block.partition(b"\r\n\r\n")[2] if h.get("content-type", "").startswith("application/http") else block
                    rows.append({"warc_type": h["warc-type"], "record_id": h["warc-record-id"], "concurrent_to": h.get("warc-concurrent-to"), "refers_to_uri": h.get("warc-refers-to-target-uri"), "target_uri": h.get("warc-target-uri"), "payload_digest": _hex(h.get("warc-payload-digest")), "payload": payload})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.mapInArrow(run, _RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: main (response or revisit), request and metadata, joined through concurrent-to identifiers.

    A capture without request or metadata has null there; a record concurrent to
    none that is present is left out. Of several requests or metadata records
    concurrent to one capture each makes a row. An empty table gives an empty
    result; columns beside those named are kept inside ``main``.
    """
    main = records.where("warc_type IN ('response', 'revisit')").select("record_id", F.struct(*[c for c in records.columns if c != "concurrent_to"]).alias("main"))
    part = lambda kind: records.where(F.col("warc_type") == kind).select(F.col("concurrent_to").alias("record_id"), F.struct("record_id", "target_uri", "payload").alias(kind))
    return main.join(part("request"), "record_id", "left").join(part("metadata"), "record_id", "left")


def archived_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Write pages as WARC captures, read them back and report each.

    page_id, payload_bytes, payload_digest (lower-case hex SHA-1), record_type
    (response or revisit), refers_to (for revisits the page_id of the response
    with their payload's digest) and target_uri. Payload digest and length are
    those of the full payload: taken from the bytes of a response and the
    headers and metadata of a revisit. A null html is an empty payload. Repeated
    rows that all have the largest page_id of their payload are all responses; a
    null page_id never is the original unless all are null, and then all are
    responses. An empty table gives an empty result.
    """
    records = read_records(write_archives(with_originals(pages, id_col, html_col, url_col)))
    # whole payloads are only measured here, so they leave before the joins
    fields = F.decode("payload", "UTF-8")
    encoded, size = F.regexp_extract(fields, r"page-id: ([^\r\n]*)", 1), F.regexp_extract(fields, r"payload-bytes: (\d+)", 1)
    response = F.col("warc_type") == "response"
    measured = records.select(
        "warc_type", "record_id", "concurrent_to", "target_uri", "payload_digest", F.when(response, F.octet_length("payload")).alias("own_bytes"), F.when(response, F.sha1("payload")).alias("own_digest"),
        F.when(F.col("warc_type") == "metadata", F.struct(encoded.alias("page_id"), size.alias("bytes"))).alias("payload"),
    )
    nested, main = transactions(stored(measured, "records")), F.col("main")
    id_type = pages.schema[id_col].dataType.simpleString()
    listed = stored(nested.select(
        F.when(F.col("metadata.payload.page_id") != "", F.url_decode("metadata.payload.page_id")).cast(id_type).alias("page_id"), F.coalesce(main["own_bytes"], F.col("metadata.payload.bytes").cast("long")).cast("long").alias("payload_bytes"),
        F.coalesce(main["own_digest"], main["payload_digest"]).alias("payload_digest"), main["warc_type"].alias("record_type"), main["target_uri"].alias("target_uri"),
    ), "transactions")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
    revisits = listed.where("record_type = 'revisit'")
    wanted = revisits.groupBy("payload_digest").agg(F.count("*").alias("n"))
    originals = listed.where(f"record_type = 'response' AND payload_bytes >= {LEAST_SHARED}").groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"))
    found = spread_join(revisits, originals, "payload_digest", wanted, "left").select(*out)
    return listed.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast(id_type)).select(*out).unionByName(found)
