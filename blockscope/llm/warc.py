"""WARC archives: written as text files by Spark, read back by a reader that survives damage.

An archive is a text file whose lines end where records end, so any file system Spark can
write takes it.  The reader checks each record's length, end and digests; after a failed
check it looks for the next gzip member or version line, goes on from the first that holds,
and reports the bytes between as a quarantined gap.
"""

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockscope.llm.common import stored

VERSION = "WARC/1.1"
#: Payloads of fewer bytes are always stored whole.
LEAST_REVISIT = 100
#: Bytes of records in an archive file at most, but for a file of one record; the reader holds one file at a time.
ARCHIVE_BYTES = 32 << 20
#: Payloads with copies whose first page is broadcast at most; more are met by a shuffled join.
MOST_COPIED = 200_000
#: Records up to so many bytes share a class of sizes; each further class goes eight times as far.
LEAST_CLASS = 8 << 10
#: Bytes of a record's head at most, without its url.
HEAD_BYTES = 1_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CRLF = "\r\n"

START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_PAGE = re.compile(r"<urn:page:(.*):[0-9a-f]{16}>")


# --- writing -----------------------------------------------------------------------------------
def record_id(page: Column, digest: Column) -> Column:
    """A page's id and the first half-word of its payload's digest, as a URN."""
    return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(":"), F.substring(digest, 1, 16), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def hashed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page, url, payload, bytes, digest) of each page."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(
        F.col(id_col).alias("page"),
        F.regexp_replace(F.col(url_col), "[\\r\\n]+", " ").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).alias("bytes"),
        F.sha2(payload.cast("binary"), 256).alias("digest"),
    )


def first_pages(rows: DataFrame) -> DataFrame:
    """(digest, first): payloads of ``LEAST_REVISIT`` bytes or more that several pages have, and their least id.

    Stored, so that pages are hashed and grouped for it once; marked for broadcast if few.
    """
    long = rows.where(F.col("bytes") >= LEAST_REVISIT)
    first = long.groupBy("digest").agg(F.min("page").alias("first"), F.max("page").alias("last"))
    first = stored(first.where(F.col("first") != F.col("last")).drop("last"), "first-pages")
    return F.broadcast(first) if first.limit(MOST_COPIED + 1).count() <= MOST_COPIED else first


def records_of(rows: DataFrame, first: DataFrame, date: str) -> DataFrame:
    """(record): each page as a response, or as a revisit of the first page with its payload.

    ``rows`` are ``hashed`` pages.  The last line feed of a record is left to the writer.
    """
    rows = rows.join(first, "digest", "left")
    again = (F.col("bytes") >= LEAST_REVISIT) & (F.col("page") != F.col("first"))
    again = F.coalesce(again, F.lit(False))
    shared = F.concat(
        _field("WARC-Record-ID", record_id(F.coalesce(F.col("page").cast("string"), F.lit("")), F.col("digest"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _field("X-Payload-Length", F.col("bytes").cast("string")),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
    )
    head = len(HTTP_HEAD)
    response = F.concat(
        F.lit(f"{VERSION}{CRLF}WARC-Type: response{CRLF}"),
        shared,
        _field("Content-Length", (F.col("bytes") + head).cast("string")),
        F.lit(CRLF + HTTP_HEAD),
        F.col("payload"),
        F.lit("\r\n\r"),
    )
    revisit = F.concat(
        F.lit(f"{VERSION}{CRLF}WARC-Type: revisit{CRLF}"),
        shared,
        _field("WARC-Profile", F.lit(REVISIT_PROFILE)),
        _field("WARC-Refers-To", record_id(F.col("first"), F.col("digest"))),
        F.lit(f"Content-Length: {head}{CRLF}{CRLF}{HTTP_HEAD}\r\n\r"),
    )
    return rows.select(F.when(again, revisit).otherwise(response).alias("record"))


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Archive files below ``path``, one record per page row, each of ``ARCHIVE_BYTES`` at most or of one record.

    Null html is an empty payload; null urls and ids leave their field out or empty.  Of equal
    payloads long enough the rows with the least id are responses, all others revisits; rows
    with a null id are responses.  No page moves unless very many payloads have copies.

    Files are cut by the number of records, so records of like size share files: one write for
    each class of sizes that occurs, with as many records as its largest allows.
    """
    rows = hashed(pages, id_col, url_col, html_col)
    rows = rows.withColumn("size", F.col("bytes") + F.coalesce(F.octet_length("url"), F.lit(0)) + HEAD_BYTES)
    over = F.greatest(F.col("size") / LEAST_CLASS, F.lit(1.0))
    rows = rows.withColumn("class", F.ceil(F.log2(over) / 3).cast("int"))
    # a row per class: sizes below 2 GB have seven
    classes = rows.groupBy("class").agg(F.max("size").alias("largest")).orderBy("class").collect()
    first = first_pages(rows)
    for number, largest in classes or [(0, ARCHIVE_BYTES)]:
        some = rows if len(classes) <= 1 else rows.where(F.col("class") == number)
        per_file = max(1, ARCHIVE_BYTES // largest)
        writer = records_of(some, first, date).write.mode("append")
        writer.option("lineSep", "\n").option("maxRecordsPerFile", per_file).text(path)


# --- reading -----------------------------------------------------------------------------------
class Damage(ValueError):
    """Why bytes are not a record."""


def _digest_holds(field: str, data: bytes) -> bool:
    """Whether a digest field (hexadecimal or base 32) fits; an unknown algorithm is not checked."""
    name, _, value = field.partition(":")
    if name.lower().replace("-", "") not in ("sha1", "sha256", "md5"):
        return True
    digest = hashlib.new(name.lower().replace("-", ""), data)
    return value.lower() in (digest.hexdigest(), base64.b32encode(digest.digest()).decode().lower())


def record_at(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Fields, payload and end of the record that starts at a version line, or ``Damage``."""
    if not data.startswith(b"WARC/1.", at):
        raise Damage("no version line")
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        raise Damage("fields do not end")
    fields: dict[str, str] = {}
    for line in data[at:head_end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damage("line without a field")
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damage("no length")
    start, end = head_end + 4, head_end + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damage("block does not end at its length")
    block = data[start:end]
    if not _digest_holds(fields.get("warc-block-digest", ""), block):
        raise Damage("block digest")
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    kind = fields.get("warc-type")
    if kind != "revisit" and not _digest_holds(fields.get("warc-payload-digest", ""), payload):
        raise Damage("payload digest")
    return fields, payload, end + 4


def member_at(data: bytes, at: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at a place, or ``Damage``."""
    inflate = zlib.decompressobj(31)
    try:
        content = inflate.decompress(memoryview(data)[at:])
    except zlib.error as error:
        raise Damage(f"member: {error}") from None
    if not inflate.eof:
        raise Damage("member is cut off")
    return content, len(data) - len(inflate.unused_data)


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, dict[str, str], bytes]]:
    """(offset, end, reason, fields, payload) in file order; a gap has a reason and no record.

    Records of a gzip member have the member's offsets, and so have gaps inside it.
    """
    at, gap, reason = 0, None, None
    while at < len(data):
        found = []
        try:
            if data.startswith(b"\x1f\x8b", at):
                content, end = member_at(data, at)
                for _, _, why, fields, payload in salvage(content):
                    found.append((at, end, why, fields, payload))
            else:
                fields, payload, end = record_at(data, at)
                found.append((at, end, None, fields, payload))
        except Damage as damage:
            if gap is None:
                gap, reason = at, str(damage)
            following = START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield gap, at, reason, {}, b""
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield gap, len(data), reason, {}, b""


READ = (
    "path string, offset long, size long, gap string, record_type string, record_id string, "
    "target_uri string, refers_to string, payload_bytes long, payload_digest string, fields map<string,string>"
)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record, and one per gap with the reason in ``gap``.

    Digest (SHA-256) and size are those of the payload read; of a revisit those its fields
    state.  ``payloads`` adds the payload itself.  A task holds one archive file at a time.
    An empty file has no rows.
    """
    kinds = [
        ("path", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("gap", pa.string()),
        ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
        ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("fields", pa.map_(pa.string(), pa.string())),
    ]
    if payloads:
        kinds.append(("payload", pa.binary()))
    names = pa.schema(kinds)

    def row(path: str, offset: int, end: int, gap: str | None, fields: dict, payload: bytes) -> dict:
        out = {"path": path, "offset": offset, "size": end - offset, "gap": gap}
        if gap is None:
            size, digest = len(payload), None
            if fields.get("warc-type") == "revisit":
                stated = fields.get("x-payload-length", "")
                size = int(stated) if stated.isascii() and stated.isdigit() else None
                digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
            out |= {
                "record_type": fields.get("warc-type"),
                "record_id": fields.get("warc-record-id"),
                "target_uri": fields.get("warc-target-uri"),
                "refers_to": fields.get("warc-refers-to"),
                "payload_bytes": size,
                "payload_digest": digest or hashlib.sha256(payload).hexdigest(),
                "fields": list(fields.items()),
                "payload": payload,
            }
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                held, size = [], 0
                for found in salvage(content.as_py() or b""):
                    held.append(row(path.as_py(), *found))
                    size += len(found[4]) if payloads else 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=names)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, READ + (", payload binary" if payloads else ""))


def page_of(record: Column) -> Column:
    """The page id in a record id, null if the page had none."""
    found = F.regexp_extract(record, _PAGE.pattern, 1)
    return F.when(found != "", found)
