"""WARC archives: a writer, and a splittable reader.

Archives are files of gzip members, one record each. Reading tasks get byte ranges. A task scans its range for gzip
magic, validates a candidate by decoding the start of the member and finding a WARC version line, and owns the records
that start inside its range, decoding past its end where the last one needs it. Behind a member the next one starts: what
doesn't decode there is damage, and so is a file whose records aren't as many as its manifest says.

Writers give every attempt a file name of its own and return it; a manifest table, committed by Spark, lists the files
of the attempts that counted, so lost executors leave no records twice.
"""

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm.common import shared_folder, written

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
SPLIT_BYTES = 8 << 20
ARCHIVE_BYTES = 128 << 20
#: Records carry a fixed date: reruns write equal archives.
DATE = "2020-01-01T00:00:00Z"
_NAMESPACE = "7d1c2a9e"


def record_id(page_id: int | None) -> str:
    """A page's id as a record id, and back (page_of)."""
    low = f"{(page_id or 0) & 0xFFFF_FFFF_FFFF_FFFF:016x}"
    return f"<urn:uuid:{_NAMESPACE}-{int(page_id is None):04x}-4000-{low[:4]}-{low[4:]}>"


def page_of(record: str) -> int | None:
    parts = record.strip("<>").removeprefix("urn:uuid:").split("-")
    if parts[0] != _NAMESPACE:
        raise ValueError(f"not a page's record: {record}")
    low = int(parts[3] + parts[4], 16)
    return None if int(parts[1], 16) else low - (1 << 64) * (low >> 63)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member. A revisit (refers_to given) keeps the HTTP headers and drops the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = "".join(c for c in url or "" if c > " ")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}"]
    lines += [f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def roles(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Adds payload, digest and refers_to (null: response). Of equal payloads of at least least_bytes, that with the
    largest page_id is the response. Null html counts as empty, null ids never are a group's response unless alone.

    Groups are found by ids and digests; payloads meet only their own page's answer, so none gathers at a common digest.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload"))
    ids = pages.where(F.octet_length("payload") >= least_bytes).select("page_id", "digest")
    groups = ids.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    other = ids.join(groups.select("digest", "first"), "digest").where("NOT page_id <=> first").distinct()
    page = [F.coalesce("page_id", F.lit(0)).alias("k"), F.col("page_id").isNull().alias("none"), "digest"]
    asked, known = pages.select("*", *page[:2]), other.select(*page, F.col("first").alias("refers_to"))
    return asked.join(known, ["k", "none", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes records of (page_id, url, payload, refers_to) to archives in folder; returns the manifest (path, bytes, records)."""

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        out, done = None, []
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{at}/{name}", compression=None)
                    done.append([f"{folder}/{name}", 0, 0])
                member = record(page_id, url, payload, refers_to)
                out.write(member)
                done[-1][1] += len(member)
                done[-1][2] += 1
                if done[-1][1] >= archive_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "bytes": [d[1] for d in done], "records": [d[2] for d in done]}, pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return written(pages.select("page_id", "url", "payload", "refers_to").mapInArrow(archived, "path string, bytes long, records long"), "manifest")


def members(file, start: int, end: int, size: int) -> Iterator[bytes]:
    """The decoded members that start in [start, end) of an open file of `size` bytes. ValueError at damage: at the
    file's start, behind a member, and where a member's first bytes decode but the rest doesn't."""
    at, buffer, base = start, bytearray(), start  # buffer holds the file from base on
    follows = start == 0  # a member must stand at `at`

    def upto(to: int) -> bool:
        """Reads until buffer reaches `to` or the file's end; true if it reaches `to`."""
        while base + len(buffer) < min(to, size):
            file.seek(base + len(buffer))
            got = file.read(min(max(CHUNK, to - base - len(buffer)), size - base - len(buffer)))
            if not got:
                raise EOFError(f"file ends before byte {size}")
            buffer.extend(got)
        return base + len(buffer) >= to

    def begins(at: int) -> bool:
        upto(at + 4096)
        head = bytes(buffer[at - base : at - base + 4096])
        try:
            return head.startswith(MAGIC) and zlib.decompressobj(31).decompress(head, 16).startswith(b"WARC/1.")
        except zlib.error:
            return False

    while at < size and (at < end or follows):
        if at - base > 4 * CHUNK:
            del buffer[: at - base]
            base = at
        if not begins(at):
            if follows:
                raise ValueError(f"no record at byte {at}, where one must follow")
            upto(at + 1 + CHUNK)
            hit = buffer.find(MAGIC, at + 1 - base)
            at = base + hit if hit >= 0 else max(at + 1, base + len(buffer) - len(MAGIC) + 1)
            continue
        if at >= end:
            return  # the next range's
        unpack, parts, pos = zlib.decompressobj(31), [], at
        try:
            while not unpack.eof:
                if not upto(pos + 1):
                    raise ValueError(f"the record at byte {at} is cut")
                part = bytes(buffer[pos - base : pos - base + CHUNK])
                parts.append(unpack.decompress(part))
                pos += len(part)
        except zlib.error as e:
            raise ValueError(f"the record at byte {at} is damaged") from e
        at, follows = pos - len(unpack.unused_data), True
        yield b"".join(parts)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields (names in lower case) and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    return fields, rest[: int(fields["content-length"])]


RECORDS = "archive string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read(spark: SparkSession, manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """RECORDS of the archives in manifest (path, bytes, records). A response's digest is computed from what was read and must
    equal its header's; a revisit's digest and length are its header's, its payload null (as all are without payloads).

    The rows are a table in the shared folder, and each archive's must be as many as its manifest says: else ValueError.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("archive", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start")), strict=True):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as file:
                    rows = []
                    for raw in members(file, start, min(start + split_bytes, size), size):
                        fields, block = parsed(raw)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        named = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        length = int(http.lower().split(b"content-length:")[1].split(b"\r\n")[0])
                        whole = fields["warc-type"] == "response"
                        if whole and (hashlib.sha1(payload).hexdigest() != named or len(payload) != length):
                            raise ValueError(f"wrong payload in {fields['warc-record-id']}")
                        refers = page_of(fields["warc-refers-to"]) if not whole else None
                        rows.append((path, page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], refers, length, named, payload if whole and payloads else None))
                        if len(rows) >= 500:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.types, strict=True)], schema=types)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.types, strict=True)], schema=types)

    ranges = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {split_bytes}L)")).alias("start"))
    # a range is a few bytes of plan but megabytes of work, so the number of tasks is given
    found = written(ranges.repartition(max(1, ranges.count())).mapInArrow(records, RECORDS), "records")
    seen = found.groupBy(F.col("archive").alias("path")).agg(F.count("*").alias("seen"))
    wrong = manifest.join(seen, "path", "left").where(F.coalesce("seen", F.lit(0)) != F.col("records")).select("path", "records", "seen").limit(5).collect()
    if wrong:
        raise ValueError(f"archives whose records aren't all there: {wrong}")
    return found


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/archives/{uuid.uuid4().hex}"
