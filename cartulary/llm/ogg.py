"""Ogg as a media column: writing byte payloads as multiplexed logical streams, and reading them back.

Reading verifies every page's checksum and sequence number, reassembles packets from lacing values across pages,
demultiplexes logical streams by serial number, and derives timestamps from granule positions.

A payload's samples are unsigned 8-bit mono at RATE. Blocks of BLOCK samples go to the logical streams in turn, one
packet each; a stream's first packet is its header. A page's granule position is the number of samples, counted over
the whole payload, up to the end of the last packet that ends on it, and -1 where none ends.
"""

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import small

RATE, BLOCK, SERIALS = 8000, 4096, (0x0A17, 0x0B29)
#: Segments of at most 255 bytes on a page.
PAGE_SEGMENTS = 64
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = "<4sBBqIIIB"  # 27 bytes
_CODEC = b"\x7fU8\x00"


def checksum(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 0x04C11DB7, no reflection, no inversion), by the reflected one over reversed bits."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{crc:032b}"[::-1], 2)


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack(_HEAD, b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    crc = checksum(head + lacing + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + lacing + body


def stream_pages(packets: list[tuple[bytes, int]], serial: int) -> Iterator[tuple[int, bytes]]:
    """(granule order, page) of one logical stream. packets: (bytes, granule at their end); the first has a page of its own."""
    segments: list[tuple[bytes, int]] = []  # (segment, granule if a packet ends with it)
    firsts = 0
    for k, (packet, granule) in enumerate(packets):
        for i in range(0, len(packet) + 1, 255):
            part = packet[i : i + 255]
            segments.append((part, granule if len(part) < 255 else -1))
        if k == 0:
            firsts = len(segments)
    at, number, order = 0, 0, 0
    while at < len(segments):
        end = firsts if at == 0 else min(at + PAGE_SEGMENTS, len(segments))
        run = segments[at:end]
        granule = max(g for _, g in run)
        flags = (1 if at and segments[at - 1][1] < 0 else 0) | (2 if at == 0 else 0) | (4 if end == len(segments) else 0)
        order = max(order, granule)
        yield order, page(flags, granule, serial, number, bytes(len(s) for s, _ in run), b"".join(s for s, _ in run))
        at, number = end, number + 1


def write(payload: bytes) -> bytes:
    """The payload as an Ogg file of len(SERIALS) logical streams, pages in the order of their granules."""
    streams = []
    for k, serial in enumerate(SERIALS):
        packets = [(_CODEC + struct.pack("<IIHHQ", RATE, BLOCK, k, len(SERIALS), len(payload)), 0)]
        packets += [(payload[i : i + BLOCK], min(i + BLOCK, len(payload))) for i in range(k * BLOCK, len(payload), len(SERIALS) * BLOCK)]
        streams.append(list(stream_pages(packets, serial)))
    heads = [s[0][1] for s in streams]
    rest = sorted(((g, k, i, p) for k, s in enumerate(streams) for i, (g, p) in enumerate(s[1:])), key=lambda x: x[:3])
    return b"".join([*heads, *(p for *_, p in rest)])


def pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(flags, granule, serial, number, lacing, body) of each page; ValueError where a page or its checksum is wrong."""
    at = 0
    while at < len(media):
        if len(media) - at < 27:
            raise ValueError(f"cut page at byte {at}")
        magic, version, flags, granule, serial, number, crc, count = struct.unpack_from(_HEAD, media, at)
        lacing = media[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(lacing)
        if magic != b"OggS" or version or end > len(media):
            raise ValueError(f"no page at byte {at}")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"wrong checksum at byte {at}")
        yield flags, granule, serial, number, lacing, media[at + 27 + count : end]
        at = end


def demultiplex(media: bytes) -> dict[int, list[tuple[bytes, float | None]]]:
    """Packets of each logical stream by serial: (bytes, seconds at their end; None unless the packet is its page's last)."""
    found: dict[int, list] = {}
    state: dict[int, tuple[int, bytes | None, bool]] = {}  # next page's number, unfinished packet, ended
    for flags, granule, serial, number, lacing, body in pages(media):
        first = serial not in state
        due, open_packet, ended = state.get(serial, (0, None, False))
        if number != due or ended or first != bool(flags & 2) or (open_packet is not None) != bool(flags & 1):
            raise ValueError(f"page {number} of stream {serial:#x} is out of order")
        out, parts, at = found.setdefault(serial, []), [open_packet or b""], 0
        unfinished = open_packet is not None
        for n in lacing:
            parts.append(body[at : at + n])
            at, unfinished = at + n, n == 255
            if n < 255:
                out.append([b"".join(parts), None])
                parts = []
        if granule >= 0 and out:
            out[-1][1] = granule / RATE
        state[serial] = (number + 1, b"".join(parts) if unfinished else None, bool(flags & 4))
    if any(rest is not None or not ended for _, rest, ended in state.values()):
        raise ValueError("a stream doesn't end")
    return {k: [tuple(p) for p in v] for k, v in found.items()}


def read(media: bytes) -> tuple[bytes, dict]:
    """The payload, and what was seen: pages, streams, packets, and seconds by the last granule. Timestamps that don't
    agree with the samples before them raise ValueError."""
    streams = demultiplex(media)
    by_turn, total, timed, last = {}, 0, True, 0.0
    for packets in streams.values():
        if packets[0][0][:4] != _CODEC:
            raise ValueError("unknown stream header")
        _, block, k, of, total = struct.unpack("<IIHHQ", packets[0][0][4:])
        for i, (packet, seconds) in enumerate(packets[1:]):
            start = (i * of + k) * block
            by_turn[start] = packet
            if seconds is not None:
                timed &= seconds == (start + len(packet)) / RATE
                last = max(last, seconds)
    payload = b"".join(by_turn[k] for k in sorted(by_turn))
    if len(payload) != total or not timed:
        raise ValueError("samples or timestamps don't agree")
    n = sum(map(len, streams.values()))
    return payload, {"pages": sum(1 for _ in pages(media)), "streams": len(streams), "packets": n, "seconds": last}


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def stored(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep`, n_bytes and the media column: each whole text (null: empty), padded with zeros to a positive
    multiple of 64, as an Ogg file. An empty table gives none; equal texts give equal media."""
    keep = [c for c in keep if c not in ("n_bytes", "media")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = [padded(t) for t in batch.column("__text").to_pylist()]
            columns = [pa.array([n for n, _ in rows], pa.int64()), pa.array([write(p) for _, p in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, "n_bytes", "media"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_bytes long, media binary"])
    return docs.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(made, schema)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame, keep: list[str], column: str = "media") -> DataFrame:
    """Columns `keep` and FEATURES of a media column, all from the bytes read back. Damaged media raise ValueError."""
    keep = [c for c in keep if c not in FEATURES.replace(",", "").split()[::2]]

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for raw in batch.column("__media").to_pylist():
                payload, got = read(raw)
                said = f"ogg:{got['streams']} streams,{got['pages']} pages,{got['packets']} packets,{got['seconds']:.6f} s"
                tail = zlib.crc32(payload[-64:])
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), tail, len(raw), hashlib.sha256(raw).hexdigest(), said))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)]
            names = FEATURES.replace(",", "").split()[::2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, *names])

    schema = ", ".join([*(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep), FEATURES])
    return media.select(*keep, F.col(column).alias("__media")).mapInArrow(seen, schema)
