"""Media columns in Ogg: pages with checksums and lacing values, multiplexed logical streams, granule positions.

A payload is stored as unsigned 8-bit mono samples at RATE in one logical stream, next to a stream that names its size.
The reader trusts nothing: it checks page sums and sequence numbers, reassembles packets, and takes times from granules."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import compact, lean, ship, sliced, stored, utf8

RATE, UNIT = 8000, 64
#: Samples in a packet: half a second. Segments in a page at most, by the format.
PACKET, SEGMENTS = 4000, 255
SOUND, NOTE = 0x534E4431, 0x4E4F5445

_HEAD = struct.Struct("<4sBBqIIIB")
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_sum(page: bytes) -> int:
    """The format's CRC (0x04c11db7, most significant bit first, from 0), by zlib's over mirrored bytes."""
    return int(f"{zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = lambda crc: _HEAD.pack(b"OggS", 0, kind, granule, serial, number, crc, len(lacing)) + lacing
    return head(page_sum(head(0) + body)) + body


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream from packets and the granule position after each. The first packet has a page of its own."""
    out, lacing, body, granule, fresh = [], bytearray(), bytearray(), -1, True

    def close(last: bool) -> None:
        nonlocal lacing, body, granule, fresh
        out.append(_page((0 if fresh else 1) | (2 if not out else 0) | (4 if last else 0), granule, serial, len(out), bytes(lacing), bytes(body)))
        lacing, body, granule = bytearray(), bytearray(), -1

    for n, (data, after) in enumerate(packets):
        sizes = [255] * (len(data) // 255) + [len(data) % 255]
        at = 0
        for k, size in enumerate(sizes):
            if len(lacing) == SEGMENTS:
                close(False)
                fresh = k == 0
            lacing.append(size)
            body += data[at : at + size]
            at += size
        granule = after
        if n == 0 and len(packets) > 1:
            close(False)
            fresh = True
    close(True)
    return out


def encode(payload: bytes, n_bytes: int) -> bytes:
    """An Ogg file of a payload: pages of both streams, ordered by time, all first pages before the others."""
    head = struct.pack("<8sIBB", b"\x7fPCMu8\0\0", RATE, 8, 1)
    sound = [(head, 0)] + [(payload[at : at + PACKET], min(at + PACKET, len(payload))) for at in range(0, len(payload), PACKET)]
    note = [(b"\x7fNOTE\0\0\0", 0), (struct.pack("<QQ", n_bytes, len(payload)), 0)]
    a, b = _pages(SOUND, sound), _pages(NOTE, note)
    return b"".join([a[0], b[0], *b[1:], *a[1:]])


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    open: bytearray | None = None
    ended: bool = False


def decode(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number. Raises ValueError at a wrong sum, a gap, or a packet that doesn't end."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < _HEAD.size:
            raise ValueError("page cut off")
        magic, version, kind, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        lacing = data[at + _HEAD.size : at + _HEAD.size + n]
        begin = at + _HEAD.size + n
        end = begin + sum(lacing)
        if magic != b"OggS" or version or len(lacing) < n or end > len(data):
            raise ValueError("not a whole page")
        if page_sum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError("wrong page sum")
        if bool(kind & 2) == (serial in streams):
            raise ValueError("a stream begins twice or not at all")
        s = streams.setdefault(serial, Stream())
        if number != s.pages or s.ended or bool(kind & 1) != (s.open is not None):
            raise ValueError("pages missing or out of order")
        s.pages += 1
        done = 0
        for size in lacing:
            if s.open is None:
                s.open = bytearray()
            s.open += data[begin : begin + size]
            begin += size
            if size < 255:
                s.packets.append(bytes(s.open))
                s.open = None
                done += 1
        s.granules += [-1] * (done - 1) + [granule] * (done > 0)
        s.ended = bool(kind & 4)
        at = end
    if any(s.open is not None or not s.ended for s in streams.values()):
        raise ValueError("a stream doesn't end")
    return streams


def samples(streams: dict[int, Stream]) -> tuple[bytes, int, list[tuple[int, int]]]:
    """The payload, its unpadded size, and (packet index, end in microseconds) for the packets whose page dates them."""
    sound, note = streams[SOUND], streams[NOTE]
    n_bytes, total = struct.unpack("<QQ", note.packets[1])
    payload = b"".join(sound.packets[1:])
    if len(payload) != total or sound.granules[-1] != total:
        raise ValueError("samples missing")
    return payload, n_bytes, [(i - 1, g * 1_000_000 // RATE) for i, g in enumerate(sound.granules) if i and g >= 0]


def features(payload: bytes, streams: dict[int, Stream], dated: list[tuple[int, int]]) -> str:
    """Integer features of the samples and of their layout."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    cross = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"us={dated[-1][1]};pages={sum(s.pages for s in streams.values())};packets={len(streams[SOUND].packets) - 1};mean_milli={int(x.sum() * 1000 // len(x))};power={int((x * x).sum() // len(x))};crossings={cross}"


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media) in a stored table: each text's UTF-8 bytes, filled with 0 to a positive multiple of UNIT, as an Ogg file.

    A null text counts as empty, a null doc_id stays null; repeated rows are stored each; an empty table gives an empty one;
    other columns are ignored."""
    ship(docs.sparkSession)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for lo, texts in sliced(utf8(batch.column(1))):
                media = [encode(t + bytes(-len(t) % UNIT if t else UNIT), len(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return stored(compact(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(files, "doc_id long, media binary"), "ogg")[0]


def describe(media: DataFrame) -> DataFrame:
    """Reads (doc_id, media) files: sizes, sums and features, all from the stored bytes. Null texts count as empty; equal texts give equal values."""
    ship(media.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            out = []
            for data in batch.column(1):
                data = data.as_py()
                streams = decode(data)
                payload, n_bytes, dated = samples(streams)
                out.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), features(payload, streams, dated)))
            cols = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names="doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature".split())

    return compact(media).mapInArrow(rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
