"""Media columns in the Ogg container: pages with checksums, packets with lacing values, several logical streams."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_bytes

#: Samples of a packet; a payload is a positive multiple of it.
BLOCK = 576
RATE = 8000
#: Payload blocks go to the tracks in turn.
TRACKS = (1, 2)
HEADER = b"pcm8"
#: The head of a page: magic, version, flags, granule position, serial number, page number, checksum, number of lacing values.
HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """The container's CRC-32: polynomial 0x04c11db7, highest bit first, nothing inverted.

    zlib's takes bits lowest first and inverts at both ends; with every byte's bits reversed and the inversions undone it is the same sum.
    """
    low_first = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{low_first:032b}"[::-1], 2)


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    blank = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return blank[:22] + struct.pack("<I", checksum(blank)) + blank[26:]


def lacing(size: int) -> bytes:
    """Lacing values of a packet: 255 for each full segment, and a last one below 255."""
    return b"\xff" * (size // 255) + bytes([size % 255])


def mux(payload: bytes) -> bytes:
    """The payload as 8-bit samples, a block a packet, dealt in turn to the tracks; pages of the tracks alternate.

    A granule position is the number of samples of the whole sound up to the end of the page's last finished packet, so that pages
    of all tracks are on one clock; -1 where no packet ends.
    """
    blocks = [payload[i : i + BLOCK] for i in range(0, len(payload), BLOCK)]
    out = []
    number = dict.fromkeys(TRACKS, 0)
    for t in TRACKS:
        head = HEADER + struct.pack("<IIB", RATE, BLOCK, t)
        out.append(_page(FIRST, 0, t, 0, lacing(len(head)), head))
        number[t] = 1
    waiting = {t: [(i, b) for i, b in enumerate(blocks) if i % len(TRACKS) == k] for k, t in enumerate(TRACKS)}
    segments = {t: [(min(255, len(b) - 255 * s), b[255 * s : 255 * s + 255], (i + 1) * BLOCK if s == len(b) // 255 else -1) for i, b in waiting[t] for s in range(len(b) // 255 + 1)] for t in TRACKS}
    at = dict.fromkeys(TRACKS, 0)
    going = list(TRACKS)
    while going:
        for t in list(going):
            part = segments[t][at[t] : at[t] + 255]
            inside = at[t] > 0 and segments[t][at[t] - 1][2] < 0
            at[t] += 255
            last = at[t] >= len(segments[t])
            ends = [g for _, _, g in part if g >= 0]
            granule = ends[-1] if ends else -1 if part else 0
            out.append(_page(CONTINUED * inside | LAST * last, granule, t, number[t], bytes(n for n, _, _ in part), b"".join(b for _, b, _ in part)))
            number[t] += 1
            if last:
                going.remove(t)
    return b"".join(out)


def pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(flags, granule, serial, number, lacing values, body) of each page; a wrong magic, length or checksum raises ValueError."""
    at = 0
    while at < len(media):
        if len(media) - at < HEAD.size:
            raise ValueError("the last page is cut off")
        magic, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(media, at)
        lace = media[at + HEAD.size : at + HEAD.size + n]
        end = at + HEAD.size + n + sum(lace)
        if magic != b"OggS" or version or end > len(media):
            raise ValueError(f"no page at byte {at}")
        page = media[at:end]
        if checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise ValueError(f"page {number} of stream {serial} has a wrong checksum")
        yield flags, granule, serial, number, lace, page[HEAD.size + n :]
        at = end


def demux(media: bytes) -> dict[int, list[tuple[int, bytes]]]:
    """Packets of each logical stream, each with the samples of the whole sound up to its end; headers have 0.

    A packet's segments may go on over pages. A page's granule position belongs to the last packet that ends on it; packets before it
    on the page end a turn of all tracks earlier each. Lost pages, wrong continuations, and streams without their last page or going on after it raise ValueError.
    """
    streams: dict[int, list[tuple[int, bytes]]] = {}
    open_: dict[int, bytes] = {}
    following: dict[int, int] = {}
    finished: set[int] = set()
    for flags, granule, serial, number, lace, body in pages(media):
        if bool(flags & FIRST) != (serial not in streams) or number != following.get(serial, 0):
            raise ValueError(f"page {number} of stream {serial} is out of order")
        if serial in finished:
            raise ValueError(f"stream {serial} goes on after its last page")
        following[serial] = number + 1
        if bool(flags & CONTINUED) != (serial in open_):
            raise ValueError(f"page {number} of stream {serial} does not continue the page before")
        packet, ended, at = open_.pop(serial, b""), [], 0
        whole = True
        for n in lace:
            packet += body[at : at + n]
            at += n
            whole = n < 255
            if whole:
                ended.append(packet)
                packet = b""
        if not whole:
            open_[serial] = packet
        turn = BLOCK * len(TRACKS)
        found = streams.setdefault(serial, [])
        found += [(max(0, granule - turn * (len(ended) - 1 - i)), p) for i, p in enumerate(ended)]
        if flags & LAST:
            finished.add(serial)
            if serial in open_:
                raise ValueError(f"stream {serial} ends inside a packet")
    if unfinished := set(streams) - finished:
        raise ValueError(f"streams {sorted(unfinished)} have no last page")
    return streams


def read(media: bytes) -> tuple[bytes, list[float]]:
    """The payload, from the blocks of all tracks in the order of their time, and the seconds at which each block starts."""
    streams = demux(media)
    if any(not packets or not packets[0][1].startswith(HEADER) for packets in streams.values()):
        raise ValueError("a stream has no header")
    blocks = sorted((end, p) for packets in streams.values() for end, p in packets[1:])
    return b"".join(p for _, p in blocks), [(end - BLOCK) / RATE for end, _ in blocks]


def features(payload: bytes, starts: list[float]) -> str:
    """Loudness, its loudest time, crossings of the middle, and energy in eight bands of the mean spectrum of the blocks."""
    samples = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    frames = samples.reshape(-1, BLOCK)
    power = np.square(frames).mean(axis=1, dtype=np.float64)
    crossings = int((np.signbit(samples[1:]) != np.signbit(samples[:-1])).sum())
    spectrum = np.zeros(BLOCK // 2)
    for i in range(0, len(frames), 256):
        spectrum += (np.abs(np.fft.rfft(frames[i : i + 256], axis=1)[:, 1:]) ** 2).sum(axis=0, dtype=np.float64)
    bands = spectrum.reshape(8, -1).sum(axis=1)
    shares = bands / bands.sum() if bands.sum() else bands
    loudest = starts[int(power.argmax())]
    return f"rms={np.sqrt(power.mean()):.4f} peak_s={loudest:.3f} seconds={len(samples) / RATE:.3f} crossings={crossings} bands=" + ",".join(f"{x:.4f}" for x in shares)


def padded(data: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of BLOCK."""
    return data + b"\xff" * (max(1, -(-len(data) // BLOCK)) * BLOCK - len(data))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature[, media]) of every row.

    The text's bytes are padded, written as an Ogg file of two tracks and read back from it; sums and features are of what was read. A null text counts
    as empty. Nothing but the text goes into the file, so equal texts give equal rows. Rows are mapped one by one, one file at a time.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), text_bytes(batch, "text"), strict=True):
                media = mux(padded(data))
                payload, starts = read(media)
                sums = hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest()
                rows.append((doc_id, len(data), len(payload), *sums, features(payload, starts), *([media] if keep_media else [])))
                if len(rows) == 256:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, schema + ", media binary" * keep_media)


TYPES = {
    "doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(),
    "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "media": pa.binary(),
}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = list(TYPES.items())[: len(rows[0])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])
