import hashlib
import struct
import zlib

import pytest

from ledgerloom.llm import ogg


def plain_checksum(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    for data in (b"", b"a", bytes(range(256)) * 3):
        assert ogg.checksum(data) == plain_checksum(data)


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 1152, 576 * 85, 576 * 171 + 3, 300_000])
def test_round_trip_and_times(n):
    payload = ogg.padded(bytes(i * 7 % 256 for i in range(n)))
    media = ogg.mux(payload)
    back, starts = ogg.read(media)
    assert back == payload
    assert starts == [i * ogg.BLOCK / ogg.RATE for i in range(len(payload) // ogg.BLOCK)]
    assert len(ogg.demux(media)) == 2


def test_packets_over_pages():
    body = b"\x07" * 255
    first = ogg._page(ogg.FIRST, -1, 9, 0, b"\xff", body)
    second = ogg._page(ogg.CONTINUED | ogg.LAST, 576, 9, 1, b"\x05", b"hello")
    assert ogg.demux(first + second) == {9: [(576, body + b"hello")]}
    with pytest.raises(ValueError, match="does not continue"):
        ogg.demux(first + ogg._page(ogg.LAST, 576, 9, 1, b"\x05", b"hello"))
    with pytest.raises(ValueError, match="out of order"):
        ogg.demux(second)


def test_damage_is_found():
    media = ogg.mux(ogg.padded(b"some text" * 100))
    with pytest.raises(ValueError, match="checksum"):
        ogg.read(media[:200] + b"\x01" + media[201:])
    with pytest.raises(ValueError):
        ogg.read(media[:-1])


def test_query(spark):
    texts = ["", None, "a", "é" * 288, "x" * 100_000, "a", "b c\n" * 500]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, "z", 1)], "doc_id long, text string, media long")
    rows = {r.doc_id: r for r in ogg.media_columns(docs, keep_media=True).collect()}
    assert len(rows) == 8
    for i, t in enumerate(texts):
        r, data = rows[i], (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (576 if not data else 0))
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert struct.unpack_from("<4s", r.media)[0] == b"OggS"
    assert rows[2][1:] == rows[5][1:] and rows[0][1:] == rows[1][1:]
    assert ogg.media_columns(docs.limit(0)).collect() == []


def test_files_cut_at_a_page_are_refused():
    media = ogg.mux(bytes(range(256)) * 9 * 64 * 4)
    cuts, at = [], 0
    for *_, lace, body in ogg.pages(media):
        at += ogg.HEAD.size + len(lace) + len(body)
        cuts.append(at)
    assert cuts[-1] == len(media) and len(cuts) > 6
    for cut in cuts[:-1]:
        with pytest.raises(ValueError):
            ogg.read(media[:cut])
    *_, lace, body = list(ogg.pages(media))[-1]
    with pytest.raises(ValueError):
        ogg.read(media + media[cuts[-2] :])
