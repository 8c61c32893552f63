import hashlib
import zlib

import pytest

from tributary.llm import media


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1
    return crc


def test_checksum_matches_the_bitwise_definition():
    for data in (b"", b"a", b"OggS" + bytes(range(256)) * 3):
        assert media.ogg_crc(data) == slow_crc(data)


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 28 * 576, 28 * 576 + 1, 254, 255, 70_000, 300_000])
def test_round_trip(n):
    data = bytes((i * 7 + i // 251) % 256 for i in range(n))
    sound = media.decode(media.encode(media.padded(data)))
    assert sound.samples == media.padded(data) and len(sound.samples) % 576 == 0 and len(sound.samples)
    assert sound.times[-1] == len(sound.samples) / media.RATE
    assert [t for t, _ in sound.notes] == [k for k in range(-(-len(sound.samples) // media.RATE))]


def test_long_packets_go_over_pages_and_exact_multiples_end():
    w = media.OggWriter()
    sizes = [0, 255, 510, 255 * 255, 255 * 255 + 1, 200_000]
    for k, n in enumerate(sizes):
        w.packet(9, bytes([k]) * n, k, last=k == len(sizes) - 1)
    got = media.read_packets(w.bytes())
    assert [len(p.data) for p in got] == sizes and [p.granule for p in got] == list(range(len(sizes))) and got[-1].last


def test_several_packets_on_a_page():
    import struct

    lacing = bytes([3, 0, 255, 2])
    page = struct.pack("<4sBBqIIIB", b"OggS", 0, 6, 77, 5, 0, 0, len(lacing)) + lacing + b"abc" + b"x" * 257
    page = page[:22] + struct.pack("<I", media.ogg_crc(page)) + page[26:]
    got = media.read_packets(page)
    assert [p.data for p in got] == [b"abc", b"", b"x" * 257] and [p.granule for p in got] == [None, None, 77]


def test_damage_is_found():
    good = media.encode(media.padded(b"some text" * 9000))
    for i in (0, 5, 30, 200, len(good) // 2, len(good) - 1):
        bad = bytearray(good)
        bad[i] ^= 1
        with pytest.raises(media.OggError):
            media.decode(bytes(bad))
    with pytest.raises(media.OggError):
        media.decode(good[:-10])
    w = media.OggWriter()
    w.packet(1, b"zz", 0)
    with pytest.raises(media.OggError):
        media.decode(w.bytes())


def test_columns(docs):
    texts = [None, "", "a", "Grüße" * 400, "x" * 576, "y" * 130_000, "a"]
    ids = [0, 1, 2, 3, 4, 5, 2]
    rows = media.media_features(media.to_media(docs(texts, ids=ids))).collect()
    assert len(rows) == len(texts)
    by = {r.doc_id: r for r in rows}
    for i, t in zip(ids, texts, strict=True):
        data = (t or "").encode()
        full = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        r = by[i]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(full))
        assert r.payload_sha256 == hashlib.sha256(full).hexdigest() and r.tail_crc32 == zlib.crc32(full[-32:])
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id == 2}) == 1 and by[0].feature == by[1].feature
    assert media.to_media(docs(["x"]).where("false")).count() == 0
