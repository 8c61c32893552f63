"""Media columns: bytes held as 8-bit samples in Ogg files, and features read back from them.

An Ogg file here multiplexes two logical streams: PCM samples (an
identification packet, then packets of whole frames; granule positions count
samples) and text notes, one packet per second of sound (granule positions
count milliseconds). Reading verifies every page's checksum and sequence
number, reassembles packets from lacing values, tells the streams apart by
serial number and takes time stamps from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import arrow, pieces, prepare, rows_of, text_of

FRAME = 576
RATE = 16_000
#: Payload bytes in a packet: 28 frames, so that a page of one packet stays under its limit of 255 lacing values.
PACKET = 28 * FRAME
PCM, NOTES = 0x50434D31, 0x4E4F5445
PCM_HEAD = struct.Struct("<8sHHIIBB6x")
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    pass


def ogg_crc(page: bytes) -> int:
    """Ogg's checksum (0x04C11DB7, most significant bit first, from 0): the mirrored CRC-32 of mirrored bytes."""
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "big").translate(_MIRROR), "little")


@dataclass
class Packet:
    serial: int
    data: bytes
    #: Granule position of the page on which the packet ends; None for one that others follow there.
    granule: int | None
    first: bool = False
    last: bool = False


class OggWriter:
    def __init__(self) -> None:
        self.pages: list[bytes] = []
        self.sequence: dict[int, int] = {}

    def packet(self, serial: int, data: bytes, granule: int, last: bool = False) -> None:
        """Writes a packet on pages of its own; a long one goes on over several, an exact multiple of 255 ends with a 0."""
        lacing = [255] * (len(data) // 255) + [len(data) % 255]
        at = 0
        for i in range(0, len(lacing), 255):
            part = lacing[i : i + 255]
            size, ends = sum(part), i + 255 >= len(lacing)
            n = self.sequence.get(serial, 0)
            self.sequence[serial] = n + 1
            flags = (1 if i else 0) | (2 if n == 0 else 0) | (4 if last and ends else 0)
            head = struct.pack("<4sBBqIIIB", b"OggS", 0, flags, granule if ends else -1, serial, n, 0, len(part)) + bytes(part)
            page = head + data[at : at + size]
            self.pages.append(page[:22] + struct.pack("<I", ogg_crc(page)) + page[26:])
            at += size

    def bytes(self) -> bytes:
        return b"".join(self.pages)


def read_packets(media: bytes) -> list[Packet]:
    """All packets in the order in which they end. Raises OggError on a bad page, checksum, gap or unfinished packet."""
    out: list[Packet] = []
    open_: dict[int, list[bytes]] = {}
    following: dict[int, int] = {}
    at = 0
    while at < len(media):
        if len(media) < at + 27 or media[at : at + 4] != b"OggS" or media[at + 4] != 0:
            raise OggError(f"no page at byte {at}")
        flags, granule, serial, sequence, crc, n = struct.unpack_from("<BqIIIB", media, at + 5)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise OggError("the last page is cut off")
        page = media[at:end]
        if ogg_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        if sequence != following.get(serial, 0) or bool(flags & 2) != (sequence == 0):
            raise OggError(f"page {sequence} of stream {serial:x} is out of sequence")
        following[serial] = sequence + 1
        if bool(flags & 1) != (serial in open_):
            raise OggError("a continued packet is missing its start or its end")
        parts, here = open_.pop(serial, []), at + 27 + n
        last: Packet | None = None
        for size in lacing:
            parts.append(media[here : here + size])
            here += size
            if size < 255:
                last = Packet(serial, b"".join(parts), None, first=sequence == 0)
                out.append(last)
                parts = []
        if lacing and lacing[-1] == 255:
            open_[serial] = parts
        if last is not None:
            last.granule, last.last = granule, bool(flags & 4) and serial not in open_
        at = end
    if open_:
        raise OggError("the last packet is cut off")
    return out


@dataclass
class Sound:
    rate: int
    samples: bytes
    #: Second at which each packet of samples ends.
    times: list[float] = field(default_factory=list)
    #: (second, text)
    notes: list[tuple[float, str]] = field(default_factory=list)


def encode(payload: bytes, rate: int = RATE, notes: list[tuple[float, str]] | None = None) -> bytes:
    """payload as unsigned 8-bit samples, one channel."""
    out = OggWriter()
    starts = list(range(0, len(payload), PACKET))
    marks = sorted(notes if notes is not None else [(s / rate, f"sample {s}") for s in range(0, len(payload), rate)])
    out.packet(PCM, PCM_HEAD.pack(b"PCM     ", 0, 0, 1, rate, 8, 1), 0, last=not starts)
    out.packet(NOTES, b"NOTES\0\0\0" + struct.pack("<I", 1000), 0, last=not marks)
    held = [(t, 1, s) for s in starts for t in [min(s + PACKET, len(payload)) / rate]] + [(t, 0, x) for t, x in marks]
    left = {0: len(marks), 1: len(starts)}
    for t, kind, x in sorted(held, key=lambda y: (y[0], y[1])):
        left[kind] -= 1
        if kind:
            out.packet(PCM, payload[x : x + PACKET], min(x + PACKET, len(payload)), last=not left[1])
        else:
            out.packet(NOTES, x.encode(), round(t * 1000), last=not left[0])
    return out.bytes()


def decode(media: bytes) -> Sound:
    """The streams of a file, told apart by what their first packets say. Every stream must end with its last flag."""
    rate, unit, sound, samples = {}, {}, Sound(0, b""), []
    over: dict[int, bool] = {}
    for p in read_packets(media):
        if over.get(p.serial):
            raise OggError("a packet follows the end of its stream")
        over[p.serial] = p.last
        if p.serial not in rate and p.serial not in unit:
            if p.data.startswith(b"PCM     ") and len(p.data) >= PCM_HEAD.size:
                _, _, _, form, hz, bits, channels = PCM_HEAD.unpack_from(p.data)
                if (form, bits, channels) != (1, 8, 1) or rate:
                    raise OggError("not one stream of unsigned 8-bit samples of one channel")
                rate[p.serial] = sound.rate = hz
            elif p.data.startswith(b"NOTES\0\0\0"):
                (unit[p.serial],) = struct.unpack_from("<I", p.data, 8)
            else:
                raise OggError(f"stream {p.serial:x} is of no known kind")
        elif p.serial in rate:
            samples.append(p.data)
            if p.granule is not None:
                sound.times.append(p.granule / rate[p.serial])
        else:
            sound.notes.append((p.granule / unit[p.serial], p.data.decode()))
    if not all(over.values()):
        raise OggError("a stream has no end")
    sound.samples = b"".join(samples)
    if sound.times and round(sound.times[-1] * sound.rate) != len(sound.samples):
        raise OggError("the last granule position is not the number of samples")
    return sound


def features(sound: Sound) -> str:
    """Duration, level, zero crossings and spectral centroid of whole frames, as a short string."""
    x = np.frombuffer(sound.samples, np.uint8).astype(np.float32) - 128
    frames = x[: len(x) // FRAME * FRAME].reshape(-1, FRAME)
    if not len(frames):
        return f"t={len(x) / max(sound.rate, 1):.4f}"
    power = np.zeros(FRAME // 2 + 1)
    crossings = level = 0.0
    for i in range(0, len(frames), 512):
        part = frames[i : i + 512]
        power += (np.abs(np.fft.rfft(part - part.mean(1, keepdims=True), axis=1)) ** 2).sum(0, dtype=np.float64)
        crossings += float((np.diff(np.signbit(part), axis=1)).sum())
        level += float((part.astype(np.float64) ** 2).sum())
    hz = np.arange(len(power)) * sound.rate / FRAME
    centroid = float((power * hz).sum() / power.sum()) if power.sum() else 0.0
    return f"t={sound.times[-1]:.4f};rms={np.sqrt(level / frames.size):.3f};zc={crossings / frames.size:.4f};hz={centroid:.1f};notes={len(sound.notes)}"


def padded(data: bytes) -> bytes:
    """data with bytes 255 appended up to a positive multiple of a frame."""
    return data + b"\xff" * ((-len(data) % FRAME) or (0 if data else FRAME))


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
FEATURES = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
    + [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded to whole frames, as an Ogg file.

    Null and empty texts give one frame of padding. Rows are taken one by one, so
    ids may be null or repeat; equal texts give equal files. No shuffle, and one
    document at a time is in memory. An empty table gives no rows. Columns other
    than the two named are not looked at.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def make(batches):
        for whole in batches:
            for b in pieces(whole):
                data = [t.encode() for t in b.column("text").to_pylist()]
                yield rows_of({"doc_id": b.column("doc_id"), "n_bytes": [len(x) for x in data], "media": [encode(padded(x)) for x in data]}, MEDIA)

    return arrow(rows, "media", make, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of what is read back from the media column of to_media. Raises on a damaged file."""
    prepare(media.sparkSession)

    def read(batches):
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in FEATURES}
            for i, n, m in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                sound = decode(m)
                row = (i, n, len(sound.samples), hashlib.sha256(sound.samples).hexdigest(), zlib.crc32(sound.samples[-32:]), len(m), hashlib.sha256(m).hexdigest(), features(sound))
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            yield rows_of(out, FEATURES)

    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return arrow(media.select("doc_id", "n_bytes", "media"), "media", read, ddl)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
