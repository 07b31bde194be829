"""Media columns in Matroska: write 8-bit PCM samples, parse EBML back into a packet table.

The parser reads variable-length EBML elements, clusters, SimpleBlocks and BlockGroups with all four
lacing modes, and cues, and yields packets with track, timestamp, byte range and lace number. The
writer stores bytes losslessly as unsigned 8-bit mono PCM.

Defined cases: null payload is empty and stores no block; unknown elements are skipped; an element
that runs past its parent raises ValueError; a cluster of unknown size (all ones) ends before the next
element beside clusters and holds no child of unknown size (ValueError), other unknown sizes end with
their parent; laced packets follow one another by their duration where the file tells it; repeated rows
give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldquarry.llm.common import small_batches, text_slices

# Element ids of the public Matroska specification.
EBML, EBML_VERSION, EBML_READ_VERSION, MAX_ID, MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
BLOCK_DURATION, DEFAULT_DURATION = 0x9B, 0x23E383
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements beside clusters: file header, segment, seek head, information, tracks, cues, chapters, tags, attachments.
BESIDE_CLUSTERS = {EBML, SEGMENT, 0x114D9B74, INFO, TRACKS, CLUSTER, CUES, 0x1043A770, 0x1254C367, 0x1941A469}

NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
#: Samples a second; samples of a packet; packets of a block; blocks of a cluster; padding unit.
RATE, PACKET, LACES, BLOCKS, UNIT = 8000, 1024, 8, 16, 64


# ---- writing ------------------------------------------------------------------------------------
def vint(value: int, width: int = 0) -> bytes:
    """value as an EBML variable-length integer; all ones stay free for 'unknown'."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(eid: int, body: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(eid: int, value: int) -> bytes:
    return element(eid, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], mode: int) -> bytes:
    """Block body after its flags byte."""
    sizes = [len(f) for f in frames]
    if mode == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    if mode == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif mode == EBML_LACING:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            d = b - a
            width = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
            head += vint(d + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def block(track: int, relative: int, frames: list[bytes], mode: int) -> bytes:
    return vint(track) + struct.pack(">hB", relative, 0x80 | mode << 1) + lace(frames, mode)


_HEAD = element(EBML, b"".join([uint(EBML_VERSION, 1), uint(EBML_READ_VERSION, 1), uint(MAX_ID, 4), uint(MAX_SIZE, 8), element(DOC_TYPE, b"matroska"), uint(DOC_TYPE_VERSION, 4), uint(DOC_TYPE_READ_VERSION, 2)]))
_TRACK = element(TRACKS, element(TRACK_ENTRY, b"".join([uint(TRACK_NUMBER, 1), uint(TRACK_UID, 1), uint(TRACK_TYPE, 2), uint(FLAG_LACING, 1), element(CODEC_ID, b"A_PCM/INT/LIT"), element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", float(RATE))) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))])))


def write_pcm(samples: bytes) -> bytes:
    """A Matroska file with samples as one 8-bit mono PCM track."""
    duration = len(samples) * 1000 / RATE
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", duration)) + element(MUXING_APP, b"fieldquarry") + element(WRITING_APP, b"fieldquarry"))
    body, cues = [info, _TRACK], []
    at = len(info) + len(_TRACK)
    per_block, per_cluster = PACKET * LACES, PACKET * LACES * BLOCKS
    for c in range(0, len(samples), per_cluster):
        base = c * 1000 // RATE
        inner = [uint(TIMESTAMP, base)]
        for b in range(c, min(c + per_cluster, len(samples)), per_block):
            frames = [samples[f : f + PACKET] for f in range(b, min(b + per_block, len(samples)), PACKET)]
            mode = NO_LACING if len(frames) == 1 else FIXED if len(frames[-1]) == PACKET else EBML_LACING
            inner.append(element(SIMPLE_BLOCK, block(1, b * 1000 // RATE - base, frames, mode)))
        cluster = element(CLUSTER, b"".join(inner))
        cues.append(element(CUE_POINT, uint(CUE_TIME, base) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    if cues:
        body.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(body))


# ---- reading ------------------------------------------------------------------------------------
@dataclass
class Packet:
    track: int
    timestamp: int
    start: int
    size: int
    block: int
    lace: int


@dataclass
class Media:
    packets: list[Packet]
    cues: list[tuple[int, int, int]]
    tracks: list[dict]
    clusters: list[int]
    scale: int
    duration: float


def read_vint(data: bytes, at: int, keep_mark: bool = False) -> tuple[int, int]:
    """(value, next position); a size of all ones is -1."""
    if at >= len(data):
        raise ValueError("variable-length integer behind the end")
    first = data[at]
    if not first:
        raise ValueError("variable-length integer of more than 8 bytes")
    width = 9 - first.bit_length()
    if at + width > len(data):
        raise ValueError("variable-length integer is cut off")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_mark:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, body start, body end) of the elements in data[at:end].

    A cluster of unknown size ends where an element begins that is no child of clusters; any other
    element of unknown size ends with its parent.
    """
    while at < end:
        eid, at = read_vint(data, at, keep_mark=True)
        size, at = read_vint(data, at)
        stop = (cluster_end(data, at, end) if eid == CLUSTER else end) if size < 0 else at + size
        if stop > end:
            raise ValueError("element runs past its parent")
        yield eid, at, stop
        at = stop


def cluster_end(data: bytes, at: int, end: int) -> int:
    """Where the body of a cluster of unknown size ends: at the next element of the segment or file."""
    while at < end:
        eid, body = read_vint(data, at, keep_mark=True)
        if eid in BESIDE_CLUSTERS:
            return at
        size, body = read_vint(data, body)
        if size < 0:
            raise ValueError("child of unknown size in a cluster")
        at = body + size
    return end


def read_block(data: bytes, at: int, end: int, base: int, number: int, scale: int = 1_000_000, durations: dict[int, tuple[float, float]] | None = None, whole: int | None = None) -> list[Packet]:
    """The packets of a block.

    Laced ones follow one another by their track's duration (ns of a packet, ns of a byte), or else by
    even shares of the block's (`whole`, in ticks); where none is known all get the block's timestamp.
    """
    track, at = read_vint(data, at)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    mode = flags >> 1 & 3
    if mode == NO_LACING:
        sizes = [end - at]
    else:
        n, at = data[at] + 1, at + 1
        sizes = []
        if mode == XIPH:
            for _ in range(n - 1):
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                sizes.append(size + data[at])
                at += 1
        elif mode == EBML_LACING and n > 1:
            size, at = read_vint(data, at)
            sizes.append(size)
            for _ in range(n - 2):
                was = at
                raw, at = read_vint(data, at)
                sizes.append(sizes[-1] + raw - (1 << 7 * (at - was) - 1) + 1)
        sizes = [(end - at) // n] * n if mode == FIXED else [*sizes, end - at - sum(sizes)]
    out = []
    packet_ns, byte_ns = (durations or {}).get(track, (0, 0))
    for i, size in enumerate(sizes):
        if size < 0 or at + size > end:
            raise ValueError("lace runs past its block")
        if packet_ns or byte_ns:
            later = int((i * packet_ns or sum(sizes[:i]) * byte_ns) / scale)
        else:
            later = i * (whole or 0) // len(sizes)
        out.append(Packet(track, base + relative + later, at, size, number, i))
        at += size
    return out


def read_media(data: bytes) -> Media:
    """Tracks, packets, clusters and cues of a file; ValueError where it is damaged."""
    try:
        return _read(data)
    except (IndexError, struct.error) as damage:
        raise ValueError("damaged file") from damage


def _read(data: bytes) -> Media:
    out = Media([], [], [], [], 1_000_000, 0.0)
    number, durations = 0, {}
    for eid, a, z in elements(data, 0, len(data)):
        if eid != SEGMENT:
            continue
        for kind, b, y in elements(data, a, z):
            if kind == INFO:
                for k, c, x in elements(data, b, y):
                    if k == TIMESTAMP_SCALE:
                        out.scale = int.from_bytes(data[c:x], "big")
                    elif k == DURATION:
                        out.duration = struct.unpack(">d" if x - c == 8 else ">f", data[c:x])[0]
            elif kind == TRACKS:
                for _, c, x in elements(data, b, y):
                    track, each, sound = {}, 0, {BIT_DEPTH: 0, CHANNELS: 1, SAMPLING_FREQUENCY: 8000.0}
                    for k, d, w in elements(data, c, x):
                        if k in (TRACK_NUMBER, TRACK_TYPE):
                            track["number" if k == TRACK_NUMBER else "type"] = int.from_bytes(data[d:w], "big")
                        elif k == CODEC_ID:
                            track["codec"] = data[d:w].decode()
                        elif k == DEFAULT_DURATION:
                            each = int.from_bytes(data[d:w], "big")
                        elif k == AUDIO:
                            for k2, e, v in elements(data, d, w):
                                if k2 == SAMPLING_FREQUENCY:
                                    sound[k2] = struct.unpack(">d" if v - e == 8 else ">f", data[e:v])[0]
                                elif k2 in sound:
                                    sound[k2] = int.from_bytes(data[e:v], "big")
                    out.tracks.append(track)
                    rate = sound[BIT_DEPTH] * sound[CHANNELS] * sound[SAMPLING_FREQUENCY] if track.get("codec", "").startswith("A_PCM/") else 0
                    durations[track.get("number")] = each, 8e9 / rate if rate else 0
            elif kind == CLUSTER:
                base = 0
                out.clusters.append(b)
                for k, c, x in elements(data, b, y):
                    if k == TIMESTAMP:
                        base = int.from_bytes(data[c:x], "big")
                    elif k == SIMPLE_BLOCK:
                        out.packets += read_block(data, c, x, base, number, out.scale, durations)
                        number += 1
                    elif k == BLOCK_GROUP:
                        group = list(elements(data, c, x))
                        whole = next((int.from_bytes(data[d:w], "big") for k2, d, w in group if k2 == BLOCK_DURATION), None)
                        for k2, d, w in group:
                            if k2 == BLOCK:
                                out.packets += read_block(data, d, w, base, number, out.scale, durations, whole)
                                number += 1
            elif kind == CUES:
                for _, c, x in elements(data, b, y):
                    time = track_no = place = 0
                    for k, d, w in elements(data, c, x):
                        if k == CUE_TIME:
                            time = int.from_bytes(data[d:w], "big")
                        elif k == CUE_TRACK_POSITIONS:
                            for k2, e, v in elements(data, d, w):
                                if k2 == CUE_TRACK:
                                    track_no = int.from_bytes(data[e:v], "big")
                                elif k2 == CUE_CLUSTER_POSITION:
                                    place = int.from_bytes(data[e:v], "big")
                    out.cues.append((time, track_no, place))
    return out


# ---- tables -------------------------------------------------------------------------------------
def _store(batches):
    for ids, texts in text_slices(batches):
        raw = [b for b in texts.cast(pa.large_binary()).to_pylist()]
        media = [write_pcm(b + bytes(-len(b) % UNIT or (0 if b else UNIT))) for b in raw]
        yield pa.RecordBatch.from_arrays([ids, pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes, zero-padded to a positive multiple of UNIT."""
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _packets(batches):
    for b in batches:
        rows = [(i, p) for i, m in enumerate(b.column("media").to_pylist()) if m is not None for p in read_media(m).packets]
        cols = [pa.array([getattr(p, k) for _, p in rows], pa.int64()) for k in ("track", "timestamp", "start", "size", "block", "lace")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array([i for i, _ in rows], pa.int64())), *cols], ["doc_id", "track", "timestamp", "start", "size", "block", "lace"])


def packet_table(media: DataFrame) -> DataFrame:
    """One row per packet of a (doc_id, media) table: timestamps in the file's scale, byte ranges."""
    return media.select("doc_id", "media").mapInArrow(_packets, "doc_id long, track long, timestamp long, start long, size long, block long, lace long")


def features(data: bytes, media: Media) -> str:
    """Integer statistics of the samples read back and of the packet table."""
    x = np.frombuffer(data, dtype=np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    last = media.packets[-1].timestamp if media.packets else 0
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};last_ms={last};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings};peak={int(np.abs(x).max(initial=0))}"


def _digest(batches):
    for b in batches:
        out = []
        for stored in b.column("media").to_pylist():
            media = read_media(stored)
            got = b"".join([stored[p.start : p.start + p.size] for p in media.packets])
            out.append((len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), features(got, media)))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = media_column(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return media.mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
