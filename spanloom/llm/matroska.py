"""Matroska: write payloads as PCM audio tracks, read files into packet tables.

The reader walks EBML elements with variable-length ids and sizes, segments, clusters (of known
and unknown size), simple blocks and block groups, all four lacings, and cues. It gives one packet
per frame: track, timestamp, byte range, keyframe, lace position.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, TIMESTAMP_SCALE, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x4282, 0x2AD7B1, 0xE7, 0xA3, 0xA0, 0xA1
REFERENCE_BLOCK = 0xFB
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1
DEFAULT_DURATION = 0x23E383
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, BLOCK_GROUP, TRACK_ENTRY, AUDIO, CUE_POINT, CUE_TRACK_POSITIONS}
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}

RATE = 8000
FRAME = 512          # samples, 64 ms
LACE = 8             # frames of a block
CLUSTER_BLOCKS = 8   # blocks of a cluster, so timestamps stay within 16 signed bits
PAD = 64


class Packet(NamedTuple):
    track: int
    timestamp_ms: float
    offset: int
    size: int
    keyframe: bool
    lace: int
    cluster: int


class Parsed(NamedTuple):
    packets: list[Packet]
    tracks: list[dict]
    clusters: list[int]
    cues: list[tuple[int, int, int]]
    doc_type: str


def vint(value: int, length: int = 0) -> bytes:
    """A size as a variable-length integer of the least (or the given) length."""
    length = length or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * length).to_bytes(length, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def unsigned(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def block(track: int, relative: int, frames: list[bytes]) -> bytes:
    """Body of a simple block; several frames are laced, by fixed size if equal, else by EBML sizes."""
    head = vint(track) + relative.to_bytes(2, "big", signed=True)
    if len(frames) == 1:
        return head + b"\x80" + frames[0]
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return head + b"\x84" + bytes([len(frames) - 1]) + b"".join(frames)
    laced = vint(sizes[0])
    for last, size in zip(sizes[:-2], sizes[1:-1]):
        n = next(n for n in range(1, 9) if abs(size - last) < 1 << 7 * n - 1)
        laced += vint(size - last + (1 << 7 * n - 1) - 1, n)
    return head + b"\x86" + bytes([len(frames) - 1]) + laced + b"".join(frames)


def write_pcm(payload: bytes) -> bytes:
    """A Matroska file with one track of 8-bit samples that holds `payload` byte by byte."""
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, np.array(RATE, ">f8").tobytes()) + unsigned(CHANNELS, 1)
                    + unsigned(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1)
                                     + unsigned(TRACK_TYPE, 2) + unsigned(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    parts, position, cues = [info, tracks], len(info) + len(tracks), []
    span = FRAME * LACE
    for low in range(0, len(payload), span * CLUSTER_BLOCKS):
        start = low * 1000 // RATE
        body = [unsigned(TIMESTAMP, start)]
        for at in range(low, min(low + span * CLUSTER_BLOCKS, len(payload)), span):
            piece = payload[at:at + span]
            frames = [piece[i:i + FRAME] for i in range(0, len(piece), FRAME)]
            body.append(element(SIMPLE_BLOCK, block(1, at * 1000 // RATE - start, frames)))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, start) + element(
            CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, position))))
        parts.append(cluster)
        position += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """(value, next position); None stands for an unknown size. Raises ValueError on bad input."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at {at}")
    length = 9 - data[at].bit_length()
    if at + length > len(data):
        raise ValueError(f"the integer at {at} is cut off")
    value = int.from_bytes(data[at:at + length], "big")
    if keep_marker:
        return value, at + length
    value &= (1 << 7 * length) - 1
    return None if value == (1 << 7 * length) - 1 else value, at + length


def cluster_end(data: bytes, at: int, high: int) -> int:
    """Where a cluster of unknown size ends: at the next element of the top level, or with its parent."""
    while at < high:
        try:
            ident, body = read_vint(data, at, keep_marker=True)
            size, body = read_vint(data, body)
        except ValueError:
            return high
        if ident in TOP_LEVEL:
            return at
        at = high if size is None else body + size
    return high


def elements(data: bytes, low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the element, start and end of its body) of one level.

    An element of unknown size lasts to the end of its parent, a cluster to the next element of
    the top level. The walk ends where the data are cut off.
    """
    at = low
    while at < high:
        try:
            ident, body = read_vint(data, at, keep_marker=True)
            size, body = read_vint(data, body)
        except ValueError:
            return
        end = high if size is None else body + size
        if size is None and ident == CLUSTER:
            end = cluster_end(data, body, high)
        if end > high and ident not in MASTERS:
            return
        yield ident, at, body, min(end, high)
        at = end


def number(data: bytes, low: int, high: int) -> int:
    return int.from_bytes(data[low:high], "big")


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of the frames of a block and the position of the first."""
    if not lacing:
        return [end - at], at
    count, at, sizes = data[at] + 1, at + 1, []
    if lacing == 2:
        if (end - at) % count:
            raise ValueError("frames of a fixed lacing differ")
        return [(end - at) // count] * count, at
    for i in range(count - 1):
        if lacing == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            start = at
            value, at = read_vint(data, at)
            if value is None:
                value = (1 << 7 * (at - start)) - 1
            size = value if not i else sizes[-1] + value - ((1 << 7 * (at - start) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames pass the end of the block")
    return sizes, at


def parse(data: bytes) -> Parsed:
    """Packets, tracks, cluster offsets and cues of a file. Data that are cut off or malformed give what precedes."""
    out = Parsed([], [], [], [], "")
    for ident, _, low, high in elements(data, 0, len(data)):
        if ident == EBML:
            out = out._replace(doc_type=next((data[a:b].rstrip(b"\0").decode("ascii", "replace")
                                              for i, _, a, b in elements(data, low, high) if i == DOC_TYPE), ""))
        elif ident == SEGMENT:
            _segment(data, low, high, out)
    return out


def _segment(data: bytes, low: int, high: int, out: Parsed) -> None:
    scale = 1_000_000
    for ident, start, a, b in elements(data, low, high):
        if ident == INFO:
            scale = next((number(data, x, y) for i, _, x, y in elements(data, a, b) if i == TIMESTAMP_SCALE), scale)
        elif ident == TRACKS:
            for i, _, x, y in elements(data, a, b):
                if i == TRACK_ENTRY:
                    fields = {j: data[p:q] for j, _, p, q in elements(data, x, y)}
                    out.tracks.append({"number": int.from_bytes(fields.get(TRACK_NUMBER, b""), "big"),
                                       "type": int.from_bytes(fields.get(TRACK_TYPE, b""), "big"),
                                       "codec": fields.get(CODEC_ID, b"").decode("ascii", "replace"),
                                       "frame_ns": int.from_bytes(fields.get(DEFAULT_DURATION, b""), "big")})
        elif ident == CUES:
            for i, _, x, y in elements(data, a, b):
                time, places = 0, []
                for j, _, p, q in elements(data, x, y) if i == CUE_POINT else ():
                    if j == CUE_TIME:
                        time = number(data, p, q)
                    elif j == CUE_TRACK_POSITIONS:
                        fields = {k: number(data, r, s) for k, _, r, s in elements(data, p, q)}
                        places.append((fields.get(CUE_TRACK, 0), low + fields.get(CUE_CLUSTER_POSITION, 0)))
                out.cues.extend((time, track, offset) for track, offset in places)
        elif ident == CLUSTER:
            out.clusters.append(start)
            base = 0
            for i, _, x, y in elements(data, a, b):
                if i == TIMESTAMP:
                    base = number(data, x, y)
                elif i == SIMPLE_BLOCK:
                    _block(data, x, y, base, scale, None, out)
                elif i == BLOCK_GROUP:
                    inner = list(elements(data, x, y))
                    key = all(j != REFERENCE_BLOCK for j, *_ in inner)
                    for j, _, p, q in inner:
                        if j == BLOCK:
                            _block(data, p, q, base, scale, key, out)


def _block(data: bytes, at: int, end: int, base: int, scale: int, key: bool | None, out: Parsed) -> None:
    try:
        track, at = read_vint(data, at)
        relative = int.from_bytes(data[at:at + 2], "big", signed=True)
        flags = data[at + 2]
        sizes, at = lace_sizes(data, at + 3, end, flags >> 1 & 3)
    except (ValueError, IndexError):
        return
    # frames of a lace follow one another by the track's default duration; without one all have the block's time
    step = next((t["frame_ns"] for t in out.tracks if t["number"] == track), 0)
    for lace, size in enumerate(sizes):
        out.packets.append(Packet(track or 0, ((base + relative) * scale + lace * step) / 1e6, at, size,
                                  bool(flags & 0x80) if key is None else key, lace, len(out.clusters) - 1))
        at += size


def payload_of(data: bytes, packets: list[Packet], track: int = 1) -> bytes:
    return b"".join([data[p.offset:p.offset + p.size] for p in packets if p.track == track])


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes filled with zeros to a positive multiple of 64, and their number before that."""
    raw = (text or "").encode()
    return raw + b"\0" * ((-len(raw)) % PAD if raw else PAD), len(raw)


def media_row(text: str | None) -> tuple:
    raw, n = padded(text)
    media = write_pcm(raw)
    parsed = parse(media)
    payload = payload_of(media, parsed.packets)
    samples = np.frombuffer(payload, np.uint8)
    total, square = int(samples.sum(dtype=np.int64)), int(np.square(samples, dtype=np.uint32).sum(dtype=np.int64))
    feature = (f"packets={len(parsed.packets)};clusters={len(parsed.clusters)};cues={len(parsed.cues)};"
               f"last_ms={parsed.packets[-1].timestamp_ms:.0f};sum={total};energy={square};"
               f"peak={int(samples.max())};rises={int(np.count_nonzero(samples[1:] > samples[:-1]))}")
    return (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media),
            hashlib.sha256(media).hexdigest(), feature)


FIELDS = ("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
          "media_sha256 string, feature string")


def media_digests(docs: DataFrame) -> DataFrame:
    """(doc_id and FIELDS) for every row of `docs` (doc_id, text).

    The text is stored as a Matroska file, read back through the parser, and described. Null and
    empty texts give 64 zero bytes; a very long text is held three times over by its task; repeated rows give repeated results; other columns are not
    read; an empty table gives no rows. One pass, row by row, no shuffle: memory is a batch.
    """
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        for batch in batches:
            out = pd.DataFrame([media_row(t) for t in batch["text"]], columns=names)
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(rows, f"doc_id long, {FIELDS}")


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text as a Matroska file."""
    @F.pandas_udf("binary")
    def media(texts: pd.Series) -> pd.Series:
        return pd.Series([write_pcm(padded(t)[0]) for t in texts], dtype=object)

    return docs.select("doc_id", media("text").alias("media"))


def packet_table(files: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per frame of every file: key, cluster, track, timestamp_ms, offset, size, keyframe, lace, cued.

    `cued` tells whether a cue points at the frame's cluster. Null, empty and foreign data give no
    rows; data that are cut off give the packets before the cut.
    """
    schema = ("cluster int, track int, timestamp_ms double, offset long, size long, keyframe boolean, lace int, "
              "cued boolean")

    @F.pandas_udf(f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")
    def packets(data: pd.Series) -> pd.Series:
        out = []
        for blob in data:
            parsed = parse(bytes(blob or b""))
            cued = {offset for _, _, offset in parsed.cues}
            out.append([{"cluster": p.cluster, "track": p.track, "timestamp_ms": p.timestamp_ms, "offset": p.offset,
                         "size": p.size, "keyframe": p.keyframe, "lace": p.lace,
                         "cued": parsed.clusters[p.cluster] in cued} for p in parsed.packets])
        return pd.Series(out, dtype=object)

    return files.select(F.col(key), F.explode(packets(F.col(column))).alias("p")).select(key, "p.*")
