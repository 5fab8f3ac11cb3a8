"""Matroska media columns: write a payload as laced blocks, and parse media into packet tables.

An element is an id (1 to 4 bytes, its length told by the leading bit, which
stays), a size (1 to 8 bytes likewise, the leading bit removed; all ones means
unknown) and a body.  A segment holds tracks, clusters of blocks and cues; a
block holds one frame, or several by Xiph, EBML or fixed-size lacing.

``packets`` gives one row per frame with its timestamp, track and byte range in
the media; ``features`` one row per medium.  Both work a row at a time in
Arrow batches, so no row meets another and nothing is shuffled.

Edge cases: a null or empty text is a payload of 64 zero bytes; null media, or
what isn't EBML, give no packets and the status ``invalid``; media that end inside an
element give the packets that are whole and ``truncated``; an element that
overruns its parent or stands in another one than the format says ends the
reading with ``malformed``, and so does a size unknown where none may be; a block whose
lacing doesn't add up gives no packets, is passed over and makes the status
``malformed``.  No packet ever lies outside its block.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of the Matroska specification.
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, TIMESTAMP_SCALE = 0x18538067, 0x1549A966, 0x2AD7B1
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
#: The element in which each may stand (0: none).
INSIDE = {
    EBML: 0, SEGMENT: 0,
    INFO: SEGMENT, TRACKS: SEGMENT, CLUSTER: SEGMENT, CUES: SEGMENT, SEEK_HEAD: SEGMENT, CHAPTERS: SEGMENT, TAGS: SEGMENT, ATTACHMENTS: SEGMENT,
    TIMESTAMP_SCALE: INFO, TRACK_ENTRY: TRACKS, TRACK_NUMBER: TRACK_ENTRY, DEFAULT_DURATION: TRACK_ENTRY,
    CLUSTER_TIMESTAMP: CLUSTER, SIMPLE_BLOCK: CLUSTER, BLOCK_GROUP: CLUSTER, BLOCK: BLOCK_GROUP, REFERENCE_BLOCK: BLOCK_GROUP,
    CUE_POINT: CUES, CUE_TIME: CUE_POINT, CUE_TRACK_POSITIONS: CUE_POINT, CUE_TRACK: CUE_TRACK_POSITIONS, CUE_CLUSTER_POSITION: CUE_TRACK_POSITIONS,
}
#: Those whose bodies are elements that are read.
PARENTS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
LACINGS = ("none", "xiph", "fixed", "ebml")

#: Bytes of a frame, frames of a block, blocks of a cluster; a frame lasts one tick.
FRAME, LACED, BLOCKS = 256, 8, 16
PACKET = "struct<n: int, track: int, ts: bigint, lacing: string, key: boolean, start: bigint, size: bigint>"


# --- writing -----------------------------------------------------------------


def _uint(n: int) -> bytes:
    return n.to_bytes(max(1, -(-n.bit_length() // 8)), "big")


def _size(n: int, width: int = 0) -> bytes:
    """n as a variable-length size; all ones is kept free for "unknown"."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, *body: bytes) -> bytes:
    data = b"".join(body)
    return _uint(ident) + _size(len(data)) + data


def _lace(frames: list[bytes], kind: int) -> bytes:
    sizes = [len(f) for f in frames]
    head = b"" if kind == 0 else bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 3:
        head += _size(sizes[0])
        for before, n in zip(sizes[:-2], sizes[1:-1], strict=True):
            width = next(w for w in range(1, 9) if abs(n - before) < (1 << 7 * w - 1))
            head += _size(n - before + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A Matroska file whose one track's frames, in order, are the payload."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    clusters, points, at = [], [], 0
    info = element(INFO, element(TIMESTAMP_SCALE, _uint(1_000_000)))
    track = element(TRACKS, element(TRACK_ENTRY, element(TRACK_NUMBER, b"\x01"), element(TRACK_UID, b"\x01"), element(TRACK_TYPE, b"\x11"), element(DEFAULT_DURATION, _uint(1_000_000)), element(CODEC_ID, b"D_LODESTONE/RAW8")))
    at = len(info) + len(track)
    for c in range(0, len(frames), LACED * BLOCKS):
        blocks = []
        for b in range(c, min(len(frames), c + LACED * BLOCKS), LACED):
            group = frames[b : b + LACED]
            kind = (b // LACED) % 4 if len(group) > 1 else 0
            if kind == 0 and len(group) > 1:
                kind = 3
            elif kind == 2 and len({*map(len, group)}) > 1:
                kind = 1
            blocks.append(element(SIMPLE_BLOCK, b"\x81", (b - c).to_bytes(2, "big"), bytes([0x80 | kind << 1]), _lace(group, kind)))
        cluster = element(CLUSTER, element(CLUSTER_TIMESTAMP, _uint(c)), *blocks)
        points.append(element(CUE_POINT, element(CUE_TIME, _uint(c)), element(CUE_TRACK_POSITIONS, element(CUE_TRACK, b"\x01"), element(CUE_CLUSTER_POSITION, _uint(at)))))
        clusters.append(cluster)
        at += len(cluster)
    return element(EBML, element(DOC_TYPE, b"matroska")) + element(SEGMENT, info, track, *clusters, element(CUES, *points))


# --- parsing -----------------------------------------------------------------


class Truncated(Exception):
    """The medium ends inside an element."""


class Malformed(Exception):
    """An element or a lace contradicts what holds it."""


def _vint(data: bytes, at: int, end: int, keep: bool) -> tuple[int, int]:
    """The variable-length integer at ``at`` and where it ends, before ``end``; -1 for the unknown size."""
    if at >= end:
        raise Truncated if end == len(data) else Malformed
    width = 9 - data[at].bit_length()
    if width > 8:
        raise Malformed
    if at + width > end:
        raise Truncated if end == len(data) else Malformed
    n = int.from_bytes(data[at : at + width], "big")
    if keep:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


def elements(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the element, start of its body, its end) of all elements, parents before children.

    A segment or cluster of unknown size ends where an element starts that can't be in it.
    """
    at, open_ = 0, [(0, len(data), False)]
    while True:
        while len(open_) > 1 and at >= open_[-1][1]:
            open_.pop()
        if at >= len(data):
            break
        ident, p = _vint(data, at, open_[-1][1], True)
        n, body = _vint(data, p, open_[-1][1], False)
        if ident in INSIDE:
            while open_[-1][2] and open_[-1][0] != INSIDE[ident]:
                open_.pop()
            if open_[-1][0] != INSIDE[ident]:
                raise Malformed
        if n < 0 and ident not in (SEGMENT, CLUSTER):
            raise Malformed
        limit = open_[-1][1]
        end = limit if n < 0 else body + n
        if end > limit:
            if limit < len(data):
                raise Malformed
            if ident not in PARENTS:
                raise Truncated
        yield ident, at, body, min(end, limit)
        if ident in PARENTS:
            open_.append((ident, min(end, limit), n < 0))
            at = body
        else:
            at = end


def _cut_short(data: bytes) -> bool:
    """Whether the outermost elements end after the medium does."""
    at = 0
    while at < len(data):
        _, p = _vint(data, at, len(data), True)
        n, body = _vint(data, p, len(data), False)
        at = len(data) if n < 0 else body + n
    return at > len(data)


def _frame_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of a block's frames, and where the first starts."""
    if kind == 0:
        return [end - at], at
    if at >= end:
        raise Malformed
    n, at = data[at] + 1, at + 1
    if kind == 2:
        if (end - at) % n:
            raise Malformed
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for i in range(n - 1):
        size = 0
        if kind == 1:
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                raise Malformed
            size, at = size + data[at], at + 1
        else:
            start = at
            size, at = _vint(data, at, end, False)
            if size < 0:
                raise Malformed
            if i:
                size += sizes[-1] - ((1 << 7 * (at - start) - 1) - 1)
        if size < 0:
            raise Malformed
        sizes.append(size)
    if sum(sizes) > end - at:
        raise Malformed
    return [*sizes, end - at - sum(sizes)], at


def _block(data: bytes, body: int, end: int) -> tuple[int, int, int, list[int], int]:
    """Track, relative timestamp, flags, frame sizes and start of the first frame of a block."""
    try:
        track, at = _vint(data, body, end, False)
        if track < 0 or at + 3 > end:
            raise Malformed
        return track, int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2], *_frame_sizes(data, at + 3, end, data[at + 2] >> 1 & 3)
    except Truncated:
        raise Malformed from None


def parse(data: bytes | None) -> dict:
    """The packets (track, timestamp, lacing, key flag, start, size), cues and status of one medium.

    Frames of a lace follow each other by their track's default duration, or share the block's time if there is none.
    A block of a group is a key frame unless it refers to another one.
    """
    out: dict = {"packets": [], "cues": [], "clusters": {}, "tracks": 0, "blocks": 0, "status": "ok"}
    if not data or not data.startswith(EBML.to_bytes(4, "big")):
        return out | {"status": "invalid"}
    now = segment = cluster = group = 0
    scale, entries = 1_000_000, []
    uint = lambda a, b: int.from_bytes(data[a:b], "big")
    try:
        for ident, start, body, end in elements(data):
            if ident == SEGMENT:
                segment = body
            elif ident == TIMESTAMP_SCALE:
                scale = max(1, uint(body, end))
            elif ident == TRACK_ENTRY:
                entries.append({})
            elif ident == TRACK_NUMBER:
                entries[-1]["number"] = uint(body, end)
                out["tracks"] += 1
            elif ident == DEFAULT_DURATION:
                entries[-1]["duration"] = uint(body, end)
            elif ident == CLUSTER:
                now, cluster = 0, start
            elif ident == CLUSTER_TIMESTAMP:
                now = out["clusters"][cluster - segment] = uint(body, end)
            elif ident == CUE_POINT:
                out["cues"].append([None, None])
            elif ident == CUE_TIME:
                out["cues"][-1][0] = uint(body, end)
            elif ident == CUE_CLUSTER_POSITION:
                out["cues"][-1][1] = uint(body, end)
            elif ident == BLOCK_GROUP:
                group = len(out["packets"])
            elif ident == REFERENCE_BLOCK:
                out["packets"][group:] = [(*p[:3], False, *p[4:]) for p in out["packets"][group:]]
            elif ident in (SIMPLE_BLOCK, BLOCK):
                try:
                    track, after, flags, sizes, first = _block(data, body, end)
                except Malformed:
                    out["status"] = "malformed"
                    continue
                lasts = next((e.get("duration", 0) for e in entries if e.get("number") == track), 0)
                out["blocks"] += 1
                for i, n in enumerate(sizes):
                    out["packets"].append((track, now + after + i * lasts // scale, LACINGS[flags >> 1 & 3], ident == BLOCK or bool(flags & 0x80), first, n))
                    first += n
        if out["status"] == "ok" and _cut_short(data):
            out["status"] = "truncated"
    except Truncated:
        out["status"] = "truncated"
    except Malformed:
        out["status"] = "malformed"
    return out


def summary(found: dict) -> str:
    """Counts by lacing, the last timestamp, and how many cues point at a cluster of their time."""
    laced = [x[2] for x in found["packets"]]
    good = sum(t is not None and found["clusters"].get(p) == t for t, p in found["cues"])
    return ";".join([f"status={found['status']}", f"tracks={found['tracks']}", f"clusters={len(found['clusters'])}", f"blocks={found['blocks']}", f"packets={len(laced)}", *(f"{k}={laced.count(k)}" for k in LACINGS), f"cues={good}/{len(found['cues'])}", f"last={max((x[1] for x in found['packets']), default=-1)}"])


# --- columns -----------------------------------------------------------------


def padded(text: bytes) -> bytes:
    """The bytes and zeros up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 if text else 64)


def packets(media: DataFrame, column: str = "media") -> DataFrame:
    """One row per frame: the other columns, then n, track, ts, lacing, key, start, size, a frame's place in the medium.

    Where media has a column of one of these names, the frame's columns begin with ``packet_``.
    """
    own, fields = [c for c in media.columns if c != column], ["n", "track", "ts", "lacing", "key", "start", "size"]
    prefix = ""
    while {f"{prefix}{f}".lower() for f in fields} & {c.lower() for c in own}:
        prefix += "packet_"
    found = F.udf(lambda m: [(i, *p) for i, p in enumerate(parse(bytes(m) if m is not None else None)["packets"])], f"array<{PACKET}>", useArrow=True)
    name = "_packet"
    while name.lower() in {c.lower() for c in own}:
        name = f"_{name}"
    kept = [F.col(f"`{c}`") for c in own]
    return media.select(*kept, F.explode(found(F.col(f"`{column}`"))).alias(name)).select(*kept, *(F.col(f"`{name}`.{f}").alias(f"{prefix}{f}") for f in fields))


def to_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds the column ``media``: the padded bytes of each text as a Matroska file."""
    make = F.udf(lambda t: mux(padded((t or "").encode())), "binary", useArrow=True)
    return docs.withColumn(media, make(F.col(text)))


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(docs: DataFrame) -> DataFrame:
    """Per text: the media written from it, and what parsing those media gives back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ident, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                raw = (text.as_py() or "").encode()
                media = mux(padded(raw))
                found = parse(media)
                payload = b"".join(media[p[4] : p[4] + p[5]] for p in found["packets"])
                rows.append((ident, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), summary(found)))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2, strict=True)], names=[x.split()[0] for x in _DIGEST.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _DIGEST)
