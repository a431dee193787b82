"""Matroska media columns: write payloads as PCM tracks, parse files into packet tables.

``parse`` walks variable-length EBML elements (known and unknown sizes), reads
clusters, simple blocks and block groups, undoes the four kinds of lacing and
collects the cues.  A packet is one frame: track, timestamp, byte range.

Defined results: null text counts as empty; an empty text is a payload of 64
zero bytes; a null or damaged file yields the packets before the damage and a
``problem``; repeated rows are written and read independently; other columns
of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import record, slices, text_column

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS = 0xAE, 0xE1, 0xA0, 0xBB, 0xB7
TIMESTAMP_SCALE, TIMESTAMP, SIMPLE_BLOCK, BLOCK, BLOCK_DURATION, REFERENCE = 0x2AD7B1, 0xE7, 0xA3, 0xA1, 0x9B, 0xFB
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, RATE, CHANNELS, BIT_DEPTH = 0xD7, 0x73C5, 0x83, 0x86, 0xB5, 0x9F, 0x6264
CUE_TIME, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0xB3, 0xF7, 0xF1, 0xF0
VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
MASTERS = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
#: Elements that end a cluster of unknown size.
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES}

# The stored form: one track of 8-bit samples, 64 samples a millisecond.
UNIT, FRAME, LACED, BLOCKS = 64, 1024, 8, 128
NONE, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


class Damaged(ValueError):
    """The bytes are no valid file from here on."""


# ---------------------------------------------------------------- writing

def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(key: int, data: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + _size(len(data)) + data


def _uint(key: int, n: int) -> bytes:
    return _element(key, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _signed_size(n: int) -> bytes:
    width = 1
    while not -(1 << 7 * width - 1) < n < (1 << 7 * width - 1):
        width += 1
    return (n + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")


def block(track: int, relative: int, frames: list[bytes], lacing: int | None = None, key: bool = True) -> bytes:
    """Content of a (simple) block; by default equal frames take fixed lacing, others EBML lacing."""
    sizes = [len(f) for f in frames]
    if lacing is None:
        lacing = NONE if len(frames) == 1 else FIXED if len(set(sizes)) == 1 else EBML_LACING
    head = _size(track) + relative.to_bytes(2, "big", signed=True) + bytes([(0x80 if key else 0) | lacing << 1])
    if lacing:
        head += bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        head += _size(sizes[0]) + b"".join(_signed_size(b - a) for a, b in zip(sizes, sizes[1:-1]))
    return head + b"".join(frames)


def write(payload: bytes) -> bytes:
    """A file whose only track holds the payload as 8-bit samples; equal payloads give equal bytes."""
    head = _element(EBML, b"".join([
        _uint(VERSION, 1), _uint(READ_VERSION, 1), _uint(MAX_ID, 4), _uint(MAX_SIZE, 8),
        _element(DOC_TYPE, b"matroska"), _uint(DOC_VERSION, 4), _uint(DOC_READ_VERSION, 2)]))
    import struct

    body = [
        _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000)),
        _element(TRACKS, _element(TRACK_ENTRY, b"".join([
            _uint(TRACK_NUMBER, 1), _uint(TRACK_UID, 1), _uint(TRACK_TYPE, 2), _element(CODEC, b"A_PCM/INT/LIT"),
            _element(AUDIO, _element(RATE, struct.pack(">d", 64_000.0)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))]))),
    ]
    at, cues = sum(map(len, body)), []
    span = FRAME * LACED
    for start in range(0, len(payload), span * BLOCKS):
        base = start // UNIT
        parts = [_uint(TIMESTAMP, base)]
        for b in range(start, min(start + span * BLOCKS, len(payload)), span):
            part = payload[b:b + span]
            frames = [part[i:i + FRAME] for i in range(0, len(part), FRAME)]
            parts.append(_element(SIMPLE_BLOCK, block(1, b // UNIT - base, frames)))
        cluster = _element(CLUSTER, b"".join(parts))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, base) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(_element(CUES, b"".join(cues)))
    return head + _element(SEGMENT, b"".join(body))


# ---------------------------------------------------------------- reading

def _vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int, int]:
    """Value, next position and width of the variable-length integer at ``at``."""
    if at >= len(data):
        raise Damaged(f"end of file at byte {at}")
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise Damaged(f"bad variable-length integer at byte {at}")
    n = int.from_bytes(data[at:at + width], "big")
    return (n if keep_marker else n & (1 << 7 * width) - 1), at + width, width


def _lace(data: bytes, at: int, end: int) -> tuple[int, int, bool, int, list[tuple[int, int]]]:
    """Track, relative time, key flag, lacing and the byte ranges of a block's frames."""
    track, at, _ = _vint(data, at, False)
    if at + 3 > end:
        raise Damaged(f"short block at byte {at}")
    relative = int.from_bytes(data[at:at + 2], "big", signed=True)
    flags = data[at + 2]
    at += 3
    lacing = flags >> 1 & 3
    if lacing == NONE:
        return track, relative, bool(flags & 0x80), lacing, [(at, end - at)]
    if at >= end:
        raise Damaged(f"short block at byte {at}")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % count:
            raise Damaged(f"uneven fixed lacing at byte {at}")
        sizes = [(end - at) // count] * count
    else:
        for i in range(count - 1):
            if lacing == XIPH:
                n = 0
                while True:
                    if at >= end:
                        raise Damaged(f"short lace at byte {at}")
                    n, at = n + data[at], at + 1
                    if data[at - 1] < 255:
                        break
            else:
                n, at, width = _vint(data, at, False)
                if i:
                    n += sizes[-1] - ((1 << 7 * width - 1) - 1)
            sizes.append(n)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or sum(sizes) != end - at:
        raise Damaged(f"lace sizes disagree with the block at byte {at}")
    ranges = []
    for n in sizes:
        ranges.append((at, n))
        at += n
    return track, relative, bool(flags & 0x80), lacing, ranges


def parse(data: bytes | None) -> dict:
    """Tracks, packets, cues and the first problem of a file.

    Packets are ``(track, timestamp, lace, key, cluster, offset, length)``: the
    timestamp is the block's in ticks of the scale, ``lace`` the place of the
    frame in its block, ``cluster`` and ``offset`` are positions in the file.
    """
    out: dict = {"scale": 1_000_000, "tracks": {}, "packets": [], "cues": [], "lacings": set(), "segment": None, "problem": None}
    data = data or b""
    state = {"cluster": 0, "time": 0}

    def number(at, end):
        return int.from_bytes(data[at:end], "big")

    def frames(at, end, key=None):
        track, relative, flag, lacing, ranges = _lace(data, at, end)
        out["lacings"].add(lacing)
        out["packets"] += [(track, state["time"] + relative, i, flag if key is None else key, state["cluster"], a, n) for i, (a, n) in enumerate(ranges)]

    def walk(at, end, parent, into):
        while at < end:
            start = at
            key, at, _ = _vint(data, at, True)
            size, at, width = _vint(data, at, False)
            unknown = size == (1 << 7 * width) - 1
            if parent == CLUSTER and into.get("open") and key in TOP_LEVEL:
                return start
            stop = end if unknown else at + size
            if stop > end:
                raise Damaged(f"element at byte {start} is longer than its parent")
            if key == SIMPLE_BLOCK:
                frames(at, stop)
            elif key == TIMESTAMP:
                state["time"] = number(at, stop)
            elif key == BLOCK:
                into["block"] = (at, stop)
            elif key == REFERENCE:
                into["reference"] = True
            elif key == TIMESTAMP_SCALE:
                out["scale"] = number(at, stop)
            elif key in MASTERS:
                own: dict = {"open": unknown}
                if key == SEGMENT:
                    out["segment"] = at
                elif key == CLUSTER:
                    state["cluster"], state["time"] = start, 0
                left = walk(at, stop, key, own)
                if key == BLOCK_GROUP and "block" in own:
                    frames(*own["block"], key="reference" not in own)
                elif key == AUDIO:
                    into.update(own)
                elif key == TRACK_ENTRY:
                    out["tracks"][own.get(TRACK_NUMBER, 0)] = {"type": own.get(TRACK_TYPE), "codec": own.get(CODEC, ""), "bits": own.get(BIT_DEPTH)}
                elif key == CUE_POSITIONS:
                    into.setdefault("at", []).append((own.get(CUE_TRACK, 0), own.get(CUE_CLUSTER, 0)))
                elif key == CUE_POINT:
                    out["cues"] += [(own.get(CUE_TIME, 0), t, (out["segment"] or 0) + p) for t, p in own.get("at", [])]
                stop = left
            elif key in (TRACK_NUMBER, TRACK_TYPE, BIT_DEPTH, CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                into[key] = number(at, stop)
            elif key == CODEC:
                into[key] = data[at:stop].rstrip(b"\0").decode("ascii", "replace")
            at = stop
        return at

    try:
        if data[:4] != EBML.to_bytes(4, "big"):
            raise Damaged("no EBML header at byte 0")
        walk(0, len(data), 0, {})
    except (Damaged, RecursionError) as e:
        out["problem"] = str(e)
    return out


def read_back(data: bytes, track: int, found: dict) -> bytes:
    """Samples of one track in the order of its packets."""
    return b"".join(data[a:a + n] for t, _, _, _, _, a, n in found["packets"] if t == track)


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


# ---------------------------------------------------------------- operators

_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_PACKETS = pa.schema([
    ("doc_id", pa.int64()), ("track", pa.int64()), ("timestamp", pa.int64()), ("lace", pa.int32()), ("keyframe", pa.bool_()),
    ("cluster_at", pa.int64()), ("byte_at", pa.int64()), ("length", pa.int64())])
_FEATURES = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("problem", pa.string())])


def encode(docs: DataFrame) -> DataFrame:
    """Texts as Matroska files: ``doc_id, n_bytes, media``."""

    def run(batches):
        for b in slices(batches):
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            yield record(_MEDIA, [[r[0] for r in rows], [len((r[1] or "").encode("utf-8", "surrogatepass")) for r in rows], [write(payload_of(r[1])) for r in rows]])

    return docs.select(F.col("doc_id").cast("long"), text_column().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packets(media: DataFrame) -> DataFrame:
    """Packet table of a media column, one row per frame."""

    def run(batches):
        for b in slices(batches, "media"):
            rows = [(i, *p) for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for p in parse(m)["packets"]]
            yield record(_PACKETS, list(zip(*rows)) if rows else [[]] * len(_PACKETS))

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(
        run, "doc_id long, track long, timestamp long, lace int, keyframe boolean, cluster_at long, byte_at long, length long")


def features(media: DataFrame) -> DataFrame:
    """Digests and packet statistics of each file, from its stored bytes."""

    def one(i, n, data):
        found = parse(data)
        data = data or b""
        samples = read_back(data, 1, found)
        p = found["packets"]
        ends = {a: t for _, t, _, _, a, _, _ in reversed(p)}
        sound = all(ends.get(at) == t for t, _, at in found["cues"])
        said = (f"tracks={len(found['tracks'])};packets={len(p)};clusters={len(ends)};cues={len(found['cues'])};cues_sound={int(sound)};"
                f"last_ms={max((x[1] for x in p), default=0)};lacing={','.join(map(str, sorted(found['lacings'])))};"
                f"longest={max((x[6] for x in p), default=0)};silence={samples.count(0)}")
        return (i, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), said, found["problem"])

    def run(batches):
        for b in slices(batches, "media"):
            rows = [one(*r) for r in zip(*(c.to_pylist() for c in b.columns))]
            yield record(_FEATURES, list(zip(*rows)) if rows else [[]] * len(_FEATURES))

    return media.select(F.col("doc_id").cast("long"), "n_bytes", "media").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, problem string")
