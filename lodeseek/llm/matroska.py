"""Matroska media columns: a writer of 8-bit PCM audio files, and a parser of EBML elements into packet tables.

The parser reads variable-length ids and sizes, also unknown sizes of segments and clusters, SimpleBlocks and
BlockGroups, the four kinds of lacing, and cues. Every frame becomes one packet with its track, timestamp, key flag and
byte range in the file, so that its payload can be read without parsing again. Cues give the cluster to begin with for a
time, so that seeking steps over the ones before it.

Defined results: null media have no packets and no error; broken or cut media yield the packets up to the fault and an
error text, also where the segment or a cluster is cut off; numbers beyond 64 bits, times beyond those of a long, and
durations that are not finite are faults; a null text is stored as an empty one; very long texts are one file each,
taken one at a time; equal texts give equal files; repeated rows each get their row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements at the level of clusters, which end a cluster of unknown size.
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

RATE = 8_000
FRAME = 256
FRAMES_IN_BLOCK = 8
BLOCKS_IN_CLUSTER = 4
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
LONG = 1 << 63


class Broken(ValueError):
    """The bytes are not well-formed media."""


# ---------------------------------------------------------------- writing


def vint(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """Frames behind the lacing header that tells their sizes."""
    if kind == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == XIPH:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == EBML_LACING:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            d = b - a
            w = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1))
            head += vint(d + (1 << 7 * w - 1) - 1, w)
    return head + b"".join(frames)


def block(ident: int, track: int, offset: int, frames: list[bytes], kind: int) -> bytes:
    flags = kind << 1 | (0x80 if ident == SIMPLE_BLOCK else 0)
    return element(ident, vint(track) + struct.pack(">hB", offset, flags) + lace(frames, kind))


_HEAD = element(
    EBML,
    number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8)
    + element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ_VERSION, 2),
)
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT")
        + number(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8)),
    ),
)


def mux(payload: bytes) -> bytes:
    """A file of one track of 8-bit samples at 8 kHz. Blocks of up to 8 frames of 32 ms; the last, uneven ones tell their sizes."""
    span = FRAME * FRAMES_IN_BLOCK
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXING_APP, b"lodeseek") + element(WRITING_APP, b"lodeseek"))
    parts, at, points = [info, _TRACKS], len(info) + len(_TRACKS), []
    for lo in range(0, len(payload), span * BLOCKS_IN_CLUSTER):
        time = lo * 1000 // RATE
        body = [number(TIMESTAMP, time)]
        for b in range(lo, min(lo + span * BLOCKS_IN_CLUSTER, len(payload)), span):
            piece = payload[b : b + span]
            frames = [piece[i : i + FRAME] for i in range(0, len(piece), FRAME)]
            kind = NO_LACING if len(frames) == 1 else FIXED if len(piece) == span else EBML_LACING if len(frames) > 2 else XIPH
            body.append(block(SIMPLE_BLOCK, 1, b * 1000 // RATE - time, frames, kind))
        cluster = element(CLUSTER, b"".join(body))
        points.append(element(CUE_POINT, number(CUE_TIME, time) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(points)))
    return _HEAD + element(SEGMENT, b"".join(parts))


# ---------------------------------------------------------------- parsing


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """Value, the place behind it, and whether it is the reserved all-ones value."""
    if at >= len(data) or data[at] == 0:
        raise Broken(f"no variable-length number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Broken(f"cut off at byte {len(data)}")
    n = int.from_bytes(data[at : at + width], "big")
    bare = n & (1 << 7 * width) - 1
    return n if keep_marker else bare, at + width, bare == (1 << 7 * width) - 1


def elements(data: bytes, at: int, end: int, ends_at: set[int] | None = None) -> Iterator[tuple[int, int, int, bool]]:
    """(id, start of the body, its end, whether its size is unknown) of the elements from at to end.

    An element of unknown size is given up to end; who reads it sends back where it ended. A segment or cluster that is
    cut off is given as far as it goes, before the fault is raised."""
    while at < end:
        ident, body, _ = read_vint(data, at, keep_marker=True)
        if ends_at and ident in ends_at:
            return
        n, body, unknown = read_vint(data, body)
        stop = end if unknown else body + n
        if stop > end:
            if ident in (SEGMENT, CLUSTER):
                yield ident, body, end, False  # what is there of it
            raise Broken(f"element {ident:X} at byte {at} ends beyond its parent")
        back = yield ident, body, stop, unknown
        at = stop if back is None else back


@dataclass
class Media:
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    #: track, timestamp in ns, byte offset, size, key flag, lacing, cluster number
    packets: list[tuple[int, int, int, int, bool, int, int]] = field(default_factory=list)
    scale: int = 1_000_000
    duration: float = 0.0
    clusters: int = 0
    doc_type: str = ""
    error: str | None = None


def unlace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte range of each frame of a block's body."""
    if kind == NO_LACING:
        return [(at, end)]
    if at >= end:
        raise Broken(f"no lacing header at byte {at}")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == FIXED:
        if (end - at) % n:
            raise Broken(f"frames of unequal size at byte {at}")
        sizes = [(end - at) // n] * n
    elif kind == XIPH:
        for _ in range(n - 1):
            s = 0
            while at < end and data[at] == 255:
                s, at = s + 255, at + 1
            if at >= end:
                raise Broken(f"cut off lacing at byte {at}")
            s, at = s + data[at], at + 1
            sizes.append(s)
    else:
        s, at, _ = read_vint(data, at)
        sizes.append(s)
        for _ in range(n - 2):
            start = at
            d, at, _ = read_vint(data, at)
            s += d - ((1 << 7 * (at - start) - 1) - 1)
            sizes.append(s)
        sizes = sizes[: n - 1]
    if kind != FIXED:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Broken(f"frames beyond the block at byte {at}")
    out = []
    for s in sizes:
        out.append((at, at + s))
        at += s
    return out


def _block(m: Media, data: bytes, at: int, end: int, time: int, key: bool | None) -> None:
    track, at, _ = read_vint(data, at)
    if at + 3 > end:
        raise Broken(f"cut off block at byte {at}")
    offset, flags = struct.unpack_from(">hB", data, at)
    kind = flags >> 1 & 3
    step = m.tracks.get(track, {}).get("default_duration", 0)
    base = (time + offset) * m.scale
    frames = unlace(data, at + 3, end, kind)
    if not all(-LONG <= t < LONG for t in (base, base + len(frames) * step)):
        raise Broken(f"time beyond 64 bits at byte {at}")
    for i, (a, b) in enumerate(frames):
        m.packets.append((track, base + i * step, a, b - a, bool(flags & 0x80) if key is None else key, kind, m.clusters - 1))


def _uint(data: bytes, a: int, b: int) -> int:
    if b - a > 8:
        raise Broken(f"number beyond 64 bits at byte {a}")
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    x = struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b - a in (4, 8) else 0.0
    if not math.isfinite(x):
        raise Broken(f"no finite number at byte {a}")
    return x


def _cluster(m: Media, data: bytes, at: int, end: int, unknown: bool) -> int:
    m.clusters += 1
    time, stop = 0, at
    for ident, a, b, _ in elements(data, at, end, TOP if unknown else None):
        stop = b
        if ident == TIMESTAMP:
            time = _uint(data, a, b)
        elif ident == SIMPLE_BLOCK:
            _block(m, data, a, b, time, None)
        elif ident == BLOCK_GROUP:
            inside = list(elements(data, a, b))
            refers = any(i == REFERENCE_BLOCK for i, *_ in inside)
            for i, c, d, _ in inside:
                if i == BLOCK:
                    _block(m, data, c, d, time, not refers)
    return stop if unknown else end


def _track(m: Media, data: bytes, at: int, end: int) -> None:
    t: dict = {}
    for ident, a, b, _ in elements(data, at, end):
        if ident in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
            t[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_duration"}[ident]] = _uint(data, a, b)
        elif ident == CODEC_ID:
            t["codec"] = data[a:b].rstrip(b"\0").decode("ascii", "replace")
        elif ident == AUDIO:
            for i, c, d, _ in elements(data, a, b):
                if i == SAMPLING:
                    t["rate"] = _float(data, c, d)
                elif i in (CHANNELS, BIT_DEPTH):
                    t["channels" if i == CHANNELS else "bits"] = _uint(data, c, d)
    m.tracks[t.get("number", 0)] = t


def _cues(m: Media, data: bytes, at: int, end: int, base: int) -> None:
    for ident, a, b, _ in elements(data, at, end):
        if ident != CUE_POINT:
            continue
        time, places = 0, []
        for i, c, d, _ in elements(data, a, b):
            if i == CUE_TIME:
                time = _uint(data, c, d)
            elif i == CUE_POSITIONS:
                got = {j: _uint(data, e, f) for j, e, f, _ in elements(data, c, d)}
                places.append((got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER, 0) + base))
        m.cues += [(time * m.scale, t, p) for t, p in places]


def parse(data: bytes, step_over: bool = False) -> Media:
    """Everything up to the first fault, which is told in error; clusters of known size are stepped over on demand."""
    m = Media()
    try:
        for ident, a, b, _ in elements(data, 0, len(data)):
            if ident == EBML:
                for i, c, d, _ in elements(data, a, b):
                    if i == DOC_TYPE:
                        m.doc_type = data[c:d].decode("ascii", "replace")
                if m.doc_type not in ("matroska", "webm"):
                    raise Broken(f"document type {m.doc_type!r}")
            elif ident == SEGMENT:
                inside, back = elements(data, a, b), None
                while True:
                    try:
                        i, c, d, unknown = inside.send(back)
                    except StopIteration:
                        break
                    back = None
                    if i == INFO:
                        for j, e, f, _ in elements(data, c, d):
                            if j == TIMESTAMP_SCALE:
                                m.scale = _uint(data, e, f)
                            elif j == DURATION:
                                m.duration = _float(data, e, f)
                        if not math.isfinite(m.duration * m.scale):
                            raise Broken("a duration beyond all times")
                    elif i == TRACKS:
                        for j, e, f, _ in elements(data, c, d):
                            if j == TRACK_ENTRY:
                                _track(m, data, e, f)
                    elif i == CLUSTER and step_over and not unknown:
                        m.clusters += 1
                    elif i == CLUSTER:
                        back = _cluster(m, data, c, d, unknown)
                    elif i == CUES:
                        _cues(m, data, c, d, a)
        if not m.doc_type:
            raise Broken("no EBML header")
    except Broken as fault:
        m.error = str(fault)
    return m


def seek(data: bytes, ns: int) -> Media:
    """The packets of the cluster that the cues give for a time, read without those before it; all packets where no cue helps."""
    m = parse(data, step_over=True)
    places = sorted({(t, p) for t, _, p in m.cues if t <= ns})
    if m.error or not places:
        return parse(data)
    m.packets, m.clusters = [], sum(p < places[-1][1] for p in {p for _, _, p in m.cues})
    try:
        ident, body, stop, unknown = next(elements(data, places[-1][1], len(data)), (0, 0, 0, False))
        if ident != CLUSTER:
            raise Broken(f"no cluster at byte {places[-1][1]}")
        _cluster(m, data, body, stop, unknown)
    except Broken as fault:
        m.error = str(fault)
    return m


PACKETS = "track long, timestamp_ns long, byte_offset long, size long, key boolean, lacing int, cluster int"


def packets(media: DataFrame, key: str, column: str = "media") -> DataFrame:
    """A row for each packet of media(key, column), and one with null packet columns for media without any."""
    given = media.select(F.struct(key).alias("keep"), F.col(column).alias("media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_py()
                m = parse(raw) if raw is not None else Media()
                rows = m.packets or [(None,) * 7]
                names = [f.split()[0] for f in PACKETS.split(", ")]
                types = [pa.int64()] * 4 + [pa.bool_(), pa.int32(), pa.int32()]
                cols = {n: pa.array(c, t) for n, t, c in zip(names, types, zip(*rows, strict=True), strict=True)}
                one = batch.column(0).take(pa.array([i] * len(rows)))
                yield pa.RecordBatch.from_pydict({"keep": one} | cols | {"error": pa.array([m.error] * len(rows), pa.string())})

    kind = given.schema["keep"].dataType.simpleString()
    return given.mapInArrow(run, f"keep {kind}, {PACKETS}, error string").select("keep.*", *[f.split()[0] for f in PACKETS.split(", ")], "error")


# ---------------------------------------------------------------- texts as media


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 64 if raw else 64)


def features(m: Media, data: bytes, payload: bytes) -> str:
    """What the packet table says of a file, as a short text."""
    keys = sum(p[4] for p in m.packets)
    laced = [sum(p[5] == k for p in m.packets) for k in range(4)]
    starts = {p for _, _, p in m.cues}
    last = max((p[1] for p in m.packets), default=0)
    low = len(payload.translate(None, _HIGH))
    middle = max((p for p in seek(data, last // 2).packets if p[1] <= last // 2), key=lambda p: p[1], default=None)
    return (
        f"codec={m.tracks.get(1, {}).get('codec', '')};tracks={len(m.tracks)};clusters={m.clusters};cues={len(starts)};packets={len(m.packets)};keys={keys};"
        f"laced={'/'.join(map(str, laced))};last_ms={last // 1_000_000};duration_ms={int(m.duration * m.scale / 1_000_000)};largest={max((p[3] for p in m.packets), default=0)};"
        f"ascii={low / max(1, len(payload)):.4f};overhead={len(data) - len(payload)};"
        f"middle={f'{middle[1] // 1_000_000}@{middle[2]}' if middle else ''}"
    )


_HIGH = bytes(range(128, 256))


def stored(docs: DataFrame, *keep: str, with_media: bool = False) -> DataFrame:
    """Each text as a file, and what is read back from the stored bytes by way of their packets."""
    given = docs.select(F.struct(*keep).alias("keep"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            cols: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media")}
            for text in part.column(1).to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                data = mux(padded(raw))
                m = parse(data)
                if m.error:
                    raise Broken(m.error)
                payload = b"".join([data[a : a + n] for _, _, a, n, *_ in m.packets])
                for k, v in (
                    ("n_bytes", len(raw)), ("payload_bytes", len(payload)), ("payload_sha256", hashlib.sha256(payload).hexdigest()), ("tail_crc32", zlib.crc32(payload[-64:])),
                    ("media_bytes", len(data)), ("media_sha256", hashlib.sha256(data).hexdigest()), ("feature", features(m, data, payload)), ("media", data if with_media else None),
                ):
                    cols[k].append(v)
            types = {"media": pa.binary()} | {k: pa.int64() for k in ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes")}
            yield pa.RecordBatch.from_pydict({"keep": part.column(0)} | {k: pa.array(v, types.get(k, pa.string())) for k, v in cols.items() if k != "media" or with_media})

    kind = given.schema["keep"].dataType.simpleString()
    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media
    return given.mapInArrow(run, f"keep {kind}, {schema}").select("keep.*", *[c.split()[0] for c in schema.split(", ")])
