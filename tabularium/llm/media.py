"""Media columns in baseline JPEG.

Reading: ``decode`` parses the markers, undoes byte stuffing, Huffman-decodes the scan and keeps the DC terms only,
which make a luminance thumbnail of one sample a block of 8 x 8. Restart intervals are independent by design, so all
intervals of a batch of images are decoded in step with each other, one numpy lane an interval.

Writing: ``encode`` makes a grey image whose thumbnail is a given byte string. A block's DC term, at quantiser 8,
is exactly its mean sample, so a byte b becomes the DC term b - 128 and comes back unchanged. Each 64 bytes are one
restart interval. The DC table gives category c a code of 9 - c bits, so a difference and its code always fill 9 bits.

Images with several scans (a component each) are read too: the thumbnail needs the first component's scan only.

Defined cases: a null or empty text is 64 zero bytes; a payload too tall for one image takes more columns, and one
too large for that, of a long text, several images one after the other; equal texts give equal bytes; repeated rows stay;
a null stream, and one that is damaged, empty or no baseline JPEG, gives a row with nulls for all that would be read from
it (a stream that isn't null keeps its size and hash) and the reason in ``problem``; keys may be of any type, null too; an
empty table gives no rows; columns other than key and text are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_text, free_name, quoted

UNIT = 64
#: Bytes worked on at once: few enough for the arrays to stay in a core's cache.
ENCODE_BYTES, DECODE_BYTES = 500_000, 1_000_000
#: Fixed values of the format: markers, and the most blocks a side (65535 samples).
SOI, EOI, SOF0, DHT, DQT, DRI, SOS, COM, RST0 = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE, 0xD0
SIDE = 65535 // 8


# --- writing -------------------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: DC: one code of each length 1..9, for the categories 8..0. AC: only "end of block", of 1 bit.
_DC_TABLE = bytes([0x00] + [1] * 9 + [0] * 7 + list(range(8, -1, -1)))
_AC_TABLE = bytes([0x10, 1] + [0] * 15 + [0])


def _block_words() -> np.ndarray:
    """For each difference -255..255: its 10 bits, which are DC code, magnitude and end of block."""
    out = np.zeros(511, np.uint64)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        code = (1 << (9 - c)) - 2  # 0, 10, 110, ... by length
        out[d + 255] = ((code << c | (d if d > 0 else d + (1 << c) - 1)) if c else code) << 1
    return out


_WORDS = _block_words()


def _head(columns: int, rows: int, payload: int) -> bytes:
    return b"".join([
        bytes([0xFF, SOI]),
        _segment(COM, b"payload %d" % payload),
        _segment(DQT, bytes([0, 8] + [1] * 63)),
        _segment(SOF0, struct.pack(">BHHBBBB", 8, rows * 8, columns * 8, 1, 1, 0x11, 0)),
        _segment(DHT, _DC_TABLE + _AC_TABLE),
        _segment(DRI, struct.pack(">H", UNIT)),
        _segment(SOS, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def _scan(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entropy-coded bytes of many intervals of 64 samples, stuffed, each followed by 2 free bytes; ends without these."""
    value = samples.reshape(-1, UNIT).astype(np.int16) - 128
    diff = np.diff(value, axis=1, prepend=np.int16(0))
    w = _WORDS[diff.reshape(-1, 4) + 255]
    packed = (w[:, 0] << np.uint64(30)) | (w[:, 1] << np.uint64(20)) | (w[:, 2] << np.uint64(10)) | w[:, 3]
    raw = packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].reshape(-1)  # 80 bytes an interval
    stuffed = raw == 0xFF
    shift = np.cumsum(stuffed) - stuffed
    at = np.arange(len(raw)) + shift + 2 * (np.arange(len(raw)) // 80)
    ends = (at + 1 + stuffed)[79::80]
    out = np.zeros(int(ends[-1]) + 2 if len(ends) else 0, np.uint8)
    out[at] = raw
    return out, ends


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG stream for each payload, whose length must be a positive multiple of 64."""
    frames: list[tuple[int, bytes, int, int, int]] = []  # payload, bytes, columns, rows, own length
    for i, p in enumerate(payloads):
        step = UNIT * (SIDE // UNIT) * SIDE
        for a in range(0, len(p), step):
            part = p[a : a + step]
            columns = UNIT * -(-len(part) // (UNIT * SIDE))
            rows = -(-len(part) // columns)
            frames.append((i, part.ljust(columns * rows, b"\0"), columns, rows, len(part)))
    out: list[list[bytes]] = [[] for _ in payloads]
    if not frames:
        return [b"" for _ in payloads]
    data, ends = _scan(np.frombuffer(b"".join(f[1] for f in frames), np.uint8))
    first, begin = 0, 0
    for i, part, columns, rows, own in frames:
        n = len(part) // UNIT
        marks = ends[first : first + n - 1]
        data[marks] = 0xFF
        data[marks + 1] = RST0 + np.arange(n - 1) % 8
        end = int(ends[first + n - 1])
        out[i] += [_head(columns, rows, own), data[begin:end].tobytes(), bytes([0xFF, EOI])]
        first, begin = first + n, end + 2
    return [b"".join(x) for x in out]


# --- reading -------------------------------------------------------------------------------------------------------


@dataclass
class Frame:
    """What the markers of one image say."""

    width: int = 0
    height: int = 0
    components: list = field(default_factory=list)  # (id, h, v, quantiser)
    scan: list = field(default_factory=list)  # (component index, DC table, AC table)
    quantisers: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)
    restart: int = 0
    scan_tables: dict = field(default_factory=dict)  # as they were at the scan that is kept
    scan_restart: int = 0
    comment: bytes = b""
    data: np.ndarray | None = None


def parse(stream: bytes) -> list[Frame]:
    """The images of a stream, one after the other. Progressive, arithmetic and lossless kinds raise ValueError."""
    out, at, n = [], 0, len(stream)
    whole = np.frombuffer(stream, np.uint8)
    while at + 1 < n:
        if stream[at] != 0xFF or stream[at + 1] != SOI:
            raise ValueError("not a JPEG stream")
        f, at = Frame(), at + 2
        while True:
            while at < n and stream[at] == 0xFF and at + 1 < n and stream[at + 1] == 0xFF:
                at += 1
            if at + 3 >= n or stream[at] != 0xFF:
                if at + 1 < n and stream[at : at + 2] == bytes([0xFF, EOI]):
                    at += 2
                    break
                raise ValueError("truncated JPEG stream")
            marker = stream[at + 1]
            if marker == EOI:
                at += 2
                break
            size = int.from_bytes(stream[at + 2 : at + 4], "big")
            body, at = stream[at + 4 : at + 2 + size], at + 2 + size
            if marker == SOF0:
                _, f.height, f.width, parts = struct.unpack(">BHHB", body[:6])
                f.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(parts)]
            elif 0xC1 <= marker <= 0xCF and marker not in (DHT, 0xC8, 0xCC):
                raise ValueError(f"not a baseline JPEG: marker {marker:02x}")
            elif marker == DQT:
                while body:
                    wide = body[0] >> 4
                    f.quantisers[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")  # the DC quantiser comes first
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == DHT:
                while body:
                    count = sum(body[1:17])
                    f.tables[body[0]] = body[1 : 17 + count]
                    body = body[17 + count :]
            elif marker == DRI:
                f.restart = int.from_bytes(body, "big")
            elif marker == COM:
                f.comment = body
            elif marker == SOS:
                ids = [c[0] for c in f.components]
                scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, 0x10 | body[2 + 2 * i] & 15) for i in range(body[0])]
                marks = _next_marker(whole, at)
                if any(c == 0 for c, _, _ in scan) and f.data is None:  # the scan that has the luminance, with the tables of its time
                    f.scan, f.data, f.scan_tables, f.scan_restart = scan, whole[at:marks], dict(f.tables), f.restart
                at = marks
        out.append(f)
    return out


def _next_marker(whole: np.ndarray, at: int) -> int:
    """Where the entropy-coded data ends: at FF followed by neither 00 nor a restart marker."""
    step = 1 << 16
    while at < len(whole):
        part = whole[at : at + step + 1]
        hit = np.flatnonzero((part[:-1] == 0xFF) & (part[1:] != 0) & ((part[1:] & 0xF8) != RST0))
        if len(hit):
            return at + int(hit[0])
        at += step
    raise ValueError("truncated JPEG stream")


_LOOKUP: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits that may follow: length of the code they begin with << 8 | symbol; 0 if there is no such code."""
    if table not in _LOOKUP:
        if len(_LOOKUP) > 64:
            _LOOKUP.clear()
        out, code, k = np.zeros(1 << 16, np.int32), 0, 16
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                a = code << (16 - length)
                out[a : a + (1 << (16 - length))] = length << 8 | table[k]
                code, k = code + 1, k + 1
            code <<= 1
        _LOOKUP[table] = out
    return _LOOKUP[table]


def _intervals(f: Frame) -> tuple[np.ndarray, np.ndarray]:
    """The scan's bytes without stuffing and restart markers, and where its intervals begin in them."""
    d = f.data
    after = np.zeros(len(d), bool)
    after[1:] = d[:-1] == 0xFF
    mark = after & (d >= RST0) & (d <= RST0 + 7)
    drop = (after & (d == 0)) | mark
    drop[:-1] |= mark[1:]
    kept = np.cumsum(~drop)
    return d[~drop], np.concatenate(([0], kept[np.flatnonzero(mark)]))


def decode(streams: list[bytes]) -> list[list[tuple[Frame, np.ndarray]]]:
    """For each stream its images with their DC-only luminance thumbnails (uint8, a sample a block)."""
    out: list[list] = [[] for _ in streams]
    alike: dict[tuple, list] = {}
    for i, s in enumerate(streams):
        for f in parse(s):
            if not f.components or f.data is None:
                raise ValueError("an image without a frame or scan")
            key = (tuple(c[1:3] for c in f.components), tuple(f.scan), tuple(sorted(f.scan_tables.items())))
            alike.setdefault(key, []).append((i, len(out[i]), f))
            out[i].append(None)
    for group in alike.values():
        for (i, k, f), thumb in zip(group, _decode_alike([f for _, _, f in group])):
            out[i][k] = (f, thumb)
    return out


def _decode_alike(frames: list[Frame]) -> list[np.ndarray]:
    """Thumbnails of images that have components and Huffman tables in common."""
    one = frames[0]
    single = len(one.scan) == 1  # blocks of one component come row by row
    order = [(c, dc, ac) for c, dc, ac in one.scan for _ in range(1 if single else one.components[c][1] * one.components[c][2])]
    h_max, v_max = max(c[1] for c in one.components), max(c[2] for c in one.components)
    h, v = one.components[0][1:3]
    if single:
        h_max, v_max, h, v = h_max / h, v_max / v, 1, 1
    buffers, starts, units, shape, base = [], [], [], [], 0
    for f in frames:
        across, down = math.ceil(f.width / (8 * h_max)), math.ceil(f.height / (8 * v_max))
        data, begin = _intervals(f)
        per = f.scan_restart or across * down
        if not 0 < across * down * len(order) <= 4 * len(data):  # a block takes two bits at least
            raise ValueError("no blocks, or more than there are data for")
        n = -(-(across * down) // per)
        if len(begin) < n:
            raise ValueError("an interval is missing")
        buffers += [data, np.full(16, 0xFF, np.uint8)]
        starts.append(begin[:n] + base)
        units.append(np.minimum(per, across * down - per * np.arange(n)))
        shape.append((across, down))
        base += len(data) + 16
    data = np.concatenate(buffers)
    window = (data[:-3].astype(np.uint32) << 24) | (data[1:-2].astype(np.uint32) << 16) | (data[2:-1].astype(np.uint32) << 8) | data[3:]
    at, units = np.concatenate(starts) * 8, np.concatenate(units)
    luma = next(k for k, (c, _, _) in enumerate(order) if c == 0)
    own = sum(c == 0 for c, _, _ in order)
    dc = np.zeros((len(at), int(units.max()), own), np.int32)
    last = np.zeros((len(one.components), len(at)), np.int32)
    steps = {t: _lookup(one.scan_tables[t]) for _, a, b in order for t in (a, b)}
    limit = 8 * (len(window) - 1)

    def peek(bit: np.ndarray, n: int) -> np.ndarray:
        bit = np.minimum(bit, limit)
        return (window[bit >> 3] << (bit & 7).astype(np.uint32)) >> np.uint32(32 - n)

    same = units.min() == units.max()
    for u in range(int(units.max())):
        lanes = slice(None) if same else np.flatnonzero(units > u)
        pos = at[lanes]
        for k, (c, d, a) in enumerate(order):
            got = steps[d][peek(pos, 16)]
            if not got.all():
                raise ValueError("a code that is in no table")
            size = got & 0xFF
            pos = pos + (got >> 8)
            bits = (peek(pos, 16) >> (16 - size).astype(np.uint32)).astype(np.int32)
            diff = np.where(bits < (1 << size) >> 1, bits - (1 << size) + 1, bits)
            pos = pos + size
            last[c, lanes] += diff
            if luma <= k < luma + own:
                dc[lanes, u, k - luma] = last[c, lanes]
            open_, seen = np.arange(len(pos)), np.ones(len(pos), np.int32)
            while len(open_):  # skip the AC terms
                got = steps[a][peek(pos[open_], 16)]
                if not got.all():
                    raise ValueError("a code that is in no table")
                sym = got & 0xFF
                pos[open_] += (got >> 8) + (sym & 15)
                end = sym == 0
                if end.all():
                    break
                seen[open_] += (sym >> 4) + 1
                open_ = open_[~end & (seen[open_] < 64)]
        at[lanes] = pos
    out, first = [], 0
    for f, (across, down), begin in zip(frames, shape, starts):
        n = len(begin)
        flat = dc[first : first + n].reshape(-1, own)[: across * down] if f.scan_restart else dc[first, : across * down]
        if f.scan_restart and f.scan_restart != dc.shape[1]:
            flat = dc[first : first + n, : f.scan_restart].reshape(-1, own)[: across * down]
        first += n
        image = flat.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        q = f.quantisers[f.components[0][3]]
        image = np.clip(np.rint(image[: -(-f.height // 8), : -(-f.width // 8)] * (q / 8) + 128), 0, 255)
        out.append(image.astype(np.uint8))
    return out


def thumbnail_hash(thumb: np.ndarray) -> str:
    """16 hex digits: which of 8 x 8 area means of a thumbnail are above their right neighbour (the last: above the first)."""
    rows, cols = thumb.shape
    r = np.arange(8) * rows // 8
    c = np.arange(8) * cols // 8
    sums = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), c, axis=1), r, axis=0)
    count = np.outer(np.maximum(1, np.diff(np.append(r, rows))), np.maximum(1, np.diff(np.append(c, cols))))
    mean = sums / count
    return np.packbits((mean > np.roll(mean, -1, axis=1)).reshape(-1)).tobytes().hex()


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The number of UTF-8 bytes of a text and these bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


def with_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a JPEG stream."""

    def store(texts: list) -> pa.Array:
        sizes, payloads = zip(*map(payload_of, texts))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(encode(list(payloads)), pa.binary())], names=["n_bytes", "media"])

    made = by_text("n_bytes long, media binary", store, ENCODE_BYTES)(quoted(text).cast("string"))
    return docs.select(quoted(key).alias("doc_id"), made.alias("made")).select("doc_id", "made.n_bytes", "made.media")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, problem string"


def media_features(media: DataFrame, stream: str = "media") -> DataFrame:
    """Features of stored streams: dimensions, thumbnail hash, and what the thumbnail holds when read as a payload. The
    stream's column is replaced by them; the others stay."""
    name = free_name(media, "features")
    rows = media.select(*[quoted(c) for c in media.columns if c != stream], by_text(FEATURES, _features, DECODE_BYTES)(quoted(stream)).alias(name))
    return rows.select(*[quoted(c) for c in media.columns if c != stream], f"{name}.*")


def _features(streams: list) -> pa.Array:
    there = [s for s in streams if s is not None]
    try:
        found = [(images, None) for images in decode(there)]
    except _PROBLEMS:
        found = list(map(_alone, there))
    rows, given = [], iter(found)
    for s in streams:
        images, problem = next(given) if s is not None else (None, "null")
        about = (None, None) if s is None else (len(s), hashlib.sha256(s).hexdigest())
        if not images:
            rows.append((None, None, None, *about, None, None, None, problem or "empty"))
            continue
        payload = b"".join(t.tobytes()[: int(f.comment.split()[1]) if f.comment.startswith(b"payload ") else None] for f, t in images)
        f = images[0][0]
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), *about, f"{f.width}x{f.height}:" + "".join(thumbnail_hash(t) for _, t in images), f.width, f.height, None))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in FEATURES.split(", ")])


#: What reading a damaged stream may raise.
_PROBLEMS = (ValueError, IndexError, KeyError, StopIteration, struct.error, OverflowError, ZeroDivisionError)


def _alone(stream: bytes) -> tuple[list | None, str | None]:
    try:
        return decode([stream])[0], None
    except _PROBLEMS as e:
        return None, f"{type(e).__name__}: {e}"
