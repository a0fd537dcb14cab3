"""Media columns: motion-JPEG in AVI containers.

Stored texts are lossless JPEG frames (process 14, marker SOF3: 8-bit samples, left-neighbour prediction, Huffman-coded
differences), so a payload survives storage bit for bit. Files from elsewhere may also hold ordinary motion-JPEG (baseline or
extended sequential DCT, SOF0 and SOF1), of which the luminance is decoded. Frames without table segments use the default tables,
as motion-JPEG allows. Frames are found by the OpenDML index (`indx`, `ix##`) or the old one (`idx1`); parts that no index names
(further RIFF parts `AVIX`, files without an index) are walked chunk by chunk.

Defined results: a null or empty text stores 192 spaces (one frame, one shot); a very long text is coded and read in pieces of
`PIECE` frames; repeated rows give repeated, equal rows; an empty table gives an empty table; extra columns are ignored. Bytes that
are no AVI file, or a damaged one, raise ValueError in the functions on bytes; `media_clips` gives them one row with `error`. A
file without frames has no shots and no clip rows; a clip without cuts is one shot.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, id_text

WIDTH, HEIGHT, FPS = 16, 12, 25
UNIT, PIECE = WIDTH * HEIGHT, 4096
#: Code lengths and symbols of the default tables of ITU-T T.81, K.3: DC and AC of luminance, DC and AC of chrominance.
DEFAULT_TABLE = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12)))
DEFAULT_AC = (
    bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]),
    bytes.fromhex(
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
        "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
        "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
    ),
)
DEFAULT_CHROMA_DC = (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12)))
DEFAULT_CHROMA_AC = (
    bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]),
    bytes.fromhex(
        "0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a"
        "434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
        "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
    ),
)


def codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), canonical."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def _encoder() -> tuple[np.ndarray, np.ndarray]:
    """Bits and bit count of every difference -255..255."""
    table = codes(*DEFAULT_TABLE)
    bits, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code, n = table[s]
        bits[d + 255], size[d + 255] = code << s | (d if d > 0 else d + (1 << s) - 1), n + s
    return bits, size


BITS, SIZE = _encoder()
HEAD = b"\xff\xd8\xff\xc3" + struct.pack(">HBHHB3B", 11, 8, HEIGHT, WIDTH, 1, 1, 0x11, 0) + b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0, 1, 0, 0)
EOI = b"\xff\xd9"


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Entropy-coded scans, stuffed, of frames shaped (n, HEIGHT, WIDTH)."""
    n = len(samples)
    x = samples.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    d = d.reshape(n, UNIT) + 255
    value, size = BITS[d], SIZE[d]
    end = np.cumsum(size, axis=1)
    length = (end[:, -1] + 7) // 8
    base = np.concatenate(([0], np.cumsum(length)))
    at = (base[:-1, None] * 8 + end - size).ravel()
    value = value.ravel() << (24 - size.ravel() - (at & 7))
    at >>= 3
    total = int(base[-1])
    out = np.zeros(total + 3)
    for k, shift in enumerate((16, 8, 0)):
        out[k:] += np.bincount(at, weights=(value >> shift) & 255, minlength=total + 3)[: total + 3 - k]
    out = out[:total].astype(np.uint8)
    pad = (length * 8 - end[:, -1]).astype(np.uint8)
    out[base[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)  # ones fill the last byte
    full = np.flatnonzero(out == 255)
    if len(full):
        base = base + np.searchsorted(full, base)
        out = np.insert(out, full + 1, 0)
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(scans: list[bytes]) -> bytes:
    n = len(scans)
    jpegs = [HEAD + s + EOI for s in scans]
    most = max(map(len, jpegs))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", UNIT, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    movi, index, at = [b"movi"], np.zeros(n, [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]), 4
    size = [len(j) for j in jpegs]
    for j, s in zip(jpegs, size, strict=True):
        movi += (b"00dc", s.to_bytes(4, "little"), j, b"\0" * (s & 1))
    index["id"], index["flags"], index["size"] = b"00dc", 0x10, size
    steps = 8 + index["size"].astype(np.int64) + (index["size"] & 1)
    index["at"] = at + np.concatenate(([0], np.cumsum(steps)[:-1]))
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", index.tobytes()))


def _chunks(media: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, begin and end of the body) of the chunks in a stretch."""
    while at + 8 <= end:
        size = int.from_bytes(media[at + 4 : at + 8], "little")
        yield media[at : at + 4], at + 8, min(end, at + 8 + size)
        at += 8 + size + (size & 1)


def parse_avi(media: bytes) -> tuple[int, list[tuple[int, int]]]:
    """(microseconds a frame, [(start, end) of each frame of the first video stream])"""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    micros, stream, video, movis, old, supers = 0, -1, None, [], None, []
    for riff, begin, end in _chunks(media, 0, len(media)):
        if riff != b"RIFF" or media[begin : begin + 4] not in (b"AVI ", b"AVIX"):
            continue
        for name, a, b in _chunks(media, begin + 4, end):
            kind = media[a : a + 4]
            if name == b"LIST" and kind == b"hdrl":
                for part, c, d in _chunks(media, a + 4, b):
                    if part == b"avih":
                        micros = int.from_bytes(media[c : c + 4], "little")
                    elif part == b"LIST" and media[c : c + 4] == b"strl":
                        stream += 1
                        for own, e, f in _chunks(media, c + 4, d):
                            if own == b"strh" and media[e : e + 4] == b"vids" and video is None:
                                video = stream
                                scale, rate = struct.unpack_from("<II", media, e + 20)
                                micros = round(1_000_000 * scale / rate) if scale and rate else micros
                            elif own == b"indx" and video == stream:
                                supers.append((e, f))
            elif name == b"LIST" and kind == b"movi":
                movis.append((a, b))
            elif name == b"idx1" and old is None:
                old = (a, b)
    if not movis:
        raise ValueError("an AVI file without frames")
    names = [b"%02d%s" % (video or 0, k) for k in (b"dc", b"db")]
    frames: list[tuple[int, int]] = []
    for a, b in supers:
        frames += _indexed(media, a, b)
    walked = [] if supers else movis
    if old and not supers:
        index = np.frombuffer(media, [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")], (old[1] - old[0]) // 16, old[0])
        index = index[np.isin(index["id"], names)]
        if len(index):
            start = index["at"].astype(np.int64) + 8
            start += 0 if media[start[0] - 8 : start[0] - 4] == index["id"][0] else movis[0][0]
            frames, walked = list(zip(start.tolist(), (start + index["size"]).tolist(), strict=True)), movis[1:]
    for a, b in walked:
        frames += _walked(media, a + 4, b, names)
    if frames and max(b for _, b in frames) > len(media):
        raise ValueError("an AVI file that is cut off")
    return micros or 40_000, [f for f in frames if f[1] > f[0]]


def _walked(media: bytes, a: int, b: int, names: list[bytes]) -> list[tuple[int, int]]:
    out = []
    for name, c, d in _chunks(media, a, b):
        if name in names:
            out.append((c, d))
        elif name == b"LIST" and media[c : c + 4] == b"rec ":
            out += _walked(media, c + 4, d, names)
    return out


def _indexed(media: bytes, a: int, b: int) -> list[tuple[int, int]]:
    """Frames of an OpenDML index whose body is at a: of its parts (kind 0), or its own (kind 1)."""
    n, kind = struct.unpack_from("<I", media, a + 4)[0], media[a + 3]
    if kind == 0:
        out = []
        for k in range(n):
            at, size = struct.unpack_from("<QI", media, a + 24 + 16 * k)
            out += _indexed(media, at + 8, at + size)
        return out
    base = struct.unpack_from("<Q", media, a + 12)[0]
    entry = np.frombuffer(media, [("at", "<u4"), ("size", "<u4")], n, a + 24)
    start = base + entry["at"].astype(np.int64)
    return list(zip(start.tolist(), (start + (entry["size"] & 0x7FFFFFFF)).tolist(), strict=True))


@dataclass
class Jpeg:
    """Headers of one frame; `used` is their length."""

    used: int = 0
    process: int = -1
    width: int = 0
    height: int = 0
    parts: tuple[tuple[int, int, int, int], ...] = ()  # id, horizontal and vertical sampling, quantiser
    scan: tuple[tuple[int, int, int], ...] = ()  # id, DC table, AC table
    predictor: int = 0
    restart: int = 0
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    dc: dict[int, tuple[bytes, bytes]] = field(default_factory=lambda: {0: DEFAULT_TABLE, 1: DEFAULT_CHROMA_DC})
    ac: dict[int, tuple[bytes, bytes]] = field(default_factory=lambda: {0: DEFAULT_AC, 1: DEFAULT_CHROMA_AC})


def parse_jpeg(frame: bytes) -> Jpeg:
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, out = 2, Jpeg()
    while at + 4 <= len(frame):
        mark, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                out.quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                counts = body[1:17]
                (out.ac if body[0] >> 4 else out.dc)[body[0] & 15] = (counts, body[17 : 17 + sum(counts)])
                body = body[17 + sum(counts) :]
        elif mark in (0xC0, 0xC1, 0xC2, 0xC3):
            out.process, out.height, out.width = mark, int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            out.parts = tuple((body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3))
        elif mark == 0xDD:
            out.restart = int.from_bytes(body[:2], "big")
        elif mark == 0xDA:
            out.scan = tuple((body[k], body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2))
            out.used, out.predictor = at, body[1 + 2 * body[0]]
            return out
    raise ValueError("a JPEG frame without a scan")


def zigzag() -> list[int]:
    """Place in the block (row * 8 + column) of each coefficient."""
    return [r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))]


COSINE = np.array([[(0.125 if k == 0 else 0.25) ** 0.5 * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])


def _ladder(table: tuple[bytes, bytes]) -> list[int]:
    """symbol << 5 | length, by the next 16 bits."""
    out = [0] * (1 << 16)
    for s, (code, n) in codes(*table).items():
        out[code << 16 - n : code + 1 << 16 - n] = [s << 5 | n] * (1 << 16 - n)
    return out


def decode_sequential(frame: bytes, head: Jpeg) -> np.ndarray:
    """Luminance (height, width) of a baseline or extended sequential frame of 8-bit samples."""
    by_id = {p[0]: p for p in head.parts}
    scan = [(by_id[i], _ladder(head.dc[d]), _ladder(head.ac[a])) for i, d, a in head.scan]
    if len(scan) != len(head.parts):
        raise ValueError("frames of several scans are not supported")
    most_h, most_v = max(p[1] for p in head.parts), max(p[2] for p in head.parts)
    if len(scan) == 1:  # one component is not interleaved: its units are blocks
        most_h = most_v = 1
        scan = [((scan[0][0][0], 1, 1, scan[0][0][3]), *scan[0][1:])]
    across, down = -(-head.width // (8 * most_h)), -(-head.height // (8 * most_v))
    (_, h, v, quantiser), order = scan[0][0], zigzag()
    blocks_ = np.zeros((down * v, across * h, 64), np.int64)
    stop = frame.rfind(EOI)
    raw = frame[head.used : stop if stop > head.used else len(frame)]
    runs, at = [], 0
    for k in range(len(raw) - 1):
        if raw[k] == 0xFF and 0xD0 <= raw[k + 1] <= 0xD7:
            runs.append(raw[at:k])
            at = k + 2
    runs.append(raw[at:])
    unit = 0
    for run in runs:
        data, bit, last = run.replace(b"\xff\0", b"\xff") + b"\xff" * 8, 0, [0] * len(scan)
        left = head.restart or across * down
        while left and unit < across * down:
            for n, (part, dc, ac) in enumerate(scan):
                for y in range(part[2]):
                    for x in range(part[1]):
                        out, k = [0] * 64, 0
                        while k < 64:
                            here = int.from_bytes(data[bit >> 3 : (bit >> 3) + 5], "big") << (bit & 7) & 0xFFFFFFFFFF
                            found = (ac if k else dc)[here >> 24]
                            symbol, used = found >> 5, found & 31
                            if not used or bit >> 3 > len(run):
                                raise ValueError("a damaged scan")
                            size = symbol & 15 if k else symbol
                            value = here >> (40 - used - size) & (1 << size) - 1
                            bit += used + size
                            value = value if size and value >> size - 1 else value - (1 << size) + 1
                            if k == 0:
                                last[n] += value
                                out[0], k = last[n], 1
                                continue
                            if symbol == 0:
                                break
                            k += symbol >> 4
                            if size and k < 64:
                                out[order[k]] = value
                            k += 1
                        if n == 0:
                            blocks_[unit // across * v + y, unit % across * h + x] = out
            unit, left = unit + 1, left - 1
    if unit < across * down:
        raise ValueError("a damaged scan")
    scale = np.empty(64, np.int64)
    scale[order] = head.quantisers[quantiser]
    x = COSINE.T @ (blocks_ * scale).reshape(*blocks_.shape[:2], 8, 8) @ COSINE
    plane = np.clip(np.rint(x + 128), 0, 255).astype(np.uint8).swapaxes(1, 2).reshape(blocks_.shape[0] * 8, -1)
    high, wide = -(-head.height * v // most_v), -(-head.width * h // most_h)
    return plane[:high, :wide]


def decode_scans(scans: list[bytes], width: int, height: int, huffman: tuple[bytes, bytes]) -> np.ndarray:
    """Samples (n, height, width); every frame advances by one symbol a step, so the steps are vectorised over frames."""
    symbol, length = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64)
    for s, (code, n) in codes(*huffman).items():
        symbol[code << 16 - n : code + 1 << 16 - n], length[code << 16 - n : code + 1 << 16 - n] = s, n
    sizes = np.fromiter(map(len, scans), np.int64, len(scans))
    raw = np.frombuffer(b"".join(scans) + b"\0" * 8, np.uint8)
    stuffed = np.flatnonzero((raw[1:] == 0) & (raw[:-1] == 255)) + 1
    stuffed = stuffed[stuffed < sizes.sum()]
    start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    start -= np.searchsorted(stuffed, start)
    raw = np.ascontiguousarray(np.delete(raw, stuffed))
    view = np.ndarray(len(raw) - 7, ">u8", raw, strides=(1,))
    at, out = start * 8, np.empty((width * height, len(scans)), np.int64)
    for k in range(width * height):
        here = view[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)
        top = (here >> np.uint64(48)).astype(np.int64)
        s, n = symbol[top], length[top]
        extra = (here >> np.uint64(24)).astype(np.int64) >> (40 - n - s)
        extra &= (1 << s) - 1
        out[k] = np.where(extra < (1 << s) >> 1, extra - (1 << s) + 1, extra)
        at += n + s
    if (at > 8 * np.append(start[1:], sizes.sum() - len(stuffed))).any():
        raise ValueError("a damaged scan")
    d = out.T.reshape(len(scans), height, width)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return np.cumsum(d, axis=2).astype(np.uint8)


def decode_media(files: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """(microseconds a frame, samples) of each file; the lossless frames of all files are decoded together."""
    found = []
    for media in files:
        try:
            found.append(parse_avi(media))
        except (IndexError, struct.error) as e:
            raise ValueError("a damaged AVI file") from e
    out: list[np.ndarray | None] = [None] * len(files)

    def put(n: int, k: int, x: np.ndarray) -> None:
        if out[n] is None:
            out[n] = np.empty((len(found[n][1]), *x.shape), np.uint8)
        if out[n].shape[1:] != x.shape:
            raise ValueError("frames of several sizes")
        out[n][k] = x

    held: dict[tuple, tuple[list, list]] = {}

    def flush(kind: tuple) -> None:
        scans, places = held.pop(kind)
        try:
            decoded = decode_scans(scans, *kind)
        except IndexError as e:
            raise ValueError("a damaged scan") from e
        for (n, k), x in zip(places, decoded, strict=True):
            put(n, k, x)

    head, used, kind = b"", 0, None
    for n, (media, (_, frames)) in enumerate(zip(files, found, strict=True)):
        for k, (a, b) in enumerate(frames):
            if kind is None or not media.startswith(head, a):
                try:
                    own = parse_jpeg(media[a:b])
                    if own.process in (0xC0, 0xC1):
                        put(n, k, decode_sequential(media[a:b], own))
                        continue
                except (IndexError, KeyError, struct.error) as e:
                    raise ValueError("a damaged JPEG frame") from e
                if own.process != 0xC3 or own.predictor != 1 or len(own.scan) != 1:
                    raise ValueError("of lossless frames those with one component and left-neighbour prediction are supported, of others the sequential ones")
                head, used, kind = media[a : a + own.used], own.used, (own.width, own.height, own.dc[own.scan[0][1]])
            scans, places = held.setdefault(kind, ([], []))
            scans.append(media[a + used : b - 2 if media[b - 2 : b] == EOI else b])
            places.append((n, k))
            if len(scans) == 2 * PIECE:
                flush(kind)
    for kind in list(held):
        flush(kind)
    return [(micros, np.zeros((0, HEIGHT, WIDTH), np.uint8) if x is None else x) for (micros, _), x in zip(found, out, strict=True)]


def shots(samples: np.ndarray, window: int = 12, spread: float = 3.0, least: float = 0.25, shortest: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(first frames of the shots, difference to the frame before of each frame).

    The difference is half the L1 distance of 16-bin histograms. A cut is a frame whose difference exceeds the mean plus
    `spread` deviations of the up to `window` differences before it, and `least`, `shortest` frames or more after the last cut.
    """
    n = len(samples)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    flat = samples.reshape(n, -1)
    hist = np.empty((n, 16), np.int64)
    for a in range(0, n, PIECE):
        part = flat[a : a + PIECE]
        hist[a : a + PIECE] = np.bincount(((np.arange(len(part)) * 16)[:, None] + (part >> 4)).ravel(), minlength=len(part) * 16).reshape(-1, 16)
    diff = np.zeros(n)
    diff[1:] = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * flat.shape[1])
    one, two = np.concatenate(([0], np.cumsum(diff))), np.concatenate(([0], np.cumsum(diff * diff)))
    here = np.arange(n)
    low = np.maximum(here - window, 1)
    count = np.maximum(here - low, 1)
    mean = (one[here] - one[np.minimum(low, here)]) / count
    dev = np.sqrt(np.maximum((two[here] - two[np.minimum(low, here)]) / count - mean * mean, 0))
    cuts, last = [0], 0
    for k in np.flatnonzero((diff > np.maximum(mean + spread * dev, least)) & (here >= shortest)).tolist():
        if k - last >= shortest:
            cuts.append(k)
            last = k
    return np.array(cuts, np.int64), diff


def store(text: bytes) -> tuple[bytes, np.ndarray]:
    payload = text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b" ")
    return payload, np.frombuffer(payload, np.uint8).reshape(-1, HEIGHT, WIDTH)


def store_all(texts: list[bytes]) -> list[bytes]:
    """An AVI file for each text; at most PIECE frames are coded at once."""
    frames = [store(t)[1] for t in texts]
    every = np.concatenate(frames) if len(frames) > 1 else frames[0] if frames else np.zeros((0, HEIGHT, WIDTH), np.uint8)
    scans, at, out = [], 0, []
    for a in range(0, len(every), PIECE):
        scans += encode_frames(every[a : a + PIECE])
    for f in frames:
        out.append(write_avi(scans[at : at + len(f)]))
        at += len(f)
    return out


def text_to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) with every text stored as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(map(len, texts), pa.int64()), "media": pa.array(store_all(texts), pa.binary())})

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def clips(micros: int, samples: np.ndarray) -> list[tuple[int, float, float, int, float]]:
    """(shot, start and end in ms, frames, largest difference within) of each shot."""
    cuts, diff = shots(samples)
    stops = [*cuts[1:].tolist(), len(samples)] if len(cuts) else []
    return [(k, a * micros / 1000, b * micros / 1000, b - a, float(diff[a + 1 : b].max(initial=0))) for k, (a, b) in enumerate(zip(cuts.tolist(), stops, strict=True))]


def media_clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each shot of each AVI file: (doc_id, shot, start_ms, end_ms, n_frames, peak, error). Null media and files without
    frames give no rows; a file that can't be read gives one, with nothing but its id and the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, files in blocks(batches):
            rows = []
            try:
                read = [(x, None) for x in decode_media(files)]
            except ValueError:
                read = [_tried(f) for f in files]
            for i, (x, error) in zip(ids, read, strict=True):
                rows += [(i, None, None, None, None, None, error)] if error else [(i, *c, None) for c in clips(*x)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, CLIP_TYPES, strict=True)], names=CLIP_NAMES)

    rows = media.select(media[id_col].cast("long").alias("doc_id"), media[media_col].cast("binary").alias("media")).where("media is not null")
    return rows.mapInArrow(run, "doc_id long, shot long, start_ms double, end_ms double, n_frames long, peak double, error string")


def _tried(file: bytes) -> tuple[tuple[int, np.ndarray] | None, str | None]:
    try:
        return decode_media([file])[0], None
    except ValueError as e:
        return None, str(e)


CLIP_NAMES = ["doc_id", "shot", "start_ms", "end_ms", "n_frames", "peak", "error"]
CLIP_TYPES = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.string()]


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text, reads the stored bytes back and returns one row of digests and shot features for each; `clips` has the
    shots' times in ms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            files = store_all(texts)
            rows = []
            for i, t, media, (micros, x) in zip(ids, texts, files, decode_media(files), strict=True):
                back = x.tobytes()
                cuts, diff = shots(x)
                stop = [*cuts[1:].tolist(), len(x)]
                long = int(np.diff(np.append(cuts, len(x))).max())
                feature = f"frames={len(x)};shots={len(cuts)};longest={long};peak={round(float(diff.max()) * 192)};last_cut={int(cuts[-1])}"
                timed = ",".join(f"{a * micros // 1000}-{b * micros // 1000}" for a, b in zip(cuts.tolist(), stop, strict=True))
                rows.append((i, len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, timed))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, DIGEST_TYPES, strict=True)], names=DIGEST_NAMES)

    return id_text(docs, id_col, text_col).mapInArrow(run, DIGEST_SCHEMA)


DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips string"
DIGEST_NAMES = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
DIGEST_TYPES = [pa.string() if x.endswith("string") else pa.int64() for x in DIGEST_SCHEMA.split(", ")]
