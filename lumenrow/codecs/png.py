"""PNG: chunks, filters, interlacing, palettes and transparency."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from .inflate import inflate_zlib
from .model import DecodeError, Image, check_size, rgba

NAME = "PNG"
SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Colour type -> name, channels, legal depths.
COLOR_TYPES = {0: ("Gray", 1, (1, 2, 4, 8, 16)), 2: ("RGB", 3, (8, 16)), 3: ("Indexed", 1, (1, 2, 4, 8)), 4: ("GrayAlpha", 2, (8, 16)), 6: ("RGBA", 4, (8, 16))}
# X and y offset, x and y step of each Adam7 pass.
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
SINGLE = ((0, 0, 1, 1),)
FILTERS = ("None", "Sub", "Up", "Average", "Paeth")
TEXT_CHARS = 120
#: Rows whose filters are undone together.
BAND = 512


@dataclass
class Chunk:
    seq: int
    type: str
    offset: int
    length: int
    data: bytes
    crc_ok: bool


@dataclass
class Header:
    width: int
    height: int
    depth: int
    color: int
    interlaced: bool

    @property
    def channels(self) -> int:
        return COLOR_TYPES[self.color][1]

    @property
    def bits(self) -> int:
        return self.channels * self.depth

    def passes(self) -> list[tuple[tuple[int, int, int, int], int, int]]:
        """Each pass that isn't empty with its width and height."""
        out = []
        for p in ADAM7 if self.interlaced else SINGLE:
            w, h = max(0, -(-(self.width - p[0]) // p[2])), max(0, -(-(self.height - p[1]) // p[3]))
            if w and h:
                out.append((p, w, h))
        return out

    def raw_size(self) -> int:
        return sum(h * (1 + (w * self.bits + 7) // 8) for _, w, h in self.passes())


@dataclass
class File:
    header: Header
    idat: bytes = b""
    n_idat: int = 0
    n_chunks: int = 0
    palette: np.ndarray | None = None
    key: tuple[int, ...] | None = None
    extra: dict[str, str] = field(default_factory=dict)


def matches(data: bytes) -> bool:
    return data[:8] == SIGNATURE


def chunks(data: bytes) -> Iterator[Chunk]:
    """The chunks in order; a cut or misnamed one is an error, a wrong checksum only marked."""
    at, seq = 8, 0
    while at < len(data):
        if at + 12 > len(data):
            raise DecodeError("a chunk is cut off", NAME, at)
        n = int.from_bytes(data[at : at + 4], "big")
        kind = data[at + 4 : at + 8]
        if n > 0x7FFFFFFF or at + 12 + n > len(data):
            raise DecodeError(f"a chunk of {n} bytes", NAME, at)
        if not kind.isalpha():
            raise DecodeError("a chunk type that isn't four letters", NAME, at + 4)
        stored = int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        yield Chunk(seq, kind.decode("ascii"), at, n, data[at + 8 : at + 8 + n], zlib.crc32(data[at + 4 : at + 8 + n]) == stored)
        at, seq = at + 12 + n, seq + 1


def header(data: bytes) -> Header:
    if len(data) != 13:
        raise DecodeError(f"IHDR of {len(data)} bytes", NAME, 16)
    w, h, depth, color, method, filter_, interlace = struct.unpack(">IIBBBBB", data)
    if color not in COLOR_TYPES or depth not in COLOR_TYPES[color][2]:
        raise DecodeError(f"colour type {color} with {depth} bits", NAME, 24)
    if method or filter_ or interlace > 1:
        raise DecodeError("compression, filter or interlace method", NAME, 26)
    check_size(w, h, NAME)
    return Header(w, h, depth, color, bool(interlace))


def _palette(c: Chunk, f: File) -> None:
    if f.n_idat or f.palette is not None or f.header.color in (0, 4) or c.length % 3 or not 3 <= c.length <= 768:
        raise DecodeError("PLTE is misplaced or malformed", NAME, c.offset)
    f.palette = np.concatenate([np.frombuffer(c.data, np.uint8).reshape(-1, 3), np.full((c.length // 3, 1), 255, np.uint8)], axis=1)


def _transparency(c: Chunk, f: File) -> None:
    color = f.header.color
    if f.n_idat or color in (4, 6):
        raise DecodeError("tRNS is misplaced", NAME, c.offset)
    if color == 3:
        if f.palette is None or c.length > len(f.palette):
            raise DecodeError("tRNS doesn't match the palette", NAME, c.offset)
        f.palette[: c.length, 3] = np.frombuffer(c.data, np.uint8)
    else:
        if c.length != 2 * f.header.channels:
            raise DecodeError(f"tRNS of {c.length} bytes", NAME, c.offset)
        f.key = struct.unpack(f">{f.header.channels}H", c.data)


def read(data: bytes) -> File:
    f, ended, last = None, False, ""
    for c in chunks(data):
        if not c.crc_ok:
            raise DecodeError(f"checksum of {c.type} differs", NAME, c.offset)
        if (f is None) != (c.type == "IHDR"):
            raise DecodeError("IHDR isn't first or not alone", NAME, c.offset)
        if f is None:
            f = File(header(c.data))
        elif c.type == "IDAT":
            if f.n_idat and last != "IDAT":
                raise DecodeError("IDAT chunks aren't together", NAME, c.offset)
            if f.header.color == 3 and f.palette is None:
                raise DecodeError("no palette before IDAT", NAME, c.offset)
            f.idat, f.n_idat = f.idat + c.data, f.n_idat + 1
        elif c.type == "PLTE":
            _palette(c, f)
        elif c.type == "tRNS":
            _transparency(c, f)
        elif c.type == "IEND":
            ended = True
        elif c.type == "gAMA" and c.length == 4:
            f.extra["gamma"] = f"{int.from_bytes(c.data, 'big') / 100000:.5f}"
        elif c.type == "pHYs" and c.length == 9:
            x, _, unit = struct.unpack(">IIB", c.data)
            if unit == 1:
                f.extra["dpi"] = str(int(x / 39.3701 + 0.5))
        elif c.type == "tEXt" and b"\0" in c.data:
            key, _, value = c.data.decode("latin-1").partition("\0")
            f.extra[key] = value if len(value) <= TEXT_CHARS else value[:TEXT_CHARS] + "…"
        elif c.type[0].isupper() and c.type not in ("IHDR",):
            raise DecodeError(f"unknown critical chunk {c.type}", NAME, c.offset, "unsupported")
        if f is not None:
            f.n_chunks += 1
        last = c.type
        if ended:
            break
    if f is None or not ended or not f.n_idat:
        raise DecodeError("IHDR, IDAT or IEND is missing", NAME, len(data))
    return f


def unfilter(rows: np.ndarray, kinds: np.ndarray, lanes: int) -> np.ndarray:
    """Undo the filters of a pass. ``rows`` is height x bytes, ``lanes`` the bytes of a pixel, 1 at least.

    Sub and Up are running sums. With Average or Paeth a byte needs its left,
    upper and upper left neighbours, so pixels are done along the diagonals on
    which these are all known.
    """
    h, n_bytes = rows.shape
    if (kinds > 4).any():
        raise DecodeError(f"filter {kinds.max()} in row {int((kinds > 4).argmax())}", NAME)
    w = n_bytes // lanes
    raw = rows.reshape(h, w, lanes)
    if not (kinds >= 3).any():
        out = np.zeros((h + 1, w, lanes), np.uint8)
        for y in range(h):
            line = raw[y]
            if kinds[y] == 1:
                line = np.cumsum(line, axis=0, dtype=np.uint64).astype(np.uint8)
            elif kinds[y] == 2:
                line = line + out[y]
            out[y + 1] = line
        return out[1:].reshape(h, n_bytes)
    out, prior = np.empty((h, w, lanes), np.uint8), np.zeros((w, lanes), np.int16)
    for top in range(0, h, BAND):
        band = raw[top : top + BAND]
        n = len(band)
        # skewed, so that a diagonal is one row: pixel (x, y) stands in row x + y, behind two rows and a column for its neighbours
        given, done = np.zeros((w + n - 1, n, lanes), np.int16), np.zeros((w + n + 1, n + 1, lanes), np.int16)
        for y in range(n):
            given[y : y + w, y] = band[y]
        done[1 : w + 1, 0] = prior
        sub, up, mean, paeth = ((kinds[top : top + n] == k).astype(np.int16)[:, None] for k in (1, 2, 3, 4))
        for d in range(w + n - 1):
            i, j = max(0, d - w + 1), min(n, d + 1)
            a, b, c = done[d + 1, i + 1 : j + 1], done[d + 1, i:j], done[d, i:j]
            p, q = b - c, a - c
            pa, pb, pc = np.abs(p), np.abs(q), np.abs(p + q)
            nearest = np.where(pa <= np.minimum(pb, pc), a, np.where(pb <= pc, b, c))
            guess = sub[i:j] * a + up[i:j] * b + mean[i:j] * ((a + b) >> 1) + paeth[i:j] * nearest
            done[d + 2, i + 1 : j + 1] = (given[d, i:j] + guess) & 255
        for y in range(n):
            out[top + y] = done[y + 2 : y + 2 + w, y + 1]
        prior = out[top + n - 1].astype(np.int16)
    return out.reshape(h, n_bytes)


def samples(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """height x width x channels of raw samples."""
    if depth == 8:
        v = rows
    elif depth == 16:
        v = rows[:, ::2].astype(np.uint16) << 8 | rows[:, 1::2]
    else:
        shifts = np.arange(8 // depth - 1, -1, -1, dtype=np.uint8) * depth
        v = ((rows[:, :, None] >> shifts) & ((1 << depth) - 1)).reshape(len(rows), -1)
    return v[:, : width * channels].reshape(len(rows), width, channels)


def scale(v: np.ndarray, depth: int) -> np.ndarray:
    """Samples to 0..255."""
    return (v.astype(np.int64) * 255 + 32767) // 65535 if depth == 16 else v.astype(np.int64) * (255 // ((1 << depth) - 1))


def expand(v: np.ndarray, f: File) -> np.ndarray:
    """Raw samples to RGBA; a colour key is compared before scaling."""
    h = f.header
    if h.color == 3:
        if v.max(initial=0) >= len(f.palette):
            raise DecodeError(f"palette index {v.max()} of {len(f.palette)}", NAME)
        return f.palette[v[:, :, 0]]
    s = scale(v, h.depth)
    if h.color in (4, 6):
        return rgba(s[:, :, 0], s[:, :, -2 if h.color == 4 else 1], s[:, :, -2], s[:, :, -1])
    alpha = 255 if f.key is None else np.where((v == np.array(f.key)).all(axis=2), 0, 255)
    return rgba(s[:, :, 0], s[:, :, 0 if h.color == 0 else 1], s[:, :, -1], alpha)


def decode(data: bytes, counted: bool = False) -> Image:
    """``counted`` adds what blocks the data's stream was made of."""
    f = read(data)
    h, size = f.header, f.header.raw_size()
    inflated = inflate_zlib(f.idat, limit=size, format=NAME, counted=counted)
    if len(inflated.data) != size:
        raise DecodeError(f"{size} bytes of rows wanted, {len(inflated.data)} there", NAME)
    raw, at = np.frombuffer(inflated.data, np.uint8), 0
    out, counts = np.zeros((h.height, h.width, 4), np.uint8), np.zeros(5, int)
    for (x0, y0, dx, dy), w, rows_n in h.passes():
        n = (w * h.bits + 7) // 8
        rows = raw[at : at + rows_n * (n + 1)].reshape(rows_n, n + 1)
        at += rows.size
        plain = unfilter(rows[:, 1:], rows[:, 0], max(1, h.bits // 8))
        counts += np.bincount(rows[:, 0], minlength=5)[:5]
        out[y0::dy, x0::dx] = expand(samples(plain, w, h.channels, h.depth), f)
    extra = {
        "interlace": "Adam7" if h.interlaced else "none", "filters": " ".join(f"{k} x {n}" for k, n in zip(FILTERS, counts.tolist(), strict=True) if n), **({"deflate blocks": inflated.blocks} if counted else {}),
        "IDAT": f"{f.n_idat} of {len(f.idat)} bytes", "ratio": f"{size / len(f.idat):.2f}:1" if f.idat else "—", "chunks": str(f.n_chunks), **({"palette": str(len(f.palette))} if f.palette is not None else {}), **f.extra,
    }
    return Image(out, NAME, COLOR_TYPES[h.color][0], h.depth, h.channels, COLOR_TYPES[h.color][0], "Deflate", extra=extra)
