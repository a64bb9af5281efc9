"""JPEG: baseline, extended sequential and progressive, 8 bits, Huffman coded."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np

from .model import DecodeError, Image, MsbBits, canonical_codes, check_size, kraft, rgba, unsupported

NAME = "JPEG"
COMMENT_CHARS = 200
# EXIF orientation -> (swap axes, flip x, flip y).
ORIENTATIONS = {1: (0, 0, 0), 2: (0, 1, 0), 3: (0, 1, 1), 4: (0, 0, 1), 5: (1, 0, 0), 6: (1, 1, 0), 7: (1, 1, 1), 8: (1, 0, 1)}
# The integer inverse transform's constants, 12-bit fixed point.
FIXED_BITS, PASS_BITS = 12, 2
F0541, F1848, F0765 = 2217, 7568, 3135
F1176, F0299, F2053, F3073, F1501 = 4816, 1223, 8410, 12586, 6149
F0900, F2563, F1962, F0390 = 3686, 10498, 8035, 1598
# Colour factors, 16-bit fixed point.
CR_R, CB_B, CR_G, CB_G = 91881, 116130, -46802, -22554


def zigzag() -> np.ndarray:
    """Natural position of each coefficient in stored order: along the diagonals, turning at the edges."""
    cells = sorted(((r + c, r if (r + c) % 2 else c, r * 8 + c) for r in range(8) for c in range(8)))
    return np.array([x[2] for x in cells])


ZIGZAG = zigzag()


def transform_matrix() -> np.ndarray:
    """One pass of the integer transform as an 8 x 8 matrix: output row, input column.

    Between roundings the transform only adds and multiplies by constants, so a
    pass is linear; the outputs mirror each other about the middle.
    """
    odd = {  # output 0..3 -> weights of inputs 1, 3, 5, 7
        0: (F1501 + F1176 - F0900 - F0390, F1176, F1176 - F0390, F1176 - F0900),
        1: (F1176, F3073 + F1176 - F2563 - F1962, F1176 - F2563, F1176 - F1962),
        2: (F1176 - F0390, F1176 - F2563, F2053 + F1176 - F2563 - F0390, F1176),
        3: (F1176 - F0900, F1176 - F1962, F1176, F0299 + F1176 - F0900 - F1962),
    }
    one = 1 << FIXED_BITS
    even = {0: (one, F0541 + F0765, one, F0541), 1: (one, F0541, -one, F0541 - F1848), 2: (one, -F0541, -one, F1848 - F0541), 3: (one, -F0541 - F0765, one, -F0541)}
    m = np.zeros((8, 8), np.int64)
    for i in range(4):
        m[i, ::2], m[i, 1::2] = even[i], odd[i]
        m[7 - i, ::2], m[7 - i, 1::2] = even[i], [-x for x in odd[i]]
    return m


TRANSFORM = transform_matrix()


def idct(blocks: np.ndarray) -> np.ndarray:
    """n x 8 x 8 coefficients to samples 0..255, exact in integers: columns, then rows with the level shift."""
    first, second = FIXED_BITS - PASS_BITS, FIXED_BITS + PASS_BITS + 3
    bounded = lambda x: np.clip(x, -32767, 32767)
    # products and their sums are whole numbers far below 2 ** 53, so matrix products of doubles are exact
    weights = TRANSFORM.astype(float)
    turned = lambda x: np.tensordot(bounded(x).astype(float), weights, axes=([1], [1])).astype(np.int64)
    work = (turned(np.asarray(blocks).astype(np.int64)) + (1 << (first - 1))) >> first
    out = (turned(work) + (1 << (second - 1)) + (128 << second)) >> second
    return np.clip(out, 0, 255).astype(np.uint8)


def idct_reference(blocks: np.ndarray) -> np.ndarray:
    """The transform by its definition in doubles; within 1 of idct."""
    k, x = np.meshgrid(np.arange(8), np.arange(8))
    basis = np.cos((2 * x + 1) * k * math.pi / 16) * np.where(k == 0, math.sqrt(0.5), 1.0)
    v = np.einsum("xu,nuv,yv->nxy", basis, blocks.astype(float), basis) / 4
    return np.clip(np.floor(np.abs(v) + 0.5) * np.sign(v) + 128, 0, 255).astype(np.uint8)


@dataclass
class Segment:
    seq: int
    marker: int
    offset: int
    data_offset: int
    length: int


@dataclass
class Component:
    id: int
    h: int
    v: int
    table: int
    blocks_w: int = 0
    blocks_h: int = 0
    padded_w: int = 0
    padded_h: int = 0
    sample_w: int = 0
    sample_h: int = 0
    first: int = 0
    coefs: np.ndarray | None = None


@dataclass
class Frame:
    marker: int
    width: int
    height: int
    components: list[Component]
    coefs: np.ndarray | None = None
    #: with other frames' coefficients behind those of this one, which begin at ``at``
    shared: np.ndarray | None = None
    at: int = 0

    def open(self) -> None:
        """Room for the coefficients of all components, one after another; each has a view of its own."""
        sizes = [c.padded_w * c.padded_h for c in self.components]
        self.coefs, at = np.zeros((sum(sizes), 64), np.int16), 0
        for c, n in zip(self.components, sizes, strict=True):
            c.first, c.coefs, at = at, self.coefs[at : at + n], at + n

    @property
    def progressive(self) -> bool:
        return self.marker == 0xC2

    @property
    def max_h(self) -> int:
        return max(c.h for c in self.components)

    @property
    def max_v(self) -> int:
        return max(c.v for c in self.components)

    @property
    def mcus(self) -> tuple[int, int]:
        return -(-self.width // (8 * self.max_h)), -(-self.height // (8 * self.max_v))

    @property
    def sampling(self) -> str:
        factors = [(c.h, c.v) for c in self.components]
        if len(factors) != 3 or factors[1] != factors[2]:
            return " ".join(f"{h}x{v}" for h, v in factors)
        (h, v), (ch, cv) = factors[:2]
        known = {(1, 1): "4:4:4", (2, 1): "4:2:2", (2, 2): "4:2:0", (4, 1): "4:1:1"}
        ratio = (h // ch, v // cv) if h % ch == 0 and v % cv == 0 else None
        return known.get(ratio, " ".join(f"{h}x{v}" for h, v in factors))


#: Index of what is read behind the last bit, beside those of 16 bits.
BEHIND = 1 << 16
#: Steps of a block's place at one symbol: those from ENDS on end the block, the lower bits being a run's; FAULT is no code.
ENDS, FAULT = 128, 255
#: No value of 15 bits.
LONG = -32768


class Code:
    """A Huffman table read from the highest bit: 16 bits ahead index symbol and length. Codes may be missing, but not too many."""

    def __init__(self, counts: bytes, symbols: bytes, at: int):
        lengths = [n for n, c in enumerate(counts, 1) for _ in range(c)]
        if not lengths or kraft(lengths, 16) > 1 << 16:
            raise DecodeError("a Huffman table is empty or has too many codes", NAME, at)
        self.table = np.zeros(BEHIND + 1, np.int32)
        for i, code, n in canonical_codes(lengths):
            self.table[code << (16 - n) : (code + 1) << (16 - n)] = symbols[i] << 5 | n
        self.table[BEHIND] = self.table[0]

    def read(self, bits: MsbBits) -> int:
        entry = int(self.table[bits.peek(16)])
        if not entry & 31:
            if bits.used_up:
                return 0
            raise DecodeError("no such Huffman code", NAME)
        bits.skip(entry & 31)
        return entry >> 5

    def _by_window(self, value: np.ndarray, behind: int) -> bytes:
        """FAULT without a code; behind the end ``behind``, or the value if it is FAULT or zeros are a code and ``behind`` is none."""
        out = np.where(self.table & 31, value, FAULT).astype(np.uint8)
        if not self.table[0] & 31:
            out[BEHIND] = max(behind, 0)
        elif behind >= 0 and out[0] != FAULT:
            out[BEHIND] = behind
        return out.tobytes()

    # What a symbol means, by the 16 bits ahead: bits taken with those that follow it, or the step of the place.

    @cached_property
    def dc_bits(self) -> bytes:
        size = self.table >> 5
        return self._by_window(np.where(size > 15, FAULT, (self.table & 31) + size), 0)

    @cached_property
    def ac_bits(self) -> bytes:
        return self._by_window((self.table & 31) + (self.table >> 5 & 15), 0)

    @cached_property
    def band_bits(self) -> bytes:
        """As ac_bits; ends of bands carry the bits of their run."""
        run, size = self.table >> 9, self.table >> 5 & 15
        return self._by_window((self.table & 31) + np.where(size, size, np.where(run < 15, run, 0)), 0)

    @cached_property
    def refined_bits(self) -> bytes:
        """As band_bits; all values are one bit."""
        run, size = self.table >> 9, self.table >> 5 & 15
        return self._by_window((self.table & 31) + np.where(size, 1, np.where(run < 15, run, 0)), 0)

    @cached_property
    def steps(self) -> bytes:
        run, size = self.table >> 9, self.table >> 5 & 15
        out = self._by_window(np.where(size, run + 1, np.where(run == 15, 16, ENDS + run)), -1)
        return out if self.table[0] & 31 else out[:BEHIND] + bytes([ENDS])

    @cached_property
    def symbols(self) -> bytes:
        return self._by_window(self.table >> 5, -1)

    @cached_property
    def end(self) -> tuple[int, int]:
        """Bits of a band's end in one block, and their number; 0 if there is none."""
        at = np.flatnonzero((self.table[:BEHIND] >> 5 == 0) & (self.table[:BEHIND] & 31 > 0))
        n = int(self.table[at[0]]) & 31 if len(at) else 0
        return (int(at[0]) >> (16 - n), n) if n else (0, 0)

    # The same for scans that are walked together.

    @cached_property
    def chain_bits(self) -> np.ndarray:
        """Bits taken with those that follow, for symbols whose low half is their size; without a code one bit."""
        return np.where(self.table & 31, (self.table & 31) + (self.table >> 5 & 15), 1).astype(np.uint8)

    @cached_property
    def chain_values(self) -> np.ndarray:
        """The value that follows, 0 without one; LONG where it isn't all in the 16 bits."""
        window, n, size = np.arange(BEHIND + 1), self.table & 31, self.table >> 5 & 15
        value = window >> np.maximum(16 - n - size, 0) & ((1 << size) - 1)
        value = np.where(value >> np.maximum(size - 1, 0), value, value - (1 << size) + 1) * (size > 0)
        return np.where(n + size > 16, LONG, value).astype(np.int16)

    def chain_steps(self, single: bool, mixed: bool) -> np.ndarray:
        """As ``steps``, 64 for an end; FAULT also for runs over blocks, which only a band may have, and for symbols that are no ``single`` size."""
        run, size = self.table >> 9, self.table >> 5 & 15
        if single:
            out = np.where(run > 0, FAULT, 1)
        else:
            out = np.where(size, run + 1, np.where(run == 15, 16, np.where(mixed | (run == 0), 64, FAULT)))
        return np.where(self.table & 31, out, FAULT).astype(np.uint8)


@lru_cache(maxsize=16)
def _known_code(counts: bytes, symbols: bytes) -> Code:
    """Files mostly bring the same tables."""
    return Code(counts, symbols, 0)


def code(counts: bytes, symbols: bytes, at: int) -> Code:
    try:
        return _known_code(bytes(counts), bytes(symbols))
    except DecodeError as e:
        raise DecodeError(e.message, NAME, at) from None


def matches(data: bytes) -> bool:
    return data[:3] == b"\xff\xd8\xff"


def is_sof(marker: int) -> bool:
    return 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)


def next_segment(data: bytes, at: int, seq: int) -> Segment | None:
    """The segment from ``at`` on; bytes before a marker and fill bytes are passed over."""
    at = data.find(b"\xff", at)
    while 0 <= at < len(data) - 1 and data[at + 1] == 0xFF:
        at += 1
    if at < 0 or at + 1 >= len(data):
        return None
    marker = data[at + 1]
    if marker == 0:
        raise DecodeError("a stuffed byte between segments", NAME, at)
    if marker in (0x01, 0xD8, 0xD9) or 0xD0 <= marker <= 0xD7:
        return Segment(seq, marker, at, at + 2, 0)
    n = int.from_bytes(data[at + 2 : at + 4], "big")
    if at + 4 > len(data) or n < 2 or at + 2 + n > len(data):
        raise DecodeError(f"a segment of {n} bytes", NAME, at)
    return Segment(seq, marker, at, at + 4, n - 2)


#: A marker that ends entropy-coded data, and those that cut it into parts.
_ENDING, _RESTART = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]"), re.compile(rb"\xff[\xd0-\xd7]")


def entropy_end(data: bytes, at: int) -> int:
    """Where the entropy-coded data from ``at`` on ends: at a marker other than RST."""
    found = _ENDING.search(data, at)
    return found.start() if found else len(data)


def segments(data: bytes) -> Iterator[Segment]:
    """All segments; entropy-coded data between them is passed over."""
    at, seq = 0, 0
    while segment := next_segment(data, at, seq):
        yield segment
        at, seq = segment.data_offset + segment.length, seq + 1
        if segment.marker == 0xD9:
            return
        if segment.marker == 0xDA:
            at = entropy_end(data, at)


def parse_dqt(body: bytes, at: int) -> dict[int, np.ndarray]:
    out, i = {}, 0
    while i < len(body):
        wide, number = body[i] >> 4, body[i] & 15
        size = 64 * (1 + wide)
        if wide > 1 or number > 3 or i + 1 + size > len(body):
            raise DecodeError("malformed quantisation table", NAME, at + i)
        out[number] = np.frombuffer(body, ">u2" if wide else "u1", 64, i + 1).astype(np.int64)
        if not out[number].all():
            raise DecodeError("a quantisation step of 0", NAME, at + i)
        i += 1 + size
    return out


def parse_dht(body: bytes, at: int) -> dict[tuple[int, int], Code]:
    out, i = {}, 0
    while i < len(body):
        kind, number, counts = body[i] >> 4, body[i] & 15, body[i + 1 : i + 17]
        n = sum(counts)
        if kind > 1 or number > 3 or len(counts) < 16 or i + 17 + n > len(body):
            raise DecodeError("malformed Huffman table", NAME, at + i)
        out[kind, number] = code(counts, body[i + 17 : i + 17 + n], at + i)
        i += 17 + n
    return out


def marker_name(marker: int) -> str:
    """A marker's name: those of a family carry their number."""
    single = {0xC4: "DHT", 0xC8: "JPG", 0xCC: "DAC", 0xD8: "SOI", 0xD9: "EOI", 0xDA: "SOS", 0xDB: "DQT", 0xDC: "DNL", 0xDD: "DRI", 0xFE: "COM", 0x01: "TEM"}
    families = ((0xC0, 0xCF, "SOF"), (0xD0, 0xD7, "RST"), (0xE0, 0xEF, "APP"))
    return single.get(marker) or next((f"{name}{marker - low}" for low, high, name in families if low <= marker <= high), f"0xFF{marker:02X}")


def parse_sof(marker: int, body: bytes, at: int) -> Frame:
    if marker not in (0xC0, 0xC1, 0xC2):
        raise unsupported(f"frame type {marker:#04x}", NAME, at)
    if len(body) < 6 or len(body) < 6 + 3 * body[5]:
        raise DecodeError("frame header is cut off", NAME, at)
    if body[0] != 8:
        raise unsupported(f"{body[0]} bits per sample", NAME, at)
    height, width, n = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5]
    if not height:
        raise unsupported("a height that follows the first scan", NAME, at)
    check_size(width, height, NAME)
    if not 1 <= n <= 4:
        raise DecodeError(f"{n} components", NAME, at)
    parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
    if any(not 1 <= c.h <= 4 or not 1 <= c.v <= 4 or c.table > 3 for c in parts) or len({c.id for c in parts}) < n:
        raise DecodeError("malformed components", NAME, at)
    frame = Frame(marker, width, height, parts)
    mw, mh = frame.mcus
    for c in parts:
        c.sample_w, c.sample_h = -(-width * c.h // frame.max_h), -(-height * c.v // frame.max_v)
        c.blocks_w, c.blocks_h = -(-c.sample_w // 8), -(-c.sample_h // 8)
        c.padded_w, c.padded_h = mw * c.h, mh * c.v
    return frame


def exif_orientation(body: bytes) -> int | None:
    """The orientation in an APP1 segment, or None for anything malformed."""
    if body[:6] != b"Exif\0\0":
        return None
    tiff = body[6:]
    order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
    if order is None:
        return None
    u = lambda at, n: int.from_bytes(tiff[at : at + n], order)
    ifd = u(4, 4)
    if u(2, 2) != 42 or ifd + 2 > len(tiff):
        return None
    for i in range(u(ifd, 2)):
        at = ifd + 2 + 12 * i
        if at + 12 > len(tiff):
            return None
        if u(at, 2) == 0x0112 and u(at + 4, 4) >= 1:
            value = {1: lambda: tiff[at + 8], 3: lambda: u(at + 8, 2), 4: lambda: u(at + 8, 4)}.get(u(at + 2, 2), lambda: 0)()  # noqa: B023
            return value if value in ORIENTATIONS else None
    return None


def oriented(pixels: np.ndarray, orientation: int) -> np.ndarray:
    swap, flip_x, flip_y = ORIENTATIONS[orientation]
    out = pixels.swapaxes(0, 1) if swap else pixels
    out = out[:, ::-1] if flip_x else out
    return np.ascontiguousarray(out[::-1] if flip_y else out)


def color_space(ids: list[int], jfif: bool, adobe: int | None) -> str:
    if len(ids) == 1:
        return "Gray"
    if len(ids) == 3:
        if jfif:
            return "YCbCr"
        if adobe is not None:
            return "RGB" if adobe == 0 else "YCbCr"
        return "RGB" if ids == [82, 71, 66] else "YCbCr"
    if len(ids) == 4:
        return "CMYK" if adobe in (None, 0) else "YCCK"
    raise unsupported(f"{len(ids)} components", NAME)


def ycc_to_rgb(y, cb, cr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed point with rounding; green's two parts are rounded together."""
    y, cb, cr = y.astype(np.int64), cb.astype(np.int64) - 128, cr.astype(np.int64) - 128
    half = 1 << 15
    clip = lambda x: np.clip(x, 0, 255)
    return clip(y + (CR_R * cr + half >> 16)), clip(y + (CB_G * cb + CR_G * cr + half >> 16)), clip(y + (CB_B * cb + half >> 16))


def to_rgba(planes: list[np.ndarray], space: str, adobe: bool) -> np.ndarray:
    p = [x.astype(np.int64) for x in planes]
    if space == "Gray":
        return rgba(p[0], p[0], p[0])
    if space == "RGB":
        return rgba(*p)
    if space == "YCbCr":
        return rgba(*ycc_to_rgb(*p))
    if space == "YCCK":
        c, m, y = (255 - x for x in ycc_to_rgb(*p[:3]))
        k = p[3]
    else:
        c, m, y, k = p if adobe else [255 - x for x in p]
    return rgba(c * k // 255, m * k // 255, y * k // 255)


def upsample(plane: np.ndarray, c: Component, f: Frame) -> np.ndarray:
    """A component's plane at full size: as it is, triangle-filtered for 2:1, else the nearest sample."""
    plane = plane[: c.sample_h, : c.sample_w]
    h, w = f.height, f.width
    if (c.h, c.v) == (f.max_h, f.max_v):
        return plane[:h, :w]
    if f.max_h == 2 * c.h and f.max_v in (c.v, 2 * c.v):
        wide = plane.astype(np.int64)
        tall = f.max_v == 2 * c.v
        if tall:
            y = np.arange(h)
            far = np.clip((y >> 1) + np.where(y & 1, 1, -1), 0, c.sample_h - 1)
            wide = 3 * wide[y >> 1] + wide[far]
        x = np.arange(w)
        far = np.clip((x >> 1) + np.where(x & 1, 1, -1), 0, c.sample_w - 1)
        even, odd = (8, 7) if tall else (1, 2)
        return ((3 * wide[:, x >> 1] + wide[:, far] + np.where(x & 1, odd, even)) >> (4 if tall else 2))[:h]
    y = np.minimum(np.arange(h) * c.v // f.max_v, c.sample_h - 1)
    x = np.minimum(np.arange(w) * c.h // f.max_h, c.sample_w - 1)
    return plane[np.ix_(y, x)]


@dataclass
class Scan:
    parts: list[tuple[Component, int, int]]
    start: int
    end: int
    high: int
    low: int


def parse_sos(body: bytes, f: Frame, at: int) -> Scan:
    n = body[0] if body else 0
    if not 1 <= n <= 4 or len(body) < 4 + 2 * n:
        raise DecodeError("malformed scan header", NAME, at)
    by_id, parts = {c.id: c for c in f.components}, []
    for i in range(n):
        c, tables = by_id.get(body[1 + 2 * i]), body[2 + 2 * i]
        if c is None or tables >> 4 > 3 or tables & 15 > 3 or any(c is p[0] for p in parts):
            raise DecodeError("a scan's component", NAME, at)
        parts.append((c, tables >> 4, tables & 15))
    start, end, approx = body[1 + 2 * n : 4 + 2 * n]
    high, low = approx >> 4, approx & 15
    if f.progressive:
        if start > end or end > 63 or (start == 0 and end > 0) or (start and n > 1) or low > 13 or (high and high != low + 1):
            raise DecodeError("a scan's spectral selection", NAME, at)
    elif (start, end, high, low) != (0, 63, 0, 0):
        raise DecodeError("a sequential scan's spectral selection", NAME, at)
    return Scan(parts, start, end, high, low)


def restart_parts(data: bytes, at: int, end: int) -> list[bytes]:
    """Entropy-coded data, cut at its restart markers; stuffed zeros are still in it."""
    parts, first = [], at
    for mark in _RESTART.finditer(data, at, end):
        parts.append(data[first : mark.start()])
        first = mark.end()
    return [*parts, data[first:end]]


def unstuffed(part: bytes) -> bytes:
    while b"\xff\xff" in part:
        part = part.replace(b"\xff\xff", b"\xff")
    return part.replace(b"\xff\x00", b"\xff")


class ScanReader:
    """One scan, block by block and bit by bit: the definition that ScanWalk is held against."""

    def __init__(self, data: bytes, at: int, frame: Frame, scan: Scan, codes: dict, interval: int):
        self.frame, self.scan, self.codes, self.interval = frame, scan, codes, interval
        self.end = entropy_end(data, at)
        self.parts = restart_parts(data, at, self.end)
        self.next = 0
        self.open()

    def open(self) -> None:
        self.bits, self.predicted, self.run = MsbBits(unstuffed(self.parts[self.next])), [0] * len(self.scan.parts), 0
        self.next += 1

    def restart(self) -> None:
        """Behind each interval: on to the next part if this one is used up; a missing marker is let pass."""
        self.bits.align()
        if self.next < len(self.parts) and self.bits.used_up:
            self.open()
        self.predicted, self.run = [0] * len(self.scan.parts), 0

    def code(self, kind: int, number: int) -> Code:
        if (kind, number) not in self.codes:
            raise DecodeError(f"Huffman table {kind}/{number} isn't there", NAME)
        return self.codes[kind, number]

    def read(self) -> None:
        scan, f = self.scan, self.frame
        if not f.progressive:
            block = self.sequential
        elif scan.start == 0:
            block = self.dc_refine if scan.high else self.dc_first
        else:
            block = self.ac_refine if scan.high else self.ac_first
        unit = 0
        if len(scan.parts) > 1:
            mw, mh = f.mcus
            units = ([(i, (my * c.v + v) * c.padded_w + mx * c.h + h) for i, (c, _, _) in enumerate(scan.parts) for v in range(c.v) for h in range(c.h)] for my in range(mh) for mx in range(mw))
        else:
            c = scan.parts[0][0]
            units = ([(0, y * c.padded_w + x)] for y in range(c.blocks_h) for x in range(c.blocks_w))
        for blocks in units:
            if self.interval and unit and unit % self.interval == 0:
                self.restart()
            unit += 1
            if self.bits.used_up and not self.run and not (self.interval and self.next < len(self.parts)):
                break
            for i, b in blocks:
                block(i, scan.parts[i][0].coefs[b])

    def difference(self, i: int) -> int:
        """A DC value's difference to the one before; its size has 15 bits at most."""
        size = self.code(0, self.scan.parts[i][1]).read(self.bits)
        if size > 15:
            raise DecodeError(f"DC size {size}", NAME)
        return self.bits.extended(size)

    def sequential(self, i: int, out: np.ndarray) -> None:
        bits, (_, _, ac) = self.bits, self.scan.parts[i]
        self.predicted[i] += self.difference(i)
        out[0] = _short(self.predicted[i])
        k, read = 1, self.code(1, ac).read
        while k < 64:
            symbol = read(bits)
            run, size = symbol >> 4, symbol & 15
            if not size:
                if run < 15:
                    break
                k += 16
                continue
            k += run
            if k > 63:
                raise DecodeError("coefficients beyond the block", NAME)
            out[k] = bits.extended(size)
            k += 1

    def dc_first(self, i: int, out: np.ndarray) -> None:
        self.predicted[i] += self.difference(i)
        out[0] = _short(self.predicted[i] << self.scan.low)

    def dc_refine(self, i: int, out: np.ndarray) -> None:
        if self.bits.read(1):
            out[0] |= 1 << self.scan.low

    def ac_first(self, i: int, out: np.ndarray) -> None:
        if self.run:
            self.run -= 1
            return
        bits, scan, k = self.bits, self.scan, self.scan.start
        read = self.code(1, scan.parts[i][2]).read
        while k <= scan.end:
            symbol = read(bits)
            run, size = symbol >> 4, symbol & 15
            if size:
                k += run
                if k > 63:
                    raise DecodeError("coefficients beyond the block", NAME)
                out[k] = _short(bits.extended(size) << scan.low)
                k += 1
            elif run == 15:
                k += 16
            else:
                self.run = (1 << run) - 1 + bits.read(run)
                return

    def ac_refine(self, i: int, out: np.ndarray) -> None:
        """One more bit for a band. Places that hold a value already and places that don't are walked as two lists: a run counts the latter, and the former passed on the way take a correction bit each."""
        bits, scan, step = self.bits, self.scan, 1 << self.scan.low
        beyond = scan.end + 1
        band = out[scan.start : beyond].tolist()
        free = [scan.start + k for k, v in enumerate(band) if not v]
        held = iter([(scan.start + k, v) for k, v in enumerate(band) if v])
        ahead = next(held, (beyond, 0))

        def correct_before(place: int) -> None:
            nonlocal ahead
            while ahead[0] < place:
                at, v = ahead
                if bits.read(1) and not abs(v) & step:
                    out[at] = _short(v + step if v > 0 else v - step)
                ahead = next(held, (beyond, 0))

        place, passed = scan.start - 1, 0
        read = self.code(1, scan.parts[i][2]).read if not self.run else None
        while not self.run and place < scan.end:
            symbol = read(bits)
            run, size = symbol >> 4, symbol & 15
            if not size and run < 15:
                self.run = (1 << run) + bits.read(run)
                break
            value = (step if bits.read(1) else -step) if size else 0
            place = free[passed + run] if passed + run < len(free) else beyond
            correct_before(place)
            if value and place < beyond:  # a run over the band's end has nothing to set
                out[place] = value
            passed += run + 1
        if self.run:
            correct_before(beyond)
            self.run -= 1


def _short(v: int) -> int:
    return (v + 32768) % 65536 - 32768


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where a value stands that isn't the one before."""
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1]) if len(x) else np.zeros(0, np.int64)


def _wide(x: np.ndarray) -> np.ndarray:
    """Each value but the last two with those behind it, eight bits each."""
    out = x[:-2] << 8
    out |= x[1:-1]
    out <<= 8
    out |= x[2:]
    return out


def _within(totals: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Running totals that start anew at ``firsts``."""
    before = totals[firsts - 1]
    before[0] = 0
    sizes = np.empty(len(firsts), np.int64)
    sizes[:-1], sizes[-1] = firsts[1:] - firsts[:-1], len(totals) - firsts[-1]
    return totals - np.repeat(before, sizes)


class ScanWalk:
    """One scan by tables over all of its bits.

    For every bit position it is looked up how many bits a symbol there would
    take and how far it would lead, all positions at once; only the way from
    symbol to symbol is walked step by step. What the symbols mean is worked out
    afterwards, again all at once. Zeros follow each part, and a walk behind a
    part's end stays where it is.
    """

    #: Zero bytes behind a part: a last symbol and 63 corrections may reach into them.
    ROOM = 16

    def __init__(self, data: bytes, at: int, frame: Frame, scan: Scan, codes: dict, interval: int):
        self.frame, self.scan, self.codes, self.interval = frame, scan, codes, interval
        self.end = entropy_end(data, at)
        parts = [unstuffed(p) for p in restart_parts(data, at, self.end)]
        if not interval:
            del parts[1:]  # never reached
        sizes = np.array([len(p) for p in parts])
        self.firsts = np.cumsum(sizes + self.ROOM) - sizes - self.ROOM
        self.starts, self.limits = (8 * self.firsts).tolist(), (8 * (self.firsts + sizes)).tolist()
        self.bytes = np.frombuffer(bytes(self.ROOM).join([*parts, b"\0\0"]), np.uint8)

    @cached_property
    def wide(self) -> np.ndarray:
        """The 24 bits from each byte on."""
        return _wide(self.bytes.astype(np.uint32))

    @cached_property
    def windows(self) -> np.ndarray:
        """The 16 bits from each bit on, BEHIND from a part's end on."""
        out = (self.wide[:, None] >> np.arange(8, 0, -1, dtype=np.uint32) & np.uint32(0xFFFF)).ravel()
        out[(np.array(self.limits)[:, None] + np.arange(8 * self.ROOM)).ravel()] = BEHIND
        return out

    def code(self, kind: int, number: int) -> Code:
        if (kind, number) not in self.codes:
            raise DecodeError(f"Huffman table {kind}/{number} isn't there", NAME)
        return self.codes[kind, number]

    def bits(self, at: int, n: int) -> int:
        return int(self.wide[at >> 3]) >> (24 - (at & 7) - n) & ((1 << n) - 1)

    def symbols(self, code: Code, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs, sizes and signed magnitudes of the symbols at some bits."""
        entry = code.table[self.windows[at]]
        size = entry >> 5 & 15
        from_ = at + (entry & 31)
        value = (self.wide[from_ >> 3].astype(np.int64) >> (24 - (from_ & 7) - size)) & ((1 << size) - 1)
        return entry >> 9, size, np.where(value >> np.maximum(size - 1, 0), value, value - (1 << size) + 1) * (size > 0)

    def place(self) -> None:
        """Where the scan's blocks stand among the frame's."""
        scan, f = self.scan, self.frame
        if len(scan.parts) > 1:
            mw, mh = f.mcus
            x, y = np.arange(mw)[None, :, None], np.arange(mh)[:, None, None]
            cells = [(i, v, h) for i, (c, _, _) in enumerate(scan.parts) for v in range(c.v) for h in range(c.h)]
            first, up, across, tall, wide, v, h = (np.array(k) for k in zip(*((c.first, c.padded_w, c.h, c.v, 1, v, h) for c, v, h in ((scan.parts[i][0], v, h) for i, v, h in cells)), strict=True))
            self.rows = (first + (y * tall + v) * up + x * across + h * wide).ravel()
            self.of_unit = [i for i, _, _ in cells]
            self.units = mw * mh
        else:
            c = scan.parts[0][0]
            self.rows = (c.first + np.arange(c.blocks_h)[:, None] * c.padded_w + np.arange(c.blocks_w)).ravel()
            self.of_unit, self.units = [0], c.blocks_w * c.blocks_h

    def read(self) -> None:
        scan, f = self.scan, self.frame
        self.place()
        if not self.limits[0] and len(self.limits) == 1:
            return
        if not f.progressive:
            self.sequential()
        elif scan.start == 0:
            self.dc_refine() if scan.high else self.dc_first()
        elif scan.high:
            self.ac_refine()
        else:
            self.ac_first()

    def intervals(self) -> Iterator[tuple[int, bool]]:
        """Units up to the next restart, and whether a part follows that a used-up one gives way to."""
        self.part, at = 0, 0
        step = self.interval or self.units
        while at < self.units:
            n = min(step, self.units - at)
            yield n, self.part + 1 < len(self.limits)
            at += n

    def restarted(self, p: int) -> int:
        """Behind an interval: on to the next part if this one is used up; a missing marker is let pass."""
        p = -(-p // 8) * 8
        if self.part + 1 < len(self.limits) and p >= self.limits[self.part]:
            self.part += 1
            return self.starts[self.part]
        return p

    def fault(self, code: Code, at: int) -> DecodeError:
        entry = int(code.table[self.windows[at]])
        return DecodeError(f"DC size {entry >> 5}" if entry & 31 else "no such Huffman code", NAME)

    def dc_values(self, codes: list[Code], at: list[int], firsts: list[int]) -> None:
        """Sets the first coefficient of each block whose symbol is at ``at``; ``firsts`` are the blocks at which the prediction starts anew."""
        if not at:
            return
        places, part = np.array(at, np.int64), np.tile(self.of_unit, len(at) // len(self.of_unit))
        anew = np.zeros(len(at), np.int64)
        anew[[k for k in firsts if k < len(at)]] = 1
        interval = np.cumsum(anew)
        for i in {*self.of_unit}:
            own = np.flatnonzero(part == i)
            value = _within(np.cumsum(self.symbols(codes[i], places[own])[2]), _firsts(interval[own]))
            self.frame.coefs[self.rows[own], 0] = (value << self.scan.low).astype(np.int16)

    def ac_values(self, codes: list[Code], at: list[int], ends: list[int]) -> None:
        """Sets the coefficients whose symbols are at ``at``; ``ends`` has the number of symbols up to each block's end."""
        if not at:
            return
        places = np.array(at, np.int64)
        block = np.repeat(np.arange(len(ends)), np.diff(np.array([0, *ends])))
        groups = [(codes[0], slice(None))]
        if len({*map(id, codes)}) > 1:
            part = np.tile(self.of_unit, len(ends) // len(self.of_unit))[block]
            groups = [(codes[i], np.flatnonzero(part == i)) for i in {*self.of_unit}]
        for code, own in groups:
            of = block[own]
            run, size, value = self.symbols(code, places[own])
            step = np.where(size, run + 1, np.where(run == 15, 16, 0))
            k = self.band_start - 1 + _within(np.cumsum(step), _firsts(of))
            set_ = np.flatnonzero(size)
            self.frame.coefs[self.rows[of[set_]], k[set_]] = (value[set_] << self.scan.low).astype(np.int16)

    @property
    def band_start(self) -> int:
        return self.scan.start or 1

    def sequential(self) -> None:
        dc, ac = ([self.code(kind, p[1 + kind]) for p in self.scan.parts] for kind in (0, 1))
        unit, ahead = [(dc[i].dc_bits, dc[i], ac[i].ac_bits, ac[i].steps, ac[i]) for i in self.of_unit], memoryview(self.windows)
        at_dc, at_ac, ends, firsts, p = [], [], [], [0], 0
        put, seen = at_ac.append, len
        for n, more in self.intervals():
            limit = self.limits[self.part]
            for _ in range(n):
                if p >= limit and not more:
                    break
                for taken, dc_code, ac_taken, steps, ac_code in unit:
                    step = taken[ahead[p]]
                    if step == FAULT:
                        raise self.fault(dc_code, p)
                    at_dc.append(p)
                    p += step
                    k = 1
                    while k < 64:
                        put(p)
                        window = ahead[p]
                        step = steps[window]
                        k += step
                        p += ac_taken[window]
                    if k > 64 and (step < ENDS or step == FAULT):
                        self.beyond(ac_code, at_ac[-1], step)
                    ends.append(seen(at_ac))
            else:
                p = self.restarted(p)
                firsts.append(len(at_dc))
                continue
            break
        self.dc_values(dc, at_dc, firsts)
        self.ac_values(ac, at_ac, ends)

    def beyond(self, code: Code, at: int, step: int) -> None:
        """What is wrong with the last symbol of a block that was led over its end; sixteen zeros may do so."""
        if step == FAULT:
            raise self.fault(code, at)
        if code.table[self.windows[at]] >> 5 & 15:
            raise DecodeError("coefficients beyond the block", NAME)

    def dc_first(self) -> None:
        codes = [self.code(0, p[1]) for p in self.scan.parts]
        unit, ahead = [(codes[i].dc_bits, codes[i]) for i in self.of_unit], memoryview(self.windows)
        at, firsts, p = [], [0], 0
        for n, more in self.intervals():
            limit = self.limits[self.part]
            for _ in range(n):
                if p >= limit and not more:
                    break
                for taken, code in unit:
                    step = taken[ahead[p]]
                    if step == FAULT:
                        raise self.fault(code, p)
                    at.append(p)
                    p += step
            else:
                p = self.restarted(p)
                firsts.append(len(at))
                continue
            break
        self.dc_values(codes, at, firsts)

    def dc_refine(self) -> None:
        """A bit for each block."""
        at, p, size = [], 0, len(self.of_unit)
        for n, more in self.intervals():
            limit = self.limits[self.part]
            read = n if more else min(n, -(-max(limit - p, 0) // size))
            at.append(np.minimum(p + np.arange(read * size), limit))
            if read < n:
                break
            p = self.restarted(min(p + n * size, limit))
        places = np.concatenate(at)
        rows = self.rows[: len(places)]
        self.frame.coefs[rows, 0] |= (self.one(places) << self.scan.low).astype(np.int16)

    def one(self, at: np.ndarray) -> np.ndarray:
        return self.bytes[at >> 3].astype(np.int64) >> (7 - (at & 7)) & 1

    def ac_first(self) -> None:
        code, (first, last) = self.code(1, self.scan.parts[0][2]), (self.scan.start, self.scan.end)
        taken, steps, ahead = code.band_bits, code.steps, memoryview(self.windows)
        at, ends, p = [], [], 0
        put, seen = at.append, len
        for n, more in self.intervals():
            limit, run = self.limits[self.part], 0
            for _ in range(n):
                if run:
                    run -= 1
                    ends.append(seen(at))
                    continue
                if p >= limit and not more:
                    break
                k = first
                while k <= last:
                    put(p)
                    window = ahead[p]
                    step = steps[window]
                    k += step
                    p += taken[window]
                if step > ENDS or 64 < k < ENDS:
                    if step < ENDS or step == FAULT:
                        self.beyond(code, at[-1], step)
                    else:
                        run = self.run_of(code, at[-1], step - ENDS) - 1
                ends.append(seen(at))
            else:
                p = self.restarted(p)
                continue
            break
        self.ac_values([code], at, ends)

    def run_of(self, code: Code, at: int, n: int) -> int:
        """Blocks of a band that end with the one at hand."""
        return (1 << n) + self.bits(at + (int(code.table[self.windows[at]]) & 31), n)

    def ac_refine(self) -> None:
        """One more bit for a band. A run counts places without a value; those with one that are passed on the way take a correction bit each, which are noted as stretches."""
        scan, coefs = self.scan, self.frame.coefs
        code, step_of = self.code(1, scan.parts[0][2]), 1 << scan.low
        taken, symbols, ahead = code.refined_bits, code.symbols, None
        end_code, end_bits = code.end
        band = scan.end - scan.start + 1
        rows = self.rows
        own = coefs[rows[0] : rows[-1] + 1] if rows[-1] - rows[0] == len(rows) - 1 else coefs[rows]
        there = own != 0
        there[:, : scan.start] = there[:, scan.end + 1 :] = False
        cells = np.flatnonzero(there)
        held_block = cells >> 6
        held = memoryview((cells & 63) - scan.start)
        held_in = np.bincount(held_block, minlength=len(rows))
        first_held = np.concatenate([[0], np.cumsum(held_in)])
        bounds = memoryview(first_held)
        stretches: list[tuple[int, int, int]] = []
        new: list[tuple[int, int, int]] = []
        p, block = 0, 0
        plain, many = [], 16
        for n, more in self.intervals():
            limit, run, until, tried = self.limits[self.part], 0, block + n, block
            while block < until:
                if not run and block >= tried and until - block >= 8:
                    # blocks that have an end at once, and values' bits behind it
                    least = min(many, until - block)
                    ends = np.cumsum(held_in[block : block + least] + end_bits) if end_bits else np.zeros(0, np.int64)
                    at = p + ends - held_in[block : block + len(ends)] - end_bits
                    fits = np.searchsorted(ends, limit - p, "right")
                    at = at[:fits]
                    ended = self.wide[at >> 3] >> (24 - end_bits - (at & 7)) & ((1 << end_bits) - 1) == end_code
                    passed = int(ended.argmin()) if not ended.all() else fits
                    if passed:
                        plain.append((block, at[:passed] + end_bits))
                        p += int(ends[passed - 1])
                        block += passed
                    many, tried = min(2 * many, 4096) if passed == least else 16, block + (0 if passed >= 4 else 8)
                    if passed == least:
                        continue
                j = first = bounds[block]
                end = bounds[block + 1]
                if not run:
                    if p >= limit and not more:
                        break
                    ahead = ahead or memoryview(self.windows)
                    free, passed, place = band - end + first, 0, -1
                    while place < band - 1:
                        at, window = p, ahead[p]
                        symbol, step = symbols[window], taken[window]
                        if step == FAULT:
                            raise self.fault(code, p)
                        p += step
                        zeros, size = symbol >> 4, symbol & 15
                        if not size and zeros < 15:
                            run = self.run_of(code, at, zeros) if zeros else 1
                            break
                        here, nth = j, passed + zeros
                        if nth < free:
                            while j < end and held[j] <= nth + j - first:
                                j += 1
                            place = nth + j - first
                            if size:
                                new.append((block, place, p - 1 if step else p))
                        else:  # a run over the band's end has nothing to set
                            place, j = band, end
                        if j > here:
                            stretches.append((p, here, j - here))
                            p = min(p + j - here, max(limit, p))
                        passed = nth + 1
                if run:
                    if end > j:
                        stretches.append((p, j, end - j))
                        p += end - j
                    run -= 1
                if p > limit:
                    p = limit
                block += 1
            else:
                p = self.restarted(p)
                continue
            break
        if stretches or plain:
            at, first, n = np.array(stretches, np.int64).reshape(-1, 3).T
            blocks = np.concatenate([np.zeros(0, np.int64), *(b + np.arange(len(x)) for b, x in plain)])
            at = np.concatenate([at, *(x for _, x in plain)])
            first, n = np.concatenate([first, first_held[blocks]]), np.concatenate([n, held_in[blocks]])
            order = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            which = np.repeat(first, n) + order
            which = which[self.one(np.repeat(at, n) + order) > 0]
            place = 64 * rows[held_block[which]] + (cells[which] & 63)
            flat = coefs.reshape(-1)
            value = flat[place].astype(np.int64)
            flat[place] = (value + (np.abs(value) & step_of == 0) * np.sign(value) * step_of).astype(np.int16)
        if new:
            block_, place_, sign = np.array(new, np.int64).T
            coefs[self.rows[block_], scan.start + place_] = np.where(self.one(sign), step_of, -step_of)


#: Bits of a lane, and those in which it must meet the next one; steps that a lane may take.
LANE, MEET, LANE_STEPS = 4096, 1536, 2048
#: Bits of scans whose values are set at a time, about.
VALUED = 1 << 21
#: Bytes of coefficients for each byte of a file, at most, for files that share memory.
SHARED = 256


def share(frames: list[Frame]) -> None:
    """One array for the coefficients of all frames, none of which is read yet."""
    sizes = [len(f.coefs) for f in frames]
    all_, at = np.zeros((sum(sizes), 64), np.int16), 0
    for f, n in zip(frames, sizes, strict=True):
        f.shared, f.at, f.coefs = all_, at, all_[at : at + n]
        for c in f.components:
            c.coefs = f.coefs[c.first : c.first + len(c.coefs)]
        at += n


def _chains(wide: np.ndarray, taken: np.ndarray, first: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the symbols of streams from ``first`` to ``limit``, the 16 bits from each on, their number in each stream, and which streams are known.

    How far a symbol leads depends on its own bits alone, so a stream is walked
    from several places at once, in lanes. A lane begun between two symbols' starts
    soon comes to stand at one; from the first place that the lane before it also
    reaches both go the same way. A stream with a lane that isn't met is unknown.
    """
    lanes = np.maximum(1, (limit - first + LANE // 2) // LANE)
    length = -(-(limit - first) // lanes)
    of, ends = np.repeat(np.arange(len(first)), lanes), np.cumsum(lanes)
    begin = first[of] + (np.arange(len(of)) - np.repeat(ends - lanes, lanes)) * length[of]
    later = np.flatnonzero(begin > first[of])
    stop = limit[of]
    stop[later - 1] = np.minimum(stop[later - 1], begin[later] + MEET)
    # lanes go some way beyond their end
    wide = np.concatenate([wide, np.zeros(8 * 31 + 8, np.int64)])
    most, p, found, ahead = 8 * len(wide) - 64 * 31 - 64, begin.copy(), [], []
    w, bit, n = np.empty_like(p), np.empty_like(p), np.empty(len(p), np.uint8)
    while len(found) < LANE_STEPS // 32 and (p < stop).any():
        np.minimum(p, most, out=p)
        places, windows = np.empty((32, len(p)), np.int32), np.empty((32, len(p)), np.uint16)
        for row, seen in zip(places, windows, strict=True):
            row[:] = p
            np.right_shift(p, 3, out=bit)
            wide.take(bit, out=w, mode="clip")
            np.bitwise_and(p, 7, out=bit)
            np.left_shift(w, bit, out=w)
            np.right_shift(w, 8, out=w)
            np.bitwise_and(w, 0xFFFF, out=w)
            seen[:] = w
            taken.take(w, out=n, mode="clip")
            np.add(p, n, out=p)
        found.append(places)
        ahead.append(windows)
    places = np.ascontiguousarray(np.concatenate([*found, np.empty((0, len(p)), np.int32)]).T)
    windows = np.ascontiguousarray(np.concatenate([*ahead, np.empty((0, len(p)), np.uint16)]).T)
    known = np.ones(len(first), bool)
    known[of[p < stop]] = False
    met, more = begin.copy(), []
    if len(later):
        seen, mine, low = np.zeros(8 * len(wide), bool), places[later - 1], begin[later, None]
        seen[mine[(mine >= low) & (mine < low + MEET)]] = True
        mine = places[later]
        both = seen[mine] & (mine < low + MEET)
        nth = both.argmax(axis=1)
        met[later] = mine[np.arange(len(later)), nth]
        for j in later[~both[np.arange(len(later)), nth]].tolist():  # the lane before goes on, up to this one's end
            way, own, goal = [x for x in places[j - 1].tolist() if x >= begin[j]], {*places[j].tolist()}, int(stop[j])
            at = next((x for x in way if x < goal and x in own), None)
            q = int(p[j - 1])
            while at is None and q < goal:
                if q in own:
                    at = q
                else:
                    more.append(q)
                    q += int(taken[int(wide[q >> 3]) >> (8 - (q & 7)) & 0xFFFF])
            known[of[j]] &= at is not None
            met[j] = at or 0
        for j in later.tolist():
            met[j] = max(met[j], met[j - 1])
    end = limit[of]
    end[later - 1] = met[later]
    if not known.all():
        end[~known[of]] = 0
    within = (places >= met.astype(np.int32)[:, None]) & (places < end.astype(np.int32)[:, None])
    at, windows = places[within].astype(np.int64), windows[within]
    if more:
        more = np.array(more)
        lane = np.searchsorted(begin, more, "right") - 1
        at = np.sort(np.concatenate([at, more[known[of[lane]]]]), kind="stable")
        windows = (wide[at >> 3] >> (8 - (at & 7)) & 0xFFFF).astype(np.uint16)
    return at, windows, np.searchsorted(at, limit) - np.searchsorted(at, first), known


def walked(walks: list[ScanWalk]) -> list[ScanWalk]:
    """Those of some scans that could be read together and have been; of frames that share their memory."""
    groups: dict[tuple, list[ScanWalk]] = {}
    for x in walks:
        scan, codes = x.scan, set()
        if scan.high:
            continue
        if not x.frame.progressive or not scan.start:
            codes |= {x.codes.get((0, p[1])) for p in scan.parts}
        if not x.frame.progressive or scan.start:
            codes |= {x.codes.get((1, p[2])) for p in scan.parts}
        if len(codes) > 1 or None in codes:
            continue  # what a symbol means to the bits hangs on its place
        x.place()
        if len(x.limits) == -(-x.units // (x.interval or x.units)):
            groups.setdefault((id(codes.pop()), x.frame.progressive, scan.start, scan.end, scan.low, *x.of_unit), []).append(x)
    return [x for group in groups.values() for x in _walked(group)]


def _walked(walks: list[ScanWalk]) -> list[ScanWalk]:
    """As ``walked``, of scans with one code and alike in all but their length. Scans with any fault are left to be read alone."""
    one = walks[0]
    single, mixed = one.frame.progressive and not one.scan.start, not one.frame.progressive
    code = one.code(0, one.scan.parts[0][1]) if single else one.code(1, one.scan.parts[0][2])
    sizes = np.array([len(x.bytes) for x in walks])
    if 8 * sizes.sum() >= 1 << 30:
        return []
    wide = _wide(np.concatenate([x.bytes for x in walks]).astype(np.int64))
    base = 8 * (np.cumsum(sizes) - sizes)
    parts = np.array([len(x.limits) for x in walks])
    first, limit = (np.concatenate([getattr(x, k) for x in walks]) + np.repeat(base, parts) for k in ("starts", "limits"))
    at, ahead, counts, known = _chains(wide, code.chain_bits, first, limit)
    # what follows takes its time from memory, so it is done for some scans at a time
    done, a, streams, symbols = [], 0, np.cumsum(parts), np.concatenate([[0], np.cumsum(counts)])
    while a < len(walks):
        b = max(a + 1, int(np.searchsorted(base, base[a] + VALUED, "right")) - 1) if base[-1] - base[a] > VALUED else len(walks)
        own = slice(streams[a] - parts[a], streams[b - 1])
        those = slice(symbols[own.start], symbols[own.stop])
        done += _valued(walks[a:b], code, single, mixed, wide, limit[own], at[those], ahead[those], counts[own], known[own])
        a = b
    return done


def _valued(walks: list[ScanWalk], code: Code, single: bool, mixed: bool, wide: np.ndarray, limit: np.ndarray, at: np.ndarray, ahead: np.ndarray, counts: np.ndarray, known: np.ndarray) -> list[ScanWalk]:
    """Sets what the symbols of scans mean, all of whose streams hold as many blocks as they should and no fault; ``single`` symbols are a block each, ``mixed`` ones have a first value and others."""
    one = walks[0]
    scan, of_unit = one.scan, np.array(one.of_unit)
    parts = np.array([len(x.limits) for x in walks])
    of = np.repeat(np.arange(len(walks)), parts)  # the scan of each stream
    nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    units = np.array([x.units for x in walks])
    step = np.array([x.interval or x.units for x in walks])
    blocks = np.minimum(step[of], units[of] - nth * step[of]) * len(of_unit)
    final = nth == parts[of] - 1

    ends = np.cumsum(counts)
    moved = code.chain_steps(single, mixed)[ahead]
    if single:
        known &= counts >= blocks
        behind = np.where(known, ends - counts + blocks, ends)
    else:
        total = np.cumsum(moved, dtype=np.int64)
        before = total if mixed else total - moved
        reach = np.searchsorted(total, before + (63 if mixed else scan.end - scan.start + 1)) + 1
        # an end leads over any block's end; blocks that the last symbol doesn't end lead behind all streams
        follows = memoryview(np.append(reach, [len(at) + 1] * 2))
        starts, behind = [], []
        put = starts.append
        for i, n in zip((ends - counts).tolist(), blocks.tolist(), strict=True):
            for _ in range(n):
                put(i)
                i = follows[i]
            behind.append(i)
        starts, behind = np.array(starts, np.int64), np.array(behind, np.int64)
        known &= (behind <= ends) & (counts > 0)
    if not len(at):
        return []
    # nothing is left of a stream but the bits that fill its last byte
    last = np.where(known, behind - 1, 0)
    over = at[last] + code.chain_bits[ahead[last]] - limit
    known &= (over <= 0) & (final | (over > -8))

    used = np.zeros(len(at) + 1, np.int8)
    np.add.at(used, (ends - counts)[known], 1)
    np.add.at(used, behind[known], -1)
    used = np.cumsum(used[:-1], dtype=np.int8) > 0
    stream = lambda symbols: np.searchsorted(ends, symbols, "right")
    known[stream(np.flatnonzero(used & (moved == FAULT)))] = False
    value = code.chain_values[ahead]
    long = np.flatnonzero(value == LONG)
    entry = code.table[ahead[long]]
    n, from_ = entry >> 5 & 15, at[long] + (entry & 31)
    part = wide[from_ >> 3] >> (24 - (from_ & 7) - n) & ((1 << n) - 1)
    value[long] = np.where(part >> np.maximum(n - 1, 0), part, part - (1 << n) + 1) * (n > 0)
    if not single:
        of_known = np.repeat(known, blocks)
        here = starts[of_known]
        begun = np.zeros(len(at), bool)
        begun[here] = True
        own = used & (value != 0)
        if mixed:
            known[stream(here[code.table[ahead[here]] >> 9 > 0])] = False
            own &= ~begun
        own = np.flatnonzero(own)
        # streams that are known no more may have symbols before the first block
        block = np.maximum(np.cumsum(begun)[own] - 1, 0)
        k = total[own] - before[here][block] + (0 if mixed else scan.start - 1) if len(here) else own
        known[stream(own[k > (63 if mixed else scan.end)])] = False
    good = np.ones(len(walks), bool)
    good[of[~known]] = False
    if not good.any():
        return []
    coefs = one.frame.shared.reshape(-1)
    rows = 64 * np.concatenate([x.rows + x.frame.at for x in walks])
    if not single:
        if not good.all():
            kept = good[of[stream(own)]]
            own, k, block = own[kept], k[kept], block[kept]
        coefs[rows[of_known][block] + k] = value[own] << scan.low
    if single or mixed:
        fine = good[of]
        mine = np.flatnonzero(np.repeat(fine, blocks))
        if mixed:
            symbol = starts[mine]
        else:
            symbol = np.flatnonzero(used)
            symbol = symbol[fine[stream(symbol)]]
        difference, of_stream = value[symbol].astype(np.int64), np.repeat(np.arange(len(of)), blocks)[mine]
        part = np.tile(of_unit, len(mine) // len(of_unit))
        for i in {*one.of_unit}:
            its = np.flatnonzero(part == i)
            sums = _within(np.cumsum(difference[its]), _firsts(of_stream[its]))
            coefs[rows[mine[its]]] = (sums << scan.low).astype(np.int16)
    return [x for x, fine in zip(walks, good, strict=True) if fine]


@dataclass
class State:
    frame: Frame | None = None
    tables: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[tuple[int, int], Code] = field(default_factory=dict)
    interval: int = 0
    scans: int = 0
    jfif: bool = False
    adobe: int | None = None
    orientation: int | None = None
    comment: str | None = None


def _scans(data: bytes, s: State, walk: type[ScanWalk] | type[ScanReader] = ScanWalk) -> Iterator[ScanWalk | ScanReader]:
    """Fills a state from all segments; each scan is to be read before the next is asked for."""
    at, seq = 2, 0
    while segment := next_segment(data, at, seq):
        seq += 1
        at = segment.data_offset + segment.length
        body, marker, here = data[segment.data_offset : at], segment.marker, segment.offset
        if marker == 0xD9:
            break
        if marker == 0xDB:
            s.tables |= parse_dqt(body, here)
        elif marker == 0xC4:
            s.codes |= parse_dht(body, here)
        elif is_sof(marker):
            if s.frame is not None:
                raise unsupported("more than one frame", NAME, here)
            s.frame = parse_sof(marker, body, here)
            s.frame.open()
        elif marker == 0xDD:
            if len(body) < 2:
                raise DecodeError("restart interval is cut off", NAME, here)
            s.interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            if s.frame is None:
                raise DecodeError("a scan before the frame", NAME, here)
            scan = walk(data, at, s.frame, parse_sos(body, s.frame, here), s.codes, s.interval)
            yield scan
            at, s.scans = scan.end, s.scans + 1
        elif marker == 0xE0 and body[:5] == b"JFIF\0":
            s.jfif = True
        elif marker == 0xE1 and s.orientation is None:
            s.orientation = exif_orientation(body)
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            s.adobe = body[11]
        elif marker == 0xFE and s.comment is None:
            text = "".join(ch if ch >= " " and ch != "\x7f" else " " for ch in body[:COMMENT_CHARS].decode("latin-1")).strip()
            s.comment = text or None
    if s.frame is None or not s.scans:
        raise DecodeError("no frame or no scan", NAME, len(data))


def read(data: bytes, walk: type[ScanWalk] | type[ScanReader] = ScanWalk) -> State:
    """All segments and scans, up to the coefficients."""
    s = State()
    for scan in _scans(data, s, walk):
        scan.read()
    return s


def read_all(files: list[bytes]) -> list[State | DecodeError]:
    """What ``read`` gives or raises for each of some files, whose scans are walked together where they can be."""
    states, out = [State() for _ in files], [None] * len(files)
    steps = {i: _scans(data, states[i]) for i, data in enumerate(files)}
    placed = False
    while steps:
        scans: dict[int, ScanWalk] = {}
        for i in [*steps]:
            try:
                scans[i] = next(steps[i])
            except StopIteration:
                out[i] = states[i]
                del steps[i]
            except DecodeError as e:
                out[i] = e
                del steps[i]
        if not placed:  # no scan has been read yet, so that the frames may move
            share([states[i].frame for i in scans if 128 * len(states[i].frame.coefs) <= SHARED * len(files[i])])
            placed = True
        done = {id(x) for x in walked([x for x in scans.values() if x.frame.shared is not None])}
        for i, scan in scans.items():
            try:
                if id(scan) not in done:
                    scan.read()
            except DecodeError as e:
                out[i] = e
                del steps[i]
    return out


def render(c: Component, table: np.ndarray) -> np.ndarray:
    """A component's samples on its padded grid."""
    natural = np.zeros((len(c.coefs), 64), np.int64)
    natural[:, ZIGZAG] = c.coefs.astype(np.int64) * table
    return idct(natural.reshape(-1, 8, 8)).reshape(c.padded_h, c.padded_w, 8, 8).swapaxes(1, 2).reshape(8 * c.padded_h, 8 * c.padded_w)


def decode(data: bytes) -> Image:
    s = read(data)
    f = s.frame
    space, planes = color_space([c.id for c in f.components], s.jfif, s.adobe), []
    for c in f.components:
        if c.table not in s.tables:
            raise DecodeError(f"quantisation table {c.table} isn't there", NAME)
        planes.append(upsample(render(c, s.tables[c.table]), c, f))
    pixels = to_rgba(planes, space, s.adobe is not None)
    if s.orientation:
        pixels = oriented(pixels, s.orientation)
    mw, mh = f.mcus
    extra = {"sampling": f.sampling, "MCUs": f"{mw} x {mh}", "scans": str(s.scans), "restart interval": str(s.interval), "JFIF": str(s.jfif).lower()}
    extra["quantisation"] = "; ".join(f"{t}: DC {int(s.tables[t][0])}, mean {float(np.mean(s.tables[t])):.2f}" for t in sorted({c.table for c in f.components}))
    extra |= {k: str(v) for k, v in (("orientation", s.orientation), ("Adobe transform", s.adobe), ("comment", s.comment)) if v is not None}
    return Image(pixels, NAME, {0xC0: "baseline", 0xC1: "extended", 0xC2: "progressive"}[f.marker], 8, len(f.components), space, "DCT", False, extra)
