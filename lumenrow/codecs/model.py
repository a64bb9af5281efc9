"""What decoders share: results, classified errors, limits and bit readers."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# The limits of an image.
MAX_SIDE = 65_535
MAX_PIXELS = 163_840_000


class DecodeError(Exception):
    """A classified failure. ``kind`` is malformed, unsupported or unknown."""

    def __init__(self, message: str, format: str | None = None, offset: int | None = None, kind: str = "malformed"):
        super().__init__(message)
        self.kind, self.format, self.message, self.offset = kind, format, message, offset


def unsupported(message: str, format: str, offset: int | None = None) -> DecodeError:
    """A valid file with a feature that isn't there."""
    return DecodeError(message, format, offset, "unsupported")


def check_size(width: int, height: int, format: str) -> None:
    if width <= 0 or height <= 0:
        raise DecodeError(f"image of {width} x {height} pixels", format)
    if width > MAX_SIDE or height > MAX_SIDE or height > MAX_PIXELS // width:
        raise DecodeError(f"image of {width} x {height} pixels is over the limit", format)


@dataclass
class Image:
    """A decoded image: ``pixels`` is height x width x 4, RGBA."""

    pixels: np.ndarray
    format: str
    variant: str
    bit_depth: int
    channels: int
    color_space: str = "RGB"
    compression: str = "none"
    is_lossless: bool = True
    extra: dict[str, str] = field(default_factory=dict)

    @property
    def width(self) -> int:
        return self.pixels.shape[1]

    @property
    def height(self) -> int:
        return self.pixels.shape[0]

    @property
    def has_transparency(self) -> bool:
        return bool((self.pixels[:, :, 3] != 255).any())


def rgba(r, g, b, a=255) -> np.ndarray:
    """Planes, or numbers, to an RGBA array of the planes' shape."""
    planes = np.broadcast_arrays(r, g, b, a)
    return np.stack(planes, axis=-1).astype(np.uint8)


def need(data: bytes, at: int, n: int, what: str, format: str) -> None:
    if at < 0 or at + n > len(data):
        raise DecodeError(f"{what}: {n} bytes wanted, {max(0, len(data) - at)} left", format, at)


class LsbBits:
    """Bits from the lowest of each byte on; running out of them is an error."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None, format: str = "deflate"):
        self.data, self.at, self.end, self.format = data, at, len(data) if end is None else end, format
        self.held = self.count = 0

    def fill(self, n: int) -> None:
        """Hold n bits if there are as many."""
        while self.count < n and self.at < self.end:
            step = min(6, self.end - self.at)
            self.held |= int.from_bytes(self.data[self.at : self.at + step], "little") << self.count
            self.at += step
            self.count += 8 * step

    def read(self, n: int) -> int:
        if self.count < n:
            self.fill(n)
            if self.count < n:
                raise DecodeError("the bit stream ends early", self.format, self.at)
        value = self.held & ((1 << n) - 1)
        self.held >>= n
        self.count -= n
        return value

    def align(self) -> None:
        drop = self.count % 8
        self.held >>= drop
        self.count -= drop

    def position(self) -> int:
        """The byte after the last one of which bits were taken."""
        return self.at - self.count // 8

    def aligned_bytes(self, n: int) -> bytes:
        self.align()
        start = self.position()
        if start + n > self.end:
            raise DecodeError("the bit stream ends early", self.format, start)
        self.held = self.count = 0
        self.at = start + n
        return bytes(self.data[start : start + n])


class MsbBits:
    """Bits from the highest of each byte on; zero bits follow the last one."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.count = data, 0, 0, 0

    def fill(self, n: int) -> None:
        while self.count < n:
            step = self.data[self.at : self.at + 6]
            self.at += 6
            step = step.ljust(6, b"\0")
            self.held = (self.held << 48 | int.from_bytes(step, "big")) & ((1 << (self.count + 48)) - 1)
            self.count += 48

    def peek(self, n: int) -> int:
        if self.count < n:
            self.fill(n)
        return self.held >> (self.count - n) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.count -= n
        self.held &= (1 << self.count) - 1

    def read(self, n: int) -> int:
        if not n:
            return 0
        value = self.peek(n)
        self.skip(n)
        return value

    def extended(self, n: int) -> int:
        """n bits as a signed magnitude: the lower half of the values are negative."""
        if not n:
            return 0
        value = self.read(n)
        return value if value >> (n - 1) else value - (1 << n) + 1

    @property
    def used_up(self) -> bool:
        """Whether all real bits are taken."""
        return 8 * self.at - self.count >= 8 * len(self.data)

    def align(self) -> None:
        self.skip(self.count % 8)


def canonical_codes(lengths: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a canonical prefix code, by length and then symbol."""
    out, code, last = [], 0, 0
    for length, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= length - last
        out.append((symbol, code, length))
        code, last = code + 1, length
    return out


def kraft(lengths: list[int], bits: int = 15) -> int:
    """How much of the code space the lengths use: 2^bits if they fill it."""
    return sum(1 << (bits - n) for n in lengths if n)


class LsbCode:
    """Decodes a canonical code whose bits come lowest first, by one table of the longest code's size."""

    def __init__(self, lengths: list[int], what: str, format: str, single_is_free: bool = False):
        used = [n for n in lengths if n]
        if used and kraft(lengths) > 1 << 15:
            raise DecodeError(f"{what}: too many codes", format)
        if not used and single_is_free:
            raise DecodeError(f"{what}: no code", format)
        if len(used) > 1 and kraft(lengths) != 1 << 15:
            raise DecodeError(f"{what}: codes are missing", format)
        self.what, self.format = what, format
        self.only = lengths.index(used[0]) if single_is_free and len(used) == 1 else None
        self.bits = max(used, default=0)
        table = np.zeros(1 << self.bits, np.int32)
        for symbol, code, n in canonical_codes(lengths):
            reversed_ = int(f"{code:0{n}b}"[::-1], 2)
            table[reversed_ :: 1 << n] = symbol << 4 | n
        self.table = table.tolist()

    def read(self, bits: LsbBits) -> int:
        if self.only is not None:
            return self.only
        if bits.count < self.bits:
            bits.fill(self.bits)
        entry = self.table[bits.held & ((1 << self.bits) - 1)]
        n = entry & 15
        if not n:
            raise DecodeError(f"{self.what}: no such code", self.format, bits.position())
        if n > bits.count:
            raise DecodeError("the bit stream ends early", self.format, bits.position())
        bits.held >>= n
        bits.count -= n
        return entry >> 4
