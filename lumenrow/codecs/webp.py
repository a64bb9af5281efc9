"""WebP: the RIFF container and lossless bitstreams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from .model import DecodeError, Image, LsbBits, LsbCode, check_size, unsupported

NAME = "WebP"
# Flags of the extended header.
FLAGS = {"animation": 2, "XMP": 4, "EXIF": 8, "alpha": 16, "ICC": 32}
# The order in which the lengths of the code-length code are stored.
ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# Columns left and rows up of each short distance code.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
HASH = 0x1E35A7BD
BLACK = 0xFF000000
KINDS = ("predictor", "cross-color", "subtract-green", "color-indexing")


@dataclass
class Chunk:
    seq: int
    tag: str
    offset: int
    length: int
    data: bytes


@dataclass
class Transform:
    kind: int
    bits: int = 0
    width: int = 0
    data: np.ndarray | None = None


@dataclass
class Features:
    transforms: list[str] = field(default_factory=list)
    cache_bits: int = 0
    groups: int = 1
    modes: list[int] = field(default_factory=list)


def matches(data: bytes) -> bool:
    return len(data) >= 12 and data[:4] == b"RIFF" and data[8:12] == b"WEBP"


def chunks(data: bytes) -> Iterator[Chunk]:
    """The chunks in order, each padded to an even length; the file's own length is not held against it."""
    at, seq = 12, 0
    while at + 8 <= len(data):
        tag, n = data[at : at + 4].decode("latin-1"), int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + n > len(data):
            raise DecodeError(f"chunk {tag} of {n} bytes goes beyond the file", NAME, at)
        yield Chunk(seq, tag, at, n, data[at + 8 : at + 8 + n])
        at, seq = at + 8 + n + (n & 1), seq + 1


def sub_size(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


def distance(width: int, code: int) -> int:
    """Pixels back for a distance code: the short ones lie near the pixel in two dimensions."""
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, y * width + x)


def index_bits(colors: int) -> int:
    """log2 of how many palette indexes share a pixel."""
    return 0 if colors > 16 else 1 if colors > 4 else 2 if colors > 2 else 3


def cache_slot(argb: int, bits: int) -> int:
    return (HASH * argb & 0xFFFFFFFF) >> (32 - bits)


def prefix_code(bits: LsbBits, size: int) -> LsbCode:
    """A simple code of one or two symbols, or lengths coded by a code of their own."""
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        for symbol in [bits.read(8 if wide else 1), *([bits.read(8)] if two else [])]:
            if symbol >= size:
                raise DecodeError(f"symbol {symbol} of {size}", NAME, bits.position())
            lengths[symbol] = 1
        return LsbCode(lengths, "simple code", NAME, True)
    order = [0] * 19
    for i in ORDER[: 4 + bits.read(4)]:
        order[i] = bits.read(3)
    code = LsbCode(order, "code lengths", NAME, True)
    left, at, last = size, 0, 8
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
        if left > size:
            raise DecodeError("more code lengths than symbols", NAME, bits.position())
    while at < size and left:
        left -= 1
        symbol = code.read(bits)
        if symbol < 16:
            lengths[at] = symbol
            at, last = at + 1, symbol or last
            continue
        value, n = (last, 3 + bits.read(2)) if symbol == 16 else (0, 3 + bits.read(3)) if symbol == 17 else (0, 11 + bits.read(7))
        if at + n > size:
            raise DecodeError("a repeat beyond the last code length", NAME, bits.position())
        lengths[at : at + n] = [value] * n
        at += n
    return LsbCode(lengths, "prefix code", NAME, True)


class Stream:
    """A lossless bitstream and the images inside it."""

    def __init__(self, bits: LsbBits):
        self.bits, self.features, self.transforms = bits, Features(), []

    def value(self, symbol: int) -> int:
        """A length or distance code from its prefix symbol."""
        if symbol < 4:
            return symbol + 1
        extra = (symbol - 2) >> 1
        return ((2 + (symbol & 1)) << extra) + self.bits.read(extra) + 1

    def main(self, width: int, height: int) -> np.ndarray:
        seen, bits = set(), self.bits
        while bits.read(1):
            kind = bits.read(2)
            if kind in seen:
                raise DecodeError(f"a second {KINDS[kind]} transform", NAME, bits.position())
            seen.add(kind)
            t = Transform(kind, width=width)
            if kind < 2:
                t.bits = bits.read(3) + 2
                t.data = self.entropy_image(sub_size(width, t.bits), sub_size(height, t.bits))
                if kind == 0:
                    self.features.modes = sorted({*((t.data >> 8) & 15).ravel().tolist()})
            elif kind == 3:
                colors = bits.read(8) + 1
                raw = self.entropy_image(colors, 1)[0]
                t.bits = index_bits(colors)
                t.data = expand_map(raw, max(colors, 1 << (8 >> t.bits)))
                width = sub_size(width, t.bits)
            self.features.transforms.append(KINDS[kind])
            self.transforms.append(t)
        pixels = self.image(width, height, True)
        for t in reversed(self.transforms):
            pixels = INVERSE[t.kind](pixels, t)
        return pixels

    def entropy_image(self, width: int, height: int) -> np.ndarray:
        return self.image(width, height, False)

    def image(self, width: int, height: int, top: bool) -> np.ndarray:
        bits = self.bits
        cache_bits = bits.read(4) if bits.read(1) else 0
        if cache_bits > 11:
            raise DecodeError(f"a colour cache of {cache_bits} bits", NAME, bits.position())
        tiles, tile_bits, n = None, 0, 1
        if top and bits.read(1):
            tile_bits = bits.read(3) + 2
            tiles = (self.entropy_image(sub_size(width, tile_bits), sub_size(height, tile_bits)) >> 8) & 0xFFFF
            n = int(tiles.max()) + 1
        if top:
            self.features.cache_bits, self.features.groups = cache_bits, n
        cached = 1 << cache_bits if cache_bits else 0
        groups = [tuple(prefix_code(bits, size) for size in (280 + cached, 256, 256, 256, 40)) for _ in range(n)]
        return self.pixels(width, height, groups, tiles, tile_bits, cache_bits)

    def pixels(self, width: int, height: int, groups: list, tiles: np.ndarray | None, tile_bits: int, cache_bits: int) -> np.ndarray:
        bits, total, out = self.bits, width * height, []
        cache = [0] * (1 << cache_bits) if cache_bits else None
        rows = tiles.tolist() if tiles is not None else None
        # a code of one symbol takes no bits: a table of one entry
        tables = [[(c.table, (1 << c.bits) - 1) if c.only is None else ([c.only << 4], 0) for c in g[:4]] for g in groups]
        data, stop, entered, place, tile = bits.data, bits.end, 0, 0, None
        (green, green_mask), (red, red_mask), (blue, blue_mask), (alpha, alpha_mask) = tables[0]
        far = groups[0][4]
        held, count, at = bits.held, bits.count, bits.at
        while place < total:
            if rows:
                now = rows[place // width >> tile_bits][place % width >> tile_bits]
                if now != tile:
                    tile, far = now, groups[now][4]
                    (green, green_mask), (red, red_mask), (blue, blue_mask), (alpha, alpha_mask) = tables[now]
            if count < 64 and at < stop:  # four codes are 60 bits at most
                step = data[at : min(at + 8, stop)]
                held |= int.from_bytes(step, "little") << count
                at += len(step)
                count += 8 * len(step)
            entry = green[held & green_mask]
            held >>= entry & 15
            count -= entry & 15
            symbol = entry >> 4
            if symbol < 256:
                r = red[held & red_mask]
                held >>= r & 15
                b = blue[held & blue_mask]
                held >>= b & 15
                a = alpha[held & alpha_mask]
                held >>= a & 15
                count -= (r & 15) + (b & 15) + (a & 15)
                if count < 0:
                    raise DecodeError("the bit stream ends early", NAME, at)
                out.append((a >> 4) << 24 | (r >> 4) << 16 | symbol << 8 | b >> 4)
                place += 1
                continue
            if count < 0:
                raise DecodeError("the bit stream ends early", NAME, at)
            if symbol < 280:
                bits.held, bits.count, bits.at = held, count, at
                n = self.value(symbol - 256)
                back = distance(width, self.value(far.read(bits)))
                held, count, at = bits.held, bits.count, bits.at
                if back > place or place + n > total:
                    raise DecodeError("a copy from before or to behind the image", NAME, at)
                out += out[place - back : place - back + n] if back >= n else (out[place - back :] * (n // back + 1))[:n]
                place += n
            else:
                if cache is None or symbol - 280 >= len(cache):
                    raise DecodeError("a colour that isn't in the cache", NAME, at)
                for argb in out[entered:]:  # the cache is brought up to date only when it is asked
                    cache[cache_slot(argb, cache_bits)] = argb
                entered = place
                out.append(cache[symbol - 280])
                place += 1
        bits.held, bits.count, bits.at = held, count, at
        return np.array(out, np.int64).reshape(height, width)


def split(argb) -> np.ndarray:
    """ARGB words to channels in the last axis, A R G B."""
    return np.stack([(np.asarray(argb) >> s) & 255 for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def join(channels: np.ndarray) -> np.ndarray:
    c = channels & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def expand_map(raw: np.ndarray, size: int) -> np.ndarray:
    """Palette entries from their differences; what is beyond the last is transparent black."""
    out = np.zeros(size, np.int64)
    out[: len(raw)] = join(np.cumsum(split(raw), axis=0))
    return out


def predict(mode: int, left: np.ndarray, top: np.ndarray, top_left: np.ndarray, top_right: np.ndarray) -> np.ndarray:
    """A pixel's guess from its neighbours, channels in the last axis."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 1:
        return left
    if mode in (2, 3, 4):
        return (top, top_right, top_left)[mode - 2]
    if mode in (5, 6, 7):
        return (mean(mean(left, top_right), top), mean(left, top_left), mean(left, top))[mode - 5]
    if mode in (8, 9):
        return mean(top_left, top) if mode == 8 else mean(top, top_right)
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        # the sum of left and top less their corner is nearer to left if top differs less from the corner
        nearer_left = np.abs(top - top_left).sum(axis=-1) < np.abs(left - top_left).sum(axis=-1)
        return np.where(nearer_left[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        m = mean(left, top)
        d = m - top_left
        return np.clip(m + np.sign(d) * (np.abs(d) >> 1), 0, 255)
    return np.broadcast_to(np.array([255, 0, 0, 0]), left.shape)


def undo_predictor(pixels: np.ndarray, t: Transform) -> np.ndarray:
    """Adds the guesses. A pixel needs its left and the row above up to the right, so pixels with equal x + 2y are done at once."""
    h, w = pixels.shape
    rest, out = split(pixels), np.zeros((h, w, 4), np.int64)
    modes = (t.data >> 8) & 15
    out[0] = np.cumsum(rest[0], axis=0)
    out[0] += np.array([255, 0, 0, 0])
    out[0] &= 255
    if h > 1:
        out[1:, 0] = (np.cumsum(rest[1:, 0], axis=0) + out[0, 0]) & 255
    for d in range(3, w + 2 * h - 2):
        y = np.arange(max(1, (d - w + 2) // 2), min(h, (d - 1) // 2 + 1))
        x = d - 2 * y
        y, x = y[(x > 0) & (x < w)], x[(x > 0) & (x < w)]
        if not y.size:
            continue
        left, top, top_left = out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]
        # right of the last column stands the row's own first pixel
        last = x == w - 1
        top_right = out[np.where(last, y, y - 1), np.where(last, 0, x + 1)]
        mode, guess = modes[y >> t.bits, x >> t.bits], np.empty_like(left)
        for m in np.unique(mode):
            k = mode == m
            guess[k] = predict(int(m), left[k], top[k], top_left[k], top_right[k])
        out[y, x] = (rest[y, x] + guess) & 255
    return join(out)


def undo_cross_color(pixels: np.ndarray, t: Transform) -> np.ndarray:
    """Adds to red and blue what green, and to blue what the new red, foretells; factors are signed with 5 bits of fraction."""
    h, w = pixels.shape
    tile = t.data[np.arange(h)[:, None] >> t.bits, np.arange(w)[None, :] >> t.bits]
    signed = lambda v: (v & 255) - ((v & 128) << 1)
    c = split(pixels)
    green = signed(c[..., 2])
    red = (c[..., 1] + (signed(tile) * green >> 5)) & 255
    blue = c[..., 3] + (signed(tile >> 8) * green >> 5) + (signed(tile >> 16) * signed(red) >> 5)
    return join(np.stack([c[..., 0], red, c[..., 2], blue], axis=-1))


def undo_subtract_green(pixels: np.ndarray, t: Transform) -> np.ndarray:
    c = split(pixels)
    c[..., 1] += c[..., 2]
    c[..., 3] += c[..., 2]
    return join(c)


def undo_color_index(pixels: np.ndarray, t: Transform) -> np.ndarray:
    green = (pixels >> 8) & 255
    per, n = 1 << t.bits, 8 >> t.bits
    index = ((green[:, :, None] >> (np.arange(per) * n)) & ((1 << n) - 1)).reshape(len(pixels), -1)[:, : t.width]
    return np.where(index < len(t.data), t.data[np.minimum(index, len(t.data) - 1)], 0)


INVERSE = (undo_predictor, undo_cross_color, undo_subtract_green, undo_color_index)


def lossless_header(data: bytes) -> tuple[LsbBits, int, int, bool]:
    bits = LsbBits(data, format=NAME)
    if bits.read(8) != 0x2F:
        raise DecodeError("no lossless signature", NAME)
    width, height, alpha = bits.read(14) + 1, bits.read(14) + 1, bool(bits.read(1))
    if bits.read(3):
        raise DecodeError("lossless version", NAME)
    check_size(width, height, NAME)
    return bits, width, height, alpha


def decode_raw(data: bytes, width: int, height: int) -> np.ndarray:
    """ARGB words of a lossless stream without its header."""
    return Stream(LsbBits(data, format=NAME)).main(width, height)


def decode(data: bytes) -> Image:
    canvas, picture, flags = None, None, []
    for c in chunks(data):
        if c.tag == "VP8X" and canvas is None:
            if c.length < 10:
                raise DecodeError("extended header is cut off", NAME, c.offset)
            canvas = tuple(int.from_bytes(c.data[i : i + 3], "little") + 1 for i in (4, 7))
            flags = [name for name, bit in FLAGS.items() if c.data[0] & bit]
        elif c.tag == "VP8L" and (picture is None or picture.tag != "VP8L") or c.tag == "VP8 " and picture is None:
            picture = c
    if "animation" in flags:
        raise unsupported("animation", NAME)
    if picture is None:
        raise DecodeError("no image chunk", NAME, len(data))
    if picture.tag != "VP8L":
        raise unsupported("lossy image data", NAME, picture.offset)
    bits, width, height, alpha = lossless_header(picture.data)
    if canvas is not None and canvas != (width, height):
        raise DecodeError(f"canvas {canvas[0]} x {canvas[1]} and image {width} x {height} differ", NAME, picture.offset)
    stream = Stream(bits)
    argb = split(stream.main(width, height))
    f = stream.features
    extra = {"transforms": " ".join(f.transforms) or "none", "cache bits": str(f.cache_bits), "groups": str(f.groups), "predictor modes": " ".join(map(str, f.modes)), "alpha hint": str(alpha).lower(), "flags": " ".join(flags)}
    return Image(argb[..., [1, 2, 3, 0]].astype(np.uint8), NAME, "VP8X" if canvas else "VP8L", 8, 4, compression="VP8L", extra=extra)
