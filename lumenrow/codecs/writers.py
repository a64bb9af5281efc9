"""Minimal encoders, for fixtures and round trips."""

import struct
import zlib

import numpy as np


class BitWriter:
    """Bits, highest or lowest of each byte first."""

    def __init__(self, msb):
        self.msb, self.bits = msb, []

    def put(self, value, n):
        if n:
            digits = f"{int(value):0{n}b}"
            self.bits.append(digits if self.msb else digits[::-1])

    def bytes(self, fill=0):
        bits = "".join(self.bits)
        bits += str(fill) * (-len(bits) % 8)
        packed = np.frombuffer(bits.encode(), np.uint8) - 48
        return np.packbits(packed, bitorder="big" if self.msb else "little").tobytes()


def png_chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(width, height, depth, color, rows, extra=(), interlace=0, level=6):
    """rows: filter byte and bytes of each row, already filtered."""
    body = zlib.compress(b"".join(rows), level)
    half = len(body) // 2
    return b"\x89PNG\r\n\x1a\n" + png_chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, interlace)) + b"".join(png_chunk(k, d) for k, d in extra) + png_chunk(b"IDAT", body[:half]) + png_chunk(b"IDAT", body[half:]) + png_chunk(b"IEND", b"")


def filtered(rows, lanes, kinds):
    """Each row with its filter's byte. A writer knows all neighbours, so every row is done at once."""
    v = np.asarray(rows, np.int16)
    up = np.vstack([np.zeros_like(v[:1]), v[:-1]])
    left, corner = (np.hstack([np.zeros((len(v), lanes), np.int16), p])[:, : v.shape[1]] for p in (v, up))
    p = left + up - corner
    pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
    paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
    kinds = np.asarray(kinds)[:, None]
    guess = np.select([kinds == k for k in (1, 2, 3, 4)], [left, up, (left + up) >> 1, paeth], 0)
    return [bytes(r) for r in np.hstack([kinds, (v - guess) % 256]).astype(np.uint8)]


def bmp(width, height, bpp, body, compression=0, palette=b"", masks=b"", used=0):
    offset = 54 + len(masks) + len(palette)
    return b"BM" + struct.pack("<IHHI", offset + len(body), 0, 0, offset) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bpp, compression, len(body), 2835, 2835, used, 0) + masks + palette + body


def segment(marker, body):
    return bytes([255, marker]) + struct.pack(">H", len(body) + 2) + body


#: A code of eight bits for each symbol 0..253.
FLAT = bytes([0] * 7 + [254] + [0] * 8) + bytes(range(254))


#: Places of what is put for a block: at k its coefficients, behind them the end mark, then the bits that end an interval.
_PLACES, _END, _FILL = 1 << 16, 64 << 8, 65 << 8


def _firsts(x):
    """Where a value stands that isn't the one before."""
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])


def packed(values, sizes):
    """Bytes of values of up to 32 bits each, highest bits first; the sizes make whole bytes."""
    at = np.cumsum(sizes) - sizes
    word, moved = at >> 5, values.astype(np.uint64) << (64 - (at & 31) - sizes).astype(np.uint64)
    first = _firsts(word)
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    # a word holds its values' upper halves and the lower halves of those that began in the word before
    out[word[first]] |= np.bitwise_or.reduceat(moved >> np.uint64(32), first)
    out[word[first] + 1] |= np.bitwise_or.reduceat(moved & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[: int(at[-1] + sizes[-1]) >> 3]


def _sized(symbols, v):
    """Values and sizes of symbols of eight bits, whose low half is to be the magnitude's size, with the magnitudes behind them."""
    n = np.frexp(np.abs(v).astype(float))[1].astype(np.int64)
    return (symbols | n) << n | np.where(v >= 0, v, v + (1 << n) - 1), n + 8


def _dc(coefs, parts, interval, low):
    """Differences of each part's values, from 0 on in every interval."""
    v, difference = coefs[:, 0] >> low, np.zeros(len(coefs), np.int64)
    for i in {*parts[: parts.argmax() + 1].tolist()}:
        own = np.flatnonzero(parts == i)
        before = np.concatenate([[0], v[own][:-1]])
        before[_firsts(interval[own])] = 0
        difference[own] = v[own] - before
    return [(np.arange(len(v)) * _PLACES, *_sized(0, difference))]


def _gaps(r, n, before):
    """How much n grew since the last of the same row, or since ``before``."""
    if not len(r):
        return n
    last = np.concatenate([[before], n[:-1]])
    last[_firsts(r)] = before
    return n - last


def _ends(r, k, rows, start, end):
    last = np.full(rows, start - 1)
    last[r] = k
    return np.flatnonzero(last < end)


def _cells(there):
    """Rows and columns of what is true."""
    return np.divmod(np.flatnonzero(there), there.shape[1])


def _ac(coefs, start, end, low):
    v = coefs[:, start : end + 1]
    if low:
        v = np.sign(v) * (np.abs(v) >> low)
    r, c = _cells(v != 0)
    gap = _gaps(r, c, -1) - 1
    far, ends = np.flatnonzero(gap > 15), _ends(r, c + start, len(v), start, end)
    at = r * _PLACES + (c + start << 8)
    skipped = gap[far] >> 4
    return [
        (at + 1, *_sized((gap & 15) << 4, v[r, c])),
        (at[far], 0xF0F0F0 >> (24 - 8 * skipped), 8 * skipped),
        (ends * _PLACES + _END, np.zeros_like(ends), np.full_like(ends, 8)),
    ]


def _ac_refine(coefs, start, end, low):
    """Without runs over blocks: each block ends with its own end mark. Behind each mark stand the bits of the values passed on the way to it."""
    band = np.abs(coefs[:, start : end + 1]) >> low
    r, c = _cells(band == 1)
    zeros = band == 0
    gap = _gaps(r, np.cumsum(zeros, axis=1, dtype=np.int8)[r, c].astype(np.int64), 0) if len(r) else r
    ends = _ends(r, c + start, len(band), start, end)
    # marks for sixteen zeros stand at the sixteenth, counted from the last new value
    far = np.repeat(np.arange(len(r)), gap >> 4)
    zr, zc = _cells(zeros) if len(far) else (r, c)
    nth = np.arange(len(far)) - np.searchsorted(far, far) + 1
    behind = np.searchsorted(zr * 64 + zc, r[far] * 64 + c[far]) - gap[far] + 16 * nth - 1
    marks = np.concatenate([r * _PLACES + (c + start << 8), r[far] * _PLACES + (zc[behind] + start << 8), ends * _PLACES + _END])
    values = np.concatenate([((gap & 15) << 4 | 1) << 1 | (coefs[r, c + start] > 0), np.full(len(far), 0xF0), np.zeros(len(ends), int)])
    sizes = np.concatenate([np.full(len(r), 9), np.full(len(far) + len(ends), 8)])
    hr, hc = _cells(band > 1)
    known = np.sort(marks)
    mark = known[np.searchsorted(known, hr * _PLACES + (hc + start << 8))]
    return [(marks, values, sizes), (mark + 1 + hc, band[hr, hc] & 1, np.ones_like(hr))]


def jpeg(width, height, parts, tables, interval=0, progressive=False, extra=b""):
    """parts: (id, h, v, table, coefs by padded block); coefs are in stored order."""
    return jpegs([(width, height, parts)], tables, interval, progressive, extra)[0]


def jpegs(images, tables, interval=0, progressive=False, extra=b""):
    """Files of images (width, height, parts) whose parts differ in their coefficients alone; all are coded at once. ``interval`` may be a list, one for each."""
    shape = [p[:4] for p in images[0][2]]
    mh, mv = max(p[1] for p in shape), max(p[2] for p in shape)
    units = [(-(-width // (8 * mh)), -(-height // (8 * mv))) for width, height, _ in images]
    before = b"\xff\xd8" + extra + b"".join(segment(0xDB, bytes([i]) + bytes(t)) for i, t in enumerate(tables))
    behind = segment(0xC4, b"\x00" + FLAT) + segment(0xC4, b"\x10" + FLAT)
    steps = interval if isinstance(interval, list) else [interval] * len(images)
    frame = b"".join(bytes([i, h << 4 | v, t]) for i, h, v, t in shape)
    files = [[before, segment(0xC2 if progressive else 0xC0, struct.pack(">BHHB", 8, height, width, len(shape)) + frame), behind + (segment(0xDD, struct.pack(">H", step)) if step else b"")] for (width, height, _), step in zip(images, steps, strict=True)]

    def every():
        """Coefficients in the order of the units, each block's part, blocks of a unit, and blocks of each image."""
        of_unit = np.repeat(np.arange(len(shape)), [p[1] * p[2] for p in shape])
        coefs = []
        for (_, _, parts), (mw, mhh) in zip(images, units, strict=True):
            blocks = [np.asarray(p[4]).reshape(mhh, p[2], mw, p[1], 64).swapaxes(1, 2).reshape(mhh * mw, -1, 64) for p in parts]
            coefs.append(np.concatenate(blocks, axis=1).reshape(-1, 64))
        counts = [len(c) for c in coefs]
        return np.concatenate(coefs), np.tile(of_unit, sum(counts) // len(of_unit)), len(of_unit), counts

    def own(i):
        _, h, v, _ = shape[i]
        coefs = []
        for (width, height, parts), (mw, _) in zip(images, units, strict=True):
            bw, bh = -(-(-(-width * h // mh)) // 8), -(-(-(-height * v // mv)) // 8)
            coefs.append(np.asarray(parts[i][4]).reshape(-1, mw * h, 64)[:bh, :bw].reshape(-1, 64))
        counts = [len(c) for c in coefs]
        return np.concatenate(coefs), np.full(sum(counts), i), 1, counts

    def scan(which, start, end, high, low, blocks, put):
        coefs, part, size, counts = blocks
        runs = [size * step or n for step, n in zip(steps, counts, strict=True)]
        intervals = [-(-n // run) for n, run in zip(counts, runs, strict=True)]
        bounds = np.cumsum([0, *intervals]).tolist()
        held = np.concatenate([first + np.arange(n) // run for first, n, run in zip(bounds, counts, runs, strict=False)])
        at, values, sizes = (np.concatenate(x) for x in zip(*put(coefs, part, held), strict=True))
        bits = np.bincount(held[at // _PLACES], sizes).astype(np.int64)
        rest = -bits % 8
        # ones fill each interval's last byte
        at = np.concatenate([at, (np.append(_firsts(held)[1:], len(held)) - 1) * _PLACES + _FILL])
        order = np.argsort(at, kind="stable")
        body = packed(np.concatenate([values, (1 << rest) - 1])[order], np.concatenate([sizes, rest])[order])
        last = [0, *(np.cumsum(bits + rest) >> 3).tolist()]
        head = segment(0xDA, bytes([len(which)]) + b"".join(bytes([shape[i][0], 0]) for i in which) + bytes([start, end, high << 4 | low]))
        for file, a, b in zip(files, bounds, bounds[1:], strict=False):
            pieces = [body[last[k] : last[k + 1]].replace(b"\xff", b"\xff\0") + bytes([255, 0xD0 + (k - a) % 8]) for k in range(a, b)]
            file += [head, *pieces[:-1], pieces[-1][:-2]]

    all_ = [*range(len(shape))]
    first = every() if len(shape) > 1 else own(0)
    if not progressive:
        scan(all_, 0, 63, 0, 0, first, lambda c, p, held: _dc(c, p, held, 0) + _ac(c, 1, 63, 0))
    else:
        scan(all_, 0, 0, 0, 1, first, lambda c, p, held: _dc(c, p, held, 1))
        scan(all_, 0, 0, 1, 0, first, lambda c, p, held: [(np.arange(len(c)) * _PLACES, c[:, 0] & 1, np.ones(len(c), int))])
        for i in all_:
            mine = own(i)
            scan([i], 1, 5, 0, 1, mine, lambda c, p, held: _ac(c, 1, 5, 1))
            scan([i], 6, 63, 0, 1, mine, lambda c, p, held: _ac(c, 6, 63, 1))
            scan([i], 1, 63, 1, 0, mine, lambda c, p, held: _ac_refine(c, 1, 63, 0))
    return [b"".join([*file, b"\xff\xd9"]) for file in files]


def webp(payload, tag=b"VP8L", before=b""):
    body = b"WEBP" + before + tag + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _flat_code(w, size):
    """Lengths of 8 for the first 256 symbols of an alphabet."""
    w.put(0, 1)
    w.put(12 - 4, 4)  # lengths of codes 17 18 0 1 2 3 4 5 16 6 7 8
    for i in range(12):
        w.put(1 if i in (2, 11) else 0, 3)  # symbols 0 and 8 have one bit each
    w.put(0, 1)
    for i in range(size):
        w.put(1 if i < 256 else 0, 1)


def _single(w, symbol):
    w.put(1, 1)
    w.put(0, 1)
    w.put(1, 1)
    w.put(symbol, 8)


def _put_pixels(w, argb):
    """Five codes and literal pixels: eight bits, lowest of the code's reversed bits first."""
    for size in (280, 256, 256, 256):
        _flat_code(w, size)
    _single(w, 0)
    # codes stand in the stream from their highest bit on, so a pixel is the bits of its G, R, B and A
    parts = np.stack([argb.ravel() >> shift & 255 for shift in (8, 16, 0, 24)], axis=1).astype(np.uint8)
    w.bits.append((np.unpackbits(parts.ravel()) + 48).tobytes().decode())


def vp8l(argb, transforms=()):
    """transforms: (kind, bits or colours, image of words); the last named is the first undone."""
    h, wd = argb.shape
    w = BitWriter(False)
    w.put(0x2F, 8)
    w.put((transforms[0][3] if transforms and len(transforms[0]) > 3 else wd) - 1, 14)
    w.put(h - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    for kind, number, image, *_ in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind in (0, 1):
            w.put(number - 2, 3)
        if kind == 3:
            w.put(number - 1, 8)
        if kind != 2:
            w.put(0, 1)
            _put_pixels(w, image)
    w.put(0, 1)
    w.put(0, 1)  # no colour cache
    w.put(0, 1)  # one group
    _put_pixels(w, argb)
    return w.bytes()
