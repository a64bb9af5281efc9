"""Deflate and zlib streams, with counts of what they are made of."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

from .model import DecodeError, LsbBits, LsbCode, unsupported

#: Bytes that a stream may grow to if its reader names no limit.
DEFAULT_LIMIT = 256 << 20
# The order in which the lengths of the code-length code are stored.
LENGTH_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)


def _bases(first: int, groups: tuple[tuple[int, int], ...]) -> list[tuple[int, int]]:
    """(base, extra bits) from how many codes have each number of extra bits."""
    out = []
    for extra, n in groups:
        for _ in range(n):
            out.append((first, extra))
            first += 1 << extra
    return out


#: Lengths from 3: eight codes without extra bits, then four of each number of them; the last stands for 258 alone.
LENGTHS = _bases(3, ((0, 8), (1, 4), (2, 4), (3, 4), (4, 4), (5, 4)))[:28] + [(258, 0)]
#: Distances from 1: four codes without extra bits, then two of each number of them.
DISTANCES = _bases(1, ((0, 4), *((k, 2) for k in range(1, 14))))


@dataclass
class Inflated:
    """A stream's bytes and what it was made of."""

    data: bytes
    stored: int = 0
    fixed: int = 0
    dynamic: int = 0
    literals: int = 0
    matches: int = 0
    consumed: int = 0

    @property
    def blocks(self) -> str:
        return " + ".join(f"{name} x {n}" for name, n in (("stored", self.stored), ("fixed", self.fixed), ("dynamic", self.dynamic)) if n)


@lru_cache(maxsize=1)
def _fixed() -> tuple[LsbCode, LsbCode]:
    return LsbCode([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8, "fixed lengths", "deflate"), LsbCode([5] * 32, "fixed distances", "deflate")


def repeated_lengths(read, total: int, format: str) -> list[int]:
    """Code lengths in which 16 repeats the last one and 17 and 18 stand for zeros. ``read(n)`` gives a symbol for None and n bits else."""
    out: list[int] = []
    while len(out) < total:
        symbol = read(None)
        if symbol < 16:
            out.append(symbol)
            continue
        if symbol == 16 and not out:
            raise DecodeError("a repeat before the first length", format)
        value, n = (out[-1], 3 + read(2)) if symbol == 16 else (0, 3 + read(3)) if symbol == 17 else (0, 11 + read(7))
        if len(out) + n > total:
            raise DecodeError("a repeat beyond the last length", format)
        out += [value] * n
    return out


def _dynamic(bits: LsbBits, format: str) -> tuple[LsbCode, LsbCode]:
    n_literal, n_distance, n_order = bits.read(5) + 257, bits.read(5) + 1, bits.read(4) + 4
    if n_literal > 286 or n_distance > 30:
        raise DecodeError("too many codes in a dynamic block", format, bits.position())
    order = [0] * 19
    for i in LENGTH_ORDER[:n_order]:
        order[i] = bits.read(3)
    code = LsbCode(order, "code lengths", format)
    lengths = repeated_lengths(lambda n: code.read(bits) if n is None else bits.read(n), n_literal + n_distance, format)
    if not lengths[256]:
        raise DecodeError("a dynamic block without an end", format, bits.position())
    return LsbCode(lengths[:n_literal], "literals", format), LsbCode(lengths[n_literal:], "distances", format)


def inflate(data: bytes, start: int = 0, limit: int = DEFAULT_LIMIT, format: str = "deflate", end: int | None = None) -> Inflated:
    """A raw deflate stream. Output beyond ``limit`` is refused before it is written."""
    bits, out, found = LsbBits(data, start, end, format), bytearray(), Inflated(b"")

    def room(n: int) -> None:
        if len(out) + n > limit:
            raise DecodeError(f"the stream holds more than {limit} bytes", format, bits.position())

    last = 0
    while not last:
        last, kind = bits.read(1), bits.read(2)
        if kind == 0:
            bits.align()
            n, inverse = bits.read(16), bits.read(16)
            if n != inverse ^ 0xFFFF:
                raise DecodeError("the length of a stored block and its complement differ", format, bits.position())
            room(n)
            out += bits.aligned_bytes(n)
            found.stored += 1
            continue
        if kind == 3:
            raise DecodeError("reserved block type", format, bits.position())
        literal, distance = _fixed() if kind == 1 else _dynamic(bits, format)
        found.fixed += kind == 1
        found.dynamic += kind == 2
        # 48 bits hold the longest length and distance with their extra bits, so one refill a symbol is enough
        table, mask, far, far_mask = literal.table, (1 << literal.bits) - 1, distance.table, (1 << distance.bits) - 1
        held, count, at, stop, literals, matches = bits.held, bits.count, bits.at, bits.end, 0, 0
        while True:
            if count < 48 and at < stop:
                step = data[at : min(at + 6, stop)]
                held |= int.from_bytes(step, "little") << count
                at += len(step)
                count += 8 * len(step)
            entry = table[held & mask]
            n = entry & 15
            held >>= n
            count -= n
            symbol = entry >> 4
            if count < 0 or not n:
                bits.at = at
                raise DecodeError("the bit stream ends early" if n else "literals: no such code", format, at)
            if symbol < 256:
                if len(out) >= limit:
                    room(1)
                out.append(symbol)
                literals += 1
                continue
            if symbol == 256:
                break
            if symbol > 285:
                raise DecodeError(f"length code {symbol}", format, at)
            length, extra = LENGTHS[symbol - 257]
            if extra:
                length += held & ((1 << extra) - 1)
                held >>= extra
                count -= extra
            entry = far[held & far_mask]
            n = entry & 15
            held >>= n
            count -= n
            if not n or entry >> 4 > 29:
                raise DecodeError("distances: no such code", format, at)
            back, extra = DISTANCES[entry >> 4]
            if extra:
                back += held & ((1 << extra) - 1)
                held >>= extra
                count -= extra
            if count < 0:
                raise DecodeError("the bit stream ends early", format, at)
            had = len(out)
            if back > had:
                raise DecodeError(f"a match {back} bytes back with {had} before it", format, at)
            if had + length > limit:
                room(length)
            # where source and copy overlap the source repeats
            out += out[had - back : had - back + length] if back >= length else (out[had - back :] * (length // back + 1))[:length]
            matches += 1
        bits.held, bits.count, bits.at = held, count, at
        found.literals += literals
        found.matches += matches
    bits.align()
    found.data, found.consumed = bytes(out), bits.position() - start
    return found


def adler32(data: bytes) -> int:
    return zlib.adler32(data)


def _uncounted(data: bytes, start: int, limit: int) -> Inflated | None:
    """A sound zlib stream's data by the standard library; None where something is wrong with it, which the walk below can name."""
    run = zlib.decompressobj()
    try:
        out = run.decompress(memoryview(data)[start:], limit + 1)
    except zlib.error:
        return None
    return Inflated(out, consumed=len(data) - start - len(run.unused_data)) if run.eof and len(out) <= limit else None


def inflate_zlib(data: bytes, start: int = 0, limit: int = DEFAULT_LIMIT, format: str = "zlib", counted: bool = True) -> Inflated:
    """A zlib stream: header, deflate stream and checksum. Blocks and symbols are only counted where ``counted`` asks for it, which takes a walk over all of them."""
    if len(data) - start < 6:
        raise DecodeError("a zlib stream of fewer than 6 bytes", format, start)
    method, flags = data[start], data[start + 1]
    if method & 15 != 8 or method >> 4 > 7:
        raise DecodeError(f"zlib method {method:#04x}", format, start)
    if (method << 8 | flags) % 31:
        raise DecodeError("the zlib header's check fails", format, start)
    if flags & 32:
        raise unsupported("zlib stream with a preset dictionary", format, start)
    if not counted and (quick := _uncounted(data, start, limit)) is not None:
        return quick
    found = inflate(data, start + 2, limit, format)
    at = start + 2 + found.consumed
    if at + 4 > len(data):
        raise DecodeError("the zlib checksum is missing", format, at)
    if int.from_bytes(data[at : at + 4], "big") != adler32(found.data):
        raise DecodeError("the zlib checksum differs", format, at)
    found.consumed += 6
    return found
