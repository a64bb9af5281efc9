"""Lossless WebP streams with copies, a colour cache and several groups, written here symbol by symbol."""

import numpy as np
import pytest

from lumenrow.codecs import model, webp
from lumenrow.codecs.writers import BitWriter
from lumenrow.codecs.writers import webp as container

CACHE = 4
#: Complete codes: half the space for literals, the rest for lengths and cache entries.
GREEN = [9] * 256 + [6] * 24 + [7] * (1 << CACHE)
PLAIN, FAR = [8] * 256, [5] * 24 + [6] * 16


def put_symbol(w, lengths, symbol):
    code, n = next((c, n) for s, c, n in model.canonical_codes(lengths) if s == symbol)
    w.put(int(f"{code:0{n}b}"[::-1], 2), n)


def put_lengths(w, lengths):
    """Each length by a code of three bits for eight of the lengths."""
    of_lengths = [3 if n in (0, 1, 2, 5, 6, 7, 8, 9) else 0 for n in range(19)]
    w.put(0, 1)
    w.put(15, 4)
    for n in webp.ORDER:
        w.put(of_lengths[n], 3)
    w.put(0, 1)
    for n in lengths:
        put_symbol(w, of_lengths, n)


def put_value(w, lengths, first, value):
    """A length or distance code: its prefix symbol and extra bits."""
    off = value - 1
    if off < 4:
        put_symbol(w, lengths, first + off)
        return
    k = off.bit_length() - 1
    put_symbol(w, lengths, first + 2 * k + (off >> (k - 1) & 1))
    w.put(off & ((1 << (k - 1)) - 1), k - 1)


def put_literal(w, argb, green=GREEN):
    for lengths, shift in ((green, 8), (PLAIN, 16), (PLAIN, 0), (PLAIN, 24)):
        put_symbol(w, lengths, argb >> shift & 255)


def stream(width, height, tokens, groups=None):
    """tokens: ("pixel", argb), ("copy", length, distance code) or ("cache", slot)."""
    w = BitWriter(False)
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    w.put(0, 1)
    w.put(1, 1)
    w.put(CACHE, 4)
    if groups is None:
        w.put(0, 1)
    else:
        w.put(1, 1)
        w.put(0, 3)
        w.put(0, 1)
        for lengths in ([8] * 256 + [0] * 24, PLAIN, PLAIN, PLAIN, FAR):
            put_lengths(w, lengths)
        for g in groups.ravel().tolist():
            put_literal(w, g << 8, [8] * 256 + [0] * 24)
    for _ in range(1 if groups is None else int(groups.max()) + 1):
        for lengths in (GREEN, PLAIN, PLAIN, PLAIN, FAR):
            put_lengths(w, lengths)
    for kind, *args in tokens:
        if kind == "pixel":
            put_literal(w, args[0])
        elif kind == "copy":
            put_value(w, GREEN, 256, args[0])
            put_value(w, FAR, 0, args[1])
        else:
            put_symbol(w, GREEN, 280 + args[0])
    return w.bytes()


def by_hand(width, tokens):
    out, cache = [], [0] * (1 << CACHE)
    for kind, *args in tokens:
        if kind == "copy":
            back = webp.distance(width, args[1])
            new = []
            for _ in range(args[0]):
                new.append((out + new)[len(out) + len(new) - back])
        else:
            new = [args[0] if kind == "pixel" else cache[args[0]]]
        for p in new:
            out.append(p)
            cache[webp.cache_slot(p, CACHE)] = p
    return out


@pytest.mark.parametrize("grouped", [False, True])
@pytest.mark.parametrize("seed", range(6))
def test_copies_and_cache(seed, grouped):
    rng = np.random.default_rng(seed)
    width, height, tokens, n = 9, 12, [], 0
    while n < width * height:
        kind = rng.choice(["pixel", "copy", "cache"]) if n > 2 * width + 9 else "pixel"
        if kind == "copy":
            length = int(rng.integers(1, min(40, width * height - n) + 1))
            code = int(rng.integers(1, 141))
            if webp.distance(width, code) > n:
                continue
            tokens.append(("copy", length, code))
            n += length
        elif kind == "cache":
            tokens.append(("cache", int(rng.integers(0, 1 << CACHE))))
            n += 1
        else:
            tokens.append(("pixel", int(rng.integers(0, 1 << 32))))
            n += 1
    groups = rng.integers(0, 2, (3, 3)) if grouped else None
    image = webp.decode(container(stream(width, height, tokens, groups)))
    p = image.pixels.astype(np.int64).reshape(-1, 4)
    assert (p[:, 3] << 24 | p[:, 0] << 16 | p[:, 1] << 8 | p[:, 2]).tolist() == by_hand(width, tokens)
    assert image.extra["cache bits"] == str(CACHE) and image.extra["groups"] == (str(int(groups.max()) + 1) if grouped else "1")


def test_copies_out_of_bounds():
    for tokens in ([("pixel", 1), ("copy", 2, 125)], [("pixel", 1), ("copy", 9, 121)]):
        with pytest.raises(model.DecodeError):
            webp.decode(container(stream(2, 2, tokens)))
