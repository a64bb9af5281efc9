"""Column expressions over samples and pixels, exact in integers unless they say otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..codecs import jpeg, webp, yuv

_255 = 255


def div(a: Column, b: Column | int) -> Column:
    """Whole-number division towards zero of non-negative numbers."""
    return F.call_function("div", a.cast("long"), (F.lit(b) if isinstance(b, int) else b).cast("long"))


def clamp(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0)), F.lit(_255))


def mask_channel(word: Column, mask: int) -> Column:
    """A channel of a pixel word as 0..255; 255 without a mask."""
    if not mask:
        return F.lit(_255)
    shift = (mask & -mask).bit_length() - 1
    top = mask >> shift
    v = F.shiftright(word.cast("long"), shift).bitwiseAND(F.lit(top))
    return v if top == _255 else div(v * _255 + top // 2, top)


def maxval_scale(v: Column, maxval: Column) -> Column:
    """A sample of 0..maxval to 0..255, rounded; what is above counts as maxval."""
    return F.call_function("div", (F.least(v, maxval) * 255 + F.call_function("div", maxval, F.lit(2))).cast("long"), maxval.cast("long"))


def depth_scale(v: Column, depth: int) -> Column:
    """A raw sample of 1, 2, 4, 8 or 16 bits to 0..255."""
    return div(v * 255 + 32767, 65535) if depth == 16 else v * (255 // ((1 << depth) - 1))


def paeth(a: Column, b: Column, c: Column) -> Column:
    """Whichever of left, up and upper left is nearest to left + up - upper left; ties in that order."""
    pa, pb, pc = F.abs(b - c), F.abs(a - c), F.abs(a + b - 2 * c)
    return F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)


def yuv_rgb(y: Column, u: Column, v: Column, matrix: str, range: str) -> tuple[Column, Column, Column]:
    """Red, green and blue by doubles, rounded half away from zero."""
    c = yuv.coefficients(matrix, range)
    luma = (y - c["offset"]) * F.lit(c["y"])
    near = lambda x: clamp(F.round(x)).cast("long")
    return near(luma + F.lit(c["rv"]) * (v - 128)), near(luma - F.lit(c["gu"]) * (u - 128) - F.lit(c["gv"]) * (v - 128)), near(luma + F.lit(c["bu"]) * (u - 128))


def ycc_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """JPEG's colours in 16-bit fixed point."""
    cb, cr, half = cb.cast("long") - 128, cr.cast("long") - 128, 1 << 15
    return clamp(y + F.shiftright(cr * jpeg.CR_R + half, 16)), clamp(y + F.shiftright(cb * jpeg.CB_G + cr * jpeg.CR_G + half, 16)), clamp(y + F.shiftright(cb * jpeg.CB_B + half, 16))


def cmyk_rgb(c: Column, m: Column, y: Column, k: Column, inverted: bool) -> tuple[Column, Column, Column]:
    """Four inks to colours; ``inverted``: 255 stands for no ink, as with an Adobe marker."""
    c, m, y, k = (x if inverted else 255 - x for x in (c, m, y, k))
    return div(c * k, 255), div(m * k, 255), div(y * k, 255)


def idct_pass(inputs: Column, rounding: int, shift: int) -> Column:
    """One pass of the integer inverse transform: array of eight outputs from an array of eight bounded inputs."""
    out = []
    for row in jpeg.TRANSFORM.tolist():
        total = F.lit(rounding).cast("long")
        for j, weight in enumerate(row):
            total = total + F.get(inputs, F.lit(j)) * weight
        out.append(F.shiftright(total, shift))
    return F.array(*out)


def idct_block(coef: Column) -> Column:
    """Samples 0..255 of a block of 64 dequantised coefficients, both arrays in natural order.

    What is used more than once is handed on as a lambda's argument, so that it
    is worked out once.
    """
    line = F.sequence(F.lit(0), F.lit(7))
    bounded = lambda v: F.least(F.greatest(v.cast("long"), F.lit(-32767)), F.lit(32767))
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    columns = once(coef, lambda b: F.transform(line, lambda c: F.transform(line, lambda r: bounded(F.get(b, c + r * 8)))))
    first = F.transform(columns, lambda v: idct_pass(v, 1 << 9, 10))
    rows = once(first, lambda w: F.transform(line, lambda r: F.transform(line, lambda c: bounded(F.get(F.get(w, c), r)))))
    samples = F.transform(rows, lambda v: idct_pass(v, (1 << 16) + (128 << 17), 17))
    return F.transform(F.flatten(samples), clamp)


def orient(x: Column, y: Column, width: Column, height: Column, orientation: int) -> tuple[Column, Column]:
    """Where a stored pixel is shown."""
    swap, flip_x, flip_y = jpeg.ORIENTATIONS[orientation]
    if swap:
        x, y, width, height = y, x, height, width
    return (width - 1 - x if flip_x else x), (height - 1 - y if flip_y else y)


def channels(argb: Column) -> tuple[Column, ...]:
    """A, R, G and B of an ARGB word."""
    return tuple(F.shiftright(argb, s).bitwiseAND(F.lit(255)) for s in (24, 16, 8, 0))


def pack(a: Column, r: Column, g: Column, b: Column) -> Column:
    return (F.pmod(a, F.lit(256)) * (1 << 24) + F.pmod(r, F.lit(256)) * (1 << 16) + F.pmod(g, F.lit(256)) * (1 << 8) + F.pmod(b, F.lit(256))).cast("long")


def mul32(a: Column, b: int) -> Column:
    """The product's lower 32 bits; b is below 2^31."""
    return F.pmod(a.cast("long") * b, F.lit(1 << 32))


def cache_slot(argb: Column, bits: int) -> Column:
    return F.shiftright(mul32(argb, webp.HASH), 32 - bits)


def int8(v: Column) -> Column:
    return v - F.when(v >= 128, 256).otherwise(0)


def color_delta(factor: Column, value: Column) -> Column:
    """A signed factor with five bits of fraction times a signed value."""
    return F.shiftright(int8(factor) * int8(value), 5)


def mean(a: Column, b: Column) -> Column:
    return F.shiftright(a + b, 1)


def clamp_half(left: Column, top: Column, top_left: Column) -> Column:
    """The mean of left and top, moved half as far from the corner."""
    m = mean(left, top)
    d = m - top_left
    return clamp(m + F.signum(d).cast("long") * F.shiftright(F.abs(d), 1))
