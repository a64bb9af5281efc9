"""Portable bitmaps, graymaps and pixmaps, P1 to P6."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

from .model import DecodeError, Image, check_size, rgba

NAME = "PNM"
#: White space and comments between header tokens.
_GAP = rb"(?:[ \t\n\v\f\r]|#[^\r\n]*)*"
_TOKEN = re.compile(_GAP + rb"([0-9]+)")
#: Digits of a number at most.
DIGITS = 6


@dataclass
class Header:
    digit: int
    width: int
    height: int
    maxval: int
    offset: int

    @property
    def samples(self) -> int:
        return 3 if self.digit in (3, 6) else 1

    @property
    def binary(self) -> bool:
        return self.digit >= 4


def matches(data: bytes) -> bool:
    return len(data) >= 2 and data[:1] == b"P" and data[1:2] in b"123456"


def _number(data: bytes, at: int, what: str) -> tuple[int, int]:
    m = _TOKEN.match(data, at)
    if not m or len(m[1]) > DIGITS:
        raise DecodeError(f"{what}: no number of up to {DIGITS} digits", NAME, at)
    return int(m[1]), m.end()


def header(data: bytes) -> Header:
    digit, at, found = data[1] - 48, 2, []
    for what in ("width", "height") + (("maxval",) if digit not in (1, 4) else ()):
        value, at = _number(data, at, what)
        found.append(value)
    width, height, maxval = (*found, 1)[:3]
    check_size(width, height, NAME)
    if not 1 <= maxval <= 65535:
        raise DecodeError(f"maxval {maxval}", NAME, at)
    if digit >= 4:
        if data[at : at + 1] not in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r") or at >= len(data):
            raise DecodeError("no white space behind the header", NAME, at)
        at += 1
    return Header(digit, width, height, maxval, at)


def scale(v: np.ndarray, maxval: int) -> np.ndarray:
    """Samples to 0..255, rounded; what is above maxval counts as maxval."""
    v = np.minimum(v.astype(np.int64), maxval)
    return v if maxval == 255 else (v * 255 + maxval // 2) // maxval


def decode(data: bytes) -> Image:
    h = header(data)
    count = h.width * h.height * h.samples
    body = data[h.offset :]
    if h.digit == 1:
        bits = re.sub(rb"#[^\r\n]*|[ \t\n\v\f\r]", b"", body)
        if len(bits) < count:
            raise DecodeError(f"{count} bits wanted, {len(bits)} there", NAME, len(data))
        v = np.frombuffer(bits[:count], np.uint8) - 48
        if (v > 1).any():
            raise DecodeError("a bit that is neither 0 nor 1", NAME, h.offset)
        v = (1 - v) * 255
    elif h.digit in (2, 3):
        words = re.sub(rb"#[^\r\n]*", b"", body).split()[:count]
        if len(words) < count or any(not w.isdigit() or len(w) > DIGITS for w in words):
            raise DecodeError(f"{count} numbers wanted", NAME, h.offset)
        v = np.array(words, dtype="S6").astype(np.int64)
        if (v > h.maxval).any():
            raise DecodeError("a sample above maxval", NAME, h.offset)
        v = scale(v, h.maxval)
    elif h.digit == 4:
        stride = (h.width + 7) // 8
        if len(body) < stride * h.height:
            raise DecodeError(f"{stride * h.height} bytes wanted, {len(body)} there", NAME, len(data))
        rows = np.frombuffer(body[: stride * h.height], np.uint8).reshape(h.height, stride)
        v = (1 - np.unpackbits(rows, axis=1)[:, : h.width]) * 255
    else:
        kind = np.dtype(">u2" if h.maxval > 255 else "u1")
        if len(body) < count * kind.itemsize:
            raise DecodeError(f"{count * kind.itemsize} bytes wanted, {len(body)} there", NAME, len(data))
        v = scale(np.frombuffer(body, kind, count), h.maxval)
    v = np.asarray(v).reshape(h.height, h.width, h.samples)
    depth = 1 if h.digit in (1, 4) else 16 if h.maxval > 255 else 8
    extra = {"maxval": str(h.maxval), "encoding": "binary" if h.binary else "ASCII", "data offset": str(h.offset)}
    return Image(rgba(v[:, :, 0], v[:, :, -2 if h.samples == 3 else 0], v[:, :, -1]), NAME, f"P{h.digit}", depth, h.samples, "RGB" if h.samples == 3 else "Gray", extra=extra)
