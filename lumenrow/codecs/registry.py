"""Which decoder a file belongs to, and decoding by it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from . import bmp, jpeg, png, pnm, webp, yuv
from .model import DecodeError, Image


@dataclass(frozen=True)
class Decoder:
    """A decoder is a pure function of a file's bytes. ``matches`` looks at the first bytes only."""

    name: str
    extensions: tuple[str, ...]
    matches: Callable[[bytes], bool]
    decode: Callable[[bytes], Image]


def _no_header(data: bytes) -> Image:
    raise DecodeError("raw frames have no header: width, height and format must be given", yuv.NAME)


#: In the order in which they are asked. Raw YUV never matches.
DECODERS = (
    Decoder(bmp.NAME, ("bmp", "dib"), bmp.matches, bmp.decode),
    Decoder(png.NAME, ("png", "apng"), png.matches, png.decode),
    Decoder(jpeg.NAME, ("jpg", "jpeg", "jpe", "jfif"), jpeg.matches, jpeg.decode),
    Decoder(webp.NAME, ("webp",), webp.matches, webp.decode),
    Decoder(pnm.NAME, ("pbm", "pgm", "ppm", "pnm", "pam"), pnm.matches, pnm.decode),
    Decoder(yuv.NAME, ("yuv", "i420", "nv12", "nv21", "yv12", "yuy2", "uyvy", "yvyu"), lambda data: False, _no_header),
)


def sniff(data: bytes) -> Decoder | None:
    return next((d for d in DECODERS if d.matches(data)), None)


def hex_preview(data: bytes, n: int = 16) -> str:
    head = data[:n]
    return head.hex(" ").upper() + "  |" + "".join(chr(b) if 32 <= b < 127 else "." for b in head) + "|"


def decode(data: bytes, counted: bool = False) -> Image:
    """``counted`` asks for statistics that take a walk of their own (PNG's deflate blocks)."""
    if not data:
        raise DecodeError("the file is empty", kind="unknown")
    found = sniff(data)
    if found is None:
        raise DecodeError(f"no decoder of {', '.join(d.name for d in DECODERS)} knows {hex_preview(data)}", kind="unknown")
    try:
        return png.decode(data, counted) if found.name == png.NAME else found.decode(data)
    except (IndexError, ValueError, OverflowError) as broken:  # a malformed file never ends the task
        raise DecodeError(f"malformed data: {broken}", found.name) from broken
