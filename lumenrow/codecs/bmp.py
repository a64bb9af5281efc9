"""Windows bitmaps: all header versions, palettes, masks and run lengths."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from .model import DecodeError, Image, check_size, need, rgba, unsupported

NAME = "BMP"
# Header sizes and compression codes.
VERSIONS = {12: "CORE", 40: "INFO", 52: "V2", 56: "V3", 108: "V4", 124: "V5"}
COMPRESSIONS = {0: "RGB", 1: "RLE8", 2: "RLE4", 3: "BITFIELDS", 4: "JPEG", 5: "PNG", 6: "ALPHABITFIELDS"}
DEPTHS = (1, 2, 4, 8, 16, 24, 32)


@dataclass
class Header:
    version: str
    width: int
    height: int
    top_down: bool
    bpp: int
    compression: str
    data_offset: int
    masks: tuple[int, int, int, int]
    implicit_alpha: bool
    palette: np.ndarray
    dpi: int

    @property
    def stride(self) -> int:
        return (self.width * self.bpp + 31) // 32 * 4


def matches(data: bytes) -> bool:
    return len(data) >= 14 and data[:2] == b"BM"


def mask_parts(mask: int) -> tuple[int, int]:
    """Shift and greatest value of a channel mask; its bits must stand together and be 16 at most."""
    if not mask:
        return 0, 0
    shift = (mask & -mask).bit_length() - 1
    top = mask >> shift
    if top & (top + 1) or top.bit_length() > 16:
        raise DecodeError(f"channel mask {mask:#010x}", NAME)
    return shift, top


def extract(words: np.ndarray, mask: int) -> np.ndarray:
    """A channel of pixel words as 0..255; without a mask it is 255."""
    shift, top = mask_parts(mask)
    if not top:
        return np.full(words.shape, 255)
    v = (words.astype(np.int64) >> shift) & top
    return v if top == 255 else (v * 255 + top // 2) // top


def header(data: bytes) -> Header:
    need(data, 0, 18, "header", NAME)
    offset, size = struct.unpack_from("<I4x", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    version = VERSIONS.get(size)
    if version is None:
        raise DecodeError(f"header of {size} bytes", NAME, 14)
    need(data, 14, size, "header", NAME)
    if version == "CORE":
        width, height, planes, bpp = struct.unpack_from("<HHHH", data, 18)
        code = used = ppm = 0
    else:
        width, height, planes, bpp, code, _, ppm, _, used = struct.unpack_from("<iiHHIIiiI", data, 18)
    top_down, height = height < 0, abs(height)
    check_size(width, height, NAME)
    if planes != 1:
        raise DecodeError(f"{planes} planes", NAME, 26)
    if bpp not in DEPTHS:
        raise DecodeError(f"{bpp} bits per pixel", NAME, 28)
    compression = COMPRESSIONS.get(code)
    if compression is None:
        raise DecodeError(f"compression {code}", NAME, 30)
    if compression in ("JPEG", "PNG"):
        raise unsupported(f"embedded {compression}", NAME, 30)
    if {"RLE8": 8, "RLE4": 4}.get(compression, bpp) != bpp or ("BITFIELDS" in compression and bpp not in (16, 32)):
        raise DecodeError(f"compression {compression} with {bpp} bits per pixel", NAME, 30)
    at, masks, implicit = 14 + size, None, False
    if "BITFIELDS" in compression:
        inline = size >= 52
        n = (4 if size >= 56 else 3) if inline else (4 if compression == "ALPHABITFIELDS" else 3)
        first = 54 if inline else at
        need(data, first, 4 * n, "channel masks", NAME)
        masks = (*struct.unpack_from(f"<{n}I", data, first), 0)[:4]
        at += 0 if inline else 4 * n
    if not masks or not any(masks):
        masks = (0x7C00, 0x3E0, 0x1F, 0) if bpp == 16 else (0xFF0000, 0xFF00, 0xFF, 0xFF000000 if bpp == 32 else 0)
        implicit = bpp == 32
    for m in masks:
        mask_parts(m)
    palette = np.zeros((0, 3), np.uint8)
    if bpp <= 8:
        entry = 3 if version == "CORE" else 4
        room = (max(at, min(offset, len(data))) if offset else len(data)) - at
        n = max(0, min(used or 1 << bpp, 1 << bpp, room // entry))
        palette = np.frombuffer(data, np.uint8, n * entry, at).reshape(n, entry)[:, 2::-1] if n else palette
    return Header(version, width, height, top_down, bpp, compression, offset, masks, implicit, palette, int(ppm * 0.0254 + 0.5) if ppm > 0 else 0)


def run_lengths(data: bytes, at: int, width: int, height: int, nibbles: bool) -> np.ndarray:
    """The palette indexes of RLE8 or RLE4 data, first stored row first.

    Writes beyond a row or the image are dropped, untouched pixels are 0, and
    data may end without an end mark; a cut absolute run is an error.
    """
    out = np.zeros((height, width), np.uint8)
    x = y = 0

    def put(values: np.ndarray) -> None:
        nonlocal x
        if y < height and x < width:
            out[y, x : x + len(values)] = values[: width - x]
        x += len(values)

    while at + 1 < len(data):
        n, v = data[at], data[at + 1]
        at += 2
        if n:
            put(np.resize(np.array([v >> 4, v & 15], np.uint8), n) if nibbles else np.full(n, v, np.uint8))
        elif v == 0:
            x, y = 0, y + 1
        elif v == 1:
            break
        elif v == 2:
            need(data, at, 2, "delta", NAME)
            x, y = x + data[at], y + data[at + 1]
            at += 2
        else:
            size = (v + 1) // 2 if nibbles else v
            need(data, at, size, "absolute run", NAME)
            raw = np.frombuffer(data, np.uint8, size, at)
            put(np.stack([raw >> 4, raw & 15], axis=1).ravel()[:v] if nibbles else raw)
            at += size + (size & 1)
    return out


def decode(data: bytes) -> Image:
    h = header(data)
    outside = 0
    need(data, h.data_offset, 0, "pixels", NAME)
    if h.compression.startswith("RLE"):
        index = run_lengths(data, h.data_offset, h.width, h.height, h.compression == "RLE4")
    else:
        need(data, h.data_offset, h.stride * h.height, "pixels", NAME)
        rows = np.frombuffer(data, np.uint8, h.stride * h.height, h.data_offset).reshape(h.height, h.stride)
        if h.bpp <= 8:
            per = 8 // h.bpp
            shifts = np.arange(per - 1, -1, -1, dtype=np.uint8) * h.bpp
            index = ((rows[:, :, None] >> shifts) & ((1 << h.bpp) - 1)).reshape(h.height, -1)[:, : h.width]
    if h.bpp <= 8:
        outside = int((index >= len(h.palette)).sum())
        table = np.zeros((256, 3), np.uint8)
        table[: len(h.palette)] = h.palette
        rgb = table[index]
        pixels = rgba(rgb[:, :, 0], rgb[:, :, 1], rgb[:, :, 2])
    elif h.bpp == 24:
        bgr = rows[:, : h.width * 3].reshape(h.height, h.width, 3)
        pixels = rgba(bgr[:, :, 2], bgr[:, :, 1], bgr[:, :, 0])
    else:
        size = h.bpp // 8
        words = np.ascontiguousarray(rows[:, : h.width * size]).view(f"<u{size}").reshape(h.height, h.width)
        r, g, b, a = (extract(words, m) for m in h.masks)
        if h.implicit_alpha and not a.any():
            a = np.full(a.shape, 255)
        pixels = rgba(r, g, b, a)
    if not h.top_down:
        pixels = pixels[::-1]
    extra = {"row order": "top-down" if h.top_down else "bottom-up", "row stride": str(h.stride), "data offset": str(h.data_offset)}
    if h.bpp <= 8:
        extra |= {"palette": str(len(h.palette)), "indexes outside": str(outside)}
    elif h.bpp != 24:
        extra["masks"] = " ".join(f"{m:08X}" for m in h.masks)
    if h.dpi:
        extra["dpi"] = str(h.dpi)
    return Image(np.ascontiguousarray(pixels), NAME, h.version, h.bpp, 4 if h.bpp == 32 else 3, compression=h.compression, extra=extra)
