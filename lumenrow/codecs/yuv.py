"""Raw YUV frames; layout, colour matrix and range come from the caller."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .model import DecodeError, Image, check_size, rgba

NAME = "YUV"
# Layout, horizontal and vertical subsampling, and for planes whether
# U stands first, for packed pixels the places of Y0, U, Y1 and V.
FORMATS = {
    "I420": ("planar", 2, 2, True),
    "YV12": ("planar", 2, 2, False),
    "I422": ("planar", 2, 1, True),
    "I444": ("planar", 1, 1, True),
    "NV12": ("semi", 2, 2, True),
    "NV21": ("semi", 2, 2, False),
    "YUY2": ("packed", 2, 1, (0, 1, 2, 3)),
    "YVYU": ("packed", 2, 1, (0, 3, 2, 1)),
    "UYVY": ("packed", 2, 1, (1, 0, 3, 2)),
}
# The weights of red and blue in luma.
RANGES = ("limited", "full")
MATRICES = {"BT.601": (0.299, 0.114), "BT.709": (0.2126, 0.0722), "BT.2020": (0.2627, 0.0593)}


@dataclass(frozen=True)
class Options:
    width: int
    height: int
    format: str = "I420"
    matrix: str = "BT.601"
    range: str = "limited"
    frame: int = 0

    @property
    def chroma(self) -> tuple[int, int]:
        """Width and height of the chroma planes, rounded up."""
        _, sx, sy, _ = FORMATS[self.format]
        return -(-self.width // sx), -(-self.height // sy)

    @property
    def frame_size(self) -> int:
        if FORMATS[self.format][0] == "packed":
            return 2 * self.width * self.height
        cw, ch = self.chroma
        return self.width * self.height + 2 * cw * ch

    def frames_in(self, length: int) -> int:
        return length // self.frame_size if self.frame_size > 0 else 0


def coefficients(matrix: str, range: str) -> dict[str, float]:
    """Factors from offset Y, U and V to red, green and blue."""
    kr, kb = MATRICES[matrix]
    kg = 1 - kr - kb
    luma, chroma = (1.0, 1.0) if range == "full" else (255.0 / 219.0, 255.0 / 224.0)
    rv, bu = 2 * (1 - kr) * chroma, 2 * (1 - kb) * chroma
    return {"y": luma, "offset": 0 if range == "full" else 16, "rv": rv, "bu": bu, "gu": kb * 2 * (1 - kb) / kg * chroma, "gv": kr * 2 * (1 - kr) / kg * chroma}


def to_rgb(y, u, v, matrix: str, range: str) -> np.ndarray:
    c = coefficients(matrix, range)
    y, u, v = (np.asarray(p, float) for p in (y, u, v))
    luma = (y - c["offset"]) * c["y"]
    near = lambda x: np.clip(np.floor(np.abs(x) + 0.5) * np.sign(x), 0, 255)
    return rgba(near(luma + c["rv"] * (v - 128)), near(luma - c["gu"] * (u - 128) - c["gv"] * (v - 128)), near(luma + c["bu"] * (u - 128)))


def exact_height(width: int, format: str, length: int) -> int:
    """The least height of which one frame has just this length, or 0. A frame grows with its height, so it lies near the greatest that fits."""
    high = largest_height(width, format, length)
    return next((h for h in range(max(1, high - 2), high + 1) if Options(width, h, format).frame_size == length), 0)


def largest_height(width: int, format: str, length: int) -> int:
    """The greatest height of which a frame fits in."""
    low, high = 0, 65535
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if Options(width, mid, format).frame_size <= length else (low, mid - 1)
    return low


def planes(data: bytes, o: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Y, and U and V brought to the same size by repeating the nearest sample."""
    layout, sx, sy, order = FORMATS[o.format]
    raw = np.frombuffer(data, np.uint8, o.frame_size, o.frame_size * o.frame)
    w, h = o.width, o.height
    if layout == "packed":
        groups = raw.reshape(h, w // 2, 4)
        y0, u, y1, v = (groups[:, :, i] for i in order)
        return np.stack([y0, y1], axis=2).reshape(h, w), np.repeat(u, 2, axis=1), np.repeat(v, 2, axis=1)
    cw, ch = o.chroma
    y, rest = raw[: w * h].reshape(h, w), raw[w * h :]
    a, b = (rest[: cw * ch], rest[cw * ch :]) if layout == "planar" else (rest[::2], rest[1::2])
    u, v = (a, b) if order else (b, a)
    full = lambda p: np.repeat(np.repeat(p.reshape(ch, cw), sy, axis=0), sx, axis=1)[:h, :w]
    return y, full(u), full(v)


def decode(data: bytes, o: Options) -> Image:
    check_size(o.width, o.height, NAME)
    layout, sx, sy, _ = FORMATS[o.format]
    if layout == "packed" and o.width % 2:
        raise DecodeError(f"{o.format} of odd width {o.width}", NAME)
    end = o.frame_size * (o.frame + 1)
    if o.frame < 0 or end > len(data):
        fit = exact_height(o.width, o.format, len(data))
        hint = f"height {fit} would fit" if fit else f"{max(0, end - len(data))} bytes are missing"
        raise DecodeError(f"frame {o.frame} of {o.frames_in(len(data))}: {hint}", NAME, o.frame_size * o.frame)
    cw, ch = o.chroma
    extra = {"layout": layout, "matrix": o.matrix, "range": o.range, "frame bytes": str(o.frame_size), "chroma": f"{cw} x {ch}", "frame": f"{o.frame + 1} / {o.frames_in(len(data))}"}
    return Image(to_rgb(*planes(data, o), o.matrix, o.range), NAME, o.format, 8, 3, "YUV", is_lossless=sx == sy == 1, extra=extra)
