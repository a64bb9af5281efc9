"""Whole texts written as files of every kind, decoded by ``decode_images`` and ``decode_frames``, against SQL that knows their pixels.

Each text, filled up with zeros to a whole number of rows, is the raw material
of one file; the SQL derives every pixel from the text's bytes and the format's
rules, with all tables and factors written out. No row per byte is made in
Spark: files go in as they are, and each image comes back as its sums.
"""

from __future__ import annotations

import struct
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codecs import writers
from ..functions import bytesx
from ..operators import decode, view
from ..sources import images
from ..streaming import arrivals
from .image_queries import query
from .recipes import SQL_BYTES, contents, sql_padded
from .round_trips import block_sums, written

_CHANNELS = "rgba"


def image_sums(decoded: DataFrame, step: int = 1) -> DataFrame:
    """doc_id, width, height, n, and of each channel its sum and its sum weighted by place, from images with pixels; with ``step`` of the first pixel of each square."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = []
            for width, blob in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                p = np.frombuffer(blob.as_py() or b"", np.uint8).reshape(-1, width or 1, 4)[::step, ::step].reshape(-1, 4).astype(np.int64)
                weight = np.arange(len(p)) % 1009 + 1
                out.append([len(p), *(x for c in range(4) for x in (int(p[:, c].sum()), int(p[:, c] @ weight)))])
            sums = [pa.array([r[k] for r in out], pa.int64()) for k in range(9)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *sums], names=["doc_id", "width", "height", "n", *(f"{s}_{c}" for c in _CHANNELS for s in ("sum", "at"))])

    return decoded.select("image_id", "width", "height", "pixels").mapInArrow(run, "doc_id long, width int, height int, n long, " + ", ".join(f"{s}_{c} long" for c in _CHANNELS for s in ("sum", "at")))


def sql_grouped(k: int) -> str:
    """w: doc_id, g and bytes b0, b1, ... of each group of k bytes of pb."""
    return f"w AS (SELECT doc_id, i // {k} AS g, " + ", ".join(f"max(CASE WHEN i % {k} = {j} THEN v END) AS b{j}" for j in range(k)) + f" FROM pb GROUP BY doc_id, i // {k})"


def sql_sums(width: str, source: str, r: str, g: str, b: str, a: str = "255", place: str = "place") -> str:
    """The sums of ``image_sums`` over a relation with a row per pixel."""
    made = ", ".join(f"CAST(sum({v}) AS BIGINT) AS sum_{c}, CAST(sum(({v}) * (({place}) % 1009 + 1)) AS BIGINT) AS at_{c}" for c, v in zip(_CHANNELS, (r, g, b, a), strict=True))
    return f"SELECT doc_id, CAST({width} AS INTEGER) AS width, CAST(count(*) // ({width}) AS INTEGER) AS height, count(*) AS n, {made} FROM {source} GROUP BY doc_id"


def _grid(data: bytes, unit: int) -> np.ndarray:
    return np.frombuffer(data + bytes(-len(data) % unit), np.uint8).reshape(-1, unit)


def image_query(name: str, write: Callable[[bytes], bytes], sql: str, step: int = 1) -> None:
    """Registers a query that writes each text as a file, decodes it and sums its pixels."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return image_sums(decode.decode_images(written(spark, sf_dir, write)), step)

    run.__name__ = name
    query(sql)(run)


# --- PNG ---------------------------------------------------------------------


def _png_rows(v: np.ndarray, depth: int, lanes: int, first: int = 0) -> list[bytes]:
    """Samples (height x samples of a row) as packed and filtered rows, the filters in turn."""
    if depth == 16:
        packed = v.astype(">u2").view(np.uint8).reshape(len(v), -1)
    elif depth == 8:
        packed = v
    else:
        packed = np.packbits((v[:, :, None] >> np.arange(depth - 1, -1, -1) & 1).reshape(len(v), -1).astype(np.uint8), axis=1)
    return writers.filtered(packed, lanes, [(first + i) % 5 for i in range(len(packed))])


#: First column and row of each Adam7 pass, and its steps.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _adam7(v: np.ndarray, depth: int, lanes: int) -> list[bytes]:
    """v is height x width x samples of a pixel."""
    rows: list[bytes] = []
    for x0, y0, dx, dy in _PASSES:
        part = v[y0::dy, x0::dx]
        if part.size:
            rows += _png_rows(part.reshape(len(part), -1), depth, lanes, len(rows))
    return rows


def _palette_png(data: bytes) -> bytes:
    i = np.arange(256)
    colors, alphas = np.stack([i, 255 - i, i * 7 % 256], axis=1).astype(np.uint8).tobytes(), (i[:100] * 5 % 256).astype(np.uint8).tobytes()
    v = _grid(data, 64)
    return writers.png(64, len(v), 8, 3, _png_rows(v, 8, 1), [(b"PLTE", colors), (b"tRNS", alphas)])


image_query("png_palette_decode", _palette_png, f"WITH {sql_padded(64)}, q AS (SELECT doc_id, i AS place, v FROM pb) " + sql_sums("64", "q", "v", "255 - v", "v * 7 % 256", "CASE WHEN v < 100 THEN v * 5 % 256 ELSE 255 END"))


def _narrow_png(depth: int, width: int) -> Callable[[bytes], bytes]:
    """Gray of few bits a sample; the row's last samples don't fill its last byte."""

    def write(data: bytes) -> bytes:
        unit = -(-width * depth // 8)
        v = _grid(data, unit)
        return writers.png(width, len(v), depth, 0, writers.filtered(v, 1, [i % 5 for i in range(len(v))]))

    return write


for _depth, _width in ((1, 61), (2, 63), (4, 63)):
    _unit, _per = -(-_width * _depth // 8), 8 // _depth
    image_query(
        f"png_gray{_depth}_decode", _narrow_png(_depth, _width),
        f"WITH {sql_padded(_unit)}, q AS (SELECT doc_id, i // {_unit} AS y, i % {_unit} * {_per} + k AS x, v // CAST(pow(2, {8 - _depth} - {_depth} * k) AS BIGINT) % {1 << _depth} * {255 // ((1 << _depth) - 1)} AS t FROM pb, range({_per}) AS r(k)), p AS (SELECT doc_id, y * {_width} + x AS place, t FROM q WHERE x < {_width}) " + sql_sums(str(_width), "p", "t", "t", "t"),
    )

image_query("png_adam7_rgb_decode", lambda d: (lambda v: writers.png(16, len(v), 8, 2, _adam7(v.reshape(len(v), 16, 3), 8, 3), interlace=1))(_grid(d, 48)), f"WITH {sql_padded(48)}, {sql_grouped(3)}, p AS (SELECT *, g AS place FROM w) " + sql_sums("16", "p", "b0", "b1", "b2"))
image_query(
    "png_adam7_gray2_decode", lambda d: (lambda v: writers.png(32, len(v), 2, 0, _adam7((v[:, :, None] >> np.array([6, 4, 2, 0]) & 3).reshape(len(v), 32, 1), 2, 1), interlace=1))(_grid(d, 8)),
    f"WITH {sql_padded(8)}, p AS (SELECT doc_id, i * 4 + k AS place, v // CAST(pow(4, 3 - k) AS BIGINT) % 4 * 85 AS t FROM pb, range(4) AS r(k)) " + sql_sums("32", "p", "t", "t", "t"),
)
_WORD = "((b{0} * 256 + b{1}) * 255 + 32767) // 65535"
image_query("png_rgba16_decode", lambda d: (lambda v: writers.png(8, len(v), 16, 6, _png_rows(v.view(">u2"), 16, 8)))(_grid(d, 64)), f"WITH {sql_padded(64)}, {sql_grouped(8)}, p AS (SELECT *, g AS place FROM w) " + sql_sums("8", "p", *(_WORD.format(2 * c, 2 * c + 1) for c in range(4))))
image_query("png_gray_alpha_decode", lambda d: (lambda v: writers.png(32, len(v), 8, 4, _png_rows(v, 8, 2)))(_grid(d, 64)), f"WITH {sql_padded(64)}, {sql_grouped(2)}, p AS (SELECT *, g AS place FROM w) " + sql_sums("32", "p", "b0", "b0", "b0", "b1"))
image_query("png_gray_key_decode", lambda d: (lambda v: writers.png(64, len(v), 8, 0, _png_rows(v, 8, 1), [(b"tRNS", b"\0e")]))(_grid(d, 64)), f"WITH {sql_padded(64)}, p AS (SELECT doc_id, i AS place, v FROM pb) " + sql_sums("64", "p", "v", "v", "v", "CASE WHEN v = 101 THEN 0 ELSE 255 END"))
image_query("png_rgb_key_decode", lambda d: (lambda v: writers.png(16, len(v), 8, 2, _png_rows(v, 8, 3), [(b"tRNS", b"\0\0\0\0\0\0")]))(_grid(d, 48)), f"WITH {sql_padded(48)}, {sql_grouped(3)}, p AS (SELECT *, g AS place FROM w) " + sql_sums("16", "p", "b0", "b1", "b2", "CASE WHEN b0 = 0 AND b1 = 0 AND b2 = 0 THEN 0 ELSE 255 END"))

# --- BMP ---------------------------------------------------------------------


def _bmp(bpp: int, width: int, **more) -> Callable[[bytes], bytes]:
    """Rows of width * bpp bits, filled up to four bytes, the last row first."""

    def write(data: bytes) -> bytes:
        unit = -(-width * bpp // 8)
        v = _grid(data, unit)
        body = np.pad(v[::-1], ((0, 0), (0, -unit % 4))).tobytes()
        return writers.bmp(width, len(v), bpp, body, **more)

    return write


_GRAYS = b"".join(bytes([(i * 3) % 256, i, 255 - i, 0]) for i in range(256))
for _bpp, _width in ((1, 61), (4, 63), (8, 61)):
    _unit, _per, _colors = -(-_width * _bpp // 8), 8 // _bpp, {1: 2, 4: 16, 8: 200}[_bpp]
    _index = f"v // CAST(pow(2, {8 - _bpp} - {_bpp} * k) AS BIGINT) % {1 << _bpp}"
    # indexes without an entry are black
    _known = lambda x: f"CASE WHEN t < {_colors} THEN {x} ELSE 0 END"  # noqa: B023, E731
    image_query(
        f"bmp_{_bpp}bit_decode", _bmp(_bpp, _width, palette=_GRAYS[: 4 * _colors], used=_colors),
        f"WITH {sql_padded(_unit)}, q AS (SELECT doc_id, i // {_unit} AS y, i % {_unit} * {_per} + k AS x, {_index} AS t FROM pb, range({_per}) AS r(k)), p AS (SELECT doc_id, y * {_width} + x AS place, t FROM q WHERE x < {_width}) " + sql_sums(str(_width), "p", _known("255 - t"), _known("t"), _known("t * 3 % 256")),
    )
_PAIR = f"{{head}}, {sql_grouped(2)}, p AS (SELECT doc_id, g AS place, b0 + 256 * b1 AS t FROM w) "
image_query("bmp_555_decode", _bmp(16, 31), "WITH " + _PAIR.format(head=sql_padded(62)) + sql_sums("31", "p", "((t // 1024 % 32) * 255 + 15) // 31", "((t // 32 % 32) * 255 + 15) // 31", "((t % 32) * 255 + 15) // 31"))
image_query("bmp_565_decode", _bmp(16, 31, compression=3, masks=struct.pack("<III", 0xF800, 0x7E0, 0x1F)), "WITH " + _PAIR.format(head=sql_padded(62)) + sql_sums("31", "p", "((t // 2048 % 32) * 255 + 15) // 31", "((t // 32 % 64) * 255 + 31) // 63", "((t % 32) * 255 + 15) // 31"))
image_query("bmp_24bit_decode", _bmp(24, 15), f"WITH {sql_padded(45)}, {sql_grouped(3)}, p AS (SELECT *, g AS place FROM w) " + sql_sums("15", "p", "b2", "b1", "b0"))
# the fourth byte is alpha unless it is zero in the whole image
image_query("bmp_32bit_decode", _bmp(32, 16), f"WITH {sql_padded(64)}, {sql_grouped(4)}, o AS (SELECT doc_id, bool_or(b3 > 0) AS seen FROM w GROUP BY doc_id), p AS (SELECT w.*, g AS place, seen FROM w JOIN o ON w.doc_id = o.doc_id) " + sql_sums("16", "p", "b2", "b1", "b0", "CASE WHEN seen THEN b3 ELSE 255 END"))
image_query("bmp_masked_alpha_decode", _bmp(32, 16, compression=6, masks=struct.pack("<IIII", 0xFF, 0xFF00, 0xFF0000, 0xFF000000)), f"WITH {sql_padded(64)}, {sql_grouped(4)}, p AS (SELECT *, g AS place FROM w) " + sql_sums("16", "p", "b0", "b1", "b2", "b3"))


def _rle4(data: bytes) -> bytes:
    """Each row of 32 bytes is 64 indexes, in absolute runs of 60 and a run of pairs; a delta leads over three pixels of each."""
    v, body = _grid(data, 32), bytearray()
    for row in v:
        body += b"\0\2\3\0" + b"\0\x3c" + row[:30].tobytes() + b"\4" + row[30:31].tobytes() + b"\0\0"
    return writers.bmp(67, -len(v), 4, bytes(body) + b"\0\1", 2, _GRAYS[:64])


image_query(
    "bmp_rle4_decode", _rle4,
    f"""WITH {sql_padded(32)}, q AS (SELECT doc_id, i // 32 AS y, 3 + i % 32 * 2 + k AS x, CASE WHEN k = 0 THEN v // 16 ELSE v % 16 END AS t FROM pb, range(2) AS r(k) WHERE i % 32 < 31
        UNION ALL SELECT doc_id, i // 32, 65 + k, CASE WHEN k = 0 THEN v // 16 ELSE v % 16 END FROM pb, range(2) AS r(k) WHERE i % 32 = 30 UNION ALL SELECT doc_id, unnest(range(m // 32)), k, 0 FROM s, range(3) AS r(k)), p AS (SELECT doc_id, y * 67 + x AS place, t FROM q) """ + sql_sums("67", "p", "255 - t", "t", "t * 3 % 256"),
)

# --- PNM ---------------------------------------------------------------------


def _ascii(kind: bytes, width: int, top: int) -> Callable[[bytes], bytes]:
    def write(data: bytes) -> bytes:
        unit = width * (3 if kind == b"P3" else 1)
        v = _grid(data, unit).astype(int) % (top + 1)
        sizes = b"%d %d" % (width, len(v))
        return kind + b" # made of a text\n" + sizes + b"\n" + (b"" if kind == b"P1" else b"%d\n" % top) + (b"" if kind == b"P1" else b"\n").join(b"".join(b"%d" % x for x in r) if kind == b"P1" else b" ".join(b"%d" % x for x in r) for r in v.tolist())

    return write


image_query("pnm_p1_decode", _ascii(b"P1", 40, 1), f"WITH {sql_padded(40)}, p AS (SELECT doc_id, i AS place, (1 - v % 2) * 255 AS t FROM pb) " + sql_sums("40", "p", "t", "t", "t"))
image_query("pnm_p2_decode", _ascii(b"P2", 40, 99), f"WITH {sql_padded(40)}, p AS (SELECT doc_id, i AS place, (v % 100 * 255 + 49) // 99 AS t FROM pb) " + sql_sums("40", "p", "t", "t", "t"))
image_query("pnm_p3_decode", _ascii(b"P3", 16, 255), f"WITH {sql_padded(48)}, {sql_grouped(3)}, p AS (SELECT *, g AS place FROM w) " + sql_sums("16", "p", "b0", "b1", "b2"))
image_query("pnm_p4_decode", lambda d: b"P4\n61 %d\n" % len(_grid(d, 8)) + _grid(d, 8).tobytes(), f"WITH {sql_padded(8)}, q AS (SELECT doc_id, i // 8 AS y, i % 8 * 8 + k AS x, (1 - v // CAST(pow(2, 7 - k) AS BIGINT) % 2) * 255 AS t FROM pb, range(8) AS r(k)), p AS (SELECT doc_id, y * 61 + x AS place, t FROM q WHERE x < 61) " + sql_sums("61", "p", "t", "t", "t"))
image_query("pnm_p5_wide_decode", lambda d: b"P5 32 %d 40000\n" % len(_grid(d, 64)) + _grid(d, 64).tobytes(), f"WITH {sql_padded(64)}, {sql_grouped(2)}, p AS (SELECT doc_id, g AS place, (least(b0 * 256 + b1, 40000) * 255 + 20000) // 40000 AS t FROM w) " + sql_sums("32", "p", "t", "t", "t"))
image_query("pnm_p6_decode", lambda d: b"P6\n# c\n16 %d\n255\n" % len(_grid(d, 48)) + _grid(d, 48).tobytes(), f"WITH {sql_padded(48)}, {sql_grouped(3)}, p AS (SELECT *, g AS place FROM w) " + sql_sums("16", "p", "b0", "b1", "b2"))

# --- YUV ---------------------------------------------------------------------

#: Bytes that stand for one step of height (two rows where chroma is halved down), by layout, at 16 columns.
_YUV_STEP = {"I420": (48, 2), "YV12": (48, 2), "NV12": (48, 2), "NV21": (48, 2), "I422": (32, 1), "I444": (48, 1), "YUY2": (32, 1), "YVYU": (32, 1), "UYVY": (32, 1)}
#: Places in SQL of Y, U and V of the pixel (x, y) of a frame of 16 columns and h rows.
_YUV_PLACE = {
    "I420": ("y * 16 + x", "16 * h + y // 2 * 8 + x // 2", "20 * h + y // 2 * 8 + x // 2"), "YV12": ("y * 16 + x", "20 * h + y // 2 * 8 + x // 2", "16 * h + y // 2 * 8 + x // 2"),
    "NV12": ("y * 16 + x", "16 * h + y // 2 * 16 + x // 2 * 2", "16 * h + y // 2 * 16 + x // 2 * 2 + 1"), "NV21": ("y * 16 + x", "16 * h + y // 2 * 16 + x // 2 * 2 + 1", "16 * h + y // 2 * 16 + x // 2 * 2"),
    "I422": ("y * 16 + x", "16 * h + y * 8 + x // 2", "24 * h + y * 8 + x // 2"), "I444": ("y * 16 + x", "16 * h + y * 16 + x", "32 * h + y * 16 + x"),
    "YUY2": ("y * 32 + x * 2", "y * 32 + x // 2 * 4 + 1", "y * 32 + x // 2 * 4 + 3"), "YVYU": ("y * 32 + x * 2", "y * 32 + x // 2 * 4 + 3", "y * 32 + x // 2 * 4 + 1"), "UYVY": ("y * 32 + x * 2 + 1", "y * 32 + x // 2 * 4", "y * 32 + x // 2 * 4 + 2"),
}
#: Weights of red and blue in luma.
_LUMA = {"BT.601": ("0.299::DOUBLE", "0.114::DOUBLE"), "BT.709": ("0.2126::DOUBLE", "0.0722::DOUBLE"), "BT.2020": ("0.2627::DOUBLE", "0.0593::DOUBLE")}


def sql_yuv(y: str, u: str, v: str, matrix: str, range_: str) -> tuple[str, str, str]:
    """Red, green and blue from first principles: weights of red and blue, and the range's spans of 219 and 224 steps."""
    kr, kb = _LUMA[matrix]
    luma, chroma, offset = ("1::DOUBLE", "1::DOUBLE", 0) if range_ == "full" else ("(255::DOUBLE / 219)", "(255::DOUBLE / 224)", 16)
    kg = f"(1 - {kr} - {kb})"
    bright = f"(({y}) - {offset}) * {luma}"
    near = lambda x: f"CAST(least(greatest(round({x}), 0), 255) AS BIGINT)"
    return (
        near(f"{bright} + (2 * (1 - {kr}) * {chroma}) * (({v}) - 128)"),
        near(f"{bright} - ({kb} * 2 * (1 - {kb}) / {kg} * {chroma}) * (({u}) - 128) - ({kr} * 2 * (1 - {kr}) / {kg} * {chroma}) * (({v}) - 128)"),
        near(f"{bright} + (2 * (1 - {kb}) * {chroma}) * (({u}) - 128)"),
    )


def yuv_query(name: str, format: str, matrix: str, range_: str) -> None:
    """A text as one frame of 16 columns."""
    step, rows = _YUV_STEP[format]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = F.octet_length("content")
        steps = F.ceil(n / step).cast("int")
        filled = F.expr(f"rpad(content, CAST(ceil(octet_length(content) / {step}) * {step} AS INT), X'00')")
        options = F.struct(F.lit(16).alias("width"), (steps * rows).alias("height"), F.lit(format).alias("format"), F.lit(matrix).alias("matrix"), F.lit(range_).alias("range"), F.lit(0).alias("frame_index"))
        files = contents(spark, sf_dir).where(n > 0).select(F.col("doc_id").alias("image_id"), options.alias("options"), filled.alias("content"))
        return image_sums(decode.decode_frames(files))

    run.__name__ = name
    at = {c: place.replace("x", "(k % 16)").replace("y ", "(k // 16) ") for c, place in zip("yuv", _YUV_PLACE[format], strict=True)}
    sql = f"""WITH {SQL_BYTES}, l AS (SELECT doc_id, list(v ORDER BY i) AS bytes, (max(n) + {step - 1}) // {step} * {rows} AS h FROM b GROUP BY doc_id),
        q AS (SELECT doc_id, unnest(list_transform(range(16 * h), lambda k: {{'place': k, 'luma': coalesce(bytes[{at["y"]} + 1], 0), 'u': coalesce(bytes[{at["u"]} + 1], 0), 'w': coalesce(bytes[{at["v"]} + 1], 0)}})) AS e FROM l), p AS (SELECT doc_id, e.place AS place, e.luma AS luma, e.u AS u, e.w AS w FROM q) """
    query(sql + sql_sums("16", "p", *sql_yuv("luma", "u", "w", matrix, range_)))(run)


for _name, _format, _matrix, _range in (
    ("yuv_i420_rgb", "I420", "BT.601", "limited"), ("yuv_nv12_rgb", "NV12", "BT.601", "limited"), ("yuv_packed_rgb", "YUY2", "BT.709", "full"), ("yuv_yv12_rgb", "YV12", "BT.709", "limited"),
    ("yuv_nv21_rgb", "NV21", "BT.2020", "limited"), ("yuv_i422_rgb", "I422", "BT.601", "full"), ("yuv_i444_rgb", "I444", "BT.2020", "full"), ("yuv_yvyu_rgb", "YVYU", "BT.601", "limited"), ("yuv_uyvy_rgb", "UYVY", "BT.709", "limited"),
):
    yuv_query(_name, _format, _matrix, _range)

# --- JPEG --------------------------------------------------------------------


#: Blocks in a row of the JPEG images, and bytes whose mean is a block's colour.
BLOCKS, MEAN = 8, 64


def _flat(data: bytes, factors: tuple[tuple[int, int], ...], progressive: bool = False, ids: tuple[int, ...] = (1, 2, 3), extra: bytes = b"") -> bytes:
    """The first component has a block of one colour for the mean of each MEAN bytes; further ones have the second mean and so on all over. Steps of 8 make a mean's coefficient the value."""
    v = _grid(data, BLOCKS * MEAN).reshape(-1, BLOCKS, MEAN).astype(int).sum(axis=2) // MEAN
    mh, mv = factors[0]
    tall = -(-len(v) // mv) * mv
    first = np.zeros((tall, BLOCKS, 64), int)
    first[: len(v), :, 0] = v - 128
    parts = [(ids[0], mh, mv, 0, first.reshape(-1, 64))]
    for c, (h, w) in enumerate(factors[1:], 1):
        blocks = np.zeros((BLOCKS // mh * h * (tall // mv) * w, 64), int)
        blocks[:, 0] = int(v.ravel()[c]) - 128
        parts.append((ids[c], h, w, 0, blocks))
    return writers.jpeg(8 * BLOCKS, 8 * len(v), parts, [[8] * 64], 3 if progressive else 0, progressive, extra)


def _sql_fixed(y: str, cb: str, cr: str) -> tuple[str, str, str]:
    """1.402, 0.344136, 0.714136 and 1.772 in 65536ths."""
    clamped = lambda x: f"least(255, greatest(0, {y} + CAST(floor(({x} + 32768) / 65536) AS BIGINT)))"
    return clamped(f"({cr} - 128) * 91881"), clamped(f"-({cb} - 128) * 22554 - ({cr} - 128) * 46802"), clamped(f"({cb} - 128) * 116130")


#: A row per block, whose pixels are all alike.
_SQL_BLOCKS = f"""WITH {sql_padded(BLOCKS * MEAN)}, t AS (SELECT doc_id, i // {MEAN} AS i, CAST(sum(v) AS BIGINT) // {MEAN} AS v FROM pb GROUP BY doc_id, i // {MEAN}),
    c AS (SELECT doc_id, max(CASE WHEN i = 1 THEN v END) AS cb, max(CASE WHEN i = 2 THEN v END) AS cr, max(CASE WHEN i = 3 THEN v END) AS ink, count(*) // {BLOCKS} AS tall FROM t GROUP BY doc_id), p AS (SELECT t.doc_id, cb, cr, ink, v, i, tall FROM t JOIN c ON t.doc_id = c.doc_id) """


def _sql_blocks(r: str, g: str, b: str, turned: bool = False) -> str:
    place = f"(i % {BLOCKS} * tall + tall - 1 - i // {BLOCKS})" if turned else "i"
    made = ", ".join(f"CAST(sum({v}) AS BIGINT) AS sum_{c}, CAST(sum(({v}) * ({place} % 1009 + 1)) AS BIGINT) AS at_{c}" for c, v in zip(_CHANNELS, (r, g, b, "255"), strict=True))
    sizes = (f"{8 * BLOCKS}", "8 * max(tall)")
    width, height = sizes[::-1] if turned else sizes
    return f"{_SQL_BLOCKS}SELECT doc_id, CAST({width} AS INTEGER) AS width, CAST({height} AS INTEGER) AS height, count(*) AS n, {made} FROM p GROUP BY doc_id"


for _name, _factors in (("444", ((1, 1),) * 3), ("422", ((2, 1), (1, 1), (1, 1))), ("420", ((2, 2), (1, 1), (1, 1))), ("440", ((1, 2), (1, 1), (1, 1)))):
    for _kind in (False, True):
        image_query(f"jpeg_{_name}_{'progressive' if _kind else 'baseline'}_decode", lambda d, f=_factors, k=_kind: _flat(d, f, k), _sql_blocks(*_sql_fixed("v", "cb", "cr")), 8)
image_query("jpeg_gray_decode", lambda d: _flat(d, ((1, 1),)), _sql_blocks("v", "v", "v"), 8)
image_query("jpeg_rgb_ids_decode", lambda d: _flat(d, ((1, 1),) * 3, ids=(82, 71, 66)), _sql_blocks("v", "cb", "cr"), 8)
#: APP14 with transform 0: inks stand inverted.
_ADOBE = writers.segment(0xEE, b"Adobe\0\x64\0\0\0\0\0")
image_query("jpeg_cmyk_decode", lambda d: _flat(d, ((1, 1),) * 4, ids=(1, 2, 3, 4), extra=_ADOBE), _sql_blocks("v * ink // 255", "cb * ink // 255", "cr * ink // 255"), 8)
#: Orientation 6 in a little-endian directory of one entry.
_EXIF = writers.segment(0xE1, b"Exif\0\0II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0")
image_query("jpeg_turned_decode", lambda d: _flat(d, ((1, 1),), extra=_EXIF), _sql_blocks("v", "v", "v", True), 8)


def _coefficients(progressive: bool, sampled: bool) -> Callable[[list[bytes]], list[bytes]]:
    def image(data: bytes) -> tuple[int, int, list[tuple]]:
        """Eight bytes less 128 are a block's first coefficients; with chroma of half the width beside them."""
        v = _grid(data, 8).astype(np.int16) - 128
        n = -(-len(v) // BLOCKS) * BLOCKS
        coefs = np.zeros((n, 64), np.int16)
        coefs[: len(v), :8] = v
        return 8 * BLOCKS, 8 * (n // BLOCKS), [(1, 2 if sampled else 1, 1, 0, coefs)] + [(i, 1, 1, 0, coefs[i - 2 :: 2]) for i in (2, 3)] * sampled

    return lambda texts: writers.jpegs([image(t) for t in texts], [[1] * 64], 0 if progressive else 5, progressive)


def coefficient_query(name: str, progressive: bool, sampled: bool) -> None:
    """The coefficients of each component as they were written."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = written(spark, sf_dir, together=_coefficients(progressive, sampled))
        k = np.stack([np.arange(1, 65), np.ones(64)], axis=1)

        def value(coefs: np.ndarray, block: np.ndarray) -> np.ndarray:
            placed, plain = (coefs.astype(float) @ k).astype(np.int64).T  # whole numbers, exact in doubles
            return placed + plain * (block % 1009)

        return block_sums(files, "component", value).groupBy("doc_id", "component").agg(F.sum("blocks").alias("blocks"), F.sum("at_coef").alias("at_coef"))

    run.__name__ = name
    shown = "SELECT doc_id, CAST({c} AS INTEGER) AS component, max(n) AS blocks, CAST(sum(CASE WHEN i < size THEN (v - 128) * (i % 8 + 1 + ({b}) % 1009) ELSE 0 END) AS BIGINT) AS at_coef FROM t {where} GROUP BY doc_id"
    sql = f"WITH {sql_padded(8)}, t AS (SELECT pb.doc_id, i, v, s.m AS size, (s.m // 8 + {BLOCKS - 1}) // {BLOCKS} * {BLOCKS} AS n FROM pb JOIN s ON pb.doc_id = s.doc_id) "
    whole = sql + shown.format(c=1, b="i // 8", where="")
    if sampled:
        halves = " UNION ALL ".join(shown.format(c=c, b="i // 16", where="").replace("FROM t", f"FROM (SELECT doc_id, n // 2 AS n, i, v, CASE WHEN i // 8 % 2 = {c - 2} THEN size ELSE 0 END AS size FROM t)") for c in (2, 3))
        whole += " UNION ALL " + halves
    query(whole)(run)


coefficient_query("jpeg_progressive_coefficients", True, False)
coefficient_query("jpeg_interleaved_coefficients", False, True)
coefficient_query("jpeg_progressive_sampled_coefficients", True, True)

# --- WebP --------------------------------------------------------------------


def _argb(data: bytes, width: int) -> np.ndarray:
    p = _grid(data, 3 * width).reshape(-1, width, 3).astype(np.int64)
    return 0xFF000000 | p[:, :, 0] << 16 | p[:, :, 1] << 8 | p[:, :, 2]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a less b, channel by channel."""
    return sum(((a >> s) - (b >> s) & 255) << s for s in (0, 8, 16, 24))


#: Predictors that are one neighbour or the black pixel, by mode: what each block of 4 x 4 takes in turn.
_MODES = (1, 2, 3, 4, 0)


def _webp_predicted(data: bytes) -> bytes:
    """Residues of the left, upper, upper right and upper left pixel."""
    v = _argb(data, 16)
    h = len(v)
    top = np.vstack([np.zeros((1, 16), np.int64), v[:-1]])
    left = np.hstack([np.zeros((h, 1), np.int64), v[:, :-1]])
    # the last column's upper right pixel is the first of its own row
    right = np.hstack([top[:, 1:], v[:, :1]])
    corner = np.hstack([np.zeros((h, 1), np.int64), top[:, :-1]])
    blocks = (np.arange(-(-h // 4))[:, None] + np.arange(4)[None, :]) % len(_MODES)
    mode = np.array(_MODES)[np.kron(blocks, np.ones((4, 4), int))[:h, :16]]
    guess = np.select([mode == m for m in (1, 2, 3, 4)], [left, top, right, corner], 0xFF000000)
    guess[:, 0], guess[0, :] = top[:, 0], left[0, :]
    guess[0, 0] = 0xFF000000
    return writers.webp(writers.vp8l(_apart(v, guess), [(0, 2, np.array(_MODES)[blocks] << 8)]))


_SQL_TRIPLES = f"WITH {sql_padded(48)}, {sql_grouped(3)}, p AS (SELECT *, g AS place FROM w) "
image_query("webp_predictor_decode", _webp_predicted, _SQL_TRIPLES + sql_sums("16", "p", "b0", "b1", "b2"))


def _webp_indexed(bits: int) -> Callable[[bytes], bytes]:
    """Two, four or sixteen colours; indexes share a green byte."""
    colors = 1 << bits
    palette = np.array([0xFF000000 | (i * 15) << 16 | (255 - i * 15) << 8 | i * 9 for i in range(colors)], np.int64)[None, :]
    steps = palette.copy()
    steps[0, 1:] = _apart(palette[0, 1:], palette[0, :-1])

    def write(data: bytes) -> bytes:
        v = _grid(data, 64)
        return writers.webp(writers.vp8l(v.astype(np.int64) << 8, [(3, colors, steps, 64 * (8 // bits))]))

    return write


for _bits in (1, 2, 4):
    _per = 8 // _bits
    image_query(f"webp_{1 << _bits}_colors_decode", _webp_indexed(_bits), f"WITH {sql_padded(64)}, p AS (SELECT doc_id, i * {_per} + k AS place, v // CAST(pow(2, {_bits} * k) AS BIGINT) % {1 << _bits} AS t FROM pb, range({_per}) AS r(k)) " + sql_sums(str(64 * _per), "p", "t * 15", "255 - t * 15", "t * 9"))


def _webp_crossed(data: bytes) -> bytes:
    """Factors 32 and -32 are one for one: red less green, blue less green plus red."""
    v = _argb(data, 16)
    r, g, b = (v >> s & 255 for s in (16, 8, 0))
    s8 = lambda x: x - (x > 127) * 256
    red, blue = r - s8(g) & 255, b + s8(g) - s8(r) & 255
    tiles = np.full((-(-len(v) // 4), 4), 0xFF000000 | 32 << 16 | 224 << 8 | 32, np.int64)
    return writers.webp(writers.vp8l(0xFF000000 | red << 16 | g << 8 | blue, [(1, 2, tiles)]))


image_query("webp_crossed_decode", _webp_crossed, _SQL_TRIPLES + sql_sums("16", "p", "b0", "b1", "b2"))
image_query(
    "webp_extended_decode", lambda d: (lambda v: writers.webp(writers.vp8l(v), before=b"VP8X" + struct.pack("<I", 10) + b"\x10\0\0\0" + struct.pack("<I", 15)[:3] + struct.pack("<I", len(v) - 1)[:3]))(_argb(d, 16)),
    _SQL_TRIPLES + sql_sums("16", "p", "b0", "b1", "b2"),
)

# --- deflate -----------------------------------------------------------------

_ADLER = "CAST(((max(n) + sum((n - i) * v)) % 65521) * 65536 + (1 + sum(v)) % 65521 AS BIGINT)"


def _deflated(name: str, level: int, strategy: int, flag: str) -> None:
    """The data that came back, and that all its blocks are of one kind."""

    def pack(data: bytes) -> bytes:
        run = zlib.compressobj(level, zlib.DEFLATED, 15, 9, strategy)
        return run.compress(data) + run.flush()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = decode.inflated(written(spark, sf_dir, pack))

        def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data = [b.as_py() for b in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array([zlib.adler32(d) for d in data], pa.int64()), batch.column(2)], names=["doc_id", "n", "adler", "alone"])

        others = [c for c in ("stored", "fixed", "dynamic") if c != flag]
        alone = (F.col(flag) > 0) & (F.col(others[0]) == 0) & (F.col(others[1]) == 0)
        return rows.select("image_id", "data", alone.alias("alone")).mapInArrow(checked, "doc_id long, n long, adler long, alone boolean")

    run.__name__ = name
    query(f"WITH {SQL_BYTES} SELECT doc_id, CAST(max(n) AS BIGINT) AS n, {_ADLER} AS adler, true AS alone FROM b GROUP BY doc_id")(run)


_deflated("inflate_stored_blocks", 0, zlib.Z_DEFAULT_STRATEGY, "stored")
_deflated("inflate_fixed_blocks", 6, zlib.Z_FIXED, "fixed")

# --- errors and metadata -----------------------------------------------------

_PIXEL = writers.png(1, 1, 8, 0, [b"\0\0"])


def _sof(marker: int, precision: int = 8, height: int = 8) -> bytes:
    return b"\xff\xd8" + writers.segment(marker, struct.pack(">BHHB", precision, height, 8, 1) + b"\x01\x11\0") + b"\xff\xd9"


def _with_header(at: int, value: bytes) -> bytes:
    data = bytearray(writers.bmp(2, 2, 24, bytes(16)))
    data[at : at + len(value)] = value
    return bytes(data)


#: name, file, error class, format
FAULTS: tuple[tuple[str, bytes, str, str | None], ...] = (
    ("empty", b"", "unknown", None), ("text", b"GIF89a", "unknown", None), ("half a mark", b"BM", "unknown", None), ("pam", b"P7\n", "unknown", None),
    ("png cut", _PIXEL[:40], "malformed", "PNG"), ("png checksum", _PIXEL[:29] + b"\0" + _PIXEL[30:], "malformed", "PNG"), ("png critical", writers.png(1, 1, 8, 0, [b"\0\0"], [(b"NEWc", b"")]), "unsupported", "PNG"),
    ("png index", writers.png(1, 1, 8, 3, [b"\0\7"], [(b"PLTE", bytes(9))]), "malformed", "PNG"), ("png no palette", writers.png(1, 1, 8, 3, [b"\0\0"]), "malformed", "PNG"), ("png filter", writers.png(1, 1, 8, 0, [b"\5\0"]), "malformed", "PNG"),
    ("png depth", writers.png(1, 1, 4, 2, [b"\0\0"]), "malformed", "PNG"), ("png rows", writers.png(1, 2, 8, 0, [b"\0\0"]), "malformed", "PNG"), ("png palette size", writers.png(1, 1, 8, 3, [b"\0\0"], [(b"PLTE", b"abcd")]), "malformed", "PNG"),
    ("png empty", writers.png(0, 1, 8, 0, [b"\0\0"]), "malformed", "PNG"), ("png huge", writers.png(60_000, 60_000, 8, 0, [b"\0\0"]), "malformed", "PNG"),
    ("bmp header", _with_header(14, b"\7"), "malformed", "BMP"), ("bmp bits", _with_header(28, b"\7"), "malformed", "BMP"), ("bmp compression", _with_header(30, b"\x63"), "malformed", "BMP"), ("bmp jpeg", _with_header(30, b"\4"), "unsupported", "BMP"),
    ("bmp rle bits", _with_header(30, b"\1"), "malformed", "BMP"), ("bmp planes", _with_header(26, b"\2"), "malformed", "BMP"), ("bmp cut", writers.bmp(2, 2, 24, bytes(8)), "malformed", "BMP"),
    ("pnm cut", b"P5 2 2 255\nab", "malformed", "PNM"), ("pnm over maxval", b"P2 1 1 15 16", "malformed", "PNM"), ("pnm maxval", b"P2 1 1 0 0", "malformed", "PNM"), ("pnm digit", b"P1 2 1 12", "malformed", "PNM"), ("pnm empty", b"P2 0 1 15 ", "malformed", "PNM"),
    ("jpeg lossless", _sof(0xC3), "unsupported", "JPEG"), ("jpeg arithmetic", _sof(0xC9), "unsupported", "JPEG"), ("jpeg 12 bits", _sof(0xC1, 12), "unsupported", "JPEG"), ("jpeg no scan", _sof(0xC0), "malformed", "JPEG"), ("jpeg late height", _sof(0xC0, 8, 0), "unsupported", "JPEG"),
    ("jpeg cut", b"\xff\xd8\xff\xc0\0\x20", "malformed", "JPEG"), ("webp lossy", writers.webp(b"x", b"VP8 "), "unsupported", "WebP"), ("webp none", writers.webp(b"x", b"ALPH"), "malformed", "WebP"),
    ("webp moving", writers.webp(b"x", before=b"VP8X" + struct.pack("<I", 10) + b"\x02" + bytes(9)), "unsupported", "WebP"), ("webp cut", writers.webp(b"\x2f\0"), "malformed", "WebP"),
)


@query("WITH f(name, kind, format) AS (VALUES " + ", ".join(f"('{n}', '{k}', {repr(f) if f else 'NULL'})" for n, _, k, f in FAULTS) + ") SELECT name, kind, format, false AS decoded, kind = 'unknown' AS raw FROM f")
def fault_classes(spark, sf_dir):
    """Files with one fault each: malformed, unsupported and unknown are told apart, and no file ends the job."""
    rows = spark.createDataFrame([(n, bytearray(d)) for n, d, _, _ in FAULTS], "image_id string, content binary")
    return decode.decode_images(rows).select(F.col("image_id").alias("name"), F.col("error.kind").alias("kind"), F.col("error.format").alias("format"), F.col("pixels").isNotNull().alias("decoded"), view.suggests_raw(F.col("error")).alias("raw"))


#: name, file, and what its metadata say
SHOWN: tuple[tuple[str, bytes, dict[str, str]], ...] = (
    ("bmp", writers.bmp(3, -2, 24, bytes(24)), {"format": "BMP", "width": "3", "height": "2", "bit_depth": "24", "is_lossless": "true", "has_transparency": "false"}),
    ("png", writers.png(2, 1, 8, 6, [b"\0" + bytes(8)], [(b"tEXt", b"Title\0a note"), (b"gAMA", struct.pack(">I", 45455)), (b"pHYs", struct.pack(">IIB", 2835, 2835, 1))]), {"format": "PNG", "bit_depth": "8", "channels": "4", "compression": "Deflate", "has_transparency": "true", "Title": "a note", "gamma": "0.45455", "dpi": "72", "interlace": "none", "filters": "None x 1"}),
    ("jpeg", _flat(bytes([200, 100, 50] * 512), ((2, 2), (1, 1), (1, 1)), True, extra=writers.segment(0xFE, b" note\x07 ")), {"format": "JPEG", "variant": "progressive", "width": "64", "height": "24", "channels": "3", "color_space": "YCbCr", "sampling": "4:2:0", "MCUs": "4 x 2", "restart interval": "3", "JFIF": "false", "comment": "note", "is_lossless": "false", "quantisation": "0: DC 8, mean 8.00"}),
    ("pnm", b"P5 2 1 1000\n" + bytes(4), {"format": "PNM", "width": "2", "height": "1", "maxval": "1000"}),
    ("webp", writers.webp(writers.vp8l(np.array([[0xFF010203]]), [(2, 0, None)])), {"format": "WebP", "variant": "VP8L", "width": "1", "cache bits": "0", "groups": "1"}),
)


@query("WITH f(name, key, value) AS (VALUES " + ", ".join(f"('{n}', '{k}', '{v}')" for n, _, m in SHOWN for k, v in m.items()) + ") SELECT name, key, value FROM f")
def image_metadata(spark, sf_dir):
    """Of small files the metadata that a reader of the format would state."""
    rows = spark.createDataFrame([(n, bytearray(d)) for n, d, _ in SHOWN], "image_id string, content binary")
    decoded = decode.decode_images(rows)
    plain = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in ("format", "variant", "width", "height", "bit_depth", "channels", "color_space", "compression", "is_lossless", "has_transparency")]
    listed = decoded.select(F.col("image_id").alias("name"), F.explode(F.concat(F.array(*plain), "extra")).alias("e")).select("name", "e.key", "e.value")
    return listed.join(F.broadcast(spark.createDataFrame([(n, k) for n, _, m in SHOWN for k in m], "name string, key string")), ["name", "key"])


# --- files in a folder -------------------------------------------------------

#: name, file, format and error class; names with a leading dot and unlisted extensions aren't taken.
FOLDER: tuple[tuple[str, bytes, str | None, str | None], ...] = (
    ("b.PNG", _PIXEL, "PNG", None), ("a.ppm", b"P3 1 1 255 1 2 3", "PNM", None), ("cut.png", _PIXEL[:40], None, "malformed"), ("lossy.webp", writers.webp(b"x", b"VP8 "), None, "unsupported"),
    ("raw.yuv", bytes(24), None, "unknown"), ("z.gif", b"GIF89a", None, None), (".hidden.png", _PIXEL, None, None),
)
_TAKEN = [f for f in FOLDER if not f[0].startswith(".") and not f[0].endswith("gif")]


def _folder(spark: SparkSession) -> str:
    """The files in a new folder: of the shared one that the session names, or on a local master of the machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
    path = f"{base}/files-{uuid.uuid4().hex}"
    images.write_files(spark, path, {name: data for name, data, _, _ in FOLDER})
    return path


_text = lambda v: f"'{v}'" if v else "CAST(NULL AS VARCHAR)"


@query("WITH f(name, length, extension, source) AS (VALUES " + ", ".join(f"('{n}', {len(d)}, '{n.rpartition('.')[2].lower()}', 'directory')" for n, d, _, _ in _TAKEN) + ") SELECT name, CAST(length AS BIGINT) AS length, extension, source FROM f")
def stored_files(spark, sf_dir):
    """Whole files of a folder, those of listed extensions in either case."""
    found = images.read_files(spark, _folder(spark))
    return found.select("name", F.octet_length("content").cast("long").alias("length"), bytesx.file_extension(F.col("name")).alias("extension"), "source")


@query("WITH f(name, format, kind) AS (VALUES " + ", ".join(f"('{n}', {_text(f)}, {_text(k)})" for n, _, f, k in _TAKEN) + ") SELECT name, format, kind FROM f")
def arriving_files(spark, sf_dir):
    """The folder as a stream, two files a batch, until all have been decoded."""
    name = f"arrived_{uuid.uuid4().hex}"
    stream = arrivals.decode_arrivals(spark, _folder(spark), files_per_trigger=2).select(F.col("image_id").alias("name"), "format", F.col("error.kind").alias("kind"))
    stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query("WITH s(seq, name) AS (VALUES (0, 'SOI'), (1, 'APP1'), (2, 'COM'), (3, 'DQT'), (4, 'SOF2'), (5, 'DHT'), (6, 'DHT'), (7, 'DRI'), (8, 'SOS')) SELECT CAST(seq AS INTEGER) AS seq, name FROM s")
def jpeg_segment_names(spark, sf_dir):
    """The segments of a progressive file by name, up to its first scan."""
    data = _flat(bytes(range(64)), ((1, 1),), True, extra=_EXIF + writers.segment(0xFE, b"note"))
    files = spark.createDataFrame([(0, bytearray(data))], "image_id long, content binary")
    return decode.jpeg_segments(files).where("seq <= 8").select("seq", "name")
