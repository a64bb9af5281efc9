"""Queries over image operators, and DuckDB SQL for the same results.

Inputs are whole texts of the driver's tables taken as bytes (recipes.py). Each
query returns sums, plain and weighted by place, so that a pixel that is wrong
or moved shows.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..codecs import jpeg, png, webp, yuv
from ..functions import bytesx
from ..functions import pixels as px
from ..operators import decode
from .recipes import RASTER_WIDTH, SQL_BYTES, SQL_RASTER, arrays, byte_rows, contents, raster, sql_padded, sql_summed, sql_words, summed, table, value_sums, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


# --- format dispatch ---------------------------------------------------------

#: Leading bytes (hex) put before the texts, by doc_id modulo their number.
PREFIXES = ("424D", "89504E470D0A1A0A", "FFD8FF", "524946460000000057454250", "5035", "")


def _prefixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.element_at(F.array(*[F.unhex(F.lit(p)) for p in PREFIXES]), (F.col("doc_id") % len(PREFIXES) + 1).cast("int"))
    return contents(spark, sf_dir).select(F.col("doc_id").alias("image_id"), F.concat(head, "content").alias("content"))


_SQL_SNIFF = f"""WITH c AS (SELECT doc_id, ([{", ".join(f"'{p}'" for p in PREFIXES)}])[doc_id % {len(PREFIXES)} + 1] || hex(encode(text)) AS h FROM documents)"""
_SQL_FORMAT = """CASE WHEN length(h) >= 28 AND h LIKE '424D%' THEN 'BMP' WHEN h LIKE '89504E470D0A1A0A%' THEN 'PNG' WHEN h LIKE 'FFD8FF%' THEN 'JPEG'
    WHEN h LIKE '52494646________57454250%' THEN 'WebP' WHEN substr(h, 1, 4) IN ('5031', '5032', '5033', '5034', '5035', '5036') THEN 'PNM' END"""


@query(f"{_SQL_SNIFF} SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS length, {_SQL_FORMAT} AS format FROM c")
def sniff_format(spark, sf_dir):
    return decode.formats(_prefixed(spark, sf_dir)).select(F.col("image_id").alias("doc_id"), F.col("length").cast("long").alias("length"), "format")


@query(f"""WITH c AS (SELECT page_id, hex(encode(html)) AS h FROM pages) SELECT page_id, rtrim(regexp_replace(substr(h, 1, 32), '(..)', '\\1 ', 'g')) || '  |' ||
    array_to_string(list_transform(range(least(16, length(h) // 2)), lambda i: CASE WHEN substr(h, CAST(2 * i + 1 AS BIGINT), 2) >= '20' AND substr(h, CAST(2 * i + 1 AS BIGINT), 2) < '7F' THEN chr(CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER)) ELSE '.' END), '') || '|' AS preview FROM c""")
def hex_preview(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", bytesx.hex_preview(F.encode("html", "UTF-8")).alias("preview"))


@query(f"{_SQL_SNIFF}, f AS (SELECT CASE WHEN h = '' THEN 'empty' WHEN {_SQL_FORMAT} IS NULL THEN 'unknown' ELSE 'none' END AS error_class, {_SQL_FORMAT} AS format FROM c) SELECT error_class, format, count(*) AS files FROM f GROUP BY error_class, format")
def error_class(spark, sf_dir):
    return decode.formats(_prefixed(spark, sf_dir)).groupBy("error_class", "format").agg(F.count("*").alias("files"))


@query("""SELECT page_id, element_at_path AS name, CASE WHEN element_at_path LIKE '%.%' AND element_at_path NOT LIKE '%.' THEN lower(regexp_extract(element_at_path, '\\.([^.]+)$', 1)) ELSE '' END AS extension,
    regexp_extract(bare, '^(.*)/', 1) AS parent FROM (SELECT page_id, regexp_replace(url, '/$', '') AS bare, string_split(regexp_replace(url, '/$', ''), '/')[-1] AS element_at_path FROM pages)""")
def path_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", bytesx.basename(url).alias("name"), bytesx.file_extension(bytesx.basename(url)).alias("extension"), bytesx.parent_path(url).alias("parent"))


@query("""SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', floor(n * 10 / 1024 + 0.5) / 10) || ' KB' ELSE printf('%.1f', floor(n * 10 / 1048576 + 0.5) / 10) || ' MB' END AS label FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)""")
def byte_size_label(spark, sf_dir):
    return contents(spark, sf_dir).select("doc_id", bytesx.byte_size_label(F.octet_length("content")).alias("label"))


# --- bytes, bits, checksums --------------------------------------------------


@query(f"WITH {SQL_BYTES} SELECT doc_id, CAST((sum(n - i) * 0 + (max(n) + sum((n - i) * v)) % 65521) * 65536 + (1 + sum(v)) % 65521 AS BIGINT) AS adler FROM b GROUP BY doc_id")
def adler32(spark, sf_dir):
    rows = byte_rows(spark, sf_dir).groupBy("doc_id").agg(F.max("n").cast("long").alias("n"), F.sum("v").alias("total"), F.sum((F.col("n") - F.col("i")).cast("long") * F.col("v")).alias("weighted"))
    return rows.select("doc_id", bytesx.adler32_of(F.col("n"), F.col("total"), F.col("weighted")).cast("long").alias("adler"))


@query("""WITH RECURSIVE t(k, j, c) AS (SELECT k, 0, CAST(k AS BIGINT) FROM range(256) AS r(k) UNION ALL SELECT k, j + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END FROM t WHERE j < 8),
    l AS (SELECT list(c ORDER BY k) AS tbl FROM t WHERE j = 8), d AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents)
    SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, v: xor(a // 256, tbl[xor(a, v) % 256 + 1])), 4294967295) AS crc FROM d, l""")
def crc32(spark, sf_dir):
    return contents(spark, sf_dir).select("doc_id", F.crc32("content").alias("crc"))


@query(f"""WITH {sql_words(4)}, u AS (SELECT doc_id, b0 + 256 * b1 AS u16le, 256 * b0 + b1 AS u16be, b0 + 256 * b1 + 65536 * b2 + 16777216 * b3 AS u32le, b3 + 256 * b2 + 65536 * b1 + 16777216 * b0 AS u32be, b0 FROM w)
    SELECT doc_id, count(*) AS words, CAST(sum(u16le) AS BIGINT) AS u16le, CAST(sum(u16be) AS BIGINT) AS u16be, CAST(sum(u32le) AS BIGINT) AS u32le, CAST(sum(u32be) AS BIGINT) AS u32be, CAST(sum(u32le - CASE WHEN u32le >= 2147483648 THEN 4294967296 ELSE 0 END) AS BIGINT) AS i32le, CAST(sum(b0 - CASE WHEN b0 >= 128 THEN 256 ELSE 0 END) AS BIGINT) AS i8 FROM u GROUP BY doc_id""")
def word_reads(spark, sf_dir):
    w = words(spark, sf_dir, 4).select("doc_id", F.unhex(F.concat(*[F.lpad(F.hex(f"b{j}"), 2, "0") for j in range(4)])).alias("c"))
    u = lambda n, little: bytesx.unsigned(F.col("c"), 0, n, little)
    made = {"u16le": u(2, True), "u16be": u(2, False), "u32le": u(4, True), "u32be": u(4, False), "i32le": bytesx.signed(u(4, True), 32), "i8": bytesx.signed(u(1, False), 8)}
    return w.groupBy("doc_id").agg(F.count("*").alias("words"), *(F.sum(c).alias(n) for n, c in made.items()))


@query(f"WITH {SQL_BYTES}, e AS (SELECT doc_id, i, i % 9 AS n, v % CAST(pow(2, i % 9) AS BIGINT) AS v FROM b) SELECT doc_id, CAST(sum((i % 1009 + 1) * CASE WHEN n = 0 THEN 0 WHEN v < CAST(pow(2, n - 1) AS BIGINT) THEN v - CAST(pow(2, n) AS BIGINT) + 1 ELSE v END) AS BIGINT) AS total FROM e GROUP BY doc_id")
def receive_extend(spark, sf_dir):
    n = F.col("i") % 9
    rows = byte_rows(spark, sf_dir).select("doc_id", "i", n.alias("n"), F.pmod("v", F.pow(F.lit(2), n).cast("int")).alias("v"))
    return rows.groupBy("doc_id").agg(F.sum((F.col("i") % 1009 + 1) * bytesx.receive_extend(F.col("v"), F.col("n"))).alias("total"))


@query("""WITH c AS (SELECT doc_id, i AS symbol, n FROM (SELECT doc_id, least(15, greatest(1, CAST(length(text) % 7 AS INTEGER) + 6)) AS base FROM documents), LATERAL (SELECT i, base + CAST(i % 2 AS INTEGER) AS n FROM range(16) AS r(i)))
    SELECT doc_id, symbol, n AS length, CAST(sum(CAST(pow(2, 15 - n) AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY n, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CAST(pow(2, 15 - n) AS BIGINT) AS BIGINT) // CAST(pow(2, 15 - n) AS BIGINT) AS code FROM c""")
def huffman_canonical_codes(spark, sf_dir):
    """Codes in order of length and symbol: each begins where the code space used so far ends."""
    base = F.least(F.lit(15), F.char_length("text") % 7 + 6)
    rows = table(spark, sf_dir, "documents").select("doc_id", base.alias("base"), F.explode(F.sequence(F.lit(0), F.lit(15).cast("long"))).alias("symbol")).withColumn("length", (F.col("base") + F.col("symbol") % 2).cast("int"))
    room = F.pow(F.lit(2), 15 - F.col("length")).cast("long")
    used = F.sum(room).over(Window.partitionBy("doc_id").orderBy("length", "symbol").rowsBetween(Window.unboundedPreceding, 0)) - room
    return rows.select("doc_id", "symbol", "length", px.div(used, room).alias("code"))


# --- BMP ---------------------------------------------------------------------

MASKS = {"555": (0x7C00, 0x3E0, 0x1F), "565": (0xF800, 0x7E0, 0x1F), "444": (0xF00, 0xF0, 0xF)}


def _sql_mask(word: str, mask: int) -> str:
    shift = (mask & -mask).bit_length() - 1
    top = mask >> shift
    return f"(({word} // {1 << shift} % {top + 1}) * 255 + {top // 2}) // {top}"


@query(f"WITH {sql_words(2)}, z AS (SELECT doc_id, k, b0 + 256 * b1 AS word FROM w) " + sql_summed("doc_id", "k", "z", **{f"{c}{name}": _sql_mask("word", m) for name, masks in MASKS.items() for c, m in zip("rgb", masks, strict=True)}))
def bmp_channel_masks(spark, sf_dir):
    w = words(spark, sf_dir, 2).select("doc_id", "k", (F.col("b0") + 256 * F.col("b1")).alias("word"))
    return summed(w, ["doc_id"], F.col("k"), **{f"{c}{name}": px.mask_channel(F.col("word"), m) for name, masks in MASKS.items() for c, m in zip("rgb", masks, strict=True)})


@query(f"WITH {SQL_RASTER} SELECT doc_id, CAST(max(({RASTER_WIDTH} * 24 + 31) // 32 * 4) AS BIGINT) AS stride, CAST(sum(v * (((h - 1 - y) * {RASTER_WIDTH} + x) % 1009 + 1)) AS BIGINT) AS at_v FROM p GROUP BY doc_id")
def bmp_row_stride_flip(spark, sf_dir):
    shown = (F.col("h") - 1 - F.col("y")) * RASTER_WIDTH + F.col("x")
    return raster(spark, sf_dir).groupBy("doc_id").agg(F.max(F.lit((RASTER_WIDTH * 24 + 31) // 32 * 4).cast("long")).alias("stride"), F.sum(F.col("v") * (shown % 1009 + 1)).alias("at_v"))


_PALETTE = 12


@query(f"WITH {SQL_BYTES}, c AS (SELECT i AS idx, i * 21 AS r, 255 - i * 17 AS g, i * i AS bl FROM range({_PALETTE}) AS t(i)), j AS (SELECT b.*, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(bl, 0) AS bl, CASE WHEN r IS NULL THEN 1 ELSE 0 END AS out FROM b LEFT JOIN c ON b.v % 16 = c.idx) " + sql_summed("doc_id", "i", "j", r="r", g="g", b="bl", outside="out"))
def bmp_palette_join(spark, sf_dir):
    """Indexes without an entry are black and counted."""
    i = F.col("id")
    colors = spark.range(_PALETTE).select(i.alias("idx"), (i * 21).alias("r"), (255 - i * 17).alias("g"), (i * i).alias("b"))
    joined = byte_rows(spark, sf_dir).withColumn("idx", F.col("v") % 16).join(F.broadcast(colors), "idx", "left")
    return summed(joined, ["doc_id"], F.col("i"), r=F.coalesce("r", F.lit(0)), g=F.coalesce("g", F.lit(0)), b=F.coalesce("b", F.lit(0)), outside=F.col("r").isNull().cast("int"))


@query(f"WITH {sql_words(4)}, a AS (SELECT doc_id, k, CASE WHEN bool_or(b3 % 64 <> 0) OVER (PARTITION BY doc_id) THEN b3 % 64 ELSE 255 END AS alpha FROM w) " + sql_summed("doc_id", "k", "a", alpha="alpha"))
def bmp_implicit_alpha(spark, sf_dir):
    """A fourth byte is alpha only if it isn't zero in the whole image."""

    def alpha(v: np.ndarray) -> np.ndarray:
        a = v.reshape(-1, 4)[:, 3] % 64
        return a if a.any() else np.full(len(a), 255)

    return value_sums(spark, sf_dir, 4, alpha=alpha)


# --- PNM ---------------------------------------------------------------------


def _ascii_graymaps(spark: SparkSession, sf_dir: str, maxval: int) -> DataFrame:
    """doc_id, content: P2 files of the rasters with a comment in the header."""
    body = F.array_join(F.transform("b", lambda v: (v % (maxval + 1)).cast("string")), " ")
    return arrays(spark, sf_dir, RASTER_WIDTH).withColumn("h", F.expr(f"size(b) div {RASTER_WIDTH}")).select("doc_id", F.concat(F.lit(f"P2 # gray\n{RASTER_WIDTH} "), F.col("h").cast("string"), F.lit(f"\n{maxval}\n"), body).alias("content"))


@query(f"WITH {SQL_RASTER} SELECT doc_id, CAST(max(h) AS BIGINT) AS height, count(*) AS n, CAST(sum(((v % 100) * 255 + 49) // 99) AS BIGINT) AS sum_v, CAST(sum(((v % 100) * 255 + 49) // 99 * ((y * {RASTER_WIDTH} + x) % 1009 + 1)) AS BIGINT) AS at_v FROM p GROUP BY doc_id")
def pnm_ascii_decode(spark, sf_dir):
    """Tokens of an ASCII graymap without a UDF."""
    tokens = F.split(F.regexp_replace("content", "#[^\r\n]*", " "), "[ \\t\\n\\x0b\\f\\r]+")
    files = _ascii_graymaps(spark, sf_dir, 99).select("doc_id", tokens.alias("t"))
    rows = files.select("doc_id", F.get("t", F.lit(2)).cast("long").alias("height"), F.get("t", F.lit(3)).cast("long").alias("maxval"), F.posexplode(F.slice("t", 5, F.size("t"))).alias("i", "s"))
    v = px.maxval_scale(F.col("s").cast("long"), F.col("maxval"))
    return rows.groupBy("doc_id").agg(F.max("height").alias("height"), F.count("*").alias("n"), F.sum(v).alias("sum_v"), F.sum(v * (F.col("i") % 1009 + 1)).alias("at_v"))


_MAXVALS = (1, 15, 100, 255, 1000, 65535)


@query(f"WITH {SQL_BYTES} " + sql_summed("doc_id", "i", "b", **{f"m{m}": f"(least(v * 7, {m}) * 255 + {m // 2}) // {m}" for m in _MAXVALS}))
def pnm_maxval_scale(spark, sf_dir):
    return summed(byte_rows(spark, sf_dir), ["doc_id"], F.col("i"), **{f"m{m}": px.maxval_scale(F.col("v") * 7, F.lit(m)) for m in _MAXVALS})


# --- YUV ---------------------------------------------------------------------


@query("""WITH m(matrix, kr, kb) AS (VALUES ('BT.601', 0.299::DOUBLE, 0.114::DOUBLE), ('BT.709', 0.2126::DOUBLE, 0.0722::DOUBLE), ('BT.2020', 0.2627::DOUBLE, 0.0593::DOUBLE)), g("range", luma, chroma) AS (VALUES ('full', 1.0::DOUBLE, 1.0::DOUBLE), ('limited', 255.0::DOUBLE / 219, 255.0::DOUBLE / 224))
    SELECT matrix, "range", printf('%.4f', luma) AS y, printf('%.4f', 2 * (1 - kr) * chroma) AS rv, printf('%.4f', kb * 2 * (1 - kb) / (1 - kr - kb) * chroma) AS gu, printf('%.4f', kr * 2 * (1 - kr) / (1 - kr - kb) * chroma) AS gv, printf('%.4f', 2 * (1 - kb) * chroma) AS bu FROM m, g""")
def yuv_coefficients(spark, sf_dir):
    rows = [F.struct(F.lit(m).alias("matrix"), F.lit(r).alias("range"), *(F.format_string("%.4f", F.lit(c[k])).alias(k) for k in ("y", "rv", "gu", "gv", "bu"))) for m in yuv.MATRICES for r in ("full", "limited") for c in [yuv.coefficients(m, r)]]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("c")).select("c.*")


_SIZES = {name: (f"{'2 * w * h' if layout == 'packed' else f'w * h + 2 * ((w + {sx - 1}) // {sx}) * ((h + {sy - 1}) // {sy})'}") for name, (layout, sx, sy, _) in yuv.FORMATS.items()}


@query("WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n, CAST(doc_id % 30 + 2 AS BIGINT) AS w, CAST(doc_id % 17 + 1 AS BIGINT) AS h FROM documents), s AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS format, n, {v} AS frame_size FROM d" for k, v in _SIZES.items()) + ") SELECT doc_id, format, frame_size, n // frame_size AS frames, n % frame_size AS remainder, CASE WHEN n < frame_size THEN 'too short' WHEN n % frame_size = 0 THEN 'exact' ELSE 'left over' END AS feedback FROM s")
def yuv_frame_math(spark, sf_dir):
    """Frame sizes, frames and what is left over, for every layout."""
    w, h, n = F.col("w"), F.col("h"), F.col("n")
    ceil = lambda a, k: px.div(a + (k - 1), k)
    sizes = [F.struct(F.lit(name).alias("format"), (2 * w * h if layout == "packed" else w * h + 2 * ceil(w, sx) * ceil(h, sy)).alias("frame_size")) for name, (layout, sx, sy, _) in yuv.FORMATS.items()]
    rows = contents(spark, sf_dir).select("doc_id", F.octet_length("content").cast("long").alias("n"), (F.col("doc_id") % 30 + 2).alias("w"), (F.col("doc_id") % 17 + 1).alias("h")).select("doc_id", "n", F.explode(F.array(*sizes)).alias("s")).select("doc_id", "n", "s.*")
    size = F.col("frame_size")
    return rows.select("doc_id", "format", "frame_size", px.div(n, size).alias("frames"), (n % size).alias("remainder"), F.when(n < size, "too short").when(n % size == 0, "exact").otherwise("left over").alias("feedback"))


@query("""WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n, CAST(doc_id % 14 + 2 AS BIGINT) AS w FROM documents), h AS (SELECT doc_id, n, w, r.h, w * r.h + 2 * ((w + 1) // 2) * ((r.h + 1) // 2) AS size FROM d, range(1, 65536) AS r(h) WHERE w * r.h <= n)
    SELECT d.doc_id, coalesce(min(CASE WHEN size = d.n THEN h.h END), 0) AS exact_height, coalesce(max(CASE WHEN size <= d.n THEN h.h END), 0) AS largest_height FROM d LEFT JOIN h ON d.doc_id = h.doc_id GROUP BY d.doc_id""")
def yuv_guess_height(spark, sf_dir):
    """I420 heights of which one frame has just the length, and the greatest that fits: of h and h + 1 rows an even pair differs by a chroma row."""
    w, n = F.col("w"), F.col("n")
    rows = contents(spark, sf_dir).select("doc_id", F.octet_length("content").cast("long").alias("n"), (F.col("doc_id") % 14 + 2).alias("w"))
    size = lambda h: w * h + 2 * px.div(w + 1, 2) * px.div(h + 1, 2)
    about = px.div(n, w + px.div(w + 1, 2))
    near = F.filter(F.sequence(F.greatest(about - 3, F.lit(1)), F.greatest(about + 3, F.lit(1))), lambda h: (size(h) <= n) & (h <= 65535))
    exact = F.filter(near, lambda h: size(h) == n)
    return rows.select("doc_id", F.coalesce(F.array_min(exact), F.lit(0)).alias("exact_height"), F.coalesce(F.array_max(near), F.lit(0)).alias("largest_height"))


# --- PNG ---------------------------------------------------------------------


@query(f"WITH {sql_padded(48)}, u AS (SELECT doc_id, i, sum(v) OVER (PARTITION BY doc_id, i // 48, i % 3 ORDER BY i ROWS UNBOUNDED PRECEDING) % 256 AS u FROM pb) " + sql_summed("doc_id", "i", "u", u="u"))
def png_unfilter_sub(spark, sf_dir):
    """Sub is a running sum along the row, for each byte of a pixel; rows of 16 pixels."""
    return value_sums(spark, sf_dir, 48, u=lambda v: png.unfilter(v.reshape(-1, 48), np.full(len(v) // 48, 1), 3))


@query(f"WITH {SQL_RASTER}, u AS (SELECT doc_id, x, y, sum(v) OVER (PARTITION BY doc_id, x ORDER BY y ROWS UNBOUNDED PRECEDING) % 256 AS u FROM p) " + sql_summed("doc_id", f"y * {RASTER_WIDTH} + x", "u", u="u"))
def png_unfilter_up(spark, sf_dir):
    return value_sums(spark, sf_dir, RASTER_WIDTH, u=lambda v: png.unfilter(v.reshape(-1, RASTER_WIDTH), np.full(len(v) // RASTER_WIDTH, 2), 1))


@query(f"WITH {sql_words(3)}, p AS (SELECT *, abs(b1 - b2) AS pa, abs(b0 - b2) AS pb, abs(b0 + b1 - 2 * b2) AS pc FROM w) " + sql_summed("doc_id", "k", "p", guess="CASE WHEN pa <= pb AND pa <= pc THEN b0 WHEN pb <= pc THEN b1 ELSE b2 END", mean="(b0 + b1) // 2"))
def png_paeth_predict(spark, sf_dir):
    a, b, c = F.col("b0"), F.col("b1"), F.col("b2")
    return summed(words(spark, sf_dir, 3), ["doc_id"], F.col("k"), guess=px.paeth(a, b, c), mean=px.mean(a, b))


@query(f"WITH {sql_words(2)} " + sql_summed("doc_id", "k", "w", **{f"d{d}": f"(b0 // {256 >> d}) * {255 // ((1 << d) - 1)}" for d in (1, 2, 4)}, d16="((b0 * 256 + b1) * 255 + 32767) // 65535"))
def png_sample_scale(spark, sf_dir):
    top = {f"d{d}": px.depth_scale(F.shiftright(F.col("b0"), 8 - d), d) for d in (1, 2, 4)}
    return summed(words(spark, sf_dir, 2), ["doc_id"], F.col("k"), **top, d16=px.depth_scale(F.col("b0") * 256 + F.col("b1"), 16))


@query(f"WITH {SQL_RASTER}, k AS (SELECT *, first_value(v) OVER (PARTITION BY doc_id ORDER BY y, x) AS key FROM p) SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN v = key THEN 1 ELSE 0 END) AS BIGINT) AS transparent, bool_or(v = key) AS has_transparency FROM k GROUP BY doc_id")
def png_trns_key(spark, sf_dir):
    """Samples equal to a colour key, here the first pixel, are transparent."""
    key = F.first("v").over(Window.partitionBy("doc_id").orderBy("y", "x"))
    alpha = raster(spark, sf_dir).select("doc_id", F.when(F.col("v") == key, 0).otherwise(255).alias("a"))
    return alpha.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum((F.col("a") == 0).cast("long")).alias("transparent"), F.bool_or(F.col("a") != 255).alias("has_transparency"))


# Number, first column and row, and steps of each pass.
_SQL_ADAM7 = "a(pass, x0, y0, dx, dy) AS (VALUES (1, 0, 0, 8, 8), (2, 4, 0, 8, 8), (3, 0, 4, 4, 8), (4, 2, 0, 4, 4), (5, 0, 2, 2, 4), (6, 1, 0, 2, 2), (7, 0, 1, 1, 2))"


@query(f"""WITH {_SQL_ADAM7}, d AS (SELECT doc_id, CAST(doc_id % 50 + 1 AS BIGINT) AS w, CAST(octet_length(encode(text)) % 40 + 1 AS BIGINT) AS h FROM documents),
    g AS (SELECT doc_id, pass, CASE WHEN w > x0 THEN (w - x0 + dx - 1) // dx ELSE 0 END AS pw, CASE WHEN h > y0 THEN (h - y0 + dy - 1) // dy ELSE 0 END AS ph FROM d, a) SELECT doc_id, CAST(pass AS INTEGER) AS pass, pw AS width, ph AS height, ph * (1 + (pw * 3 * 8 + 7) // 8) AS raw_size FROM g WHERE pw > 0 AND ph > 0""")
def adam7_geometry(spark, sf_dir):
    """Sizes of the passes that aren't empty, for RGB of 8 bits."""
    rows = contents(spark, sf_dir).select("doc_id", (F.col("doc_id") % 50 + 1).alias("w"), (F.octet_length("content") % 40 + 1).cast("long").alias("h"))
    part = lambda size, first, step: F.when(size > first, px.div(size - first + step - 1, step)).otherwise(0)
    passes = [F.struct(F.lit(i + 1).alias("pass"), part(F.col("w"), x0, dx).cast("long").alias("width"), part(F.col("h"), y0, dy).cast("long").alias("height")) for i, (x0, y0, dx, dy) in enumerate(png.ADAM7)]
    made = rows.select("doc_id", F.explode(F.array(*passes)).alias("p")).select("doc_id", "p.*").where("width > 0 AND height > 0")
    return made.withColumn("raw_size", F.col("height") * (1 + px.div(F.col("width") * 24 + 7, 8)))


# --- JPEG --------------------------------------------------------------------


# The transform's weights in fixed point, each output sample's row over the eight frequencies.
_WEIGHTS = (
    (4096, 5681, 5352, 4816, 4096, 3218, 2217, 1130),
    (4096, 4816, 2217, -1131, -4096, -5682, -5351, -3219),
    (4096, 3218, -2217, -5682, -4096, 1130, 5351, 4816),
    (4096, 1130, -5352, -3219, 4096, 4816, -2217, -5682),
    (4096, -1130, -5352, 3219, 4096, -4816, -2217, 5682),
    (4096, -3218, -2217, 5682, -4096, -1130, 5351, -4816),
    (4096, -4816, 2217, 1131, -4096, 5682, -5351, 3219),
    (4096, -5681, 5352, -4816, 4096, -3218, 2217, -1130),
)


def _sql_idct() -> str:
    """Two passes of the integer transform over blocks of 64 bytes less 128, as sums over the transform's weights."""
    m = ", ".join(str((i, j, w)) for i, row in enumerate(_WEIGHTS) for j, w in enumerate(row))
    return f"""WITH {sql_padded(64)}, m(o, k, wt) AS (VALUES {m}), c AS (SELECT doc_id, i // 64 AS block, i % 64 // 8 AS r, i % 8 AS c, (v - 128) * 3 AS s FROM pb),
        q AS (SELECT doc_id, block, o AS r, c, CAST(floor((sum(s * wt) + 512) / 1024) AS BIGINT) AS s FROM c JOIN m ON c.r = m.k GROUP BY ALL),
        f AS (SELECT doc_id, block, r, o AS c, least(255, greatest(0, CAST(floor((sum(s * wt) + 65536 + 16777216) / 131072) AS BIGINT))) AS s FROM q JOIN m ON q.c = m.k GROUP BY ALL) """ + sql_summed("doc_id", "block * 64 + r * 8 + c", "f", s="s")


@query(_sql_idct())
def jpeg_idct_fast(spark, sf_dir):
    """Blocks of 64 bytes, in natural order, through the exact integer transform, all of a text's at once."""
    return value_sums(spark, sf_dir, 64, s=lambda v: jpeg.idct((v.astype(np.int64).reshape(-1, 8, 8) - 128) * 3))


_NATURAL = jpeg.ZIGZAG.tolist()


#: The order by its rule: along diagonals, upwards on even ones.
@query("""WITH z AS (SELECT row_number() OVER (ORDER BY x + y, CASE WHEN (x + y) % 2 = 0 THEN x ELSE y END) - 1 AS i, 8 * y + x AS place FROM range(8) AS r(x), range(8) AS q(y)),
    e AS (SELECT vec_id, CAST(round(embedding[i + 1]::DOUBLE * 1000) AS BIGINT) * (1 + i) AS v, place FROM embeddings, z) SELECT vec_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS sum_v, CAST(sum(v * (place + 1)) AS BIGINT) AS at_v FROM e GROUP BY vec_id""")
def jpeg_dequant_zigzag(spark, sf_dir):
    """Stored coefficients times their steps, put to their natural places."""
    coef = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long"))
    product = F.zip_with(coef, F.sequence(F.lit(1), F.lit(64)), lambda c, q: c * q)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(product).alias("k", "v"))
    natural = F.element_at(F.lit(_NATURAL), F.col("k") + 1)
    return rows.groupBy("vec_id").agg(F.count("*").alias("n"), F.sum("v").alias("sum_v"), F.sum(F.col("v") * (natural + 1)).alias("at_v"))


def _sql_ycc(y: str, cb: str, cr: str) -> dict[str, str]:
    shifted = lambda x: f"least(255, greatest(0, {y} + CAST(floor(({x} + 32768) / 65536) AS BIGINT)))"
    return {"r": shifted(f"({cr} - 128) * 91881"), "g": shifted(f"({cb} - 128) * -22554 + ({cr} - 128) * -46802"), "b": shifted(f"({cb} - 128) * 116130")}


@query(f"WITH {sql_words(3)} " + sql_summed("doc_id", "k", "w", **_sql_ycc("b0", "b1", "b2")))
def jpeg_color_ycc(spark, sf_dir):
    r, g, b = px.ycc_rgb(F.col("b0"), F.col("b1"), F.col("b2"))
    return summed(words(spark, sf_dir, 3), ["doc_id"], F.col("k"), r=r, g=g, b=b)


@query(f"WITH {sql_words(4)} " + sql_summed("doc_id", "k", "w", c="(255 - b0) * (255 - b3) // 255", m="b1 * b3 // 255", y="(255 - b2) * (255 - b3) // 255"))
def jpeg_color_cmyk(spark, sf_dir):
    """Inks to colours, plain (c, y) and as with an Adobe marker (m)."""
    parts = [F.col(f"b{j}") for j in range(4)]
    plain, adobe = px.cmyk_rgb(*parts, inverted=False), px.cmyk_rgb(*parts, inverted=True)
    return summed(words(spark, sf_dir, 4), ["doc_id"], F.col("k"), c=plain[0], m=adobe[1], y=plain[2])


def _upsampled(v: np.ndarray, down: int) -> np.ndarray:
    """The bytes as a chroma plane of half the width (and, with ``down`` of 2, height), at full size as the decoder has it."""
    plane = v.reshape(-1, RASTER_WIDTH)
    sizes = struct.pack(">BHHB", 8, down * len(plane), 2 * RASTER_WIDTH, 2) + bytes([1, 0x20 | down, 0, 2, 0x11, 0])
    frame = jpeg.parse_sof(0xC0, sizes, 0)
    return jpeg.upsample(plane, frame.components[1], frame)


def _sql_doubled(source: str, place: str, keys: str) -> str:
    near = lambda f: f"3 * v + coalesce({f}(v) OVER (PARTITION BY {keys} ORDER BY {place}), v)"
    return f"SELECT {keys}, 2 * {place} AS {place}, {near('lag')} AS v FROM {source} UNION ALL SELECT {keys}, 2 * {place} + 1, {near('lead')} FROM {source}"


@query(f"WITH {SQL_RASTER}, u AS ({_sql_doubled('p', 'x', 'doc_id, y')}) " + sql_summed("doc_id", f"y * {2 * RASTER_WIDTH} + x", "u", v="(v + 1 + x % 2) // 4"))
def jpeg_upsample_h2v1(spark, sf_dir):
    """Each sample twice along its row, near its left or right neighbour: 3 near + far, edges repeated."""
    return value_sums(spark, sf_dir, RASTER_WIDTH, v=lambda v: _upsampled(v, 1))


@query(f"WITH {SQL_RASTER}, t AS ({_sql_doubled('p', 'y', 'doc_id, x')}), u AS ({_sql_doubled('t', 'x', 'doc_id, y')}) " + sql_summed("doc_id", f"y * {2 * RASTER_WIDTH} + x", "u", v="(v + 8 - x % 2) // 16"))
def jpeg_upsample_h2v2(spark, sf_dir):
    return value_sums(spark, sf_dir, RASTER_WIDTH, v=lambda v: _upsampled(v, 2))


#: Where a pixel (x, y) of an image of 32 columns and h rows lands, by orientation: as it is, mirrored, half turned, flipped, and the same for the transposed image.
_SQL_ORIENT = ("y * 32 + x", "y * 32 + 31 - x", "(h - 1 - y) * 32 + 31 - x", "(h - 1 - y) * 32 + x", "x * h + y", "x * h + h - 1 - y", "(31 - x) * h + h - 1 - y", "(31 - x) * h + y")


@query(f"WITH {SQL_RASTER} SELECT doc_id, " + ", ".join(f"CAST(sum(v * (({place}) % 1009 + 1)) AS BIGINT) AS o{o}" for o, place in enumerate(_SQL_ORIENT, 1)) + " FROM p GROUP BY doc_id")
def jpeg_orientation(spark, sf_dir):
    """Every orientation as a projection of coordinates."""
    made = []
    for o, (swap, _, _) in jpeg.ORIENTATIONS.items():
        x, y = px.orient(F.col("x"), F.col("y"), F.lit(RASTER_WIDTH), F.col("h"), o)
        made.append(F.sum(F.col("v") * ((y * (F.col("h") if swap else F.lit(RASTER_WIDTH)) + x) % 1009 + 1)).cast("long").alias(f"o{o}"))
    return raster(spark, sf_dir).groupBy("doc_id").agg(*made)


@query("""WITH d AS (SELECT doc_id, CAST(octet_length(encode(text)) % 3000 + 1 AS BIGINT) AS w, CAST(doc_id % 700 + 1 AS BIGINT) AS h, CAST(doc_id % 2 + 1 AS BIGINT) AS sh, CAST(doc_id // 2 % 2 + 1 AS BIGINT) AS sv FROM documents)
    SELECT doc_id, (w + 8 * sh - 1) // (8 * sh) AS mcus_w, (h + 8 * sv - 1) // (8 * sv) AS mcus_h, (w + sh - 1) // sh AS chroma_w, (h + sv - 1) // sv AS chroma_h, ((w + sh - 1) // sh + 7) // 8 AS chroma_blocks_w, (w + 8 * sh - 1) // (8 * sh) * sh AS padded_w,
    CASE WHEN sh = 1 AND sv = 1 THEN '4:4:4' WHEN sh = 2 AND sv = 1 THEN '4:2:2' WHEN sh = 2 THEN '4:2:0' ELSE '1x2 1x1 1x1' END AS sampling FROM d""")
def jpeg_frame_geometry(spark, sf_dir):
    w, h, sh, sv = (F.col(c) for c in ("w", "h", "sh", "sv"))
    rows = contents(spark, sf_dir).select("doc_id", (F.octet_length("content") % 3000 + 1).cast("long").alias("w"), (F.col("doc_id") % 700 + 1).alias("h"), (F.col("doc_id") % 2 + 1).alias("sh"), (px.div(F.col("doc_id"), 2) % 2 + 1).alias("sv"))
    ceil = lambda a, b: px.div(a + b - 1, b)
    label = F.when((sh == 1) & (sv == 1), "4:4:4").when((sh == 2) & (sv == 1), "4:2:2").when(sh == 2, "4:2:0").otherwise("1x2 1x1 1x1")
    return rows.select("doc_id", ceil(w, 8 * sh).alias("mcus_w"), ceil(h, 8 * sv).alias("mcus_h"), ceil(w, sh).alias("chroma_w"), ceil(h, sv).alias("chroma_h"), ceil(ceil(w, sh), F.lit(8)).alias("chroma_blocks_w"), (ceil(w, 8 * sh) * sh).alias("padded_w"), label.alias("sampling"))


@query(f"WITH {SQL_BYTES}, d AS (SELECT doc_id, i, sum(v - 100) OVER (PARTITION BY doc_id, i // 40 ORDER BY i ROWS UNBOUNDED PRECEDING) AS dc FROM b) " + sql_summed("doc_id", "i", "d", dc="dc"))
def jpeg_dc_prediction(spark, sf_dir):
    """Differences to values by a running sum that starts anew every 40 units."""

    def values(v: np.ndarray) -> np.ndarray:
        steps = v.astype(np.int64) - 100
        rows = np.pad(steps, (0, -len(steps) % 40)).reshape(-1, 40)
        return np.cumsum(rows, axis=1).ravel()[: len(steps)]

    return value_sums(spark, sf_dir, 1, dc=values)


# --- WebP --------------------------------------------------------------------

_S8 = "({0} - CASE WHEN {0} >= 128 THEN 256 ELSE 0 END)"


def _sql_delta(factor: str, value: str) -> str:
    return f"CAST(floor({_S8.format(factor)} * {_S8.format(value)} / 32) AS BIGINT)"


@query(f"WITH {sql_words(6)}, r AS (SELECT *, (((b1 + {_sql_delta('b3', 'b0')}) % 256) + 256) % 256 AS red FROM w), z AS (SELECT *, (((b2 + {_sql_delta('b4', 'b0')} + {_sql_delta('b5', 'red')}) % 256) + 256) % 256 AS blue FROM r) " + sql_summed("doc_id", "k", "z", red="red", blue="blue"))
def webp_cross_color(spark, sf_dir):
    """Green foretells red, green and the new red foretell blue."""
    b = [F.col(f"b{j}") for j in range(6)]
    rows = words(spark, sf_dir, 6).withColumn("red", F.pmod(b[1] + px.color_delta(b[3], b[0]), F.lit(256)))
    rows = rows.withColumn("blue", F.pmod(b[2] + px.color_delta(b[4], b[0]) + px.color_delta(b[5], F.col("red")), F.lit(256)))
    return summed(rows, ["doc_id"], F.col("k"), red=F.col("red"), blue=F.col("blue"))


@query(f"WITH {sql_words(4)} " + sql_summed("doc_id", "k", "w", argb="b0 * 16777216 + ((b1 + b2) % 256) * 65536 + b2 * 256 + (b3 + b2) % 256"))
def webp_add_green(spark, sf_dir):
    a, r, g, b = (F.col(f"b{j}") for j in range(4))
    return summed(words(spark, sf_dir, 4), ["doc_id"], F.col("k"), argb=px.pack(a, r + g, g, b + g))


@query(f"WITH {sql_words(4)}, c AS (SELECT doc_id, k, " + ", ".join(f"sum(b{j}) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) % 256 AS c{j}" for j in range(4)) + " FROM w) " + sql_summed("doc_id", "k", "c", argb="c0 * 16777216 + c1 * 65536 + c2 * 256 + c3"))
def webp_color_map(spark, sf_dir):
    """Palette entries are running sums of their differences, channel by channel."""
    return value_sums(spark, sf_dir, 4, argb=lambda v: np.cumsum(v.reshape(-1, 4), axis=0, dtype=np.int64) % 256 @ np.array([1 << 24, 1 << 16, 1 << 8, 1]))


@query(f"WITH {sql_words(3)}, h AS (SELECT *, (b0 + b1) // 2 AS m FROM w) " + sql_summed("doc_id", "k", "h", full="least(255, greatest(0, b0 + b1 - b2))", half="least(255, greatest(0, m + sign(m - b2)::BIGINT * (abs(m - b2) // 2)))", mean="((b0 + b2) // 2 + b1) // 2", pick="CASE WHEN abs(b1 - b2) < abs(b0 - b2) THEN b0 ELSE b1 END"))
def webp_predict(spark, sf_dir):
    """The predictors that aren't one neighbour alone, on one channel."""
    left, top, corner = F.col("b0"), F.col("b1"), F.col("b2")
    return summed(words(spark, sf_dir, 3), ["doc_id"], F.col("k"), full=px.clamp(left + top - corner), half=px.clamp_half(left, top, corner), mean=px.mean(px.mean(left, corner), top), pick=F.when(F.abs(top - corner) < F.abs(left - corner), left).otherwise(top))


@query(f"WITH z(code, x, y) AS (VALUES {', '.join(str((i + 1, *p)) for i, p in enumerate(webp.NEAR))}), d AS (SELECT doc_id, CAST(doc_id % 60 + 1 AS BIGINT) AS w, octet_length(encode(text)) % 200 + 1 AS code FROM documents) SELECT doc_id, CAST(d.code AS BIGINT) AS code, CAST(CASE WHEN d.code > 120 THEN d.code - 120 ELSE greatest(1, z.y * w + z.x) END AS BIGINT) AS distance FROM d LEFT JOIN z ON d.code = z.code")
def webp_plane_distance(spark, sf_dir):
    """Short distance codes lie near the pixel in two dimensions."""
    near = spark.range(1).select(F.posexplode(F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in webp.NEAR])).alias("i", "p")).select((F.col("i") + 1).alias("code"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    rows = contents(spark, sf_dir).select("doc_id", (F.col("doc_id") % 60 + 1).alias("w"), (F.octet_length("content") % 200 + 1).alias("code"))
    far = F.when(F.col("code") > 120, F.col("code") - 120).otherwise(F.greatest(F.lit(1), F.col("y") * F.col("w") + F.col("x")))
    return rows.join(F.broadcast(near), "code", "left").select("doc_id", F.col("code").cast("long").alias("code"), far.cast("long").alias("distance"))


@query(f"WITH {sql_words(4)}, z AS (SELECT doc_id, k, b0 * 16777216 + b1 * 65536 + b2 * 256 + b3 AS argb FROM w) " + sql_summed("doc_id", "k", "z", slot=f"CAST((argb::HUGEINT * 506832829) % 4294967296 AS BIGINT) // 4194304"))
def webp_cache_slot(spark, sf_dir):
    a, r, g, b = (F.col(f"b{j}") for j in range(4))
    return summed(words(spark, sf_dir, 4), ["doc_id"], F.col("k"), slot=px.cache_slot(px.pack(a, r, g, b), 10))


# --- viewer ------------------------------------------------------------------


@query(f"WITH {SQL_RASTER} SELECT v AS value, count(*) AS pixels FROM p GROUP BY v")
def histogram(spark, sf_dir):
    return raster(spark, sf_dir).groupBy(F.col("v").alias("value")).agg(F.count("*").alias("pixels"))


@query(f"WITH {SQL_RASTER} " + sql_summed("doc_id", f"y * {RASTER_WIDTH} + x", "p", shown="CASE WHEN v % 2 = 0 THEN v ELSE CASE WHEN (x // 8 + y // 8) % 2 = 1 THEN 204 ELSE 255 END END"))
def checkerboard(spark, sf_dir):
    """Transparent pixels, here the odd values, show squares of 8 pixels."""
    square = F.when((px.div(F.col("x"), 8) + px.div(F.col("y"), 8)) % 2 == 1, 204).otherwise(255)
    return summed(raster(spark, sf_dir), ["doc_id"], F.col("y") * RASTER_WIDTH + F.col("x"), shown=F.when(F.col("v") % 2 == 0, F.col("v")).otherwise(square))


@query(f"""WITH {SQL_RASTER} SELECT doc_id, CAST(max(h) AS BIGINT) AS height, CAST(max(CASE WHEN x = 5 AND y = 0 THEN v * 16777216 + v * 65536 + v * 256 + 255 END) AS BIGINT) AS probe, least(640 / {RASTER_WIDTH}::DOUBLE, 480 / max(h)::DOUBLE, 64) AS fit, least(greatest(640 / {RASTER_WIDTH}::DOUBLE, 480 / max(h)::DOUBLE), 64) AS fill FROM p GROUP BY doc_id""")
def view_scale_and_probe(spark, sf_dir):
    """A pixel as 0xRRGGBBAA, and the scales at which an image fits or fills a view of 640 x 480."""
    v = F.col("v")
    rows = raster(spark, sf_dir).groupBy("doc_id").agg(F.max("h").cast("long").alias("height"), F.max(F.when((F.col("x") == 5) & (F.col("y") == 0), v * (1 << 24) + v * 65536 + v * 256 + 255)).alias("probe"))
    wide, tall = F.lit(640.0 / RASTER_WIDTH), F.lit(480.0) / F.col("height")
    bounded = lambda x: F.greatest(F.least(x, F.lit(64.0)), F.lit(0.05))
    return rows.select("doc_id", "height", "probe", bounded(F.least(wide, tall)).alias("fit"), bounded(F.greatest(wide, tall)).alias("fill"))


@query("SELECT conv_id, CAST(turn AS BIGINT) AS frame, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn, text) AS previous, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn, text) AS following FROM conversations")
def frames_by_turn(spark, sf_dir):
    """Frames of a sequence with the ones before and after them."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("frame"), F.octet_length("text").cast("long").alias("bytes"), F.lag("turn").over(w).alias("previous"), F.lead("turn").over(w).alias("following"))
