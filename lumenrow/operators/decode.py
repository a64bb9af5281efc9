"""Decoding whole files, and the relations inside them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codecs import inflate, jpeg, png, registry, webp, yuv
from ..codecs.model import DecodeError, Image
from ..functions import bytesx

MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")
#: Rows of parts that are sent at a time.
PART_ROWS = 4096
#: Bytes of JPEG files that are read together, about.
READ_BYTES = 1 << 21
ERROR = pa.struct([("kind", pa.string()), ("format", pa.string()), ("message", pa.string()), ("offset", pa.int64())])
_FIELDS = [
    ("format", pa.string()), ("variant", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("bit_depth", pa.int32()), ("channels", pa.int32()), ("color_space", pa.string()), ("compression", pa.string()),
    ("is_lossless", pa.bool_()), ("has_transparency", pa.bool_()), ("decode_micros", pa.int64()), ("extra", pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))), ("pixels", pa.binary()), ("error", ERROR),
]
_DDL = "format string, variant string, width int, height int, bit_depth int, channels int, color_space string, compression string, is_lossless boolean, has_transparency boolean, decode_micros long, extra array<struct<key: string, value: string>>, pixels binary, error struct<kind: string, format: string, message: string, offset: bigint>"


def _row(run: Callable[[], Image], mode: str, pixels: bool) -> dict:
    began = time.perf_counter()
    try:
        image = run()
    except DecodeError as e:
        if mode == "FAILFAST":
            raise
        return {"error": {"kind": e.kind, "format": e.format, "message": e.message, "offset": e.offset}}
    micros = int((time.perf_counter() - began) * 1e6)
    made = {k: getattr(image, k) for k in ("format", "variant", "width", "height", "bit_depth", "channels", "color_space", "compression", "is_lossless", "has_transparency")}
    return made | {"decode_micros": micros, "extra": [{"key": k, "value": str(v)} for k, v in image.extra.items()], "pixels": image.pixels.tobytes() if pixels else None}


def _mapped(files: DataFrame, columns: list[str], run: Callable[..., Image], mode: str, pixels: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"mode {mode}: one of {', '.join(MODES)}")
    kept = ["image_id", *keep]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carried = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            values = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
            # one file at a time, so that only its pixels are in memory twice
            for i, args in enumerate(zip(*values, strict=True)):
                row = _row(lambda: run(*args), mode, pixels)  # noqa: B023
                if mode == "DROPMALFORMED" and row.get("error"):
                    continue
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in carried), *(pa.array([row.get(k)], t) for k, t in _FIELDS)], names=[*kept, *(k for k, _ in _FIELDS)])

    ddl = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in kept)
    return files.select(*kept, *(c for c in columns if c not in kept)).mapInArrow(decoded, f"{ddl}, {_DDL}")


def decode_images(files: DataFrame, mode: str = "PERMISSIVE", pixels: bool = True, counted: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per file (image_id, content): metadata, pixels (RGBA, row by row) or a classified error.

    PERMISSIVE keeps failed files with their error, DROPMALFORMED leaves them
    out, FAILFAST ends the job. A null content counts as empty and is unknown.
    ``counted`` adds statistics of PNG's deflate blocks, for a walk over all of
    them. Columns named in ``keep`` are carried along, so that no join brings
    them back. Repeated ids and null ids stay, each file a row of its own; an
    empty table gives an empty result.
    """
    return _mapped(files, ["content"], lambda content: registry.decode(content or b"", counted), mode, pixels, keep)


def decode_frames(files: DataFrame, mode: str = "PERMISSIVE", pixels: bool = True) -> DataFrame:
    """Raw YUV: one row per file (image_id, content, options), options being width, height, format, matrix, range and frame_index.

    Options that are missing or unknown are an error of the file, as a frame
    beyond its end is. Repeated ids and null ids stay; an empty table gives an
    empty result.
    """

    def run(content: bytes, options: dict) -> Image:
        known = {k if k != "frame_index" else "frame": v for k, v in (options or {}).items() if v is not None}
        if known.get("format", "I420") not in yuv.FORMATS or not known.get("width") or not known.get("height"):
            raise DecodeError("options need width, height and a known format", yuv.NAME)
        if known.get("matrix", "BT.601") not in yuv.MATRICES or known.get("range", "limited") not in yuv.RANGES:
            raise DecodeError("options need a known matrix and range", yuv.NAME)
        return yuv.decode(content or b"", yuv.Options(**known))

    return _mapped(files, ["content", "options"], run, mode, pixels)


def frames(files: DataFrame) -> DataFrame:
    """One row per frame of raw YUV files: options with each frame_index the file holds."""
    o = F.col("options")
    planar = o["width"] * o["height"] + 2 * F.ceil(o["width"] / F.when(o["format"].isin("I444"), 1).otherwise(2)) * F.ceil(o["height"] / F.when(o["format"].isin("I444", "I422"), 1).otherwise(2))
    size = F.when(o["format"].isin("YUY2", "YVYU", "UYVY"), 2 * o["width"] * o["height"]).otherwise(planar)
    count = F.floor(F.octet_length("content") / size).cast("int")
    return files.where(count > 0).select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("frame_index")).withColumn("options", o.withField("frame_index", F.col("frame_index")))


def formats(files: DataFrame) -> DataFrame:
    """image_id, length, format, preview and error class, by the leading bytes alone."""
    c = F.coalesce(F.col("content"), F.lit(b""))
    return files.select("image_id", F.octet_length(c).alias("length"), bytesx.sniff(c).alias("format"), bytesx.hex_preview(c).alias("preview")).withColumn("error_class", bytesx.error_class(F.col("format"), F.col("length")))


def _parts(files: DataFrame, walk: Callable[[bytes], Iterator[tuple]], columns: list[tuple[str, pa.DataType, str]], keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per part that ``walk`` finds, with the columns of ``keep``; a malformed file yields its parts up to the fault."""
    kept = ["image_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carried = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            at, rows = [], []

            def sent() -> pa.RecordBatch:
                where = pa.array(at, pa.int64())  # noqa: B023
                return pa.RecordBatch.from_arrays([*(c.take(where) for c in carried), *(pa.array([r[k] for r in rows], t) for k, (_, t, _) in enumerate(columns))], names=[*kept, *(n for n, _, _ in columns)])  # noqa: B023

            for i, content in enumerate(batch.column(batch.schema.get_field_index("content"))):
                try:
                    for row in walk(content.as_py() or b""):
                        at.append(i)
                        rows.append(row)
                except DecodeError:
                    pass
                if len(rows) >= PART_ROWS:
                    yield sent()
                    at, rows = [], []
            yield sent()

    ddl = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in kept)
    return files.select(*kept, "content").mapInArrow(run, f"{ddl}, " + ", ".join(f"{n} {t}" for n, _, t in columns))


_SEQ, _OFFSET, _LENGTH = ("seq", pa.int32(), "int"), ("offset", pa.int64(), "long"), ("length", pa.int64(), "long")


def png_chunks(files: DataFrame) -> DataFrame:
    """image_id, seq, type, offset, length, crc_ok, critical and private of each PNG chunk."""
    walk = lambda data: ((c.seq, c.type, c.offset, c.length, c.crc_ok, c.type[0].isupper(), c.type[1].islower()) for c in png.chunks(data)) if png.matches(data) else iter(())
    flags = [(n, pa.bool_(), "boolean") for n in ("crc_ok", "critical", "private")]
    return _parts(files, walk, [_SEQ, ("type", pa.string(), "string"), _OFFSET, _LENGTH, *flags])


def jpeg_segments(files: DataFrame) -> DataFrame:
    """image_id, seq, marker, name, offset and length of each JPEG segment."""
    walk = lambda data: ((s.seq, s.marker, jpeg.marker_name(s.marker), s.offset, s.length) for s in jpeg.segments(data)) if jpeg.matches(data) else iter(())
    return _parts(files, walk, [_SEQ, ("marker", pa.int32(), "int"), ("name", pa.string(), "string"), _OFFSET, _LENGTH])


def webp_chunks(files: DataFrame) -> DataFrame:
    """image_id, seq, tag, offset and length of each RIFF chunk."""
    walk = lambda data: ((c.seq, c.tag, c.offset, c.length) for c in webp.chunks(data)) if webp.matches(data) else iter(())
    return _parts(files, walk, [_SEQ, ("tag", pa.string(), "string"), _OFFSET, _LENGTH])


def jpeg_quant(files: DataFrame) -> DataFrame:
    """image_id, table_id, k and q: quantisation steps in stored order, the last of a table winning."""

    def walk(data: bytes) -> Iterator[tuple]:
        found: dict = {}
        for s in jpeg.segments(data) if jpeg.matches(data) else ():
            if s.marker == 0xDB:
                found |= jpeg.parse_dqt(data[s.data_offset : s.data_offset + s.length], s.offset)
        return ((t, k, int(q)) for t, steps in found.items() for k, q in enumerate(steps))

    return _parts(files, walk, [("table_id", pa.int32(), "int"), ("k", pa.int32(), "int"), ("q", pa.int32(), "int")])


def jpeg_coefficients(files: DataFrame, keep: tuple[str, ...] = (), then: tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str] | None = None) -> DataFrame:
    """image_id, the columns of ``keep``, component, block and coef (64, stored order) of each block on the padded grid, an image's one after another.

    Files are read some at a time, so that their scans are walked together.
    Blocks are Arrow columns. ``then``, a step over their batches and the columns
    that it makes, is done in the same worker, so that sums needn't send 64
    numbers a block.
    """
    kept = ["image_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        def sent(carried: list[pa.Array], held: list[tuple]) -> Iterator[pa.RecordBatch]:
            at, ids, blocks, coefs = (np.concatenate(x) for x in zip(*held, strict=True))
            for i in range(0, len(at), PART_ROWS):
                part = slice(i, i + PART_ROWS)
                where, flat = pa.array(at[part]), pa.array(coefs[part].astype(np.int32).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 64, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([*(c.take(where) for c in carried), pa.array(ids[part]), pa.array(blocks[part]), lists], names=[*kept, "component", "block", "coef"])

        for batch in batches:
            carried = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            contents = batch.column(batch.schema.get_field_index("content"))
            sizes = pc.fill_null(pc.binary_length(contents), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = (np.cumsum(sizes) - sizes) // READ_BYTES
            for at in np.split(np.arange(len(group)), np.flatnonzero(np.diff(group)) + 1):
                files = [(i, data) for i in at.tolist() if jpeg.matches(data := contents[i].as_py() or b"")]
                held, rows = [], 0
                for (i, _), state in zip(files, jpeg.read_all([data for _, data in files]), strict=True):
                    if isinstance(state, DecodeError):
                        continue
                    frame = state.frame
                    sizes = [len(c.coefs) for c in frame.components]
                    ids, blocks = np.repeat(np.array([c.id for c in frame.components], np.int32), sizes), np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                    held.append((np.full(len(ids), i), ids, blocks, frame.coefs))
                    rows += len(ids)
                    if rows >= PART_ROWS:
                        yield from sent(carried, held)
                        held, rows = [], 0
                if held:
                    yield from sent(carried, held)

    ddl = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in kept)
    step, made = then or (lambda batches: batches, "component int, block int, coef array<int>")
    return files.select(*kept, "content").mapInArrow(lambda batches: step(run(batches)), made if then else f"{ddl}, {made}")


def inflated(files: DataFrame, wrapped: bool = True, limit: int = inflate.DEFAULT_LIMIT, keep: tuple[str, ...] = ()) -> DataFrame:
    """image_id, data and what each zlib (or raw deflate) stream was made of; streams that can't be read are left out."""
    run = inflate.inflate_zlib if wrapped else inflate.inflate

    def walk(data: bytes) -> Iterator[tuple]:
        f = run(data, limit=limit)
        yield f.data, f.stored, f.fixed, f.dynamic, f.literals, f.matches, f.consumed

    return _parts(files, walk, [("data", pa.binary(), "binary"), *((n, pa.int64(), "long") for n in ("stored", "fixed", "dynamic", "literals", "matches", "consumed"))], keep)


def pixels_of(images: DataFrame, sizes: bool = False) -> DataFrame:
    """image_id, x, y, r, g, b and a of every pixel of decoded images; with ``sizes`` also the image's width and height, so that no join brings them back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            ids, widths, blobs = (batch.column(i) for i in range(3))
            for i in range(batch.num_rows):
                w = widths[i].as_py()
                p = np.frombuffer(blobs[i].as_py(), np.uint8).reshape(-1, w, 4)
                for y0 in range(0, len(p), max(1, 65536 // w)):
                    part = p[y0 : y0 + max(1, 65536 // w)]
                    y, x = np.divmod(np.arange(part.shape[0] * w, dtype=np.int32), w)
                    flat = part.reshape(-1, 4).astype(np.int32)
                    size = [pa.array(np.full(len(x), n, np.int32)) for n in (w, len(p))] if sizes else []
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(len(x), i))), pa.array(x), pa.array(y + y0, pa.int32()), *(pa.array(flat[:, k]) for k in range(4)), *size], names=["image_id", "x", "y", "r", "g", "b", "a", "width", "height"][: 7 + len(size)])

    id_type = images.schema["image_id"].dataType.simpleString()
    return images.where("pixels IS NOT NULL").select("image_id", "width", "pixels").mapInArrow(run, f"image_id {id_type}, x int, y int, r int, g int, b int, a int" + ", width int, height int" * sizes)
