"""What a viewer shows of decoded images: metadata rows, probes, histograms, turned and scaled pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..codecs.model import MAX_PIXELS, MAX_SIDE
from ..functions import pixels as px

#: Scales that a view may have.
LEAST_SCALE, MOST_SCALE = 0.05, 64.0
#: Pixels of a square, and its two grays, behind transparent pixels.
SQUARE, DARK, LIGHT = 8, 204, 255
CHANNELS = ("r", "g", "b", "a")


def count_label(n: Column) -> Column:
    """A whole number with separators between thousands."""
    return F.format_number(n, 0)


def error_detail(error: Column) -> Column:
    """[format] message, and the offset in decimal and hex where there is one."""
    head = F.when(error["format"].isNotNull(), F.concat(F.lit("["), error["format"], F.lit("] "))).otherwise(F.lit(""))
    place = F.when(error["offset"].isNotNull(), F.concat(F.lit(" at "), error["offset"].cast("string"), F.lit(" (0x"), F.hex(error["offset"]), F.lit(")"))).otherwise(F.lit(""))
    return F.when(error.isNotNull(), F.concat(head, error["message"], place))


def read_failure(message: Column) -> Column:
    """Why a folder can't be listed: missing rights are told apart from all else."""
    return F.when(F.lower(message).rlike("permission denied|operation not permitted|access is denied"), F.lit("no right to read this folder")).otherwise(message)


def display_rows(images: DataFrame) -> DataFrame:
    """image_id, position, key and value: the metadata of decoded images in the order in which they are shown."""
    c = F.col
    fixed = [
        ("format", c("format")), ("variant", c("variant")), ("size", F.concat(c("width").cast("string"), F.lit(" x "), c("height").cast("string"))), ("pixels", count_label(c("width").cast("long") * c("height"))),
        ("bit depth", c("bit_depth").cast("string")), ("channels", c("channels").cast("string")), ("color space", c("color_space")), ("compression", c("compression")), ("lossless", F.when(c("is_lossless"), "yes").otherwise("no")), ("transparency", F.when(c("has_transparency"), "yes").otherwise("no")),
    ]
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    rows = F.concat(F.array(*[entry(k, v) for k, v in fixed]), F.coalesce(c("extra"), F.array().cast("array<struct<key:string,value:string>>")))
    return images.where("error IS NULL").select("image_id", F.posexplode(F.filter(rows, lambda r: r["value"].isNotNull())).alias("position", "e")).select("image_id", "position", "e.key", "e.value")


def transparency(pixels: DataFrame) -> DataFrame:
    """image_id and whether any pixel isn't opaque."""
    return pixels.groupBy("image_id").agg(F.bool_or(F.col("a") != 255).alias("has_transparency"))


def histogram(pixels: DataFrame) -> DataFrame:
    """image_id, channel, value and how many pixels have it."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in CHANNELS]))
    return pixels.select("image_id", each.alias("e")).groupBy("image_id", F.col("e.channel").alias("channel"), F.col("e.value").alias("value")).agg(F.count("*").alias("pixels"))


def probe(pixels: DataFrame, x: int, y: int) -> DataFrame:
    """image_id, the channels at a place and the pixel as 0xRRGGBBAA."""
    packed = px.pack(F.col("r"), F.col("g"), F.col("b"), F.col("a"))
    return pixels.where((F.col("x") == x) & (F.col("y") == y)).select("image_id", F.array(*CHANNELS).alias("channels"), packed.alias("rgba"))


def oriented(pixels: DataFrame, orientation: int) -> DataFrame:
    """Pixels with their image's width and height, turned and flipped as an EXIF orientation asks: a projection. Width and height are the new ones."""
    w, h = F.col("width"), F.col("height")
    x, y = px.orient(F.col("x"), F.col("y"), w, h, orientation)
    turned = (h, w) if orientation >= 5 else (w, h)
    return pixels.select("image_id", x.cast("int").alias("x"), y.cast("int").alias("y"), *CHANNELS, turned[0].alias("width"), turned[1].alias("height"))


def blank(sizes: DataFrame) -> DataFrame:
    """Transparent black images of given sizes (image_id, width, height), with pixels as decoded images have them; sizes out of bounds leave null."""
    n = F.col("width").cast("long") * F.col("height")
    fits = (F.col("width") > 0) & (F.col("height") > 0) & (F.col("width") <= MAX_SIDE) & (F.col("height") <= MAX_SIDE) & (n <= MAX_PIXELS)
    return sizes.select("image_id", "width", "height", F.when(fits, F.expr("unhex(repeat('00', CAST(4L * width * height AS INT)))")).alias("pixels"))


def with_pixel(pixels: DataFrame, x: int, y: int, rgba: tuple[int, int, int, int]) -> DataFrame:
    """Pixels with the one at a place replaced; a place outside an image changes nothing."""
    here = (F.col("x") == x) & (F.col("y") == y)
    return pixels.withColumns({c: F.when(here, F.lit(v)).otherwise(F.col(c)).cast("int") for c, v in zip(CHANNELS, rgba, strict=True)})


def with_metadata(images: DataFrame, **changes: Column) -> DataFrame:
    """Decoded images with some of their metadata replaced, the rest as it was."""
    unknown = [c for c in changes if c not in images.columns]
    if unknown:
        raise ValueError(f"no metadata {', '.join(unknown)}")
    return images.withColumns({c: v.cast(images.schema[c].dataType) for c, v in changes.items()})


def zoomed(scale: Column, factor: float) -> Column:
    """The scale after a step nearer or further away, within bounds."""
    return F.greatest(F.least(scale * factor, F.lit(MOST_SCALE)), F.lit(LEAST_SCALE))


def centred(width: Column, height: Column, view_width: int, view_height: int, scale: Column) -> tuple[Column, Column]:
    """Where the upper left corner of a scaled image lies if the centres of image and view agree."""
    return F.lit(view_width / 2) - scale * width / 2, F.lit(view_height / 2) - scale * height / 2


def suggests_raw(error: Column) -> Column:
    """Only a file that no decoder knows may be raw frames."""
    return F.coalesce(error["kind"] == "unknown", F.lit(False))


def fitted_scale(width: Column, height: Column, view_width: int, view_height: int, fill: bool = False) -> Column:
    """The scale at which an image fits into a view, or fills it."""
    wide, tall = F.lit(float(view_width)) / width, F.lit(float(view_height)) / height
    return F.greatest(F.least((F.greatest if fill else F.least)(wide, tall), F.lit(MOST_SCALE)), F.lit(LEAST_SCALE))


def enlarged(pixels: DataFrame, factor: int) -> DataFrame:
    """Every pixel as a square of factor x factor: nearest-neighbour scaling by a whole number."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    grown = pixels.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    return grown.select("image_id", (F.col("x") * factor + F.col("dx")).alias("x"), (F.col("y") * factor + F.col("dy")).alias("y"), *CHANNELS)


def reduced(pixels: DataFrame, factor: int) -> DataFrame:
    """The first pixel of every square of factor x factor."""
    return pixels.where((F.col("x") % factor == 0) & (F.col("y") % factor == 0)).select("image_id", px.div(F.col("x"), factor).cast("int").alias("x"), px.div(F.col("y"), factor).cast("int").alias("y"), *CHANNELS)


def over_checkerboard(pixels: DataFrame) -> DataFrame:
    """Opaque pixels: what isn't opaque is mixed with squares of two grays."""
    ground = F.when((px.div(F.col("x"), SQUARE) + px.div(F.col("y"), SQUARE)) % 2 == 1, DARK).otherwise(LIGHT)
    mixed = lambda c: px.div(F.col(c) * F.col("a") + ground * (255 - F.col("a")) + 127, 255).cast("int").alias(c)
    return pixels.select("image_id", "x", "y", *(mixed(c) for c in CHANNELS[:3]), F.lit(255).alias("a"))
