"""Queries over decoded images: texts written as graymaps, decoded, and looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decode, view
from .image_queries import query
from .recipes import SQL_BYTES, sql_summed, summed
from .round_trips import WIDTH, _pgm, written

#: The pixels of the graymaps: the text's bytes row by row, the last row filled with zeros.
_SQL_PIXELS = f"{SQL_BYTES}, s AS (SELECT doc_id, max(n) AS n FROM b GROUP BY doc_id), p AS (SELECT doc_id, i % {WIDTH} AS x, i // {WIDTH} AS y, v FROM b UNION ALL SELECT doc_id, unnest(range(n, (n + {WIDTH - 1}) // {WIDTH} * {WIDTH})) % {WIDTH}, (n - 1) // {WIDTH}, 0 FROM s)"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.decode_images(written(spark, sf_dir, _pgm))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.pixels_of(_images(spark, sf_dir))


@query(f"WITH {_SQL_PIXELS} SELECT c AS channel, CAST(CASE WHEN c = 'a' THEN 255 ELSE v END AS INTEGER) AS value, count(*) AS pixels FROM p, (VALUES ('r'), ('g'), ('b'), ('a')) AS k(c) GROUP BY ALL")
def channel_histogram(spark, sf_dir):
    per_image = view.histogram(_pixels(spark, sf_dir))
    return per_image.groupBy("channel", "value").agg(F.sum("pixels").alias("pixels"))


@query(f"WITH {_SQL_PIXELS}, g AS (SELECT doc_id, x + 1 AS w, y, v, x FROM p), z AS (SELECT doc_id, max(y) + 1 AS h FROM p GROUP BY doc_id), t AS (SELECT p.doc_id, h - 1 - y AS x, x AS y, h, v FROM p JOIN z ON p.doc_id = z.doc_id) " + sql_summed("doc_id", "y * h + x", "t", v="v"))
def rotated_pixels(spark, sf_dir):
    """Orientation 6: a quarter turn to the right, of pixels that carry their image's size."""
    images = _images(spark, sf_dir)
    turned = view.oriented(decode.pixels_of(images, sizes=True), 6).withColumnRenamed("image_id", "doc_id")
    return summed(turned, ["doc_id"], F.col("y") * F.col("width") + F.col("x"), v=F.col("g"))


@query(f"WITH {_SQL_PIXELS}, t AS (SELECT doc_id, x // 2 AS x, y // 2 AS y, v FROM p WHERE x % 2 = 0 AND y % 2 = 0) " + sql_summed("doc_id", f"y * {WIDTH} + x", "t", v="v"))
def reduced_pixels(spark, sf_dir):
    small = view.reduced(_pixels(spark, sf_dir), 2).withColumnRenamed("image_id", "doc_id")
    return summed(small, ["doc_id"], F.col("y") * WIDTH + F.col("x"), v=F.col("b"))


@query(f"WITH d AS (SELECT doc_id, (octet_length(encode(text)) + {WIDTH - 1}) // {WIDTH} AS h FROM documents WHERE octet_length(encode(text)) > 0) SELECT doc_id, '{WIDTH} x ' || h AS size, format('{{:,}}', CAST({WIDTH} * h AS BIGINT)) AS pixels, '255' AS maxval, CAST(13 AS BIGINT) AS rows FROM d")
def display_metadata(spark, sf_dir):
    """The rows that are shown of each image, brought side by side."""
    rows = view.display_rows(_images(spark, sf_dir))
    pick = lambda k: F.max(F.when(F.col("key") == k, F.col("value"))).alias(k)
    return rows.groupBy(F.col("image_id").alias("doc_id")).agg(pick("size"), pick("pixels"), pick("maxval"), F.count("*").alias("rows"))


@query("""SELECT page_id, 'unknown' AS kind, false AS decoded FROM pages""")
def unknown_pages(spark, sf_dir):
    """Web pages as files: no decoder claims them, and each says so as a value."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("image_id"), F.encode("html", "UTF-8").alias("content"))
    rows = decode.decode_images(pages)
    return rows.select(F.col("image_id").alias("page_id"), F.col("error.kind").alias("kind"), F.col("pixels").isNotNull().alias("decoded"))


@query("""WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents WHERE octet_length(encode(text)) > 100) SELECT doc_id, '[PNG] a chunk of ' || n || ' bytes at 33 (0x21)' AS detail FROM d""")
def error_details(spark, sf_dir):
    """Files cut in their second chunk: format, message and offset of the error."""
    from ..codecs import writers

    files = written(spark, sf_dir, lambda b: writers.png(1, 1, 8, 0, [b"\0\0"], [(b"noTe", b)])[:80]).where("n > 100")
    return decode.decode_images(files).select(F.col("image_id").alias("doc_id"), view.error_detail(F.col("error")).alias("detail"))


@query(f"WITH d AS (SELECT doc_id, (octet_length(encode(text)) + {WIDTH - 1}) // {WIDTH} AS h FROM documents WHERE octet_length(encode(text)) > 0), f AS (SELECT doc_id, h, least(640::DOUBLE / {WIDTH}, 480::DOUBLE / h, 64) * 1.25 AS z FROM d), c AS (SELECT doc_id, h, least(greatest(z, 0.05), 64) AS scale FROM f) SELECT doc_id, scale, 320 - scale * {WIDTH} / 2 AS x, 240 - scale * h / 2 AS y FROM c")
def view_zoom_and_centre(spark, sf_dir):
    """Images fitted into a view of 640 x 480, brought nearer by a quarter, and where their corners then lie."""
    images = _images(spark, sf_dir).select(F.col("image_id").alias("doc_id"), "width", "height")
    fit = F.least(F.lit(640.0) / F.col("width"), F.lit(480.0) / F.col("height"), F.lit(view.MOST_SCALE))
    zoomed = images.withColumn("scale", view.zoomed(fit, 1.25))
    x, y = view.centred(F.col("width"), F.col("height"), 640, 480, F.col("scale"))
    return zoomed.select("doc_id", "scale", x.alias("x"), y.alias("y"))


@query("SELECT t AS name, false AS is_directory, CAST(NULL AS VARCHAR) AS error FROM (VALUES ('benchmark'), ('conversations'), ('customer'), ('documents'), ('embeddings'), ('events'), ('labels'), ('lineitem'), ('nation'), ('orders'), ('pages'), ('part'), ('region'), ('supplier')) AS v(n), LATERAL (SELECT n || '.parquet' AS t) UNION ALL SELECT 'nowhere', false, 'no such folder'")
def directory_listing(spark, sf_dir):
    """The tables' own folder, in which a table may lie in parts, and one that isn't there: its failure is a row."""
    from ..sources import images

    found = images.list_directory(spark, sf_dir, ("parquet",), in_parts=True).select("name", "is_directory", "error")
    missing = images.list_directory(spark, f"{sf_dir}/nowhere").select("name", "is_directory", "error")
    return found.unionByName(missing)
