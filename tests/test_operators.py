"""Files through Spark: scans, decoding in its modes, relations inside files, and arrivals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrow.codecs import writers
from lumenrow.functions import bytesx
from lumenrow.functions import pixels as px
from lumenrow.operators import decode, view
from lumenrow.sources import images
from lumenrow.streaming import arrivals

GRAY = writers.png(2, 2, 8, 0, [b"\0ab", b"\0cd"])


@pytest.fixture
def folder(tmp_path):
    for name, data in (("b.PNG", GRAY), ("a.ppm", b"P3 1 1 255 1 2 3"), ("cut.png", GRAY[:40]), ("z.gif", b"GIF89a"), ("lossy.webp", writers.webp(b"x", b"VP8 ")), (".hidden.png", GRAY)):
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def files(spark, *contents):
    return spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "image_id int, content binary")


def test_listing_and_reading(spark, folder):
    assert [r["name"] for r in images.list_files(spark, folder).collect()] == ["a.ppm", "b.PNG", "cut.png", "lossy.webp"]
    assert images.read_files(spark, folder).count() == 4 and images.read_files(spark, folder, extensions=None).count() == 5


def test_modes(spark, folder):
    found = images.read_files(spark, folder, extensions=None).withColumn("image_id", F.col("name"))
    rows = {r["image_id"]: r for r in decode.decode_images(found).collect()}
    assert bytes(rows["b.PNG"]["pixels"])[:4] == b"aaa\xff" and rows["a.ppm"]["width"] == 1 and not rows["a.ppm"]["has_transparency"]
    assert {k: r["error"]["kind"] for k, r in rows.items() if r["error"]} == {"cut.png": "malformed", "z.gif": "unknown", "lossy.webp": "unsupported"}
    assert decode.decode_images(found, "DROPMALFORMED").count() == 2
    with pytest.raises(Exception, match="DecodeError"):
        decode.decode_images(found, "FAILFAST").count()
    assert decode.pixels_of(decode.decode_images(found)).where("image_id = 'b.PNG' AND x = 1 AND y = 1 AND r = 100").count() == 1
    assert bytes(images.as_ppm(decode.decode_images(found)).where("image_id = 'a.ppm'").first()["content"]) == b"P6\n1 1\n255\n\x01\x02\x03"


def test_null_and_empty_contents(spark):
    df = files(spark, None, b"", GRAY)
    assert [r["error"]["kind"] if r["error"] else None for r in decode.decode_images(df).orderBy("image_id").collect()] == ["unknown", "unknown", None]
    assert [r["error_class"] for r in decode.formats(df).orderBy("image_id").collect()] == ["empty", "empty", "none"]
    for relation in (decode.png_chunks, decode.jpeg_segments, decode.webp_chunks, decode.jpeg_quant, decode.jpeg_coefficients):
        assert relation(df.limit(0)).count() == 0


def test_frames(spark):
    options = "named_struct('width', 4, 'height', 2, 'format', 'I420', 'matrix', 'BT.601', 'range', 'full', 'frame_index', 0)"
    df = files(spark, bytes.fromhex("4C4C96964C4C9696552CFF15") * 2 + b"x").withColumn("options", F.expr(options))
    rows = decode.decode_frames(decode.frames(df)).collect()
    assert len(rows) == 2 and all(bytes(r["pixels"])[:3] == bytes([254, 0, 0]) for r in rows)
    missing = decode.decode_frames(df.withColumn("options", F.col("options").withField("frame_index", F.lit(2)))).first()
    assert missing["error"]["kind"] == "malformed"


def test_jpeg_relations(spark):
    coefs = np.zeros((2, 64), int)
    coefs[0, 0], coefs[1, 0] = 8 * (200 - 128), 8 * (10 - 128)
    df = files(spark, writers.jpeg(16, 8, [(1, 1, 1, 0, coefs)], [[1] * 64]))
    assert [f"{r['marker']:X}" for r in decode.jpeg_segments(df).orderBy("seq").collect()] == ["D8", "DB", "C0", "C4", "C4", "DA", "D9"]
    joined = decode.jpeg_coefficients(df).join(decode.jpeg_quant(df).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("k", "q"))).alias("steps")), "image_id")
    natural = F.zip_with("coef", "steps", lambda c, s: c * s["q"])
    got = {r["block"]: {*r["s"]} for r in joined.select("block", px.idct_block(natural).alias("s")).collect()}
    assert got == {0: {200}, 1: {10}}


def test_paths(spark):
    rows = spark.createDataFrame([("/",), ("/a",), ("/a/b.TAR.gz",), ("/a/b/",), ("x",), ("n.",)], "p string")
    got = rows.select("p", bytesx.parent_path(F.col("p")).alias("parent"), bytesx.file_extension(F.col("p")).alias("ext"), bytesx.join_path(F.lit("/d/"), F.lit("n")).alias("joined")).collect()
    assert [(r["parent"], r["ext"]) for r in got] == [(None, ""), ("/", ""), ("/a", "gz"), ("/a", ""), (None, ""), (None, "")]
    assert got[0]["joined"] == "/d/n"


def test_arrivals(spark, folder, tmp_path):
    out = arrivals.decode_arrivals(spark, folder, mode="DROPMALFORMED")
    query = out.select("image_id", "format").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r["image_id"], r["format"]) for r in spark.table("arrived").collect()} == {("b.PNG", "PNG"), ("a.ppm", "PNM")}


def test_directory_listing(spark, folder, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "A2.bmp").write_bytes(b"BM")
    rows = images.list_directory(spark, folder).collect()
    assert [(r["name"], r["is_directory"]) for r in rows] == [("sub", True), ("a.ppm", False), ("A2.bmp", False), ("b.PNG", False), ("cut.png", False), ("lossy.webp", False)]
    assert rows[2]["size_bytes"] == 2 and rows[0]["size_bytes"] is None and all(r["error"] is None for r in rows)
    missing = images.list_directory(spark, folder + "/none").collect()
    assert len(missing) == 1 and missing[0]["error"] == "no such folder"
    assert "pam" in images.EXTENSIONS and len(images.EXTENSIONS) == 22


def test_tables_in_parts_are_listed_as_files(spark, tmp_path):
    """A table that Spark wrote is a folder; an empty folder of that name is none, nor is any without being asked."""
    spark.range(10).repartition(2).write.parquet(f"{tmp_path}/made.parquet")
    spark.range(4).selectExpr("id", "id % 2 AS k").write.partitionBy("k").parquet(f"{tmp_path}/keyed.parquet")
    spark.range(1).coalesce(1).write.parquet(f"{tmp_path}/other")
    (tmp_path / "empty.parquet").mkdir()
    (tmp_path / "one.parquet").write_bytes(b"PAR1")
    found = {r["name"]: r for r in images.list_directory(spark, str(tmp_path), ("parquet",), in_parts=True).collect()}
    assert {k: r["is_directory"] for k, r in found.items()} == {"made.parquet": False, "keyed.parquet": False, "one.parquet": False, "other": True, "empty.parquet": True}
    assert found["made.parquet"]["size_bytes"] == sum(f.stat().st_size for f in (tmp_path / "made.parquet").glob("part-*")) and found["other"]["size_bytes"] is None
    plain = images.list_directory(spark, str(tmp_path), ("parquet",)).collect()
    assert {r["name"]: r["is_directory"] for r in plain} == {"made.parquet": True, "keyed.parquet": True, "one.parquet": False, "other": True, "empty.parquet": True}


def test_directory_query_reads_tables_in_parts(spark, tmp_path):
    from lumenrow.plans import view_queries

    spark.range(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in view_queries.directory_listing(spark, str(tmp_path)).collect()} == {("documents.parquet", False, None), ("nowhere", False, "no such folder")}


def test_images_are_changed_by_expressions(spark):
    decoded = decode.decode_images(files(spark, GRAY), keep=())
    pixels = view.with_pixel(decode.pixels_of(decoded, sizes=True), 1, 0, (1, 2, 3, 4))
    got = {(r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in pixels.collect()}
    assert got == {(0, 0): (97, 97, 97, 255), (1, 0): (1, 2, 3, 4), (0, 1): (99, 99, 99, 255), (1, 1): (100, 100, 100, 255)}
    turned = {(r["x"], r["y"]): r["r"] for r in view.oriented(pixels, 6).collect()}
    assert turned == {(1, 0): 97, (1, 1): 1, (0, 0): 99, (0, 1): 100}
    assert view.with_metadata(decoded, variant=F.lit("own")).first()["variant"] == "own"
    with pytest.raises(ValueError, match="no metadata"):
        view.with_metadata(decoded, none=F.lit(1))
    made = view.blank(spark.createDataFrame([(1, 2, 3), (2, 0, 3), (3, 70_000, 1)], "image_id int, width int, height int")).collect()
    assert [r["pixels"] and bytes(r["pixels"]) for r in made] == [bytes(24), None, None]


def test_frame_options_are_checked(spark):
    """Unknown matrix, range or layout is an error of the file."""
    ddl = "image_id int, content binary, options struct<width: int, height: int, format: string, matrix: string, range: string, frame_index: int>"
    rows = [(0, bytes(24), (4, 4, "I420", "BT.601", "full", 0)), (1, bytes(24), (4, 4, "I420", "BT.999", "full", 0)), (2, bytes(24), (4, 4, "I420", "BT.601", "wide", 0)), (3, bytes(24), (4, 4, "X", "BT.601", "full", 0)), (4, bytes(24), None), (5, bytes(24), (4, 4, "I420", "BT.601", "full", 1))]
    got = {r["image_id"]: r["error"] for r in decode.decode_frames(spark.createDataFrame(rows, ddl)).collect()}
    assert got[0] is None and all(got[i]["kind"] == "malformed" for i in range(1, 6)) and "1 of 1" in got[5]["message"]
