"""Column expressions over file bytes: words, previews, format and error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading bytes (hex), least length and name of each format, in the order in which they are asked.
MAGICS = (("424D", 14, "BMP"), ("89504E470D0A1A0A", 8, "PNG"), ("FFD8FF", 3, "JPEG"))
PNM_DIGITS = ("5031", "5032", "5033", "5034", "5035", "5036")


def byte_array(content: Column) -> Column:
    """array<int> of a binary column's bytes."""
    chars = F.split(F.decode(content, "ISO-8859-1"), "")
    return F.when(F.octet_length(content) > 0, F.transform(chars, lambda c: F.ascii(c))).otherwise(F.array().cast("array<int>"))


def unsigned(content: Column, at: int, n: int, little: bool = False) -> Column:
    """n bytes from ``at`` on, from 0, as a number; null beyond the end."""
    part = F.substring(content, at + 1, n)
    digits = F.hex(part)
    if little:
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(n - 1, -1, -1)])
    return F.when(F.octet_length(content) >= at + n, F.conv(digits, 16, 10).cast("long"))


def signed(value: Column, bits: int) -> Column:
    """An unsigned number of ``bits`` bits as two's complement."""
    return value - F.when(value >= (1 << (bits - 1)), F.lit(1 << bits)).otherwise(F.lit(0)).cast("long")


def latin1(content: Column, at: int, n: int) -> Column:
    return F.decode(F.substring(content, at + 1, n), "ISO-8859-1")


def sniff(content: Column) -> Column:
    """The format's name by the leading bytes, null if none is known. The extension is never asked."""
    head = F.hex(F.substring(content, 1, 14))
    found = [F.when((F.octet_length(content) >= n) & head.startswith(magic), F.lit(name)) for magic, n, name in MAGICS]
    webp = (F.octet_length(content) >= 12) & head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    return F.coalesce(*found, F.when(webp, F.lit("WebP")), F.when(F.substring(head, 1, 4).isin(*PNM_DIGITS), F.lit("PNM")))


def hex_preview(content: Column, n: int = 16) -> Column:
    """The first bytes in hex, and beside them as text with dots for what can't be printed."""
    head = F.substring(content, 1, n)
    spaced = F.rtrim(F.regexp_replace(F.hex(head), "(..)", "$1 "))
    shown = F.regexp_replace(F.decode(head, "ISO-8859-1"), "[^\\x20-\\x7E]", ".")
    return F.concat(spaced, F.lit("  |"), shown, F.lit("|"))


def error_class(format: Column, length: Column) -> Column:
    """What becomes of a file before decoding: empty, unknown (raw frames may be meant) or none."""
    return F.when(length == 0, "empty").when(format.isNull(), "unknown").otherwise("none")


def adler32_of(count: Column, total: Column, weighted: Column) -> Column:
    """Adler-32 from the number of bytes, their sum, and their sum weighted by n - i."""
    return F.pmod(count + weighted, F.lit(65521)) * 65536 + F.pmod(F.lit(1) + total, F.lit(65521))


def receive_extend(value: Column, n: Column) -> Column:
    """n bits as a signed magnitude: the lower half of the values are negative."""
    return F.when(n == 0, F.lit(0)).when(value < F.pow(F.lit(2), n - 1), value - F.pow(F.lit(2), n) + 1).otherwise(value).cast("long")


def file_extension(name: Column) -> Column:
    """Lower-cased text behind the last dot; empty without one."""
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/$", ""), "/"), -1)


def parent_path(path: Column) -> Column:
    """All before the last separator; the root stays the root, and a bare name has none."""
    bare = F.regexp_replace(path, "(?<=.)/$", "")
    return F.when(bare == "/", F.lit(None)).when(~bare.contains("/"), F.lit(None)).when(F.regexp_extract(bare, "^(.*)/", 1) == "", F.lit("/")).otherwise(F.regexp_extract(bare, "^(.*)/", 1))


def join_path(folder: Column, name: Column) -> Column:
    return F.concat(F.regexp_replace(folder, "/$", ""), F.lit("/"), name)


def byte_size_label(n: Column) -> Column:
    """B, KB or MB with one decimal, by 1024."""
    tenths = lambda unit: F.format_string("%.1f", F.floor(n * 10 / unit + 0.5) / 10)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(tenths(1024), F.lit(" KB"))).otherwise(F.concat(tenths(1024 * 1024), F.lit(" MB")))
