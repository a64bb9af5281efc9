"""Decoders against independent encoders, zlib and definitions."""

import struct
import zlib

import numpy as np
import pytest



from lumenrow.codecs import writers as e
from lumenrow.codecs import bmp, inflate, jpeg, model, png, pnm, registry, webp, yuv

RNG = np.random.default_rng(4)


@pytest.mark.parametrize("level", [0, 1, 6, 9])
def test_inflate(level):
    text = b"".join(RNG.choice([b"the ", b"of ", b"tion", bytes([7, 255, 3])], 4000)) + RNG.integers(0, 256, 3000, np.uint8).tobytes() + b"\0" * 5000
    packed = zlib.compress(text, level)
    found = inflate.inflate_zlib(packed + b"trailing")
    assert found.data == text and found.consumed == len(packed)
    assert (found.stored > 0) == (level == 0) and found.literals + found.matches > 0 or level == 0
    fixed = zlib.compressobj(9, zlib.DEFLATED, 15, 9, zlib.Z_FIXED)
    assert inflate.inflate_zlib(fixed.compress(text) + fixed.flush()).fixed > 0
    with pytest.raises(model.DecodeError):
        inflate.inflate_zlib(packed, limit=len(text) - 1)
    with pytest.raises(model.DecodeError):
        inflate.inflate_zlib(packed[:-1] + bytes([packed[-1] ^ 1]))
    with pytest.raises(model.DecodeError):
        inflate.inflate_zlib(packed[: len(packed) // 2])


def test_length_and_distance_tables():
    assert inflate.LENGTHS[0] == (3, 0) and inflate.LENGTHS[27] == (227, 5) and inflate.LENGTHS[28] == (258, 0) and len(inflate.LENGTHS) == 29
    assert inflate.DISTANCES[0] == (1, 0) and inflate.DISTANCES[29] == (24577, 13) and len(inflate.DISTANCES) == 30
    assert [c[1:] for c in sorted(model.canonical_codes([2, 1, 3, 3]))] == [(0b10, 2), (0, 1), (0b110, 3), (0b111, 3)]


@pytest.mark.parametrize("color,depth", [(c, d) for c, (_, _, depths) in png.COLOR_TYPES.items() for d in depths])
@pytest.mark.parametrize("interlace", [0, 1])
def test_png(color, depth, interlace):
    w, h, n = 13, 11, png.COLOR_TYPES[color][1]
    top = min(1 << depth, 5) if color == 3 else 1 << depth
    v = RNG.integers(0, top, (h, w, n))
    head, rows, kinds = png.Header(w, h, depth, color, bool(interlace)), [], 0
    for (x0, y0, dx, dy), _, _ in head.passes():
        part, lines = v[y0::dy, x0::dx], []
        for line in part:
            if depth == 16:
                lines.append([*line.ravel().astype(">u2").tobytes()])
            else:
                bits = "".join(f"{x:0{depth}b}" for x in line.ravel())
                bits += "0" * (-len(bits) % 8)
                lines.append([int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)])
        rows += e.filtered(lines, max(1, n * depth // 8), [(kinds + i) % 5 for i in range(len(lines))])
        kinds += 1
    palette = RNG.integers(0, 256, (5, 3), np.uint8)
    extra = [(b"PLTE", palette.tobytes()), (b"tRNS", b"\x10\x20")] if color == 3 else []
    key = v[2, 3]
    if color in (0, 2):
        extra = [(b"tRNS", key.astype(">u2").tobytes())]
    image = png.decode(e.png(w, h, depth, color, rows, extra, interlace))
    if color == 3:
        want = np.concatenate([palette[v[:, :, 0]], np.array([16, 32, 255, 255, 255], np.uint8)[v[:, :, :1]]], axis=2)
    else:
        s = (v * 255 + (32767 if depth == 16 else 0)) // ((1 << depth) - 1)
        alpha = s[:, :, -1] if color in (4, 6) else np.where((v == key).all(axis=2), 0, 255)
        want = np.dstack([s[:, :, 0]] * 3 + [alpha] if n < 3 else [s[:, :, 0], s[:, :, 1], s[:, :, 2], alpha])
    assert (image.pixels == want).all()


def test_png_faults():
    good = e.png(2, 2, 8, 0, [b"\0ab", b"\0cd"])
    assert png.decode(good + b"after the end").pixels[1, 1, 0] == ord("d")
    for at in (19, 35, len(good) - 20):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(model.DecodeError):
            png.decode(bytes(bad))
    with pytest.raises(model.DecodeError):
        png.decode(e.png(2, 2, 8, 3, [b"\0\0\1", b"\0\2\7"], [(b"PLTE", bytes(9))]))


@pytest.mark.parametrize("bpp", [1, 2, 4, 8, 24, 32, 16])
def test_bmp(bpp):
    w, h = 11, 5
    stride = (w * bpp + 31) // 32 * 4
    if bpp <= 8:
        index, palette = RNG.integers(0, min(1 << bpp, 20), (h, w)), RNG.integers(0, 256, (min(1 << bpp, 20), 4), np.uint8)
        bits = ((index[:, :, None] >> np.arange(bpp - 1, -1, -1)) & 1).reshape(h, -1).astype(np.uint8)
        body = b"".join(np.packbits(r).tobytes().ljust(stride, b"\0") for r in bits[::-1])
        image = bmp.decode(e.bmp(w, h, bpp, body, palette=palette.tobytes(), used=len(palette)))
        assert (image.pixels[:, :, :3] == palette[index][:, :, 2::-1]).all()
        return
    raw = RNG.integers(0, 256, (h, w, bpp // 8), np.uint8)
    body = b"".join(r.tobytes().ljust(stride, b"\0") for r in raw)
    p = bmp.decode(e.bmp(w, -h, bpp, body)).pixels
    if bpp >= 24:
        assert (p[:, :, :3] == raw[:, :, 2::-1]).all() and (bpp == 24 or (p[:, :, 3] == raw[:, :, 3]).all())
        if bpp == 32:
            raw[:, :, 3] = 0
            assert (bmp.decode(e.bmp(w, -h, 32, raw.tobytes())).pixels[:, :, 3] == 255).all()
    else:
        word = raw.view("<u2")[:, :, 0].astype(int)
        assert (p[:, :, 0] == ((word >> 10 & 31) * 255 + 15) // 31).all()
        q = bmp.decode(e.bmp(w, -h, 16, body, 3, masks=struct.pack("<III", 0xF800, 0x7E0, 0x1F))).pixels
        assert (q[:, :, 1] == ((word >> 5 & 63) * 255 + 31) // 63).all()
    assert bmp.extract(np.array([16]), 31)[0] == 132


def test_bmp_run_lengths():
    palette = bytes(range(64)) * 4
    body = bytes([3, 5, 0, 3, 1, 2, 3, 0, 0, 0, 0, 2, 1, 0, 2, 9, 0, 1])
    image = bmp.decode(e.bmp(6, 2, 8, body, 1, palette[:64]))
    assert bmp.run_lengths(body, 0, 6, 2, False).tolist() == [[5, 5, 5, 1, 2, 3], [0, 9, 9, 0, 0, 0]] and image.height == 2
    assert bmp.run_lengths(bytes([5, 0x12, 0, 1]), 0, 6, 1, True).tolist() == [[1, 2, 1, 2, 1, 0]]
    with pytest.raises(model.DecodeError):
        bmp.run_lengths(bytes([0, 9, 1]), 0, 6, 2, False)


def test_pnm():
    assert pnm.decode(b"P1 # c\n3 2\n101\n0 1 0").pixels[:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert pnm.decode(b"P2\n2 1 15\n0 1").pixels[0, 1].tolist() == [17, 17, 17, 255]
    assert pnm.decode(b"P3 1 1 255 1 2 3").pixels[0, 0].tolist() == [1, 2, 3, 255]
    assert pnm.decode(b"P4 9 1\n" + bytes([0b10000000, 0b10000000])).pixels[0, :, 0].tolist() == [0, *[255] * 7, 0]
    assert pnm.decode(b"P5 1 1 1000\n" + struct.pack(">H", 2000)).pixels[0, 0, 0] == 255
    assert pnm.decode(b"P6 1 1 255\nabc").pixels[0, 0].tolist() == [97, 98, 99, 255]
    for bad in (b"P2 2 1 15 0 16", b"P2 2 1 15 0", b"P5 2 2 255\nab", b"P2 0 1 15 ", b"P2 1 1 0 0", b"P1 2 1 12"):
        with pytest.raises(model.DecodeError):
            pnm.decode(bad)


def test_samples_written_by_hand():
    """Files and pixels as the formats' descriptions give them, not by the writers here."""
    red, green, blue, white = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (255, 255, 255, 255)
    # 2 x 2 RGB in one stored block: blue, white; red, green
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = bytes.fromhex("00 0000FF FFFFFF 00 FF0000 00FF00")
    stored = bytes.fromhex("7801 01 0E00 F1FF") + raw + struct.pack(">I", zlib.adler32(raw))
    file = bytes.fromhex("89504E470D0A1A0A") + chunk(b"IHDR", bytes.fromhex("00000002 00000002 08 02 00 00 00")) + chunk(b"IDAT", stored) + chunk(b"IEND", b"")
    image = png.decode(file, counted=True)
    assert len(file) == 82 and [tuple(p) for p in image.pixels.reshape(-1, 4).tolist()] == [blue, white, red, green]
    assert image.extra["deflate blocks"] == "stored x 1" and image.extra["filters"] == "None x 2" and image.extra["chunks"] == "3"
    for at in (19, 50, 76):
        bad = bytearray(file)
        bad[at] ^= 1
        with pytest.raises(model.DecodeError):
            png.decode(bytes(bad))
    # 2 x 2, 24 bits, the last row first and filled up to 8 bytes
    head = bytes.fromhex("424D 46000000 0000 0000 36000000 28000000 02000000 02000000 0100 1800 00000000 10000000 130B0000 130B0000 00000000 00000000")
    assert [tuple(p) for p in bmp.decode(head + bytes.fromhex("0000FF FFFFFF 0000 FF0000 00FF00 0000")).pixels.reshape(-1, 4).tolist()] == [blue, green, red, white]
    # the three ASCII kinds
    assert pnm.decode(b"P1\n# a ring's corner\n4 2\n0110\n1 0 0 1").pixels[:, :, 0].tolist() == [[255, 0, 0, 255], [0, 255, 255, 0]]
    assert pnm.decode(b"P2\n4 1\n15\n0 1 8 15").pixels[0, :, 0].tolist() == [0, 17, 136, 255]
    assert [tuple(p) for p in pnm.decode(b"P3\n2 1\n255\n255 0 0 0 255 0").pixels[0].tolist()] == [red, green]
    # one lossless WebP pixel: all five codes are single symbols
    bits = model.LsbBits(webp.decode(e.webp(e.vp8l(np.array([[0xFF102030]])))).pixels.tobytes())
    assert bits.aligned_bytes(4) == bytes([0x10, 0x20, 0x30, 0xFF])


def test_jpeg_faults():
    """DC sizes over 15, and a refinement whose run leads over the band's end."""
    one = np.zeros((1, 64), int)
    one[0, 0] = 5
    good = e.jpeg(8, 8, [(1, 1, 1, 0, one)], [[1] * 64])
    at = good.index(b"\xff\xda") + 10
    assert good[at] == 3 and jpeg.decode(good).pixels[0, 0, 0] == 129
    for size in (16, 40):
        with pytest.raises(model.DecodeError, match="DC size"):
            jpeg.decode(good[:at] + bytes([size]) + good[at + 1 :])
    reader = jpeg.ScanReader.__new__(jpeg.ScanReader)
    w = e.BitWriter(True)
    w.put(0x51, 8)  # five zeros, then a new coefficient: the band of three has no place for it
    w.put(1, 1)
    reader.bits, reader.run = model.MsbBits(w.bytes(1)), 0
    reader.scan = type("S", (), {"start": 1, "end": 3, "low": 0, "parts": [(None, 0, 0)]})()
    reader.code = lambda kind, table: type("C", (), {"read": staticmethod(lambda bits: bits.read(8))})()
    out = np.zeros(64, np.int16)
    reader.ac_refine(0, out)
    assert not out.any()


def test_yuv():
    data = bytes.fromhex("4C4C96964C4C9696552CFF15")
    assert yuv.decode(data, yuv.Options(4, 2, range="full")).pixels[0].tolist() == [[254, 0, 0, 255]] * 2 + [[0, 255, 1, 255]] * 2
    assert yuv.decode(data, yuv.Options(4, 2, "NV12", range="full")).pixels[0, 0].tolist() == [0, 151, 0, 255]
    c = {k: round(v, 3) for k, v in yuv.coefficients("BT.709", "limited").items()}
    assert (c["y"], c["rv"], c["gu"], c["gv"], c["bu"]) == (1.164, 1.793, 0.213, 0.533, 2.112)
    for name in yuv.FORMATS:
        o = yuv.Options(6, 4, name, frame=1)
        raw = RNG.integers(0, 256, o.frame_size * 2, np.uint8).tobytes()
        assert yuv.decode(raw, o).pixels.shape == (4, 6, 4)
        assert all(yuv.exact_height(w, name, yuv.Options(w, h, name).frame_size) == next(g for g in range(1, h + 1) if yuv.Options(w, g, name).frame_size == yuv.Options(w, h, name).frame_size) for w in (2, 6) for h in range(1, 40))
        assert yuv.exact_height(6, name, o.frame_size) in (3, 4) and yuv.largest_height(6, name, o.frame_size + 1) >= 4
    with pytest.raises(model.DecodeError):
        yuv.decode(b"ab", yuv.Options(4, 2))


def coefficients(n, spread=3):
    c = np.zeros((n, 64), int)
    c[:, 0] = RNG.integers(-60, 60, n)
    for k in range(1, 64):
        c[:, k] = np.where(RNG.random(n) < 0.25, RNG.integers(-spread * 4, spread * 4 + 1, n), 0)
    return c


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("factors", [((1, 1),), ((1, 1),) * 3, ((2, 1), (1, 1), (1, 1)), ((2, 2), (1, 1), (1, 1)), ((1, 2), (1, 1), (1, 1))])
@pytest.mark.parametrize("interval", [0, 2])
def test_jpeg_coefficients(factors, progressive, interval):
    w, h = 37, 29
    mh, mv = max(f[0] for f in factors), max(f[1] for f in factors)
    mw, mhh = -(-w // (8 * mh)), -(-h // (8 * mv))
    parts = [(i + 1, a, b, min(i, 1), coefficients(mw * a * mhh * b)) for i, (a, b) in enumerate(factors)]
    data = e.jpeg(w, h, parts, [range(1, 65), [3] * 64], interval, progressive)
    found = jpeg.read(data)
    for c, (_, _, _, _, want) in zip(found.frame.components, parts, strict=True):
        got, mask = c.coefs.reshape(c.padded_h, c.padded_w, 64), np.zeros((c.padded_h, c.padded_w), bool)
        mask[: c.blocks_h, : c.blocks_w] = True
        if not progressive and len(parts) > 1:
            mask[:] = True
        assert (got[mask] == want.reshape(got.shape)[mask]).all()
    image = jpeg.decode(data)
    assert image.pixels.shape == (h, w, 4) and image.variant == ("progressive" if progressive else "baseline")
    for cut in (len(data) // 2, len(data) - 3):  # a cut file still gives an image, or a classified error
        try:
            jpeg.decode(data[:cut])
        except model.DecodeError:
            pass


def test_jpeg_flat_blocks_and_parts():
    coefs = np.zeros((2, 64), int)
    coefs[0, 0], coefs[1, 0] = 8 * (200 - 128), 8 * (10 - 128)
    assert jpeg.decode(e.jpeg(16, 8, [(1, 1, 1, 0, coefs)], [[1] * 64])).pixels[3, ::8, 0].tolist() == [200, 10]
    exif = b"Exif\0\0II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0"
    turned = jpeg.decode(e.jpeg(16, 8, [(1, 1, 1, 0, coefs)], [[1] * 64], extra=e.segment(0xE1, exif) + e.segment(0xFE, b" note\x07 ")))
    assert (turned.width, turned.height, turned.pixels[0, 0, 0], turned.extra["comment"]) == (8, 16, 200, "note")
    blocks = RNG.integers(-300, 300, (200, 8, 8)) * (RNG.random((200, 8, 8)) < 0.3)
    assert np.abs(jpeg.idct(blocks).astype(int) - jpeg.idct_reference(blocks).astype(int)).max() <= 1
    assert jpeg.ZIGZAG[:8].tolist() == [0, 1, 8, 16, 9, 2, 3, 10] and jpeg.ZIGZAG[-1] == 63
    assert jpeg.color_space([1, 2, 3], False, None) == "YCbCr" and jpeg.color_space([82, 71, 66], False, None) == "RGB" and jpeg.color_space([1, 2, 3, 4], False, 2) == "YCCK"


def words(h, w):
    return RNG.integers(0, 1 << 32, (h, w)).astype(np.int64)


def argb(image):
    p = image.pixels.astype(np.int64)
    return p[:, :, 3] << 24 | p[:, :, 0] << 16 | p[:, :, 1] << 8 | p[:, :, 2]


def slow_predictor(rest, modes, bits):
    """The predictor undone pixel by pixel."""
    h, w = rest.shape
    out = np.zeros((h, w), np.int64)
    for y in range(h):
        for x in range(w):
            if y == 0:
                guess = out[0, x - 1] if x else 0xFF000000
            elif x == 0:
                guess = out[y - 1, 0]
            else:
                right = out[y - 1, x + 1] if x < w - 1 else out[y, 0]
                n = [webp.split(np.array([v])) for v in (out[y, x - 1], out[y - 1, x], out[y - 1, x - 1], right)]
                guess = int(webp.join(webp.predict(int(modes[y >> bits, x >> bits] >> 8 & 15), *n))[0])
            out[y, x] = webp.join(webp.split(np.array([rest[y, x]])) + webp.split(np.array([guess])))[0]
    return out


def test_webp():
    plain = words(9, 14)
    assert (argb(webp.decode(e.webp(e.vp8l(plain)))) == plain).all()
    green = argb(webp.decode(e.webp(e.vp8l(plain, [(2, 0, None)]))))
    c = webp.split(plain)
    assert (webp.split(green)[..., 1] == (c[..., 1] + c[..., 2]) % 256).all()
    modes = RNG.integers(0, 14, (3, 4)).astype(np.int64) << 8
    assert (argb(webp.decode(e.webp(e.vp8l(plain, [(0, 2, modes)])))) == slow_predictor(plain, modes, 2)).all()
    tiles = words(3, 4)
    crossed = webp.split(argb(webp.decode(e.webp(e.vp8l(plain, [(1, 2, tiles)])))))
    s8 = lambda v: (int(v) & 255) - (256 if int(v) & 128 else 0)
    for y, x in ((0, 0), (5, 9), (8, 13)):
        t, p = int(tiles[y >> 2, x >> 2]), [int(v) for v in c[y, x]]
        red = (p[1] + (s8(t) * s8(p[2]) >> 5)) & 255
        assert crossed[y, x].tolist() == [p[0], red, p[2], (p[3] + (s8(t >> 8) * s8(p[2]) >> 5) + (s8(t >> 16) * s8(red) >> 5)) & 255]
    colors, index = words(1, 3), RNG.integers(0, 3, (5, 10))
    packed = np.zeros((5, 3), np.int64)
    for x in range(10):
        packed[:, x // 4] |= index[:, x].astype(np.int64) << (x % 4 * 2) << 8
    steps = colors.copy()
    steps[0, 1:] = webp.join(webp.split(colors[0, 1:]) - webp.split(colors[0, :-1]))
    assert (argb(webp.decode(e.webp(e.vp8l(packed, [(3, 3, steps, 10)])))) == colors[0][index]).all()
    extended = e.webp(e.vp8l(plain), before=b"VP8X" + struct.pack("<I", 10) + b"\x10\0\0\0" + struct.pack("<I", 13)[:3] + struct.pack("<I", 8)[:3])
    assert webp.decode(extended).variant == "VP8X"
    for bad, kind in ((e.webp(b"x", b"VP8 "), "unsupported"), (e.webp(b"x", b"ALPH"), "malformed"), (e.webp(e.vp8l(plain)[:40]), "malformed")):
        with pytest.raises(model.DecodeError) as info:
            webp.decode(bad)
        assert info.value.kind == kind
    assert [webp.distance(2, k) for k in (1, 2, 120, 121)] == [2, 1, 22, 1] and len(webp.NEAR) == 120


def test_registry():
    for data, name in ((b"BM" + bytes(12), "BMP"), (png.SIGNATURE, "PNG"), (b"\xff\xd8\xff", "JPEG"), (b"RIFF0000WEBP", "WebP"), (b"P5", "PNM"), (b"P7", None), (b"", None), (b"BM", None)):
        found = registry.sniff(data)
        assert (found.name if found else None) == name
    with pytest.raises(model.DecodeError) as info:
        registry.decode(b"GIF89a")
    assert info.value.kind == "unknown" and registry.hex_preview(b"P5\n\xff") == "50 35 0A FF  |P5..|"
    for _ in range(300):  # malformed files are classified, whatever is in them
        seed = RNG.choice([e.png(2, 2, 8, 0, [b"\0ab", b"\0cd"]), e.bmp(3, 2, 24, bytes(24)), b"P2 2 2 9 1 2 3 4", e.jpeg(8, 8, [(1, 1, 1, 0, coefficients(1))], [[1] * 64]), e.webp(e.vp8l(words(2, 2)))])
        bad = bytearray(seed)
        for _ in range(3):
            bad[int(RNG.integers(0, len(bad)))] = int(RNG.integers(0, 256))
        try:
            registry.decode(bytes(bad))
        except model.DecodeError:
            pass
