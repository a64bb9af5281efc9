"""Scans walked by tables against the same read bit by bit, and what the queries over coefficients cost."""

import time

import numpy as np
import pytest

from lumenrow.codecs import jpeg, model, writers
from lumenrow.plans import decoded_queries, round_trips

RNG = np.random.default_rng(11)
FACTORS = (((1, 1),), ((2, 1), (1, 1), (1, 1)), ((2, 2), (1, 1), (1, 1)), ((2, 1), (1, 2), (1, 1), (2, 2)))


def image(factors, width, height, density, spread):
    mh, mv = max(h for h, _ in factors), max(v for _, v in factors)
    units = -(-width // (8 * mh)) * -(-height // (8 * mv))
    parts = []
    for i, (h, v) in enumerate(factors):
        n = units * h * v
        coefs = np.where(RNG.random((n, 64)) < density, RNG.integers(-spread, spread + 1, (n, 64)), 0)
        coefs[:, 0] = RNG.integers(-1000, 1000, n)
        parts.append((i + 1, h, v, 0, coefs))
    return width, height, parts


def outcome(data, walk):
    try:
        state = jpeg.read(data, walk)
    except model.DecodeError as e:
        return e.message, e.offset
    return state.scans, [c.coefs.tolist() for c in state.frame.components]


def damaged(data):
    """Cut, or with some bytes behind the first scan's header changed to markers, stuffing or anything."""
    out, first = bytearray(data), data.index(b"\xff\xda") + 4
    if RNG.random() < 0.3:
        return bytes(out[: int(RNG.integers(first, len(out)))])
    for _ in range(int(RNG.integers(1, 5))):
        out[int(RNG.integers(first, len(out)))] = int(RNG.choice([0, 255, 0xD0, RNG.integers(256)]))
    return bytes(out)


@pytest.mark.parametrize("progressive", [False, True])
def test_walk_finds_what_the_reader_finds(progressive):
    """In whole and in damaged files, also where zero bits are no code or codes are long."""
    kinds = set()
    for n in range(120):
        data = writers.jpeg(*image(FACTORS[n % 4], int(RNG.integers(1, 60)), int(RNG.integers(1, 40)), (0, 0.05, 0.3, 0.9)[n // 4 % 4], (2, 130)[n % 2]), [[1] * 64], (0, 1, 3)[n % 3], progressive)
        if n % 3 == 1:  # three short codes, the others have twelve bits
            at = data.index(b"\xff\xc4\x01\x11\x10") + 5
            data = data[:at] + bytes([1, 1, 1] + [0] * 8 + [251] + [0] * 4) + data[at + 16 :]
        for tried in (data, damaged(data), damaged(data)):
            want = outcome(tried, jpeg.ScanReader)
            assert outcome(tried, jpeg.ScanWalk) == want
            kinds.add(isinstance(want[0], str))
    assert kinds == {False, True}


@pytest.mark.parametrize("progressive", [False, True])
def test_files_written_together(progressive):
    made = [image(FACTORS[1], w, h, d, 40) for w, h, d in ((8, 8, 0.2), (70, 9, 0), (33, 40, 0.9))]
    assert writers.jpegs(made, [[1] * 64], [0, 2, 5], progressive) == [writers.jpeg(*i, [[1] * 64], step, progressive) for i, step in zip(made, (0, 2, 5), strict=True)]


#: The texts' bytes as files, by query.
WRITERS = {
    "jpeg_progressive_coefficients": decoded_queries._coefficients(True, False),
    "jpeg_interleaved_coefficients": decoded_queries._coefficients(False, True),
    "jpeg_entropy_roundtrip": round_trips._jpegs,
    "jpeg_progressive_sampled_coefficients": decoded_queries._coefficients(True, True),
}


@pytest.mark.parametrize("name", WRITERS)
def test_scans_are_walked_in_less_time(name):
    """Half the reader's time at most, though it now has the tables ready."""
    data = WRITERS[name]([RNG.integers(32, 127, 60_000, np.uint8).tobytes()])[0]
    took = {}
    for walk in (jpeg.ScanReader, jpeg.ScanWalk):
        began = time.process_time()
        found = jpeg.read(data, walk).frame.coefs
        took[walk] = time.process_time() - began, found
    assert (took[jpeg.ScanReader][1] == took[jpeg.ScanWalk][1]).all()
    assert 2 * took[jpeg.ScanWalk][0] < took[jpeg.ScanReader][0]


def found(state):
    return (state.message, state.offset) if isinstance(state, Exception) else (state.scans, [c.coefs.tolist() for c in state.frame.components])


@pytest.mark.parametrize("lane, meet", [(4096, 1536), (600, 400)])
@pytest.mark.parametrize("progressive", [False, True])
def test_files_read_together(progressive, lane, meet, monkeypatch):
    """Whole and damaged files of all kinds at once, in lanes that are met, that are met late and that aren't."""
    monkeypatch.setattr(jpeg, "LANE", lane)
    monkeypatch.setattr(jpeg, "MEET", meet)
    together, walked = [], jpeg.walked
    monkeypatch.setattr(jpeg, "walked", lambda scans: together.append(done := walked(scans)) or done)
    files = [b"\xff\xd8\xff", b""]
    for n in range(60):
        data = writers.jpeg(*image(FACTORS[n % 4], int(RNG.integers(1, 200)), int(RNG.integers(1, 90)), (0, 0.05, 0.3, 0.9)[n // 4 % 4], (2, 130)[n % 2]), [[1] * 64], (0, 1, 3)[n % 3], progressive)
        if n % 5 == 1:  # other codes
            at = data.index(b"\xff\xc4\x01\x11\x10") + 5
            data = data[:at] + bytes([1, 1, 1] + [0] * 8 + [251] + [0] * 4) + data[at + 16 :]
        files += [data, damaged(data)]
    for data, state in zip(files, jpeg.read_all(files), strict=True):
        assert found(state) == outcome(data, jpeg.ScanReader)
    assert sum(map(len, together)) > 20


def test_lanes_find_what_one_walk_finds(monkeypatch):
    monkeypatch.setattr(jpeg, "LANE", 600)
    monkeypatch.setattr(jpeg, "MEET", 400)
    known = 0
    for n in range(200):
        data = RNG.integers(0, 256, int(RNG.integers(100, 1500))).astype(np.int64)
        wide = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        taken = RNG.integers(3, 20, 1 << 16).astype(np.uint8) if n % 2 else (8 + (np.arange(1 << 16) >> 8 & 15)).astype(np.uint8)
        cuts = np.linspace(0, len(wide) - 16, n % 3 + 2).astype(int)
        first, limit = 8 * cuts[:-1], 8 * cuts[1:] - RNG.integers(0, 8, len(cuts) - 1)
        at, _, counts, sure = jpeg._chains(wide, taken, first, limit)
        assert len(at) == counts.sum()
        for p, end, own, fine in zip(first.tolist(), limit.tolist(), np.split(at, np.cumsum(counts)[:-1]), sure, strict=True):
            want = []
            while p < end:
                want.append(p)
                p += int(taken[int(wide[p >> 3]) >> (8 - (p & 7)) & 0xFFFF])
            assert not fine or own.tolist() == want
            known += int(fine)
    assert known > 200


@pytest.mark.parametrize("name", ["jpeg_interleaved_coefficients", "jpeg_progressive_coefficients"])
def test_files_are_read_together_in_less_time(name):
    """Short texts at once, against the same one by one."""
    texts = [RNG.integers(32, 127, 2500, np.uint8).tobytes() for _ in range(200)]
    files, took = WRITERS[name](texts), []
    for read in (lambda: [jpeg.read(data) for data in files], lambda: jpeg.read_all(files)):
        began = time.process_time()
        states = read()
        took.append(time.process_time() - began)
        assert len(states) == len(files)
    assert 1.25 * took[1] < took[0]
