"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Documents are tokenised once; each is cut at every full window, and what is
left of it (shorter than a window), in a few pieces, is packed. The pieces are
dealt by hash into groups of bounded size. Within a group they start as partial partitions,
each a vector with one piece and otherwise empty windows. The two partial
partitions of the widest spread are merged again and again, the fullest windows
of one with the emptiest of the other, until one is left: windows of nearly
equal load. A group begins with the fewest windows its tokens can fill; if one
ends up over capacity the window count rises by one and the group is dealt anew.
"""

from __future__ import annotations

import heapq
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tiktoken._tiktoken import CoreBPE
from tokenizers import Tokenizer

from .common import bounded, id_and_text, stored, texts_of

WINDOW = 4096
END_ID = 2
#: Tokens of a piece of a remainder at most; small pieces make loads more equal.
CUT = 512
#: Pieces in a group, about; a group's last window is all that is padded much.
GROUP_ROWS = 4096
#: Windows of one group never reach this, so group and window make one number.
GROUP_STRIDE = 1 << 20
#: Distinct words a Python worker remembers, and their greatest length.
CACHE_WORDS, CACHED_CHARS = 500_000, 48
#: Longer words are left to the library, whose merging grows more slowly with the length.
MERGED_CHARS = 512


#: Letters that have one lower case and no composed form of several.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įıĲ-ɏ"
#: Words of these characters are split by _SPLIT as by the vocabulary's pre-tokenizer.
_LATIN = re.compile(f"[!-~{_LETTERS}]+")
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+")
#: A byte that UTF-8 never has stands for the end of a word.
_WORD_END = b"\xff"


def _merge_table(tokenizer) -> CoreBPE:
    """The vocabulary as ranks of bytes, for a quicker merger that takes the lowest rank first.

    The vocabulary numbers the 256 bytes, the bytes with a word end, and then
    the merges in order; so ids can serve as ranks. Its letters stand for bytes
    by the usual table: printable bytes for themselves, others from U+0100 on.
    """
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    special = tokenizer.get_added_tokens_decoder()
    ranks = {}
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        if i not in special:
            end = token.endswith("</w>") and len(token) > 4
            data = bytes(byte_of[c] for c in (token[:-4] if end else token)) + _WORD_END * end
            ranks[data] = i
    return CoreBPE(ranks, {}, ".")


class _Words(dict):
    """word between spaces, line feeds or stops -> its ids as bytes."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge = _merge_table(self.tokenizer).encode_single_piece

    def __missing__(self, word: str) -> bytes:
        if len(word) <= MERGED_CHARS and _LATIN.fullmatch(word):
            ids = [i for part in _SPLIT.findall(word.lower()) for i in self.merge(part.encode() + _WORD_END)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=1)
def _words(path: str) -> _Words:
    return _Words(path)


#: A comma or full stop that doesn't follow a letter or digit may belong to a run before it, so it isn't cut off.
_ODD_STOP = re.compile(f"(?<![0-9{_LETTERS}])[,.]")


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers, without special tokens.

    The vocabulary's pre-tokenizer drops white space and never joins across it,
    and a run of punctuation starts anew behind a letter or digit. So words are
    cut at spaces, line feeds and stops, encoded alone and remembered.
    """
    known, out = _words(path).__getitem__, []
    for t in texts:
        t = t.replace("\n", " ")
        if not _ODD_STOP.search(t):
            t = t.replace(",", " ,").replace(".", " .")
        out.append(b"".join(map(known, t.split(" "))))
    return out


def cuts(n: int, window: int, cut: int) -> list[tuple[int, int]]:
    """Where n tokens are cut: full windows, then what is left in equal pieces of at most ``cut``."""
    full = n - n % window
    parts = -(-(n - full) // cut)
    ends = [full + (n - full) * k // parts for k in range(1, parts + 1)] if parts else []
    return [(i, i + window) for i in range(0, full, window)] + list(zip([full, *ends], ends, strict=False))


def pieces(df: DataFrame, tokenizer_path: str, window: int = WINDOW, cut: int = CUT, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Every document's tokens and ``end_id``, cut at each multiple of ``window`` and, past the last, into pieces of at most ``cut``.

    doc_id, start, length, ids_crc32 (of the piece's ids as little-endian
    unsigned 32-bit integers), doc_tokens and, if ``keep_ids``, ids.
    """
    rows = id_and_text(df, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            at, start, length, crc, total, kept = [], [], [], [], [], []
            for i, body in enumerate(token_bytes(texts_of(batch), tokenizer_path)):
                body += end
                n = len(body) // 4
                for first, last in cuts(n, window, cut):
                    part = body[4 * first : 4 * last]
                    at.append(i)
                    start.append(first)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
                    if keep_ids:
                        kept.append(np.frombuffer(part, "<i4"))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids)


def karmarkar_karp(sizes: list[int], windows: int) -> np.ndarray:
    """The window, from 0, of each of ``sizes``: multiway differencing into ``windows`` nearly equal loads.

    Every partial partition is a vector of loads in falling order. A merge adds
    one vector to the other reversed and sorts the sum; the sorting orders are
    kept and, read back from the last merge, lead each size to its window. Ties
    go to the lower index.
    """
    n = len(sizes)
    if windows == 1 or n == 0:
        return np.zeros(n, np.int64)
    loads: dict[int, np.ndarray] = {}
    heap = []
    for i, s in enumerate(sizes):
        loads[i] = np.zeros(windows, np.int64)
        loads[i][0] = s
        heap.append((-s, i))
    heapq.heapify(heap)
    merged: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = loads.pop(a) + loads.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        loads[n + len(merged)] = both
        heapq.heappush(heap, (int(both[-1] - both[0]), n + len(merged)))
        merged.append((a, b, order.astype(np.int32)))
    at: dict[int, np.ndarray] = {heap[0][1]: np.arange(windows)}
    for k in range(len(merged) - 1, -1, -1):
        a, b, order = merged[k]
        place = np.empty(windows, np.int64)
        place[order] = at.pop(n + k)
        at[a], at[b] = place, place[::-1]
    return np.array([at[i][0] for i in range(n)], np.int64)


def packed(sizes: list[int], window: int) -> np.ndarray:
    """The window of each size, none over capacity; the count starts at the least and rises while any is."""
    weights = np.array(sizes, np.int64)
    windows = max(1, -(-int(weights.sum()) // window))
    while True:
        found = karmarkar_karp(sizes, windows)
        if not len(sizes) or np.bincount(found, weights).max() <= window:
            return found
        windows += 1


def pack(df: DataFrame, tokenizer_path: str, window: int = WINDOW, cut: int = CUT, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every piece of every document with its sequence and place there.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A
    sequence holds at most ``window`` tokens; offsets are gapless from 0. An
    empty or null text still has its end token. Repeated rows and null doc_ids
    are packed like any others. An empty table gives an empty result; other
    columns of df aren't read. sequence_id is unique but not gapless: it is the
    group's number times 2^20 plus the window's.
    """
    made = stored(pieces(df, tokenizer_path, window, cut, end_id, id_col, text_col), "pieces")
    # the table is written, so these numbers stay as they are whichever task is run again
    numbered = stored(made.select("*", F.monotonically_increasing_id().alias("n")), "numbered")
    rest = numbered.where(F.col("length") < window).count()
    groups = max(1, -(-rest // group_rows))
    dealt = numbered.withColumn("g", F.pmod(F.xxhash64("n"), F.lit(groups)).cast("long"))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full = dealt.where(F.col("length") == window).select(*out[:5], (F.lit(groups * GROUP_STRIDE).cast("long") + F.col("n")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    id_type = made.schema["doc_id"].dataType.simpleString()

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by("n")
        sizes = group.column("length").to_pylist()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        first = (group.column("g")[0].as_py() if sizes else 0) * GROUP_STRIDE
        used: dict[int, int] = {}
        for i, w in enumerate(packed(sizes, window).tolist()):
            sequence[i], offset[i] = first + w, used.get(w, 0)
            used[w] = used.get(w, 0) + sizes[i]
        return group.select(out[:5]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    rests = dealt.where(F.col("length") < window).groupBy("g").applyInArrow(place, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return full.unionByName(rests)


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """One row per sequence: its pieces in order, its tokens and its padding to the window.

    A sequence's pieces are at most a window's tokens, so a group is bounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length")))
    return packed_pieces.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("tokens")).select("*", (F.lit(WINDOW) - F.col("tokens")).alias("padding"))


def fill(packed_pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row: sequences, tokens and the share of the windows that tokens fill."""
    per = packed_pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    return per.agg(F.count("*").alias("sequences"), F.sum("tokens").alias("tokens")).select("*", (F.col("tokens") / (F.col("sequences") * F.lit(window))).alias("filled"))
