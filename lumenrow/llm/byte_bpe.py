"""Byte-level BPE by prefix dynamic programming.

For a fixed merge table the encoding of a byte string has one last token, and
so has every prefix. ``PrefixEncoder`` keeps, for each prefix, that token: the
candidate tokens are those that end there, and the one is right whose
predecessor's token, at the prefix before it, may stand beside it. The token
list is read by walking back. Appending bytes leaves all earlier entries as
they are, so appends are exact and cost only the new bytes; an edit keeps the
entries before it, and the entries after it are taken over as soon as enough
consecutive ones agree.

Whether two tokens may stand side by side is decided by undoing merges: the
pair is valid unless some merge across their border would have come before the
merges that made them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, id_and_text, texts_of

#: Distinct text pieces a Python worker remembers before it starts anew.
CACHE_PIECES = 500_000
#: Verdicts on token pairs a Python worker remembers before it starts anew.
PAIRS_KEPT = 1_000_000
#: Bytes of a match whose prefix tokens are kept for other matches that begin alike.
STEM_BYTES = 8
#: The split pattern that the cutting shortcut is made for.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer pieces are encoded each time instead of remembered.
CACHED_BYTES = 64


class PrefixEncoder:
    """Encodes single pieces (one match of the split pattern) by their prefixes' last tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: token -> the two tokens of its last merge; single bytes map to themselves
        self.parts: dict[int, tuple[int, int]] = {}
        #: (left, right) -> rank of their merge
        self.merges: dict[tuple[int, int], int] = {}
        self._valid: dict[tuple[int, int], bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.parts[rank] = (rank, rank)
                continue
            split = self._last_merge(token, rank)
            if split:
                self.parts[rank] = split
                self.merges[split] = rank
        #: finds all tokens that end at each byte; bytes stand as characters of the same number
        self.ends = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if rank in self.parts:
                self.ends.add_word(token.decode("latin-1"), (len(token), rank))
        if ranks:
            self.ends.make_automaton()

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens that merges of lower rank leave of a token's bytes."""
        ids = [self.ranks[token[i : i + 1]] for i in range(len(token))]
        while len(ids) > 2:
            best = min(((self.merges.get(pair, rank), i) for i, pair in enumerate(zip(ids, ids[1:], strict=False))), default=(rank, 0))
            if best[0] >= rank:
                return None
            ids[best[1] : best[1] + 2] = [best[0]]
        return (ids[0], ids[1])

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens."""
        known = self._valid.get((left, right))
        if known is None:
            if len(self._valid) >= PAIRS_KEPT:
                self._valid.clear()
            known = self._valid[left, right] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        a, b, limit = left, right, 1 << 60
        while True:
            merged = self.merges.get((a, b))
            if merged is not None and merged < limit:
                return False
            if a > b:
                # the later made of both is opened; its border half meets the other
                limit = a
                a = self.parts[a][1]
                if a == limit:
                    limit = b + 1
                    b = self.parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = self.parts[b][0]
                if b + 1 == limit:
                    limit = a
                    a = self.parts[a][1]
                    if a == limit:
                        return True

    def _run(self, data: bytes, last: list[int], to: int) -> None:
        """Add the last tokens of data[:len(last) + 1] to data[:to] to last; last[i] is that of data[:i + 1]."""
        done = len(last)
        base = max(0, done + 1 - self.longest)
        valid, fits = self._valid, self.fits
        # at each end the automaton names its tokens from the longest, which most often is the one
        for end, (length, token) in self.ends.iter(data[base:to].decode("latin-1")):
            end += base
            if end < done:
                continue
            start = end + 1 - length
            if start:
                if start < base:
                    continue
                pair = (last[start - 1], token)
                known = valid.get(pair)
                if not (known if known is not None else fits(*pair)):
                    continue
            last.append(token)
            done += 1
        if done != to:
            raise ValueError("the ranks don't hold every single byte")

    def prefixes(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """The last token of every prefix. ``last``: those of a prefix of data, which are kept (exact append)."""
        last = list(last or ())
        self._run(data, last, len(data))
        return last

    def edited(self, old: bytes, last: list[int], at: int, removed: int, put: bytes) -> tuple[bytes, list[int]]:
        """old with ``removed`` bytes at ``at`` replaced by ``put``, and its prefixes' tokens, recomputed near the edit only.

        An entry depends on the entries up to the longest token's length before
        it; after that many entries in a row agree with the old ones, so do all
        that follow.
        """
        new = old[:at] + put + old[at + removed :]
        shift, out, same = len(put) - removed, last[:at], 0
        for end in range(at + 1, len(new) + 1):
            self._run(new, out, end)
            before = end - shift
            same = same + 1 if end > at + len(put) and before >= 1 and last[before - 1] == out[-1] else 0
            if same > 2 * self.longest:
                out += last[before:]
                break
        return new, out

    def read_back(self, last: list[int]) -> list[int]:
        """The token ids, from the prefixes' last tokens."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[out[-1]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.read_back(self.prefixes(data))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


#: Letters and digits as the pattern and Python's \\w see them alike.
_WORD = "0-9A-Za-zªµºÀ-ÖØ-öø-ɏ"
#: Texts with any of these are split by the pattern alone: other characters than
#: plain ones, white space that stands by white space or at an end, and a comma
#: or full stop that doesn't follow a letter or digit.
_ODD = re.compile(rf"[^ -~\n¡-±´-¸º»¿-ɏ]|[ \n](?![!-~¡-ɏ])|(?<![{_WORD}])[,.]")


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _Pieces(dict):
    """piece of text -> its ids as bytes; those not met before are split and encoded."""

    def __init__(self, bpe: PrefixEncoder, pattern: regex.Pattern):
        super().__init__()
        self.bpe, self.pattern, self.stems = bpe, pattern, {}

    def __missing__(self, piece: str) -> bytes:
        ids = np.array([i for m in self.pattern.finditer(piece) for i in self.match(m[0].encode("utf-8", "surrogatepass"))], "<u4").tobytes()
        if len(piece) <= CACHED_BYTES:
            self[piece] = ids
        return ids

    def match(self, data: bytes) -> list[int]:
        """The ids of one match, from the prefix it shares with earlier ones."""
        bpe = self.bpe
        whole = bpe.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) <= STEM_BYTES:
            return bpe.read_back(bpe.prefixes(data))
        stem = data[:STEM_BYTES]
        known = self.stems.get(stem)
        if known is None:
            known = self.stems[stem] = bpe.prefixes(stem)
        return bpe.read_back(bpe.prefixes(data, known))


class TextEncoder:
    """Encodes whole texts: splits them by the pattern and remembers the pieces' ids."""

    def __init__(self, path: str, pattern: str):
        self.bpe, self.pattern = PrefixEncoder(ranks_of(path)), regex.compile(pattern)
        self.seen = _Pieces(self.bpe, self.pattern)
        # the shortcut below holds for patterns that cut at spaces and punctuation like this one
        self.cuts = pattern == CUT_PATTERN

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers.

        In plain texts a match begins at each single space, at a line feed and
        after it, and at a comma or full stop behind a letter or digit, whatever
        follows; so these can be cut there and the cuts looked up. All other
        texts are split by the pattern as a whole.
        """
        if len(self.seen) > CACHE_PIECES:
            self.seen.clear()
            self.seen.stems.clear()
        if not self.cuts or _ODD.search(text):
            pieces = self.pattern.findall(text)
        else:
            pieces = text.replace(" ", "\0 ").replace("\n", "\0\n\0").replace(",", "\0,").replace(".", "\0.").split("\0")
        return b"".join(map(self.seen.__getitem__, pieces))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder for each Python worker."""
    return TextEncoder(path, pattern)


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """For every row doc_id, n_tokens, ids_sha256, decoded_sha256 and, if ``keep_ids``, the ids as array<int>.

    The digests are those of the ids as little-endian unsigned 32-bit integers
    and of the bytes the ids decode to. A null or empty text has no ids.
    Repeated rows and null doc_ids stay as they are; an empty table gives an
    empty result; other columns of df aren't read. The vocabulary's path must
    be readable on every worker.
    """
    rows = id_and_text(df, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        table = [enc.bpe.tokens.get(i, b"") for i in range(max(enc.bpe.tokens, default=0) + 1)]
        for batch in bounded(batches):
            n, ids_sha, decoded_sha, kept = [], [], [], []
            for text in texts_of(batch):
                ids = enc.encode(text)
                values = np.frombuffer(ids, "<u4")
                n.append(values.size)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(b"".join(map(table.__getitem__, values.tolist()))).hexdigest())
                if keep_ids:
                    kept.append(values.astype(np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(run, schema)


def decode_ids(df: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """df with ``decoded`` (binary): the bytes its token ids stand for; null ids give null, an unknown id fails."""
    extra = F.array_compact(F.col(ids_col)).alias("__ids")
    tokens = df.sparkSession.sparkContext.broadcast({r: t for t, r in ranks_of(ranks_path).items()})

    @F.pandas_udf("binary")
    def decoded(ids):
        return ids.map(lambda x: None if x is None else b"".join(tokens.value[int(i)] for i in x))

    return df.select("*", decoded(extra).alias("decoded"))
