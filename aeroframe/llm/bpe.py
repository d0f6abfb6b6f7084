"""Byte-level BPE by a monoid tree reduction.

A text is encoded by halves, recursively; two neighbours are joined by encoding
a window round their boundary anew. The window grows on both sides until it ends
where a character that is not white space meets white space. No match of the
pre-splitting pattern holds such a pair and none looks across it, so the tokens
outside the window are those of the whole text, whatever the text inside.

A single match that is very long (no white space for thousands of characters) is
reduced in the same way by its bytes: a sequence of tokens is the encoding of its
bytes exactly if every two neighbours are the encoding of theirs, so the window of
tokens round the boundary grows until both pairs at its edges hold.

Decoding concatenates bytes up the same tree.

Defined results: null text is empty text; an empty text has no ids; special
tokens' strings are ordinary text; an empty table gives an empty table; input
columns named like the output are replaced, all others are kept.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, tidy

LEAF = 8192
PIECE_LEAF = 128
#: Matches a worker remembers in each of two generations.
REMEMBERED = 200_000
_NO_RANK = 1 << 62
_SAFE = regex.compile(r"(?<=\S)(?=\s)")
_LOADED: dict = {}


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


class Bpe:
    """Encoder and decoder over one rank file. Ids travel as little-endian 32-bit bytes."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.cache = _Pieces(self)

    # pieces: matches of the pattern
    def merge(self, piece: bytes) -> list[int]:
        """Merge the neighbours of lowest rank, leftmost first, until none has a rank."""
        rank = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank(a + b, _NO_RANK) for a, b in zip(parts, parts[1:])]
        while pairs and (least := min(pairs)) < _NO_RANK:
            at = pairs.index(least)
            parts[at] += parts.pop(at + 1)
            del pairs[at]
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], _NO_RANK)
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], _NO_RANK)
        return [self.ranks[p] for p in parts]

    def piece_ids(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(piece) <= PIECE_LEAF:
            return self.merge(piece)
        mid = len(piece) // 2
        return self._join_pieces(self.piece_ids(piece[:mid]), self.piece_ids(piece[mid:]))

    def _stable(self, a: int, b: int) -> bool:
        return self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def _join_pieces(self, left: list[int], right: list[int]) -> list[int]:
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self._whole(b"".join(self.bytes_of[t] for t in left[len(left) - i :] + right[:j]))
            ok_left = i == len(left) or self._stable(left[len(left) - i - 1], window[0])
            ok_right = j == len(right) or self._stable(window[-1], right[j])
            if ok_left and ok_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = (i if ok_left else 2 * i), (j if ok_right else 2 * j)

    def _whole(self, piece: bytes) -> list[int]:
        return self.merge(piece) if len(piece) <= 4 * PIECE_LEAF else self._merge_long(piece)

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges with a heap, for the rare window that cannot stay short."""
        import heapq

        n = len(piece)
        start, nxt, prev, end = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = []

        def push(i):
            k = nxt[i]
            if k < n and (r := self.ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))

        for i in range(n - 1):
            push(i)
        while heap:
            r, i, e = heapq.heappop(heap)
            k = nxt[i] if alive[i] else n
            if k >= n or end[k] != e:
                continue
            alive[k] = False
            end[i], nxt[i] = e, nxt[k]
            if nxt[i] < n:
                prev[nxt[i]] = i
            push(i)
            if prev[i] >= 0:
                push(prev[i])
        return [self.ranks[piece[i : end[i]]] for i in start if alive[i]]

    # texts
    def flat(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.find(text)))

    def encode(self, text: str) -> bytes:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> bytes:
        if hi - lo <= LEAF:
            return self.flat(text[lo:hi])
        mid = (lo + hi) // 2
        left, right = self._encode(text, lo, mid), self._encode(text, mid, hi)
        p, q = self._cut_before(text, lo, mid), self._cut_after(text, mid, hi)
        stale_left, stale_right = len(self.flat(text[p:mid])), len(self.flat(text[mid:q]))
        return left[: len(left) - stale_left] + self.flat(text[p:q]) + right[stale_right:]

    @staticmethod
    def _cut_before(text: str, lo: int, mid: int) -> int:
        """The last safe cut before mid, else lo."""
        w = 64
        while True:
            at = max(lo, mid - w)
            found = [m.start() for m in _SAFE.finditer(text, max(lo, at - 1), mid) if lo < m.start() < mid]
            if found:
                return found[-1]
            if at == lo:
                return lo
            w *= 2

    @staticmethod
    def _cut_after(text: str, mid: int, hi: int) -> int:
        """The first safe cut after mid, else hi."""
        w = 64
        while True:
            at = min(hi, mid + w)
            m = next((m for m in _SAFE.finditer(text, mid, at) if m.start() > mid), None)
            if m:
                return m.start()
            if at == hi:
                return hi
            w *= 2

    def decode(self, ids) -> bytes:
        if len(ids) <= LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


class _Pieces(dict):
    """Match to the bytes of its ids. What a generation looked up again outlives it, the rest is forgotten."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe, self.older = bpe, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            found = self.bpe.piece_ids(piece.encode("utf-8", "replace"))
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        if len(piece) <= 256:
            self[piece] = ids
        return ids


def loaded(path: str, pattern: str) -> Bpe:
    """One encoder per Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Bpe(path, pattern)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The input's columns plus ``ids_col``, the ids of the whole text."""
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]
    src = docs.drop(ids_col)
    at = src.columns.index(text_col)
    src = src.withColumn(text_col, F.col(text_col).cast("string"))

    @tidy
    def run(batches):
        bpe = loaded(path, pattern)
        for b in slices(batches):
            parts = [bpe.encode(t or "") for t in b.column(at).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype("<i4")
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, ids_col])

    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(docs: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The input's columns plus ``bytes_col``, the bytes that the ids stand for."""
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]
    src = docs.drop(bytes_col)
    at = src.columns.index(ids_col)

    @tidy
    def run(batches):
        bpe = loaded(path, pattern)
        for b in slices(batches):
            out = [bpe.decode(ids) for ids in id_lists(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, bytes_col])

    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(bytes_col, T.BinaryType())]))


def id_lists(column):
    """Each row's ids as a list; never the whole column's as Python numbers."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    valid = column.is_valid().to_pylist()
    for i, j, ok in zip(offsets[:-1], offsets[1:], valid):
        yield values[i:j].tolist() if ok else []


def round_trip(docs: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encodes each text and decodes its ids in one pass: the other columns plus n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids) and decoded_sha256."""
    import hashlib

    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    src = docs.drop(*names)
    at = src.columns.index(text_col)
    src = src.withColumn(text_col, F.col(text_col).cast("string"))
    kinds = (T.LongType(), T.StringType(), T.StringType())
    out = T.StructType([*src.drop(text_col).schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds)]])

    @tidy
    def run(batches):
        bpe = loaded(path, pattern)
        for b in slices(batches):
            n, ids_sha, text_sha = [], [], []
            for text in b.column(at).to_pylist():
                ids = bpe.encode(text or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest())
            rest = [c for k, c in enumerate(b.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], out.names)

    return src.mapInArrow(run, out)
