"""Token counts without token ids: each distinct pre-token is counted once.

A byte-level BPE splits a text into pre-tokens and encodes each by itself, so a
document's token count is the sum over its distinct pre-tokens of frequency times
pieces. Three passes over ever smaller data do that sum:

1. Tasks fold documents into frequency lists over a dictionary of their own. A
   dictionary belongs to a *chunk* of documents and is bounded in bytes of text and in
   entries. What equals an entry of the vocabulary, a table bounded by the tokenizer,
   is summed on the spot. The other pre-tokens of a chunk leave it once each, by buckets.
2. A bucket brings equal pre-tokens of all chunks together: each is counted once by the
   library's own model. Its counts go back to the chunks as one byte a pre-token.
3. Frequency lists meet the counts of their chunk and are summed in a stream.

A frequent pre-token leaves a chunk once, however often it occurs, and nothing is
gathered by document, so no key is hot.

Defined results: null text is empty text with no bytes and no tokens; special tokens'
strings inside a text are one token each, as the library's default has it; rows that
repeat an id, or have none, are rows of their own; a very long text is split at safe
cuts (before white space that follows other characters, which no match of the pattern
spans) and its list stays one row; an empty table gives an empty table; input columns
named like the output are replaced, all others but the text are kept, names that
clash in case included.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _SAFE
from .common import materialise, shared_dir, tidy

#: A chunk ends after a document that brings it to this many bytes of text, or new pre-tokens.
CHUNK_BYTES, CHUNK_ENTRIES = 32_000_000, 500_000
#: Pre-tokens are dealt to this many buckets; a task holds the distinct ones of one bucket at a time.
BUCKETS = 2048
WINDOW = 1 << 18
#: Characters of which the pattern's classes are the same in ``regex`` and in the library (a test compares them one by
#: one); a text with others is split by the library itself.
_PLAIN = regex.compile("[\\x00-ԯ -⁯₠-₿℀-⅏←-⇿─-╿　-〩ぁ-ゖァ-ヺ一-龥가-힣！-～\U0001f300-\U0001f64f]*")
#: The pattern of the library's byte-level pre-tokenizer: a fixed value.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PreTokens:
    """The library's tokenizer taken apart: pre-tokens of a text, and the number of pieces of one pre-token."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer, decoders, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"] or {}
        plain = all(not (a["single_word"] or a["lstrip"] or a["rstrip"]) for a in spec["added_tokens"])
        if spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or not plain:
            raise ValueError(f"{path}: only byte-level tokenizers without a normalizer, prefix space or stripping tokens are split by pre-token")
        library = Tokenizer.from_file(path)
        self.model, self.library_split = library.model, library.pre_tokenizer.pre_tokenize_str
        self.in_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.find = regex.compile(_PATTERN).findall
        special = sorted((a["content"] for a in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        plain_text = decoders.ByteLevel().decode
        #: Pre-tokens that are entries of the vocabulary, with their pieces.
        self.known = {plain_text([entry]): len(self.model.tokenize(entry)) for entry in library.get_vocab(with_added_tokens=False)}

    def pieces(self, pre_token: str) -> int:
        return sum(len(self.model.tokenize(s)) for s, _ in self.in_bytes(pre_token))

    def split(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return self.find(text)
        return [text[i:j] for _, (i, j) in self.library_split(text)]

    def windows(self, text: str):
        """Parts of the text that split like the whole, and the number of special tokens before each part."""
        n = 0
        for part in self.special.split(text) if self.special else [text]:
            at = 0
            while len(part) - at > WINDOW:
                cut = _SAFE.search(part, at + WINDOW)
                if cut is None:
                    break
                yield part[at : cut.start()], n
                at, n = cut.start(), 0
            yield part[at:], n
            n = 1


def loaded(path: str) -> PreTokens:
    """One per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PreTokens(path)
    return _LOADED[path]


class _Entries(dict):
    """Pre-token to its place: entries of the vocabulary first, then the chunk's own by first appearance."""

    def __missing__(self, key):
        self[key] = at = len(self)
        return at


def pack(at: np.ndarray) -> bytes:
    """Ascending numbers as 16-bit steps; 65535 is a step that ends nowhere."""
    step = np.diff(at, prepend=0)
    long = step // 65535
    if not long.any():
        return step.astype("<u2").tobytes()
    out = np.full(len(step) + long.sum(), 65535, "<u2")
    out[np.cumsum(long + 1) - 1] = step - 65535 * long
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    step = np.frombuffer(data, "<u2")
    return np.cumsum(step, dtype=np.int64)[step < 65535]


def pack_counts(n: np.ndarray) -> bytes:
    """One byte each; 255 stands for the four bytes of a greater count, which follow the bytes."""
    return np.minimum(n, 255).astype("u1").tobytes() + n[n >= 255].astype("<u4").tobytes()


def unpack_counts(data: bytes, entries: int) -> np.ndarray:
    n = np.frombuffer(data, "u1", entries).astype(np.int64)
    n[n == 255] = np.frombuffer(data, "<u4", offset=entries)
    return n


def fold(docs: DataFrame, text_col: str, path: str, chunk_bytes: int = CHUNK_BYTES, chunk_entries: int = CHUNK_ENTRIES, buckets: int = BUCKETS) -> DataFrame:
    """Rows of two kinds: a document (``row`` holds its other columns) with its list, and a bucket of a chunk's pre-tokens."""
    rest = T.StructType([f for f in docs.schema.fields if f.name != text_col])
    src = docs.select(F.struct(*[docs[f"`{f.name}`"] for f in rest.fields]).alias("row") if rest.fields else F.struct(F.lit(0).alias("_")).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("entries", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("pre_tokens", T.BinaryType()), T.StructField("row", src.schema["row"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("told", T.LongType()), T.StructField("at", T.BinaryType()), T.StructField("freq", T.BinaryType())])

    @tidy
    def run(batches):
        from pyspark import TaskContext

        pre = loaded(path)
        known = len(pre.known)
        told = np.fromiter(pre.known.values(), np.int64, known)
        first = _Entries(zip(pre.known, range(known)))
        task, chunk, kind = TaskContext.get().partitionId() << 24, 0, None
        entries, held, lists, size = _Entries(first), [], [], 0

        def chunk_rows():
            """The chunk's pre-tokens by buckets, then its documents with places in that order."""
            own = list(entries)[known:]
            raw = [p.encode() for p in own]
            bucket = np.fromiter((zlib.crc32(p) % buckets for p in raw), np.int64, len(raw))
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(raw), np.int64)
            place[order] = np.arange(len(raw))
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(edges))
            blobs = []
            for b in some.tolist():
                mine = [raw[i] for i in order[edges[b] : edges[b + 1]].tolist()]
                blobs.append(zlib.compress(np.array([len(p) for p in mine], "<u4").tobytes() + b"".join(mine), 1))
            n, null = len(blobs), lambda kind, n: pa.nulls(n, kind)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([task | chunk] * n, pa.int64()), pa.array(edges[some], pa.int32()), pa.array(np.diff(edges)[some], pa.int32()), pa.array(some, pa.int32()), pa.array(blobs, pa.binary()), null(kind, n), null(pa.int64(), n), null(pa.int64(), n), null(pa.binary(), n), null(pa.binary(), n)], out.names)
            at, freq = [], []
            for places, counts in lists:
                here = place[places]
                by = np.argsort(here)
                here, counts = here[by], counts[by]
                again = (counts - 1) // 255 + 1  # a count above 255 takes further entries of the same place
                if (again > 1).any():
                    ends = np.cumsum(again) - 1
                    here, each = np.repeat(here, again), np.full(ends[-1] + 1, 255)
                    each[ends] = counts - 255 * (again - 1)
                    counts = each
                at.append(pack(here))
                freq.append(counts.astype("u1").tobytes())
            m = 0
            for rows, n_bytes, sums in held:
                k = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([task | chunk] * k, pa.int64()), null(pa.int32(), k), null(pa.int32(), k), null(pa.int32(), k), null(pa.binary(), k), rows, pa.array(n_bytes, pa.int64()), pa.array(sums, pa.int64()), pa.array(at[m : m + k], pa.binary()), pa.array(freq[m : m + k], pa.binary())], out.names)
                m += k

        for b in batches:
            kind, since = b.schema.field("row").type, 0
            n_bytes, sums = [], []
            texts = b.column(1)
            for k in range(b.num_rows):
                text = texts[k].as_py()
                look, found, total = entries.__getitem__, [], 0
                for part, special in pre.windows(text):
                    total += special
                    found.append(np.array(list(map(look, pre.split(part))), np.int64))
                places, counts = np.unique(np.concatenate(found), return_counts=True)
                cut = int(np.searchsorted(places, known))
                sums.append(total + int(told[places[:cut]] @ counts[:cut]))
                lists.append((places[cut:] - known, counts[cut:]))
                n_bytes.append(len(text.encode()))
                size += n_bytes[-1]
                if size >= chunk_bytes or len(entries) - known >= chunk_entries:
                    held.append((b.column(0).slice(since, k + 1 - since), n_bytes, sums))
                    yield from chunk_rows()
                    chunk, entries, held, lists, size = chunk + 1, _Entries(first), [], [], 0
                    since, n_bytes, sums = k + 1, [], []
            if n_bytes:
                held.append((b.column(0).slice(since), n_bytes, sums))
        if held:
            yield from chunk_rows()

    return src.mapInArrow(run, out)


def count_buckets(pieces: DataFrame, path: str) -> DataFrame:
    """One row a bucket and chunk: the pieces of its pre-tokens in order. A pre-token is counted when its bucket first shows it."""

    @tidy
    def run(batches):
        pre, bucket, seen = loaded(path), None, {}
        for b in batches:
            counts = []
            for at, n, blob in zip(*(b.column(k).to_pylist() for k in (2, 3, 4))):
                if at != bucket:
                    bucket, seen = at, {}
                data, here, found = zlib.decompress(blob), 4 * n, []
                for size in np.frombuffer(data, "<u4", n).tolist():
                    p, here = data[here : here + size], here + size
                    k = seen.get(p)
                    if k is None:
                        k = seen[p] = pre.pieces(p.decode())
                    found.append(k)
                counts.append(pack_counts(np.array(found, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(counts, pa.binary())], ["chunk", "start", "entries", "counts"])

    dealt = pieces.select("chunk", "start", "bucket", "entries", "pre_tokens").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "chunk long, start int, entries int, counts binary")


def count_tokens(docs: DataFrame, text_col: str = "text", path: str | None = None, **bounds) -> DataFrame:
    """The input's columns but the text, plus n_bytes (UTF-8) and n_tokens; ``bounds`` are those of :func:`fold`."""
    path = path or default_vocabulary()
    src = docs.drop("n_bytes", "n_tokens")
    kinds = [f for f in src.schema.fields if f.name != text_col]
    # Inside, columns go by number: names that differ in case only would clash in a written table.
    plain = src.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kinds)], F.col(f"`{text_col}`").alias("text"))
    folded = materialise(fold(plain, "text", path, **bounds), shared_dir(docs.sparkSession))
    row = folded.schema["row"]
    told = count_buckets(folded.where("bucket IS NOT NULL"), path)
    told = told.select("chunk", F.lit(0).alias("kind"), "start", "entries", "counts", F.lit(None).cast(row.dataType).alias("row"), F.lit(None).cast("long").alias("n_bytes"), F.lit(None).cast("long").alias("told"), F.lit(None).cast("binary").alias("freq"))
    lists = folded.where("bucket IS NULL").select("chunk", F.lit(1).alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("entries"), F.col("at").alias("counts"), "row", "n_bytes", "told", "freq")
    both = told.unionByName(lists).repartition("chunk").sortWithinPartitions("chunk", "kind")
    out = T.StructType([T.StructField("row", row.dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    @tidy
    def run(batches):
        chunk, pieces = None, np.zeros(0, np.int64)
        for b in batches:
            documents, sums = [], []
            for k, (of, kind, start, n, data) in enumerate(zip(*(b.column(j).to_pylist() for j in range(5)))):
                if of != chunk:
                    chunk, pieces = of, np.zeros(0, np.int64)
                if kind == 0:
                    if start + n > len(pieces):
                        pieces = np.concatenate([pieces, np.zeros(start + n, np.int64)])
                    pieces[start : start + n] = unpack_counts(data, n)
                else:
                    documents.append(k)
                    sums.append(b.column(7)[k].as_py() + int(pieces[unpack(data)] @ np.frombuffer(b.column(8)[k].as_py(), "u1").astype(np.int64)))
            if documents:
                b = b.take(pa.array(documents))
                yield pa.RecordBatch.from_arrays([b.column(5), b.column(6), pa.array(sums, pa.int64())], out.names)

    counted = both.mapInArrow(run, out)
    return counted.select(*[F.col(f"row.c{i}").alias(f.name) for i, f in enumerate(kinds)], "n_bytes", "n_tokens")
