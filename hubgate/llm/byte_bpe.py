"""Byte-level BPE over Arrow batches: encoding with offsets by the tokenizers library, decoding by the byte table.

The vocabulary is a rank file (base64 token, rank). Its bytes are mapped to printable characters, as byte-level BPE
models of the library want them, and its merges are rebuilt from the ranks: every way to split a token into two
tokens is a merge, ordered by the rank of the result. The lowest rank merges first, as in the rank-file encoder; a
match of the pattern that is a token itself is taken whole. The order among splits of one token could only matter
where two of them overlap, that is in texts of one repeated unit; the tests compare those too.

Rows: null and empty texts give no tokens. Long texts are encoded in parts cut before ASCII white space that follows
a visible character, where no match of the pattern can cross; results do not depend on the part size. Lone
surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._storage import prepare
from ._text import SPACE, binary_column, distinct_spans, gather_runs, pieces, text_buffer

_SAFE = re.compile(r"(?<=[^\s])[ \t\n\r\v\f]")
PART_CHARS = 1 << 16
BATCH_CHARS = 1 << 18


def safe_parts(text: str, most: int = PART_CHARS) -> list[str]:
    """``text`` in order, cut at the first safe boundary after every ``most`` characters."""
    parts, at = [], 0
    while len(text) - at > most and (cut := _SAFE.search(text, at + most)):
        parts.append(text[at : cut.start()])
        at = cut.start()
    parts.append(text[at:] if at else text)
    return parts


def byte_characters() -> list[str]:
    """The character of each byte: visible Latin-1 characters stand for themselves, the rest follow from U+0100."""
    visible = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    extra = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(extra)) for b in range(256)]


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every split of a token into two tokens, by the token's rank, longer left part first."""
    return [(t[:i], t[i:]) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) for i in range(len(t) - 1, 0, -1) if t[:i] in ranks and t[i:] in ranks]


def tokenizer_json(content: bytes, pattern: str) -> str:
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(content), byte_characters()
    name = {t: "".join(chars[b] for b in t) for t in ranks}
    model = models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=[(name[a], name[b]) for a, b in merges_of(ranks)], ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer.to_str()


@lru_cache(maxsize=2)
def _tokenizer(json: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(json)


def single_threaded() -> None:
    """Tasks are the unit of parallelism; the library's own threads would oversubscribe an executor's cores."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def balanced(texts: list[str | None], most: int = BATCH_CHARS, part: int = PART_CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """Row numbers and parts of texts in order, in batches of about ``most`` characters."""
    rows: list[int] = []
    parts: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        for p in safe_parts(text or "", part):
            rows.append(row)
            parts.append(p)
            size += len(p)
            if size >= most:
                yield rows, parts
                rows, parts, size = [], [], 0
    if parts:
        yield rows, parts


def encode_texts(tokenizer, texts: list[str | None], offsets: bool = False) -> tuple[list[np.ndarray], list[np.ndarray] | None]:
    """Ids of each text and, if asked, the character spans of its tokens (a token that is part of a character
    has the span of the whole character)."""
    ids: list[list[np.ndarray]] = [[] for _ in texts]
    spans: list[list[np.ndarray]] = [[] for _ in texts]
    base = [0] * len(texts)
    encode = tokenizer.encode_batch if offsets else tokenizer.encode_batch_fast
    for rows, parts in balanced(texts):
        for row, part, found in zip(rows, parts, encode(parts, add_special_tokens=False), strict=True):
            ids[row].append(np.array(found.ids, np.uint32))
            if offsets:
                spans[row].append(np.array(found.offsets, np.int64).reshape(-1, 2) + base[row])
                base[row] += len(part)
    one = lambda x, empty: x[0] if len(x) == 1 else np.concatenate(x) if x else empty
    return [one(x, np.zeros(0, np.uint32)) for x in ids], [one(x, np.zeros((0, 2), np.int64)) for x in spans] if offsets else None


class ByteTable:
    """Bytes of every id in one buffer; decoding gathers spans of it."""

    def __init__(self, ranks: dict[bytes, int]):
        n = max(ranks.values(), default=-1) + 1
        tokens = [b""] * n
        for t, r in ranks.items():
            tokens[r] = t
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.length) - self.length

    def decode_runs(self, ids: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of consecutive runs of ids that end at ``stops``, and where each run's bytes end."""
        at, ends = gather_runs(self.begin, self.length, ids.astype(np.int64))
        return self.data[at], np.concatenate([[0], ends])[stops]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_runs(ids, np.array([len(ids)]))[0].tobytes()

    def decode_text(self, runs: list[np.ndarray]) -> list[str]:
        """Text of consecutive runs of ids. A character split between runs appears with the run that ends it;
        bytes that are no UTF-8 become U+FFFD."""
        import codecs

        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        return [decoder.decode(self.decode(run), final=i == len(runs) - 1) for i, run in enumerate(runs)]


def chunk_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut at every safe boundary: starts, ends, and for each text its first chunk (n+1 entries).

    The boundaries are ASCII white space after a byte that is neither ASCII white space nor the end of a character
    that could be white space beyond ASCII (U+0085, U+00A0, and all of U+1680-16BF, U+2000-207F and U+3000-303F).
    """
    cut = np.zeros(len(data) + 1, bool)
    if len(data):
        space = SPACE[data]
        cut[1:-1] = space[1:] & ~space[:-1]
        high = np.flatnonzero(cut[:-1] & np.concatenate([[False], data[:-1] >= 0x80]))
        high = high[high >= 2]
        b1, b2 = data[high - 1], data[high - 2]
        b3 = np.where(high >= 3, data[np.maximum(high - 3, 0)], 0)
        blank = (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
        blank |= (b3 == 0xE1) & (b2 == 0x9A) | (b3 == 0xE2) & ((b2 == 0x80) | (b2 == 0x81)) | (b3 == 0xE3) & (b2 == 0x80)
        cut[high[blank]] = False
    cut[offsets] = True
    cut[len(data)] = False
    starts = np.flatnonzero(cut)
    return starts, np.concatenate([starts[1:], [len(data)]])[: len(starts)], np.searchsorted(starts, offsets)


CACHED_CHUNKS = 100_000


def cached(chunks: list[bytes], encode, cache: dict[bytes, object]) -> list:
    """What ``encode`` gives for each chunk. ``cache`` keeps results of short chunks between batches until it is
    full; it changes the speed only."""
    found = [cache.get(c) for c in chunks]
    missing = [i for i, x in enumerate(found) if x is None]
    at = 0
    for _, parts in balanced([chunks[i].decode() for i in missing], part=1 << 62):
        for x in encode(parts):
            i = missing[at]
            found[i] = x
            if len(cache) < CACHED_CHUNKS and len(chunks[i]) <= 32:
                cache[chunks[i]] = x
            at += 1
    return found


def encode_column(tokenizer, column: pa.Array, cache: dict[bytes, object]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and n+1 offsets. Equal chunks between safe boundaries are encoded once."""
    data, offsets = text_buffer(column)
    starts, ends, of_text = chunk_spans(data, offsets)
    first, place = distinct_spans(data, starts, ends)
    raw = data.tobytes()
    chunks = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    found = cached(chunks, lambda parts: [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch_fast(parts, add_special_tokens=False)], cache)
    length = np.fromiter(map(len, found), np.int64, len(found)) // 4
    flat = np.frombuffer(b"".join(found), "<u4")
    at, stops = gather_runs(np.cumsum(length) - length, length, place)
    return flat[at], np.concatenate([[0], stops])[of_text]


def encode(
    docs: DataFrame, ranks: bytes, pattern: str, *, text_col: str = "text", ids_col: str = "ids", offsets_col: str | None = None, decoded_col: str | None = None
) -> DataFrame:
    """``docs`` with the token ids of ``text_col`` in ``ids_col``, packed as little-endian unsigned 32-bit integers
    (``unpack`` makes them an array), and, if ``offsets_col`` is named, an array of (start, end) characters per
    token. ``decoded_col`` adds what the ids decode to in the same pass (``decode`` does it later). Columns of these
    names are replaced."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast((tokenizer_json(ranks, pattern), ranks if decoded_col else b""))
    keep = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (ids_col, offsets_col, decoded_col)], F.col(f"`{text_col}`").cast("string").alias("__text"))
    i = len(keep.columns) - 1
    schema = T.StructType([*keep.schema.fields[:i], T.StructField(ids_col, T.BinaryType())])
    if offsets_col:
        schema = schema.add(offsets_col, T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))

    if decoded_col:
        schema = T.StructType([*schema.fields, T.StructField(decoded_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        tokenizer, table, cache = _tokenizer(shared.value[0]), ByteTable(read_ranks(shared.value[1])), {}
        for batch in batches:
            for rows in pieces(batch, "__text", 1 << 21):
                if offsets_col:
                    each, spans = encode_texts(tokenizer, rows.column(i).to_pylist(), True)
                    ids, stops = np.concatenate([np.zeros(0, np.uint32), *each]), np.cumsum([0, *map(len, each)])
                    both = np.concatenate([np.zeros((0, 2), np.int64), *spans]).astype(np.int32)
                    pairs = pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["start", "end"])
                    more = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, spans)], dtype=np.int32)), pairs)]
                else:
                    ids, stops = encode_column(tokenizer, rows.column(i), cache)
                    more = []
                packed = binary_column(ids.astype("<u4").view(np.uint8), stops * 4)
                if decoded_col:
                    more.append(binary_column(*table.decode_runs(ids, stops)))
                yield pa.RecordBatch.from_arrays([*rows.columns[:i], packed, *more], names=schema.names)

    return keep.mapInArrow(run, schema)


def unpack(ids: Column) -> Column:
    """Packed ids as an array of ints."""
    at = F.sequence(F.lit(0), (F.length(ids) / 4 - 1).cast("int"))
    swap = lambda h: F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])
    return F.when(F.length(ids) > 0, F.transform(at, lambda i: F.conv(swap(F.substr(F.hex(ids), i * 8 + 1, F.lit(8))), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))


def decode(docs: DataFrame, ranks: bytes, *, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of the packed ids in ``bytes_col``: the exact bytes, also where ids end inside a
    character; null ids give none."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(ranks)
    keep = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != bytes_col])
    i = keep.columns.index(ids_col)
    schema = T.StructType([*keep.schema.fields, T.StructField(bytes_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ByteTable(read_ranks(shared.value))
        for batch in batches:
            for rows in pieces(batch, ids_col, 1 << 21):
                data, offsets = text_buffer(rows.column(i))
                yield pa.RecordBatch.from_arrays([*rows.columns, binary_column(*table.decode_runs(np.frombuffer(data.tobytes(), "<u4"), offsets // 4))], names=schema.names)

    return keep.mapInArrow(run, schema)
