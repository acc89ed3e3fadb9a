r"""Line deduplication by a sharded minimal perfect hash over line hashes.

A text's lines are what ``\n`` separates. A line's key is the line without white space at its ends (the six
characters of ``[\x20\x09-\x0D]``) and with A-Z lower-cased. Keys of at least ``min_chars`` code points that are
found in at least ``min_docs`` documents lose all their lines, except in the document with the largest id that holds
them.

Line keys are hashed to two 64-bit lanes and counted by document, with a combine in every batch of the scan. The
distinct keys of ``index_docs`` documents are dealt to shards of bounded size; every shard becomes a minimal perfect
hash of one lane that indexes compact arrays: fingerprint (the other lane), number of documents, largest id. Documents
probe these arrays and the numbers there decide; lines are never joined. Keys that share a first lane with another key
are listed apart and compared on both. While all shards together are small they are broadcast; beyond ``max_broadcast_bytes``
packets of line hashes are dealt to the shards, stream past them, and only the numbers of lines to drop come back.

Rows: a row is a document; repeated rows count, and rows that share the largest id all keep their lines. A null id is
smaller than any other; if all rows with a key have none, all keep it. A null or empty text has one empty line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._storage import prepare, written
from ._text import SPACE, mix, pieces, span_hashes, text_buffer

_NO_ID = np.iinfo(np.int64).min
_GAMMA, _LEVELS = 2.0, 40


class PerfectHash:
    """Minimal perfect hash by levels of bit arrays: a key sits at the first level where its slot is its own, and
    its number is the rank of that bit. Keys that share slots on all levels are listed apart."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.words = np.cumsum(sizes // 64) - sizes // 64
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts, left = [], [], keys
        for level in range(_LEVELS):
            if not len(left):
                break
            size = 64 * (int(len(left) * _GAMMA) // 64 + 1)
            slot = cls._slots(left, level, size)
            own = np.bincount(slot, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(own, bitorder="little").view("<u8"))
            left = left[~own[slot]]
        return cls(np.array(sizes, np.int64), np.concatenate([np.zeros(0, "<u8"), *parts]), np.sort(left))

    @staticmethod
    def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def __len__(self) -> int:
        return int(self.ranks[-1]) + len(self.rest)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of keys; any number, or -1, for what is no key."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (size, first) in enumerate(zip(self.sizes.tolist(), self.words.tolist(), strict=True)):
            slot = self._slots(keys[open_], level, size)
            word, bit = first + (slot >> 6), (slot & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit & np.uint64(1)).astype(bool)
            below = self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = self.ranks[word[hit]] + np.bitwise_count(below)
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            found = self.rest[at] == keys[open_]
            out[open_[found]] = self.ranks[-1] + at[found]
        return out


class Shard:
    """A perfect hash with the arrays it indexes."""

    FIELDS = ("sizes", "bits", "rest", "fingerprints", "counts", "largest", "others")
    TYPES = ("<i8", "<u8", "<u8", "<u8", "<u4", "<i8", "<i8")

    def __init__(self, *arrays: np.ndarray):
        self.arrays = arrays
        self.hash = PerfectHash(*arrays[:3])
        self.fingerprints, self.counts, self.largest, self.others = arrays[3:]

    @classmethod
    def build(cls, one: np.ndarray, two: np.ndarray, counts: np.ndarray, largest: np.ndarray) -> Shard:
        counts = np.minimum(counts, 0xFFFFFFFF)
        keys, first = np.unique(one, return_index=True)
        h = PerfectHash.build(keys)
        at = h.index(keys)
        arrays = [np.empty(len(keys), t) for t in cls.TYPES[3:6]]
        for a, values in zip(arrays, (two, counts, largest), strict=True):
            a[at] = values[first]
        # keys whose first lane another key has: four numbers each, compared on both lanes
        rest = np.setdiff1d(np.arange(len(one)), first)
        others = np.stack([one[rest].view(np.int64), two[rest].view(np.int64), counts[rest].astype(np.int64), largest[rest]], axis=1).reshape(-1)
        return cls(h.sizes, h.bits, h.rest, *arrays, others)

    def pack(self) -> list[bytes]:
        return [a.astype(t).tobytes() for a, t in zip(self.arrays, self.TYPES, strict=True)]

    @classmethod
    def unpack(cls, blobs: list[bytes]) -> Shard:
        return cls(*[np.frombuffer(b, t) for b, t in zip(blobs, cls.TYPES, strict=True)])

    def probe(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray, min_docs: int) -> np.ndarray:
        """Which of these lines, held by documents ``ids``, go: those whose count reaches ``min_docs``, but for the
        largest id."""
        if not len(self.fingerprints):
            return np.zeros(len(one), bool)
        at = self.hash.index(one)
        gone = (at >= 0) & (self.fingerprints[at] == two) & (self.counts[at] >= min_docs) & (self.largest[at] != ids)
        for a, b, count, last in self.others.reshape(-1, 4):
            if count >= min_docs:
                gone |= (one.view(np.int64) == a) & (two.view(np.int64) == b) & (ids != last)
        return gone


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line, and for each text its first line (n+1 entries)."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    first = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
    return starts, ends, first


def line_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the lines whose key has at least ``min_chars`` code points, and both hashes of their keys."""
    visible = np.flatnonzero(~SPACE[data])
    a, b = np.searchsorted(visible, starts), np.searchsorted(visible, ends)
    some = np.flatnonzero(b > a)
    s, e = visible[a[some]], visible[b[some] - 1] + 1
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    long = chars[e] - chars[s] >= min_chars
    some, s, e = some[long], s[long], e[long]
    return some, span_hashes(data, s, e, True, 0), span_hashes(data, s, e, True, 1)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def line_index(docs: DataFrame, *, id_col: str, text_col: str, min_chars: int, index_docs: int, shard_lines: int) -> tuple[DataFrame, int, int]:
    """Packed shards (one row each), their number and that of the lines they index."""
    spark = docs.sparkSession
    prepare(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, "text"):
                data, offsets = text_buffer(rows.column(1))
                starts, ends, first = line_spans(data, offsets)
                at, one, two = line_keys(data, starts, ends, min_chars)
                doc = np.searchsorted(first, at, side="right") - 1
                order = np.lexsort((doc, two, one))
                one, two, doc = one[order], two[order], doc[order]
                new = np.ones(len(one), bool)
                new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                once = new.copy()
                once[1:] |= doc[1:] != doc[:-1]
                head = np.flatnonzero(new)
                if len(head):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one[head].view(np.int64)), pa.array(two[head].view(np.int64)), pa.array(np.add.reduceat(once.astype(np.int64), head)), pa.array(np.maximum.reduceat(_ids(rows.column(0))[doc], head))],
                        names=["one", "two", "docs", "largest"],
                    )

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counted = source.mapInArrow(count, "one long, two long, docs long, largest long").groupBy("one", "two").agg(F.sum("docs").alias("docs"), F.max("largest").alias("largest"))
    frequent = written(counted.filter(F.col("docs") >= index_docs), "indexed-lines")
    lines = frequent.count()
    shards = max(1, -(-lines // shard_lines))

    def build(key: tuple, group: pa.Table) -> pa.Table:
        column = lambda c: group.column(c).to_numpy()
        blobs = Shard.build(column("one").view(np.uint64), column("two").view(np.uint64), column("docs"), column("largest")).pack()
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), **{f: pa.array([b], pa.binary()) for f, b in zip(Shard.FIELDS, blobs, strict=True)}})

    schema = "shard int, " + ", ".join(f"{f} binary" for f in Shard.FIELDS)
    packed = frequent.withColumn("shard", F.pmod(F.shiftrightunsigned("one", 20), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(build, schema)
    return written(packed, "line-shards"), shards, lines


def _shard_of(one: np.ndarray, shards: int) -> np.ndarray:
    return (one >> np.uint64(20)) % np.uint64(shards)


def _rewrite(rows: pa.RecordBatch, text_at: int, drop_of) -> list[pa.Array]:
    """Kept text, number of lines and of dropped lines of each row."""
    data, offsets = text_buffer(rows.column(text_at))
    starts, ends, first = line_spans(data, offsets)
    drop = drop_of(data, starts, ends, first)
    gone = np.concatenate([[0], np.cumsum(drop)])
    dropped = gone[first[1:]] - gone[first[:-1]]
    raw, texts = data.tobytes(), rows.column(text_at).fill_null("").to_pylist()
    for i in np.flatnonzero(dropped).tolist():
        own = np.arange(first[i], first[i + 1])[~drop[first[i] : first[i + 1]]]
        texts[i] = b"\n".join(raw[s:e] for s, e in zip(starts[own].tolist(), ends[own].tolist(), strict=True)).decode()
    return [pa.array(texts, pa.string()), pa.array(np.diff(first)), pa.array(dropped)]


def drop_frequent_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    lines_col: str = "n_lines",
    dropped_col: str = "n_dropped",
    index_docs: int | None = None,
    shard_lines: int = 500_000,
    max_broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """``docs`` with frequent lines dropped from ``text_col``, and the numbers of lines before and dropped (columns
    of these names are replaced).

    Lines found in ``index_docs`` documents are indexed, by default ``min_docs``; the counts decide in any case, so a
    smaller number (1: every distinct line) gives the same result from a larger index.
    """
    spark = docs.sparkSession
    index, shards, lines = line_index(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, index_docs=min_docs if index_docs is None else min(index_docs, min_docs), shard_lines=shard_lines)
    keep = [c for c in docs.columns if c not in (lines_col, dropped_col)]
    base = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in keep], F.col(f"`{id_col}`").cast("long").alias("__id"))
    at = keep.index(text_col)
    schema = T.StructType([*base.schema.fields[: len(keep)], T.StructField(lines_col, T.LongType()), T.StructField(dropped_col, T.LongType())])
    if 48 * lines > max_broadcast_bytes:
        return _drop_by_packets(base, index, shards, schema, at, min_chars, min_docs)
    tables = {r.shard: [bytes(r[f]) for f in Shard.FIELDS] for r in index.collect()}
    shared = spark.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {k: Shard.unpack(v) for k, v in shared.value.items()}
        for batch in batches:
            for rows in pieces(batch, keep[at]):
                ids = _ids(rows.column(len(keep)))

                def drop_of(data, starts, ends, first, ids=ids):
                    line, one, two = line_keys(data, starts, ends, min_chars)
                    doc = np.searchsorted(first, line, side="right") - 1
                    drop, shard = np.zeros(len(starts), bool), _shard_of(one, shards)
                    for k, table in index.items():
                        own = np.flatnonzero(shard == np.uint64(k))
                        drop[line[own]] = table.probe(one[own], two[own], ids[doc[own]], min_docs)
                    return drop

                text, n, dropped = _rewrite(rows, at, drop_of)
                yield pa.RecordBatch.from_arrays([*[text if i == at else rows.column(i) for i in range(len(keep))], n, dropped], names=schema.names)

    return base.mapInArrow(run, schema)


def _drop_by_packets(base: DataFrame, index: DataFrame, shards: int, schema: T.StructType, at: int, min_chars: int, min_docs: int, deals: int = 8) -> DataFrame:
    """The same for an index too large to broadcast. Rows are known by 128 bits of hash over id and text; equal rows
    have equal lines to drop. Every shard is met by ``deals`` tasks, so a hot one is shared between them; packets
    stream past the shard in order, one at a time."""
    keep = schema.names[:-2]
    text = keep[at]
    keyed = base.withColumn("__k1", F.xxhash64("__id", F.col(f"`{text}`"))).withColumn("__k2", F.xxhash64(F.col(f"`{text}`"), F.lit(7), "__id"))
    names = ("k1", "k2", "line", "one", "two", "id")
    kinds = ("<i8", "<i8", "<i4", "<u8", "<u8", "<i8")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, "text"):
                data, offsets = text_buffer(rows.column(3))
                starts, ends, first = line_spans(data, offsets)
                line, one, two = line_keys(data, starts, ends, min_chars)
                doc = np.searchsorted(first, line, side="right") - 1
                columns = (rows.column(0).to_numpy()[doc], rows.column(1).to_numpy()[doc], line - first[doc], one, two, _ids(rows.column(2))[doc])
                shard = _shard_of(one, shards)
                for k in np.unique(shard).tolist():
                    own = np.flatnonzero(shard == np.uint64(k))
                    deal = int(columns[0][own[0]] % deals)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([deal], pa.int32()), pa.array([1], pa.int32()), *[pa.array([c[own].astype(t).tobytes()], pa.binary()) for c, t in zip(columns, kinds, strict=True)]], names=["shard", "deal", "kind", *names])

    slots = [f"b{i}" for i in range(len(Shard.FIELDS))]
    packets = keyed.select("__k1", "__k2", F.col("__id").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(cut, "shard int, deal int, kind int, " + ", ".join(f"{n} binary" for n in names))
    packets = packets.select("shard", "deal", "kind", *[(F.col(names[i]) if i < len(names) else F.lit(None).cast("binary")).alias(c) for i, c in enumerate(slots)])
    tables = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"), F.lit(0).alias("kind"), *[F.col(f).alias(s) for f, s in zip(Shard.FIELDS, slots, strict=True)])
    met = tables.unionByName(packets).repartition(F.col("shard"), F.col("deal")).sortWithinPartitions("shard", "deal", "kind")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, owner = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                r = [c[row].as_py() for c in batch.columns]
                if r[2] == 0:
                    table, owner = Shard.unpack(r[3:]), r[0]
                elif owner == r[0]:
                    k1, k2, line, one, two, ids = (np.frombuffer(b, t) for b, t in zip(r[3:], kinds, strict=False))
                    gone = table.probe(one, two, ids, min_docs)
                    if gone.any():
                        yield pa.RecordBatch.from_arrays([pa.array(k1[gone]), pa.array(k2[gone]), pa.array(line[gone])], names=["__k1", "__k2", "line"])

    gone = met.mapInArrow(probe, "__k1 long, __k2 long, line int").groupBy("__k1", "__k2").agg(F.collect_set("line").alias("__gone"))
    joined = keyed.join(gone, ["__k1", "__k2"], "left").select(*[F.col(f"`{c}`") for c in keep], "__gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, text):
                lists = rows.column(len(keep)).to_pylist()

                def drop_of(data, starts, ends, first, lists=lists):
                    drop = np.zeros(len(starts), bool)
                    for i, lines in enumerate(lists):
                        if lines:
                            drop[first[i] + np.array(lines)] = True
                    return drop

                out, n, dropped = _rewrite(rows, at, drop_of)
                yield pa.RecordBatch.from_arrays([*[out if i == at else rows.column(i) for i in range(len(keep))], n, dropped], names=schema.names)

    return joined.mapInArrow(run, schema)
