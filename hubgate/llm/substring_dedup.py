r"""Removal of word sequences that occur more than once, by level-wise doubling.

A window is ``window`` consecutive words of one text (words: ``[^\x20\x09-\x0D]+``, unchanged). Every word covered by
a window whose sequence also starts anywhere else, in another text or the same one, is removed; windows are judged on
the input.

Candidates grow from short windows to long ones: a window of the full length stays a candidate at a level only if one
of its parts of that level's length is repeated, and only candidates are extended to twice the length, until the
window itself has been compared or no candidates survive. At a level every candidate window names one part, that with
the smallest hash; equal windows name equal parts, and neighbouring windows mostly name the same one, so a level looks
at a tenth of all positions. Level lengths are ``window`` halved, rounded up, down to at least ``first``.

Items (part hash, text, position) travel packed: a task gathers those of its texts, keeps one of each hash that it
saw alone and two of each that it saw more often (the rest is known to be repeated), and deals them to buckets by
hash, whose number follows the size of all texts. A bucket finds the hashes that came twice; their places go back to the
text they came from. Lower levels compare 64 bits, which only select; the full windows are compared by 128. Texts are
known by 128 bits of hash, so copies of a text share one answer, and a group of copies of any size sends each task's
share of it once. No list of places or texts is ever held in one task beyond a bucket's share. Where marks come back to
the texts, one row of marks meets all copies of a text, so an adaptive plan can split the copies between tasks.

Rows: null and empty texts have no words and keep an empty text; texts shorter than a window keep all words. Repeated
rows are copies: both lose what they repeat. All other columns pass through; ``n_words``, ``n_removed`` and the text
are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._storage import discard, prepare, tidy, written
from ._text import pieces, span_hashes, text_buffer, window_hashes, word_spans

_PLACE = np.dtype([("text", "<u4"), ("at", "<u4")])
_FLUSH_ITEMS = 2_000_000
#: A bucket for so many bytes of text, of whose positions the first level sends one in ten: some 4 MB of items.
_BUCKET_TEXT, _MOST_PARTITIONS = 16 << 20, 1 << 16


def level_lengths(window: int, first: int) -> list[int]:
    lengths = [window]
    while -(-lengths[0] // 2) >= first:
        lengths.insert(0, -(-lengths[0] // 2))
    return lengths


def sliding_argmin(values: np.ndarray, span: int) -> np.ndarray:
    """Position of the smallest of every ``span`` consecutive values (of their upper bits; then the first)."""
    n = len(values)
    if n < span:
        return np.zeros(0, np.int64)
    bits = np.uint64(max(20, n.bit_length()))
    low = (values >> bits << bits) | np.arange(n, dtype=np.uint64)
    size = 1
    while size < span:
        step = min(size, span - size)
        low = np.minimum(low[: len(low) - step], low[step:])
        size += step
    return (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def named_parts(words: np.ndarray, of_text: np.ndarray, window: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of every window that lies in one text, the start of the part it names, and all parts' hashes."""
    parts = window_hashes(words, length)
    named = sliding_argmin(parts, window - length + 1)
    text_end = np.repeat(of_text[1:], np.diff(of_text))
    starts = np.flatnonzero(np.arange(len(named)) + window <= text_end[: len(named)])
    return starts, named[starts], parts


def _order(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal rows of ``items`` together, and which of the rows so ordered equal the one before."""
    order = np.argsort(items[:, 0])
    s = items[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:, 0] == s[:-1, 0]
    if items.shape[1] > 1 and len(s) and (s[1:, 1:] != s[:-1, 1:])[same[1:]].any():
        order = np.lexsort(items.T[::-1])
        s = items[order]
        same[1:] = (s[1:] == s[:-1]).all(axis=1)
    return order, same


def _pack(buckets: int, chunk: str, keys: list[np.ndarray], hashes: list[np.ndarray], places: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of one chunk: its texts' keys, places known to be repeated, and its items by bucket."""
    h, p = np.concatenate(hashes), np.concatenate(places)
    order, same = _order(h)
    more = same.copy()
    more[:-1] |= same[1:]
    third = same.copy()
    third[1:] &= same[:-1]
    send = np.sort(order[~third])
    known = order[more]
    rows = [(-1, b"".join(k.tobytes() for k in keys), b""), (-2, b"", p[known].tobytes())]
    bucket = (h[send, 0] >> np.uint64(32)) % np.uint64(buckets)
    by = np.argsort(bucket, kind="stable")
    some, cuts = np.unique(bucket[by], return_index=True)
    for b, i, j in zip(some.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(by)], strict=True):
        own = send[by[i:j]]
        rows.append((b, h[own].tobytes(), p[own].tobytes()))
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk] * len(rows)), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
        names=["chunk", "bucket", "items", "places"],
    )


def _repeated(texts: DataFrame, length: int, window: int, buckets: int) -> DataFrame:
    """``k1, k2, marks``: the positions of the parts that are repeated, packed, for each text that has any.

    ``texts`` has k1, k2, text and ``marks`` of the level before (null at the first). The last level, which decides,
    compares 128 bits of hash.
    """
    lanes = 2 if length == window else 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, hashes, places, n, texts_seen = [], [], [], 0, 0
        for batch in batches:
            for rows in pieces(batch, "text"):
                data, offsets = text_buffer(rows.column(2))
                s, e, of_text = word_spans(data, offsets)
                words = span_hashes(data, s, e)
                alive = None
                if rows.column(3).null_count < rows.num_rows:
                    before = int(np.frombuffer(rows.column(3)[0].as_py()[:4], "<u4")[0])
                    starts, named, _ = named_parts(words, of_text, window, before)
                    marked = np.zeros(len(words) + 1, bool)
                    for i, m in enumerate(rows.column(3).to_pylist()):
                        marked[of_text[i] + np.frombuffer(m, "<u4")[1:].astype(np.int64)] = True
                    alive = np.zeros(len(words) + 1, bool)
                    alive[starts[marked[named]]] = True
                starts, named, parts = named_parts(words, of_text, window, length)
                if alive is not None:
                    named = named[alive[starts]]
                at = np.unique(named)
                text = np.searchsorted(of_text, at, side="right") - 1
                some, text_no = np.unique(text, return_inverse=True)
                place = np.empty(len(at), _PLACE)
                place["text"], place["at"] = text_no + texts_seen, at - of_text[text]
                texts_seen += len(some)
                keys.append(np.stack([rows.column(0).to_numpy()[some], rows.column(1).to_numpy()[some]], axis=1))
                second = [window_hashes(span_hashes(data, s, e, lane=1), length, lane=1)[at]] * (lanes - 1)
                hashes.append(np.stack([parts[at], *second], axis=1))
                places.append(place)
                n += len(at)
                if n >= _FLUSH_ITEMS:
                    yield _pack(buckets, uuid.uuid4().hex, keys, hashes, places)
                    keys, hashes, places, n, texts_seen = [], [], [], 0, 0
        if n:
            yield _pack(buckets, uuid.uuid4().hex, keys, hashes, places)

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        items = [np.frombuffer(x.as_py(), "<u8").reshape(-1, lanes) for x in group.column("items")]
        places = np.concatenate([np.frombuffer(x.as_py(), _PLACE) for x in group.column("places")])
        ends = np.cumsum([0, *map(len, items)])
        order, same = _order(np.concatenate(items))
        same[:-1] |= same[1:]
        twice = np.zeros(len(order), bool)
        twice[order] = same
        found = [places[a:b][twice[a:b]] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        some = [i for i, f in enumerate(found) if len(f)]
        return pa.table({"chunk": pa.array([group.column("chunk")[i].as_py() for i in some], pa.string()), "bucket": pa.array([-2] * len(some), pa.int32()), "items": pa.array([b""] * len(some), pa.binary()), "places": pa.array([found[i].tobytes() for i in some], pa.binary())})

    def back(key: tuple, group: pa.Table) -> pa.Table:
        own = group.column("bucket").to_pylist()
        keys = np.frombuffer(group.column("items")[own.index(-1)].as_py(), "<i8").reshape(-1, 2)
        marks = np.unique(np.concatenate([np.frombuffer(x.as_py(), _PLACE) for x in group.column("places")]))
        some, first = np.unique(marks["text"], return_index=True)
        head = np.array([length], "<u4").tobytes()
        runs = np.split(marks["at"], first[1:]) if len(some) else []
        return pa.table({"k1": pa.array(keys[some, 0]), "k2": pa.array(keys[some, 1]), "marks": pa.array([head + r.tobytes() for r in runs], pa.binary())})

    schema = "chunk string, bucket int, items binary, places binary"
    packed = written(texts.select("k1", "k2", "text", "marks").mapInArrow(cut, schema), f"windows-{length}")
    own = packed.filter("bucket >= 0")
    dealt = own.repartitionById(buckets, F.col("bucket")) if buckets <= _MOST_PARTITIONS else own.repartition(_MOST_PARTITIONS, "bucket")
    met = dealt.groupBy("bucket").applyInArrow(meet, schema)
    marks = packed.filter("bucket < 0").unionByName(met).groupBy("chunk").applyInArrow(back, "k1 long, k2 long, marks binary")
    # copies of a text in several chunks got the same marks, but for those that one of the chunks knew by itself
    found = written(marks.groupBy("k1", "k2").agg(F.max_by("marks", F.length("marks")).alias("marks")), f"repeated-{length}")
    discard(packed)
    return found


def remove_repeats(docs: DataFrame, *, text_col: str = "text", window: int = 35, first: int = 16, words_col: str = "n_words", removed_col: str = "n_removed") -> DataFrame:
    """``docs`` with ``text_col`` reduced to the kept words joined by one space, and the numbers of words before and
    removed."""
    spark = docs.sparkSession
    prepare(spark)
    keep = [c for c in docs.columns if c not in (words_col, removed_col)]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    k1, k2 = F.xxhash64(text), F.xxhash64(F.lit(11), text, F.length(text))
    source = docs.select(k1.alias("k1"), k2.alias("k2"), text.alias("text"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = 1 + size // _BUCKET_TEXT
    marks = None
    for length in level_lengths(window, first):
        texts = source.withColumn("marks", F.lit(None).cast("binary")) if marks is None else source.join(marks, ["k1", "k2"])
        before, marks = marks, _repeated(texts, length, window, buckets)
        del texts
        tidy(spark)
        if before is not None:
            discard(before)
        if marks.isEmpty():
            break
    base = docs.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in keep], k1.alias("__k1"), k2.alias("__k2"))
    found = marks.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("marks").alias("__marks"))
    joined = base.join(found, ["__k1", "__k2"], "left").select(*[F.col(f"`{c}`") for c in keep], "__marks")
    at = keep.index(text_col)
    schema = T.StructType([*joined.schema.fields[: len(keep)], T.StructField(words_col, T.LongType()), T.StructField(removed_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, keep[at]):
                data, offsets = text_buffer(rows.column(at))
                s, e, of_text = word_spans(data, offsets)
                raw, out, removed = data.tobytes(), [], []
                for i, m in enumerate(rows.column(len(keep)).to_pylist()):
                    a, b = int(of_text[i]), int(of_text[i + 1])
                    kept = np.arange(a, b)
                    if m:
                        edge = np.zeros(b - a + 1, np.int64)
                        starts = np.frombuffer(m, "<u4")[1:].astype(np.int64)
                        edge[starts] += 1
                        edge[starts + window] -= 1
                        kept = kept[np.cumsum(edge)[:-1] == 0]
                    removed.append(b - a - len(kept))
                    out.append(b" ".join([raw[x:y] for x, y in zip(s[kept].tolist(), e[kept].tolist(), strict=True)]).decode())
                yield pa.RecordBatch.from_arrays([*[pa.array(out, pa.string()) if k == at else rows.column(k) for k in range(len(keep))], pa.array(np.diff(of_text)), pa.array(removed, pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)
