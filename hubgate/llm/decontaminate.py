r"""Benchmark decontamination: windows of item size, SimHash, and exact verification.

An item's words (``[^\x20\x09-\x0D]+``, A-Z lower-cased) are its passage; a window of a document is as many consecutive
words. Passages and windows are compared as bags of shingles of ``shingle`` words (an item with fewer words is one
shingle): the similarity is the sum of the smaller over the sum of the larger counts, and a window of at least
``similar`` percent is a hit.

SimHash decides what is compared: the sign of each of 128 bits summed over a bag's shingles. The second and later
occurrences of a shingle in a bag have signs of their own, so a repeated word does not weigh as one large vector and the
shared part of two bags is the shared part of their sums. Fingerprints are cut into 8 blocks of 16 bits. If two of them
differ in at most ``radius`` bits, some block differs in at most radius // 8 bits (pigeonhole); every item is filed in
each block's table under all values within that distance, so probing a window's own block values finds every item
within the radius, for certain. Candidates within the radius are verified on the full bags.

Radius: at a similarity of 0.8 the cosine of two bags of equal size is 0.89, and a bit differs with a probability of
0.15; by the binomial, 31 or fewer of 128 bits then differ for 0.998 of the pairs, for 0.99995 at 0.85, and for nearly
all above. An item's values within 3 bits are 697 of 65,536 in each of 8 tables, so a window that has nothing in common
with an item becomes its candidate once in 12 times.

A window without any shingle of any item has similarity 0 to all of them. Only windows that hold one are
fingerprinted, which loses nothing.

The benchmark is broadcast in blocks of at most ``block_items`` items and ``block_words`` words; an item longer than that
is a block of its own. A scan of the documents holds them against ``scan_blocks`` blocks, whose indexes (some 70 MB each
at most) a Python worker builds once; a larger benchmark takes several scans.

Rows: null and empty texts and items have no words and no hits. An item without an id counts like any other; its hits
have a null ``item_id``, one for each such item. A passage of a longer item is no hit for it (windows
have the item's size). Repeated rows give hits each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._storage import prepare
from ._text import gather_runs, mix, pieces, span_hashes, text_buffer, window_hashes, word_spans

_SIGN_SALTS = np.array([0x452821E638D01377, 0xBE5466CF34E90C6C], np.uint64)
_BITS, _BLOCK = 128, 16
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 and -1 for each of 128 bits of each shingle's hashes."""
    bits = np.unpackbits(mix(shingles[:, None] ^ _SIGN_SALTS).view(np.uint8).reshape(-1, _BITS // 8), axis=1)
    return bits.view(np.int8) * np.int8(2) - np.int8(1)


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of 128 sums: the 8 block values of each."""
    return np.packbits(sums > 0, axis=1).view("<u2").reshape(-1, _BITS // _BLOCK)


def occurrences(shingles: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Shingles with their occurrence number (from 1) in a bag, as hashes; a first occurrence is the shingle itself."""
    return shingles ^ ((number - 1).astype(np.uint64) * _TIMES)


def bag_sums(shingles: np.ndarray) -> np.ndarray:
    """Sums of the signs of a bag's occurrences."""
    own = np.sort(shingles)
    return signs(occurrences(own, np.arange(len(own)) - np.searchsorted(own, own) + 1)).sum(axis=0, dtype=np.int32)


def repeat_distances(runs: np.ndarray) -> np.ndarray:
    """How far the nearest equal entry is, for every entry."""
    out = np.full(len(runs), np.iinfo(np.int64).max)
    order = np.argsort(runs, kind="stable")
    same = np.flatnonzero(runs[order[1:]] == runs[order[:-1]])
    a, b = order[same], order[same + 1]
    out[a] = b - a
    out[b] = np.minimum(out[b], b - a)
    return out


def window_sums(runs: np.ndarray, distances: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """``bag_sums`` of the windows of ``size`` entries at ``starts``, from running sums over the stretches they cover.

    A window that moves on takes in an entry under the number of its occurrences there, and lets go of one under the
    number of occurrences it still had; over a whole stretch the two come to the same.
    """
    cover = np.zeros(len(runs) + 1, np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + size, -1)
    used = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    place = np.searchsorted(used, starts)
    taken = runs[used]
    again = np.flatnonzero(distances[used] < size)
    if len(again):
        # places a window's size apart between stretches, so that no window reaches into another one
        spread = np.concatenate([[0], np.cumsum(np.diff(used) > 1)]) * size + np.arange(len(used))
        again = again[np.argsort(taken[again], kind="stable")]
        value, at = taken[again], spread[again]
        key = np.concatenate([[0], np.cumsum(value[1:] != value[:-1])]) * (spread[-1] + size + 1) + at
        here = np.arange(len(key))
        came = here - np.searchsorted(key, key - size + 1) + 1
        went = np.searchsorted(key, key + size) - here
        taken[again] = occurrences(value, came)
        other = np.flatnonzero(came != went)
        other = other[np.argsort(again[other])]
        change = np.concatenate([np.zeros((1, _BITS), np.int32), np.cumsum(signs(occurrences(value[other], went[other])).astype(np.int16) - signs(taken[again[other]]), axis=0, dtype=np.int32)])
    sums = np.concatenate([np.zeros((1, _BITS), np.int32), np.cumsum(signs(taken), axis=0, dtype=np.int32)])
    out = sums[place + size] - sums[place]
    return out - change[np.searchsorted(again[other], place)] if len(again) else out


class BlockIndex:
    """Items by the values of their fingerprint's blocks, each filed under all values within the block radius."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        near = [0]
        for r in range(1, radius // prints.shape[1] + 1):
            near += [sum(1 << b for b in c) for c in combinations(range(_BLOCK), r)]
        masks = np.array(near, np.uint16)
        items = np.repeat(np.arange(len(prints), dtype=np.int32), len(masks))
        self.tables = []
        for b in range(prints.shape[1]):
            values = (prints[:, b][:, None] ^ masks[None, :]).reshape(-1)
            order = np.argsort(values, kind="stable")
            self.tables.append((values[order], items[order]))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (fingerprint, item), each once, of which some block is within the block radius."""
        pairs = []
        for b, (values, items) in enumerate(self.tables):
            own = np.ascontiguousarray(prints[:, b])
            first = np.searchsorted(values, own)
            n = np.searchsorted(values, own, side="right") - first
            pairs.append(np.repeat(np.arange(len(prints)), n) * len(self.prints) + items[gather_runs(first, n, np.arange(len(n)))[0]])
        return np.divmod(np.unique(np.concatenate(pairs)), max(1, len(self.prints)))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (fingerprint, item) at a distance of at most the radius."""
        q, i = self.candidates(prints)
        near = np.bitwise_count(prints[q] ^ self.prints[i]).sum(axis=1) <= self.radius
        return q[near], i[near]


class ItemGroup:
    """Items of one length in words: their bags, sorted, and the index of their fingerprints. Ids are (False, id), or
    (True, place) for an item without one."""

    def __init__(self, size: int, shingle: int, ids: list[tuple[bool, int]], bags: list[np.ndarray], radius: int):
        self.size, self.shingle, self.ids = size, min(shingle, size), ids
        self.bags = [np.unique(b, return_counts=True) for b in bags]
        self.index = BlockIndex(fingerprints(np.stack([bag_sums(b) for b in bags])), radius)

    @property
    def per_window(self) -> int:
        return self.size - self.shingle + 1


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffer(column)
    s, e, of_text = word_spans(data, offsets)
    return span_hashes(data, s, e, lower=True), of_text


def group_items(items: list[tuple[int | None, str]], shingle: int, radius: int, first: int = 0) -> list[ItemGroup]:
    """Items by length; ``first`` is the place of the first one in the benchmark."""
    words, of_text = _words(pa.array([t for _, t in items], pa.string()))
    by_size: dict[int, tuple[list, list]] = {}
    for place, ((item, _), a, b) in enumerate(zip(items, of_text[:-1].tolist(), of_text[1:].tolist(), strict=True)):
        if b > a:
            ids, bags = by_size.setdefault(b - a, ([], []))
            ids.append((True, first + place) if item is None else (False, item))
            bags.append(window_hashes(words[a:b], min(shingle, b - a)))
    return [ItemGroup(n, shingle, ids, bags, radius) for n, (ids, bags) in sorted(by_size.items())]


_last: dict[str, list[ItemGroup]] = {}


def _built(blocks: list[tuple[str, int, list]], shingle: int, radius: int) -> list[ItemGroup]:
    """The groups of a scan's blocks (name, place of the first item, items), kept for the worker's next task."""
    name = "|".join(b[0] for b in blocks)
    if name not in _last:
        _last.clear()
        _last[name] = [g for _, first, items in blocks for g in group_items(items, shingle, radius, first)]
    return _last[name]


def _overlap(shingles: np.ndarray, bag: tuple[np.ndarray, np.ndarray]) -> int:
    values, counts = bag
    at = np.minimum(np.searchsorted(values, shingles), len(values) - 1)
    own = np.bincount(at[values[at] == shingles], minlength=len(values))
    return int(np.minimum(own, counts).sum())


def find_hits(column: pa.Array, groups: list[ItemGroup], similar: int) -> Iterator[tuple[int, int | None, int, int, int, int]]:
    """Text, item, first word of the best window, its words, smaller and larger counts; one per text and item."""
    words, of_text = _words(column)
    every = {size: np.unique(np.concatenate([v for g in groups if g.shingle == size for v, _ in g.bags])) for size in {g.shingle for g in groups}}

    def of_items(size: int) -> tuple[np.ndarray, np.ndarray]:
        runs = window_hashes(words, size)
        return runs, every[size][np.minimum(np.searchsorted(every[size], runs), len(every[size]) - 1)] == runs

    # texts without any shingle of any item go at once
    some = np.unique(np.concatenate([np.searchsorted(of_text, np.flatnonzero(of_items(size)[1]), side="right") - 1 for size in every]))
    if not len(some):
        return
    at, ends = gather_runs(of_text[:-1], np.diff(of_text), some)
    words, of_text = words[at], np.concatenate([[0], ends])
    end = np.repeat(of_text[1:], np.diff(of_text))
    known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for size in every:
        runs, held = of_items(size)
        known[size] = runs, np.concatenate([[0], np.cumsum(held)]), repeat_distances(runs)
    best: dict[tuple[int, bool, int], tuple[float, int, int, int, int]] = {}
    for g in groups:
        runs, seen, distances = known[g.shingle]
        m = len(words) - g.size + 1
        if m <= 0:
            continue
        starts = np.arange(m)
        starts = starts[(starts + g.size <= end[:m]) & (seen[g.per_window : g.per_window + m] > seen[:m])]
        for part in np.array_split(starts, -(-len(starts) // 50_000) or 1):
            if not len(part):
                continue
            q, i = g.index.within(fingerprints(window_sums(runs, distances, part, g.per_window)))
            for w, item in zip(part[q].tolist(), i.tolist(), strict=True):
                both = _overlap(runs[w : w + g.per_window], g.bags[item])
                either = 2 * g.per_window - both
                if both * 100 >= similar * either:
                    text = int(np.searchsorted(of_text, w, side="right")) - 1
                    found = (both / either, -(w - int(of_text[text])), g.size, both, either)
                    key = (text, *g.ids[item])
                    if key not in best or found > best[key]:
                        best[key] = found
    for (text, nameless, item), (_, start, size, both, either) in sorted(best.items()):
        yield int(some[text]), None if nameless else item, -start, size, both, either


def item_blocks(items: Iterable[tuple[int | None, str]], block_items: int, block_words: int) -> Iterator[list[tuple[int | None, str]]]:
    block, words = [], 0
    for item in items:
        n = len(item[1].split())
        if block and (len(block) >= block_items or words + n > block_words):
            yield block
            block, words = [], 0
        block.append(item)
        words += n
    if block:
        yield block


def _scans(benchmark: DataFrame, item_col: str, item_text_col: str, block_items: int, block_words: int, scan_blocks: int) -> Iterator[list[Broadcast]]:
    """The benchmark as broadcast blocks, ``scan_blocks`` for each scan; items come to the driver one block at a time."""
    passages = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text")).filter("text is not null")
    scan, first = [], 0
    for block in item_blocks(((r[0], r[1]) for r in passages.toLocalIterator()), block_items, block_words):
        scan.append(benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, first, block)))
        first += len(block)
        if len(scan) == scan_blocks:
            yield scan
            scan = []
    if scan:
        yield scan


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = 5,
    similar: int = 80,
    radius: int = 31,
    block_items: int = 2_000,
    block_words: int = 400_000,
    scan_blocks: int = 4,
) -> DataFrame:
    """Hits: ``doc_id, item_id, first_word, n_words, n_common, n_either``, the best (then first) window of every row
    of ``docs`` for every item it holds. Clean documents have no row."""
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    names = ["doc_id", "item_id", "first_word", "n_words", "n_common", "n_either"]
    schema = ", ".join(f"{n} long" for n in names)
    out = None
    for scan in _scans(benchmark, item_col, item_text_col, block_items, block_words, scan_blocks):

        def run(batches: Iterator[pa.RecordBatch], scan=scan) -> Iterator[pa.RecordBatch]:
            groups = _built([b.value for b in scan], shingle, radius)
            for batch in batches:
                for rows in pieces(batch, "text", 1 << 21):
                    hits = list(find_hits(rows.column(1), groups, similar)) if groups else []
                    if hits:
                        text, *rest = (pa.array(c, pa.int64()) for c in zip(*hits, strict=True))
                        yield pa.RecordBatch.from_arrays([rows.column(0).take(text), *rest], names=names)

        found = source.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, similar: int = 80, radius: int = 31, block_items: int = 2_000, block_words: int = 400_000, scan_blocks: int = 4) -> DataFrame:
    """``docs`` without the rows that hold a passage; rows are judged where they are read, without a join."""
    spark = docs.sparkSession
    prepare(spark)
    at = docs.columns.index(text_col)
    out = docs
    for scan in _scans(benchmark, item_col, item_text_col, block_items, block_words, scan_blocks):

        def run(batches: Iterator[pa.RecordBatch], scan=scan) -> Iterator[pa.RecordBatch]:
            groups = _built([b.value for b in scan], shingle, radius)
            for batch in batches:
                for rows in pieces(batch, text_col, 1 << 21):
                    clean = np.ones(rows.num_rows, bool)
                    if groups:
                        clean[[h[0] for h in find_hits(rows.column(at), groups, similar)]] = False
                    yield rows.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
