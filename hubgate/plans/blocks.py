"""All-pairs passes in blocks: one matrix product per block pair, only top lists and sums leave a task.

Queries are broadcast and gallery rows stream past them where they are read, so no gallery row is shuffled. A query
side of more than ``broadcast_bytes`` (as counted) is dealt to parts of that size; the gallery is read once for each,
and the parts' results are merged by grouped aggregates. A task keeps one running top list per query and emits it
when it ends, so (queries x k) rows leave a task however many gallery rows it reads; parts are small enough for the
lists to fit in ``state_bytes``. At most ``cells`` similarities exist in a task at once, however large the blocks, so
a task's memory is its part of the queries, their lists and a few arrays of that size. The matrix of all similarities
never exists, but for ``all_pairs``, whose rows are the pairs.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])
#: Pairs in an Arrow batch where all of them are wanted.
_PAIR_ROWS = 1 << 16
#: Most queries that a kernel gets at once.
_QUERY_ROWS = 4096


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package even if the driver put it on sys.path by hand."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, have) if x)


@dataclass(frozen=True)
class Blocks:
    """Rows of a block, the largest broadcast of queries, the largest state of a task and the similarities it computes
    at once. A part has at least one block of queries; of a block beyond ``_QUERY_ROWS`` a task takes so many at a
    time."""

    queries: int = 4096
    gallery: int = 4096
    broadcast_bytes: int = 128 << 20
    state_bytes: int = 32 << 20
    cells: int = 1 << 18


def tiles(rows: int, columns: int, cells: int) -> Iterator[slice]:
    """Even cuts of a block's rows: each has at most ``cells`` similarities to the columns, or one row."""
    n = -(-rows // max(1, cells // max(1, columns)))
    return (slice(rows * i // n, rows * (i + 1) // n) for i in range(n))


def part_count(n: int, width: int, state: int, blocks: Blocks) -> int:
    """Parts that the queries are dealt to, so that neither a part's vectors nor its state take more than they may."""
    most = max(blocks.queries, blocks.broadcast_bytes // (8 * width))
    return -(-n // max(1, min(most, blocks.state_bytes // max(state, 1))))


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


class Kernel:
    """What a task does with the pairs it sees: ``add`` gets a block of queries (``at``: their place in the part) and
    one of gallery rows, ``finish`` is called when all have been seen."""

    def add(self, at: int, qids: np.ndarray, left: np.ndarray, cids: np.ndarray, right: np.ndarray, extras: dict) -> Iterator[pa.RecordBatch]:
        yield from ()

    def block_done(self, cids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Called when a block of gallery rows has met all queries of the part."""
        yield from ()

    def finish(self, qids: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from ()


def pass_over_pairs(q: DataFrame, g: DataFrame, extra: list[str], make: Callable[[int], Kernel], schema: str, blocks: Blocks, state: int = 0) -> DataFrame:
    """Run the kernel that ``make`` gives for a number of queries over blocks that together hold every pair once.

    ``q`` has qid and v, ``g`` has cid, v and the ``extra`` columns, which the kernel gets as arrays. Ids are longs.
    ``want``, if ``q`` has it, is a long that the kernel finds among the extras, a value for each query of the block.
    ``state`` is what the kernel keeps for a query, in bytes.
    """
    own_columns = [c for c in ("want",) if c in q.columns]
    spark = q.sparkSession
    prepare(spark)
    n, width = q.agg(F.count("*"), F.max(F.size("v"))).first()
    parts = part_count(n, width or 1, state, blocks)
    own = q.select("qid", "v", *own_columns, F.pmod(F.xxhash64("qid"), F.lit(max(parts, 1))).alias("part"))
    out = None
    for part in range(parts):
        rows = own.filter(F.col("part") == part).select("qid", "v", *own_columns).orderBy("qid").toArrow()
        if not rows.num_rows:
            continue
        shared = spark.sparkContext.broadcast((rows.column("qid").to_numpy(), matrix(rows.column("v")), {c: rows.column(c).to_numpy() for c in own_columns}))

        def stream(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, left, asked = shared.value
            kernel = make(len(qids))
            held: list[pa.RecordBatch] = []

            def flush() -> Iterator[pa.RecordBatch]:
                t = pa.Table.from_batches(held).combine_chunks()
                t = t.take(pa.array(np.argsort(t.column("cid").to_numpy(), kind="stable")))
                cids, right, extras = t.column("cid").to_numpy(), matrix(t.column("v")), {c: t.column(c).to_numpy() for c in extra}
                step = min(blocks.queries, _QUERY_ROWS)
                for at in range(0, len(qids), step):
                    some = slice(at, at + step)
                    yield from kernel.add(at, qids[some], left[some], cids, right, extras | {c: x[some] for c, x in asked.items()})
                yield from kernel.block_done(cids)

            for batch in batches:
                for at in range(0, batch.num_rows, blocks.gallery):
                    held.append(batch.slice(at, blocks.gallery))
                    if sum(b.num_rows for b in held) >= blocks.gallery:
                        yield from flush()
                        held.clear()
            if held:
                yield from flush()
            yield from kernel.finish(qids)

        found = g.select("cid", "v", *extra).mapInArrow(stream, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def top_rows(scores: np.ndarray, ties: np.ndarray | None, k: int) -> np.ndarray:
    """For each row the columns of the k largest scores; then of the larger tie value; then the smaller column.

    Columns are cut by the k-th score first, so only those that can be in the list are sorted.
    """
    n, m = scores.shape
    k = min(k, m)
    if k < m:
        kth = np.partition(scores, m - k, axis=1)[:, m - k]
        row, col = np.nonzero(scores >= kth[:, None])
    else:
        row, col = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
    keys = [col, *([-ties[row, col]] if ties is not None else []), -scores[row, col], row]
    order = np.lexsort(keys)
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(n))
    return col[first[:, None] + np.arange(k)[None, :]]


class RunningTop:
    """The k best gallery items of every query so far: by score, then by the similarity, then the smaller id."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.s, self.cid = np.full((n, k), -np.inf), np.full((n, k), -np.inf), np.full((n, k), self.NONE)

    def add(self, own: np.ndarray, score: np.ndarray, s: np.ndarray, cids: np.ndarray) -> None:
        """Scores of the queries at the places ``own``. Only those that reach the last of a full list are looked at."""
        row, col = np.nonzero(score >= self.score[own, -1][:, None])
        if len(row) > 2 * self.k * len(own):
            col = top_rows(score, None if score is s else s, self.k)
            row, col = np.repeat(np.arange(len(own)), col.shape[1]), col.reshape(-1)
        if not len(row):
            return
        changed, line = np.unique(row, return_inverse=True)
        place = own[changed]
        line = np.concatenate([np.repeat(np.arange(len(place)), self.k), line])
        new = score[row, col], s[row, col], cids[col]
        both = [np.concatenate([x[place].reshape(-1), y]) for x, y in zip((self.score, self.s, self.cid), new, strict=True)]
        order = np.lexsort((both[2], -both[1], -both[0], line))
        order = order[np.searchsorted(line[order], np.arange(len(place)))[:, None] + np.arange(self.k)[None, :]]
        self.score[place], self.s[place], self.cid[place] = (x[order] for x in both)

    def rows(self, qids: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """qid, cid, s and score of what was found, in pieces."""
        for at in range(0, len(qids), step := max(1, _PAIR_ROWS // self.k)):
            row, col = np.nonzero(self.cid[at : at + step] != self.NONE)
            yield qids[at + row], self.cid[at + row, col], self.s[at + row, col], self.score[at + row, col]


def shortlist(q: DataFrame, g: DataFrame, k: int, blocks: Blocks | None = None) -> DataFrame:
    """``qid, cid, s`` of the k most similar gallery items per task; ``best`` merges them."""
    sizes = blocks or Blocks()

    class Lists(Kernel):
        def __init__(self, n: int):
            self.top = RunningTop(n, k)

        def add(self, at, qids, left, cids, right, extras):
            for own in tiles(len(qids), len(cids), sizes.cells):
                s = left[own] @ right.T
                self.top.add(np.arange(at + own.start, at + own.stop), s, s, cids)
            yield from ()

        def finish(self, qids):
            for qid, cid, s, _ in self.top.rows(qids):
                yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(cid), pa.array(s)], names=["qid", "cid", "s"])

    return pass_over_pairs(q, g, [], Lists, "qid long, cid long, s double", sizes, 24 * k)


def all_pairs(q: DataFrame, g: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """``qid, cid, s`` of every pair, for callers that want the pairs themselves: queries x gallery rows.

    Blocks and parts of the queries are smaller by default, as all of a block pair's similarities leave the task: with
    more queries there are more tasks, not longer ones."""

    class Pairs(Kernel):
        def __init__(self, n: int):
            pass

        def add(self, at, qids, left, cids, right, extras):
            for own in tiles(len(qids), len(cids), _PAIR_ROWS):
                some = qids[own]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, len(cids))), pa.array(np.tile(cids, len(some))), pa.array((left[own] @ right.T).reshape(-1))], names=["qid", "cid", "s"])

    return pass_over_pairs(q, g, [], Pairs, "qid long, cid long, s double", blocks or Blocks(1024, 1024, 8 << 20))


def gallery_statistics(q: DataFrame, g: DataFrame, ks: tuple[int, ...], taus: tuple[float, ...], blocks: Blocks | None = None) -> DataFrame:
    """Per gallery item: ``cid, mean_<k>`` over its k most similar queries, and ``lse_<i>`` = log sum exp(tau s) for
    each of ``taus`` in their order.

    A task sends one row for each item; an item's rows (as many as there are parts of the queries) meet in one group."""
    most, sizes = max(ks), blocks or Blocks()

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))

    class Statistics(Kernel):
        def __init__(self, n: int):
            self.held = None

        def add(self, at, qids, left, cids, right, extras):
            done = [self.merged(right[own] @ left.T, None if self.held is None else [x[own] for x in self.held]) for own in tiles(len(cids), len(qids), sizes.cells)]
            self.held = [np.concatenate(x) for x in zip(*done, strict=True)]
            yield from ()

        def merged(self, s, held):
            k = min(most, s.shape[1])
            top = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k :].copy()  # a view would keep all of s
            peak = s.max(axis=1)
            sums = {tau: np.exp(tau * (s - peak[:, None])).sum(axis=1) for tau in set(taus)}
            peaks, totals = np.stack([tau * peak for tau in taus], axis=1), np.stack([sums[tau] for tau in taus], axis=1)
            if held is not None:
                before, p, t = held
                top, high = np.concatenate([before, top], axis=1), np.maximum(p, peaks)
                top = np.partition(top, max(0, top.shape[1] - most), axis=1)[:, max(0, top.shape[1] - most) :].copy()
                peaks, totals = high, t * np.exp(p - high) + totals * np.exp(peaks - high)
            return top, peaks, totals

        def block_done(self, cids):
            if self.held is not None:
                yield pa.RecordBatch.from_arrays([pa.array(cids), *map(lists, self.held)], names=["cid", "top", "peaks", "totals"])
                self.held = None

    partial = pass_over_pairs(q, g, [], Statistics, "cid long, top array<double>, peaks array<double>, totals array<double>", sizes)
    merged = partial.groupBy("cid").agg(F.collect_list("top").alias("top"), F.collect_list(F.struct("peaks", "totals")).alias("parts")).withColumn("top", F.sort_array(F.flatten("top"), asc=False))

    def mean(k: int) -> Column:
        first = F.slice("top", 1, k)
        return F.aggregate(first, F.lit(0.0), lambda acc, x: acc + x) / F.size(first)

    def lse(i: int) -> Column:
        peak = F.array_max(F.transform("parts", lambda p: p.peaks[i]))
        return peak + F.ln(F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p.totals[i] * F.exp(p.peaks[i] - peak)))

    return merged.select("cid", *[mean(k).alias(f"mean_{k}") for k in sorted(set(ks))], *[lse(i).alias(f"lse_{i}") for i in range(len(taus))])


def reranked(q: DataFrame, g: DataFrame, methods: list[tuple[str, str, float | None]], k: int, blocks: Blocks | None = None) -> DataFrame:
    """``method, qid, cid, s, score`` of the k best per task by each method's score.

    ``methods`` are (name, column of ``g`` with its penalty, temperature of the log form or None). Equal scores go to
    the larger similarity, then to the smaller id. A column ``want`` of ``q`` has a bit for each method, in their order,
    by which the query is reranked; the similarities are computed once for all methods.
    """
    sizes = blocks or Blocks()

    class Lists(Kernel):
        def __init__(self, n: int):
            self.top = [RunningTop(n, k) for _ in methods]

        def add(self, at, qids, left, cids, right, extras):
            for own in tiles(len(qids), len(cids), sizes.cells):
                every = left[own] @ right.T
                for i, ((_, column, tau), top) in enumerate(zip(methods, self.top, strict=True)):
                    some = np.flatnonzero(extras["want"][own] >> i & 1) if "want" in extras else np.arange(len(every))
                    if len(some):
                        s, psi = every[some], extras[column][None, :]
                        top.add(at + own.start + some, s - psi if tau is None else np.log(np.maximum(s, 1e-12)) + tau * (s - psi), s, cids)
            yield from ()

        def finish(self, qids):
            for (name, _, _), top in zip(methods, self.top, strict=True):
                for qid, cid, s, score in top.rows(qids):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(qid), pa.string()), pa.array(qid), pa.array(cid), pa.array(s), pa.array(score)], names=["method", "qid", "cid", "s", "score"])

    return pass_over_pairs(q, g, sorted({c for _, c, _ in methods}), Lists, "method string, qid long, cid long, s double, score double", sizes, 24 * k * len(methods))
