r"""Near-duplicate documents by MinHash with tensored banding, verified on full shingle sets.

A document's set is its distinct runs of ``shingle`` words (``[^\x20\x09-\x0D]+``, A-Z lower-cased); with fewer words
the whole sequence is its one shingle; without words the set is empty and linked with nothing. Two documents are
linked if their sets' intersection is at least ``similar`` / 100 of the union.

Tensored banding: instead of one band of hashes per table, ``collections`` small groups of ``width`` minima are
computed, and every pair of groups is the key of one table. 12 groups of 2 give 66 tables of 4 minima from 24 instead
of 264. A pair is missed only if at most one group agrees: 7 in a million at a similarity of 0.85, 1 in 10,000 at
0.8, less above.

1. Equal sets are one class (128 bits of digest), so copies are compared once.
2. Classes that share a table key with another form a bucket. Every member meets the bucket's first member (the
   smallest id): sizes and bitmaps of 2,048 places exclude most pairs that are not linked, the rest is verified on full
   sets, and components are formed. Then every member of a bucket that is still in several components meets a central
   one (of the most table keys).
3. What then shares a bucket with a member of another component, the two that have met all of it set aside, is settled
   by an exact prefix join: of each set's shingles, the rarest among these documents first, two linked sets have one of
   the first n - ceil(similar * n) + 1 in common. A shingle of one document meets nothing, which settles groups of
   copies with edits of their own; one that few hold gives its pairs, whose places must leave enough after them; the
   documents of one that many hold meet in blocks of bounded size, from which only links come.
   No bucket is capped, and no pair within a component is measured.

Rows: a document is an id; repeated rows and rows that share an id are one document for linking, each row is
returned. Ids are below 2**62; a row without an id takes part under a number made of its text, is never the name of a
component that has an id, and gets a null component if no row of its component has one. Null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._storage import discard, only, prepare, tidy, written
from ._text import gather_runs, mix, pieces, span_hashes, text_buffer, window_hashes, word_spans
from .components import connected_components

_NAMELESS = 1 << 62
#: A shingle that at most so many prefixes hold gives its pairs; the others' texts meet in blocks of so many shingles.
_FEW, _BLOCK_SHINGLES = 64, 1 << 16


def shingle_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text end to end, and n+1 offsets."""
    data, offsets = text_buffer(column)
    s, e, of_text = word_spans(data, offsets)
    words = span_hashes(data, s, e, lower=True)
    counts = np.diff(of_text)
    text = np.repeat(np.arange(len(counts)), counts)
    runs = window_hashes(words, shingle)
    inside = np.flatnonzero(text[: len(runs)] == text[shingle - 1 :][: len(runs)]) if len(runs) else np.zeros(0, np.int64)
    hashes, owner = [runs[inside]], [text[inside]]
    for n in range(1, shingle):
        short = np.flatnonzero(counts == n)
        if len(short):
            hashes.append(window_hashes(words, n)[of_text[short]])
            owner.append(short)
    h, o = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    return h, np.searchsorted(o, np.arange(len(counts) + 1))


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return a[:n], a[n:] | np.uint64(1)


def collection_keys(hashes: np.ndarray, offsets: np.ndarray, collections: int, width: int) -> np.ndarray:
    """For each non-empty set a row with one value per collection: ``width`` minima, combined."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.zeros((len(starts), collections), np.uint64)
    if len(starts):
        xor, odd = _constants(collections * width)
        for c in range(collections):
            for w in range(width):
                i = c * width + w
                out[:, c] = mix(out[:, c] + np.minimum.reduceat((hashes ^ xor[i]) * odd[i], starts))
    return out


def _key(id_: Column, text: Column) -> Column:
    return F.coalesce(id_.cast("long"), F.shiftrightunsigned(F.xxhash64(text), 2) + F.lit(_NAMELESS))


def sketches(docs: DataFrame, shingle: int, collections: int, width: int) -> DataFrame:
    """``key, n, d1, d2, groups`` of every row of ``docs`` (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, "text"):
                h, offsets = shingle_sets(rows.column(1), shingle)
                n = np.diff(offsets)
                full = n > 0
                digest = np.zeros((2, len(n)), np.uint64)
                groups = np.zeros((len(n), collections), np.uint64)
                if full.any():
                    starts = offsets[:-1][full]
                    for lane, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
                        digest[lane, full] = np.add.reduceat(mix(h ^ np.uint64(salt)), starts)
                    groups[full] = collection_keys(h, offsets, collections, width)
                flat = pa.array(groups.reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * collections), flat)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), lists], names=["key", "n", "d1", "d2", "groups"])

    return docs.select("key", "text").mapInArrow(run, "key long, n long, d1 long, d2 long, groups array<long>")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """``a, b, both, either``: sizes of intersection and union of the full sets of each pair's texts."""
    with_b = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    full = with_b.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, "text_b", 1 << 21):
                # the first texts of a batch repeat; each is cut once (an id may have several)
                first = rows.column(2).dictionary_encode()
                place = first.indices.to_numpy()
                ha, oa = shingle_sets(first.dictionary, shingle)
                hb, ob = shingle_sets(rows.column(3), shingle)
                both = np.zeros(rows.num_rows, np.int64)
                for i, j in enumerate(place.tolist()):
                    x, y = ha[oa[j] : oa[j + 1]], hb[ob[i] : ob[i + 1]]
                    at = np.searchsorted(x, y)
                    both[i] = np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y) if len(x) and len(y) else 0
                either = np.diff(oa)[place] + np.diff(ob) - both
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(both), pa.array(either)], names=["a", "b", "both", "either"])

    return full.mapInArrow(run, "a long, b long, both long, either long").groupBy("a", "b").agg(F.max_by(F.struct("both", "either"), F.col("both") / F.col("either")).alias("s")).select("a", "b", "s.both", "s.either")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similar: int = 80, collections: int = 12, width: int = 2
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``; ``similar`` is in percent. The smallest
    id of a component is kept."""
    out = _labelled(docs, id_col=id_col, text_col=text_col, shingle=shingle, similar=similar, collections=collections, width=width)
    real = lambda c: F.when(F.col(c) < _NAMELESS, F.col(c))
    return out.select(real("key").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"), (F.col("key") == F.col("component")).alias("kept"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similar: int = 80, collections: int = 12, width: int = 2) -> DataFrame:
    """``docs`` reduced to the documents that are kept, all columns unchanged."""
    kept = _labelled(docs, id_col=id_col, text_col=text_col, shingle=shingle, similar=similar, collections=collections, width=width)
    gone = kept.groupBy("key").agg(F.max(F.col("key") == F.col("component")).alias("kept")).filter("not kept").select(F.col("key").alias("__key"))
    gone = written(gone, "dropped", narrow=True)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return only(docs.withColumn("__key", _key(F.col(f"`{id_col}`"), text)), "__key", gone, gone.count(), "left_anti").drop("__key")


def _labelled(docs: DataFrame, *, id_col: str, text_col: str, shingle: int, similar: int, collections: int, width: int) -> DataFrame:
    """``key, n, component`` for every row."""
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    source = docs.select(_key(F.col(f"`{id_col}`"), text).alias("key"), text.alias("text"))
    rows = written(sketches(source, shingle, collections, width), "sketches")

    # different sets of fewer elements cannot be similar enough: of sizes a <= b they share at most a of b, a < b
    least = -(-similar // (100 - similar)) if similar < 100 else 1 << 62
    classes = rows.filter(F.col("n") > 0).groupBy("d1", "d2", "n").agg(F.min("key").alias("node"), F.first("groups").alias("groups"))
    classes = written(classes, "classes", narrow=True)
    groups = classes.filter(F.col("n") >= least).select("node", "n", F.posexplode("groups").alias("i", "g"))
    common = groups.groupBy("i", "g").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("i", "g")
    held = groups.join(common, ["i", "g"]).groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("i", "g"))).alias("held")).filter(F.size("held") > 1)
    key = lambda x, y: F.xxhash64(x.i, y.i, x.g, y.g)
    pair = F.explode(F.flatten(F.transform("held", lambda x, i: F.transform(F.slice("held", i + 2, F.size("held")), lambda y: key(x, y)))))
    keyed = held.select("node", F.size("held").alias("w"), pair.alias("table_key"))
    leads = keyed.groupBy("table_key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).filter("lead <> last").select("table_key", "lead")
    members = written(keyed.join(leads, "table_key").select("table_key", "node", "w", "lead"), "buckets", narrow=True)
    nodes = written(members.select(F.col("node").alias("key")).distinct(), "candidates", narrow=True)
    n_nodes, components = nodes.count(), None
    if n_nodes:
        own = only(source, "key", nodes, n_nodes)
        if not rows.groupBy("key").count().filter("count > 1").join(nodes, "key", "left_semi").isEmpty():
            own = own.withColumn("t", F.xxhash64("text")).dropDuplicates(["key", "t"]).drop("t")
        texts = written(own, "candidate-texts")
        tidy(spark)
        maps = written(_bitmaps(texts, shingle), "bitmaps", narrow=True)
        components = _settled(members, _Bench(texts, maps, shingle, similar))
        discard(texts, maps)
    discard(members, nodes)
    tidy(spark)

    named = classes.select("d1", "d2", "n", "node")
    if components is not None:
        named = named.join(components, "node", "left")
    else:
        named = named.withColumn("component", F.col("node"))
    named = named.select("d1", "d2", "n", F.coalesce("component", "node").alias("component"))
    return rows.join(named, ["d1", "d2", "n"], "left").select("key", "n", F.coalesce("component", "key").alias("component"))


def _tokens(texts: DataFrame, shingle: int) -> DataFrame:
    """``h, ent, n``: every shingle of every text (ent, text), with the size of the text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, "text"):
                h, offsets = shingle_sets(rows.column(1), shingle)
                n = np.diff(offsets)
                at = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), rows.column(0).take(at), pa.array(np.repeat(n, n))], names=["h", "ent", "n"])

    return texts.select("ent", "text").mapInArrow(run, "h long, ent long, n long")


def _bitmaps(texts: DataFrame, shingle: int) -> DataFrame:
    """``node, n, bits, several``: a bit for every hashed place of 2,048 that a shingle of the text falls on, as 32
    longs, and whether an id has several texts (of which these figures then bound none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, "text"):
                h, offsets = shingle_sets(rows.column(1), shingle)
                owner = np.repeat(np.arange(rows.num_rows), np.diff(offsets))
                place = (h >> np.uint64(53)).astype(np.int64)
                maps = np.zeros((rows.num_rows, 32), np.uint64)
                np.bitwise_or.at(maps, (owner, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
                flat = pa.array(maps.reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows.num_rows + 1, dtype=np.int32) * 32), flat)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets)), lists], names=["node", "n", "bits"])

    merged = [F.bit_or(F.col("bits")[i]) for i in range(32)]
    found = texts.select("key", "text").mapInArrow(run, "node long, n long, bits array<long>")
    return found.groupBy("node").agg(F.max("n").alias("n"), F.array(*merged).alias("bits"), (F.count("*") > 1).alias("several"))


def _outside(x: str, y: str) -> Column:
    """At least so many elements of x are not in y: places that only x has."""
    out = F.lit(0)
    for i in range(32):
        out = out + F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i])))
    return out


def _pair(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


class _Bench:
    """What pairs are measured with: texts (key, text) and bitmaps of the candidates, and the pairs measured so far."""

    def __init__(self, texts: DataFrame, maps: DataFrame, shingle: int, similar: int):
        self.texts, self.maps, self.shingle, self.similar = texts, maps, shingle, similar
        self.known: DataFrame | None = None

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs that sizes and bitmaps leave possible: of sizes n and m a linked pair has at least
        similar * (n + m) / (100 + similar) elements in common, and what is outside of a map is in no intersection."""
        side = lambda k: self.maps.select(F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "bits", "several")])
        enough = lambda r: (100 + self.similar) * r >= self.similar * (F.col("n_a") + F.col("n_b"))
        able = enough(F.col("n_a") - _outside("bits_a", "bits_b")) & enough(F.col("n_b") - _outside("bits_b", "bits_a"))
        return pairs.join(side("a"), "a").join(side("b"), "b").filter(F.col("several_a") | F.col("several_b") | able).select("a", "b")

    def links(self, pairs: DataFrame) -> DataFrame | None:
        """The pairs (a, b) that are linked, by their full sets; None if no pair is left to be measured."""
        near = self.near(pairs)
        if self.known is not None:
            near = near.join(self.known, ["a", "b"], "left_anti")
        near = written(near, "pairs", narrow=True)
        n = near.count()
        if not n:
            discard(near)
            return None
        own = only(self.texts, "key", near.select(F.explode(F.array("a", "b")).alias("key")).distinct(), 2 * n)
        measured = written(verified(near, own, self.shingle), "measured", narrow=True)
        self.known = near if self.known is None else self.known.unionByName(near)
        return measured.filter(F.col("both") * 100 >= F.col("either") * self.similar).select("a", "b")


def _merged(labels: DataFrame | None, links: DataFrame | None) -> DataFrame | None:
    """``node, component`` after more links: components known so far are the nodes of what is left to connect."""
    if links is None:
        return labels
    if labels is not None:
        for side in ("a", "b"):
            named = labels.select(F.col("node").alias(side), F.col("component").alias("c"))
            links = links.join(named, side, "left").withColumn(side, F.coalesce("c", side)).drop("c")
        links = links.filter("a <> b").distinct()
    new = connected_components(links.select("a", "b"))
    if labels is None:
        return new
    moved = labels.join(new.select(F.col("node").alias("component"), F.col("component").alias("c")), "component", "left").select("node", F.coalesce("c", "component").alias("component"))
    return written(moved.unionByName(new.join(labels, "node", "left_anti").select("node", "component")), "components", narrow=True)


def _open(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows (table_key, node, w) with their component, of the buckets whose members are in different ones."""
    if labels is None:
        rows = rows.withColumn("component", F.col("node"))
    else:
        rows = rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = rows.groupBy("table_key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("table_key")
    return written(rows.join(open_, "table_key").select("table_key", "node", "w", "component"), "open-buckets", narrow=True)


def _settled(members: DataFrame, bench: _Bench) -> DataFrame | None:
    """``node, component`` of all that the true links of the buckets (table_key, node, w, lead) connect."""
    labels = _merged(None, bench.links(members.filter("node <> lead").select(*_pair("lead", "node")).distinct()))
    # a bucket's lead has met all of it
    rows = _open(members.filter("node <> lead").select("table_key", "node", "w"), labels)
    if rows.isEmpty():
        return labels
    center = rows.groupBy("table_key").agg(F.max_by(F.struct("node", "component"), F.struct(F.col("w"), F.xxhash64("table_key", "node"))).alias("p"))
    met = rows.join(center, "table_key")
    labels = _merged(labels, bench.links(met.filter(F.col("p.component") != F.col("component")).select(*_pair("p.node", "node")).distinct()))
    left = _open(met.filter("node <> p.node").select("table_key", "node", "w"), labels)
    discard(rows)
    ends = written(left.select("node", "component").distinct(), "rest", narrow=True)
    n = ends.count()
    if not n:
        return labels
    return _settled_by_prefixes(ends, n, bench, labels)


def _prefixes(own: DataFrame, ends: DataFrame, shingle: int, similar: int) -> DataFrame:
    """``ent, node, component, n, i, h``: of each text's set, in the order of how many of these texts hold a shingle
    (then by hash), the first n - ceil(similar * n) + 1, with their places i. Two linked sets have one of them in
    common. Shingles of one text only come first and meet nothing; they take their places and are left out."""
    tokens = _tokens(own, shingle)
    often = tokens.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1")
    lists = tokens.join(often, "h").groupBy("ent", "n").agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("shared"))
    alone = (F.col("n") - F.size("shared")).cast("int")
    most = (F.col("n") - F.ceil(F.col("n") * similar / 100) + 1 - alone).cast("int")
    cut = lists.withColumn("alone", alone).withColumn("most", most).filter("most > 0")
    flat = cut.select("ent", "n", "alone", F.posexplode(F.slice("shared", 1, F.col("most"))).alias("at", "x")).select("ent", "n", (F.col("alone") + F.col("at")).alias("i"), "x.h")
    return flat.join(own.select("ent", F.col("key").alias("node")), "ent").join(ends, "node")


def _settled_by_prefixes(ends: DataFrame, n_ends: int, bench: _Bench, labels: DataFrame | None) -> DataFrame | None:
    """Labels after all links among ``ends`` (node, component) are known, by an exact prefix join.

    A shingle that few texts hold in their prefix gives its pairs; the texts of one that many hold are met in blocks.
    """
    spark = ends.sparkSession
    own = only(bench.texts, "key", ends.select(F.col("node").alias("key")), n_ends).withColumn("ent", F.xxhash64("key", "text"))
    own = written(own, "rest-texts")
    rows = written(_prefixes(own, ends, bench.shingle, bench.similar), "prefixes", narrow=True)
    # a partner is no smaller than the smallest set that holds the shingle, nor than the share of n that a link needs
    partner = F.greatest("least", F.ceil(F.col("n") * bench.similar / 100))
    able = (100 + bench.similar) * (F.col("n") - F.col("i")) >= bench.similar * (F.col("n") + partner)
    rows = rows.join(rows.groupBy("h").agg(F.min("n").alias("least")), "h").filter(able).drop("least")
    held = rows.groupBy("h").agg(F.count("*").alias("holders"), F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    held = written(rows.join(held.select("h", "holders"), "h"), "held", narrow=True)
    few, many = held.filter(F.col("holders") <= _FEW), held.filter(F.col("holders") > _FEW)
    left, right = (few.select("h", *[F.col(c).alias(f"{k}_{c}") for c in ("node", "component", "n", "i")]) for k in ("p", "q"))
    enough = lambda r: (100 + bench.similar) * r >= bench.similar * (F.col("p_n") + F.col("q_n"))
    met = (F.col("p_node") < F.col("q_node")) & (F.col("p_component") != F.col("q_component")) & enough(F.col("p_n") - F.col("p_i")) & enough(F.col("q_n") - F.col("q_i"))
    labels = _merged(labels, bench.links(left.join(right, "h").filter(met).select(F.col("p_node").alias("a"), F.col("q_node").alias("b")).distinct()))
    if many.isEmpty():
        return labels
    found = written(_block_links(many, own, bench.shingle, bench.similar), "block-links", narrow=True)
    return labels if found.isEmpty() else _merged(labels, found)


def _block_links(entries: DataFrame, own: DataFrame, shingle: int, similar: int) -> DataFrame:
    """Links among the texts that hold a common shingle, for shingles that many hold.

    Each one's texts are laid in the order of their components and cut into blocks of bounded size; two blocks meet in
    one task, unless both are of one and the same component. Pairs are never rows; only links leave a task.
    """
    order = Window.partitionBy("h").orderBy("component", "ent")
    dealt = entries.withColumn("block", F.floor(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) / _BLOCK_SHINGLES))
    blocks = dealt.groupBy("h", "block").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    one, two = (blocks.select("h", F.col("block").alias(k), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k in ("p", "q"))
    apart = (F.col("p") <= F.col("q")) & (F.least("xp", "xq") != F.greatest("yp", "yq"))
    sides = one.join(two, "h").filter(apart).select("h", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))
    full = sides.join(dealt.select("h", "block", "ent", "node", "component"), ["h", "block"]).join(own.select("ent", "text"), "ent").select("h", "p", "q", "block", "node", "component", "text")

    def meet(group: pa.Table) -> pa.Table:
        p, q, block, node, component = (group.column(c).to_numpy() for c in ("p", "q", "block", "node", "component"))
        h, offsets = shingle_sets(group.column("text"), shingle)
        n = np.diff(offsets)
        owner = np.repeat(np.arange(len(n)), n)
        keep = block[owner] == q[0]
        order = np.flatnonzero(keep)[np.argsort(h[keep], kind="stable")]
        values, holder = h[order], owner[order]
        a, b = [], []
        for x in np.flatnonzero(block == p[0]).tolist():
            own_ = h[offsets[x] : offsets[x + 1]]
            lo, hi = np.searchsorted(values, own_), np.searchsorted(values, own_, side="right")
            both = np.bincount(holder[gather_runs(lo, hi - lo, np.arange(len(own_)))[0]], minlength=len(n))
            link = np.flatnonzero((both * 100 >= similar * (n[x] + n - both)) & (component != component[x]) & (both > 0))
            # one link to each component says all
            link = link[np.unique(component[link], return_index=True)[1]]
            a.append(np.minimum(node[x], node[link]))
            b.append(np.maximum(node[x], node[link]))
        none = np.zeros(0, np.int64)
        return pa.table({"a": pa.array(np.concatenate([none, *a])), "b": pa.array(np.concatenate([none, *b]))})

    return full.groupBy("h", "p", "q").applyInArrow(meet, "a long, b long").distinct()
