"""Every text operator against a brute-force version, with nulls, empty tables, repeated rows and clashing names."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hubgate.llm import byte_bpe, chat_format, decontaminate, line_dedup, minhash_dedup, quality_rules, substring_dedup, token_count, url_filter, warc
from hubgate.llm import _text as kernels

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = " \t\n\x0b\x0c\r"


def docs_of(spark, texts, ids=None, extra=True):
    rows = [(i if ids is None else ids[i], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:  # names that the operators use for columns of their own
        for c in ("key", "n", "id", "chunk", "marks", "kept", "component", "ids", "n_words", "n_lines", "words", "a", "b"):
            df = df.withColumn(c, F.lit("own"))
    return df


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def corpus(seed=1, n=60):
    """Random texts over few words with shared passages, exact and near copies, nulls and odd white space."""
    rng = random.Random(seed)
    vocabulary = [a + b for a in ("ka", "Lo", "mé", "中", "x") for b in ("n", "T", "s.", "")]
    say = lambda k: " ".join(rng.choice(vocabulary) + str(rng.randint(0, 9)) for _ in range(k))
    passage, line = say(60), "  A very common Line that is long enough to count " + say(3)
    out = [None, "", " \n\t ", "one", "two words", line, line.upper()]
    for i in range(n):
        parts = [say(rng.randint(1, 90)) for _ in range(rng.randint(1, 3))]
        if i % 4 == 0:
            parts.insert(1, passage)
        if i % 3 == 0:
            parts.append(line + " " * (i % 2))
        out.append("\n".join(parts))
    for t in out[7:17]:
        out.append(t)
        w = t.split(" ")
        w[len(w) // 2] = "edited"
        out.append(" ".join(w))
    return out


# --- kernels ---------------------------------------------------------------------------------------------------


def test_word_spans_and_hashes_follow_the_bytes():
    texts = ["", " a  b\x0bc ", "é 中文", "a", "tail\n", "x" * 100]
    data, offsets = kernels.text_buffer(pa.array(texts))
    s, e, of_text = kernels.word_spans(data, offsets)
    raw = data.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(s[x:y], e[x:y], strict=True)] for x, y in zip(of_text[:-1], of_text[1:], strict=True)]
    assert got == [WORD.findall(t) for t in texts]
    h = kernels.span_hashes(data, s, e)
    flat = [w for ws in got for w in ws]
    assert len(set(h.tolist())) == len(set(flat)) and h[flat.index("a")] == h[len(flat) - 1 - flat[::-1].index("a")]


def test_long_spans_cross_segments(monkeypatch):
    monkeypatch.setattr(kernels, "_SEGMENT", 8)
    monkeypatch.setattr(kernels, "_powers", {})
    data, offsets = kernels.text_buffer(pa.array(["ab " * 10 + "c" * 50 + " ab"]))
    s, e, _ = kernels.word_spans(data, offsets)
    h = kernels.span_hashes(data, s, e)
    assert len(set(h[:10].tolist())) == 1 and h[0] == h[11] and h[10] != h[0]


# --- 1: urls ---------------------------------------------------------------------------------------------------

RULES = [url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/e"), url_filter.Rule("block", "example.com", "/en/p")]
URLS = ["http://a.EXAMPLE.com/en/1", "x://www.example.com/en/?q", "https://example.com/enx", "http://com", "http://com/", "http://net/es/1", "http://x.net/f", "http://badexample.com/en/", "example.com/en/", "", None, "a://b://c/", "http://example.com/en/page#x", "http://:80/en", "http://example.com\n/en/"]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host = host.translate(LOWER)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), len(r.host)), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


def test_url_filter_by_one_trie_and_by_shards(spark):
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, rule string")
    want = {i: brute_url(u) for i, u in enumerate([*URLS, *URLS])}
    tables = [url_filter.judge_urls(df, RULES, max_trie_bytes=most) for most in (1 << 20, 0)] + [url_filter.judge_urls_by_shards(df, RULES, shards=n, deals=2) for n in (1, 3)]
    for found in tables:
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()} == want
    for most in (1 << 20, 0):
        assert url_filter.judge_urls(df.limit(0), RULES, max_trie_bytes=most).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df, [], default="block").collect()} == {"block"}
    assert {r.verdict for r in url_filter.judge_urls_by_shards(df, [], shards=2, default="block").collect()} == {"block"}


def test_trie_is_bounded_by_measured_bytes():
    sizes = [url_filter.trie_bytes(url_filter.RuleTrie(url_filter.Rule("block", f"site{i}.example.org", f"/p{i}/") for i in range(n))) for n in (1000, 2000)]
    assert sizes[0] > 1000 * 500 and 1.8 < sizes[1] / sizes[0] < 2.2


# --- 2: near-duplicates ----------------------------------------------------------------------------------------


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(texts, k, similar):
    sets = [shingle_set(t, k) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= similar * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("shingle,similar", [(3, 85), (5, 80)])
def test_near_duplicates(spark, shingle, similar):
    texts = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs_of(spark, texts), shingle=shingle, similar=similar).collect()}
    assert got == brute_components(texts, shingle, similar)


def test_group_of_near_copies_is_settled_exactly(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 4, 5, 6, 9))):
            w[rng.randrange(len(w))] = f"u{rng.randrange(10**6)}"
        if i % 7 == 0:
            w = w[rng.randrange(12) :]
        texts.append(" ".join(w))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs_of(spark, texts), shingle=3, similar=85).collect()}
    assert got == brute_components(texts, 3, 85)


def test_near_duplicates_edge_rows(spark):
    df = docs_of(spark, ["a b c d e f g", "a b c d e f g", "a b c d e f g", None, "", "q"], ids=[7, None, 3, 4, None, 7])
    rows = minhash_dedup.near_duplicates(df, shingle=3, similar=85).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows if r.n_shingles == 5 and r.doc_id is not None) == [(3, 3, True), (7, 3, False)]
    assert [(r.component_id, r.kept) for r in rows if r.n_shingles == 5 and r.doc_id is None] == [(3, False)]
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0
    kept = minhash_dedup.deduplicated(docs_of(spark, corpus()))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in brute_components(corpus(), 5, 80).items() if d == c)
    assert kept.columns == docs_of(spark, []).columns


def test_tensored_tables_find_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    missed = 0
    for _ in range(300):
        common, own = rng.integers(0, 1 << 63, 170), rng.integers(0, 1 << 63, 30)
        a, b = np.unique(np.concatenate([common, own[:15]])).astype(np.uint64), np.unique(np.concatenate([common, own[15:]])).astype(np.uint64)
        keys = minhash_dedup.collection_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 12, 2)
        missed += (keys[0] == keys[1]).sum() < 2
    assert missed == 0


def test_buckets_settle_ids_with_several_texts(spark, monkeypatch):
    words = [f"w{j}" for j in range(100)]
    swap = lambda base, at, k: " ".join(base[:at] + [f"{k}{j}" for j in range(at, at + 6)] + base[at + 6 :])
    first, near = swap(words[:70] + [f"y{j}" for j in range(30)], 0, "l"), [words, swap(words, 0, "m").split()]
    other = " ".join(f"z{j}" for j in range(300))
    rows = [(1, first), (2, " ".join(near[0])), (2, other), (3, " ".join(near[1])), (4, swap(near[0], 94, "n"))]
    texts = spark.createDataFrame(rows, "key long, text string")
    members = spark.createDataFrame([(9, k, 2, 1) for k in (1, 2, 3, 4)], "table_key long, node long, w int, lead long")
    for few in (64, 0):
        monkeypatch.setattr(minhash_dedup, "_FEW", few)
        settled = minhash_dedup._settled(members, minhash_dedup._Bench(texts, minhash_dedup._bitmaps(texts, 5), 5, 80))
        assert {(r.node, r.component) for r in settled.collect()} == {(2, 2), (3, 2), (4, 2)}


@pytest.mark.parametrize("few,block", [(64, 1 << 16), (0, 1 << 16), (3, 400)])
def test_prefixes_and_blocks_give_all_links(spark, monkeypatch, few, block):
    monkeypatch.setattr(minhash_dedup, "_FEW", few)
    monkeypatch.setattr(minhash_dedup, "_BLOCK_SHINGLES", block)
    rng = random.Random(9)
    bases = [[f"w{rng.randrange(40)}" for _ in range(60)] for _ in range(3)]
    texts = []
    for i in range(90):
        w = list(bases[i % 3])
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(60)}"
        texts.append(" ".join(w[rng.randrange(4) :]))
    for shingle, similar in ((1, 80), (3, 70)):
        source = spark.createDataFrame(list(enumerate(texts)), "key long, text string").dropDuplicates(["text"])
        alone = source.select(F.col("key").alias("node"), F.col("key").alias("component"))
        bench = minhash_dedup._Bench(source, minhash_dedup._bitmaps(source, shingle), shingle, similar)
        labels = {r.node: r.component for r in minhash_dedup._settled_by_prefixes(alone, len(texts), bench, None).collect()}
        kept = {r.key for r in source.collect()}
        want = brute_components([t if i in kept else None for i, t in enumerate(texts)], shingle, similar)
        assert {i: labels.get(i, i) for i in kept} == {i: want[i][1] for i in kept}


def test_rows_follow_the_size_of_a_cluster(spark, monkeypatch):
    """No table between the steps, pairs included, grows with the square of a group of near copies."""

    def most_rows(n):
        rng = random.Random(n)
        base = [f"w{rng.randrange(900)}" for _ in range(150)]
        texts = []
        for _ in range(n):
            w = list(base)
            for _ in range(rng.randrange(14)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(900)}"
            texts.append(" ".join(w))
        counts, first = {}, minhash_dedup.written

        def counted(df, name, narrow=False):
            out = first(df, name, narrow)
            counts[name] = max(counts.get(name, 0), out.count())
            return out

        with monkeypatch.context() as m:
            m.setattr(minhash_dedup, "written", counted)
            minhash_dedup.near_duplicates(docs_of(spark, texts, extra=False), shingle=3, similar=85).count()
        return counts

    small, large = most_rows(500), most_rows(2000)
    assert large["pairs"] <= 4 * 2000 and max(large[k] / max(small[k], 500) for k in small) < 8


@pytest.mark.parametrize("common,own", [(800, 200), (850, 150)])
def test_recall_at_the_thresholds(common, own):
    """Pairs at a similarity of exactly 0.8 and 0.85 that share a table key: 0.9999 and more by the binomial."""
    rng, pairs = np.random.default_rng(5), 2000
    found = 0
    for _ in range(pairs):
        x = rng.integers(0, 1 << 63, common + own).astype(np.uint64)
        a, b = x[: common + own // 2], np.concatenate([x[:common], x[common + own // 2 :]])
        keys = minhash_dedup.collection_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 12, 2)
        found += (keys[0] == keys[1]).sum() >= 2
    assert found >= 0.999 * pairs


# --- 3: decontamination ----------------------------------------------------------------------------------------


def brute_hits(texts, items, similar=80):
    out = {}
    for i, item in items:
        w = WORD.findall((item or "").translate(LOWER))
        k = min(5, len(w))
        bag = lambda x, k=k: [tuple(x[j : j + k]) for j in range(len(x) - k + 1)]
        for d, t in enumerate(texts):
            words = WORD.findall((t or "").translate(LOWER))
            for p in range(len(words) - len(w) + 1) if w else ():
                x, rest, both = bag(words[p : p + len(w)]), bag(w), 0
                for s in x:
                    if s in rest:
                        rest.remove(s)
                        both += 1
                either = 2 * len(x) - both
                if both * 100 >= similar * either and ((d, i) not in out or both / either > out[d, i][0]):
                    out[d, i] = both / either, p, len(w), both, either
    return {k: v[1:] for k, v in out.items()}


def test_decontamination(spark):
    rng = random.Random(2)
    say = lambda k: " ".join(f"w{rng.randint(0, 500)}" for _ in range(k))
    items = [(0, say(40)), (1, say(60)), (2, "tiny item"), (3, None), (4, ""), (5, "a a a a a a a a a a a a"), (6, say(45))]
    changed = items[6][1].split()
    changed[0] = "other"
    texts = [say(80) + " " + items[0][1].upper() + "\n" + say(10), items[1][1], "x " + items[2][1] + " y", None, "", say(30), " ".join(changed) + " z", items[0][1] + "\n" + items[1][1], "a " * 30, say(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(texts, items)
    for words, scan in ((400_000, 4), (70, 4), (70, 1)):  # one block of items, several in a scan, and several scans
        got = {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.n_common, r.n_either) for r in decontaminate.contaminated(docs_of(spark, texts), bench, block_words=words, scan_blocks=scan).collect()}
        assert got == want
    clean = decontaminate.drop_contaminated(docs_of(spark, texts), bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(set(range(len(texts))) - {d for d, _ in want})
    assert decontaminate.contaminated(docs_of(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs_of(spark, texts).limit(0), bench).count() == 0


def test_decontamination_by_items_without_an_id(spark):
    say = lambda k, n: " ".join(f"{k}{j}" for j in range(n))
    bench = spark.createDataFrame([(None, say("a", 20)), (None, say("b", 20)), (7, say("c", 20)), (None, None)], "item_id long, text string")
    texts = ["x " + say("a", 20) + " " + say("b", 20), say("c", 20), say("d", 40)]
    for most in (2000, 1):
        hits = decontaminate.contaminated(docs_of(spark, texts), bench, block_items=most).collect()
        assert sorted((r.doc_id, r.item_id or -1, r.first_word) for r in hits) == [(0, -1, 1), (0, -1, 21), (1, 7, 0)]
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs_of(spark, texts), bench).collect()] == [2]


def test_window_sums_number_the_occurrences_of_each_window():
    rng = np.random.default_rng(12)
    for size in (1, 3, 17):
        runs = decontaminate.mix(rng.integers(0, 6, 400).astype(np.uint64))
        starts = np.flatnonzero(rng.random(400 - size + 1) < 0.05)
        got = decontaminate.window_sums(runs, decontaminate.repeat_distances(runs), starts, size)
        assert (got == np.stack([decontaminate.bag_sums(runs[w : w + size]) for w in starts])).all()


def test_decontamination_finds_passages_beside_a_repeated_word():
    words = [[f"w{i}x{j}" for j in range(200)] for i in range(40)]
    groups = decontaminate.group_items([(i, " ".join(w)) for i, w in enumerate(words)], 5, 31)
    texts = pa.array([" ".join(w[:179] + ["so"] * 21) for w in words], pa.string())  # similarity 175 / 217
    assert [(h[0], h[1], h[4], h[5]) for h in decontaminate.find_hits(texts, groups, 80)] == [(i, i, 175, 217) for i in range(40)]


def test_block_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 16, (50, 8)).astype(np.uint16)
    asked = prints[rng.integers(0, 50, 400)]
    for _ in range(33):
        asked[np.arange(400), rng.integers(0, 8, 400)] ^= np.uint16(1) << rng.integers(0, 16, 400).astype(np.uint16)
    index = decontaminate.BlockIndex(prints, 31)
    q, i = index.within(asked)
    near = np.bitwise_count(asked[:, None] ^ prints[None, :]).sum(axis=2) <= 31
    assert set(zip(q.tolist(), i.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True)) and near.any()
    # what has nothing in common with an item is its candidate once in 12 times
    looked_at = len(index.candidates(rng.integers(0, 1 << 16, (4000, 8)).astype(np.uint16))[0]) / (4000 * 50)
    assert looked_at < 0.1


@pytest.mark.parametrize("own,least", [(20, 0.99), (15, 0.998), (11, 1.0)])
def test_fingerprints_of_similar_passages_are_within_the_radius(own, least):
    """Passages of 180 shingles of which ``own`` differ: similarities of exactly 0.8, 0.85 (0.846) and 0.88."""
    rng = np.random.default_rng(3)
    found = 0
    for _ in range(1000):
        a = rng.integers(0, 1 << 63, 180).astype(np.uint64)
        b = np.concatenate([a[: 180 - own], rng.integers(0, 1 << 63, own).astype(np.uint64)])
        x, y = (decontaminate.fingerprints(decontaminate.bag_sums(v)[None]) for v in (a, b))
        found += len(decontaminate.BlockIndex(x, 31).within(y)[0])
    assert found >= least * 1000


# --- 4: lines --------------------------------------------------------------------------------------------------


def brute_lines(texts, ids, min_chars=40, min_docs=5):
    key = lambda x: x.strip(SPACES).translate(LOWER)
    holders = {}
    for row, t in enumerate(texts):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, []).append(row)
    rank = lambda i: -(1 << 63) if i is None else i
    largest = {k: max(rank(ids[r]) for r in rows) for k, rows in holders.items() if len(rows) >= min_docs}
    out = []
    for row, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in largest or largest[key(x)] == rank(ids[row])]
        out.append((ids[row], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_line_dedup_broadcast_and_packets(spark, most):
    texts = [*corpus(), "é" * 40, "É" * 40, *["é" * 39] * 6, *["\n" + "z" * 40 + "\r\n\n"] * 5]
    ids = [None if i % 11 == 5 else i for i in range(len(texts))]
    df = docs_of(spark, texts, ids)
    got = line_dedup.drop_frequent_lines(df, max_broadcast_bytes=most, shard_lines=2)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == brute_lines(texts, ids)
    assert [c for c in got.columns if c not in ("n_lines", "n_dropped")] == [c for c in df.columns if c != "n_lines"]
    assert line_dedup.drop_frequent_lines(df.limit(0), max_broadcast_bytes=most).count() == 0
    whole = line_dedup.drop_frequent_lines(df, max_broadcast_bytes=most, shard_lines=20, index_docs=1)  # every distinct line
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in whole.collect()), key=str) == brute_lines(texts, ids)


def test_perfect_hash_is_minimal_and_survives_equal_slots():
    keys = np.random.default_rng(2).integers(0, 1 << 63, 5000).astype(np.uint64)
    h = line_dedup.PerfectHash.build(keys)
    assert sorted(h.index(keys).tolist()) == list(range(5000))
    few = line_dedup.PerfectHash(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.sort(keys[:10]))
    assert sorted(few.index(keys[:10]).tolist()) == list(range(10)) and (few.index(keys[10:20]) == -1).all()


def test_shards_tell_keys_with_an_equal_lane_apart():
    one, two = np.array([5, 9, 5, 5], np.uint64), np.array([1, 2, 3, 4], np.uint64)
    shard = line_dedup.Shard.build(one, two, np.array([5, 6, 7, 4]), np.array([10, 20, 30, 40]))
    shard = line_dedup.Shard.unpack(shard.pack())
    asked = np.array([5, 5, 5, 5, 9, 5], np.uint64), np.array([1, 3, 3, 4, 2, 8], np.uint64), np.array([11, 31, 30, 41, 21, 1])
    assert shard.probe(*asked, 5).tolist() == [True, True, False, False, True, False]
    assert shard.probe(*asked, 4).tolist() == [True, True, False, True, True, False]


# --- 5: WARC ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [200_000, 0])
def test_warc_round_trip(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", most)
    html = ["<p>a</p>", "<p>a</p>", None, "", "é\r\n\r\nWARC/1.1", "<p>a</p>", "x" * 5000, "lone"]
    urls = ["http://b.com/1", "http://a.com/", "http://a.com/?q=1 2", None, "HTTP://A.com/", "http://b.com/1", "no scheme\r\nX: y", ""]
    ids = [3, 9, 1, 2, 4, 5, 6, None]
    df = spark.createDataFrame([(*x, "own") for x in zip(ids, urls, html, strict=True)], "page_id long, url string, html string, key string")
    folder = warc.archive_folder(df)
    captures = warc.write_archive(df, folder, file_bytes=300)
    index = warc.build_index(captures, folder, block_lines=2, partitions=3)
    rows = {r.page_id: r for r in warc.read_archive(df.select(warc.capture_key(F.col("url"), F.col("page_id"))), index, payloads=True).collect()}
    assert len(rows) == len(ids) and len({r.file for r in captures.collect()}) > 1
    last = {}
    for i, h in zip(ids, html, strict=True):
        last[h or ""] = max(i or -1, last.get(h or "", -1))
    for i, h in zip(ids, html, strict=True):
        data, r = (h or "").encode(), rows[i]
        first = i is None or last[h or ""] == i
        assert (r.payload_bytes, r.record_type, r.refers_to) == (len(data), "response" if first else "revisit", None if first else last[h or ""])
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode() and r.payload == (data if first else None)
    reader = index.reader()
    assert reader.lookup(b"zz)/ 0000") == []
    for c in captures.collect():
        assert (c.file, c.offset, c.length) in reader.lookup(c.key.encode())
        assert zlib.decompress(reader.read(c.file, c.offset, c.length), 31).startswith(b"WARC/1.1\r\n")
    none = df.limit(0)
    folder = warc.archive_folder(none)
    empty = warc.build_index(warc.write_archive(none, folder), folder)
    assert warc.read_archive(none.select(warc.capture_key(F.col("url"), F.col("page_id"))), empty).count() == 0


def test_small_payloads_are_all_responses_and_repeated_rows_stay(spark):
    df = spark.createDataFrame([(1, "http://a/", "xy"), (2, "http://a/", "xy"), (2, "http://a/", "xy")], "page_id long, url string, html string")
    for least, want in ((3, ["response"] * 3), (0, ["response", "response", "revisit"])):
        folder = warc.archive_folder(df)
        index = warc.build_index(warc.write_archive(df, folder, min_bytes=least), folder)
        rows = warc.read_archive(df.select(warc.capture_key(F.col("url"), F.col("page_id"))), index).collect()
        assert sorted(r.record_type for r in rows) == want


# --- 6 and 9: tokens -------------------------------------------------------------------------------------------

HARD = [None, "", " ", "a  b\n\n c", "x\xa0 \xa0y", "\u2003 z\u0085 q", "é中🙂 ß", "\x1c a\x1d", "aaaa" * 50, "<|endoftext|> <|startoftext|>x", "don't we'LL", "1234 567", "=" * 99, " lead", "trail \n"]


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read()


def test_byte_bpe_equals_the_rank_encoder_and_decodes(spark, ranks):
    import public_tokenizers
    import tiktoken

    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(ranks), special_tokens={})
    texts = [*HARD, *corpus(3, 20)]
    df = docs_of(spark, texts)
    coded = byte_bpe.decode(byte_bpe.encode(df, ranks, public_tokenizers.PATTERN, ids_col="packed"), ranks, ids_col="packed")
    for r in coded.withColumn("list", byte_bpe.unpack(F.col("packed"))).collect():
        t = texts[r.doc_id] or ""
        assert r.list == plain.encode_ordinary(t) and bytes(r.decoded) == t.encode()
    once = byte_bpe.encode(df, ranks, public_tokenizers.PATTERN, ids_col="packed", decoded_col="decoded")
    assert sorted(tuple(r) for r in once.select("doc_id", "packed", "decoded").collect()) == sorted(tuple(r) for r in coded.select("doc_id", "packed", "decoded").collect())
    spans = byte_bpe.encode(df, ranks, public_tokenizers.PATTERN, ids_col="packed", offsets_col="spans")
    for r in spans.withColumn("list", byte_bpe.unpack(F.col("packed"))).collect():
        t = texts[r.doc_id] or ""
        assert r.list == plain.encode_ordinary(t) and all(0 <= s.start < s.end <= len(t) for s in r.spans)
    assert byte_bpe.encode(df.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_repeated_units_and_parts(ranks):
    import public_tokenizers
    import tiktoken

    own = byte_bpe.read_ranks(ranks)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})
    tokenizer = byte_bpe._tokenizer(byte_bpe.tokenizer_json(ranks, public_tokenizers.PATTERN))
    texts = [u * n for u in ("a", "aab", "é", "=-", "\n ", "0", "🙂") for n in (2, 7, 33, 64)]
    ids, stops = byte_bpe.encode_column(tokenizer, pa.array(texts), {})
    assert [ids[a:b].tolist() for a, b in zip(stops[:-1], stops[1:], strict=True)] == [plain.encode_ordinary(t) for t in texts]
    long = " ".join(corpus(5, 8)[20:])
    assert "".join(byte_bpe.safe_parts(long, 50)) == long
    assert sum((plain.encode_ordinary(p) for p in byte_bpe.safe_parts(long, 50)), []) == plain.encode_ordinary(long)
    table = byte_bpe.ByteTable(own)
    ids = np.array(plain.encode_ordinary("é🙂中"), np.uint32)
    single = [np.array([own[bytes([b])]], np.uint32) for b in "é🙂".encode()]
    assert table.decode_text(single) == ["", "é", "", "", "", "🙂"] and table.decode(ids).decode() == "é🙂中"
    assert table.decode_text(single[:1]) == ["\ufffd"]


def test_token_counts(spark):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    texts = [*HARD, *corpus(3, 20)]
    df = docs_of(spark, texts)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for name, kind, count in (("word_bpe_49k.json", "json", lambda t: len(plain.encode(t, add_special_tokens=False).ids)), ("piece_bpe_32k.model", "model", lambda t: len(pieces.encode(t)))):
        with open(public_tokenizers.path(name), "rb") as f:
            rows = token_count.count_tokens(df, f.read(), kind).collect()
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == {i: (len((t or "").encode()), count(t or "")) for i, t in enumerate(texts)}
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        word = f.read()
    twice = token_count.count_tokens(docs_of(spark, ["a b", "a b"], ids=[1, 1]), word, "json").collect()
    assert [(r.doc_id, r.n_tokens) for r in twice] == [(1, 2), (1, 2)] and token_count.count_tokens(df.limit(0), word, "json").count() == 0


def test_json_vocabularies_are_cut_only_where_counts_add_up(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    content = {}
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        with open(public_tokenizers.path(name), "rb") as f:
            content[name] = f.read()
        assert token_count.cuts_at_space(content[name])
    d = json.loads(content["byte_bpe_50k.json"])
    other = [d | {"pre_tokenizer": d["pre_tokenizer"] | {"add_prefix_space": True}}, d | {"pre_tokenizer": None}, d | {"normalizer": {"type": "Strip", "strip_left": True, "strip_right": True}}, d | {"pre_tokenizer": {"type": "Split", "pattern": {"Regex": r"[^\d]+"}, "behavior": "Removed", "invert": True}}]
    other.append(d | {"added_tokens": [d["added_tokens"][0] | {"lstrip": True}]})
    texts = [t for t in HARD if t] + corpus(3, 5)[20:]
    for x in other:
        raw = json.dumps(x).encode()
        assert not token_count.cuts_at_space(raw)
        plain = Tokenizer.from_str(raw.decode())
        rows = token_count.count_tokens(docs_of(spark, texts), raw, "json").collect()
        assert [r.n_tokens for r in sorted(rows)] == [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]


def test_ids_that_are_null_decode_to_nothing(spark, ranks):
    df = spark.createDataFrame([(1, None), (2, b""), (3, b"\x05\x00\x00\x00")], "doc_id long, ids binary")
    rows = byte_bpe.decode(df, ranks).collect()
    assert [r.decoded and bytes(r.decoded) for r in rows][:2] == [b"", b""] and len(rows[2].decoded) == 1
    assert byte_bpe.decode(df.limit(0), ranks).count() == 0


def test_texts_longer_than_a_piece(spark, ranks):
    """Texts of more than the bytes a worker takes at once, whole and right, in every operator."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    rng = random.Random(21)
    words = [f"w{rng.randrange(10**6)}" for _ in range(170_000)]
    line = "a line that is long enough to be counted in every text"
    body = lambda w: "\n".join(" ".join(w[i : i + 200]) for i in range(0, len(w), 200))
    long = body(words)
    near = body([*words[:90_000], "edited", *words[90_001:]])
    texts = [long, line + "\n" + near, "short", " ".join(words[500:560]), *[line + f"\n{i}" for i in range(4)], "word" * 300_000]
    assert all(len(texts[i]) > 1 << 20 for i in (0, 1, 8))
    df = docs_of(spark, texts)
    full = {i: t for i, t in enumerate(texts)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(df).collect()} == brute_components(texts, 5, 80)
    bench = spark.createDataFrame([(1, " ".join(words[169_000:169_040]))], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.first_word) for r in decontaminate.contaminated(df, bench).collect()) == [(0, 1, 169_000), (1, 1, 169_012)]
    got = line_dedup.drop_frequent_lines(df).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got), key=str) == brute_lines(texts, list(range(len(texts))))
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.remove_repeats(df).collect()} == brute_repeats(texts, 35)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(ranks), special_tokens={})
    coded = byte_bpe.encode(df.filter("doc_id < 3"), ranks, public_tokenizers.PATTERN, ids_col="packed", decoded_col="decoded").select("doc_id", "packed", "decoded").collect()
    assert all(np.frombuffer(r.packed, "<u4").tolist() == plain.encode_ordinary(full[r.doc_id]) and bytes(r.decoded).decode() == full[r.doc_id] for r in coded)
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        word = f.read()
    whole = Tokenizer.from_str(word.decode())
    counted = token_count.count_tokens(df.filter("doc_id < 3"), word, "json").collect()
    assert {r.doc_id: r.n_tokens for r in counted} == {i: len(whole.encode(full[i], add_special_tokens=False).ids) for i in range(3)}
    rows = quality_rules.with_statistics(df.filter("doc_id in (0, 1, 8)")).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) for r in rows} == {i: brute_statistics(full[i]) for i in (0, 1, 8)}
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", texts[8])], "conv_id long, turn int, role string, text string")
    back = chat_format.read_back(chat_format.render(turns)).first()
    assert back.targets == [texts[8]] and back.turns[0].text == long
    pages = spark.createDataFrame([(1, "http://a.com/" + "p/" * 600_000 + "?q", long), (2, "http://b.com/", long)], "page_id long, url string, html string")
    assert [(r.host, len(r.path), r.verdict) for r in url_filter.judge_urls(pages, RULES).collect()] == [("a.com", 1_200_001, "allow"), ("b.com", 1, "allow")]
    folder = warc.archive_folder(pages)
    index = warc.build_index(warc.write_archive(pages, folder), folder)
    read = warc.read_archive(pages.select(warc.capture_key(F.col("url"), F.col("page_id"))), index, payloads=True).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.payload and len(r.payload)) for r in read) == [(1, len(long), "revisit", None), (2, len(long), "response", len(long))]


# --- 7: chat ---------------------------------------------------------------------------------------------------


def test_chat_format_round_trip(spark):
    nasty = "\\### Assistant: </turn>\n\\\\h \\b ### </turn"
    rows = [
        (1, 0, "system", nasty), (1, 1, "user", None), (1, 2, "assistant", "é🙂" + nasty), (1, 3, "assistant", ""), (1, 4, "user", "tail</turn>\n"),
        (2, 0, "user", "no reply"), (3, 5, "assistant", "b"), (3, None, "user", "first"), (3, 5, "assistant", "a"), (3, 5, "assistant", "a"), (None, 0, "ro\nle", "x"), (4, 0, None, "###"),
    ]
    df = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    rendered = chat_format.render(df)
    got = {r.conv_id: r for r in chat_format.read_back(rendered).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        assert [(t.role, t.text) for t in got[conv].turns] == [x[1:] for x in own]
        assert list(got[conv].targets) == [x[2] for x in own if x[1] == "assistant"]
    examples = chat_format.expand(rendered).withColumn("whole", chat_format.example_text(F.col("rendered"), F.col("end"))).collect()
    for x in examples:
        assert x.rendered.startswith(x.whole)
        if x.target_turn:
            target = [t.text for t in got[x.conv_id].turns][x.target_turn - 1]
            raw = x.whole[x.target_start : x.target_end]
            assert raw.replace("\\h", "###").replace("\\t", "</turn>").replace("\\b", "\\") == target
            assert x.whole[x.target_end :] == "</turn>\n" and x.whole.count("### ") == x.target_turn
    assert sum(x.conv_id == 1 for x in examples) == 3
    assert chat_format.read_back(chat_format.render(df.limit(0))).count() == 0


def test_chat_targets_are_what_the_spans_cut(spark):
    turns = [(1, 0, "user", "ask"), (1, 1, "assistant", "one ### \\ two"), (1, 2, "user", "x"), (1, 3, "assistant", "four"), (1, 4, "user", "end")]
    rendered = chat_format.render(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"))
    assert chat_format.read_back(rendered).first().targets == ["one ### \\ two", "four"]
    shifted = F.transform("examples", lambda x: x.withField("target_start", F.when(x.target_start < 0, x.target_start).otherwise(x.target_start + 1)))
    assert chat_format.read_back(rendered.withColumn("examples", shifted)).first().targets == ["ne ### \\ two", "our"]
    outside = F.transform("examples", lambda x: x.withField("target_start", F.lit(9999).cast("long")).withField("target_end", F.lit(-5).cast("long")))
    assert chat_format.read_back(rendered.withColumn("examples", outside)).first().targets == ["", "", ""]
    examples = chat_format.expand(rendered).select(F.length(chat_format.example_text(F.col("rendered"), F.col("end")))).collect()
    assert chat_format.read_back(rendered).first().formatted_chars == sum(n for (n,) in examples)
    plan = chat_format.read_back(rendered)._jdf.queryExecution().toString()
    assert plan[plan.index("== Physical Plan ==") :].count("Exchange hashpartitioning") <= 1 and "Python" not in plan


# --- 8: substrings ---------------------------------------------------------------------------------------------


def brute_repeats(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = {}
    for w in words:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] = seen.get(tuple(w[i : i + window]), 0) + 1
    out = {}
    for d, w in enumerate(words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out[d] = len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)
    return out


@pytest.mark.parametrize("window,first", [(35, 16), (35, 4), (9, 2), (20, 20)])
def test_substring_dedup(spark, window, first):
    texts = [*corpus(), "r s " * 40, " ".join(f"t{i}" for i in range(35)), " ".join(f"t{i}" for i in range(35))]
    got = substring_dedup.remove_repeats(docs_of(spark, texts), window=window, first=first)
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got.collect()} == brute_repeats(texts, window)


def test_full_windows_are_told_apart_by_both_lanes():
    items = np.array([[7, 1], [7, 2], [3, 5], [7, 1], [7, 2], [7, 9]], np.uint64)
    order, same = substring_dedup._order(items)
    assert sorted(order.tolist()) == list(range(6)) and same.sum() == 2
    assert all((items[order[i]] == items[order[i - 1]]).all() for i in np.flatnonzero(same))
    assert substring_dedup._order(items[:, :1])[1].sum() == 4 and substring_dedup._order(items[:0])[1].sum() == 0


def test_substring_dedup_of_many_partitions_and_empty_tables(spark):
    texts = corpus(7, 30)
    assert substring_dedup.remove_repeats(docs_of(spark, []), window=9).count() == 0
    assert substring_dedup.level_lengths(35, 16) == [18, 35] and substring_dedup.level_lengths(35, 4) == [5, 9, 18, 35]
    unique = [" ".join(f"{i}-{j}" for j in range(50)) for i in range(4)]
    assert {r.n_removed for r in substring_dedup.remove_repeats(docs_of(spark, unique)).collect()} == {0}
    got = substring_dedup.remove_repeats(docs_of(spark, texts).repartition(13), window=12, first=6)
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got.collect()} == brute_repeats(texts, 12)


# --- 10: quality -----------------------------------------------------------------------------------------------


def brute_statistics(t):
    t = t or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    repeated = {p for ps in at.values() if len(ps) > 1 for i in ps for p in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(repeated)


def test_statistics(spark):
    texts = [*corpus(), "a b c d e a b c d e", "x " * 30, "l\nl\n l\n\n", "#|<>&$%* é", "a b c d e", "1 2 3 4 5 6 1 2 3 4 5 6 7"]
    rows = quality_rules.with_statistics(docs_of(spark, texts)).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) for r in rows} == {i: brute_statistics(t) for i, t in enumerate(texts)}


def test_decision_list_learns_and_becomes_one_expression(spark):
    rng = random.Random(8)
    say = lambda k, junk: " ".join(("## " if junk and rng.random() < 0.6 else "") + f"w{rng.randint(0, 10**6)}" for _ in range(k))
    bad = [i % 4 == 0 for i in range(400)]
    texts = [say(rng.randint(20, 60), b) for b in bad]
    docs = docs_of(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, int(not b), "own") for i, b in enumerate(bad) if i < 300] + [(7, 1, ""), (None, 0, ""), (999, 0, ""), (8, None, "")], "doc_id long, quality int, text string")
    rules = quality_rules.learn(quality_rules.labelled_rows(docs, labels))
    assert rules.rules and str(rules).startswith("reject if ")
    got = {r.doc_id: r for r in quality_rules.judge(docs, rules).collect()}
    held = [(got[i].kept, not bad[i]) for i in range(300, 400)]
    assert sum(a == b for a, b in held) >= 98 and all(a for a, b in held if b)
    for i, r in got.items():
        x = brute_statistics(texts[i] if i < 400 else None)
        features = (x[0], x[1] / max(x[0], 1), x[2] / max(x[0], 1), x[4] / max(x[3], 1), x[5] / max(x[0], 1))
        assert r.base_failed == (x[0] < 10 or 100 * x[5] > 20 * x[0])
        assert r.kept == (not r.base_failed and not rules.rejects(features))


def test_no_labels_or_one_class_learn_nothing(spark):
    docs = docs_of(spark, ["a b c d e f g h i j k"])
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        rules = quality_rules.learn(quality_rules.labelled_rows(docs, some))
        assert rules.rules == () and quality_rules.judge(docs, rules).first().kept
    assert quality_rules.judge(docs.limit(0), rules).count() == 0


# --- the pipeline ----------------------------------------------------------------------------------------------


def test_pipeline_stages_do_what_their_operators_say(spark, tmp_path):
    import corpus_pipeline

    texts = [t for t in corpus(11, 40)]
    ids = list(range(len(texts)))
    passage = " ".join(f"bench{i}" for i in range(30))
    texts += ["start " * 3 + "of a text that holds a passage and some more words " + passage, "## ** || " * 30 + "words of junk text in here too"]
    ids += [1000, 1001]
    # documents of a kind that the labels call bad, the base rules let pass and the learned list must reject
    rng = random.Random(1)
    junk = list(range(2000, 2060))
    texts += [" ".join(f"<{rng.randrange(10**4)}> $$" for _ in range(rng.randrange(10, 60))) for _ in junk]
    ids += junk
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 2000), 0) for i in [*ids[7:30], 1000, *junk]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, by_stage = d, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path)).persist()
        by_stage[name] = before, docs
        if name != "byte_bpe":
            assert docs.columns == d.columns
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    rules = quality_rules.learn(quality_rules.labelled_rows(d, spark.read.parquet(str(tmp_path / "labels.parquet"))))

    def keeps(t):
        x = brute_statistics(t)
        return not (x[0] < 10 or 100 * x[5] > 20 * x[0]) and not rules.rejects((x[0], x[1] / x[0], x[2] / x[0], x[4] / max(x[3], 1), x[5] / x[0]))

    kept = {i for i, t in zip(ids, texts, strict=True) if keeps(t)}
    assert rules.rules and not kept & set(junk) and {1000, *range(7, 30)} <= kept
    assert set(text(by_stage["quality_rules"][1])) == kept
    before, after = (text(x) for x in by_stage["line_dedup"])
    assert after == {i: t for i, _, _, t in brute_lines(list(before.values()), list(before))}
    before, after = (text(x) for x in by_stage["minhash_dedup"])
    order = sorted(before)
    assert set(after) == {order[i] for i, (_, c) in brute_components([before[i] for i in order], 5, 80).items() if i == c}
    assert set(text(by_stage["minhash_dedup"][1])) - set(text(by_stage["decontamination"][1])) == {1000}
    last = {r.doc_id: r for r in by_stage["byte_bpe"][1].collect()}
    assert {i: sha(t) for i, t in text(by_stage["decontamination"][1]).items()} == {i: r.decoded_sha256 for i, r in last.items()}
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(last)
