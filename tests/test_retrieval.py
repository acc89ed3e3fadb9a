"""The retrieval analysis against numpy, its invariants and its edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hubgate.functions import ranks
from hubgate.operators import learned, matched_skip, metrics, order, strategies
from hubgate.plans import blocks, retrieval, retrieval_queries
from hubgate.plans.retrieval import METHODS, Params, Retrieval

P = Params(csls_k=3, nnn_k=5, local_k=6, pool_k=6, rerank_k=5)


def frames(spark, q, g, match):
    schema = lambda i: f"{i} long, v array<double>"
    qd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], schema("qid"))
    gd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(g)], schema("cid"))
    return qd, gd, spark.createDataFrame(match or [(0, 0)], "qid long, cid long")


def unit(rng, n, d):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def numpy_psi(s, p=P):
    top = lambda k: -np.sort(-s, axis=0)[: min(k, len(s))].mean(axis=0)
    lse = lambda t: np.log(np.exp(t * s).sum(axis=0)) / t
    return {"CSLS": top(p.csls_k) / 2, "QB-Norm": lse(p.qb_tau), "DB-Norm": lse(p.db_tau), "NNN": p.nnn_w * top(p.nnn_k)}


def numpy_score(s, psi, method, p=P):
    return np.log(np.maximum(s, 1e-12)) + p.db_tau * (s - psi) if method == "DB-Norm" else s - psi


@pytest.fixture(scope="module")
def cell(spark):
    rng = np.random.default_rng(3)
    q, g = unit(rng, 23, 6), unit(rng, 31, 6)
    match = [(i, int(j)) for i in range(20) for j in rng.choice(31, 2, replace=False)]
    return q @ g.T, match, Retrieval(*frames(spark, q, g, match), P)


def test_psi_matches_numpy(cell):
    s, _, r = cell
    want = numpy_psi(s)
    for row in r.psi.collect():
        assert row.psi == pytest.approx(want[row.method][row.cid], abs=1e-12)
    assert r.psi.count() == 4 * s.shape[1]


def test_full_and_pool_top1_match_numpy(cell):
    s, _, r = cell
    psi = numpy_psi(s)
    near = np.argsort(-s, axis=1, kind="stable")[:, : P.pool_k]
    for row in r.decisions.collect():
        score = numpy_score(s[row.qid], psi[row.method], row.method)
        assert row.full == score.argmax()
        assert row.pool == near[row.qid][score[near[row.qid]].argmax()]
        assert row.c1 == s[row.qid].argmax()


def test_certificates_are_sound_and_nested(cell):
    _, _, r = cell
    for row in r.decisions.collect():
        assert not row.cert_global or row.full == row.c1
        assert not row.cert_local or row.pool == row.c1
        assert not row.cert_maxform or row.pool == row.c1
        assert row.cert_maxform or not row.cert_local
        assert row.cert_local or not row.cert_global
        if row.method != "DB-Norm":
            assert row.cert_maxform == (row.pool == row.c1)


def test_strict_certificates_are_a_subset(cell):
    _, _, r = cell
    for kind in ("global", "local", "maxform"):
        assert r.certificates.filter(r.certified(kind, True) & ~r.certified(kind, False)).isEmpty()


def test_gated_second_pass_gives_the_full_result(cell):
    _, _, r = cell
    want = {(x.method, x.qid): (x.full, x.cert_global) for x in r.decisions.collect()}
    got = {(x.method, x.qid): (x.top1, x.skipped) for x in r.gated("global").collect()}
    assert got == want


def test_block_plans_agree(spark, cell):
    _, match, r = cell
    other = Retrieval(r.q, r.g, r.truth, P, blocks.Blocks(7, 9, 0))
    key = lambda rows: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in rows)
    assert key(r.psi_wide.collect()) == key(other.psi_wide.collect())
    assert key(r.shortlist.collect()) == key(other.shortlist.collect())
    assert key(r.rerank_list.collect()) == key(other.rerank_list.collect())


def test_full_strategy_recovers_everything(cell):
    _, _, r = cell
    rows = {(x.strategy, x.method): x for x in strategies.strategy_table(r).collect()}
    assert len(rows) == 8 * 4
    for m in METHODS:
        assert rows["full", m].pct_disagree_full == 0 and rows["full", m].selected_fraction == 1
        assert rows["exact_global", m].pct_disagree_full == 0
        assert rows["selective_top50_pool_maxform", m].pct_disagree_pool == 0


def test_report_and_buckets_add_up(cell):
    _, _, r = cell
    for x in metrics.certificate_report(r.decisions, "cert_global").collect():
        assert x.disagreements_certified == 0 and x.gain_recovery == pytest.approx(100.0)
    for m, rows in _by_method(metrics.margin_buckets(r.decisions, "cert_global").collect()).items():
        assert sum(x.n for x in rows) == 20 and len(rows) == 4
        report = metrics.certificate_report(r.decisions, "cert_global").filter(F.col("method") == m).first()
        assert max(rows, key=lambda x: x.bucket_no).cumulative_delta_r1 == pytest.approx(report.full_gain)


def _by_method(rows):
    out = {}
    for x in rows:
        out.setdefault(x.method, []).append(x)
    return out


def test_global_order_certificates_are_sound(cell):
    _, _, r = cell
    for k in (2, 4):
        for x in order.order_report(r, k).collect():
            assert x.violations_set_global == 0 and x.violations_order_exact_global == 0 and x.violations_order_loose_global == 0
            assert x.max_mrr_drift_order_exact_global < 1e-9 and x.max_ndcg_drift_order_exact_global < 1e-9
    with pytest.raises(ValueError):
        order.effective_k(5, 2)


def test_rank_quality_matches_python(cell):
    s, match, r = cell
    want = {}
    for q in range(20):
        own = {c for a, c in match if a == q}
        ranked = np.argsort(-s[q], kind="stable")[:5]
        hits = [i for i, c in enumerate(ranked) if c in own]
        dcg = sum(1 / np.log2(i + 2) for i in hits)
        want[q] = (1 / (hits[0] + 1) if hits else 0.0, dcg / sum(1 / np.log2(i + 2) for i in range(min(len(own), 5))))
    got = {x.qid: (x.mrr, x.ndcg) for x in metrics.rank_quality(r.shortlist, r.truth, 5).collect()}
    assert set(got) == set(want)
    for q in want:
        assert got[q] == pytest.approx(want[q])


def test_small_gallery_ties_and_negative_similarities(spark):
    q = np.array([[1.0, 0.0], [0.0, -1.0], [1.0, 0.0]])
    g = np.array([[1.0, 0.0], [1.0, 0.0], [-1.0, 0.0]])
    r = Retrieval(*frames(spark, q, g, [(0, 1)]), Params())  # k beyond the queries, K beyond the gallery
    rows = {(x.method, x.qid): x for x in r.decisions.collect()}
    assert len(rows) == 12
    assert rows["CSLS", 0].c1 == 0 and rows["CSLS", 0].full == 0  # equal items: the smaller id
    assert rows["CSLS", 0].margin == 0 and not rows["CSLS", 0].hit_cos
    assert [rows["CSLS", i].has_gt for i in range(3)] == [True, False, False]
    assert all(np.isfinite(x.slack_global) for x in rows.values())


def test_histogram_summary_and_constant_input(spark):
    x = np.random.default_rng(5).normal(size=200)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 2.0)] * 3, "k string, v double")
    rows = metrics.histogram(df, "v", 7, ["k"]).collect()
    counts, _ = np.histogram(x, 7)
    assert [r.n for r in sorted((r for r in rows if r.k == "a"), key=lambda r: r.bin)] == counts.tolist()
    assert [r.n for r in sorted((r for r in rows if r.k == "b"), key=lambda r: r.bin)] == np.histogram([2.0] * 3, 7)[0].tolist()
    s = {r.k: r for r in metrics.summary(df, "v", ["k"]).collect()}
    assert s["a"].median == pytest.approx(np.median(x)) and s["a"].std == pytest.approx(x.std())


def test_ks_statistic(spark):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 30, 300), rng.integers(3, 35, 200)
    one = lambda v: spark.createDataFrame([(float(x),) for x in v], "v double")
    got = metrics.ks_statistic(one(a), one(b), "v").first()
    grid = np.arange(40)
    want = np.abs((a[None] <= grid[:, None]).mean(axis=1) - (b[None] <= grid[:, None]).mean(axis=1)).max()
    assert got.ks == pytest.approx(want) and 0 <= got.p_value < 0.01
    same = metrics.ks_statistic(one(a), one(a), "v").first()
    assert same.ks == 0 and same.p_value == 1


def test_exact_skip_counts_round_half_even(spark):
    df = spark.createDataFrame([("m", i, float(i % 4)) for i in range(10)], "method string, qid long, s double")
    rows = matched_skip.skip_exactly(df, "s", "qid", (0.25, 0.45), ["method"]).collect()
    assert {r: sum(x.skip for x in rows if x.rate == r) for r in (0.25, 0.45)} == {0.25: round(2.5), 0.45: round(4.5)}
    assert {x.qid for x in rows if x.skip and x.rate == 0.25} == {3, 7}


def test_aps_and_alpha(spark):
    p = spark.createDataFrame([(0, 1, 0.95), (0, 2, 0.05), (1, 1, 0.5), (1, 2, 0.3), (1, 3, 0.2)], "qid long, rank int, p double")
    assert {x.qid: x.size for x in matched_skip.aps_set_size(p, 0.1, 50).collect()} == {0: 1, 1: 3}
    first = p.filter("rank = 1").select(F.col("p").alias("p1"))
    row = matched_skip.calibrated_alpha(first, (0.5,)).first()
    assert row.error == 0 and 0.05 <= row.alpha < 0.5


def test_learned_gates(cell):
    _, _, r = cell
    f = learned.feature_table(r)
    assert f.columns == ["method", "qid", *learned.FEATURES, "y"] and f.count() == 4 * 23
    folds = learned.anchored_folds(f)
    assert {x.fold for x in folds.collect()} == {"train", "test"} and folds.count() == 23
    d = r.decisions.filter("method = 'QB-Norm'").select("qid", "margin", "slack_local", (F.col("c1") == F.col("full")).cast("int").alias("y"))
    p = learned.logistic_gate(d, d).select("y", "p").collect()
    assert all(0 <= x.p <= 1 for x in p)
    assert np.mean([x.p for x in p if x.y]) > np.mean([x.p for x in p if not x.y])
    constant = d.withColumn("y", F.lit(1))
    assert {x.p for x in learned.logistic_gate(constant, constant).collect()} == {1.0}


def test_rescaled_slack_skips_groups_without_a_median(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 4.0), ("b", 0.0, 0.0)], "k string, m double, b double")
    assert sorted(x.rescaled for x in metrics.rescaled_slack(df, "m", "b", ["k"]).collect()) == pytest.approx([0.5 - 2 / 3, 1.5 - 4 / 3])


def embeddings_of(path, n, d=6):
    """A small ``embeddings`` table and the similarities of its queries (rows) and gallery (columns)."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    v = unit(np.random.default_rng(8), n, d).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(n), "label": np.arange(n) % 3, "embedding": list(v)}), path / "embeddings.parquet")
    q, g = np.arange(0, n, 5), np.array([i for i in range(n) if i % 5])
    return str(path), q, g, v.astype(float)[q] @ v.astype(float)[g].T


def test_all_pairs_by_both_plans(spark, cell):
    s, _, r = cell
    for sizes in (None, blocks.Blocks(7, 9, 1 << 20), blocks.Blocks(7, 9, 0)):
        rows = blocks.all_pairs(r.q, r.g, sizes).collect()
        assert len(rows) == s.size and {(x.qid, x.cid): x.s for x in rows} == pytest.approx({(i, j): s[i, j] for i in range(23) for j in range(31)})


def test_scaled_similarity_has_every_pair(spark, tmp_path):
    folder, q, g, s = embeddings_of(tmp_path, 60)
    rows = retrieval_queries.fn3_scaled_similarity(spark, folder).collect()
    assert len(rows) == s.size
    assert {(x.qid, x.cid): x.s for x in rows} == pytest.approx({(int(a), int(b)): s[i, j] * 112.5 - 10 for i, a in enumerate(q) for j, b in enumerate(g)}, abs=1e-6)


def test_pair_queries_have_no_bound_on_pairs(spark, tmp_path):
    folder, q, g, s = embeddings_of(tmp_path, 8000, 4)  # 10,240,000 pairs
    lse = {x.cid: x.lse for x in retrieval_queries.fn19_log_sum_exp(spark, folder).collect()}
    assert lse == pytest.approx(dict(zip(g.tolist(), np.log(np.exp(20 * s).sum(axis=0)), strict=True)), abs=1e-5)
    assert tuple(retrieval_queries.lrn8_recompute_difference(spark, folder).first()) == (0, 0.0, 0.0)
    row = retrieval_queries.jn1_all_pairs(spark, folder).agg(F.count("*").alias("n"), F.sum("s").alias("s")).first()
    assert row.n == s.size and row.s == pytest.approx(s.sum(), abs=1)
    row = retrieval_queries.fn18_clamped_log(spark, folder).agg(F.count("*").alias("n"), F.sum("log_s").alias("s")).first()
    assert row.n == s.size and row.s == pytest.approx(np.log(np.maximum(s, 1e-12)).sum(), rel=1e-6)


def test_ranks_and_quantiles_in_buckets(spark):
    rng = np.random.default_rng(4)
    rows = [(None if i % 17 == 0 else ("a", "b", "a")[i % 3], None if i % 13 == 0 else float(rng.integers(0, 9)) if i % 2 else float(rng.normal()), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, x double, i long")
    for down in (False, True):
        got = {r.i: (r.rank, r.n) for r in ranks.with_rank(df, ["k"], "x", ["i"], descending=down, rank="rank", total="n", buckets=7).collect()}
        for k in ("a", "b", None):
            own = sorted((r for r in rows if r[0] == k), key=lambda r: ((r[1] is None) == down, (-1 if down else 1) * (r[1] or 0) if r[1] is not None else 0, r[2]))
            assert [got[r[2]] for r in own] == [(j + 1, len(own)) for j in range(len(own))]
    shares = [0.0, 0.15, 0.5, 1.0]
    for r in ranks.quantiles(df.filter("k is not null"), "x", shares, ["k"]).collect():
        assert r.q == pytest.approx(np.quantile([x for k, x, _ in rows if k == r.k and x is not None], shares).tolist(), abs=1e-12)
    assert ranks.with_rank(df.limit(0), ["k"], "x").count() == 0 and ranks.with_rank(df, [], "i").count() == 400


def test_cells_with_a_learned_gate(cell):
    _, _, r = cell
    rows = matched_skip.evaluate_cell(r, "demo", "i2t", (0.25,), learned_share=0.5).collect()
    assert {(x.cell, x.cert_local_topk, x.gate, x.method) for x in rows} == {("demo|i2t", 6, g, m) for g in ("threshold", "logistic") for m in METHODS}
    assert {x.n_queries for x in rows if x.gate == "logistic"} == {11}


def _kernel(monkeypatch, call, n):
    """The kernel that an operator hands to the pass, for n queries."""
    made = []

    class Stop(Exception):
        pass

    def catch(q, g, extra, make, *rest):
        made.append(make(n))
        raise Stop

    monkeypatch.setattr(blocks, "pass_over_pairs", catch)
    with pytest.raises(Stop):
        call()
    return made[0]


def _peak_mb(kernel, n, m, extras):
    import tracemalloc

    rng = np.random.default_rng(5)
    left, right = unit(rng, n, 8), unit(rng, m, 8)
    tracemalloc.start()
    for at in (0, m):
        list(kernel.add(0, np.arange(n), left, np.arange(at, at + m), right, extras))
        list(kernel.block_done(np.arange(at, at + m)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / (1 << 20)


def test_statistics_hold_few_similarities_at_once(monkeypatch):
    kernel = _kernel(monkeypatch, lambda: blocks.gallery_statistics(None, None, (1, 4), (20.0, 5.0)), 4096)
    assert _peak_mb(kernel, 4096, 2048, {}) < 30  # a block's similarities alone take 64


def test_a_large_query_block_does_not_grow_the_statistics(monkeypatch):
    kernel = _kernel(monkeypatch, lambda: blocks.gallery_statistics(None, None, (1, 4), (20.0,), blocks.Blocks(queries=20_000, broadcast_bytes=0)), 20_000)
    assert _peak_mb(kernel, 20_000, 512, {}) < 30


def test_shortlist_holds_few_similarities_at_once(monkeypatch):
    kernel = _kernel(monkeypatch, lambda: blocks.shortlist(None, None, 5), 2048)
    assert _peak_mb(kernel, 2048, 4096, {}) < 40


def test_reranking_holds_few_similarities_at_once(monkeypatch):
    methods = [("CSLS", "a", None), ("DB-Norm", "a", 20.0)]
    kernel = _kernel(monkeypatch, lambda: blocks.reranked(None, None, methods, 5), 2048)
    assert _peak_mb(kernel, 2048, 4096, {"a": np.zeros(4096), "want": np.arange(2048) % 4}) < 40


def test_a_kernel_gets_few_queries_at_once(spark):
    """A part of many queries is not one block of them."""

    class Sizes(blocks.Kernel):
        def add(self, at, qids, left, cids, right, extras):
            yield blocks.pa.RecordBatch.from_arrays([blocks.pa.array([len(qids)])], names=["n"])

    q = spark.range(9000).select(F.col("id").alias("qid"), F.array(F.lit(1.0)).alias("v"))
    g = spark.range(3).select(F.col("id").alias("cid"), F.array(F.lit(1.0)).alias("v"))
    rows = blocks.pass_over_pairs(q, g.coalesce(1), [], lambda n: Sizes(), "n long", blocks.Blocks(queries=9000, broadcast_bytes=0)).collect()
    assert sum(r.n for r in rows) == 9000 and max(r.n for r in rows) <= 4096


def test_running_lists_with_ties_over_blocks():
    rng = np.random.default_rng(11)
    score, s = rng.integers(0, 6, (37, 300)).astype(float), rng.integers(0, 3, (37, 300)).astype(float)
    cids = rng.permutation(300)
    top = blocks.RunningTop(37, 7)
    for part in np.array_split(np.arange(300), 9):
        part = part[np.argsort(cids[part])]
        for own in blocks.tiles(37, len(part), 200):
            top.add(np.arange(37)[own], score[own][:, part], s[own][:, part], cids[part])
    for i in range(37):
        want = sorted(range(300), key=lambda j: (-score[i, j], -s[i, j], cids[j]))[:7]
        assert top.cid[i].tolist() == cids[want].tolist() and top.score[i].tolist() == score[i, want].tolist()


def test_pairs_of_many_queries_are_dealt_to_more_tasks(spark, tmp_path):
    q = spark.range(3000).select(F.col("id").alias("qid"), F.array_repeat(F.lit(1.0), 1024).alias("v"))
    spark.range(2).select(F.col("id").alias("cid"), F.array_repeat(F.lit(0.5), 1024).alias("v")).coalesce(1).write.parquet(str(tmp_path / "g"))
    found = blocks.all_pairs(q, spark.read.parquet(str(tmp_path / "g")))
    assert found.rdd.getNumPartitions() == 3
    assert found.distinct().count() == 6000 and found.filter("s <> 512").count() == 0


def test_lists_of_many_queries_are_dealt_to_parts():
    """A task's running lists stay small: those of 123,077 queries (6 GB) are not held by one task or two."""
    for n in (20_513, 123_077, 1_000_000):
        for state in (24 * 51, 24 * 10 * 4):
            parts = blocks.part_count(n, 64, state, blocks.Blocks())
            assert -(-n // parts) * state <= 33 << 20 and (n > 30_000 or parts == 1)


def test_rates_need_no_python(spark):
    rates = matched_skip.rate_table(spark, (0.0, 0.15, 0.6, 1.0))
    assert "ExistingRDD" not in rates._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in rates.collect()] == [(0.15,), (0.6,)] and rates.dtypes == [("rate", "double")]
    assert matched_skip.rate_table(spark, ()).count() == 0


def test_gate_pairs_need_python_for_the_passes_only(spark, tmp_path):
    found = retrieval_queries.msk9_gate_pairs(spark, embeddings_of(tmp_path, 60)[0])
    assert "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 20


def test_gate_pairs_store_one_table(spark, tmp_path, monkeypatch):
    """Neither folds nor features are in its result, and for each file that an executor writes it may be forked."""
    written = []
    for module in (learned, retrieval):
        monkeypatch.setattr(module, "stored", lambda df, name: written.append(name) or df)
    assert retrieval_queries.msk9_gate_pairs(spark, embeddings_of(tmp_path, 60)[0]).count() == 20 and written == ["gate-scores"]


def test_report_tables_need_no_python(spark):
    spine = metrics.bucket_spine(spark)
    assert "ExistingRDD" not in spine._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in spine.collect()] == [(i, label, lo, hi) for i, (lo, hi, label) in enumerate(metrics.MARGIN_BUCKETS)]


def test_markdown_rows_need_no_python(spark, tmp_path):
    lines = retrieval_queries.snk7_markdown_report(spark, embeddings_of(tmp_path, 60)[0])
    assert "ExistingRDD" not in lines._jdf.queryExecution().executedPlan().toString()
    assert lines.count() == 32 and all(r.line.startswith("| ") and r.line.endswith(" |") for r in lines.collect())


def test_timings_need_no_python(spark, tmp_path):
    found = retrieval_queries.met29_gated_against_full(spark, embeddings_of(tmp_path, 60)[0])
    assert "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.scope, r.certificate) for r in found.collect()] == [("full", "global"), ("full", "local"), ("pool", "local"), ("pool", "maxform")]
