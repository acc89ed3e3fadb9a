"""Gated execution strategies: when reranking is skipped, and over what it runs otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Skip rule (condition of ``Retrieval.certified``), scope, and whether the strict flag is honoured.
STRATEGIES = {
    "full": ("never", "full", False),
    "rerank_cos_topk_pool": ("never", "pool", False),
    "selective_top50_pool": ("local", "pool", True),
    "selective_top50_pool_exact_global": ("global", "pool", True),
    "selective_top50_pool_maxform": ("maxform", "pool", True),
    "naive_margin": ("naive", "full", False),
    "exact_global": ("global", "full", False),
    "local_topk": ("local", "full", True),
}


def run_strategy(retrieval, name: str) -> DataFrame:
    """``strategy, method, qid, top1, skipped``, executed: reranking runs for the queries that are not skipped, and for
    those alone."""
    kind, scope, strict = STRATEGIES[name]
    done = retrieval.gated(kind, scope=scope, strict=retrieval.params.strict and strict)
    return done.select(F.lit(name).alias("strategy"), "method", "qid", "top1", "skipped")


def strategy_table(retrieval) -> DataFrame:
    """One row per strategy and method: share reranked, R@1, gaps and disagreements to full and pool reranking."""
    rows = None
    for name in STRATEGIES:
        one = run_strategy(retrieval, name)
        rows = one if rows is None else rows.unionByName(one)
    rows = retrieval.truth.with_hit(rows, "top1", "hit").join(retrieval.decisions.select("method", "qid", "has_gt", "full", "pool", "hit_full", "hit_pool"), ["method", "qid"])
    pct = lambda c: 100 * F.avg(c.cast("double"))
    on_gt = lambda c: F.coalesce(F.avg(F.when(F.col("has_gt"), F.col(c).cast("double"))), F.lit(0.0))
    return rows.groupBy("strategy", "method").agg(
        F.count("*").alias("n_queries"), F.avg((~F.col("skipped")).cast("double")).alias("selected_fraction"), on_gt("hit").alias("r1"), (on_gt("hit") - on_gt("hit_full")).alias("r1_gap_full"), (on_gt("hit") - on_gt("hit_pool")).alias("r1_gap_pool"),
        pct(F.col("top1") != F.col("full")).alias("pct_disagree_full"), pct(F.col("top1") != F.col("pool")).alias("pct_disagree_pool"),
    )
