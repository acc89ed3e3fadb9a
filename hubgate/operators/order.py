"""Top-K set and order certificates, and what reranking does to rank quality.

Global forms are sound against the true reranked list. Local forms ignore penalties outside the list; they are
surrogates, whose violations are counted, and are not meant to gate anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import as_double, rank_quality


def effective_k(k: int, n_gallery: int) -> int:
    out = min(k, n_gallery - 1)
    if out < 2:
        raise ValueError("order certificates need lists of two and a gallery of three items at least")
    return out


def order_certificates(retrieval, k: int) -> DataFrame:
    """Per method and query: gaps, penalty ranges, six flags, the flag of every consecutive pair and the cosine list."""
    k, tol = effective_k(k, retrieval.n_gallery), retrieval.params.tolerance
    w = Window.partitionBy("method", "qid").orderBy("rank")
    own = retrieval.scored_shortlist.filter(F.col("rank") <= k + 1)
    own = own.withColumn("gap", F.col("s") - F.lead("s").over(w)).withColumn("drop", F.col("psi") - F.lead("psi").over(w))
    inside, pair = F.col("rank") <= k, F.col("rank") < k
    ok = F.col("gap") + tol >= F.col("drop")
    per = own.groupBy("method", "qid").agg(
        F.max(F.when(F.col("rank") == k, F.col("gap"))).alias("m_k"),
        F.min(F.when(pair, F.col("gap"))).alias("m_pair"),
        F.max(F.when(inside, F.col("psi"))).alias("psi_high"),
        F.min(F.when(inside, F.col("psi"))).alias("psi_low"),
        F.bool_and(F.when(pair, ok)).alias("pairs_ok"),
        F.transform(F.sort_array(F.collect_list(F.when(pair, F.struct("rank", ok.alias("ok"))))), lambda x: x.ok).alias("per_pair_ok"),
        F.transform(F.sort_array(F.collect_list(F.when(inside, F.struct("rank", "cid")))), lambda x: x.cid).alias("cosine_list"),
    )
    d = per.join(F.broadcast(retrieval.psi_min), "method").withColumn("psi_range", F.col("psi_high") - F.col("psi_low"))
    d = d.withColumn("rhs_global", F.col("psi_high") - F.col("psi_min")).withColumn("rhs_local", F.col("psi_range"))
    for scope in ("global", "local"):
        d = d.withColumn(f"set_{scope}", F.col("m_k") + tol >= F.col(f"rhs_{scope}"))
        d = d.withColumn(f"order_loose_{scope}", F.col(f"set_{scope}") & (F.col("m_pair") + tol >= F.col("psi_range")))
        d = d.withColumn(f"order_exact_{scope}", F.col(f"set_{scope}") & F.col("pairs_ok"))
    return d.drop("psi_min", "psi_high", "psi_low", "pairs_ok")


def rank_drift(retrieval, k: int) -> DataFrame:
    """Per method and query with a match: MRR and nDCG of the cosine and the reranked list, and their differences."""
    cosine = rank_quality(retrieval.shortlist, retrieval.truth, k).withColumnsRenamed({"mrr": "mrr_cosine", "ndcg": "ndcg_cosine"})
    again = rank_quality(retrieval.rerank_list, retrieval.truth, k, ["method"]).withColumnsRenamed({"mrr": "mrr_rerank", "ndcg": "ndcg_rerank"})
    d = again.join(cosine, "qid")
    return d.withColumn("mrr_drift", F.abs(F.col("mrr_cosine") - F.col("mrr_rerank"))).withColumn("ndcg_drift", F.abs(F.col("ndcg_cosine") - F.col("ndcg_rerank")))


def lists_changed(retrieval, k: int) -> DataFrame:
    """Per method and query whether reranking changed the set or the order of the first k."""
    own = retrieval.rerank_list.filter(F.col("rank") <= k).groupBy("method", "qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "cid"))), lambda x: x.cid).alias("reranked_list"))
    cos = retrieval.shortlist.filter(F.col("rank") <= k).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "cid"))), lambda x: x.cid).alias("cos_list"))
    d = own.join(cos, "qid")
    return d.select("method", "qid", "reranked_list", (F.sort_array("reranked_list") != F.sort_array("cos_list")).alias("set_changed"), (F.col("reranked_list") != F.col("cos_list")).alias("order_changed"))


def order_report(retrieval, k: int) -> DataFrame:
    """Per method: fire rates, violations, and drift overall and where the exact order certificates fire."""
    flags = ("set_global", "set_local", "order_loose_global", "order_loose_local", "order_exact_global", "order_exact_local")
    d = order_certificates(retrieval, k).join(lists_changed(retrieval, k), ["method", "qid"]).join(rank_drift(retrieval, k).select("method", "qid", "mrr_drift", "ndcg_drift"), ["method", "qid"], "left")
    worst = lambda c, flag: F.coalesce(F.max(F.when(F.col(flag), F.col(c))), F.lit(0.0))
    out = [F.count("*").alias("n_queries"), F.count("mrr_drift").alias("n_eval")]
    for f in flags:
        broken = F.col("set_changed") if f.startswith("set") else F.col("order_changed")
        out += [F.avg(as_double(f)).alias(f"rate_{f}"), F.count_if(f).alias(f"n_{f}"), F.count_if(F.col(f) & broken).alias(f"violations_{f}")]
    for f in ("order_exact_global", "order_exact_local", "order_loose_global"):
        out += [worst("mrr_drift", f).alias(f"max_mrr_drift_{f}"), worst("ndcg_drift", f).alias(f"max_ndcg_drift_{f}")]
    out += [F.avg("mrr_drift").alias("mean_mrr_drift"), F.avg("ndcg_drift").alias("mean_ndcg_drift"), F.max("mrr_drift").alias("max_mrr_drift"), F.max("ndcg_drift").alias("max_ndcg_drift")]
    return d.groupBy("method").agg(*out)
