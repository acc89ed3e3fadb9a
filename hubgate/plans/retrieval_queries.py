"""Queries over the ``embeddings`` table: similarities, penalties, certificates, strategies, metrics, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.literal import literal_rows
from ..operators import learned, matched_skip, metrics, order, pairs, strategies
from ..sources import bank
from . import blocks, retrieval
from .registry import ORACLES, register, rounded

# Shared SQL: similarities, ranks, penalties, certificates, reranked top-1 and hits, with the default parameters.
BASE = """
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
q AS (SELECT vec_id AS qid, label AS ql, v FROM e WHERE vec_id % 5 = 0),
g AS (SELECT vec_id AS cid, label AS gl, v FROM e WHERE vec_id % 5 <> 0),
sim AS (SELECT qid, cid, ql, gl, list_dot_product(q.v, g.v) AS s FROM q, g),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, cid) AS rn, row_number() OVER (PARTITION BY cid ORDER BY s DESC, qid) AS rq FROM sim),
psi AS (SELECT cid, avg(s) FILTER (WHERE rq <= 20) / 2 AS csls, ln(sum(exp(20 * s))) / 20 AS qb, ln(sum(exp(20 * s))) / 20 AS db, 0.5 * avg(s) FILTER (WHERE rq <= 64) AS nnn FROM r GROUP BY cid),
pl AS (SELECT 'CSLS' AS method, cid, csls AS psi FROM psi UNION ALL SELECT 'QB-Norm', cid, qb FROM psi UNION ALL SELECT 'DB-Norm', cid, db FROM psi UNION ALL SELECT 'NNN', cid, nnn FROM psi),
pm AS (SELECT method, min(psi) AS psi_min FROM pl GROUP BY method),
sc AS (SELECT method, r.*, psi, CASE WHEN method = 'DB-Norm' THEN ln(greatest(s, 1e-12)) + 20 * (s - psi) ELSE s - psi END AS score FROM r JOIN pl USING (cid)),
rr AS (SELECT *, row_number() OVER (PARTITION BY method, qid ORDER BY score DESC, s DESC, cid) AS rf FROM sc),
sl AS (SELECT *, row_number() OVER (PARTITION BY method, qid ORDER BY score DESC, s DESC, cid) AS rp FROM sc WHERE rn <= 50),
top AS (SELECT qid, max(cid) FILTER (WHERE rn = 1) AS c1, max(s) FILTER (WHERE rn = 1) AS s1, max(s) FILTER (WHERE rn = 2) AS s2 FROM r WHERE rn <= 2 GROUP BY qid),
ce AS (SELECT method, qid, max(cid) FILTER (WHERE rn = 1) AS c1, max(psi) FILTER (WHERE rn = 1) AS psi1, max(s) FILTER (WHERE rn = 1) - max(s) FILTER (WHERE rn = 2) AS margin,
              max(psi) FILTER (WHERE rn = 1) - min(psi) AS b_local, (max(psi) FILTER (WHERE rn = 1) - max(s) FILTER (WHERE rn = 1)) - min(psi - s) FILTER (WHERE rn > 1) AS max_term
       FROM sl GROUP BY method, qid),
cx AS (SELECT ce.*, psi1 - psi_min AS b_global, margin - (psi1 - psi_min) AS slack_global, margin - b_local AS slack_local FROM ce JOIN pm USING (method)),
gt AS (SELECT qid, cid FROM q JOIN g ON ql = gl),
d AS (SELECT cx.*, slack_global >= 0 AS cert_global, slack_local >= 0 AS cert_local, max_term <= 0 AS cert_maxform, margin >= 0.05 AS cert_naive, f.cid AS "full", p.cid AS pool,
             EXISTS (SELECT 1 FROM gt WHERE gt.qid = cx.qid) AS has_gt, (cx.qid, cx.c1) IN (SELECT (qid, cid) FROM gt) AS hit_cos, (cx.qid, f.cid) IN (SELECT (qid, cid) FROM gt) AS hit_full, (cx.qid, p.cid) IN (SELECT (qid, cid) FROM gt) AS hit_pool
      FROM cx JOIN rr f ON f.method = cx.method AND f.qid = cx.qid AND f.rf = 1 JOIN sl p ON p.method = cx.method AND p.qid = cx.qid AND p.rp = 1)
"""


def sql(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([BASE, *ctes]) + "\n" + select


demo = retrieval.demo


def _in_parts(spark, sf_dir):
    """The analysis as for a query side beyond the broadcast bound: some six parts of the queries, whose results are
    merged, and small gallery blocks, over which top lists run."""
    r = demo(spark, sf_dir)
    return r.in_blocks(blocks.Blocks(max(64, -(-r.n_queries // 6)), 96, 0))


def _demo_bank(spark, sf_dir) -> DataFrame:
    """The table as a bank with ids in the image and caption form, and splits by a rule on the id."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = F.col("vec_id")
    base = F.concat(F.lit("emb_"), F.floor(n / 5).cast("string"))
    id_ = F.when(n % 5 == 0, base).otherwise(F.concat(base, F.lit("_cap"), (n % 5 - 1).cast("string")))
    split = F.when(F.floor(n / 5) % 2 == 0, "test").otherwise("val")
    return e.select(id_.alias("id"), n.alias("idx"), split.alias("split"), F.when(n % 5 == 0, "image").otherwise("text").alias("modality"), F.col("embedding").cast("array<double>").alias("v"), "label")


_BANK = """
b AS (SELECT CASE WHEN vec_id % 5 = 0 THEN 'emb_' || (vec_id // 5) ELSE 'emb_' || (vec_id // 5) || '_cap' || (vec_id % 5 - 1) END AS id, vec_id AS idx,
             CASE WHEN (vec_id // 5) % 2 = 0 THEN 'test' ELSE 'val' END AS split, CASE WHEN vec_id % 5 = 0 THEN 'image' ELSE 'text' END AS modality, embedding::DOUBLE[] AS v FROM embeddings)
"""


@register("src1_bank_scan", f"WITH {_BANK} SELECT CASE WHEN modality = 'image' THEN 'query' ELSE 'gallery' END AS side, count(*) AS n, min(id) AS first_id, round(sum(v[1]), 6) AS v1 FROM b WHERE split = 'test' GROUP BY 1")
def src1_bank_scan(spark, sf_dir):
    q, g = bank.pair(_demo_bank(spark, sf_dir), "i2t")
    side = lambda d, i, name: d.agg(F.lit(name).alias("side"), F.count("*").alias("n"), F.min(i).alias("first_id"), F.sum(F.col("v")[0]).alias("v1"))
    return rounded(side(q, "qid", "query").unionByName(side(g, "cid", "gallery")))


@register("src2_dataset_alias", "SELECT * FROM (VALUES ('coco', 'coco'), ('flickr30k', 'flickr30k'), ('flickr30k_entities', 'flickr30k'), ('flickr_entities', 'flickr30k')) t(dataset, stem)")
def src2_dataset_alias(spark, sf_dir):
    return spark.createDataFrame([(d, bank.dataset_stem(d)) for d in ("coco", "flickr30k", "flickr30k_entities", "flickr_entities")], "dataset string, stem string")


@register("src3_split_scan", f"WITH {_BANK} SELECT id, round(v[1], 6) AS v1 FROM b WHERE split = 'val' AND modality = 'text'")
def src3_split_scan(spark, sf_dir):
    b = _demo_bank(spark, sf_dir).filter((F.col("split") == "val") & (F.col("modality") == "text"))
    return rounded(b.select("id", F.col("v")[0].alias("v1")))


@register(
    "src4_multi_split_gallery",
    f"WITH {_BANK}, n AS (SELECT max(idx) + 1 AS n FROM b WHERE split = 'test' AND modality = 'text') SELECT id AS cid, idx + CASE WHEN split = 'val' THEN (SELECT n FROM n) ELSE 0 END AS cidx FROM b WHERE modality = 'text'",
)
def src4_multi_split_gallery(spark, sf_dir):
    return bank.pair(_demo_bank(spark, sf_dir), "i2t", gallery_splits=("test", "val"))[1].select("cid", "cidx")


@register("fn1_l2_normalize", "WITH p AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: 9 * x * x))) AS n, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round(n, 6) AS before, round(3 * v[1] / n, 6) AS v1 FROM p")
def fn1_l2_normalize(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3).alias("v"))
    return rounded(e.select("vec_id", vectors.norm(F.col("v")).alias("before"), vectors.l2_normalize(F.col("v"))[0].alias("v1")))


@register("fn2_cosine", sql("SELECT qid, cid, round(s, 6) AS s FROM sim"))
@register("jn1_all_pairs", sql("SELECT qid, cid, round(s, 6) AS s FROM sim"))
def jn1_all_pairs(spark, sf_dir):
    r = demo(spark, sf_dir)
    return rounded(blocks.all_pairs(r.q, r.g))


@register("fn3_scaled_similarity", sql("SELECT qid, cid, round(s * 112.5 - 10.0, 6) AS s FROM sim"))
def fn3_scaled_similarity(spark, sf_dir):
    r = demo(spark, sf_dir)
    return rounded(blocks.all_pairs(r.q, r.g).select("qid", "cid", vectors.scaled_similarity(F.col("s"), 112.5, -10.0).alias("s")))


@register("fn16_softmax", sql("SELECT qid, rn::INT AS rank, cid, round(exp(s / 0.07) / sum(exp(s / 0.07)) OVER (PARTITION BY qid), 6) AS p FROM r WHERE rn <= 50"))
def fn16_softmax(spark, sf_dir):
    return rounded(learned.shortlist_probabilities(demo(spark, sf_dir)))


@register("fn17_entropy", sql("SELECT qid, round(sum(-p * ln(greatest(p, 1e-12))), 6) AS entropy FROM p GROUP BY qid", "p AS (SELECT qid, exp(s / 0.07) / sum(exp(s / 0.07)) OVER (PARTITION BY qid) AS p FROM r WHERE rn <= 50)"))
def fn17_entropy(spark, sf_dir):
    return rounded(learned.shortlist_probabilities(demo(spark, sf_dir)).groupBy("qid").agg(F.sum(vectors.entropy_term(F.col("p"))).alias("entropy")))


@register("fn18_clamped_log", sql("SELECT qid, cid, round(ln(greatest(s, 1e-12)), 6) AS log_s FROM sim"))
def fn18_clamped_log(spark, sf_dir):
    r = demo(spark, sf_dir)
    return rounded(blocks.all_pairs(r.q, r.g).select("qid", "cid", vectors.clamped_log(F.col("s")).alias("log_s")))


@register("fn19_log_sum_exp", sql("SELECT cid, round(ln(sum(exp(20 * s))), 6) AS lse FROM sim GROUP BY cid"))
def fn19_log_sum_exp(spark, sf_dir):
    r = demo(spark, sf_dir)
    return rounded(blocks.gallery_statistics(r.q, r.g, (1,), (20.0,)).select("cid", F.col("lse_0").alias("lse")))


# the caps are the feature
@register("fn20_row_caps", sql("SELECT qid, cid, round(s, 6) AS s FROM sim WHERE qid < 100 AND cid < 100"))
def fn20_row_caps(spark, sf_dir):
    r = demo(spark, sf_dir)
    return rounded(blocks.all_pairs(r.q.filter("qid < 100"), r.g.filter("cid < 100")))


@register("jn2_blocked_shortlist", sql("SELECT qid, rn::INT AS rank, cid, round(s, 6) AS s FROM r WHERE rn <= 51"))
def jn2_blocked_shortlist(spark, sf_dir):
    return rounded(_in_parts(spark, sf_dir).shortlist)


@register("top2_shortlist", sql("SELECT qid, rn::INT AS rank, cid, round(s, 6) AS s FROM r WHERE rn <= 51"))
def top2_shortlist(spark, sf_dir):
    return rounded(demo(spark, sf_dir).shortlist)


@register("jn3_match_captions", f"WITH {_BANK} SELECT regexp_extract(id, '^(.*)_cap', 1) AS qid, idx AS cidx FROM b WHERE modality = 'text' AND split = 'test'")
def jn3_match_captions(spark, sf_dir):
    return pairs.matches_to_captions(*bank.pair(_demo_bank(spark, sf_dir), "i2t"))


@register("jn4_match_images", f"WITH {_BANK} SELECT t.id AS qid, max(i.idx) AS cidx FROM b t JOIN b i ON regexp_extract(t.id, '^(.*)_cap', 1) = i.id WHERE t.modality = 'text' AND t.split = 'test' AND i.modality = 'image' GROUP BY t.id")
def jn4_match_images(spark, sf_dir):
    return pairs.matches_to_images(*bank.pair(_demo_bank(spark, sf_dir), "t2i"))


@register("jn5_has_match", sql("SELECT qid FROM q WHERE EXISTS (SELECT 1 FROM gt WHERE gt.qid = q.qid)"))
def jn5_has_match(spark, sf_dir):
    r = demo(spark, sf_dir)
    return r.q.select("qid").join(r.truth.sizes(), "qid", "left_semi")


@register("jn6_top1_hits", sql("SELECT qid, c1 FROM top WHERE (qid, c1) IN (SELECT (qid, cid) FROM gt)"))
def jn6_top1_hits(spark, sf_dir):
    r = demo(spark, sf_dir)
    return r.truth.with_hit(r.top.select("qid", "c1"), "c1", "hit").filter("hit").select("qid", "c1")


@register("jn7_psi_gather", sql("SELECT method, qid, rn::INT AS rank, cid, round(psi, 6) AS psi FROM sl"))
@register("jn8_shortlist_gather", sql("SELECT method, qid, rn::INT AS rank, cid, round(psi, 6) AS psi FROM sl"))
def jn7_psi_gather(spark, sf_dir):
    return rounded(demo(spark, sf_dir).scored_shortlist.filter("rank <= 50").select("method", "qid", "rank", "cid", "psi"))


_GATED = "SELECT method, qid, CASE WHEN cert_{0} THEN c1 ELSE \"full\" END AS top1, cert_{0} AS skipped FROM d"


@register("jn9_gated_global", sql(_GATED.format("global")))
@register("top5_gated_global", sql(_GATED.format("global")))
def top5_gated_global(spark, sf_dir):
    return demo(spark, sf_dir).gated("global")


@register("top5_gated_local", sql(_GATED.format("local")))
def top5_gated_local(spark, sf_dir):
    return demo(spark, sf_dir).gated("local")


@register("jn13_dump_join", sql("SELECT a.method, count(*) AS n, count(*) FILTER (WHERE a.slack_local < a.slack_global) AS out_of_order FROM cx a GROUP BY a.method"))
def jn13_dump_join(spark, sf_dir):
    c = demo(spark, sf_dir).certificates
    both = c.select("method", "qid", "slack_global").join(c.select("method", "qid", "slack_local"), ["method", "qid"], "full")
    return both.groupBy("method").agg(F.count("*").alias("n"), F.count_if((F.col("slack_local") < F.col("slack_global")) | F.col("slack_local").isNull() | F.col("slack_global").isNull()).alias("out_of_order"))


for _key, _column in (("psi1_csls", "csls"), ("psi2_qb_norm", "qb"), ("psi3_db_norm", "db"), ("psi4_nnn", "nnn")):
    register(_key, sql(f"SELECT cid, round({_column}, 6) AS psi FROM psi"))(lambda spark, sf_dir, c=_column: rounded(demo(spark, sf_dir).psi_wide.select("cid", F.col(c).alias("psi"))))


@register("psi5_all_in_one_pass", sql("SELECT cid, round(csls, 6) AS csls, round(qb, 6) AS qb, round(db, 6) AS db, round(nnn, 6) AS nnn FROM psi"))
def psi5_all_in_one_pass(spark, sf_dir):
    return rounded(demo(spark, sf_dir).psi_wide)


@register("psi6_partial_final", sql("SELECT cid, round(csls, 6) AS csls, round(qb, 6) AS qb, round(db, 6) AS db, round(nnn, 6) AS nnn FROM psi"))
def psi6_partial_final(spark, sf_dir):
    """Top lists and sums of every part of the queries, merged by item."""
    return rounded(_in_parts(spark, sf_dir).psi_wide)


@register("psi7_dispatch", sql("SELECT method, round(min(psi), 6) AS psi_min, round(max(psi), 6) AS psi_max FROM pl GROUP BY method"))
def psi7_dispatch(spark, sf_dir):
    return rounded(demo(spark, sf_dir).psi.groupBy("method").agg(F.min("psi").alias("psi_min"), F.max("psi").alias("psi_max")))


@register("top1_margin", sql("SELECT qid, c1, round(s1 - s2, 6) AS margin FROM top"))
def top1_margin(spark, sf_dir):
    return rounded(demo(spark, sf_dir).top.select("qid", "c1", "margin"))


@register("top3_full_offset", sql("SELECT method, qid, \"full\" FROM d WHERE method <> 'DB-Norm'"))
def top3_full_offset(spark, sf_dir):
    return demo(spark, sf_dir).full_top.filter("method <> 'DB-Norm'")


@register("top4_full_db", sql("SELECT qid, \"full\" FROM d WHERE method = 'DB-Norm'"))
def top4_full_db(spark, sf_dir):
    return demo(spark, sf_dir).full_top.filter("method = 'DB-Norm'").drop("method")


@register("top6_pool_top1", sql("SELECT method, qid, pool FROM d"))
def top6_pool_top1(spark, sf_dir):
    return demo(spark, sf_dir).pool_top


@register("top10_blocked_pool", sql("SELECT method, qid, pool FROM d"))
def top10_blocked_pool(spark, sf_dir):
    return _in_parts(spark, sf_dir).pool_top


@register("top7_gated_pool", sql("SELECT method, qid, CASE WHEN cert_local THEN c1 ELSE pool END AS top1, cert_local AS skipped FROM d"))
def top7_gated_pool(spark, sf_dir):
    return strategies.run_strategy(demo(spark, sf_dir), "selective_top50_pool").select("method", "qid", "top1", "skipped")


@register("top8_block_merge", sql("SELECT qid, rn::INT AS rank, cid, round(s, 6) AS s FROM r WHERE rn <= 5"))
def top8_block_merge(spark, sf_dir):
    """The shortlist by the plan for a query side beyond the broadcast bound, in small blocks and parts."""
    from .blocks import Blocks, shortlist

    r = demo(spark, sf_dir)
    w = Window.partitionBy("qid").orderBy(F.desc("s"), "cid")
    found = shortlist(r.q, r.g, 5, Blocks(max(64, -(-r.n_queries // 6)), 96, 0)).withColumn("rank", F.row_number().over(w)).filter("rank <= 5")
    return rounded(found.select("qid", "rank", "cid", "s"))


@register("top9_running_best", sql("SELECT method, qid, \"full\" FROM d"))
def top9_running_best(spark, sf_dir):
    """The best item so far runs on over gallery blocks, within tasks and then between them."""
    r = _in_parts(spark, sf_dir)
    return r.best(r.q, r._method_list(), 1).select("method", "qid", F.col("cid").alias("full"))


@register("top11_rerank_list", sql("SELECT method, qid, rf::INT AS rank, cid, round(score, 6) AS score FROM rr WHERE rf <= 10"))
def top11_rerank_list(spark, sf_dir):
    return rounded(demo(spark, sf_dir).rerank_list.select("method", "qid", "rank", "cid", "score"))


_RATES = "rates(rate) AS (SELECT unnest([0.15, 0.25, 0.35, 0.45, 0.55])::DOUBLE)"
_EXACT = "x AS (SELECT method, qid, slack_local, row_number() OVER (PARTITION BY method ORDER BY slack_local DESC, qid) AS k, count(*) OVER (PARTITION BY method) AS n FROM d)"


@register("top12_exact_k_skip", sql("SELECT method, rate, qid, k <= round_even(rate * n, 0) AS skip FROM x, rates", _EXACT, _RATES))
def top12_exact_k_skip(spark, sf_dir):
    own = demo(spark, sf_dir).certificates.select("method", "qid", "slack_local")
    return matched_skip.skip_exactly(own, "slack_local", "qid", matched_skip.LEARNED_RATES, ["method"]).select("method", "rate", "qid", "skip")


@register("crt1_global_slack", sql("SELECT method, qid, round(b_global, 6) AS b, round(slack_global, 6) AS slack FROM cx"))
def crt1_global_slack(spark, sf_dir):
    return rounded(demo(spark, sf_dir).certificates.select("method", "qid", F.col("b_global").alias("b"), F.col("slack_global").alias("slack")))


@register("crt2_local_slack", sql("SELECT method, qid, round(b_local, 6) AS b, round(slack_local, 6) AS slack FROM cx"))
def crt2_local_slack(spark, sf_dir):
    return rounded(demo(spark, sf_dir).certificates.select("method", "qid", F.col("b_local").alias("b"), F.col("slack_local").alias("slack")))


for _key, _kind in (("crt3_certified", "global"), ("crt4_local", "local"), ("crt5_global", "global"), ("crt6_maxform", "maxform"), ("crt7_naive_margin", "naive")):
    register(_key, sql(f"SELECT method, qid, cert_{_kind} AS certified FROM d"))(lambda spark, sf_dir, k=_kind: demo(spark, sf_dir).decisions.select("method", "qid", F.col(f"cert_{k}").alias("certified")))

register("crt4_local_strict", sql("SELECT method, qid, slack_local > 0 AS certified FROM cx"))(
    lambda spark, sf_dir: (lambda r: r.certificates.select("method", "qid", r.certified("local", True).alias("certified")))(demo(spark, sf_dir))
)

# Set and order certificates for lists of K items; KK is replaced.
_ORDER = """
o1 AS (SELECT method, qid, rn, cid, s, psi, s - lead(s) OVER w AS gap, psi - lead(psi) OVER w AS drp FROM sc WHERE rn <= KK + 1 WINDOW w AS (PARTITION BY method, qid ORDER BY rn)),
o2 AS (SELECT method, qid, max(gap) FILTER (WHERE rn = KK) AS m_k, min(gap) FILTER (WHERE rn < KK) AS m_pair, max(psi) FILTER (WHERE rn <= KK) AS hi, min(psi) FILTER (WHERE rn <= KK) AS lo, bool_and(gap + 1e-7 >= drp) FILTER (WHERE rn < KK) AS ok,
              list(gap + 1e-7 >= drp ORDER BY rn) FILTER (WHERE rn < KK) AS per_pair_ok, list(cid ORDER BY rn) FILTER (WHERE rn <= KK) AS cosine_list FROM o1 GROUP BY method, qid),
o3 AS (SELECT o2.*, hi - psi_min AS rhs_global, hi - lo AS rhs_local FROM o2 JOIN pm USING (method)),
o AS (SELECT *, m_k + 1e-7 >= rhs_global AS set_global, m_k + 1e-7 >= rhs_local AS set_local, m_k + 1e-7 >= rhs_global AND m_pair + 1e-7 >= rhs_local AS order_loose_global, m_k + 1e-7 >= rhs_local AND m_pair + 1e-7 >= rhs_local AS order_loose_local,
             m_k + 1e-7 >= rhs_global AND ok AS order_exact_global, m_k + 1e-7 >= rhs_local AND ok AS order_exact_local FROM o3)
"""
_QUALITY = """
idl AS (SELECT qid, list_sum(list_transform(range(1, least(count(*), KK) + 1), lambda i: 1 / log2(i + 1))) AS idcg FROM gt GROUP BY qid),
hc AS (SELECT qid, coalesce(1.0::DOUBLE / min(rn) FILTER (WHERE ql = gl), 0) AS mrr, coalesce(sum(1 / log2(rn + 1)) FILTER (WHERE ql = gl), 0) AS dcg FROM r WHERE rn <= KK GROUP BY qid),
hr AS (SELECT method, qid, coalesce(1.0::DOUBLE / min(rf) FILTER (WHERE ql = gl), 0) AS mrr, coalesce(sum(1 / log2(rf + 1)) FILTER (WHERE ql = gl), 0) AS dcg FROM rr WHERE rf <= KK GROUP BY method, qid),
dr AS (SELECT hr.method, hr.qid, hc.mrr AS mrr_cosine, hc.dcg / idcg AS ndcg_cosine, hr.mrr AS mrr_rerank, hr.dcg / idcg AS ndcg_rerank, abs(hc.mrr - hr.mrr) AS mrr_drift, abs(hc.dcg / idcg - hr.dcg / idcg) AS ndcg_drift FROM hr JOIN hc USING (qid) JOIN idl USING (qid))
"""
_CHANGED = """
ch AS (SELECT a.method, a.qid, list_sort(a.l) <> list_sort(b.l) AS set_changed, a.l <> b.l AS order_changed FROM
       (SELECT method, qid, list(cid ORDER BY rf) AS l FROM rr WHERE rf <= KK GROUP BY method, qid) a JOIN (SELECT qid, list(cid ORDER BY rn) AS l FROM r WHERE rn <= KK GROUP BY qid) b USING (qid))
"""


def _at_k(text: str, k: int) -> str:
    return text.replace("KK", str(k))


for _k in (2, 5, 10):
    register(
        f"crt8_10_set_order_k{_k}",
        sql("SELECT method, qid, set_global, set_local, order_loose_global, order_loose_local, order_exact_global, order_exact_local FROM o", _at_k(_ORDER, _k)),
    )(lambda spark, sf_dir, k=_k: order.order_certificates(demo(spark, sf_dir), k).select("method", "qid", *[f"{a}_{b}" for a in ("set", "order_loose", "order_exact") for b in ("global", "local")]))


@register("crt11_effective_k", sql("SELECT k::INT AS k, least(k, n - 1)::INT AS effective FROM (SELECT unnest([2, 5, 10, 100000]) AS k), (SELECT count(*) AS n FROM g)"))
def crt11_effective_k(spark, sf_dir):
    n = demo(spark, sf_dir).n_gallery
    return spark.createDataFrame([(k, order.effective_k(k, n)) for k in (2, 5, 10, 100_000)], "k int, effective int")


@register("snk4_order_dump", sql("SELECT method, qid, round(m_k, 6) AS m_k, round(m_pair, 6) AS m_pair, round(rhs_local, 6) AS psi_range, per_pair_ok, cosine_list FROM o", _at_k(_ORDER, 10)))
def snk4_order_dump(spark, sf_dir):
    return rounded(order.order_certificates(demo(spark, sf_dir), 10).select("method", "qid", "m_k", "m_pair", "psi_range", "per_pair_ok", "cosine_list"))


for _name, (_kind, _scope, _) in strategies.STRATEGIES.items():
    _skip = "false" if _kind == "never" else f"cert_{_kind}"
    register(f"str_{_name}", sql(f'SELECT method, qid, CASE WHEN {_skip} THEN c1 ELSE "{_scope}" END AS top1, {_skip} AS skipped FROM d'))(
        lambda spark, sf_dir, n=_name: strategies.run_strategy(demo(spark, sf_dir), n).select("method", "qid", "top1", "skipped")
    )

_STRATEGY_ROWS = "st AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS strategy, method, {'false' if k == 'never' else 'cert_' + k} AS skipped, CASE WHEN {'false' if k == 'never' else 'cert_' + k} THEN c1 ELSE \"{s}\" END AS top1, CASE WHEN {'false' if k == 'never' else 'cert_' + k} THEN hit_cos ELSE hit_{s} END AS hit, \"full\", pool, has_gt, hit_full, hit_pool FROM d"
    for n, (k, s, _) in strategies.STRATEGIES.items()
) + ")"


@register(
    "met12_strategy_table",
    sql(
        """SELECT strategy, method, count(*) AS n_queries, round(avg((NOT skipped)::INT), 6) AS selected_fraction, round(avg(hit::INT) FILTER (WHERE has_gt), 6) AS r1, round(avg(hit::INT) FILTER (WHERE has_gt) - avg(hit_full::INT) FILTER (WHERE has_gt), 6) + 0.0 AS r1_gap_full,
 round(avg(hit::INT) FILTER (WHERE has_gt) - avg(hit_pool::INT) FILTER (WHERE has_gt), 6) + 0.0 AS r1_gap_pool, round(100 * avg((top1 <> "full")::INT), 6) AS pct_disagree_full, round(100 * avg((top1 <> pool)::INT), 6) AS pct_disagree_pool FROM st GROUP BY strategy, method""",
        _STRATEGY_ROWS,
    ),
)
def met12_strategy_table(spark, sf_dir):
    return rounded(strategies.strategy_table(demo(spark, sf_dir)))


_REPORT = """SELECT *, n_certified / n_queries AS cert_fraction, round(full_r1 - cos_r1, 6) + 0.0 AS full_gain, round(gated_r1 - cos_r1, 6) + 0.0 AS gated_gain,
 CASE WHEN abs(full_r1 - cos_r1) > 1e-9 THEN round(100 * (gated_r1 - cos_r1) / (full_r1 - cos_r1), 6) + 0.0 WHEN abs(gated_r1 - cos_r1) < 1e-9 THEN 100.0 ELSE 0.0 END AS gain_recovery FROM (
 SELECT method, count(*) AS n_queries, count(*) FILTER (WHERE cert_{0}) AS n_certified, avg(hit_cos::INT) FILTER (WHERE has_gt) AS cos_r1, avg(hit_full::INT) FILTER (WHERE has_gt) AS full_r1,
        avg((CASE WHEN cert_{0} THEN hit_cos ELSE hit_full END)::INT) FILTER (WHERE has_gt) AS gated_r1, count(*) FILTER (WHERE cert_{0} AND c1 <> "full") AS disagreements, count(*) FILTER (WHERE cert_{0} AND c1 <> "full") AS disagreements_certified FROM d GROUP BY method)"""

for _kind in ("global", "local"):
    register(f"met1_4_certificate_report_{_kind}", sql(_REPORT.format(_kind)))(lambda spark, sf_dir, k=_kind: rounded(metrics.certificate_report(demo(spark, sf_dir).decisions, f"cert_{k}")))

_SPINE = "sp(bucket_no, bucket, lo, hi) AS (VALUES (0, '[0, 0.01)', 0.0, 0.01), (1, '[0.01, 0.03)', 0.01, 0.03), (2, '[0.03, 0.05)', 0.03, 0.05), (3, '[0.05, inf)', 0.05, 1e9))"
_BUCKETS = """SELECT *, round(sum(delta_r1) OVER (PARTITION BY method ORDER BY bucket_no), 6) + 0.0 AS cumulative_delta_r1 FROM (
 SELECT m.method, sp.bucket_no, bucket, count(b.qid) AS n, round(coalesce(100 * avg(cert_global::INT), 0), 6) AS pct_certified, round(coalesce(100 * avg(("full" <> c1)::INT), 0), 6) AS pct_changed,
        round(coalesce(sum({f} - {c}), 0) / max(m.n_gt), 6) + 0.0 AS delta_r1, count(*) FILTER (WHERE {f} > {c}) AS gains, count(*) FILTER (WHERE {f} < {c}) AS harms, count(*) FILTER (WHERE {f} > {c}) - count(*) FILTER (WHERE {f} < {c}) AS net
 FROM (SELECT method, count(*) AS n_gt FROM d WHERE has_gt GROUP BY method) m CROSS JOIN sp LEFT JOIN (SELECT d.*, first_gt.gt FROM d LEFT JOIN (SELECT qid, min(cid) AS gt FROM gt GROUP BY qid) first_gt USING (qid) WHERE has_gt) b ON b.method = m.method AND b.margin >= lo AND b.margin < hi
 GROUP BY m.method, sp.bucket_no, bucket)"""


@register("met5_margin_buckets", sql(_BUCKETS.format(f="hit_full::INT", c="hit_cos::INT"), _SPINE))
@register("viz1_bucket_curves", sql(_BUCKETS.format(f="hit_full::INT", c="hit_cos::INT"), _SPINE))
def met5_margin_buckets(spark, sf_dir):
    return rounded(metrics.margin_buckets(demo(spark, sf_dir).decisions, "cert_global"))


@register("met6_localization_first_match", sql(_BUCKETS.format(f="(\"full\" = gt)::INT", c="(c1 = gt)::INT"), _SPINE))
@register("viz6_localization_grid", sql(_BUCKETS.format(f="(\"full\" = gt)::INT", c="(c1 = gt)::INT"), _SPINE))
def met6_localization_first_match(spark, sf_dir):
    r = demo(spark, sf_dir)
    d = r.decisions.join(pairs.first_match(r.q, r.truth), "qid")
    d = d.withColumn("first_cos", F.col("c1") == F.col("gt")).withColumn("first_full", F.col("full") == F.col("gt"))
    return rounded(metrics.margin_buckets(d, "cert_global", "first_cos", "first_full"))


@register("met7_first_match", sql("SELECT q.qid, coalesce(min(cid), -1) AS gt FROM q LEFT JOIN gt USING (qid) GROUP BY q.qid"))
def met7_first_match(spark, sf_dir):
    r = demo(spark, sf_dir)
    return pairs.first_match(r.q, r.truth)


@register("met8_10_rank_drift", sql("SELECT method, qid, round(mrr_cosine, 6) AS mrr_cosine, round(ndcg_cosine, 6) AS ndcg_cosine, round(mrr_rerank, 6) AS mrr_rerank, round(ndcg_rerank, 6) AS ndcg_rerank, round(mrr_drift, 6) AS mrr_drift, round(ndcg_drift, 6) AS ndcg_drift FROM dr", _at_k(_QUALITY, 10)))
def met8_10_rank_drift(spark, sf_dir):
    return rounded(order.rank_drift(demo(spark, sf_dir), 10))


_FIRES = ", ".join(f"round(avg({f}::INT), 6) AS rate_{f}, count(*) FILTER (WHERE {f}) AS n_{f}, count(*) FILTER (WHERE {f} AND {'set' if f.startswith('set') else 'order'}_changed) AS violations_{f}" for f in ("set_global", "set_local", "order_loose_global", "order_loose_local", "order_exact_global", "order_exact_local"))
_WORST = ", ".join(f"coalesce(max(round({m}_drift, 6)) FILTER (WHERE {f}), 0) AS max_{m}_drift_{f}" for f in ("order_exact_global", "order_exact_local", "order_loose_global") for m in ("mrr", "ndcg"))
for _k in (2, 5, 10):
    register(
        f"met11_order_report_k{_k}",
        sql(f"SELECT o.method, count(*) AS n_queries, count(mrr_drift) AS n_eval, {_FIRES}, {_WORST}, round(avg(mrr_drift), 6) AS mean_mrr_drift, round(avg(ndcg_drift), 6) AS mean_ndcg_drift, round(max(mrr_drift), 6) AS max_mrr_drift, round(max(ndcg_drift), 6) AS max_ndcg_drift FROM o JOIN ch USING (method, qid) LEFT JOIN dr USING (method, qid) GROUP BY o.method", _at_k(_ORDER, _k), _at_k(_QUALITY, _k), _at_k(_CHANGED, _k)),
    )(lambda spark, sf_dir, k=_k: rounded(order.order_report(demo(spark, sf_dir), k)))


@register("met13_maxform_vs_scalar", sql("SELECT method, round(100 * avg((a <> b)::INT), 6) AS pct_disagree FROM (SELECT method, CASE WHEN cert_maxform THEN c1 ELSE pool END AS a, CASE WHEN cert_local THEN c1 ELSE pool END AS b FROM d) GROUP BY method"))
def met13_maxform_vs_scalar(spark, sf_dir):
    r = demo(spark, sf_dir)
    one = lambda n, c: strategies.run_strategy(r, n).select("method", "qid", F.col("top1").alias(c))
    both = one("selective_top50_pool_maxform", "a").join(one("selective_top50_pool", "b"), ["method", "qid"])
    return rounded(both.groupBy("method").agg((100 * F.avg(metrics.as_double(F.col("a") != F.col("b")))).alias("pct_disagree")))


_HIST = """SELECT s.method, b.bin::INT AS bin, round(lo + b.bin * (hi - lo) / NN, 6) + 0.0 AS lo, round(lo + (b.bin + 1) * (hi - lo) / NN, 6) + 0.0 AS hi, count(x.qid) AS n
FROM (SELECT method, min(slack_global) AS lo, max(slack_global) AS hi FROM d GROUP BY method) s CROSS JOIN (SELECT unnest(range(NN)) AS bin) b
LEFT JOIN d x ON x.method = s.method AND least(floor((x.slack_global - s.lo) / (s.hi - s.lo) * NN), NN - 1) = b.bin GROUP BY s.method, b.bin, lo, hi"""
for _key, _n in (("met14_histogram_80", 80), ("met14_histogram_48", 48), ("viz2_slack_bars", 48)):
    register(_key, sql(_HIST.replace("NN", str(_n))))(lambda spark, sf_dir, n=_n: rounded(metrics.histogram(demo(spark, sf_dir).certificates, "slack_global", n, ["method"])))

_SUMMARY = "SELECT method, count(*) AS n, round(avg({x}), 6) AS mean, round(median({x}), 6) AS median, round(stddev_pop({x}), 6) AS std, round(min({x}), 6) AS min, round(max({x}), 6) AS max, round(avg(({x} > 0)::INT), 6) AS frac_positive, round(avg(({x} >= 0)::INT), 6) AS frac_nonneg, round(avg(({x} <= 0)::INT), 6) AS frac_nonpositive FROM cx GROUP BY method"


@register("met15_slack_summary", sql(_SUMMARY.format(x="slack_global")))
def met15_slack_summary(spark, sf_dir):
    return rounded(metrics.summary(demo(spark, sf_dir).certificates, "slack_global", ["method"]))


@register("met21_ecdf", sql("SELECT method, qid, round(b_global, 6) AS b_global, round(row_number() OVER (PARTITION BY method ORDER BY b_global, qid) / count(*) OVER (PARTITION BY method), 6) AS share FROM cx"))
@register("viz3_bq_cdf", sql("SELECT method, qid, round(b_global, 6) AS b_global, round(row_number() OVER (PARTITION BY method ORDER BY b_global, qid) / count(*) OVER (PARTITION BY method), 6) AS share FROM cx"))
def met21_ecdf(spark, sf_dir):
    c = demo(spark, sf_dir).certificates.select("method", "qid", "b_global")
    return rounded(metrics.ecdf(c, "b_global", ["method"], ["qid"]))


_RESCALED = "md AS (SELECT method, median(margin) AS mm, median(b_global) AS mb FROM cx GROUP BY method HAVING median(margin) > 0 AND median(b_global) > 0), rs AS (SELECT cx.method, qid, margin / mm - b_global / mb AS rescaled FROM cx JOIN md USING (method))"


@register("met22_rescaled_slack", sql("SELECT method, qid, round(rescaled, 6) + 0.0 AS rescaled FROM rs", _RESCALED))
def met22_rescaled_slack(spark, sf_dir):
    return rounded(metrics.rescaled_slack(demo(spark, sf_dir).certificates.select("method", "qid", "margin", "b_global"), "margin", "b_global", ["method"]).select("method", "qid", "rescaled"))


@register("viz5_collapse_cdf", sql("SELECT method, qid, round(rescaled, 6) + 0.0 AS rescaled, round(row_number() OVER (PARTITION BY method ORDER BY rescaled, qid) / count(*) OVER (PARTITION BY method), 6) AS share FROM rs", _RESCALED))
def viz5_collapse_cdf(spark, sf_dir):
    d = metrics.rescaled_slack(demo(spark, sf_dir).certificates.select("method", "qid", "margin", "b_global"), "margin", "b_global", ["method"])
    return rounded(metrics.ecdf(d.select("method", "qid", "rescaled"), "rescaled", ["method"], ["qid"]))


@register("met23_margin_bands", sql("SELECT round(quantile_cont(s1 - s2, 0.25), 6) AS q25, round(quantile_cont(s1 - s2, 0.5), 6) AS q50, round(quantile_cont(s1 - s2, 0.75), 6) AS q75 FROM top"))
def met23_margin_bands(spark, sf_dir):
    p = demo(spark, sf_dir).top.agg(F.percentile("margin", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"))
    return rounded(p.select(*[F.col("p")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))]))


@register("met24_curve_mean_std", sql(f"SELECT bucket_no, round(avg(pct_changed), 4) AS mean, round(stddev_pop(pct_changed), 4) AS std FROM ({_BUCKETS.format(f='hit_full::INT', c='hit_cos::INT')}) GROUP BY bucket_no", _SPINE))
def met24_curve_mean_std(spark, sf_dir):
    b = rounded(metrics.margin_buckets(demo(spark, sf_dir).decisions, "cert_global"))
    return rounded(b.groupBy("bucket_no").agg(F.avg("pct_changed").alias("mean"), F.stddev_pop("pct_changed").alias("std")), 4)


@register("viz4_margin_scatter", sql("SELECT method, qid, round(margin, 6) AS margin, round(b_global, 6) AS b_global, cert_global AS certified, c1 <> \"full\" AS flipped FROM d"))
def viz4_margin_scatter(spark, sf_dir):
    return rounded(demo(spark, sf_dir).decisions.select("method", "qid", "margin", "b_global", F.col("cert_global").alias("certified"), (F.col("c1") != F.col("full")).alias("flipped")))


@register("snk2_margin_dump", sql("SELECT method, d.qid, round(margin, 6) AS margin, cert_global AS certified, c1 AS base_top1, \"full\" AS refined_top1, coalesce(f.gt, -1) AS gt FROM d LEFT JOIN (SELECT qid, min(cid) AS gt FROM gt GROUP BY qid) f ON f.qid = d.qid"))
def snk2_margin_dump(spark, sf_dir):
    r = demo(spark, sf_dir)
    d = r.decisions.join(pairs.first_match(r.q, r.truth), "qid")
    return rounded(d.select("method", "qid", "margin", F.col("cert_global").alias("certified"), F.col("c1").alias("base_top1"), F.col("full").alias("refined_top1"), "gt"))


@register("snk3_slack_dump", sql("SELECT method, qid, round(margin, 6) AS margin, round(b_global, 6) AS b_q, round(slack_global, 6) AS slack, cert_global AS certified, c1 <> \"full\" AS changed_full, c1 AS cosine_top1, \"full\" AS full_rerank_top1 FROM d"))
def snk3_slack_dump(spark, sf_dir):
    d = demo(spark, sf_dir).decisions
    return rounded(d.select("method", "qid", "margin", F.col("b_global").alias("b_q"), F.col("slack_global").alias("slack"), F.col("cert_global").alias("certified"), (F.col("c1") != F.col("full")).alias("changed_full"), F.col("c1").alias("cosine_top1"), F.col("full").alias("full_rerank_top1")))


@register("snk5_json_report", sql("SELECT 'demo|i2t' AS cell, '20' AS csls_k, method, n_queries, n_certified, round(cos_r1, 6) AS cos_r1, round(full_r1, 6) AS full_r1 FROM (" + _REPORT.format("global") + ")"))
def snk5_json_report(spark, sf_dir):
    """The report is written as JSON text and read back."""
    from ..sinks import nested_report, scratch_path

    path = scratch_path(spark, "json-report")
    nested_report(metrics.certificate_report(demo(spark, sf_dir).decisions, "cert_global"), {"dataset": "embeddings", "csls_k": "20"}, "demo|i2t").write.text(path)
    methods = "array<struct<method: string, n_queries: bigint, n_certified: bigint, cos_r1: double, full_r1: double>>"
    report = spark.read.text(path, wholetext=True).select(F.from_json("value", f"config map<string, string>, cells array<struct<cell: string, methods: {methods}>>").alias("r"))
    cells = report.select(F.col("r.config")["csls_k"].alias("csls_k"), F.explode("r.cells").alias("c"))
    return rounded(cells.select("c.cell", "csls_k", F.inline("c.methods")))


@register(
    "snk6_margin_curve_json",
    sql("SELECT 'demo|i2t' AS cell, method, bucket_no, bucket, n, pct_certified, pct_changed, delta_r1, cumulative_delta_r1 FROM (" + _BUCKETS.format(f="hit_full::INT", c="hit_cos::INT") + ")", _SPINE),
)
def snk6_margin_curve_json(spark, sf_dir):
    """The report is written as JSON text and read back."""
    from ..sinks import margin_curve_report, scratch_path

    path = scratch_path(spark, "margin-curves")
    margin_curve_report(rounded(metrics.margin_buckets(demo(spark, sf_dir).decisions, "cert_global")), "demo|i2t").write.text(path)
    curve = "array<struct<bucket_no: int, bucket: string, n: bigint, pct_certified: double, pct_changed: double, delta_r1: double, cumulative_delta_r1: double>>"
    report = spark.read.text(path, wholetext=True).select(F.from_json("value", f"cells array<struct<cell: string, methods: array<struct<method: string, margin_buckets: {curve}>>>>").alias("r"))
    cells = report.select(F.explode("r.cells").alias("c")).select("c.cell", F.explode("c.methods").alias("m"))
    return cells.select("cell", "m.method", F.inline("m.margin_buckets"))


_CELLS = " || ' | ' || ".join(f"format('{{:.4f}}', {c})" for c in ("selected_fraction", "r1", "r1_gap_full", "r1_gap_pool", "pct_disagree_full", "pct_disagree_pool"))


@register("snk7_markdown_report", f"SELECT '| ' || strategy || ' | ' || method || ' | ' || n_queries || ' | ' || {_CELLS} || ' |' AS line FROM ({ORACLES['met12_strategy_table']})")
def snk7_markdown_report(spark, sf_dir):
    """The rows of a Markdown report, below its head."""
    from ..sinks import markdown

    report = markdown(rounded(strategies.strategy_table(demo(spark, sf_dir))).orderBy("method", "strategy"), "Strategies")
    return literal_rows(spark, [(line,) for line in report.splitlines()[4:]], "line string")


_CURVE = """cut AS (SELECT method, rate, quantile_cont(margin, 1 - rate) AS tau_margin, quantile_cont(slack_local, 1 - rate) AS tau_slack FROM d, rates GROUP BY method, rate),
cv AS (SELECT d.method, rate, tau_margin, tau_slack, margin >= tau_margin AS skip_m, slack_local >= tau_slack AS skip_s, c1 <> "full" AS flip FROM d JOIN cut USING (method))"""


def _curve_rates(rates) -> str:
    cuts = " UNION ALL ".join(f"SELECT method, {r}::DOUBLE AS rate, quantile_cont(margin, {1.0 - r!r}) AS tau_margin, quantile_cont(slack_local, {1.0 - r!r}) AS tau_slack FROM d GROUP BY method" for r in rates)
    return f"cut AS ({cuts}),\n" + _CURVE[_CURVE.index("cv AS") :]


_CURVE_SELECT = """SELECT method, rate, round(max(tau_margin), 6) AS tau_margin, round(max(tau_slack), 6) AS tau_slack, round(avg(skip_m::INT), 6) AS skip_margin, round(avg(skip_s::INT), 6) AS skip_slack, round(avg((skip_m AND flip)::INT), 6) AS disagree_margin, round(avg((skip_s AND flip)::INT), 6) AS disagree_slack,
 round(coalesce(avg(flip::INT) FILTER (WHERE skip_m), 0), 6) AS flips_skipped_margin, round(coalesce(avg(flip::INT) FILTER (WHERE skip_s), 0), 6) AS flips_skipped_slack, count(*) AS n_queries, round(100 * (avg((skip_m AND flip)::INT) - avg((skip_s AND flip)::INT)), 6) + 0.0 AS dis_margin_minus_slack_pp FROM cv GROUP BY method, rate"""

for _key, _rates in (("msk1_4_skip_curve", matched_skip.MARGIN_RATES), ("msk2_3_skip_curve_wide", matched_skip.LAION_RATES)):
    register(_key, sql(_CURVE_SELECT, _curve_rates(_rates)))(lambda spark, sf_dir, r=_rates: rounded(matched_skip.skip_curve(demo(spark, sf_dir).decisions, r)))


register("aux7_cell_evaluation", sql("SELECT 'demo|i2t' AS cell, 50 AS cert_local_topk, 'threshold' AS gate, * FROM (" + _CURVE_SELECT + ")", _curve_rates(matched_skip.MARGIN_RATES)))(
    lambda spark, sf_dir: rounded(matched_skip.evaluate_cell(demo(spark, sf_dir), "demo", "i2t"))
)

# Folds by hash: the same rows are train in both engines.
_HASHED = "round_even(0.8 * n, 0)"
_FOLDS = """
y AS (SELECT qid, (c1 = "full")::INT AS y FROM d WHERE method = 'CSLS'),
f1 AS (SELECT qid, y, row_number() OVER (PARTITION BY y ORDER BY ('0x' || substr(sha256(qid || ':42'), 1, 13))::BIGINT, qid) AS k, count(*) OVER (PARTITION BY y) AS n FROM y),
f2 AS (SELECT qid, y, CASE WHEN k <= least(greatest(round_even(n * 0.8, 0), 1), n - 1) THEN 'train' ELSE 'test' END AS fold FROM f1),
f3 AS (SELECT qid, row_number() OVER (PARTITION BY y ORDER BY ('0x' || substr(sha256(qid || ':43'), 1, 13))::BIGINT, qid) AS k, count(*) OVER (PARTITION BY y) AS n FROM f2 WHERE fold = 'train'),
fo AS (SELECT f2.qid, fold, CASE WHEN f3.qid IS NULL THEN fold WHEN k <= least(greatest(round_even(n * 0.75, 0), 1), n - 1) THEN 'fit' ELSE 'calib' END AS slice FROM f2 LEFT JOIN f3 USING (qid))
"""
_P1 = "pr AS (SELECT qid, rn, exp(s / 0.07) / sum(exp(s / 0.07)) OVER (PARTITION BY qid) AS p FROM r WHERE rn <= 50), p1 AS (SELECT qid, 1 - p AS u, p FROM pr WHERE rn = 1)"


@register("lrn3_random_split", sql("SELECT qid, CASE WHEN row_number() OVER (ORDER BY ('0x' || substr(sha256(qid || ':7'), 1, 13))::BIGINT, qid) <= least(greatest(round_even(count(*) OVER () * 0.5, 0), 1), count(*) OVER () - 1) THEN 'train' ELSE 'eval' END AS fold FROM q"))
def lrn3_random_split(spark, sf_dir):
    return learned.fold_by_rank(demo(spark, sf_dir).q.select("qid"), 0.5, 7)


@register("lrn4_anchored_folds", sql("SELECT qid, fold, slice FROM fo", _FOLDS))
def lrn4_anchored_folds(spark, sf_dir):
    return _folds(demo(spark, sf_dir))


@register(
    "lrn1_features",
    sql(
        """SELECT f.method, f.qid, {cols}, (d.c1 = d."full")::INT AS y FROM f JOIN en USING (qid) JOIN d ON d.method = f.method AND d.qid = f.qid""".format(
            cols=", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in (("margin", "d.margin"), ("cos_rank2", "s2"), ("cos_rank3", "s3"), ("cos_rank4", "s4"), ("cos_rank5", "s5"), ("gap_s2_s3", "s2 - s3"), ("gap_s3_s4", "s3 - s4"), ("gap_s4_s5", "s4 - s5"), ("b_global", "d.b_global"), ("b_local", "d.b_local"), ("psi_c1", "d.psi1"), ("psi_min_topk", "lo"), ("psi_max_topk", "hi"), ("psi_mean_topk", "mean"), ("psi_std_topk", "sd"), ("entropy_softmax_topk", "entropy"), ("rank_argmin_psi_topk", "k"))),
        ),
        "f AS (SELECT method, qid, " + ", ".join(f"max(s) FILTER (WHERE rn = {i}) AS s{i}" for i in range(2, 6)) + ", min(psi) AS lo, max(psi) AS hi, avg(psi) AS mean, stddev_pop(psi) AS sd, (arg_min(rn, psi) - 1)::DOUBLE AS k FROM sl GROUP BY method, qid)",
        _P1,
        "en AS (SELECT qid, sum(-p * ln(greatest(p, 1e-12))) AS entropy FROM pr GROUP BY qid)",
    ),
)
def lrn1_features(spark, sf_dir):
    return rounded(_features(demo(spark, sf_dir)))


@register("lrn2_labels", sql("SELECT method, qid, (c1 = \"full\")::INT AS y FROM d"))
def lrn2_labels(spark, sf_dir):
    return demo(spark, sf_dir).decisions.select("method", "qid", (F.col("c1") == F.col("full")).cast("int").alias("y"))


def _features(r) -> DataFrame:
    return r.share("features", lambda: learned.feature_table(r))


def _folds(r) -> DataFrame:
    return r.share("folds", lambda: learned.anchored_folds(_features(r)))


def _folded(spark, sf_dir) -> DataFrame:
    r = demo(spark, sf_dir)
    first = learned.shortlist_probabilities(r).filter("rank = 1").select("qid", F.col("p").alias("p1"), (1 - F.col("p")).alias("u"))
    return r.share("folded", lambda: r.decisions.join(_folds(r), "qid").join(first, "qid"))


def _quantile_rows(alias: str, value: str, source: str, upper: bool) -> str:
    rows = " UNION ALL ".join(f"SELECT method, {r}::DOUBLE AS rate, quantile_cont({value}, {(1.0 - r if upper else r)!r}) AS cut FROM {source} GROUP BY method" for r in matched_skip.LEARNED_RATES)
    return f"{alias} AS ({rows})"


_GATE_SELECT = """SELECT method, rate, fold, count(*) FILTER (WHERE skip) AS skipped, count(*) AS total, round(avg(skip::INT), 6) AS skip_rate, round(100 * avg((skip AND c1 <> "full")::INT), 6) AS pct_disagree,
 round(100 * (avg((CASE WHEN skip THEN hit_cos ELSE hit_full END)::INT) FILTER (WHERE has_gt) - avg(hit_full::INT) FILTER (WHERE has_gt)), 6) + 0.0 AS r1_gap_pp FROM gm GROUP BY method, rate, fold"""


@register("msk5_train_quantile_gate", sql(_GATE_SELECT, _FOLDS, "df AS (SELECT d.*, fold, slice FROM d JOIN fo USING (qid))", "tr AS (SELECT * FROM df WHERE fold = 'train')", _quantile_rows("cut", "slack_local", "tr", True), "gm AS (SELECT df.*, rate, slack_local >= cut AS skip FROM df JOIN cut USING (method))"))
def msk5_train_quantile_gate(spark, sf_dir):
    own = matched_skip.skip_by_train_quantile(_folded(spark, sf_dir), "slack_local", "fold", matched_skip.LEARNED_RATES, ["method"])
    return rounded(matched_skip.gate_report(own, ["method", "rate", "fold"]))


@register("msk6_split_calibrated_gate", sql(_GATE_SELECT, _FOLDS, _P1, "df AS (SELECT d.*, fold, slice, u FROM d JOIN fo USING (qid) JOIN p1 USING (qid))", "tr AS (SELECT * FROM df WHERE slice = 'calib')", _quantile_rows("cut", "u", "tr", False), "gm AS (SELECT df.*, rate, u <= cut AS skip FROM df JOIN cut USING (method))"))
def msk6_split_calibrated_gate(spark, sf_dir):
    own = _folded(spark, sf_dir)
    cuts = matched_skip.thresholds(own.filter("slice = 'calib'"), "u", matched_skip.LEARNED_RATES, ["method"], "cut", upper=False)
    masks = own.join(F.broadcast(cuts), "method").withColumn("skip", F.col("u") <= F.col("cut"))
    return rounded(matched_skip.gate_report(masks, ["method", "rate", "fold"]))


@register("msk7_aps_set_size", sql("SELECT qid, least(count(*) FILTER (WHERE mass < 1 - 0.1) + 1, 50)::BIGINT AS size FROM (SELECT qid, sum(p) OVER (PARTITION BY qid ORDER BY p DESC, rn ROWS UNBOUNDED PRECEDING) AS mass FROM pr) GROUP BY qid", _P1))
def msk7_aps_set_size(spark, sf_dir):
    return matched_skip.aps_set_size(learned.shortlist_probabilities(demo(spark, sf_dir)), 0.1, 50)


@register(
    "msk8_alpha_grid",
    sql(
        "SELECT rate, round(arg_min(alpha, (err, step)), 6) AS alpha, round(min(err), 6) AS error FROM (SELECT rate, step, alpha, abs(share - rate) AS err FROM sh, rates) GROUP BY rate",
        _P1, _RATES, "gr AS (SELECT unnest(range(200)) AS step)", "al AS (SELECT step, 1e-4 + step * ((0.99 - 1e-4) / 199) AS alpha FROM gr)", "sh AS (SELECT step, alpha, avg((p >= 1 - alpha)::INT) AS share FROM p1, al GROUP BY step, alpha)",
    ),
)
def msk8_alpha_grid(spark, sf_dir):
    first = learned.shortlist_probabilities(demo(spark, sf_dir)).filter("rank = 1").select(F.col("p").alias("p1"))
    return rounded(matched_skip.calibrated_alpha(first, matched_skip.LEARNED_RATES))


_TWO_GATES = "ga AS (SELECT method, qid, c1, \"full\", rate, row_number() OVER (PARTITION BY method, rate ORDER BY slack_local DESC, qid) <= round_even(rate * count(*) OVER (PARTITION BY method, rate), 0) AS skip, row_number() OVER (PARTITION BY method, rate ORDER BY p DESC, qid) <= round_even(rate * count(*) OVER (PARTITION BY method, rate), 0) AS skip_b FROM d JOIN p1 USING (qid), rates)"


@register("msk9_gate_pairs", sql("SELECT method, rate, round(100 * avg((skip <> skip_b)::INT), 6) AS decision_pct, round(100 * avg(((CASE WHEN skip THEN c1 ELSE \"full\" END) <> (CASE WHEN skip_b THEN c1 ELSE \"full\" END))::INT), 6) AS top1_pct FROM ga GROUP BY method, rate", _P1, _RATES, _TWO_GATES))
def msk9_gate_pairs(spark, sf_dir):
    r = demo(spark, sf_dir)
    first = learned.shortlist_probabilities(r).filter("rank = 1").select("qid", F.col("p").alias("p1"))
    own = r.share("gate-scores", lambda: r.decisions.join(first, "qid").select("method", "qid", "c1", "full", "slack_local", "p1"))
    gate = lambda s: matched_skip.skip_exactly(own, s, "qid", matched_skip.LEARNED_RATES, ["method"])
    return rounded(matched_skip.gate_pair_disagreement(gate("slack_local"), gate("p1"), ["method", "rate"]))


@register("msk10_exact_gate_report", sql(_GATE_SELECT.replace("method, rate, fold", "method, rate"), _RATES, "gm AS (SELECT d.*, rate, row_number() OVER (PARTITION BY method, rate ORDER BY slack_local DESC, qid) <= round_even(rate * count(*) OVER (PARTITION BY method, rate), 0) AS skip FROM d, rates)"))
@register("aux4_skip_metrics", sql(_GATE_SELECT.replace("method, rate, fold", "method, rate"), _RATES, "gm AS (SELECT d.*, rate, row_number() OVER (PARTITION BY method, rate ORDER BY slack_local DESC, qid) <= round_even(rate * count(*) OVER (PARTITION BY method, rate), 0) AS skip FROM d, rates)"))
def msk10_exact_gate_report(spark, sf_dir):
    masks = matched_skip.skip_exactly(demo(spark, sf_dir).decisions, "slack_local", "qid", matched_skip.LEARNED_RATES, ["method"])
    return rounded(matched_skip.gate_report(masks, ["method", "rate"]))


@register("lrn5_logistic_gate")
def lrn5_logistic_gate(spark, sf_dir):
    d = demo(spark, sf_dir).decisions.filter("method = 'CSLS'").select("qid", "margin", "slack_local", (F.col("c1") == F.col("full")).cast("int").alias("y"))
    folds = learned.fold_by_rank(d, 0.5, 7).persist()
    return rounded(learned.logistic_gate(folds.filter("fold = 'train'"), folds.filter("fold = 'eval'")).select("qid", "y", "p"))


@register("lrn6_tree_gate")
def lrn6_tree_gate(spark, sf_dir):
    r = demo(spark, sf_dir)
    d = _features(r).filter("method = 'CSLS'").join(_folds(r), "qid").persist()
    return rounded(learned.tree_gate(d.filter("slice = 'fit'"), d.filter("fold = 'test'")).select("qid", "y", "p"))


@register("lrn7_gate_evaluation")
def lrn7_gate_evaluation(spark, sf_dir):
    own = _folded(spark, sf_dir)
    f = _features(demo(spark, sf_dir)).filter("method = 'CSLS'")
    d = f.join(own.filter("method = 'CSLS'").select("qid", "fold", "slice", "c1", "full", "hit_cos", "hit_full", "has_gt", "slack_local", "p1"), "qid").persist()
    d = learned.tree_gate(d.filter("slice = 'fit'"), d.filter("fold = 'test'")).persist()
    rows = None
    for name, score in (("slack_local", "slack_local"), ("trees", "p"), ("softmax_pc1", "p1")):
        one = matched_skip.gate_report(matched_skip.skip_exactly(d, score, "qid", matched_skip.LEARNED_RATES, ["method"]), ["method", "rate"]).withColumn("gate", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rounded(rows)


@register("lrn8_recompute_difference", sql("SELECT 0::BIGINT AS unmatched, 0.0::DOUBLE AS max_diff_b_local, 0.0::DOUBLE AS max_diff_slack_local"))
def lrn8_recompute_difference(spark, sf_dir):
    """Stored certificates against the same from a pass of its own, by the plan for two large sides."""
    r = demo(spark, sf_dir)
    again = retrieval.Retrieval(r.q, r.g, r.truth, r.params, blocks.Blocks(queries=max(64, -(-r.n_queries // 3)), broadcast_bytes=0))
    near = again.shortlist.filter(F.col("rank") <= r.params.local_k).join(again.psi, "cid")
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    own = near.groupBy("method", "qid").agg((at(1, "psi") - F.min("psi")).alias("b_local"), (at(1, "s") - at(2, "s") - at(1, "psi") + F.min("psi")).alias("slack_local"))
    return rounded(learned.stored_difference(r.certificates, own, ("method", "qid"), ("b_local", "slack_local")))


@register("aux1_full_top1_dispatch", sql("SELECT method, count(DISTINCT \"full\") AS n_items, count(*) FILTER (WHERE \"full\" <> c1) AS n_changed FROM d GROUP BY method"))
def aux1_full_top1_dispatch(spark, sf_dir):
    return demo(spark, sf_dir).decisions.groupBy("method").agg(F.count_distinct("full").alias("n_items"), F.count_if(F.col("full") != F.col("c1")).alias("n_changed"))


@register("aux2_gated_where", sql("SELECT method, qid, CASE WHEN cert_naive THEN c1 ELSE \"full\" END AS top1 FROM d"))
def aux2_gated_where(spark, sf_dir):
    return demo(spark, sf_dir).decisions.select("method", "qid", F.when(F.col("cert_naive"), F.col("c1")).otherwise(F.col("full")).alias("top1"))


@register("aux3_pct_disagree", sql("SELECT method, round(100 * avg((cert_naive AND c1 <> \"full\")::INT), 6) AS pct FROM d GROUP BY method"))
def aux3_pct_disagree(spark, sf_dir):
    return rounded(demo(spark, sf_dir).decisions.groupBy("method").agg((100 * F.avg(metrics.as_double(F.col("cert_naive") & (F.col("c1") != F.col("full"))))).alias("pct")))


@register("aux5_r1_on_gt", sql("SELECT method, round(avg(hit_full::INT) FILTER (WHERE has_gt), 6) AS r1 FROM d GROUP BY method"))
def aux5_r1_on_gt(spark, sf_dir):
    return rounded(demo(spark, sf_dir).decisions.groupBy("method").agg(metrics.rate_on("hit_full", default=None).alias("r1")))


@register("set2_first_of_query", sql("SELECT label AS qid, min(vec_id) AS idx FROM e GROUP BY label"))
def set2_first_of_query(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("qid"), F.col("vec_id").alias("idx"))
    return pairs.first_of_each(e, "qid", "idx")


@register(
    "met25_26_bank_verification",
    f"""WITH {_BANK} SELECT 'dimension' AS rule, count(*) FILTER (WHERE len(v) <> 64) AS broken FROM b UNION ALL SELECT 'id_format', count(*) FILTER (WHERE NOT regexp_matches(id, '^emb_[0-9]+(_cap[0-9]+)?$')) FROM b
 UNION ALL SELECT 'repeated_ids', count(*) - count(DISTINCT id) FROM b UNION ALL SELECT 'unit_norm', count(*) FILTER (WHERE idx < 1000 AND abs(sqrt(list_dot_product(v, v)) - 1) > 0.02) FROM b""",
)
def met25_26_bank_verification(spark, sf_dir):
    from ..operators.corpus import verify_bank

    return verify_bank(_demo_bank(spark, sf_dir), 64, r"^emb_[0-9]+(_cap[0-9]+)?$", first_rows=1000)


@register("met29_gated_against_full")
def met29_gated_against_full(spark, sf_dir):
    """Seconds of reranking all queries and of reranking those that a certificate leaves, over all methods: the second
    pass over the gallery, and the cosine pool. Penalties, shortlist and certificates are there in either case."""
    from ..operators.timing import mean_seconds

    r = demo(spark, sf_dir)
    r.scored_gallery.count(), r.scored_shortlist.count(), r.certificates.count()
    seconds = lambda kind, scope: mean_seconds(lambda: r.gated(kind, scope=scope), warm_ups=1, repeats=2)
    rows = []
    for scope, kinds in (("full", ("global", "local")), ("pool", ("local", "maxform"))):
        whole = seconds("never", scope)
        for kind in kinds:
            skipped = r.gated(kind, scope=scope).agg(F.avg(metrics.as_double("skipped"))).first()[0]
            part = seconds(kind, scope)
            rows.append((scope, kind, skipped, whole, part, whole / part))
    return literal_rows(spark, rows, "scope string, certificate string, skip_rate double, all_seconds double, gated_seconds double, speedup double")


@register("ext_stream_scoring", sql("SELECT qid, CASE WHEN cert_global THEN c1 ELSE \"full\" END AS top1, cert_global AS certified FROM d WHERE method = 'CSLS'"))
def ext_stream_scoring(spark, sf_dir):
    """Queries arrive as a file stream; gallery and penalties are frozen."""
    from ..sinks import scratch_path
    from ..streaming import score_stream

    r = demo(spark, sf_dir)
    top = scratch_path(spark, "stream")
    r.q.write.parquet(f"{top}/in")
    stream = spark.readStream.schema(r.q.schema).parquet(f"{top}/in")
    score_stream(stream, r.g.join(r.psi_wide, "cid"), f"{top}/out", f"{top}/state").awaitTermination()
    return spark.read.parquet(f"{top}/out").select("qid", "top1", "certified")


@register("src15_report_scan", sql("SELECT 'demo|i2t' AS cell, method, count(*) FILTER (WHERE cert_global) AS n_certified, count(*) AS n_queries FROM d GROUP BY method"))
def src15_report_scan(spark, sf_dir):
    """A report is written and read back."""
    from ..sinks import nested_report, scratch_path
    from ..sources.corpus import report_cells

    path = scratch_path(spark, "report")
    nested_report(metrics.certificate_report(demo(spark, sf_dir).decisions, "cert_global"), {"dataset": "embeddings"}, "demo|i2t").write.text(path)
    return report_cells(spark, path).select("cell", "method", "n_certified", "n_queries")


@register("snk1_bank_round_trip", f"WITH {_BANK} SELECT split, modality, count(*) AS n, round(sum(v[1]), 4) AS v1 FROM b GROUP BY split, modality")
def snk1_bank_round_trip(spark, sf_dir):
    """The bank is written by split and modality and scanned again."""
    from ..sinks import scratch_path, write_bank

    path = scratch_path(spark, "bank")
    write_bank(_demo_bank(spark, sf_dir).drop("label"), path)
    return rounded(bank.scan(spark, path).groupBy("split", "modality").agg(F.count("*").alias("n"), F.sum(F.col("v")[0]).alias("v1")), 4)


@register("flagship_certified_rerank", sql(_GATED.format("global") + " WHERE method = 'CSLS'"))
def flagship_certified_rerank(spark, sf_dir):
    """CSLS with the global certificate: certified queries keep their cosine top-1, the others are reranked."""
    return demo(spark, sf_dir).gated("global", ("CSLS",))
