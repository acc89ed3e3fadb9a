"""Gates compared at matched skip rates: thresholds by quantile, exact-k masks, conformal sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.literal import literal_rows
from ..functions.ranks import quantiles, with_rank
from .metrics import as_double

# The rates at which gates are compared.
LAION_RATES = (0.15, 0.25, 0.35, 0.45, 0.55, 0.60, 0.62, 0.65, 0.69, 0.71)
MARGIN_RATES = (0.15, 0.25, 0.35, 0.45)
LEARNED_RATES = (0.15, 0.25, 0.35, 0.45, 0.55)


def rate_table(spark: SparkSession, rates: Sequence[float]) -> DataFrame:
    """Rates strictly between 0 and 1; others are left out."""
    return literal_rows(spark, [(float(r),) for r in rates if 0 < r < 1], "rate double")


def thresholds(df: DataFrame, score: str, rates: Sequence[float], keys: Sequence[str], name: str, upper: bool = True) -> DataFrame:
    """``keys, rate, name``: the quantile at 1 - rate of a score (at rate for ``upper=False``)."""
    rates = [float(r) for r in rates if 0 < r < 1]
    pairs = F.arrays_zip(F.array(*map(F.lit, rates)).alias("rate"), F.col("q").alias("t"))
    out = quantiles(df, score, [1.0 - r if upper else r for r in rates], keys).select(*keys, F.explode(pairs).alias("x"))
    return out.select(*keys, F.col("x.rate").alias("rate"), F.col("x.t").alias(name))


def skip_curve(decisions: DataFrame, rates: Sequence[float] = LAION_RATES, strict: bool = False) -> DataFrame:
    """Per method and rate: thresholds on margin and on local slack, achieved skip rates, disagreement with full
    reranking, its difference in points, and the flips among skipped queries."""
    cuts = thresholds(decisions, "margin", rates, ["method"], "tau_margin").join(thresholds(decisions, "slack_local", rates, ["method"], "tau_slack"), ["method", "rate"])
    d = decisions.join(F.broadcast(cuts), "method")
    slack = F.col("slack_local") > F.col("tau_slack") if strict else F.col("slack_local") >= F.col("tau_slack")
    d = d.withColumn("skip_margin", F.col("margin") >= F.col("tau_margin")).withColumn("skip_slack", slack).withColumn("flip", F.col("c1") != F.col("full"))
    rate = lambda c: F.avg(as_double(c))
    among = lambda c: F.coalesce(F.avg(F.when(F.col(c), as_double("flip"))), F.lit(0.0))
    out = d.groupBy("method", "rate").agg(
        F.first("tau_margin").alias("tau_margin"), F.first("tau_slack").alias("tau_slack"), rate("skip_margin").alias("skip_margin"), rate("skip_slack").alias("skip_slack"),
        rate(F.col("skip_margin") & F.col("flip")).alias("disagree_margin"), rate(F.col("skip_slack") & F.col("flip")).alias("disagree_slack"),
        among("skip_margin").alias("flips_skipped_margin"), among("skip_slack").alias("flips_skipped_slack"), F.count("*").alias("n_queries"),
    )
    return out.withColumn("dis_margin_minus_slack_pp", 100 * (F.col("disagree_margin") - F.col("disagree_slack")))


def skip_exactly(df: DataFrame, score: str, order: str, rates: Sequence[float], keys: Sequence[str], largest: bool = True) -> DataFrame:
    """``df`` with ``rate`` and ``skip``: exactly round(rate * n) rows per key (halves to even), by score, ties by
    ``order``."""
    ranked = with_rank(df, keys, score, [order], descending=largest)
    out = ranked.crossJoin(F.broadcast(rate_table(df.sparkSession, rates)))
    return out.withColumn("skip", F.col("__rank") <= F.bround(F.col("rate") * F.col("__n"), 0)).drop("__rank", "__n")


def skip_by_train_quantile(df: DataFrame, score: str, fold: str, rates: Sequence[float], keys: Sequence[str], largest: bool = True) -> DataFrame:
    """``df`` with ``rate`` and ``skip`` by the threshold that the train fold has; it holds for all folds."""
    cuts = thresholds(df.filter(F.col(fold) == "train"), score, rates, keys, "__cut", upper=largest)
    skip = F.col(score) >= F.col("__cut") if largest else F.col(score) <= F.col("__cut")
    return df.join(F.broadcast(cuts), list(keys)).withColumn("skip", skip).drop("__cut")


def aps_set_size(probabilities: DataFrame, alpha: float, k: int) -> DataFrame:
    """``qid, size``: the smallest number of the largest probabilities with mass of at least 1 - alpha, at most k.
    ``probabilities`` has qid, rank and p."""
    w = Window.partitionBy("qid").orderBy(F.desc("p"), "rank").rowsBetween(Window.unboundedPreceding, 0)
    running = probabilities.withColumn("mass", F.sum("p").over(w))
    return running.groupBy("qid").agg(F.least(F.count_if(F.col("mass") < 1.0 - alpha) + 1, F.lit(k)).alias("size"))


def calibrated_alpha(first_probability: DataFrame, rates: Sequence[float], steps: int = 200, low: float = 1e-4, high: float = 0.99) -> DataFrame:
    """``rate, alpha, error``: of evenly spaced alphas the first whose share of one-element sets is nearest to the rate.

    A set has one element where the largest probability is at least 1 - alpha. ``first_probability`` has p1.
    """
    spark = first_probability.sparkSession
    grid = spark.range(steps).select(F.col("id").alias("step"), (low + F.col("id") * ((high - low) / (steps - 1))).alias("alpha"))
    share = first_probability.crossJoin(F.broadcast(grid)).groupBy("step", "alpha").agg(F.avg(as_double(F.col("p1") >= 1.0 - F.col("alpha"))).alias("share"))
    d = share.crossJoin(F.broadcast(rate_table(spark, rates))).withColumn("error", F.abs(F.col("share") - F.col("rate")))
    return d.groupBy("rate").agg(F.min_by(F.struct("alpha", "error"), F.struct("error", "step")).alias("b")).select("rate", "b.alpha", "b.error")


def gate_report(masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: skipped, total, rate, percent of gated top-1 that differ from full, and the R@1 gap in points."""
    flip = F.col("skip") & (F.col("c1") != F.col("full"))
    hit = F.when(F.col("skip"), as_double("hit_cos")).otherwise(as_double("hit_full"))
    gap = F.avg(F.when(F.col("has_gt"), hit)) - F.avg(F.when(F.col("has_gt"), as_double("hit_full")))
    return masks.groupBy(*keys).agg(F.count_if("skip").alias("skipped"), F.count("*").alias("total"), F.avg(as_double("skip")).alias("skip_rate"), (100 * F.avg(as_double(flip))).alias("pct_disagree"), (100 * gap).alias("r1_gap_pp"))


def gate_pair_disagreement(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: percent of rows where two gates decide differently, and where their gated top-1 differ."""
    d = a.select(*keys, "qid", "skip", "c1", "full").join(b.select(*keys, "qid", F.col("skip").alias("skip_b")), [*keys, "qid"])
    top: Column = F.when(F.col("skip"), F.col("c1")).otherwise(F.col("full"))
    other: Column = F.when(F.col("skip_b"), F.col("c1")).otherwise(F.col("full"))
    return d.groupBy(*keys).agg((100 * F.avg(as_double(F.col("skip") != F.col("skip_b")))).alias("decision_pct"), (100 * F.avg(as_double(top != other))).alias("top1_pct"))


def evaluate_cell(retrieval, backbone: str, direction: str, rates: Sequence[float] = MARGIN_RATES, learned_share: float | None = None, seed: int = 7) -> DataFrame:
    """The skip curves of one cell, ``cell, cert_local_topk, gate`` before the columns of ``skip_curve``: both
    thresholds over all queries (gate ``threshold``), and, if ``learned_share`` of the queries is given to train on, the
    same over the others with the score of a logistic gate in place of the slack (gate ``logistic``)."""
    from . import learned

    k = min(retrieval.params.local_k, retrieval.n_gallery)
    curves = skip_curve(retrieval.decisions, rates).withColumn("gate", F.lit("threshold"))
    if learned_share is not None:
        own = retrieval.decisions.select("method", "qid", "margin", "slack_local", "c1", "full", (F.col("c1") == F.col("full")).cast("int").alias("y"))
        folds = learned.fold_by_rank(own.select("qid").distinct(), learned_share, seed)
        own = learned.stored(own.join(folds, "qid"), "cell-folds")
        for (method,) in own.select("method").distinct().collect():
            one = own.filter(F.col("method") == method)
            scored = learned.logistic_gate(one.filter("fold = 'train'"), one.filter("fold = 'eval'"))
            curves = curves.unionByName(skip_curve(scored.withColumn("slack_local", F.col("p")), rates).withColumn("gate", F.lit("logistic")))
    return curves.select(F.lit(f"{backbone}|{direction}").alias("cell"), F.lit(k).alias("cert_local_topk"), "gate", *[c for c in curves.columns if c != "gate"])
