"""Metrics: recall, gains, buckets, histograms, distributions, rank quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.literal import literal_rows
from ..functions.ranks import bucket_of, quantiles, with_rank
from .pairs import Truth, truth_of

# Margin buckets (lower bound, upper bound or None for open, label).
MARGIN_BUCKETS = ((0.0, 0.01, "[0, 0.01)"), (0.01, 0.03, "[0.01, 0.03)"), (0.03, 0.05, "[0.03, 0.05)"), (0.05, None, "[0.05, inf)"))


def as_double(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def rate_on(flag: str, mask: str = "has_gt", default: float | None = 0.0) -> Column:
    """Share of ``flag`` among rows with ``mask``."""
    out = F.avg(F.when(F.col(mask), as_double(flag)))
    return out if default is None else F.coalesce(out, F.lit(default))


def gain_recovery(gated: Column, full: Column, eps: float = 1e-9) -> Column:
    """Percent of the full gain that the gated run keeps; without a full gain 100 if there is no gated one, else 0."""
    return F.when(F.abs(full) > eps, 100 * gated / full).otherwise(F.when(F.abs(gated) < eps, 100.0).otherwise(0.0))


def certificate_report(decisions: DataFrame, certified: str) -> DataFrame:
    """Per method: certified share, R@1 of cosine, full and gated runs, gains, recovery and disagreements."""
    gated = F.when(F.col(certified), F.col("c1")).otherwise(F.col("full"))
    d = decisions.withColumn("gated", gated).withColumn("hit_gated", F.when(F.col(certified), F.col("hit_cos")).otherwise(F.col("hit_full")))
    per = d.groupBy("method").agg(
        F.count("*").alias("n_queries"), F.count_if(certified).alias("n_certified"), rate_on("hit_cos").alias("cos_r1"), rate_on("hit_full").alias("full_r1"), rate_on("hit_gated").alias("gated_r1"),
        F.count_if(F.col("full") != F.col("gated")).alias("disagreements"), F.count_if((F.col("full") != F.col("gated")) & F.col(certified)).alias("disagreements_certified"),
    )
    full, kept = F.col("full_r1") - F.col("cos_r1"), F.col("gated_r1") - F.col("cos_r1")
    return per.withColumn("cert_fraction", F.col("n_certified") / F.col("n_queries")).withColumn("full_gain", full).withColumn("gated_gain", kept).withColumn("gain_recovery", gain_recovery(kept, full))


def bucket_spine(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, [(i, label, lo, hi) for i, (lo, hi, label) in enumerate(MARGIN_BUCKETS)], "bucket_no int, bucket string, lo double, hi double")


def margin_bucket(margin: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, (lo, hi, _) in enumerate(MARGIN_BUCKETS):
        inside = margin >= lo if hi is None else (margin >= lo) & (margin < hi)
        out = F.when(inside, i).otherwise(out)
    return out


def margin_buckets(decisions: DataFrame, certified: str, hit_cos: str = "hit_cos", hit_full: str = "hit_full") -> DataFrame:
    """Per method and margin bucket, over queries with a match: number, percent certified and changed, the part of
    the R@1 change that falls into the bucket, and its running sum. Empty buckets have a row."""
    own = decisions.filter("has_gt").withColumn("bucket_no", margin_bucket(F.col("margin")))
    total = own.groupBy("method").agg(F.count("*").alias("n_gt"))
    change = as_double(hit_full) - as_double(hit_cos)
    part = own.groupBy("method", "bucket_no").agg(
        F.count("*").alias("n"), F.avg(as_double(certified)).alias("c"), F.avg(as_double(F.col("full") != F.col("c1"))).alias("r"), F.sum(change).alias("d"), F.count_if(change > 0).alias("gains"), F.count_if(change < 0).alias("harms")
    )
    spine = total.crossJoin(F.broadcast(bucket_spine(decisions.sparkSession)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    whole = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    rows = spine.join(part, ["method", "bucket_no"], "left").select(
        "method", "bucket_no", "bucket", whole("n").alias("n"), (100 * zero("c")).alias("pct_certified"), (100 * zero("r")).alias("pct_changed"), (zero("d") / F.col("n_gt")).alias("delta_r1"), whole("gains").alias("gains"), whole("harms").alias("harms"), (whole("gains") - whole("harms")).alias("net")
    )
    return rows.withColumn("cumulative_delta_r1", F.sum("delta_r1").over(Window.partitionBy("method").orderBy("bucket_no").rowsBetween(Window.unboundedPreceding, 0)))


def histogram(df: DataFrame, value: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins from the smallest to the largest value, the last one closed; ``keys, bin, lo, hi, n``.

    A constant input is spread over a width of one around the value.
    """
    own = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    span = own.groupBy(*keys).agg(F.min(value).alias("a"), F.max(value).alias("b"))
    same = F.col("a") == F.col("b")
    span = span.withColumn("from_", F.when(same, F.col("a") - 0.5).otherwise(F.col("a"))).withColumn("to_", F.when(same, F.col("b") + 0.5).otherwise(F.col("b"))).drop("a", "b")
    joined = own.join(F.broadcast(span), list(keys)) if keys else own.crossJoin(F.broadcast(span))
    place = F.least(F.floor((F.col(value) - F.col("from_")) / (F.col("to_") - F.col("from_")) * bins), F.lit(bins - 1)).cast("int")
    counts = joined.withColumn("bin", place).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    spine = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("to_") - F.col("from_")) / bins
    return spine.join(counts, [*keys, "bin"], "left").select(*keys, "bin", (F.col("from_") + F.col("bin") * width).alias("lo"), (F.col("from_") + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def _joined(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b, list(keys)) if keys else a.crossJoin(b)


def summary(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, mean, median, population deviation, extremes and shares by sign."""
    x = F.col(value)
    own = df.filter(x.isNotNull() & ~F.isnan(value))
    found = own.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.avg(as_double(x > 0)).alias("frac_positive"), F.avg(as_double(x >= 0)).alias("frac_nonneg"), F.avg(as_double(x <= 0)).alias("frac_nonpositive"),
    )
    middle = quantiles(own, value, [0.5], keys).select(*keys, F.col("q")[0].alias("median"))
    return _joined(found, middle, keys).select(*keys, "n", "mean", "median", "std", "min", "max", "frac_positive", "frac_nonneg", "frac_nonpositive")


def describe(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, mean, population deviation and the quantiles 5, 25, 50, 75, 95 and 99."""
    x = F.col(value)
    qs = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    own = df.filter(x.isNotNull())
    out = _joined(own.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")), quantiles(own, value, qs, keys), keys)
    return out.select(*keys, "n", "mean", "std", *[F.col("q")[i].alias(f"p{round(100 * v)}") for i, v in enumerate(qs)])


def ks_statistic(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and the p-value of its asymptotic series.

    Values are counted first, so equal values meet before the running sums. These are taken in two steps: within
    ranges of values, and over the ranges' totals, so no task sees all values.
    """
    x = F.col(value).cast("double").alias("x")
    both = a.select(x, F.lit(1).alias("i"), F.lit(0).alias("j")).unionAll(b.select(x, F.lit(0).alias("i"), F.lit(1).alias("j"))).filter("x is not null and not isnan(x)")
    counted = both.groupBy("x").agg(F.sum("i").alias("i"), F.sum("j").alias("j"))
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counted.withColumn("part", bucket_of(counted, F.col("x"), parts))
    own = Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    running = dealt.withColumn("ri", F.sum("i").over(own)).withColumn("rj", F.sum("j").over(own))
    totals = dealt.groupBy("part").agg(F.sum("i").alias("ti"), F.sum("j").alias("tj"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.withColumn("bi", F.coalesce(F.sum("ti").over(before), F.lit(0))).withColumn("bj", F.coalesce(F.sum("tj").over(before), F.lit(0)))
    sizes = totals.agg(F.sum("ti").cast("double").alias("n"), F.sum("tj").cast("double").alias("m"))
    gap = F.abs((F.col("ri") + F.col("bi")) / F.col("n") - (F.col("rj") + F.col("bj")) / F.col("m"))
    out = running.join(F.broadcast(shift.select("part", "bi", "bj")), "part").crossJoin(F.broadcast(sizes)).agg(F.max(gap).alias("ks"), F.max("n").alias("n"), F.max("m").alias("m"))
    lam = F.col("ks") * F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m")))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam))
    return out.select(F.col("n").cast("long").alias("n"), F.col("m").cast("long").alias("m"), "ks", F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.least(series, F.lit(1.0)), F.lit(0.0))).alias("p_value"))


def ecdf(df: DataFrame, value: str, keys: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """Every row with the share of rows up to it, in order of value (then of ``ties``), within the keys."""
    return with_rank(df, keys, value, ties).withColumn("share", F.col("__rank") / F.col("__n")).drop("__rank", "__n")


def rescaled_slack(df: DataFrame, margin: str, b: str, keys: Sequence[str]) -> DataFrame:
    """margin / median(margin) - b / median(b) within the keys; groups with a median that is not positive are left out."""
    middle = lambda c, name: quantiles(df, c, [0.5], keys).select(*keys, F.col("q")[0].alias(name))
    medians = middle(margin, "mm").join(middle(b, "mb"), list(keys)).filter("mm > 0 and mb > 0")
    return df.join(F.broadcast(medians), list(keys)).withColumn("rescaled", F.col(margin) / F.col("mm") - F.col(b) / F.col("mb")).drop("mm", "mb")


def rank_quality(ranked: DataFrame, matches: DataFrame | Truth, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """MRR@k and nDCG@k (binary) of ranked lists ``keys, qid, rank, cid`` for queries with a match."""
    truth = truth_of(matches)
    hit = truth.with_hit(ranked.filter(F.col("rank") <= k), "cid", "hit")
    per = hit.groupBy(*keys, "qid").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.sum(F.when(F.col("hit"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    ideal = truth.sizes().select("qid", F.least("n", F.lit(k)).alias("n"))
    ideal = ideal.select("qid", F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1)).alias("idcg"))
    return per.join(ideal, "qid").select(*keys, "qid", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("dcg") / F.col("idcg")).alias("ndcg"))
