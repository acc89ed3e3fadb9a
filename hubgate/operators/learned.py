"""Learned gates: features, splits, balanced logistic regression, boosted trees, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import with_rank
from ..functions.text import hash_uniform
from ..functions.vectors import entropy_term, softmax_over
from ..sinks import stored

# The feature columns in their order.
FEATURES = (
    "margin", "cos_rank2", "cos_rank3", "cos_rank4", "cos_rank5", "gap_s2_s3", "gap_s3_s4", "gap_s4_s5", "b_global", "b_local",
    "psi_c1", "psi_min_topk", "psi_max_topk", "psi_mean_topk", "psi_std_topk", "entropy_softmax_topk", "rank_argmin_psi_topk",
)


def shortlist_probabilities(retrieval) -> DataFrame:
    """``qid, rank, cid, p``: softmax of the shortlist's cosines."""
    own = retrieval.shortlist.filter(F.col("rank") <= retrieval.params.local_k)
    return own.withColumn("p", softmax_over(F.col("s"), retrieval.params.softmax_temperature, "qid")).drop("s")


def feature_table(retrieval) -> DataFrame:
    """``method, qid``, the features and the label ``y`` (1 where reranking keeps the cosine top-1). Ranks that a short
    gallery lacks repeat the last one there is."""
    own = retrieval.scored_shortlist.filter(F.col("rank") <= retrieval.params.local_k)
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("s")))
    per = own.groupBy("method", "qid").agg(
        *[at(r).alias(f"s{r}") for r in range(2, 6)], F.min("psi").alias("psi_min_topk"), F.max("psi").alias("psi_max_topk"), F.avg("psi").alias("psi_mean_topk"), F.stddev_pop("psi").alias("psi_std_topk"),
        (F.min_by("rank", F.struct("psi", "rank")) - 1).cast("double").alias("rank_argmin_psi_topk"),
    )
    entropy = shortlist_probabilities(retrieval).groupBy("qid").agg(F.sum(entropy_term(F.col("p"))).alias("entropy_softmax_topk"))
    last = F.lit(0.0)
    for r in range(2, 6):
        last = F.coalesce(F.col(f"s{r}"), last)
        per = per.withColumn(f"cos_rank{r}", last)
    for r in range(2, 5):
        per = per.withColumn(f"gap_s{r}_s{r + 1}", F.col(f"cos_rank{r}") - F.col(f"cos_rank{r + 1}"))
    d = per.join(entropy, "qid").join(retrieval.decisions.select("method", "qid", "margin", "b_global", "b_local", F.col("psi1").alias("psi_c1"), "c1", "full"), ["method", "qid"])
    return d.select("method", "qid", *FEATURES, (F.col("c1") == F.col("full")).cast("int").alias("y"))


def fold_by_rank(df: DataFrame, fraction: float, seed: int, keys: tuple[str, ...] = (), id_col: str = "qid", names: tuple[str, str] = ("train", "eval")) -> DataFrame:
    """``df`` with ``fold``: per key the first round(fraction * n) rows by hash of the id (at least one, at most n - 1)
    are ``names[0]``. Keys are strata; the order is the same for every run and partitioning."""
    ranked = with_rank(df.withColumn("__u", hash_uniform(F.col(id_col), seed)), keys, "__u", [id_col], rank="__r")
    size = F.least(F.greatest(F.bround(F.col("__n") * fraction, 0), F.lit(1)), F.col("__n") - 1)
    return ranked.withColumn("fold", F.when(F.col("__r") <= size, names[0]).otherwise(names[1])).drop("__u", "__r", "__n")


def anchored_folds(features: DataFrame, seed: int = 42, anchor: str = "CSLS") -> DataFrame:
    """``qid, fold`` (train, test) stratified by the anchor method's label; a quarter of train is ``calib`` in
    ``slice``, the rest ``fit``. All methods share the folds."""
    base = stored(features.filter(F.col("method") == anchor).select("qid", "y"), "fold-labels")
    folds = stored(fold_by_rank(base, 0.8, seed, ("y",), names=("train", "test")), "folds")
    train = fold_by_rank(folds.filter("fold = 'train'").drop("fold"), 0.75, seed + 1, ("y",), names=("fit", "calib")).select("qid", F.col("fold").alias("slice"))
    return folds.join(train, "qid", "left").select("qid", "fold", F.coalesce("slice", "fold").alias("slice"))


def class_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """``df`` with ``weight`` = n / (2 n_class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("__c"))
    n = df.count()
    return df.join(F.broadcast(counts), label).withColumn("weight", F.lit(float(n)) / (2 * F.col("__c"))).drop("__c")


def _vectors(df: DataFrame, inputs: tuple[str, ...]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(inputs), outputCol="features").transform(df)


def _constant(df: DataFrame, train: DataFrame) -> DataFrame | None:
    """With one class in the labels its share is everyone's probability."""
    seen = [r["y"] for r in train.select("y").distinct().collect()]
    return df.withColumn("p", F.lit(float(seen[0]) if seen else 0.0)) if len(seen) < 2 else None


def _positive(model, df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).withColumn("p", vector_to_array("probability")[1])


def logistic_gate(train: DataFrame, df: DataFrame, inputs: tuple[str, ...] = ("margin", "slack_local")) -> DataFrame:
    """``df`` with ``p`` of a class-balanced logistic regression (unit penalty on the summed loss)."""
    from pyspark.ml.classification import LogisticRegression

    if (flat := _constant(df, train)) is not None:
        return flat
    model = LogisticRegression(labelCol="y", weightCol="weight", maxIter=1000, tol=1e-8, regParam=1.0 / train.count(), standardization=False).fit(_vectors(class_weights(train), inputs))
    return _positive(model, _vectors(df, inputs)).drop("features", "rawPrediction", "probability", "prediction")


def tree_gate(train: DataFrame, df: DataFrame, inputs: tuple[str, ...] = FEATURES, rounds: int = 30, depth: int = 4, seed: int = 42) -> DataFrame:
    """``df`` with ``p`` of gradient-boosted trees."""
    from pyspark.ml.classification import GBTClassifier

    if (flat := _constant(df, train)) is not None:
        return flat
    model = GBTClassifier(labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.9, seed=seed).fit(_vectors(train, inputs))
    return _positive(model, _vectors(df, inputs)).drop("features", "rawPrediction", "probability", "prediction")


def stored_difference(a: DataFrame, b: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """Rows that only one side has, and the largest absolute difference of each column between two tables."""
    d = a.select(*keys, *columns, F.lit(1).alias("__a")).join(b.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(1).alias("__b")), list(keys), "full")
    return d.agg(F.count_if(F.col("__a").isNull() | F.col("__b").isNull()).alias("unmatched"), *[F.max(F.abs(F.col(c) - F.col(f"__{c}"))).alias(f"max_diff_{c}") for c in columns])
