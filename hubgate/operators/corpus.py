"""Data preparation: exact deduplication, sampling, splits, manifests, verification."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import with_rank
from ..functions.text import hash_uniform, padded_stem

#: Splits, best first, with their shares.
SPLITS = ("train", "train_calib", "val", "test")
FRACTIONS = (0.72, 0.08, 0.10, 0.10)


def split_priority(split):
    out = F.lit(len(SPLITS))
    for i, s in enumerate(SPLITS):
        out = F.when(split == s, i).otherwise(out)
    return out


def assign_split(df: DataFrame, key: str, seed: int = 42, splits: Sequence[str] = SPLITS, fractions: Sequence[float] = FRACTIONS) -> DataFrame:
    """``df`` with ``split`` drawn independently per row by a hash of the key; rounding goes to the last split."""
    u, out, at = hash_uniform(F.col(key), seed), F.lit(splits[-1]), sum(fractions)
    for s, f in reversed(list(zip(splits[:-1], fractions[:-1], strict=True))):
        at = sum(fractions[: splits.index(s) + 1])
        out = F.when(u < at, s).otherwise(out)
    return df.withColumn("split", out)


def number_stems(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``stem``: eight digits, counted from 0 within the split in order of the key."""
    return with_rank(df, ["split"], key).withColumn("stem", padded_stem(F.col("__rank") - 1)).drop("__rank", "__n")


def sample_exactly(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, each set equally likely over seeds: those with the smallest hash. The feature is a sample of fixed size."""
    return df.withColumn("__u", hash_uniform(F.col(key), seed)).orderBy("__u", key).limit(n).drop("__u")


def shards(df: DataFrame, index: str, n_shards: int, n_rows: int) -> DataFrame:
    """``df`` with ``shard``: contiguous ranges of equal length, the last one shorter."""
    return df.withColumn("shard", F.floor(F.col(index) / -(-n_rows // n_shards)).cast("int"))


def duplicate_groups(df: DataFrame, content: str, key: str) -> DataFrame:
    """Groups of equal content: ``sha, n, n_splits, kept, removed``; what is kept has the best split, then the smallest
    key."""
    place = F.struct(split_priority(F.col("split")).alias("o"), F.col(key).alias("k"))
    hashed = df.withColumn("sha", F.sha2(content, 256))
    return hashed.groupBy("sha").agg(F.count("*").alias("n"), F.count_distinct("split").alias("n_splits"), F.min_by(key, place).alias("kept")).filter("n > 1").withColumn("removed", F.col("n") - 1)


def drop_duplicates_by_content(df: DataFrame, content: str, key: str) -> DataFrame:
    """One row per content: that of the best split, then the smallest key. Only keys meet in the grouping, and a hot
    content is combined where it is read."""
    place = F.struct(split_priority(F.col("split")).alias("o"), F.col(key).alias("k"))
    kept = df.groupBy(F.sha2(content, 256).alias("__sha")).agg(F.min_by(key, place).alias(key)).select(key)
    return df.join(kept, key, "left_semi")


def manifest(df: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """``split, stem, sha256_jpeg, caption_sha256, jpeg_bytes, caption_bytes, laion_meta`` in canonical order, from
    split, stem, image (binary) and caption; missing metadata is empty."""
    out = df.select("split", "stem", F.sha2("image", 256).alias("sha256_jpeg"), F.sha2(F.encode("caption", "utf-8"), 256).alias("caption_sha256"), F.octet_length("image").cast("long").alias("jpeg_bytes"), F.octet_length("caption").cast("long").alias("caption_bytes"))
    if meta is not None:
        out = out.join(meta.select("split", "stem", "laion_meta"), ["split", "stem"], "left").withColumn("laion_meta", F.coalesce("laion_meta", F.lit("")))
    else:
        out = out.withColumn("laion_meta", F.lit(""))
    return out.orderBy(split_priority(F.col("split")), "stem")


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once; empty if the rows are disjoint."""
    return df.groupBy(*keys).count().filter("count > 1")


def hamming_pairs(df: DataFrame, key: str, hash_col: str, radius: int, bits: int = 64, blocks: int = 4) -> DataFrame:
    """``a, b, d``: pairs of rows (a < b) whose hashes differ in at most ``radius`` bits.

    Two such hashes have a block that differs in at most radius // blocks bits. Each row asks for all values within
    that of each of its blocks, so pairs meet by equi-join and none is missed.
    """
    width = bits // blocks
    near = [0]
    for r in range(1, radius // blocks + 1):
        near += [sum(1 << b for b in c) for c in combinations(range(width), r)]
    h = F.col(hash_col).cast("long")
    value = lambda b: F.shiftrightunsigned(h, b * width).bitwiseAND(F.lit((1 << width) - 1))
    parts = df.select(F.col(key).alias("k"), h.alias("h"), F.posexplode(F.array(*map(value, range(blocks)))).alias("block", "value"))
    masks = df.sparkSession.createDataFrame([(m,) for m in near], "mask long")
    asked = parts.crossJoin(F.broadcast(masks)).select(F.col("k").alias("a"), F.col("h").alias("ha"), "block", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    d = F.bit_count(F.col("ha").bitwiseXOR(F.col("h")))
    return asked.join(parts.withColumnRenamed("k", "b"), ["block", "value"]).filter((F.col("a") < F.col("b")) & (d <= radius)).select("a", "b", d.cast("int").alias("d")).distinct()


def top_values(df: DataFrame, value, k: int) -> DataFrame:
    """The k most common non-empty values with their counts; ties by value. A report of fixed size."""
    return df.select(value.alias("value")).filter("value <> ''").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def share_distance(a: DataFrame, b: DataFrame, k: int = 50) -> DataFrame:
    """Half the summed difference of shares over the k most common values of ``a``; null if a side is empty. Both have
    one column, ``value``."""
    count = lambda d, n: d.filter("value <> ''").groupBy("value").agg(F.count("*").alias(n))
    ca, cb = count(a, "na"), count(b, "nb")
    totals = ca.agg(F.sum("na").cast("double").alias("ta")).crossJoin(cb.agg(F.sum("nb").cast("double").alias("tb")))
    top = ca.orderBy(F.desc("na"), "value").limit(k)
    d = top.join(cb, "value", "left").crossJoin(F.broadcast(totals))
    return d.agg((F.sum(F.abs(F.col("na") / F.col("ta") - F.coalesce("nb", F.lit(0)) / F.nullif(F.col("tb"), F.lit(0.0)))) / 2).alias("half_l1"))


def joined_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """``value, na, nb`` over the values of either side."""
    count = lambda d, n: d.filter("value <> ''").groupBy("value").agg(F.count("*").alias(n))
    zero = F.lit(0).cast("long")
    return count(a, "na").join(count(b, "nb"), "value", "full").select("value", F.coalesce("na", zero).alias("na"), F.coalesce("nb", zero).alias("nb"))


def max_numeric_stem(df: DataFrame) -> DataFrame:
    return df.filter(F.col("stem").rlike("^[0-9]+$")).groupBy("split").agg(F.max(F.col("stem").cast("long")).alias("max_stem"))


def verify_bank(bank: DataFrame, dim: int, id_pattern: str, tolerance: float = 0.02, first_rows: int | None = None) -> DataFrame:
    """One row per rule with the number of rows that break it: dimension, id format, repeated ids, unit norm (of the
    first rows only, where a number is given)."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    own = F.lit(True) if first_rows is None else F.col("idx") < first_rows
    row = bank.agg(
        F.count_if(F.size("v") != dim).alias("dimension"), F.count_if(~F.col("id").rlike(id_pattern)).alias("id_format"), (F.count("id") - F.count_distinct("id")).alias("repeated_ids"), F.count_if(own & (F.abs(norm - 1) > tolerance)).alias("unit_norm")
    )
    return row.select(F.expr("stack(4, 'dimension', dimension, 'id_format', id_format, 'repeated_ids', repeated_ids, 'unit_norm', unit_norm) as (rule, broken)"))
