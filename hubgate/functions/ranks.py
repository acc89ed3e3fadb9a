"""Row numbers and exact quantiles within groups that are too large for one task.

Rows are cut into buckets of neighbouring values, numbered within their bucket and moved by the rows of the buckets
before. The cuts come from a sample of at most ``64 x buckets`` rows; they decide how even the buckets are, never the
result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cuts(df: DataFrame, place: Column, buckets: int) -> list[Column]:
    """At most ``buckets`` - 1 different places, in order, as literals."""
    some = df.select(place.alias("p")).orderBy(F.xxhash64("p")).limit(64 * buckets)
    row = some.agg(F.sort_array(F.collect_list("p")).alias("p")).first()
    kinds = [f.dataType for f in some.schema["p"].dataType.fields]
    picked = dict.fromkeys(tuple(row["p"][len(row["p"]) * i // buckets]) for i in range(1, buckets)) if row["p"] else {}
    return [F.struct(*[F.lit(x).cast(k).alias(f"f{j}") for j, (x, k) in enumerate(zip(p, kinds, strict=True))]) for p in picked]


def bucket_of(df: DataFrame, value: Column, buckets: int) -> Column:
    """The number of the bucket of neighbouring values that a row of ``df`` belongs to, the same in every use."""
    place = F.struct(value.alias("f0"))
    cuts = _cuts(df, place, buckets)
    return F.size(F.filter(F.array(*cuts), lambda c: c < place)) if cuts else F.lit(0)


def with_rank(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str] = (), *, descending: bool = False, rank: str = "__rank", total: str = "__n", buckets: int | None = None) -> DataFrame:
    """``df`` with the row number (from 1) by ``value`` and then ``ties`` within ``keys``, and the number of rows there.

    Nulls come first, with ``descending`` (numbers only) last. Keys that are null form one group.
    """
    first = [F.col(value).isNull(), -F.col(value)] if descending else [F.col(value).isNotNull(), F.col(value)]
    place = F.struct(*[c.alias(f"f{i}") for i, c in enumerate([*first, *map(F.col, ties)])])
    cuts = _cuts(df, place, buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.size(F.filter(F.array(*cuts), lambda c: c < place)) if cuts else F.lit(0)
    dealt = df.withColumn("__place", place).withColumn("__bucket", bucket)
    sizes = dealt.groupBy(*keys, "__bucket").agg(F.count("*").alias("__rows"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__bucket").alias("__b"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"), F.sum("__rows").over(group).alias(total)
    )
    same = F.col("__bucket") == F.col("__b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    own = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy("__place")))
    return own.join(sizes, same).withColumn(rank, F.col(rank) + F.col("__before")).select(*df.columns, rank, total)


def quantiles(df: DataFrame, value: str, shares: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """``keys`` and ``q``: exact quantiles with linear interpolation, in the order of ``shares``; nulls are left out."""
    ranked = with_rank(df.select(*keys, F.col(value).cast("double").alias("__x")).filter("__x is not null"), keys, "__x")
    picked = []
    for i, share in enumerate(shares):
        at = (F.col("__n") - 1) * F.lit(float(share))
        x = lambda k: F.max(F.when(F.col("__rank") == k + 1, F.col("__x")))
        picked += [x(F.floor(at)).alias(f"lo{i}"), x(F.ceil(at)).alias(f"hi{i}"), F.max(at - F.floor(at)).alias(f"w{i}")]
    found = ranked.groupBy(*keys).agg(*picked)
    return found.select(*keys, F.array(*[F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"w{i}") for i in range(len(shares))]).alias("q"))
