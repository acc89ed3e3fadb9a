"""Vector functions over ``array<double>`` columns. They run in the JVM; the block plans use BLAS instead."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Smallest norm and smallest similarity that are divided by or taken the logarithm of.
EPS = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit-length vector; a zero vector stays zero."""
    return F.transform(F.array(F.greatest(norm(v), F.lit(EPS))), lambda n: F.transform(v, lambda x: x / n))[0]


def scaled_similarity(s: Column, logit_scale: float, bias: float = 0.0) -> Column:
    return s * F.lit(float(logit_scale)) + F.lit(float(bias))


def clamped_log(s: Column) -> Column:
    return F.ln(F.greatest(s, F.lit(EPS)))


def softmax_over(s: Column, temperature: float, *keys: str) -> Column:
    """Softmax of ``s / temperature`` within the rows of each key; the largest logit is taken off first."""
    w = Window.partitionBy(*keys)
    e = F.exp((s - F.max(s).over(w)) / F.lit(float(temperature)))
    return e / F.sum(e).over(w)


def entropy_term(p: Column) -> Column:
    """Its sum over a distribution is the entropy."""
    return -p * F.ln(F.greatest(p, F.lit(EPS)))


def log_sum_exp(x: Column) -> Column:
    """Aggregate log(sum(exp(x))). Direct summation is safe for bounded x (cosines times a temperature of 20 stay
    below e**20); partial sums are merged by Spark."""
    return F.ln(F.sum(F.exp(x)))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))
