"""Pairing by joins: ground truth and first matches. Similarities of all pairs are in ``plans.blocks``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_caption_suffix


class Truth:
    """Ground truth by keys: a query (``qid, key``, one key each) matches every item (``cid, key``) that has its key.

    Keys of the items in question are compared and items are counted by key, so the pairs are never a table: ten labels
    would make a tenth of all pairs.
    """

    def __init__(self, q_keys: DataFrame, g_keys: DataFrame):
        self.q_keys = q_keys.toDF("qid", "key").filter("key is not null")
        self.g_keys = g_keys.toDF("cid", "key").filter("key is not null").distinct()

    @classmethod
    def by_label(cls, q: DataFrame, g: DataFrame) -> Truth:
        return cls(q.select("qid", "ql"), g.select("cid", "gl"))

    @classmethod
    def of_pairs(cls, matches: DataFrame) -> Truth:
        """From pairs (query, item), of which a query has few."""
        qid, cid = matches.columns[:2]
        return cls(matches.select(qid, F.col(qid).alias("key")).distinct(), matches.select(cid, qid))

    def with_hit(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """``df`` (with qid) and whether the item in ``column`` matches the query."""
        held = self.g_keys.select(F.col("cid").alias(column), F.col("key").alias("__key"), F.lit(True).alias(name))
        asked = df.join(self.q_keys.withColumnRenamed("key", "__key"), "qid", "left")
        return asked.join(held, [column, "__key"], "left").drop("__key").withColumn(name, F.coalesce(name, F.lit(False)))

    def sizes(self) -> DataFrame:
        """``qid, n``: the number of matches of the queries that have any."""
        return self.q_keys.join(self.g_keys.groupBy("key").agg(F.count("*").alias("n")), "key").select("qid", "n")

    def first(self) -> DataFrame:
        """``qid, gt``: the smallest matching item."""
        return self.q_keys.join(self.g_keys.groupBy("key").agg(F.min("cid").alias("gt")), "key").select("qid", "gt")


def truth_of(matches: DataFrame | Truth) -> Truth:
    return matches if isinstance(matches, Truth) else Truth.of_pairs(matches)


def matches_to_captions(q: DataFrame, g: DataFrame) -> DataFrame:
    """``qid, cidx``: gallery items whose id without its caption suffix is the query's id; all of them."""
    base = g.select(strip_caption_suffix(F.col("cid")).alias("qid"), "cidx")
    return q.select("qid").distinct().join(base, "qid")


def matches_to_images(q: DataFrame, g: DataFrame, last_only: bool = True) -> DataFrame:
    """``qid, cidx``: gallery items that have the query's id without its caption suffix. Of duplicate ids the last one
    counts, or all of them (``last_only=False``)."""
    base = q.select("qid", strip_caption_suffix(F.col("qid")).alias("cid")).distinct()
    found = base.join(g.select("cid", "cidx"), "cid")
    return found.groupBy("qid").agg(F.max("cidx").alias("cidx")) if last_only else found.select("qid", "cidx")


def first_match(q: DataFrame, matches: DataFrame | Truth) -> DataFrame:
    """``qid, gt``: the smallest matching position, -1 where there is none."""
    return q.select("qid").join(truth_of(matches).first(), "qid", "left").select("qid", F.coalesce("gt", F.lit(-1)).cast("long").alias("gt"))


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key."""
    rest = [c for c in df.columns if c not in (key, order)]
    picked = df.groupBy(key).agg(F.min_by(F.struct(order, *rest), F.col(order)).alias("row"))
    return picked.select(key, "row.*")
