"""Connected components of a link table by alternating star contractions; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._storage import discard, written


def _star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to its smallest neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _all_stars(links: DataFrame) -> bool:
    """Every node has one link, and what it is linked to has none itself."""
    rows, nodes = links.groupBy("u").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    return rows == nodes and links.join(links.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def connected_components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``node, component`` for every node of ``links`` (two long columns): the smallest node it is connected with.

    A round costs two grouped minima; chains shorten by half a round, stars are done in one. Every round is written,
    so lineage stays short, and replaces the one before; it ends when every component is a star. A node with very many
    links is only ever joined with one row of its own, so an adaptive plan may split its links between tasks.
    """
    a, b = links.columns[:2]
    first = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now = written(first, "links", narrow=True)
    for _ in range(most_rounds):
        if _all_stars(now):
            break
        before, now = now, written(_small_star(_star(now)), "links", narrow=True)
        discard(before)
    else:
        raise RuntimeError(f"links still change after {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
