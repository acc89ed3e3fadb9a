"""Scoring of query streams against a frozen gallery and its penalties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.blocks import Blocks, reranked, shortlist


def score_batch(batch: DataFrame, gallery: DataFrame, psi_column: str = "csls", sizes: Blocks | None = None) -> DataFrame:
    """``qid, top1, certified`` for a batch of queries (qid, v); ``gallery`` has cid, v and the frozen penalty.

    Queries that the global certificate covers keep their cosine top-1; only the others are reranked.
    """
    batch = batch.persist()
    near = shortlist(batch, gallery, 2, sizes)
    list_ = F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("o"), F.col("cid").alias("c"))))
    top = near.groupBy("qid").agg(list_.alias("t")).select("qid", F.col("t")[0].c.alias("c1"), (F.get("t", F.lit(1)).o - F.col("t")[0].o).alias("margin"))
    low = gallery.agg(F.min(psi_column)).first()[0]
    judged = top.join(gallery.select(F.col("cid").alias("c1"), F.col(psi_column).alias("psi1")), "c1")
    judged = judged.select("qid", "c1", F.coalesce(F.col("margin") >= F.col("psi1") - F.lit(low), F.lit(True)).alias("certified")).persist()
    rest = batch.join(judged.filter(~F.col("certified")).select("qid"), "qid", "left_semi")
    again = reranked(rest, gallery, [("m", psi_column, None)], 1, sizes)
    best = again.groupBy("qid").agg(F.min_by("cid", F.struct(-F.col("score"), -F.col("s"), "cid")).alias("top1"))
    return judged.join(best, "qid", "left").select("qid", F.coalesce("top1", "c1").alias("top1"), "certified")


def score_stream(queries: DataFrame, gallery: DataFrame, path: str, checkpoint: str, psi_column: str = "csls") -> StreamingQuery:
    """Score micro-batches of a query stream and append them below ``path``. Stateless; the penalties are refreshed by
    a batch job, since they depend on the set of queries. A batch that runs again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        score_batch(batch.select("qid", "v"), gallery, psi_column).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
