"""The retrieval analysis of one (queries, gallery) pair: lazy, shared intermediates, all small.

Two passes over the pairs feed everything: the first gives statistics per gallery item (the penalties of all four
rerankers) and the cosine shortlist, the second the best items by each method's score. Only queries whose certificate
does not fire need the second pass; ``gated`` runs it for those alone.

Ties: (method score, then cosine, then the smaller gallery id). With it the non-strict certificates agree with the
output exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.pairs import Truth, truth_of
from ..sinks import stored
from . import blocks

METHODS = ("CSLS", "QB-Norm", "DB-Norm", "NNN")


@dataclass(frozen=True)
class Params:
    csls_k: int = 20
    qb_tau: float = 20.0
    db_tau: float = 20.0
    nnn_k: int = 64
    nnn_w: float = 0.5
    local_k: int = 50
    pool_k: int = 50
    naive_margin: float = 0.05
    strict: bool = False
    tolerance: float = 1e-7
    rerank_k: int = 10
    softmax_temperature: float = 0.07


class Retrieval:
    """``q`` has qid (long) and v, ``g`` has cid (long) and v; ``matches`` is the ground truth, pairs (qid, cid) or by
    keys."""

    def __init__(self, q: DataFrame, g: DataFrame, matches: DataFrame | Truth, params: Params = Params(), sizes: blocks.Blocks = blocks.Blocks()):
        self.q, self.g, self.params, self.sizes = q.select("qid", "v"), g.select("cid", "v"), params, sizes
        self.truth = truth_of(matches)
        self._kept: list[DataFrame] = []
        self._shared: dict[str, DataFrame] = {}
        self._others: dict[blocks.Blocks, Retrieval] = {}

    def _keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(df.persist())
        return df

    def share(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A further intermediate that several queries want, made and stored once: plans that read it start there."""
        if name not in self._shared:
            self._shared[name] = stored(make(), name)
        return self._shared[name]

    def in_blocks(self, sizes: blocks.Blocks) -> Retrieval:
        """The same analysis by passes of other block and part sizes, with intermediates of its own."""
        if sizes not in self._others:
            self._others[sizes] = Retrieval(self.q, self.g, self.truth, self.params, sizes)
        return self._others[sizes]

    def release(self) -> None:
        """Give the memory of all shared intermediates back."""
        for df in self._kept:
            df.unpersist()
        self._kept.clear()
        self._shared.clear()
        for other in self._others.values():
            other.release()
        self._others.clear()

    @cached_property
    def n_queries(self) -> int:
        return self.q.count()

    @cached_property
    def n_gallery(self) -> int:
        return self.g.count()

    @cached_property
    def psi_wide(self) -> DataFrame:
        """``cid`` and the penalty of each method."""
        p = self.params
        found = blocks.gallery_statistics(self.q, self.g, (p.csls_k, p.nnn_k), (p.qb_tau, p.db_tau), self.sizes)
        return self._keep(found.select("cid", (F.col(f"mean_{p.csls_k}") / 2).alias("csls"), (F.col("lse_0") / p.qb_tau).alias("qb"), (F.col("lse_1") / p.db_tau).alias("db"), (p.nnn_w * F.col(f"mean_{p.nnn_k}")).alias("nnn")))

    @cached_property
    def psi(self) -> DataFrame:
        """``method, cid, psi``."""
        pairs = ", ".join(f"'{m}', `{c}`" for m, c in zip(METHODS, ("csls", "qb", "db", "nnn"), strict=True))
        return self.psi_wide.select("cid", F.expr(f"stack(4, {pairs}) as (method, psi)")).select("method", "cid", "psi")

    @cached_property
    def psi_min(self) -> DataFrame:
        return self.psi.groupBy("method").agg(F.min("psi").alias("psi_min"))

    @cached_property
    def shortlist(self) -> DataFrame:
        """``qid, rank, cid, s``: the most similar items, one more than any list that is needed."""
        k = min(max(self.params.local_k, self.params.pool_k, self.params.rerank_k) + 1, self.n_gallery)
        w = Window.partitionBy("qid").orderBy(F.desc("s"), "cid")
        found = blocks.shortlist(self.q, self.g, k, self.sizes)
        return self._keep(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("qid", "rank", "cid", "s"))

    @cached_property
    def top(self) -> DataFrame:
        """``qid, c1, s1, s2, margin``."""
        at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
        return self.shortlist.filter("rank <= 2").groupBy("qid").agg(at(1, "cid").alias("c1"), at(1, "s").alias("s1"), at(2, "s").alias("s2")).withColumn("margin", F.col("s1") - F.col("s2"))

    @cached_property
    def scored_shortlist(self) -> DataFrame:
        """``method, qid, rank, cid, s, psi`` of the shortlist."""
        return self._keep(self.shortlist.join(self.psi, "cid").select("method", "qid", "rank", "cid", "s", "psi"))

    @cached_property
    def certificates(self) -> DataFrame:
        """Per method and query: ``c1, margin, b_global, slack_global, b_local, slack_local, max_term`` (null with a
        shortlist of one)."""
        own = self.scored_shortlist.filter(F.col("rank") <= self.params.local_k)
        first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
        grouped = own.groupBy("method", "qid").agg(
            first("cid").alias("c1"), first("s").alias("s1"), first("psi").alias("psi1"), F.max(F.when(F.col("rank") == 2, F.col("s"))).alias("s2"), F.min("psi").alias("psi_local"),
            # psi1 - s1 is the same for all items of a query, so the largest term is that of the smallest psi - s
            F.min(F.when(F.col("rank") > 1, F.col("psi") - F.col("s"))).alias("least"),
        )
        with_min = grouped.join(F.broadcast(self.psi_min), "method")
        margin = F.col("s1") - F.col("s2")
        b_global, b_local = F.col("psi1") - F.col("psi_min"), F.col("psi1") - F.col("psi_local")
        return self._keep(with_min.select(
            "method", "qid", "c1", "psi1", margin.alias("margin"), b_global.alias("b_global"), (margin - b_global).alias("slack_global"), b_local.alias("b_local"), (margin - b_local).alias("slack_local"),
            ((F.col("psi1") - F.col("s1")) - F.col("least")).alias("max_term"),
        ))

    def certified(self, kind: str, strict: bool | None = None):
        """Condition on ``certificates`` under which reranking is skipped."""
        strict = self.params.strict if strict is None else strict
        over = lambda a, b: a > b if strict else a >= b
        zero = F.lit(0.0)
        return {
            "never": F.lit(False),
            "global": over(F.col("slack_global"), zero),
            "local": over(F.col("slack_local"), zero),
            "maxform": F.coalesce(over(zero, F.col("max_term")), F.lit(True)),
            "naive": F.col("margin") >= self.params.naive_margin,
        }[kind]

    def _method_list(self) -> list[tuple[str, str, float | None]]:
        return [("CSLS", "csls", None), ("QB-Norm", "qb", None), ("DB-Norm", "db", self.params.db_tau), ("NNN", "nnn", None)]

    @cached_property
    def scored_gallery(self) -> DataFrame:
        """The gallery with its penalties; every second pass reads it."""
        return self._keep(self.g.join(self.psi_wide, "cid"))

    def best(self, q: DataFrame, methods: list[tuple[str, str, float | None]], k: int) -> DataFrame:
        """``method, qid, rank, cid, s, score`` by method score over the whole gallery."""
        w = Window.partitionBy("method", "qid").orderBy(F.desc("score"), F.desc("s"), "cid")
        found = blocks.reranked(q, self.scored_gallery, methods, k, self.sizes)
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("method", "qid", "rank", "cid", "s", "score")

    @cached_property
    def rerank_list(self) -> DataFrame:
        return self._keep(self.best(self.q, self._method_list(), min(self.params.rerank_k, self.n_gallery)))

    @cached_property
    def full_top(self) -> DataFrame:
        """``method, qid, full``: reranked top-1 over the gallery."""
        return self.rerank_list.filter("rank = 1").select("method", "qid", F.col("cid").alias("full"))

    @cached_property
    def pool_top(self) -> DataFrame:
        """``method, qid, pool``: reranked top-1 within the cosine pool."""
        return self._best_of_pool(self.scored_shortlist)

    def _best_of_pool(self, scored: DataFrame) -> DataFrame:
        own = scored.filter(F.col("rank") <= self.params.pool_k)
        w = Window.partitionBy("method", "qid").orderBy(F.desc(self.score()), F.desc("s"), "cid")
        return own.withColumn("r", F.row_number().over(w)).filter("r = 1").select("method", "qid", F.col("cid").alias("pool"))

    def score(self):
        """Method score of columns method, s and psi."""
        plain = F.col("s") - F.col("psi")
        return F.when(F.col("method") == "DB-Norm", F.ln(F.greatest("s", F.lit(1e-12))) + self.params.db_tau * plain).otherwise(plain)

    def gated(self, kind: str, methods: tuple[str, ...] = METHODS, scope: str = "full", strict: bool | None = None) -> DataFrame:
        """``method, qid, top1, skipped`` where reranking, over the whole gallery or the cosine pool, runs only over
        queries that are not certified."""
        flagged = self.certificates.filter(F.col("method").isin(*methods)).select("method", "qid", "c1", self.certified(kind, strict).alias("skipped"))
        out = flagged.filter("skipped").select("method", "qid", F.col("c1").alias("top1"), "skipped")
        rest = self._keep(flagged.filter(~F.col("skipped")).select("method", "qid"))
        if scope == "pool":
            done = self._best_of_pool(self.scored_shortlist.join(rest, ["method", "qid"], "left_semi")).withColumnRenamed("pool", "top1")
            return out.unionByName(done.withColumn("skipped", F.lit(False)))
        # one pass for all methods: a query takes part with those that have not skipped it
        own = [m for m in self._method_list() if m[0] in methods]
        bit = F.lit(0).cast("long")
        for i, m in enumerate(own):
            bit = F.when(F.col("method") == m[0], F.lit(1 << i).cast("long")).otherwise(bit)
        asked = rest.groupBy("qid").agg(F.sum(bit).alias("want"))
        found = self.best(self.q.join(asked, "qid"), own, 1)
        return out.unionByName(found.select("method", "qid", F.col("cid").alias("top1"), F.lit(False).alias("skipped")))

    @cached_property
    def decisions(self) -> DataFrame:
        """Everything per method and query: certificates, their flags, and cosine, full and pool top-1 with hits."""
        flags = [self.certified(k).alias(f"cert_{k}") for k in ("global", "local", "maxform", "naive")]
        out = self.certificates.select("*", *flags).join(self.full_top, ["method", "qid"]).join(self.pool_top, ["method", "qid"])
        has = self.truth.sizes().select("qid", F.lit(True).alias("has_gt"))
        out = out.join(has, "qid", "left").withColumn("has_gt", F.coalesce("has_gt", F.lit(False)))
        for name, column in (("hit_cos", "c1"), ("hit_full", "full"), ("hit_pool", "pool")):
            out = self.truth.with_hit(out, column, name)
        return self._keep(out)


_known: dict[tuple[str, str], Retrieval] = {}


def forget() -> None:
    """Give back what the queries of a session share, so that the next one computes it again."""
    for known in _known.values():
        known.release()
    _known.clear()


def demo(spark, sf_dir: str) -> Retrieval:
    """The analysis of the ``embeddings`` table; intermediates are shared by all queries of a session."""
    from ..sources.bank import demo_pair

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _known:
        if all(app == key[0] for app, _ in _known):
            forget()
        _known.clear()
        q, g = demo_pair(spark, sf_dir)
        _known[key] = Retrieval(q, g, Truth.by_label(q, g))
    return _known[key]
