"""URL allow and block lists, judged by a trie over reversed host labels and path segments.

A rule is a host and a path. It fits its host and every subdomain of it, on urls whose path starts with the
rule's path. The longest fitting rule decides (by code points of host and path together; then the longer host;
then block before allow), so an allow entry can open part of a blocked site and the other way round.

Rows: a null url, or one without ``://``, has an empty host and path, which no rule fits; it gets the default
verdict. All input columns are replaced by the result columns, so clashing names cannot occur.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._storage import prepare

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(_UPPER, _LOWER)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url as columns."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    none = url.isNull() | (at == 0)
    return F.when(none, "").otherwise(F.translate(host, _UPPER, _LOWER)), F.when(none, "").otherwise(path)


class RuleTrie:
    """Host labels from the top-level domain down; under each host a trie of path segments.

    A path node holds the rules that end at it with a whole segment, and those that end inside the next segment
    as prefixes (``/en`` fits ``/english``), which are tried on the one segment that follows.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in rules:
            if rule.verdict not in (ALLOW, BLOCK):
                raise ValueError(f"a verdict is {ALLOW} or {BLOCK}: {rule.verdict}")
            node = self.root
            for label in reversed(rule.host.translate(_TO_LOWER).split(".")):
                node = node.setdefault("h", {}).setdefault(label, {})
            node = node.setdefault("p", {})
            *whole, part = rule.path.split("/")
            for segment in whole:
                node = node.setdefault("s", {}).setdefault(segment, {})
            ends = node.setdefault("e", {})
            kept = ends.get(part)
            if kept is None or (rule.verdict == BLOCK and kept.verdict == ALLOW):
                ends[part] = Rule(rule.verdict, rule.host.translate(_TO_LOWER), rule.path)

    def match(self, host: str, path: str) -> Rule | None:
        best, best_key = None, (-1, -1)
        segments = path.split("/")
        node = self.root
        for label in reversed(host.split(".")):
            node = node.get("h", {}).get(label)
            if node is None:
                break
            at = node.get("p")
            for segment in segments:
                if at is None:
                    break
                for part, rule in at.get("e", {}).items():
                    key = (len(rule.host) + len(rule.path), len(rule.host))
                    if key > best_key and segment.startswith(part):
                        best, best_key = rule, key
                at = at.get("s", {}).get(segment)
        return best


def trie_bytes(trie: RuleTrie) -> int:
    """What the trie takes in memory, measured node by node."""
    total, open_ = 0, [trie.root]
    while open_:
        node = open_.pop()
        total += getsizeof(node)
        for key, value in node.items():
            total += getsizeof(key)
            if isinstance(value, dict):
                open_.append(value)
            else:
                total += getsizeof(value) + getsizeof(value.__dict__) + getsizeof(value.host) + getsizeof(value.path) + getsizeof(value.verdict)
    return total


def judge_urls(
    pages: DataFrame, rules: Iterable[Rule], *, id_col: str = "page_id", url_col: str = "url", default: str = ALLOW, max_trie_bytes: int = 64 << 20
) -> DataFrame:
    """``id_col, host, path, rule, verdict`` for every row of ``pages``.

    The trie is broadcast while it takes at most ``max_trie_bytes`` in memory, as measured; a longer list is cut into
    tries of that size by host (``judge_urls_by_shards``), with the same result.
    """
    rules = list(rules)
    trie = RuleTrie(rules)
    size = trie_bytes(trie)
    if size > max_trie_bytes:
        return judge_urls_by_shards(pages, rules, shards=size // max(1, max_trie_bytes // 2) + 1, id_col=id_col, url_col=url_col, default=default)
    spark = pages.sparkSession
    prepare(spark)
    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    shared = spark.sparkContext.broadcast(trie)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            found = [trie.match(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            text = pa.array([r.text if r else None for r in found], pa.string())
            verdict = pa.array([r.verdict if r else default for r in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text, verdict], names=[id_col, "host", "path", "rule", "verdict"])

    kind = parts.schema[id_col].dataType.simpleString()
    return parts.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def judge_urls_by_shards(pages: DataFrame, rules: Iterable[Rule], *, shards: int, deals: int = 16, id_col: str = "page_id", url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """The same verdicts for a list whose trie is too large to broadcast.

    Rules are dealt to shards by their host. Each distinct host and path asks the shards of its host and of all the
    domains above it; a task builds one shard's trie from the rules that come first and matches the urls that stream
    past it, and the longest of the rules found decides. A shard is met by ``deals`` tasks, so one that most urls ask
    (that of ``com``) is shared between them.
    """
    spark = pages.sparkSession
    prepare(spark)
    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    shard = lambda h: F.pmod(F.xxhash64(h), F.lit(shards)).cast("int")
    table = spark.createDataFrame([(r.verdict, r.host.translate(_TO_LOWER), r.path) for r in rules], "verdict string, host string, path string")
    every = F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))
    own = table.select(shard(F.col("host")).alias("shard"), every.alias("deal"), F.lit(0).alias("kind"), "host", "path", "verdict")
    labels = F.split("host", r"\.", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: shard(F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    asked = parts.select("host", "path").distinct().select(
        F.explode(F.array_distinct(above)).alias("shard"), F.pmod(F.xxhash64("host", "path"), F.lit(deals)).cast("int").alias("deal"), F.lit(1).alias("kind"), "host", "path", F.lit(None).cast("string").alias("verdict")
    )
    met = own.unionByName(asked).repartition("shard", "deal").sortWithinPartitions("shard", "deal", "kind")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, trie, gathered = None, None, []
        for batch in batches:
            found = []
            for at, deal, kind, h, p, verdict in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (at, deal) != owner:
                    owner, trie, gathered = (at, deal), None, []
                if kind == 0:
                    gathered.append(Rule(verdict, h, p))
                    continue
                if trie is None:
                    trie, gathered = RuleTrie(gathered), []
                if (rule := trie.match(h, p)) is not None:
                    found.append((h, p, rule.text, rule.verdict, len(rule.host)))
            if found:
                kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["host", "path", "rule", "verdict", "of_host"])

    found = met.mapInArrow(judge, "host string, path string, rule string, verdict string, of_host int")
    best = found.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "of_host", "verdict")).alias("best"))
    return parts.join(best, ["host", "path"], "left").select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
