r"""Quality rules as a learned decision list, in DataFrame operations only.

Statistics of whole texts are built-in expressions. A list of rules, each a conjunction of thresholds on them, is
learned from a bounded sample of labelled documents by sequential covering: a rule grows by the condition with the
best information gain until it covers no document of the other class (or gains nothing), is pruned from its end on
held-out labels, and the documents it covers are set aside before the next one. Rules become one ordered
``CASE WHEN`` expression; documents that no rule covers are kept.

Words are runs of characters other than the six of ``[\x20\x09-\x0D]``; lines are what ``\n`` separates.

Rows: a null text counts as empty: all statistics are 0, and the base rule of at least ``min_words`` words fails.
A statistic without a denominator is 0. Documents without a label, and labels without a document, teach nothing;
of repeated labels the lowest quality counts. Without labels of both classes the list is empty.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._columns import let

_SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: What conditions may test, from the statistics.
FEATURES = ("n_words", "chars_per_word", "symbols_per_word", "dup_lines_per_line", "repeat_share")


def _covered(positions: Column) -> Column:
    """How many words the windows that begin at the ascending ``positions`` cover."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a.n + p + WINDOW - F.greatest(p, a.end)).alias("n"))
    return F.aggregate(positions, start, step, lambda a: a.n)


def _repeat_words(words: Column) -> Column:
    """Words in windows of five that occur twice or more in the text. Windows are compared by 64-bit hash."""

    def windows(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*[hashes[i + k] for k in range(WINDOW)]))

    def repeated(sorted_: Column) -> Column:
        last = F.size(sorted_) - 1
        same = lambda x, i: ((i > 0) & (sorted_[F.greatest(i - 1, F.lit(0))].h == x.h)) | ((i < last) & (sorted_[F.least(i + 1, last)].h == x.h))
        return F.sort_array(F.transform(F.filter(sorted_, same), lambda x: x.i))

    def count(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(_covered(let(ordered, repeated)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(let(hashes, windows), count))


def with_statistics(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (all long; columns of
    these names are replaced)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, _SPACES, "") != "")
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    new = {
        "__words": of_words,
        "__lines": of_lines,
        "word_chars": F.length(F.translate(text, _SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    }
    names = ("n_words", "n_repeat_words", "n_lines", "n_dup_lines", "word_chars", "n_symbols")
    out = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names], *[v.alias(k) for k, v in new.items()])
    found = [F.col("__words.n_words"), F.col("__words.n_repeat_words"), F.col("__lines.n_lines"), F.col("__lines.n_dup_lines"), F.col("word_chars"), F.col("n_symbols")]
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names], *found)


def base_failed(min_words: int = 10, max_repeat_percent: int = 20) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def feature(name: str) -> Column:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"),
        "chars_per_word": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "dup_lines_per_line": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
    }[name]


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def holds(self, x: Sequence[float]) -> bool:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, names: Sequence[str]) -> Column:
        c = feature(names[self.feature])
        return c > self.threshold if self.above else c <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a document that one covers is rejected."""

    rules: tuple[tuple[Condition, ...], ...]
    names: tuple[str, ...] = FEATURES

    def rejects(self, x: Sequence[float]) -> bool:
        return any(all(c.holds(x) for c in rule) for rule in self.rules)

    def verdict(self) -> Column:
        """True for documents to keep, as one ordered conditional expression."""
        out = None
        for rule in self.rules:
            test = F.lit(True)
            for c in rule:
                test = test & c.column(self.names)
            out = F.when(test, False) if out is None else out.when(test, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def __str__(self) -> str:
        one = lambda c: f"{self.names[c.feature]} {'>' if c.above else '<='} {c.threshold:.6g}"
        return "\n".join("reject if " + " and ".join(map(one, rule)) for rule in self.rules)


Rows = list[tuple[tuple[float, ...], bool]]


def _best(rows: Rows, n_features: int) -> tuple[float, Condition | None]:
    """The condition with the most information gain over what the rule covers so far: for every feature one sort
    and one sweep over its distinct values."""
    bad = sum(y for _, y in rows)
    if not bad or bad == len(rows):
        return 0.0, None
    before = math.log2(bad / len(rows))
    best: tuple[float, Condition | None] = (1e-9, None)
    for f in range(n_features):
        ordered = sorted(((x[f], y) for x, y in rows), key=lambda r: r[0])
        p = n = 0
        for i, (v, y) in enumerate(ordered[:-1]):
            p, n = p + y, n + (not y)
            if ordered[i + 1][0] > v:
                cut = (v + ordered[i + 1][0]) / 2
                for above, q, m in ((False, p, n), (True, bad - p, len(rows) - bad - n)):
                    if q:
                        gain = q * (math.log2(q / (q + m)) - before)
                        if gain > best[0]:
                            best = gain, Condition(f, above, cut)
    return best


def learn(rows: Rows, names: Sequence[str] = FEATURES, *, precision: float = 0.95, min_cover: int = 5, max_rules: int = 16, max_conditions: int = 4) -> DecisionList:
    """A decision list from (features, is bad) rows; every third row, in the order given, is held out to prune.

    A rule is accepted if, on all rows not covered before, it covers at least ``min_cover`` bad ones with at least
    ``precision``; the first one that is not ends the list.
    """
    left, rules = list(rows), []
    while len(rules) < max_rules:
        grow = [r for i, r in enumerate(left) if i % 3 != 2]
        held = [r for i, r in enumerate(left) if i % 3 == 2]
        rule: list[Condition] = []
        covered = grow
        while len(rule) < max_conditions and (c := _best(covered, len(names))[1]):
            rule.append(c)
            covered = [r for r in covered if c.holds(r[0])]
        if not rule:
            break

        def worth(k: int, rule: list[Condition] = rule, held: Rows = held) -> float:
            hit = [y for x, y in held if all(c.holds(x) for c in rule[:k])]
            return (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0

        rule = rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))]
        hit = [y for x, y in left if all(c.holds(x) for c in rule)]
        if sum(hit) < min_cover or sum(hit) < precision * len(hit):
            break
        rules.append(tuple(rule))
        left = [r for r in left if not all(c.holds(r[0]) for c in rule)]
    return DecisionList(tuple(rules), tuple(names))


def labelled_rows(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = 10_000) -> Rows:
    """Statistics of at most ``max_labels`` labelled documents, those with the smallest hash of the id, in that order.

    The bound makes the sample, the join side that is broadcast and the rows brought to the driver of fixed size.
    """
    key = F.col(f"`{id_col}`").cast("string")
    sample = (
        labels.filter(key.isNotNull() & F.col(f"`{label_col}`").isNotNull())
        .groupBy(key.alias("__id")).agg((F.min(F.col(f"`{label_col}`")) <= 0).alias("__bad"))
        .withColumn("__rank", F.sha2("__id", 256)).orderBy("__rank", "__id").limit(max_labels)
    )
    picked = docs.select(key.alias("__id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(sample), "__id")
    # what the base rules reject is set aside on the driver: a filter here would be evaluated over all documents, below the join
    columns = [F.col("__rank"), F.col("__id"), F.col("__bad"), base_failed().alias("__failed"), *[feature(n).alias(n) for n in FEATURES]]
    found = with_statistics(picked).select(*columns).orderBy("__rank", "__id", *FEATURES).limit(2 * max_labels).collect()
    return [(tuple(r[4:]), bool(r[2])) for r in found if not r[3]]


def judge(docs: DataFrame, rules: DecisionList, *, text_col: str = "text") -> DataFrame:
    """``docs`` with the statistics, ``base_failed`` and ``kept``."""
    out = with_statistics(docs, text_col=text_col)
    names = [c for c in out.columns if c not in ("base_failed", "kept")]
    return out.select(*[F.col(f"`{c}`") for c in names], base_failed().alias("base_failed"), F.when(base_failed(), False).otherwise(rules.verdict()).alias("kept"))
