"""A corpus pipeline over ``documents``: quality rules, line dedup, near-dedup, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; between stages docs are written as
Parquet and read again. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubgate.llm import byte_bpe, decontaminate, line_dedup, minhash_dedup, quality_rules
from hubgate.llm._storage import discard, written
from hubgate.llm.queries import learned_rules, table, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the learned decision list go."""
    rules = learned_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).filter("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 or more characters found in five or more documents stay in one of them; ``n_chars`` follows."""
    kept = line_dedup.drop_frequent_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 or more on shingles of five words stays."""
    return minhash_dedup.deduplicated(docs, shingle=5, similar=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, packed, and a digest of what they decode to."""
    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN, decoded_col="decoded")
    return coded.select("doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("minhash_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", tokens),
]

#: The learned rules, the exact near-duplicate components and the tokens have no SQL; the tests hold every stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    read = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if read is not None:
            discard(read)
        read = docs
    return STAGES[-1][1](spark, docs, sf_dir)
