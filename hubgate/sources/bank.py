"""Embedding banks: scans by direction and split, identities, and import from NPZ archives.

A bank is a table ``id string, idx long, split string, modality string, v array<double>``; ``idx`` is the position of
a row in its file. A query table has ``qid, qidx, v``, a gallery table ``cid, cidx, v``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize

#: Query and gallery modality of each direction.
DIRECTIONS = {"i2t": ("image", "text"), "t2i": ("text", "image"), "a2t": ("audio", "text"), "t2a": ("text", "audio")}
#: Data sets whose files have another stem.
STEMS = {"flickr30k_entities": "flickr30k", "flickr_entities": "flickr30k"}
NPZ_SCHEMA = "path string, id string, idx long, v array<double>"


def dataset_stem(dataset: str) -> str:
    return STEMS.get(dataset, dataset)


def scan(spark: SparkSession, path: str, split: str | Sequence[str] | None = None, modality: str | None = None) -> DataFrame:
    """Rows of a bank in Parquet; filters reach the scan."""
    bank = spark.read.parquet(path)
    if split is not None:
        bank = bank.filter(F.col("split").isin([split] if isinstance(split, str) else list(split)))
    if modality is not None:
        bank = bank.filter(F.col("modality") == modality)
    return bank.withColumn("v", F.col("v").cast("array<double>"))


def pair(bank: DataFrame, direction: str, *, query_split: str = "test", gallery_splits: Sequence[str] = ("test",), normalize: bool = False) -> tuple[DataFrame, DataFrame]:
    """Query and gallery of a direction. Gallery rows count on over the splits in the order they are listed."""
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction: {direction}")
    asked, given = DIRECTIONS[direction]
    v = l2_normalize(F.col("v")) if normalize else F.col("v")
    q = bank.filter((F.col("split") == query_split) & (F.col("modality") == asked)).select(F.col("id").alias("qid"), F.col("idx").alias("qidx"), v.alias("v"))
    own = bank.filter(F.col("split").isin(list(gallery_splits)) & (F.col("modality") == given))
    sizes = {r["split"]: r["n"] for r in own.groupBy("split").agg((F.max("idx") + 1).alias("n")).collect()}
    shift, at = F.lit(0).cast("long"), 0
    for s in gallery_splits:
        shift = F.when(F.col("split") == s, F.lit(at)).otherwise(shift)
        at += sizes.get(s, 0)
    return q, own.select(F.col("id").alias("cid"), (F.col("idx") + shift).alias("cidx"), v.alias("v"))


def read_npz(spark: SparkSession, paths: str) -> DataFrame:
    """Arrays ``embeddings`` and ``ids`` of NPZ archives as rows (``path, id, idx, v``), archives in parallel."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import numpy as np

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    v, ids = z["embeddings"].astype(np.float64), z["ids"].astype(str)
                for at in range(0, len(ids), 4096):
                    part = v[at : at + 4096]
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(ids[at : at + 4096].tolist()), pa.array(np.arange(at, at + len(part))), rows], names=["path", "id", "idx", "v"])

    return files.mapInArrow(unpack, NPZ_SCHEMA)


def image_id(dataset: str, split: str, index) -> F.Column:
    return F.concat(F.lit(f"{dataset}_{split}_"), index.cast("string"))


def demo_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries and gallery of the ``embeddings`` table: every fifth vector asks for the rest; equal labels match."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    q = e.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("ql"), "v")
    return q, e.filter("vec_id % 5 <> 0").select(F.col("vec_id").alias("cid"), F.col("label").alias("gl"), "v")
