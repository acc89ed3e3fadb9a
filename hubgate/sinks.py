"""Sinks: partitioned dumps, reports as JSON and Markdown, ordered CSV with a checksum."""

from __future__ import annotations

import hashlib
import io
import tarfile
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder of ``spark.checkpoint.dir``; in a temporary one only on a local master that
    sets none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="scratch-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its plan ends there, and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_dump(df: DataFrame, path: str, partition_by: Sequence[str] = ("method",)) -> None:
    """Per-query rows as Parquet, a folder per partition value."""
    df.write.mode("overwrite").partitionBy(*partition_by).option("compression", "zstd").parquet(path)


def write_bank(bank: DataFrame, path: str) -> None:
    """An embedding bank, by split and modality; vectors are stored as floats."""
    bank.withColumn("v", F.col("v").cast("array<float>")).write.mode("overwrite").partitionBy("split", "modality").option("compression", "zstd").parquet(path)


def margin_curve_report(buckets: DataFrame, cell: str) -> DataFrame:
    """One row ``report``: JSON with the bucket bounds (open upper bound: absent) and each method's curve."""
    curve = F.sort_array(F.collect_list(F.struct("bucket_no", "bucket", "n", "pct_certified", "pct_changed", "delta_r1", "cumulative_delta_r1")))
    methods = buckets.groupBy("method").agg(curve.alias("margin_buckets"))
    return methods.agg(F.sort_array(F.collect_list(F.struct("method", "margin_buckets"))).alias("methods")).select(F.to_json(F.struct(F.array(F.struct(F.lit(cell).alias("cell"), "methods")).alias("cells"))).alias("report"))


def nested_report(metrics: DataFrame, config: dict[str, str], cell: str) -> DataFrame:
    """One row ``report``: JSON with the configuration and one object per method."""
    rows = metrics.agg(F.sort_array(F.collect_list(F.struct("method", *[c for c in metrics.columns if c != "method"]))).alias("methods"))
    settings = F.create_map(*[F.lit(x) for k, v in config.items() for x in (k, str(v))]) if config else F.create_map().cast("map<string,string>")
    return rows.select(F.to_json(F.struct(settings.alias("config"), F.array(F.struct(F.lit(cell).alias("cell"), "methods")).alias("cells"))).alias("report"))


def markdown(df: DataFrame, title: str, digits: int = 4) -> str:
    """A table of metrics (few rows) as Markdown."""
    show = lambda x: "-" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(x) for x in row) + " |" for row in df.collect())]) + "\n"


def write_files(files: DataFrame, folder: str) -> int:
    """Rows ``name, content`` as files below a shared folder, and their number. Tasks write under names of their own
    and move a file to its place when it is whole, so a task may be repeated."""
    spark = files.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store.create_dir(f"{top}/{name}".rpartition("/")[0], recursive=True)
                own = f"{top}/_{uuid.uuid4().hex}"
                with store.open_output_stream(own, compression=None) as out:
                    out.write(content)
                store.move(own, f"{top}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    done = files.select("name", F.col("content").cast("binary")).mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return stored(done, "written").first()["n"]


def tar_files(members: DataFrame, shard: str) -> DataFrame:
    """``name, content`` of tar files, one per value of ``shard``, from members ``shard, stem, ending, content``."""

    def build(key: tuple, group: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for stem, ending, content in sorted(zip(*(group.column(c).to_pylist() for c in ("stem", "ending", "content")), strict=True)):
                info = tarfile.TarInfo(f"{stem}.{ending}")
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
        return pa.table({"name": [f"{key[0].as_py()}.tar"], "content": pa.array([out.getvalue()], pa.binary())})

    own = members.select(F.col(shard).cast("string").alias("shard"), "stem", "ending", "content")
    return own.groupBy("shard").applyInArrow(build, "name string, content binary")


def csv_lines(ordered: DataFrame) -> DataFrame:
    """``line``: the rows as CSV in their order, without the header."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return ordered.select(F.concat_ws(",", *map(cell, ordered.columns)).alias("line"))


def csv_checksum(ordered: DataFrame) -> DataFrame:
    """``n_rows, n_bytes, sha256`` of the rows as CSV with a header.

    A checksum is sequential: lines come to the driver in order, a partition at a time, and none is kept.
    """
    header = (",".join(ordered.columns) + "\n").encode()
    digest, rows, size = hashlib.sha256(header), 0, len(header)
    for row in csv_lines(ordered).toLocalIterator(prefetchPartitions=True):
        data = (row["line"] + "\n").encode()
        digest.update(data)
        rows, size = rows + 1, size + len(data)
    return ordered.sparkSession.createDataFrame([(rows, size, digest.hexdigest())], "n_rows long, n_bytes long, sha256 string")


def write_csv(ordered: DataFrame, path: str) -> None:
    """Ordered rows as one CSV folder with a header; Spark keeps the order of files and rows."""
    ordered.write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def checksum(lines: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def merged_shards(parts: Sequence[DataFrame]) -> DataFrame:
    """Shards in their order as one table; ``idx`` becomes the position in the whole."""
    out, at = None, 0
    for part in parts:
        n = part.count()
        moved = part.withColumn("idx", F.col("idx") + F.lit(at))
        out, at = moved if out is None else out.unionByName(moved), at + n
    return out
