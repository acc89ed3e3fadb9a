"""Corpus sources: metadata shards, image and caption pairs, tar shards, captions, reports."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_string, eligible, json_number

# Names under which metadata columns occur, first choice first.
ALIASES = {
    "url": ("URL", "url"),
    "caption": ("TEXT", "text", "caption"),
    "language": ("LANGUAGE", "language", "lang"),
    "nsfw": ("NSFW", "nsfw"),
    "similarity": ("similarity", "SIMILARITY"),
    "width": ("WIDTH", "width"),
    "height": ("HEIGHT", "height"),
}


def first_present(columns: Sequence[str], names: Sequence[str]) -> str | None:
    return next((n for n in names if n in columns), None)


def aliased(df: DataFrame, overrides: Mapping[str, str] | None = None, required: Sequence[str] = ("url", "caption")) -> DataFrame:
    """``df`` under the common names, with those optional columns that it has. Other columns are not read."""
    overrides = overrides or {}
    picked = []
    for name, names in ALIASES.items():
        have = overrides.get(name) or first_present(df.columns, names)
        if have is not None:
            picked.append(F.col(f"`{have}`").alias(name))
        elif name in required:
            raise ValueError(f"no column for {name}: have {', '.join(df.columns)}")
    return df.select(*picked)


def metadata_shards(spark: SparkSession, path: str, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Metadata Parquet below a folder, under the common names."""
    return aliased(spark.read.option("recursiveFileLookup", "true").parquet(path), overrides)


def eligible_rows(meta: DataFrame, english_only: bool = True) -> DataFrame:
    lang = F.col("language") if "language" in meta.columns else None
    return meta.filter(eligible(F.col("url"), F.col("caption"), lang, english_only)).withColumns({"url": clean_string(F.col("url")), "caption": clean_string(F.col("caption"))})


def parquet_names(names: DataFrame, pattern: str | None = None, most: int | None = None, skip: DataFrame | None = None) -> DataFrame:
    """Parquet files of a listing (column ``name``), sorted, filtered by a pattern, without those already there; the
    first ``most`` of them if a number is given."""
    out = names.select("name").filter(F.col("name").endswith(".parquet")).distinct()
    if pattern:
        out = out.filter(F.col("name").rlike(pattern))
    if skip is not None:
        out = out.join(skip.select("name"), "name", "left_anti")
    out = out.orderBy("name")
    return out if most is None else out.limit(most)


def stem_and_split(path: Column) -> tuple[Column, Column]:
    """File name without its ending, and the folder that holds it."""
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def image_caption_pairs(spark: SparkSession, root: str) -> DataFrame:
    """``split, stem, image, caption`` of ``split/stem.jpg`` with ``split/stem.txt``; files without a partner are left
    out."""
    files = lambda ending: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{ending}").load(root)
    stem, split = stem_and_split(F.col("path"))
    images = files("jpg").select(split.alias("split"), stem.alias("stem"), F.col("content").alias("image"))
    captions = files("txt").select(split.alias("split"), stem.alias("stem"), F.decode("content", "utf-8").alias("caption"))
    return images.join(captions, ["split", "stem"])


def tar_pairs(spark: SparkSession, paths: str) -> DataFrame:
    """``shard, stem, image, caption, meta`` of tar shards: members are grouped by name without ending; a stem needs an
    image and a txt or json member. Shards are read in parallel."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    names = ["shard", "stem", "image", "caption", "meta"]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import tarfile

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                members: dict[str, dict[str, bytes]] = {}
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile() and "." in m.name.rpartition("/")[2]:
                            stem, _, ending = m.name.rpartition(".")
                            members.setdefault(stem, {})[ending.lower()] = tar.extractfile(m).read()
                text = lambda x: None if x is None else x.decode("utf-8", "replace")
                rows = [(path, s, next((f[e] for e in ("jpg", "jpeg", "png", "webp") if e in f), None), text(f.get("txt")), text(f.get("json"))) for s, f in members.items()]
                rows = [r for r in rows if r[2] is not None and (r[3] is not None or r[4] is not None)]
                kinds = (pa.string(), pa.string(), pa.binary(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return files.mapInArrow(unpack, "shard string, stem string, image binary, caption string, meta string")


def decodable(df: DataFrame, column: str = "image") -> DataFrame:
    """Rows whose image can be decoded; without an image library, rows whose bytes begin like JPEG, PNG or WebP."""

    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        try:
            from PIL import Image
        except ImportError:
            Image = None

        def good(data: bytes | None) -> bool:
            if not data:
                return False
            if Image is None:
                return data[:3] == b"\xff\xd8\xff" or data[:8] == b"\x89PNG\r\n\x1a\n" or (data[:4] == b"RIFF" and data[8:12] == b"WEBP")
            try:
                Image.open(io.BytesIO(data)).convert("RGB")
            except Exception:
                return False
            return True

        for batch in batches:
            yield batch.filter(pa.array([good(x) for x in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def captions_by_image(captions: DataFrame) -> DataFrame:
    """``image, captions`` (list in file order) from ``image, caption`` with an ``ordinal``."""
    return captions.groupBy("image").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "caption"))), lambda x: x.caption).alias("captions"))


def exploded_captions(df: DataFrame, prefix: str, index: str = "idx") -> DataFrame:
    """``image_id, caption_id, caption`` with one row per caption; the list is under text, caption or sentences, a
    single string counts as a list of one."""
    kinds = dict(df.dtypes)
    lists = [F.when(F.col(c).isNotNull(), F.array(c)) if kinds[c] == "string" else F.col(c) for c in ("text", "caption", "sentences") if c in kinds]
    image = F.concat(F.lit(prefix), F.col(index).cast("string"))
    return df.select(image.alias("image_id"), F.posexplode(F.coalesce(*lists)).alias("j", "caption")).select("image_id", F.concat("image_id", F.lit("_cap"), F.col("j").cast("string")).alias("caption_id"), "caption")


def karpathy_captions(spark: SparkSession, path: str) -> DataFrame:
    """``filename, split, sentid, raw`` of a Karpathy split file (JSON with images and their sentences)."""
    images = spark.read.option("multiLine", "true").json(path).select(F.explode("images").alias("i"))
    return images.select("i.filename", "i.split", F.explode("i.sentences").alias("s")).select("filename", "split", "s.sentid", "s.raw")


def retained_metadata(df: DataFrame) -> DataFrame:
    """``caption, url, similarity, width, height, caption_len`` of a retained table; numbers come from their columns or
    else from the packed JSON."""
    caption = first_present(df.columns, ("caption", "TEXT", "text"))
    if caption is None:
        raise ValueError("retained metadata needs captions")
    url = first_present(df.columns, ("url", "URL"))

    def number(name: str) -> Column:
        have = first_present(df.columns, (name, name.upper()))
        own = F.col(f"`{have}`").try_cast("double") if have else F.lit(None).cast("double")
        return F.coalesce(own, json_number(F.col("laion_meta"), (name, name.upper()))) if "laion_meta" in df.columns else own

    return df.select(F.col(f"`{caption}`").alias("caption"), (F.col(f"`{url}`") if url else F.lit(None).cast("string")).alias("url"), number("similarity").alias("similarity"), number("width").alias("width"), number("height").alias("height"), F.length(F.col(f"`{caption}`")).alias("caption_len"))


def stem_metadata(df: DataFrame) -> DataFrame:
    """A stem table with its required columns checked."""
    if missing := {"split", "stem", "laion_meta"} - set(df.columns):
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    return df.select("split", "stem", "laion_meta")


def report_cells(spark: SparkSession, path: str, required: Sequence[str] = ("cell", "methods")) -> DataFrame:
    """``cell`` and its methods of report files (JSON), exploded, with their columns checked."""
    cells = spark.read.option("multiLine", "true").json(path).select(F.explode("cells").alias("c")).select("c.*")
    if missing := set(required) - set(cells.columns):
        raise ValueError(f"not a report: missing {', '.join(sorted(missing))}")
    return cells.select("cell", F.explode("methods").alias("m")).select("cell", "m.*")


#: ``backbone__direction__method`` with an optional ``__slack_mode``.
DUMP_NAME = r"^([^/]+?)__([a-z0-9]+)__([^/.]+?)(?:__slack_([A-Za-z0-9]+))?(?:\.[a-z]+)?$"


def dump_names(files: DataFrame) -> DataFrame:
    """``name, backbone, direction, method, mode`` of per-query dumps, from their names; other files are left out."""
    part = lambda i: F.regexp_extract("name", DUMP_NAME, i)
    return files.select("name").filter(F.col("name").rlike(DUMP_NAME)).select("name", part(1).alias("backbone"), part(2).alias("direction"), part(3).alias("method"), F.nullif(part(4), F.lit("")).alias("mode"))


def parse_cells(text: str) -> list[tuple[str, str]]:
    """(backbone, direction) cells of ``a|i2t,b|t2i``."""
    out = []
    for part in filter(None, re.split(r"[,\s]+", text)):
        backbone, bar, direction = part.partition("|")
        if not (bar and backbone and direction):
            raise ValueError(f"a cell is backbone|direction: {part}")
        out.append((backbone, direction))
    return out


def jpeg_bytes(df: DataFrame, column: str = "image", quality: int = 95) -> DataFrame:
    """``df`` with ``column`` as encoded images: bytes stay, strings are their Latin-1 bytes ("?" for what is beyond),
    and raw pixels (the struct of Spark's image source) become RGB JPEG where an image library is installed, else
    null."""
    kind = df.schema[column].dataType.typeName()
    if kind == "binary":
        return df
    rest = [c for c in df.columns if c != column]
    if kind == "string":
        return df.select(*rest, F.encode(F.regexp_replace(F.col(column), "[^\\x{0}-\\x{FF}]", "?"), "iso-8859-1").alias(column))
    pixels = df.select(*rest, F.col(f"{column}.height").alias("__h"), F.col(f"{column}.width").alias("__w"), F.col(f"{column}.nChannels").alias("__n"), F.col(f"{column}.data").alias("__data"))
    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField(column, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import numpy as np

        try:
            from PIL import Image
        except ImportError:
            Image = None

        def one(h, w, n, data) -> bytes | None:
            if Image is None or not data:
                return None
            x = np.frombuffer(data, np.uint8).reshape(h, w, n)
            out = io.BytesIO()  # the source has blue first
            Image.fromarray(x[:, :, 2::-1] if n >= 3 else np.repeat(x, 3, axis=2)).convert("RGB").save(out, format="JPEG", quality=quality)
            return out.getvalue()

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[len(rest) :]]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array([one(*x) for x in zip(*columns, strict=True)], pa.binary())], names=schema.names)

    return pixels.mapInArrow(run, schema)


def flickr_captions(spark: SparkSession, captions: str, names: DataFrame) -> DataFrame:
    """``idx, image, captions`` of the images of a split (``names``: image), from a caption file with image and caption
    columns. Images are numbered in order of their names; those without captions keep their number and are left out."""
    from ..functions.ranks import with_rank

    lines = spark.read.option("header", "true").option("quote", '"').option("escape", '"').csv(captions)
    own = captions_by_image(lines.withColumn("ordinal", F.monotonically_increasing_id()))
    numbered = with_rank(names.select("image"), [], "image").select((F.col("__rank") - 1).alias("idx"), "image")
    return numbered.join(own, "image").select("idx", "image", "captions")


def organised_splits(images: DataFrame) -> DataFrame:
    """``filename, split`` of split files: unknown and missing splits count as train, entries without a name go."""
    known = F.when(F.col("split").isin("train", "val", "test"), F.col("split")).otherwise("train")
    return images.filter(F.coalesce(F.col("filename"), F.lit("")) != "").select("filename", known.alias("split"))


def experiment_splits(df: DataFrame, order: str, calibration: int = 5000, renamed: dict[str, str] | None = None) -> DataFrame:
    """``df`` (with split) as experiments want it: ``validation`` is named val, and the first rows of train, by
    ``order``, are there a second time as train_calib. That number of rows is the feature."""
    names = {"validation": "val"} if renamed is None else renamed
    split = F.col("split")
    for old, new in names.items():
        split = F.when(F.col("split") == old, new).otherwise(split)
    out = df.withColumn("split", split)
    head = out.filter("split = 'train'").orderBy(order).limit(calibration)
    return out.unionByName(head.withColumn("split", F.lit("train_calib")))


# Value types of a data set description and their Spark types.
_VALUE_TYPES = {
    "string": "string", "large_string": "string", "bool": "boolean", "int8": "byte", "int16": "short", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double", "binary": "binary",
}


def _feature_type(feature) -> str:
    if isinstance(feature, list):
        return f"array<{_feature_type(feature[0])}>"
    kind = feature.get("_type")
    if kind == "Value":
        return _VALUE_TYPES[feature["dtype"]]
    if kind in ("Image", "Audio"):
        return "struct<bytes: binary, path: string>"
    if kind == "ClassLabel":
        return "bigint"
    if kind in ("Sequence", "List"):
        return f"array<{_feature_type(feature['feature'])}>"
    return "struct<" + ", ".join(f"`{k}`: {_feature_type(v)}" for k, v in feature.items()) + ">"


def saved_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A data set saved with its description (``dataset_info.json``) beside Arrow stream files; files are read in
    parallel, record batches one at a time."""
    info = json.loads(spark.read.text(f"{path}/dataset_info.json", wholetext=True).first()[0])
    schema = ", ".join(f"`{k}` {_feature_type(v)}" for k, v in info["features"].items())
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(path).select("content")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                yield from pa.ipc.open_stream(content)

    return files.mapInArrow(unpack, schema)


def detected_kind(spark: SparkSession, path: str) -> str:
    """What a folder holds: a saved data set, image and caption pairs, or files of one ending."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    there = lambda pattern: bool(store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}")))
    for kind, patterns in {"saved": ["dataset_info.json"], "pairs": ["*.jpg", "*/*.jpg"], "tar": ["*.tar"], "parquet": ["*.parquet"], "csv": ["*.csv"], "json": ["*.json"]}.items():
        if any(map(there, patterns)):
            return kind
    raise ValueError(f"nothing known in {path}")


def read_corpus(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Reader dispatch by kind: saved, parquet, csv, json, pairs or tar; without a kind it is detected."""
    readers = {
        "saved": lambda: saved_dataset(spark, path),
        "parquet": lambda: spark.read.parquet(path),
        "csv": lambda: spark.read.option("header", "true").csv(path),
        "json": lambda: spark.read.json(path),
        "pairs": lambda: image_caption_pairs(spark, path),
        "tar": lambda: tar_pairs(spark, f"{path}/*.tar" if kind is None else path),
    }
    found = kind or detected_kind(spark, path)
    if found not in readers:
        raise ValueError(f"unknown kind of corpus: {kind}")
    return readers[found]()
