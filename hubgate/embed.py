"""Embedding inference as an Arrow map with one model per Python worker, and a registry of models.

Model families are described by specs; one wrapper applies their rules (batches, number types, padding, placeholders,
pooling, clips of a fixed length) over a backend, which holds the weights and comes from a plug-in or is injected. The
one model that ships is a deterministic hashing embedder for texts, images and audio; it makes the plans run without
weights and has no claim to meaning.
"""

from __future__ import annotations

import hashlib
import importlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plans.blocks import prepare


class Embedder(Protocol):
    def encode_texts(self, texts: Sequence[str]) -> np.ndarray: ...

    def encode_images(self, images: Sequence[bytes]) -> np.ndarray: ...

    def encode_audio(self, clips: Sequence[np.ndarray]) -> np.ndarray: ...

    def get_metadata(self) -> dict[str, str]: ...


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def compute_similarity(a: np.ndarray, b: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """Cosines of all rows of two small matrices; the scale is applied to the cosines, not to the vectors."""
    return scale * unit_rows(a) @ unit_rows(b).T


class HashingEmbedder:
    """Signed feature hashing of byte trigrams; the same input gives the same vector everywhere."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def _encode(self, items: Sequence[bytes]) -> np.ndarray:
        out = np.zeros((len(items), self.dim))
        for row, data in zip(out, items, strict=True):
            for i in range(max(1, len(data) - 2)):
                h = int.from_bytes(hashlib.blake2b(data[i : i + 3], digest_size=8).digest(), "little")
                row[h % self.dim] += 1.0 if h >> 63 else -1.0
        return unit_rows(out)

    def encode_texts(self, texts: Sequence[str]) -> np.ndarray:
        return self._encode([t.lower().encode() for t in texts])

    def encode_images(self, images: Sequence[bytes]) -> np.ndarray:
        return self._encode([x or b"\0" for x in images])

    def encode_audio(self, clips: Sequence[np.ndarray]) -> np.ndarray:
        return self._encode([np.asarray(c, np.float32).tobytes() for c in clips])

    def get_metadata(self) -> dict[str, str]:
        return {"model_name": "hashing", "embedding_dim": str(self.dim), "dtype": "float64", "library": "hubgate"}


class Backend(Protocol):
    """A loaded model with its preprocessing: what a wrapper is made of. Outputs are arrays, or objects with
    ``pooler_output`` or ``last_hidden_state``, or tuples of which the first counts."""

    def decode(self, data: bytes) -> object: ...

    def blank(self, width: int, height: int) -> object: ...

    def images(self, images: list) -> object: ...

    def texts(self, texts: list[str], padding: str) -> object: ...

    def audio(self, samples: np.ndarray, rate: int) -> object: ...

    def project(self, modality: str, first: np.ndarray) -> np.ndarray: ...

    def metadata(self) -> dict[str, object]: ...


@dataclass(frozen=True)
class ModelSpec:
    """How a family of models is used: the type of its vectors, batches, the padding of texts (``truncate``: cut to the
    context; ``max_length``: cut and filled to it; ``longest``: filled to the longest of the batch), what an image that
    cannot be read becomes (None: an error), and whether the first token's state is projected."""

    name: str
    library: str
    dtype: str = "float32"
    batch: int = 32
    padding: str = "longest"
    placeholder: tuple[int, int] | None = None
    projected: bool = False
    seconds: float | None = None
    rate: int = 48_000

    @property
    def modality(self) -> str:
        return "image-text" if self.seconds is None else "audio-text"


# Model types with the names of their weights, number types and batch sizes.
SPECS = {
    "clip": ModelSpec("ViT-L/14@336px", "clip", "float16", 32, "truncate"),
    "clip_b16": ModelSpec("ViT-B/16", "clip", "float16", 32, "truncate"),
    "siglip": ModelSpec("google/siglip-base-patch16-256", "transformers", "float32", 32, "max_length"),
    "siglip2": ModelSpec("google/siglip2-so400m-patch14-384", "transformers", "float32", 32, "max_length"),
    "blip": ModelSpec("base_model/blip", "transformers", "float16", 32, "longest", projected=True),
    "eva_clip": ModelSpec("townwish/EVACLIP-ViT-L-14-336px", "transformers", "float16", 32, "longest"),
    "laion": ModelSpec("hf-hub:laion/CLIP-ViT-L-14-laion2B-s32B-b82K", "open_clip", "float32", 64, "truncate", (224, 224)),
    "openclip_vit_h14": ModelSpec("hf-hub:laion/CLIP-ViT-H-14-laion2B-s32B-b79K", "open_clip", "float32", 64, "truncate", (224, 224)),
    "eva_clip_l14": ModelSpec("hf-hub:timm/eva02_large_patch14_clip_336.merged2b_s6b_b61k", "open_clip", "float32", 64, "truncate", (224, 224)),
    "clap": ModelSpec("base_model/clap-htsat-fused", "transformers", "float16", 32, "longest", seconds=10.0),
}
#: Model types by modality, as processes that embed a data set choose among them.
TYPES_SINGLE = ("clip", "siglip", "laion", "blip", "clap")


def pooled(out: object) -> np.ndarray:
    """The vectors in a model's output."""
    if isinstance(out, np.ndarray):
        return out
    if getattr(out, "pooler_output", None) is not None:
        return np.asarray(out.pooler_output)
    if hasattr(out, "last_hidden_state"):
        return np.asarray(out.last_hidden_state)[:, 0]
    return np.asarray(out[0] if isinstance(out, tuple | list) else out)


class ModelEmbedder:
    """An embedder over an injected backend, by the rules of its spec."""

    def __init__(self, spec: ModelSpec, backend: Backend):
        self.spec, self.backend = spec, backend

    def _finish(self, modality: str, out: object, normalize: bool) -> np.ndarray:
        if self.spec.projected:
            states = out[0] if isinstance(out, tuple | list) else out
            x = np.asarray(self.backend.project(modality, np.asarray(states)[:, 0]))
        else:
            x = pooled(out)
        x = x.astype(np.float64)
        return (unit_rows(x) if normalize else x).astype(self.spec.dtype)

    def _in_batches(self, modality: str, items: Sequence, encode: Callable[[list], object], batch: int, normalize: bool) -> np.ndarray:
        parts = [self._finish(modality, encode(list(items[at : at + batch])), normalize) for at in range(0, len(items), batch)]
        return np.concatenate(parts) if parts else np.zeros((0, 0), self.spec.dtype)

    def _image(self, image: object) -> object:
        if not isinstance(image, bytes):
            return image
        try:
            return self.backend.decode(image)
        except Exception:
            if self.spec.placeholder is None:
                raise
            return self.backend.blank(*self.spec.placeholder)

    def encode_images(self, images: Sequence, batch: int | None = None, normalize: bool = True) -> np.ndarray:
        """Vectors of encoded (bytes) or decoded images."""
        return self._in_batches("image", images, lambda some: self.backend.images([self._image(x) for x in some]), batch or self.spec.batch, normalize)

    def encode_texts(self, texts: Sequence[str], batch: int | None = None, normalize: bool = True) -> np.ndarray:
        return self._in_batches("text", texts, lambda some: self.backend.texts(some, self.spec.padding), batch or self.spec.batch, normalize)

    def encode_audio(self, clips: Sequence[np.ndarray], rates: int | Sequence[int] | None = None, normalize: bool = True) -> np.ndarray:
        """Vectors of clips, one at a time: mono samples of a fixed length at the model's rate."""
        if self.spec.seconds is None:
            raise ValueError(f"{self.spec.name} has no audio side")
        rates = [rates if isinstance(rates, int) else self.spec.rate] * len(clips) if rates is None or isinstance(rates, int) else list(rates)
        ready = lambda one: self.backend.audio(fixed_length(one[0][0], self.spec.seconds, self.spec.rate, one[0][1]), self.spec.rate)
        return self._in_batches("audio", list(zip(clips, rates, strict=True)), ready, 1, normalize)

    def get_metadata(self) -> dict[str, str]:
        own = {"model_name": self.spec.name, "dtype": self.spec.dtype, "library": self.spec.library}
        return own | {k: str(v) for k, v in self.backend.metadata().items()}


def only_pickled_weights(folder: str) -> bool:
    """Whether a local model folder has its weights in the pickle format alone."""
    top = Path(folder)
    return (top / "pytorch_model.bin").is_file() and not (top / "model.safetensors").is_file()


def _plug_in(kind: str) -> Callable[[], Embedder]:
    """Backends need weights and their libraries; a module ``hubgate_models_<kind>`` gives one by ``create(name)``."""

    def make() -> Embedder:
        module = f"hubgate_models_{kind}"
        try:
            backend = importlib.import_module(module).create(SPECS[kind].name)
        except ModuleNotFoundError as e:
            raise RuntimeError(f"{kind} needs its weights: install a module {module} with create(name)") from e
        return ModelEmbedder(SPECS[kind], backend)

    return make


#: Model types. All but ``hashing`` get their backend from a plug-in, or from ``use_backend``.
REGISTRY: dict[str, Callable[[], Embedder]] = {"hashing": HashingEmbedder} | {kind: _plug_in(kind) for kind in SPECS}


def use_backend(kind: str, make: Callable[[], Backend]) -> None:
    """Inject the backend of a model type; ``make`` runs once in every Python worker, so it must be importable there."""
    REGISTRY[kind] = lambda: ModelEmbedder(SPECS[kind], make())


def make_embedder(kind: str) -> Embedder:
    if kind not in REGISTRY:
        raise ValueError(f"unknown model type: {kind}")
    return REGISTRY[kind]()


def embed_texts(texts: Sequence[str], kind: str = "hashing") -> np.ndarray:
    """Vectors of a few texts on the driver; tables go through ``embed_column``."""
    return make_embedder(kind).encode_texts(texts)


def embed_images(images: Sequence[bytes], kind: str = "hashing") -> np.ndarray:
    return make_embedder(kind).encode_images(images)


def fixed_length(samples: np.ndarray, seconds: float = 10.0, rate: int = 48_000, source_rate: int | None = None) -> np.ndarray:
    """Mono samples at ``rate``, cut or padded with silence to a fixed length; linear resampling."""
    x = np.asarray(samples, np.float32)
    x = x.mean(axis=0 if x.shape[0] <= x.shape[-1] else 1) if x.ndim == 2 else x
    if source_rate and source_rate != rate and len(x):
        n = round(len(x) * rate / source_rate)
        x = np.interp(np.arange(n) * (len(x) / max(n, 1)), np.arange(len(x)), x).astype(np.float32)
    n = int(seconds * rate)
    return x[:n] if len(x) >= n else np.pad(x, (0, n - len(x)))


def embed_column(df: DataFrame, column: str, kind: str = "hashing", modality: str = "text", out: str = "v", batch: int = 256, make: Callable[[], Embedder] | None = None) -> DataFrame:
    """``df`` with the vector of ``column`` (null counts as empty): strings of ``text``, bytes of ``image``, arrays of
    samples of ``audio`` (at the model's rate). The model is made once per task, by its kind or by ``make``."""
    method, empty = {"text": ("encode_texts", ""), "image": ("encode_images", b""), "audio": ("encode_audio", [])}[modality]
    prepare(df.sparkSession)
    at = df.columns.index(column)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make() if make else make_embedder(kind)
        for big in batches:
            for k in range(0, big.num_rows, batch):
                rows = big.slice(k, batch)
                values = rows.column(at).to_pylist()
                v = getattr(model, method)([x or empty for x in values])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.reshape(-1).astype(np.float64)))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], names=schema.names)

    return df.mapInArrow(run, schema)


def embed_captions(captions: DataFrame, dataset: str, split: str, kind: str = "hashing") -> DataFrame:
    """A text bank from ``caption_id, caption`` in order of ``ordinal``."""
    own = embed_column(captions.select("caption_id", "ordinal", "caption"), "caption", kind)
    return own.select(F.col("caption_id").alias("id"), F.col("ordinal").alias("idx"), F.lit(split).alias("split"), F.lit("text").alias("modality"), "v")


def split_bank(samples: DataFrame, dataset: str, split: str, kind: str = "hashing", modality: str = "image", make: Callable[[], Embedder] | None = None) -> DataFrame:
    """The bank (``id, idx, split, modality, v``) of a split: one vector per sample and one per caption.

    ``samples`` has ``idx`` (the position in the source, kept in the ids), a column named as the modality and the
    captions as text, caption or sentences. A sample without media or captions is left out on both sides.
    """
    from .functions.ranks import with_rank
    from .sources.corpus import exploded_captions

    own = samples.filter(F.col(modality).isNotNull())
    prefix = f"{dataset}_{split}_"
    captions = exploded_captions(own, prefix)
    place = F.regexp_extract("caption_id", r"_cap(\d+)$", 1).cast("int").alias("j")
    captions = with_rank(captions.select(F.col("image_id").substr(len(prefix) + 1, 20).cast("long").alias("i"), place, "caption_id", "caption"), [], "i", ["j"])
    texts = captions.select(F.col("caption_id").alias("id"), (F.col("__rank") - 1).alias("idx"), "caption")
    has = captions.select(F.col("i").alias("idx")).distinct()
    media = with_rank(own.join(has, "idx", "left_semi").select(F.col("idx").alias("i"), modality), [], "i")
    media = media.select(F.concat(F.lit(prefix), F.col("i").cast("string")).alias("id"), (F.col("__rank") - 1).alias("idx"), modality)
    bank = lambda d, c, m: embed_column(d, c, kind, m, make=make).select("id", "idx", F.lit(split).alias("split"), F.lit(m).alias("modality"), "v")
    return bank(media, modality, modality).unionByName(bank(texts, "caption", "text"))
