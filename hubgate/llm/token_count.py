"""Token counts of whole texts: batch encoding inside Arrow functions that return lengths only.

Texts are cut before ASCII white space that follows a visible byte. A tokenizer that drops white space, or binds it
to the word after it, never crosses that boundary, so counts add up; equal chunks of a batch are encoded once, in
calls of about the same number of characters. Whether a JSON vocabulary is of that kind is read from its normalizer,
pre-tokenizer and added tokens (``cuts_at_space``). Others, and sentencepiece models, whose normalization may join white
space, are given whole texts; only the batches are balanced there.

Rows: null and empty texts have 0 bytes and 0 tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._storage import prepare
from ._text import distinct_spans, pieces, text_buffer
from .byte_bpe import cached, chunk_spans, single_threaded


@lru_cache(maxsize=2)
def _counter(kind: str, content: bytes):
    if kind == "json":
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]


_PLAIN_NORMALIZERS = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase"}


def cuts_at_space(content: bytes) -> bool:
    """Whether counts of a JSON vocabulary add up over texts cut before white space.

    True for byte-level pre-tokenizers without a prefix space, and for splits that keep the matches of a pattern which
    matches no white space; with normalizers that work on characters or make runs of white space one space; and with
    added tokens that hold no white space and take none from around them.
    """
    import regex

    d = json.loads(content)
    flat = lambda x, inner: [] if x is None else [z for y in x[inner] for z in flat(y, inner)] if x["type"] == "Sequence" else [x]
    for n in flat(d.get("normalizer"), "normalizers"):
        if n["type"] not in _PLAIN_NORMALIZERS and (n["type"], n.get("pattern"), n.get("content")) != ("Replace", {"Regex": r"\s+"}, " "):
            return False
    for t in d.get("added_tokens") or []:
        if regex.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"]:
            return False
    steps = flat(d.get("pre_tokenizer"), "pretokenizers")
    if not steps or any(p["type"] == "ByteLevel" and p["add_prefix_space"] for p in steps):
        return False
    first = steps[0]
    if first["type"] == "Split":
        pattern = first["pattern"].get("Regex")
        seen = pattern and any(regex.search(pattern, around) and regex.search(r"\s", regex.search(pattern, around)[0]) for c in " \t\n\v\f\r" for around in (c, f"a{c}", f"{c}a", f"{c}1", f".{c}"))
        return bool(pattern) and first["behavior"] == "Removed" and first["invert"] and not seen
    return first["type"] == "ByteLevel" and first["use_regex"]


def count_column(count, column: pa.Array, cut: bool, cache: dict) -> np.ndarray:
    """Tokens of each text of a column."""
    data, offsets = text_buffer(column)
    if cut:
        starts, ends, of_text = chunk_spans(data, offsets)
    else:
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        starts, ends, of_text = offsets[full], offsets[full + 1], np.searchsorted(full, np.arange(len(offsets)))
    first, place = distinct_spans(data, starts, ends)
    raw = data.tobytes()
    found = cached([raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], count, cache)
    sums = np.concatenate([[0], np.cumsum(np.array(found, np.int64)[place])]) if len(place) else np.zeros(1, np.int64)
    return sums[of_text[1:]] - sums[of_text[:-1]]


def count_tokens(docs: DataFrame, vocabulary: bytes, kind: str, *, text_col: str = "text", bytes_col: str = "n_bytes", tokens_col: str = "n_tokens") -> DataFrame:
    """``docs`` with the UTF-8 bytes and the tokens of ``text_col``; ``kind`` is "json" or "model", as the file's
    ending. Columns of the two names are replaced."""
    if kind not in ("json", "model"):
        raise ValueError(f"unknown kind of vocabulary: {kind}")
    spark = docs.sparkSession
    prepare(spark)
    shared, cut = spark.sparkContext.broadcast(vocabulary), kind == "json" and cuts_at_space(vocabulary)
    keep = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (bytes_col, tokens_col, text_col)], F.col(f"`{text_col}`").cast("string").alias("__text"))
    i = len(keep.columns) - 1
    schema = T.StructType([*keep.schema.fields[:i], T.StructField(bytes_col, T.LongType()), T.StructField(tokens_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        count, cache = _counter(kind, shared.value), {}
        for batch in batches:
            for rows in pieces(batch, "__text", 1 << 21):
                _, offsets = text_buffer(rows.column(i))
                out = [pa.array(np.diff(offsets)), pa.array(count_column(count, rows.column(i), cut, cache))]
                yield pa.RecordBatch.from_arrays([*rows.columns[:i], *out], names=schema.names)

    return keep.mapInArrow(run, schema)
