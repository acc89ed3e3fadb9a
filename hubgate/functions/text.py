"""Text, url, JSON and hash functions of the data preparation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_caption_suffix(id_: Column) -> Column:
    """The id before its last ``_cap``, or the id itself where there is none."""
    return F.when(F.contains(id_, F.lit("_cap")), F.regexp_extract(id_, r"^(.*)_cap", 1)).otherwise(id_)


def clean_string(x: Column) -> Column:
    """Without white space at its ends; blank is null."""
    return F.nullif(F.regexp_replace(x.cast("string"), r"^\s+|\s+$", ""), F.lit(""))


def eligible(url: Column, text: Column, lang: Column | None = None, english_only: bool = True) -> Column:
    """Url and text are there; a missing language counts as English."""
    ok = clean_string(url).isNotNull() & clean_string(text).isNotNull()
    return ok & (lang.isNull() | (F.lower(lang) == "en")) if lang is not None and english_only else ok


def url_domain(url: Column) -> Column:
    """Lower-cased authority with port and user, as it stands; ``http://`` is assumed where a scheme is missing."""
    s = F.trim(F.coalesce(url, F.lit("")))
    full = F.when(F.instr(s, "://") > 0, s).otherwise(F.concat(F.lit("http://"), s))
    return F.when(s == "", F.lit("")).otherwise(F.lower(F.regexp_extract(full, r"^[^:]*://([^/?#]*)", 1)))


def json_number(json: Column, keys: Sequence[str]) -> Column:
    """Number under the first key that is present and not null; a value that is no number gives NaN, and later keys
    are not tried."""
    out = F.lit(None).cast("double")
    for key in reversed(keys):
        raw = F.get_json_object(json, f"$.{key}")
        out = F.when(raw.isNotNull(), F.coalesce(raw.try_cast("double"), F.lit(float("nan")))).otherwise(out)
    return out


def caption_of_json(json: Column, keys: Sequence[str] = ("caption", "TEXT", "text", "caption_txt")) -> Column:
    """The first non-blank string under the given keys, else the first non-blank string value of the object."""
    fields = F.from_json(json, "map<string,string>")
    quoted = lambda k: F.regexp_like(json, F.concat(F.lit('"'), k, F.lit('"\\s*:\\s*"')))
    text = lambda k: F.when(quoted(k), clean_string(fields[k]))
    others = F.filter(F.transform(F.map_keys(fields), text), lambda v: v.isNotNull())
    return F.coalesce(*[text(F.lit(k)) for k in keys], F.get(others, F.lit(0)))


def pack_json(columns: Sequence[str]) -> Column:
    """The columns as a JSON object without its nulls."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]))


def sha256_hex(x: Column) -> Column:
    return F.sha2(x, 256)


def padded_stem(n: Column) -> Column:
    return F.lpad(n.cast("string"), 8, "0")


def hash_uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only: 52 bits of a SHA-256."""
    digits = F.substring(F.sha2(F.concat(key.cast("string"), F.lit(f":{seed}")), 256), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))
