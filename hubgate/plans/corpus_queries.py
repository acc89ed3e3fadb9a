"""Queries of the data preparation over documents, pages, labels, benchmark and conversations."""

from __future__ import annotations

import io
import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import embed, sinks
from ..functions import text, vectors
from ..operators import corpus, metrics
from ..sources import corpus as source
from .registry import register, rounded, table

_U = "('0x' || substr(sha256({key} || ':{seed}'), 1, 13))::BIGINT / 16.0::DOUBLE ** 13"
_SPLIT = f"CASE WHEN {_U.format(key='doc_id', seed=42)} < 0.72 THEN 'train' WHEN {_U.format(key='doc_id', seed=42)} < 0.8 THEN 'train_calib' WHEN {_U.format(key='doc_id', seed=42)} < 0.9 THEN 'val' ELSE 'test' END"
_PRIORITY = "CASE split WHEN 'train' THEN 0 WHEN 'train_calib' THEN 1 WHEN 'val' THEN 2 ELSE 3 END"
_DOMAIN = "CASE WHEN trim(coalesce(url, '')) = '' THEN '' ELSE lower(regexp_extract(CASE WHEN instr(trim(url), '://') > 0 THEN trim(url) ELSE 'http://' || trim(url) END, '^[^:]*://([^/?#]*)', 1)) END"
_SPLIT_DOCS = f"sd AS (SELECT doc_id, text, {_SPLIT} AS split FROM documents)"
_STEMS = "st AS (SELECT *, lpad((row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1)::VARCHAR, 8, '0') AS stem FROM sd)"


def _documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _split_documents(spark, sf_dir) -> DataFrame:
    return corpus.assign_split(_documents(spark, sf_dir).select("doc_id", "text"), "doc_id")


def _metadata(spark, sf_dir) -> DataFrame:
    """Documents with the url of the page that has their number, as a metadata shard."""
    d, p = _documents(spark, sf_dir), table(spark, sf_dir, "pages")
    return d.join(p.select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left").select(F.col("doc_id"), F.col("url").alias("URL"), F.col("text").alias("TEXT"), F.col("lang").alias("LANGUAGE"), F.col("n_chars").alias("WIDTH"))


_META = "md AS (SELECT d.doc_id, p.url, d.text, d.lang, d.n_chars FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id)"
_CLEAN = r"nullif(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '')"


@register("src6_metadata_scan", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def src6_metadata_scan(spark, sf_dir):
    return _documents(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@register("src7_aliased_schema", f"WITH {_META} SELECT url, length(text)::INT AS caption_len, lang AS language, n_chars AS width FROM md")
def src7_aliased_schema(spark, sf_dir):
    m = source.aliased(_metadata(spark, sf_dir))
    return m.select("url", F.length("caption").alias("caption_len"), "language", "width")


@register("fn6_eligible_rows", f"WITH {_META} SELECT url, length({_CLEAN.format('text')})::INT AS caption_len FROM md WHERE {_CLEAN.format('url')} IS NOT NULL AND {_CLEAN.format('text')} IS NOT NULL AND (lang IS NULL OR lower(lang) = 'en')")
def fn6_eligible_rows(spark, sf_dir):
    return source.eligible_rows(source.aliased(_metadata(spark, sf_dir))).select("url", F.length("caption").alias("caption_len"))


@register("src5_parquet_listing", "SELECT 'part-' || lpad(page_id::VARCHAR, 5, '0') || '.parquet' AS name FROM pages WHERE page_id % 3 <> 0 ORDER BY name LIMIT 20")
def src5_parquet_listing(spark, sf_dir):
    name = F.concat(F.lit("part-"), F.lpad(F.col("page_id").cast("string"), 5, "0"), F.lit(".parquet"))
    pages = table(spark, sf_dir, "pages")
    return source.parquet_names(pages.select(name.alias("name")), "^part-", 20, pages.filter("page_id % 3 = 0").select(name.alias("name")))


def _stem(column: str):
    return F.lpad(F.col(column).cast("string"), 8, "0")


@register("src8_tar_shards", "SELECT 'shard-' || (page_id % 4) AS shard, lpad(page_id::VARCHAR, 8, '0') AS stem, octet_length(encode(url)) AS image_bytes, sha256(html) AS caption_sha256 FROM pages WHERE url IS NOT NULL AND html IS NOT NULL")
def src8_tar_shards(spark, sf_dir):
    """Pages are packed into tar shards (the bytes of the url as the image, the html as the caption) and read back."""
    p = table(spark, sf_dir, "pages").filter("url is not null and html is not null")
    member = lambda c, ending: p.select(F.concat(F.lit("shard-"), (F.col("page_id") % 4).cast("string")).alias("shard"), _stem("page_id").alias("stem"), F.lit(ending).alias("ending"), F.encode(c, "utf-8").alias("content"))
    folder = sinks.scratch_path(spark, "tar-shards")
    sinks.write_files(sinks.tar_files(member("url", "jpg").unionByName(member("html", "txt")), "shard"), folder)
    back = source.tar_pairs(spark, f"{folder}/*.tar")
    return back.select(F.regexp_extract("shard", r"([^/]+)\.tar$", 1).alias("shard"), "stem", F.octet_length("image").cast("long").alias("image_bytes"), F.sha2("caption", 256).alias("caption_sha256"))


@register("src9_10_image_caption_files", "SELECT CASE WHEN item_id % 2 = 0 THEN 'test' ELSE 'val' END AS split, lpad(item_id::VARCHAR, 8, '0') AS stem, octet_length(encode(text)) AS image_bytes, sha256(text) AS caption_sha256 FROM benchmark WHERE item_id % 5 <> 0")
def src9_10_image_caption_files(spark, sf_dir):
    """Items become an image and a caption file each, but for every fifth caption; files without a partner are left
    out."""
    b = table(spark, sf_dir, "benchmark")
    place = lambda ending: F.concat(F.when(F.col("item_id") % 2 == 0, "test/").otherwise("val/"), _stem("item_id"), F.lit(ending)).alias("name")
    content = F.encode("text", "utf-8").alias("content")
    folder = sinks.scratch_path(spark, "image-files")
    sinks.write_files(b.select(place(".jpg"), content).unionByName(b.filter("item_id % 5 <> 0").select(place(".txt"), content)), folder)
    back = source.read_corpus(spark, folder)
    return back.select("split", "stem", F.octet_length("image").cast("long").alias("image_bytes"), F.sha2("caption", 256).alias("caption_sha256"))


@register("src12_saved_dataset", "SELECT item_id, sha256(text) AS sha FROM benchmark")
def src12_saved_dataset(spark, sf_dir):
    """Items are saved as Arrow stream files with a description beside them, detected by it and read back."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), "text")

    def pack(batches):
        for batch in batches:
            out = io.BytesIO()
            with pa.ipc.new_stream(out, batch.schema) as stream:
                stream.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([f"data-{uuid.uuid4().hex}.arrow"]), pa.array([out.getvalue()], pa.binary())], names=["name", "content"])

    value = lambda kind: {"dtype": kind, "_type": "Value"}
    info = json.dumps({"features": {"item_id": value("int64"), "text": value("string")}})
    described = spark.createDataFrame([("dataset_info.json", info.encode())], "name string, content binary")
    folder = sinks.scratch_path(spark, "saved-data-set")
    sinks.write_files(b.mapInArrow(pack, "name string, content binary").unionByName(described), folder)
    return source.read_corpus(spark, folder).select("item_id", F.sha2("text", 256).alias("sha"))


@register("src17_split_file", "SELECT lpad(item_id::VARCHAR, 8, '0') || '.jpg' AS filename, CASE WHEN item_id % 3 = 1 THEN 'val' ELSE 'train' END AS split, item_id * 2 + j AS sentid, CASE WHEN j = 0 THEN text ELSE lower(text) END AS raw FROM benchmark, (SELECT unnest([0, 1]) AS j)")
def src17_split_file(spark, sf_dir):
    """Items as the images of a split file (one JSON document, as the format has it), with two sentences each; the
    unknown split restval counts as train."""
    b = table(spark, sf_dir, "benchmark")
    sentence = lambda j, c: F.struct((F.col("item_id") * 2 + j).alias("sentid"), c.alias("raw"))
    split = F.when(F.col("item_id") % 3 == 0, "train").when(F.col("item_id") % 3 == 1, "val").otherwise("restval")
    image = F.struct(F.concat(_stem("item_id"), F.lit(".jpg")).alias("filename"), split.alias("split"), F.array(sentence(0, F.col("text")), sentence(1, F.lower("text"))).alias("sentences"))
    path = sinks.scratch_path(spark, "split-file")
    b.agg(F.to_json(F.struct(F.collect_list(image).alias("images")))).write.text(path)
    rows = source.karpathy_captions(spark, path)
    own = source.organised_splits(rows.select("filename", "split").distinct())
    return rows.drop("split").join(own, "filename").select("filename", "split", "sentid", "raw")


@register("fn14_decodable", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 2")
def fn14_decodable(spark, sf_dir):
    """Whole texts behind the first bytes of a JPEG, of a PNG, or bare; only the bytes of images are kept (without an
    image library by their beginning)."""
    d = _documents(spark, sf_dir)
    head = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("FFD8FF"))).when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("89504E470D0A1A0A"))).otherwise(F.unhex(F.lit("00")))
    return source.decodable(d.select("doc_id", F.concat(head, F.encode("text", "utf-8")).alias("image"))).select("doc_id")


@register("aux6_parsed_cells", "SELECT * FROM (VALUES ('clip', 'i2t'), ('clip', 't2i'), ('siglip', 'i2t')) t(backbone, direction)")
def aux6_parsed_cells(spark, sf_dir):
    return spark.createDataFrame(source.parse_cells("clip|i2t,clip|t2i siglip|i2t"), "backbone string, direction string")


@register("aux11_jpeg_bytes", "SELECT doc_id, length(text) AS n FROM documents")
def aux11_jpeg_bytes(spark, sf_dir):
    """Texts taken for encoded images held in strings: one byte for each character."""
    d = _documents(spark, sf_dir).select("doc_id", F.col("text").alias("image"))
    return source.jpeg_bytes(d).select("doc_id", F.octet_length("image").cast("long").alias("n"))


@register("src11_captions_by_image", "SELECT source AS image, count(*) AS n, sha256(string_agg(sha256(text), '|' ORDER BY doc_id)) AS digest FROM documents GROUP BY source")
def src11_captions_by_image(spark, sf_dir):
    # whole texts by their hash, which keeps an image's row small
    c = _documents(spark, sf_dir).select(F.col("source").alias("image"), F.sha2("text", 256).alias("caption"), F.col("doc_id").alias("ordinal"))
    return source.captions_by_image(c).select("image", F.size("captions").cast("long").alias("n"), F.sha2(F.array_join("captions", "|"), 256).alias("digest"))


@register("src13_retained_metadata", "SELECT doc_id, length(text)::INT AS caption_len, n_chars::DOUBLE AS width FROM documents")
def src13_retained_metadata(spark, sf_dir):
    d = _documents(spark, sf_dir).withColumn("laion_meta", F.to_json(F.struct(F.col("n_chars").alias("WIDTH")))).select("doc_id", "text", "laion_meta")
    kept = source.retained_metadata(d.select(F.col("text").alias("caption"), "laion_meta", F.col("doc_id").cast("string").alias("url")))
    return kept.select(F.col("url").cast("long").alias("doc_id"), "caption_len", "width")


@register("src14_dump_names", "SELECT * FROM (VALUES ('clip__i2t__CSLS.npz', 'clip', 'i2t', 'CSLS', NULL), ('blip__t2i__QB_Norm__slack_localK50.npz', 'blip', 't2i', 'QB_Norm', 'localK50'), ('eva_clip_l14__i2t__NNN__slack_global.npz', 'eva_clip_l14', 'i2t', 'NNN', 'global')) t(name, backbone, direction, method, mode)")
def src14_dump_names(spark, sf_dir):
    names = [(n,) for n in ("clip__i2t__CSLS.npz", "blip__t2i__QB_Norm__slack_localK50.npz", "eva_clip_l14__i2t__NNN__slack_global.npz", "readme.txt")]
    return source.dump_names(spark.createDataFrame(names, "name string"))


@register("src16_stem_metadata", f"WITH {_SPLIT_DOCS}, {_STEMS} SELECT split, stem, '' || doc_id AS laion_meta FROM st")
def src16_stem_metadata(spark, sf_dir):
    d = corpus.number_stems(_split_documents(spark, sf_dir), "doc_id")
    return source.stem_metadata(d.withColumn("laion_meta", F.col("doc_id").cast("string")))


@register("fn4_strip_caption_suffix", "SELECT conv_id, turn, CASE WHEN contains(i, '_cap') THEN regexp_extract(i, '^(.*)_cap', 1) ELSE i END AS base FROM (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'c_' || conv_id ELSE 'c_' || conv_id || '_cap_cap' || turn END AS i FROM conversations)")
def fn4_strip_caption_suffix(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    base = F.concat(F.lit("c_"), F.col("conv_id").cast("string"))
    id_ = F.when(F.col("turn") == 0, base).otherwise(F.concat(base, F.lit("_cap_cap"), F.col("turn").cast("string")))
    return c.select("conv_id", "turn", text.strip_caption_suffix(id_).alias("base"))


@register("fn5_clean_string", "SELECT doc_id, length(nullif(regexp_replace('  ' || text || chr(9) || chr(10), '^\\s+|\\s+$', '', 'g'), ''))::INT AS n FROM documents")
def fn5_clean_string(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.length(text.clean_string(F.concat(F.lit("  "), "text", F.lit("\t\n")))).alias("n"))


@register("fn7_url_domain", f"SELECT page_id, {_DOMAIN} AS domain FROM pages")
def fn7_url_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.url_domain(F.col("url")).alias("domain"))


@register("fn8_json_number", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def fn8_json_number(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.json_number(F.col("props"), ("K", "k")).alias("k"))


@register("fn9_caption_of_json", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'cap ' || doc_id WHEN doc_id % 3 = 1 THEN 'txt ' || doc_id ELSE 'other ' || doc_id END AS caption FROM documents")
def fn9_caption_of_json(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    word = lambda w: F.concat(F.lit(w), n)
    j = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.lit(" ").alias("TEXT"), word("cap ").alias("caption")))).when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(word("txt ").alias("text"), F.lit(5).alias("caption")))).otherwise(F.to_json(F.struct(F.lit(7).alias("width"), word("other ").alias("title"))))
    return _documents(spark, sf_dir).select("doc_id", text.caption_of_json(j).alias("caption"))


@register("fn10_pack_json", "SELECT doc_id, '{\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || '}' AS meta FROM documents")
def fn10_pack_json(spark, sf_dir):
    d = _documents(spark, sf_dir).select("doc_id", "lang", "n_chars", F.lit(None).cast("string").alias("nsfw"))
    return d.select("doc_id", text.pack_json(["lang", "n_chars", "nsfw"]).alias("meta"))


@register("fn11_12_length_and_hash", "SELECT doc_id, length(text)::INT AS n, sha256(text) AS sha FROM documents")
def fn11_12_length_and_hash(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.length("text").alias("n"), text.sha256_hex(F.col("text")).alias("sha"))


@register("fn13_stems", "SELECT doc_id, lpad(doc_id::VARCHAR, 8, '0') AS stem FROM documents")
def fn13_stems(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", text.padded_stem(F.col("doc_id")).alias("stem"))


@register("fn15_id_pattern", "SELECT count(*) FILTER (WHERE NOT regexp_matches(source, '^src[0-9]+$')) AS bad FROM documents")
def fn15_id_pattern(spark, sf_dir):
    return _documents(spark, sf_dir).agg(F.count_if(~F.col("source").rlike("^src[0-9]+$")).alias("bad"))


@register("fn21_jn12_hamming_pairs", "WITH h AS (SELECT doc_id, (doc_id * 2654435761) % 4294967296 AS h FROM documents) SELECT a.doc_id AS a, b.doc_id AS b, bit_count(xor(a.h, b.h))::INT AS d FROM h a JOIN h b ON a.doc_id < b.doc_id AND bit_count(xor(a.h, b.h)) <= 5")
def fn21_jn12_hamming_pairs(spark, sf_dir):
    h = _documents(spark, sf_dir).select("doc_id", ((F.col("doc_id") * 2654435761) % 4294967296).alias("h"))
    return corpus.hamming_pairs(h, "doc_id", "h", 5, bits=32, blocks=2)


@register("jn10_manifest_metadata", f"WITH {_SPLIT_DOCS}, {_STEMS} SELECT split, stem, coalesce(CASE WHEN doc_id % 2 = 0 THEN '' || doc_id END, '') AS laion_meta, strlen(text) AS caption_bytes, sha256(text) AS caption_sha256 FROM st")
def jn10_manifest_metadata(spark, sf_dir):
    d = corpus.number_stems(_split_documents(spark, sf_dir), "doc_id")
    meta = d.filter("doc_id % 2 = 0").select("split", "stem", F.col("doc_id").cast("string").alias("laion_meta"))
    m = corpus.manifest(d.select("split", "stem", F.encode("text", "utf-8").alias("image"), F.col("text").alias("caption")), meta)
    return m.select("split", "stem", "laion_meta", "caption_bytes", "caption_sha256")


@register("jn11_images_with_captions", "SELECT l.doc_id, count(*) AS n FROM labels l JOIN conversations c ON c.conv_id = l.doc_id GROUP BY l.doc_id")
def jn11_images_with_captions(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id").join(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


@register("set1_split_union", "SELECT split, count(*) AS n FROM (SELECT 'val' AS split FROM labels UNION ALL SELECT 'test' FROM benchmark) GROUP BY split")
def set1_split_union(spark, sf_dir):
    a = table(spark, sf_dir, "labels").select(F.lit("val").alias("split"))
    return a.unionByName(table(spark, sf_dir, "benchmark").select(F.lit("test").alias("split"))).groupBy("split").agg(F.count("*").alias("n"))


@register("set3_file_union", "SELECT source AS name FROM documents UNION SELECT 'src' || item_id FROM benchmark")
def set3_file_union(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("name"))
    return _documents(spark, sf_dir).select(F.col("source").alias("name")).union(b).distinct()


@register("set4_dedupe_by_content", f"WITH {_SPLIT_DOCS} SELECT doc_id, split FROM (SELECT doc_id, split, row_number() OVER (PARTITION BY sha256(text) ORDER BY {_PRIORITY}, doc_id) AS k FROM sd) WHERE k = 1")
def set4_dedupe_by_content(spark, sf_dir):
    return corpus.drop_duplicates_by_content(_split_documents(spark, sf_dir), "text", "doc_id").select("doc_id", "split")


@register("set5_duplicate_groups", f"WITH {_SPLIT_DOCS} SELECT sha256(text) AS sha, count(*) AS n, count(DISTINCT split) AS n_splits, arg_min(doc_id, ({_PRIORITY}, doc_id)) AS kept, count(*) - 1 AS removed FROM sd GROUP BY 1 HAVING count(*) > 1")
@register("met27_duplicate_report", f"WITH {_SPLIT_DOCS} SELECT sha256(text) AS sha, count(*) AS n, count(DISTINCT split) AS n_splits, arg_min(doc_id, ({_PRIORITY}, doc_id)) AS kept, count(*) - 1 AS removed FROM sd GROUP BY 1 HAVING count(*) > 1")
def set5_duplicate_groups(spark, sf_dir):
    return corpus.duplicate_groups(_split_documents(spark, sf_dir), "text", "doc_id")


_TWO_DOMAINS = f"va AS (SELECT {_DOMAIN} AS value FROM pages), vb AS (SELECT {_DOMAIN} AS value FROM pages WHERE {_U.format(key='page_id', seed=42)} < 0.6), ca AS (SELECT value, count(*) AS na FROM va WHERE value <> '' GROUP BY value), cb AS (SELECT value, count(*) AS nb FROM vb WHERE value <> '' GROUP BY value)"


def _domains(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All pages, and those a download would have retained: a hash sample of six tenths."""
    p = table(spark, sf_dir, "pages").withColumn("value", text.url_domain(F.col("url")))
    return p.select("value"), p.filter(text.hash_uniform(F.col("page_id"), 42) < 0.6).select("value")


@register("set6_domain_union", f"WITH {_TWO_DOMAINS} SELECT coalesce(ca.value, cb.value) AS value, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM ca FULL JOIN cb ON ca.value = cb.value")
def set6_domain_union(spark, sf_dir):
    return corpus.joined_counts(*_domains(spark, sf_dir))


@register("met18_domain_distance", f"WITH {_TWO_DOMAINS} SELECT round(sum(abs(na / (SELECT sum(na) FROM ca) - coalesce(nb, 0) / (SELECT sum(nb) FROM cb))) / 2, 6) AS half_l1 FROM (SELECT * FROM ca ORDER BY na DESC, value LIMIT 50) t LEFT JOIN cb ON t.value = cb.value")
def met18_domain_distance(spark, sf_dir):
    return rounded(corpus.share_distance(*_domains(spark, sf_dir)))


@register("top13_common_domains", f"SELECT value, count(*) AS n FROM (SELECT {_DOMAIN} AS value FROM pages) WHERE value <> '' GROUP BY value ORDER BY n DESC, value LIMIT 15")
def top13_common_domains(spark, sf_dir):
    return corpus.top_values(table(spark, sf_dir, "pages"), text.url_domain(F.col("url")), 15)


@register("met19_languages", "SELECT lang AS value, count(*) AS n FROM documents WHERE lang <> '' GROUP BY lang ORDER BY n DESC, value LIMIT 10")
def met19_languages(spark, sf_dir):
    return corpus.top_values(_documents(spark, sf_dir), F.col("lang"), 10)


@register("met20_split_counts", f"WITH {_SPLIT_DOCS} SELECT split, count(*) AS n FROM sd GROUP BY split")
@register("aux10_count_by_split", f"WITH {_SPLIT_DOCS} SELECT split, count(*) AS n FROM sd GROUP BY split")
def met20_split_counts(spark, sf_dir):
    return _split_documents(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"))


@register("top14_split_order", f"WITH {_SPLIT_DOCS} SELECT split, count(*) AS n, row_number() OVER (ORDER BY split = 'train', count(*), split)::INT AS place FROM sd GROUP BY split")
def top14_split_order(spark, sf_dir):
    c = _split_documents(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"))
    # four rows at most: a single-partition window over split names
    return c.withColumn("place", F.row_number().over(Window.orderBy(F.col("split") == "train", "n", "split")))


@register("top15_canonical_order", f"WITH {_SPLIT_DOCS}, {_STEMS} SELECT split, stem FROM st ORDER BY {_PRIORITY}, stem")
def top15_canonical_order(spark, sf_dir):
    d = corpus.number_stems(_split_documents(spark, sf_dir), "doc_id")
    return d.orderBy(corpus.split_priority(F.col("split")), "stem").select("split", "stem")


@register("met16_describe", "SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, " + ", ".join(f"round(quantile_cont(n_chars, {q}), 6) AS p{round(q * 100)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) + " FROM documents GROUP BY lang")
def met16_describe(spark, sf_dir):
    return rounded(metrics.describe(_documents(spark, sf_dir), "n_chars", ["lang"]))


@register("met17_ks", "WITH v AS (SELECT n_chars::DOUBLE AS x, 1 AS i, 0 AS j FROM documents UNION ALL SELECT length(text), 0, 1 FROM benchmark), c AS (SELECT x, sum(i) AS i, sum(j) AS j FROM v GROUP BY x), r AS (SELECT sum(i) OVER (ORDER BY x) / (SELECT sum(i) FROM c) - sum(j) OVER (ORDER BY x) / (SELECT sum(j) FROM c) AS gap FROM c) SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM benchmark) AS m, round(max(abs(gap)), 6) AS ks FROM r")
def met17_ks(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.length("text").alias("x"))
    return rounded(metrics.ks_statistic(_documents(spark, sf_dir).select(F.col("n_chars").alias("x")), b, "x").drop("p_value"))


@register("met28_disjoint_stems", f"WITH {_SPLIT_DOCS}, {_STEMS} SELECT split, stem, count(*) AS count FROM st GROUP BY split, stem HAVING count(*) > 1")
def met28_disjoint_stems(spark, sf_dir):
    return corpus.repeated_keys(corpus.number_stems(_split_documents(spark, sf_dir), "doc_id"), "split", "stem")


@register("smp1_exact_sample", f"SELECT doc_id FROM documents ORDER BY {_U.format(key='doc_id', seed=42)}, doc_id LIMIT 100")
@register("smp7_subsample", f"SELECT doc_id FROM documents ORDER BY {_U.format(key='doc_id', seed=42)}, doc_id LIMIT 100")
def smp1_exact_sample(spark, sf_dir):
    return corpus.sample_exactly(_documents(spark, sf_dir).select("doc_id"), "doc_id", 100)


@register("smp2_early_stop", f"SELECT doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 200) ORDER BY {_U.format(key='doc_id', seed=42)}, doc_id LIMIT 50")
def smp2_early_stop(spark, sf_dir):
    first = _documents(spark, sf_dir).filter("lang = 'en'").select("doc_id").orderBy("doc_id").limit(200)
    return corpus.sample_exactly(first, "doc_id", 50)


@register("smp3_split", f"WITH {_SPLIT_DOCS} SELECT doc_id, split FROM sd")
def smp3_split(spark, sf_dir):
    return _split_documents(spark, sf_dir).select("doc_id", "split")


@register("smp4_stems", f"WITH {_SPLIT_DOCS}, {_STEMS} SELECT doc_id, split, stem FROM st")
def smp4_stems(spark, sf_dir):
    return corpus.number_stems(_split_documents(spark, sf_dir), "doc_id").select("doc_id", "split", "stem")


@register("smp5_calibration_head", f"WITH {_SPLIT_DOCS} SELECT doc_id FROM sd WHERE split = 'train' ORDER BY doc_id LIMIT 5000")
def smp5_calibration_head(spark, sf_dir):
    return _split_documents(spark, sf_dir).filter("split = 'train'").select("doc_id").orderBy("doc_id").limit(5000)


@register("aux16_calibration_conversion", f"WITH {_SPLIT_DOCS} SELECT doc_id, split FROM sd UNION ALL (SELECT doc_id, 'train_calib' AS split FROM sd WHERE split = 'train' ORDER BY doc_id LIMIT 5000)")
def aux16_calibration_conversion(spark, sf_dir):
    return source.experiment_splits(_split_documents(spark, sf_dir).select("doc_id", "split"), "doc_id")


@register("smp6_shuffle", f"WITH {_SPLIT_DOCS} SELECT doc_id, round({_U.format(key='doc_id', seed=1)}, 6) AS u FROM sd WHERE split = 'train'")
def smp6_shuffle(spark, sf_dir):
    d = _split_documents(spark, sf_dir).filter("split = 'train'").withColumn("u", text.hash_uniform(F.col("doc_id"), 1))
    return rounded(d.select("doc_id", "u").orderBy("u"))


@register("smp8_range_shards", "SELECT doc_id, (doc_id // ceil((SELECT count(*) FROM documents) / 8)::BIGINT)::INT AS shard FROM documents")
def smp8_range_shards(spark, sf_dir):
    d = _documents(spark, sf_dir)
    return corpus.shards(d.select("doc_id"), "doc_id", 8, d.count())


@register("smp9_round_robin", "SELECT doc_id, (doc_id % 4)::INT AS worker FROM documents")
def smp9_round_robin(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", (F.col("doc_id") % 4).cast("int").alias("worker"))


@register("snk8_sampled_rows", f"WITH {_META}, s AS (SELECT doc_id FROM documents ORDER BY {_U.format(key='doc_id', seed=42)}, doc_id LIMIT 100) SELECT md.url, length(md.text)::INT AS caption_len, '{{\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || '}}' AS laion_meta FROM md JOIN s USING (doc_id)")
def snk8_sampled_rows(spark, sf_dir):
    m = _metadata(spark, sf_dir).withColumnsRenamed({"LANGUAGE": "lang", "WIDTH": "n_chars"})
    return corpus.sample_exactly(m, "doc_id", 100).select(F.col("URL").alias("url"), F.length("TEXT").alias("caption_len"), text.pack_json(["lang", "n_chars"]).alias("laion_meta"))


@register("snk9_manifest_checksum", f"""WITH {_SPLIT_DOCS}, {_STEMS}, l AS (SELECT {_PRIORITY} AS o, stem, '"' || split || '","' || stem || '","' || sha256(text) || '"' AS line FROM st) SELECT sha256('split,stem,caption_sha256' || chr(10) || string_agg(line, chr(10) ORDER BY o, stem) || chr(10)) AS sha256 FROM l""")
def snk9_manifest_checksum(spark, sf_dir):
    d = corpus.number_stems(_split_documents(spark, sf_dir), "doc_id")
    m = corpus.manifest(d.select("split", "stem", F.encode("text", "utf-8").alias("image"), F.col("text").alias("caption")))
    return sinks.csv_checksum(m.select("split", "stem", "caption_sha256")).select("sha256")


@register("snk10_dedupe_report", f"WITH {_SPLIT_DOCS}, g AS (SELECT sha256(text) AS s, count(*) AS n, count(DISTINCT split) AS k FROM sd GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS groups, sum(n - 1)::BIGINT AS removed, count(*) FILTER (WHERE k > 1) AS cross_split FROM g")
def snk10_dedupe_report(spark, sf_dir):
    g = corpus.duplicate_groups(_split_documents(spark, sf_dir), "text", "doc_id")
    return g.agg(F.count("*").alias("groups"), F.sum("removed").alias("removed"), F.count_if(F.col("n_splits") > 1).alias("cross_split"))


@register("snk11_merged_shards", "SELECT doc_id, row_number() OVER (ORDER BY doc_id % 2, doc_id) - 1 AS idx FROM documents")
def snk11_merged_shards(spark, sf_dir):
    d = _documents(spark, sf_dir)
    part = lambda k: d.filter(F.col("doc_id") % 2 == k).select("doc_id", F.floor(F.col("doc_id") / 2).alias("idx"))
    return sinks.merged_shards([part(0), part(1)])


@register("aux9_max_stem", f"WITH {_SPLIT_DOCS}, {_STEMS} SELECT split, max(stem::BIGINT) AS max_stem FROM st GROUP BY split")
def aux9_max_stem(spark, sf_dir):
    return corpus.max_numeric_stem(corpus.number_stems(_split_documents(spark, sf_dir), "doc_id"))


@register("udf11_caption_ids", "SELECT 'set_test_' || conv_id AS image_id, 'set_test_' || conv_id || '_cap' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS caption_id, length(text)::INT AS n FROM conversations")
def udf11_caption_ids(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("idx")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x.text).alias("sentences"))
    return source.exploded_captions(c, "set_test_").select("image_id", "caption_id", F.length("caption").alias("n"))


@register("udf1_hashing_embeddings")
def udf1_hashing_embeddings(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    v = embed.embed_column(b, "text")
    return rounded(v.select("item_id", F.size("v").alias("dim"), vectors.norm(F.col("v")).alias("norm"), F.col("v")[0].alias("v1")))


@register("udf10_caption_bank", "SELECT 'bench_test_' || item_id || '_cap0' AS id, item_id AS idx, 'test' AS split, 'text' AS modality, 64 AS dim FROM benchmark")
def udf10_caption_bank(spark, sf_dir):
    c = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("bench_test_"), F.col("item_id").cast("string"), F.lit("_cap0")).alias("caption_id"), F.col("item_id").alias("ordinal"), F.col("text").alias("caption"))
    return embed.embed_captions(c, "bench", "test").select("id", "idx", "split", "modality", F.size("v").alias("dim"))


@register(
    "udf10_image_text_split",
    """WITH i AS (SELECT 'pages_test_' || page_id AS id, row_number() OVER (ORDER BY page_id) - 1 AS idx, 'image' AS modality FROM pages),
c AS (SELECT 'pages_test_' || page_id || '_cap' || j AS id, row_number() OVER (ORDER BY page_id, j) - 1 AS idx, 'text' AS modality FROM pages, (SELECT unnest([0, 1]) AS j))
SELECT id, idx, modality, 'test' AS split, 1.0::DOUBLE AS norm FROM i UNION ALL SELECT id, idx, modality, 'test', 1.0::DOUBLE FROM c""",
)
def udf10_image_text_split(spark, sf_dir):
    """Pages as samples: the bytes of the url as the image, the url and its host as captions."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("idx"), F.encode("url", "utf-8").alias("image"), F.array(F.col("url"), F.coalesce(text.url_domain(F.col("url")), F.lit(""))).alias("sentences"))
    bank = embed.split_bank(p, "pages", "test")
    return rounded(bank.select("id", "idx", "modality", "split", vectors.norm(F.col("v")).alias("norm")))


_TYPES = ", ".join(f"('{k}', '{m.name}', '{m.library}', '{m.dtype}', {m.batch}, '{m.modality}')" for k, m in embed.SPECS.items())


@register("udf9_model_types", f"SELECT * FROM (VALUES {_TYPES}) t(kind, model_name, library, dtype, batch, modality)")
def udf9_model_types(spark, sf_dir):
    rows = [(k, m.name, m.library, m.dtype, m.batch, m.modality) for k, m in embed.SPECS.items()]
    return spark.createDataFrame(rows, "kind string, model_name string, library string, dtype string, batch int, modality string")


@register("aux12_meta_map", "SELECT doc_id, lang AS language FROM documents")
def aux12_meta_map(spark, sf_dir):
    d = _documents(spark, sf_dir).select("doc_id", F.create_map(F.lit("language"), "lang").alias("meta"))
    return d.select("doc_id", F.coalesce("meta", F.create_map().cast("map<string,string>"))["language"].alias("language"))


