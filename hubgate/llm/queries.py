"""Registered queries of the operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, decontaminate, line_dedup, minhash_dedup, quality_rules, substring_dedup, token_count, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary(name: str) -> bytes:
    """A vocabulary file (some MB), read once on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


# The url rules of the contract.
URL_RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, similar=85)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = warc.archive_folder(pages)
    index = warc.build_index(warc.write_archive(pages, folder), folder)
    keys = pages.select(warc.capture_key(F.col("url"), F.col("page_id")))
    return warc.read_archive(keys, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN, decoded_col="decoded")
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    rendered = chat_format.render(turns)
    back = chat_format.read_back(rendered)
    turns_text = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("targets", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns_text, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_count.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"), "json")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def learned_rules(docs: DataFrame, labels: DataFrame) -> quality_rules.DecisionList:
    return quality_rules.learn(quality_rules.labelled_rows(docs, labels))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learned_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_base_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the base rules of operator 10 see, without a learned list."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), quality_rules.DecisionList(()))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_line_dedup": op4_line_dedup,
    "op5_warc": op5_warc,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_chat_format": op7_chat_format,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_count": op9_token_count,
    "op10_quality_rules": op10_quality_rules,
    "quality_base_statistics": quality_base_statistics,
}

_URL_PARTS = """
p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id,
             translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p)
"""

#: Base 32 of a SHA-1 in hexadecimal (column d): eight groups of five digits, four characters each.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(d, {5 * g + 1}, 5))::INT >> {s}) & 31), 1)" for g in range(8) for s in (15, 10, 5, 0)
)

ORACLES = {
    "op1_url_filter": f"""
WITH {_URL_PARTS},
r(v, h, d) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT page_id, h || d AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || d) DESC, length(h) DESC) AS n
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, d))
SELECT u.page_id, host, path, m.rule, coalesce(m.v, 'allow') AS verdict FROM u LEFT JOIN m ON u.page_id = m.page_id AND m.n = 1
""",
    "op2_minhash_dedup": """
WITH RECURSIVE
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * m >= 85 * (x.n + y.n - m)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT u.b, r.c FROM r JOIN u ON r.doc_id = u.a WHERE r.c < u.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, g.c AS component_id, d.doc_id = g.c AS kept
FROM d JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) g ON d.doc_id = g.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
""",
    "op3_decontamination": """
WITH
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM benchmark),
z AS (SELECT item_id, len(ws) AS l, least(5, len(ws)) AS k FROM i WHERE len(ws) > 0),
ip AS (SELECT item_id, z.k, unnest(range(1, l - z.k + 2)) AS p FROM z),
ib AS (SELECT ip.item_id, ip.k, array_to_string(ws[p : p + ip.k - 1], ' ') AS sh, count(*) AS c FROM ip JOIN i ON ip.item_id = i.item_id GROUP BY ALL),
dp AS (SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM z)),
h AS (SELECT x.doc_id, ib.item_id, x.p, x.sh, ib.c FROM (SELECT dp.doc_id, dp.k, p, array_to_string(ws[p : p + dp.k - 1], ' ') AS sh FROM dp JOIN d ON dp.doc_id = d.doc_id) x JOIN ib ON x.k = ib.k AND x.sh = ib.sh),
w AS (SELECT DISTINCT h.doc_id, h.item_id, l, l - k + 1 AS pw, unnest(range(greatest(p - (l - k), 1), least(p, len(ws) - l + 1) + 1)) AS w FROM h JOIN z ON h.item_id = z.item_id JOIN d ON h.doc_id = d.doc_id),
f AS (SELECT w.doc_id, w.item_id, w, l, pw, sh, least(count(*), any_value(c)) AS n FROM w JOIN h ON w.doc_id = h.doc_id AND w.item_id = h.item_id AND p BETWEEN w AND w + pw - 1 GROUP BY w.doc_id, w.item_id, w, l, pw, sh),
m AS (SELECT doc_id, item_id, w, l, sum(n)::BIGINT AS n_common, 2 * any_value(pw) - sum(n)::BIGINT AS n_either FROM f GROUP BY doc_id, item_id, w, l),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_common / n_either DESC, w) AS r FROM m WHERE 100 * n_common >= 80 * n_either)
SELECT doc_id, item_id, w - 1 AS first_word, l AS n_words, n_common, n_either FROM b WHERE r = 1
""",
    "quality_base_statistics": """
WITH
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS k, len(ws) AS n FROM d),
v AS (SELECT r, k, n, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS seq FROM t),
c AS (SELECT r, k, count(*) OVER (PARTITION BY r, seq) AS times FROM v WHERE k + 4 <= n),
g AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(k, k + 5)) AS p FROM c WHERE times > 1) GROUP BY r),
s AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls, coalesce(g.n, 0) AS n_repeat_words FROM d LEFT JOIN g ON d.r = g.r)
SELECT doc_id, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s
""",
    "op4_line_dedup": """
WITH s AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
t AS (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM s),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM t),
f AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
j AS (SELECT k.*, (f.key IS NOT NULL AND k.doc_id <> f.holder) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
""",
    "op5_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS holder FROM p GROUP BY d)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = holder THEN NULL ELSE holder END AS refers_to
FROM p JOIN m USING (d)
""",
    "op7_chat_format": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'),
e AS (
  SELECT *, 13 + length(replace(replace(replace(replace(role, chr(92), chr(92) || 'b'), '###', chr(92) || 'h'), '</turn>', chr(92) || 't'), chr(10), chr(92) || 'n'))
              + length(replace(replace(replace(text, chr(92), chr(92) || 'b'), '###', chr(92) || 'h'), '</turn>', chr(92) || 't')) AS n FROM t),
s AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS ends,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back FROM e)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(ends) FILTER (WHERE role = 'assistant' OR back = 1)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
""",
    "op8_substring_dedup": """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k, len(ws) AS n FROM d),
v AS (SELECT doc_id, k, n, word, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS seq FROM t),
c AS (SELECT doc_id, k, count(*) OVER (PARTITION BY seq) AS times FROM v WHERE k + 34 <= n),
r AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS k FROM c WHERE times > 1),
j AS (SELECT t.doc_id, t.k, t.word, r.k IS NOT NULL AS gone FROM t LEFT JOIN r ON t.doc_id = r.doc_id AND t.k = r.k),
g AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (WHERE NOT gone) AS kept FROM j GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g ON d.doc_id = g.doc_id
""",
}
