"""The operators of this folder as queries over the given tables, with SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    chat_format,
    fingerprints,
    html_text,
    jaccard,
    langid,
    mixing,
    pii,
    prefix_trie,
    quality,
    secrets,
    tiling,
    url_rules,
    variants,
)
from millrace.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PROBE = "\\### Assistant: </turn> ok"  # fixed by the query's definition
PII_KEY = "pseudonyms-1"

# (host, path, verdict): fixed by the query's definition.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations", ("conv_id", "turn", "role", "text"))
    turns = [
        F.struct(F.lit(-7).cast("bigint"), F.lit(i).cast("bigint"), F.lit(role), F.lit(PROBE))
        for i, role in enumerate(("user", "assistant"))
    ]
    probe = spark.range(1).select(F.inline(F.array(*turns))).toDF("conv_id", "turn", "role", "text")
    return chat_format.conversation_digests(chat_format.prefix_targets(given.unionByName(probe)))


ORACLES["op1_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(replace(replace(replace(role || text, '\', '\\'), '<', '\<'), '>', '\>')) + 16 AS chars
  FROM turns
), placed AS (
  SELECT *,
    sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS so_far,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM sized
), summed AS (
  SELECT conv_id,
    count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS said,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS trained,
    sum(so_far) FILTER (role = 'assistant' OR pos = n) AS formatted_chars,
    count(*) FILTER (role = 'assistant' OR pos = n) AS n_examples
  FROM placed GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(trained) AS BIGINT) AS loss_chars,
  sha256(trained) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars, n_examples
FROM summed
"""


@register
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_cascade(table(spark, sf_dir, "documents", ("doc_id", "text")), report=True)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept"
    )


ORACLES["op5_quality"] = r"""
WITH worded AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, struct_pack(a := words[i], b := words[i + 1], c := words[i + 2]) AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM worded)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) AS r(k) GROUP BY doc_id
), measured AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
  FROM worded LEFT JOIN repeats USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > word_chars
    OR 10 * n_dup_lines > 4 * n_lines OR 10 * n_capitals > 4 * word_chars) AS kept
FROM measured
"""


@register
def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", ("page_id", "url"))
    judged = url_rules.url_verdicts(pages, url_rules.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


ORACLES["op7_url_rules"] = (
    "WITH rules(host, path, verdict) AS (VALUES " + ", ".join(map(repr, URL_RULES)) + ")"
    r"""
, parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages
), fits AS (
  SELECT p.page_id, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, r.verdict DESC) AS pos
  FROM parts p JOIN rules r
    ON starts_with(p.path, r.path) AND (p.host = r.host OR ends_with(p.host, '.' || r.host))
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.pos = 1
"""
)


@register
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.pseudonymize(table(spark, sf_dir, "documents", ("doc_id", "text")), PII_KEY)
    counts = [F.get("pii_counts", i).alias(f"n_{k.name}") for i, k in enumerate(pii.KINDS)]
    return docs.select("doc_id", "text", *counts)


@register
def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ("doc_id", "text", "lang"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    profiles = langid.fit_profiles(docs.where(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), profiles, keep_text=False)


@register
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ("doc_id", "text"))
    found = secrets.scan_secrets(docs, secrets.fit_formats(docs), keep_text=False)
    base = F.filter("secret_spans", lambda s: s["kind"] != secrets.FORMAT)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}") for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))


@register
def op6_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ("doc_id", "text"))
    return tiling.tile_matches(docs, table(spark, sf_dir, "benchmark", ("item_id", "text")))


@register
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.production_mix(table(spark, sf_dir, "documents", ("doc_id", "text", "lang", "source")))


@register
def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", ("page_id", "url", "html"))
    out = html_text.extract_text(pages, html_text.fit_blocks(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@register
def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents", ("doc_id", "text")))


ORACLES["op8_jaccard"] = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(words[i:i + 4], ' ')) AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM worded WHERE len(words) > 0)
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
        FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN sizes a ON a.doc_id = p.a JOIN sizes b ON b.doc_id = p.b
  WHERE 100 * common >= 80 * (a.n + b.n - common)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""


@register
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations", ("conv_id", "turn", "role", "text")))


@register
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents", ("doc_id", "text")))


@register
def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ("doc_id", "text"))
    return variants.spelling_variants(variants.word_counts(docs))


# op11 and op13 hash with CRC-32, which DuckDB lacks, and op12's digests are no SQL: all three are held against
# brute-force versions in tests/llm.
