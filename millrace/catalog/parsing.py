"""Sources, routing, parsing and the cache of parsed text."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import frames, query
from millrace.catalog import sql as q
from millrace.operators import parse
from millrace.sources import files, tables

# --- sources --------------------------------------------------------------


@query(
    sql="SELECT lang, source, count(*) AS n_docs, sum(strlen(text))::BIGINT AS n_bytes FROM documents GROUP BY lang, source"
)
def table_source(spark, sf_dir):
    docs = tables.table_source(spark, f"{sf_dir}/documents.parquet", ["text", "lang", "source"])
    return docs.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.octet_length("text").cast("bigint")).alias("n_bytes")
    )


@query()
def source_listing(spark, sf_dir):
    return files.source_listing(spark, sf_dir, glob="*.parquet").select("source_id", "name", "suffix", "length")


@query()
def fetch_changed(spark, sf_dir):
    listing = files.source_listing(spark, sf_dir, glob="*.parquet")
    fetched = files.fetch_changed(listing.repartition("path"))
    return fetched.select("name", "length", F.octet_length("content").cast("bigint").alias("fetched"), "fetch_error")


@query(
    sql=q.build(
        "SELECT path, length FROM docs WHERE path GLOB '*1.txt' OR path GLOB '/docs/src[2-4]/*' OR path GLOB '/docs/src?/*9.txt'",
        q.DOCS,
    )
)
def glob_filter(spark, sf_dir):
    docs = frames.documents(spark, sf_dir)
    return files.glob_filter(docs, "path", ["*1.txt", "/docs/src[2-4]/*", "/docs/src?/*9.txt"]).select("path", "length")


@query(sql=q.build("SELECT path, length FROM docs WHERE length <= 2000", q.DOCS))
def size_limit_filter(spark, sf_dir):
    return files.size_limit_filter(frames.documents(spark, sf_dir), 2000).select("path", "length")


@query(
    sql=q.build(
        "SELECT 0 AS source_no, path, length, NULL::VARCHAR AS url FROM docs UNION ALL "
        "SELECT 1, '/pages/' || page_id || '.html', strlen(html)::BIGINT, url FROM pages UNION ALL "
        "SELECT 2, '/talks/' || conv_id || '/' || turn || '.md', strlen(text)::BIGINT, NULL FROM conversations",
        q.DOCS,
    )
)
def union_sources(spark, sf_dir):
    docs = frames.documents(spark, sf_dir).select("path", "length")
    pages = frames.table(spark, sf_dir, "pages", ["page_id", "url", "html"]).select(
        F.format_string("/pages/%d.html", "page_id").alias("path"),
        F.octet_length("html").cast("bigint").alias("length"),
        "url",
    )
    talks = frames.table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"]).select(
        F.format_string("/talks/%d/%d.md", "conv_id", "turn").alias("path"),
        F.octet_length("text").cast("bigint").alias("length"),
    )
    return files.union_sources(docs, pages, talks).select("source_no", "path", "length", "url")


# --- routing --------------------------------------------------------------

SUFFIXES = ["", ".txt", ".md", ".PDF", ".png", ".jpeg", ".mp3", ".wav", ".mp4", ".mkv", ".docx", ".html", ".pdf"]
RULES = [
    {"match": ["src1-*.pdf", "*.jpeg"], "type": "vision_slide"},
    {"match": ["src[23]-*1.*"], "type": "skip", "options": {"reason": "archive"}},
    {"match": ["src?-*.md", "x.mp?"], "type": "unstructured"},
]
ENV = {"docling": True, "openai_key": True}


def _named(spark, sf_dir):
    docs = frames.table(spark, sf_dir, "documents", ["doc_id", "source"], "doc_id")
    suffix = F.get(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("doc_id") % len(SUFFIXES)).cast("int"))
    # Every source 7 object comes without a name.
    name = F.when(F.col("source") == "src7", F.lit("")).otherwise(
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), suffix)
    )
    return docs.select("doc_id", suffix.alias("suffix"), name.alias("name"))


_SUFFIX_LIST = "[" + ", ".join(f"'{s}'" for s in SUFFIXES) + "]"
ROUTED = [
    f"named AS (SELECT doc_id, source, {_SUFFIX_LIST}[doc_id % {len(SUFFIXES)} + 1] AS suffix FROM documents)",
    "called AS (SELECT doc_id, suffix, CASE WHEN source = 'src7' THEN 'x' || suffix ELSE source || '-' || doc_id || suffix END AS name FROM named)",
    "routed AS (SELECT *, "
    "CASE WHEN lower(suffix) IN ('', '.txt', '.md') THEN 'text' WHEN lower(suffix) = '.pdf' THEN 'pdf' "
    "WHEN lower(suffix) IN ('.png', '.jpeg') THEN 'image' WHEN lower(suffix) IN ('.mp3', '.wav') THEN 'audio' "
    "WHEN lower(suffix) IN ('.mp4', '.mkv') THEN 'video' ELSE 'office' END AS modality FROM called)",
    "parsed AS (SELECT *, CASE WHEN name GLOB 'src1-*.pdf' OR name GLOB '*.jpeg' THEN 'vision_slide' "
    "WHEN name GLOB 'src[23]-*1.*' THEN 'skip' WHEN name GLOB 'src?-*.md' OR name GLOB 'x.mp?' THEN 'unstructured' "
    "WHEN modality = 'text' THEN 'utf8' WHEN modality = 'pdf' THEN 'docling' WHEN modality = 'audio' THEN 'whisper' "
    "WHEN modality IN ('image', 'video') THEN 'skip' ELSE 'unstructured' END AS parser FROM routed)",
    "reasoned AS (SELECT doc_id, modality, parser, CASE WHEN parser <> 'skip' THEN NULL WHEN name GLOB 'src[23]-*1.*' THEN 'archive' "
    "WHEN modality = 'image' THEN 'images: no OCR package installed' ELSE 'video: no video key set' END AS skip_reason FROM parsed)",
]


@query(sql=q.build("SELECT doc_id, modality, parser, skip_reason FROM reasoned", ROUTED))
def parser_route(spark, sf_dir):
    routed = parse.parser_route(_named(spark, sf_dir), RULES, ENV)
    return routed.select("doc_id", "modality", "parser", "skip_reason")


@query(
    sql=q.build(
        "SELECT parser, skip_reason, count(*) AS n_files FROM reasoned WHERE parser = 'skip' GROUP BY parser, skip_reason",
        ROUTED,
    )
)
def parse_skip_report(spark, sf_dir):
    return parse.parse_skip_report(parse.parser_route(_named(spark, sf_dir), RULES, ENV))


# --- parsing --------------------------------------------------------------


@query(sql="SELECT doc_id, text || chr(65533) AS text FROM documents")
def parse_utf8(spark, sf_dir):
    docs = frames.table(spark, sf_dir, "documents", ["doc_id", "text"], "doc_id")
    # Each document's bytes end in one byte that is not UTF-8.
    content = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))
    return parse.parse_utf8(docs.select("doc_id", content.alias("content"))).select("doc_id", "text")


_BLOCKS = (
    "p|div|br|hr|h[1-6]|li|ul|ol|tr|table|article|section|header|footer|nav|main|title|head|body|html|blockquote|pre"
)


def _html_sql() -> str:
    t = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    t = f"regexp_replace({t}, '(?is)<(?:script|style)\\b.*?</(?:script|style)[^>]*>', '', 'g')"
    t = f"regexp_replace({t}, '(?i)</?(?:{_BLOCKS})\\b[^>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', '', 'g')"
    pairs = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]
    for entity, char in pairs:
        t = f"replace({t}, '{entity}', '{char}')"
    t = f"regexp_replace({t}, '[ \\t\\r\\f]+', ' ', 'g')"
    return q.strip(f"regexp_replace({t}, ' ?\\n[ \\n]*', chr(10), 'g')")


@query(sql=f"SELECT page_id, {_html_sql()} AS text FROM pages")
def parse_html(spark, sf_dir):
    pages = frames.table(spark, sf_dir, "pages", ["page_id", "html"], "page_id")
    return parse.parse_html(pages).select("page_id", "text")


@query(
    sql="SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10) || chr(10))) AS text_md5 FROM documents"
)
def parse_concat_elements(spark, sf_dir):
    docs = frames.table(spark, sf_dir, "documents", ["doc_id", "text"], "doc_id")
    elements = F.transform(
        F.split("text", "\n"), lambda line: F.struct(line.alias("text"), F.length(line).cast("string").alias("meta"))
    )
    parsed = parse.parse_concat_elements(docs.select("doc_id", elements.alias("elements")))
    return parsed.select("doc_id", F.md5("text").alias("text_md5"))


@query(
    sql=q.build(
        "SELECT n.path, o.path IS NOT NULL AS cached, CASE WHEN o.path IS NOT NULL THEN md5(o.text) END AS text_md5 "
        "FROM new_docs n LEFT JOIN old_docs o ON o.path = n.path AND o.length = n.length AND o.mtime = n.mtime",
        q.BEFORE_AFTER,
    )
)
def parse_cache(spark, sf_dir):
    old, new = frames.before_and_after(spark, sf_dir)
    route = F.lit("utf8").alias("route")
    cache = old.select("path", "length", "mtime", route, "text")
    listing = new.select("path", "length", "mtime", route)
    hits, misses = parse.parse_cache(listing, cache)
    none = F.lit(None).cast("string").alias("text_md5")
    return hits.select("path", F.lit(True).alias("cached"), F.md5("text").alias("text_md5")).unionByName(
        misses.select("path", F.lit(False).alias("cached"), none)
    )


@query(
    sql=q.build(
        "SELECT doc_id AS entry_id, size_bytes, bytes_kept FROM (SELECT doc_id, length AS size_bytes, "
        "(sum(length) OVER (ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS bytes_kept FROM docs) "
        "WHERE bytes_kept <= 1500000",
        q.DOCS,
    )
)
def cache_evict_lru(spark, sf_dir):
    # The character count stands in for the time of last use; it repeats.
    docs = frames.documents(spark, sf_dir, "n_chars")
    cache = docs.select(
        F.col("doc_id").alias("entry_id"), F.col("n_chars").alias("last_used"), F.col("length").alias("size_bytes")
    )
    return parse.cache_evict_lru(cache, 1_500_000).select("entry_id", "size_bytes", "bytes_kept")
