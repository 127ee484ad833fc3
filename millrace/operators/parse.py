"""Routing files to parsers, parsing them to text, and the cache of parsed text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.plans.running import running

# File suffixes by modality; all others are office documents.
MODALITY_SUFFIXES = {
    "text": [".txt", ".md", ".markdown", ".text", ""],
    "pdf": [".pdf"],
    "image": [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"],
    "audio": [".mp3", ".wav", ".m4a", ".flac", ".ogg", ".aac"],
    "video": [".mp4", ".webm", ".mov", ".mkv", ".avi"],
}


def default_parsers(env: dict[str, bool]) -> dict[str, tuple[str, str | None]]:
    """Parser (and skip reason) per modality for the given environment.

    ``env`` says what is at hand: ``docling``, ``paddleocr`` (packages),
    ``openai_key``, ``twelvelabs_key`` (credentials).
    """
    def need(flag: str, parser: str, reason: str) -> tuple[str, str | None]:
        return (parser, None) if env.get(flag) else ("skip", reason)

    return {
        "text": ("utf8", None),
        "pdf": ("docling" if env.get("docling") else "pypdf", None),
        "image": need("paddleocr", "paddle_ocr", "images: no OCR package installed"),
        "audio": need("openai_key", "whisper", "audio: no transcription key set"),
        "video": need("twelvelabs_key", "twelvelabs_video", "video: no video key set"),
        "office": ("unstructured", None),
    }


def modality(suffix: Column) -> Column:
    out = F.lit("office")
    for name, suffixes in MODALITY_SUFFIXES.items():
        out = F.when(F.lower(suffix).isin(suffixes), F.lit(name)).otherwise(out)
    return out


def parser_route(files: DataFrame, rules: list[dict] | None = None, env: dict | None = None) -> DataFrame:
    """Add ``modality``, ``parser`` and ``skip_reason``.

    The first rule with a matching name pattern wins (a nameless file is
    called ``x`` plus its suffix); otherwise the modality's default applies.
    ``files`` needs ``name`` and ``suffix``.
    """
    name = F.when(F.coalesce(F.col("name"), F.lit("")) != "", F.col("name")).otherwise(
        F.concat(F.lit("x"), F.col("suffix"))
    )
    kind = modality(F.col("suffix"))
    parser, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for mod, (default, why) in default_parsers(env or {}).items():
        parser = F.when(kind == mod, F.lit(default)).otherwise(parser)
        reason = F.when(kind == mod, F.lit(why).cast("string")).otherwise(reason)
    for rule in reversed(rules or []):
        hit = tx.matches_any(name, rule["match"])
        why = None
        if rule["type"] == "skip":
            why = rule.get("options", {}).get("reason", "no parser configured")
        parser = F.when(hit, F.lit(rule["type"])).otherwise(parser)
        reason = F.when(hit, F.lit(why).cast("string")).otherwise(reason)
    return files.withColumns({"modality": kind, "parser": parser, "skip_reason": reason})


def parse_utf8(files: DataFrame) -> DataFrame:
    """Bytes as text; malformed bytes become the replacement character."""
    return files.withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))


def parse_html(files: DataFrame, column: str = "html") -> DataFrame:
    return files.withColumn("text", tx.html_text(F.col(column)))


def parse_concat_elements(docs: DataFrame, column: str = "elements") -> DataFrame:
    """Join the non-empty element texts of a document with a blank line."""
    texts = F.filter(F.transform(F.col(column), lambda e: e["text"]), lambda t: t.isNotNull() & (t != ""))
    return docs.withColumn("text", F.array_join(texts, "\n\n"))


def parse_documents(routed: DataFrame, custom: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Text of every fetched file by its route.

    ``utf8`` and HTML are native; any other parser is a function from the
    content column to a text column (usually a pandas UDF) given in
    ``custom``. Skipped, failed or unparsed files get the empty text;
    ``parse_error`` says why the last two have none.
    """
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    text = F.when(F.col("parser") == "utf8", raw).when(
        (F.col("parser") == "unstructured") & F.col("suffix").isin(".html", ".htm"), tx.html_text(raw)
    )
    for parser, fn in (custom or {}).items():
        text = text.when(F.col("parser") == parser, fn(F.col("content")))
    served = (F.col("parser") == "utf8") | F.col("parser").isin("skip", *(custom or {}))
    served = served | ((F.col("parser") == "unstructured") & F.col("suffix").isin(".html", ".htm"))
    error = F.when(~F.coalesce(served, F.lit(False)), F.concat(F.lit("no function for parser "), F.coalesce("parser", F.lit("(none)"))))
    if "fetch_error" in routed.columns:
        error = F.coalesce(F.when(F.col("parser") != "skip", F.col("fetch_error")), error)
    return routed.withColumns({"parse_error": error, "text": F.coalesce(text, F.lit(""))})


def parse_skip_report(routed: DataFrame) -> DataFrame:
    """One row per parser and reason of the files that will have no text."""
    return (
        routed.where(F.col("parser") == "skip")
        .groupBy("parser", "skip_reason")
        .agg(F.count(F.lit(1)).alias("n_files"))
    )


CACHE_KEY = ["path", "length", "mtime", "route"]


def parse_cache(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a listing into (files with their cached text, files to parse).

    A cached text counts only for the same path, length, modification time
    and parser route.
    """
    hits = files.join(cache.select(*CACHE_KEY, "text"), CACHE_KEY)
    misses = files.join(cache.select(*CACHE_KEY), CACHE_KEY, "left_anti")
    return hits, misses


_MAX_TIME = (1 << 40) - 1


def cache_evict_lru(cache: DataFrame, max_bytes: int, entry: str = "entry_id") -> DataFrame:
    """The most recently used entries that fit into ``max_bytes``.

    ``cache`` has a unique non-negative BIGINT ``entry``, ``last_used``
    (epoch seconds) and ``size_bytes``; equal times are taken by ``entry``.
    """
    aged = cache.withColumn("_age", F.lit(_MAX_TIME) - F.col("last_used"))
    by_time = aged.groupBy("_age").agg(F.sum("size_bytes").alias("_time_bytes"))
    newer = running(by_time, "_age", {"_newer": ("sum", "_time_bytes")}, inclusive=False)
    same = running(aged, entry, {"_same": ("sum", "size_bytes")}, by=("_age",))
    return (
        same.join(newer.select("_age", "_newer"), "_age")
        .withColumn("bytes_kept", F.col("_newer") + F.col("_same"))
        .where(F.col("bytes_kept") <= max_bytes)
        .select(*cache.columns, "bytes_kept")
    )
