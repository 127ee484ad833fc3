"""Cutting texts into chunks and giving each chunk its identity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as tx


def chunk_token_count(docs: DataFrame, size: int | None = 512, out: str = "chunks") -> DataFrame:
    """Add the array of consecutive runs of at most ``size`` tokens.

    A token is a run of non-blanks with the blanks after it. ``size=None``
    keeps the whole text as one chunk. An empty text has no chunks.
    """
    empty = F.array().cast("array<string>")
    if size is None:
        whole = F.when(F.coalesce(F.col("text"), F.lit("")) == "", empty).otherwise(F.array("text"))
        return docs.withColumn(out, whole)
    tokens = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(tx.SPACED_TOKEN), F.lit(0))
    # The token array is its own projection: inside the lambda it would be
    # built again for every chunk.
    tokenised = docs.withColumn("_tokens", tokens)
    starts = F.sequence(F.lit(1), F.size("_tokens"), F.lit(size))
    packed = F.transform(starts, lambda i: F.array_join(F.slice(F.col("_tokens"), i, F.lit(size)), ""))
    return tokenised.withColumn(out, F.when(F.size("_tokens") == 0, empty).otherwise(packed)).drop("_tokens")


def chunk_tail_merge(docs: DataFrame, min_chars: int = 100, column: str = "chunks") -> DataFrame:
    """Fold a last chunk shorter than ``min_chars`` into the one before it."""
    c = F.col(column)
    n = F.size(c)
    folded = F.concat(tx.rstrip(F.element_at(c, -2)), F.lit("\n"), F.element_at(c, -1))
    short_tail = (n >= 2) & (F.length(F.element_at(c, -1)) < min_chars)
    return docs.withColumn(
        column,
        F.when(short_tail, F.concat(F.slice(c, F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(folded))).otherwise(c),
    )


# Cut points from the best to the last resort.
SEPARATORS = ("\n\n", "\n", " ")


def _recursive_cuts(text: str, size: int, overlap: int) -> list[str]:
    pieces, start, n = [], 0, len(text)
    while n - start > size:
        end, cut = start + size, -1
        for sep in SEPARATORS:
            at = text.rfind(sep, start + overlap + 1, end)
            if at > 0:
                cut = at + len(sep)
                break
        cut = min(cut, end) if cut > 0 else end
        pieces.append(text[start:cut])
        # The next chunk starts at the first word inside the overlap.
        back = max(cut - overlap, start + 1)
        blank = text.find(" ", back, cut)
        start = blank + 1 if 0 <= blank < cut - 1 else (back if overlap else cut)
    if start < n:
        pieces.append(text[start:])
    return pieces


def chunk_recursive(docs: DataFrame, size: int = 512, overlap: int = 50, out: str = "chunks") -> DataFrame:
    """Cut at the best separator within ``size`` characters, with an overlap."""
    if not 0 <= overlap < size // 2:
        raise ValueError("overlap must be below half the chunk size")

    @F.pandas_udf("array<string>")
    def cuts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _recursive_cuts(t, size, overlap) if t else [])

    return docs.withColumn(out, cuts("text"))


def metadata_json(docs: DataFrame, columns: list[str], out: str = "metadata_json") -> DataFrame:
    """Canonical JSON object of the given columns: sorted keys, string values."""
    pairs = []
    for name in sorted(columns):
        pairs += [F.lit(name), F.col(name).cast("string")]
    return docs.withColumn(out, F.to_json(F.create_map(*pairs)))


def chunk_id(meta: Column, text: Column) -> Column:
    """SHA-256 of metadata, a NUL byte and the chunk text."""
    return F.sha2(F.concat(meta, F.char(F.lit(0)), text), 256)


def chunk_explode(docs: DataFrame, column: str = "chunks") -> DataFrame:
    """One row ``(doc_key, pos, text, metadata_json)`` per distinct chunk.

    Equal chunks of one document have one identity; they are dropped inside
    the document's own array, so no shuffle is needed for it.
    """
    # posexplode_outer: for posexplode, Spark would add filters that cut again.
    rows = docs.select(
        *[c for c in docs.columns if c not in (column, "text")],
        F.posexplode_outer(F.array_distinct(column)).alias("pos", "text"),
    )
    return rows.where(F.col("pos").isNotNull())


def build_chunks(
    docs: DataFrame,
    meta_columns: list[str],
    splitter: str = "token_count",
    size: int | None = 512,
    overlap: int = 50,
) -> DataFrame:
    """Documents ``(doc_key, text, …)`` to chunk rows with their ids.

    A narrow plan: metadata is serialised once per document, before rows
    multiply, and nothing is shuffled.
    """
    docs = metadata_json(docs, meta_columns).select("doc_key", "metadata_json", "text")
    if splitter in ("token_count", "tokencount"):
        docs = chunk_tail_merge(chunk_token_count(docs, size))
    elif splitter in ("recursive", "recursive_character"):
        docs = chunk_recursive(docs, size, overlap)
    elif splitter in ("null", "none"):
        docs = chunk_token_count(docs, None)
    else:
        raise ValueError(f"unknown splitter {splitter!r}")
    rows = chunk_explode(docs)
    return rows.select(
        chunk_id(F.col("metadata_json"), F.col("text")).alias("chunk_id"),
        "doc_key",
        "pos",
        "text",
        "metadata_json",
    )
