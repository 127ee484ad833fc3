"""Embedding chunk rows; models plug in as batched functions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.functions import text as tx
from millrace.functions import vectors as vx
from millrace.plans.skew import at_most, salted_join
from millrace.session import ship, written

# A lookup table of up to this many values (rows x dimensions) is broadcast:
# 32 million floats are 128 MB.
MAX_LOOKUP_VALUES = 32_000_000
# Tokens whose vectors one task holds at once in ``embed_static``.
BLOCK_TOKENS = 1 << 15
# Code points of the texts that share one set of vectors when the lookup is larger; the least, if cores would idle.
BLOCK_CHARS, LEAST_CHARS = 1 << 26, 1 << 22


def embed_prefix(df: DataFrame, prefix: str, column: str = "text", out: str = "embed_input") -> DataFrame:
    """Model input with a document or query marker; the stored text stays clean."""
    return df.withColumn(out, F.concat(F.lit(prefix), F.col(column)))


def embed_mock(df: DataFrame, dim: int = vx.MOCK_DIM, column: str = "text", out: str = "embedding") -> DataFrame:
    return df.withColumn(out, vx.mock_vector(F.col(column), dim))


def embed_batch(
    df: DataFrame,
    model_factory: Callable[[], Callable[[list[str]], np.ndarray]],
    batch_size: int = 256,
    retries: int = 0,
    deterministic: bool = True,
    column: str = "text",
    out: str = "embedding",
) -> DataFrame:
    """Embed with a model loaded once per task and called in batches.

    ``retries`` repeats a failed call with doubling waits.
    """

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = model_factory()

        def call(texts: list[str]) -> np.ndarray:
            for attempt in range(retries + 1):
                try:
                    return np.asarray(model(texts), dtype=np.float32)
                except Exception:
                    if attempt == retries:
                        raise
                    time.sleep(2.0**attempt)

        for texts in batches:
            values = texts.tolist()
            rows: list[np.ndarray] = []
            for start in range(0, len(values), batch_size):
                rows.extend(call(values[start : start + batch_size]))
            yield pd.Series(rows)

    embed = vectors if deterministic else vectors.asNondeterministic()
    return df.withColumn(out, embed(column))


def embed_static(
    chunks: DataFrame, lookup: DataFrame, dim: int, key: str = "chunk_id", column: str = "text"
) -> DataFrame:
    """Mean of the token vectors of each text: ``(key, embedding, n_known)``, one row per input row.

    ``lookup`` is ``(term, vec)`` with one row per term. Words are cut on the JVM side; when the lookup holds
    at most ``MAX_LOOKUP_VALUES`` values it is sent once to every executor as a matrix, and one narrow Arrow
    pass finds each word's row (``pyarrow.compute.index_in``) and sums vectors per text by segments
    (``numpy.add.reduceat`` over blocks of ``BLOCK_TOKENS`` tokens), so nothing is shuffled and no task holds
    more than one block of vectors. With a larger lookup each block of texts gets the vectors
    of its words instead. ``n_known`` counts the tokens found; a text without one (null, empty, unknown words) gets the zero vector. Repeated keys are rows
    of their own.
    """
    spark = chunks.sparkSession
    if not at_most(lookup, MAX_LOOKUP_VALUES // dim):
        return _embed_static_joined(chunks, lookup, dim, key, column)
    table = lookup.select(F.col("term").cast("string"), F.col("vec")).toArrow()
    vocab = table.column(0).combine_chunks()
    vecs = table.column(1).combine_chunks()
    matrix = _vector_rows(vecs, dim)
    shared = spark.sparkContext.broadcast((vocab, matrix))
    ship(spark)
    schema = T.StructType(
        [chunks.schema[key], T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("n_known", T.LongType())]
    )

    def run(batches):
        terms, vectors = shared.value
        for batch in batches:
            yield _means(batch.column(0), batch.column(1), terms, vectors, dim, out_schema)

    out_schema = to_arrow_schema(schema)
    words = F.coalesce(tx.words(F.col(column)), F.array().cast("array<string>"))
    return chunks.select(F.col(key), words.alias("_words")).mapInArrow(run, schema)


def _vector_rows(vecs, dim: int) -> np.ndarray:
    if len(vecs) and (vecs.null_count or not np.all(pc.list_value_length(vecs).to_numpy(zero_copy_only=False) == dim)):
        raise ValueError(f"every lookup vector must have {dim} values")
    return vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(vecs), dim)


def _means(keys, words, terms, vectors: np.ndarray, dim: int, schema) -> pa.RecordBatch:
    """Mean vectors of texts given as lists of words, and the number of their known words."""
    n = len(keys)
    found = pc.index_in(words.flatten(), value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)
    segment = np.repeat(np.arange(n), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    known = found >= 0
    found, segment = found[known], segment[known]
    counts = np.bincount(segment, minlength=n)
    sums = np.zeros((n, dim), dtype=np.float64)
    for at in range(0, len(found), BLOCK_TOKENS):
        rows, seg = found[at : at + BLOCK_TOKENS], segment[at : at + BLOCK_TOKENS]
        starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        sums[seg[starts]] += np.add.reduceat(vectors[rows], starts, axis=0, dtype=np.float64)
    means = (sums / np.maximum(counts, 1)[:, None]).astype(np.float32)
    embedding = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(means.ravel()))
    return pa.RecordBatch.from_arrays([keys, embedding, pa.array(counts.astype(np.int64))], schema=schema)


def _embed_static_joined(chunks: DataFrame, lookup: DataFrame, dim: int, key: str, column: str) -> DataFrame:
    """:func:`embed_static` for a lookup too large to send whole: each block of texts gets the vectors of its words.

    Texts are dealt into blocks of at most about ``BLOCK_CHARS`` code points. A vector goes once to each block that has its
    word, ahead of the block's texts, so neither (text, word) pairs nor partial sums are shuffled.
    """
    ship(chunks.sparkSession)
    rows = chunks.select(key, F.col(column).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows, "static-rows")
    chars = rows.agg(F.sum(F.length("_text").cast("bigint"))).head()[0] or 0
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    blocks = max(1 + chars // BLOCK_CHARS, min(cores, 1 + chars // LEAST_CHARS))
    block = F.pmod(F.xxhash64("_row"), F.lit(blocks))
    # explode_outer: for explode, Spark would add filters that tokenise again.
    pairs = rows.select(block.alias("_block"), F.explode_outer(tx.words(F.col("_text"))).alias("term"))
    pairs = pairs.where(F.col("term").isNotNull()).distinct()
    words = lookup.select(F.col("term").cast("string").alias("term"), F.col("vec").cast("array<float>").alias("vec"))
    # Terms that every block has are as many rows as blocks, so no term is a large group.
    known = pairs.join(words, "term").select("_block", F.lit(0).alias("_side"), "term", "vec")
    texts = rows.select(block.alias("_block"), F.lit(1).alias("_side"), key, "_text")
    both = known.unionByName(texts, allowMissingColumns=True)
    both = both.repartition("_block").sortWithinPartitions("_block", "_side")
    cut = F.coalesce(tx.words(F.col("_text")), F.array().cast("array<string>"))
    schema = T.StructType(
        [chunks.schema[key], T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("n_known", T.LongType())]
    )
    out_schema = to_arrow_schema(schema)

    def run(batches):
        now, terms, parts, vectors = None, [], [], None
        for batch in batches:
            blocks, sides = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            heads = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (sides[1:] != sides[:-1])])
            for lo, hi in zip(heads, [*heads[1:], batch.num_rows], strict=True) if batch.num_rows else ():
                part = batch.slice(lo, hi - lo)
                if blocks[lo] != now:
                    now, terms, parts, vectors = blocks[lo], [], [], None
                if sides[lo] == 0:
                    terms.append(part.column(2))
                    parts.append(_vector_rows(part.column(3), dim))
                    continue
                if vectors is None:
                    vocab = pa.concat_arrays([pa.array([], pa.string()), *terms])
                    vectors = np.concatenate([np.zeros((0, dim), np.float32), *parts])
                    terms, parts = [], []
                yield _means(part.column(4), part.column(5), vocab, vectors, dim, out_schema)

    return both.select("_block", "_side", "term", "vec", key, cut.alias("_words")).mapInArrow(run, schema)


def embed_dedup_cache(
    chunks: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame], model: str
) -> tuple[DataFrame, DataFrame]:
    """Embed every distinct text once, and only texts not in the cache.

    ``cache`` is ``(text_key, model, embedding)``. Returns the embedded
    chunks and the rows to add to the cache. The distinct step sends one row
    per text and task, and the join back salts texts that many chunks share.
    """
    keyed = chunks.withColumn("text_key", F.sha2("text", 256))
    known = cache.where(F.col("model") == model).select("text_key", "embedding")
    texts = keyed.groupBy("text_key").agg(F.first("text").alias("text"))
    todo = texts.join(known.select("text_key"), "text_key", "left_anti")
    # Written once: a model call must not be repeated by each branch below.
    fresh = written(embed(todo).select("text_key", "embedding"), "embedded")
    vectors = known.unionByName(fresh)
    out = salted_join(keyed, vectors, "text_key", salt_by="chunk_id").drop("text_key")
    return out, fresh.select("text_key", F.lit(model).alias("model"), "embedding")


def truncate_dim(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    return df.withColumn(column, vx.first_dims(F.col(column), dim))


def embedding_dimension(df: DataFrame, expected: int, column: str = "embedding") -> DataFrame:
    """Vectors per size, each size marked as accepted or not."""
    size = F.when(F.col(column).isNull(), F.lit(-1)).otherwise(F.size(column))
    return (
        df.groupBy(size.alias("dim"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("accepted", F.col("dim") == F.lit(expected))
    )


def probe_dimension(model_factory: Callable[[], Callable[[list[str]], np.ndarray]]) -> int:
    """Dimension of a model's vectors, found with one probe call."""
    return int(np.asarray(model_factory()(["probe"])).shape[1])
