"""Fusing, merging, rescoring and diversifying ranked lists.

A ranked list is a set of rows ``(query_id, list_id, rank, text, …)``; rank
starts at 1. All groups here hold retrieved candidates only, so their size is
bounded by the number of lists times their length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as tx
from millrace.operators.vector import RANK_DIGITS, rank_hits, rounded

# Fixed value: damping constant of reciprocal-rank fusion.
RRF_C = 60


def rrf_fuse(lists: DataFrame, limit: int, c: int = RRF_C) -> DataFrame:
    """Reciprocal-rank fusion per query, keyed by ``text``.

    Every occurrence of a text adds 1/(c + rank), also within one list. The
    row first seen (by list, then rank) stands for the text and its score is
    replaced; equal sums keep that first-seen order.
    """
    rest = [f for f in lists.columns if f not in ("query_id", "text", "score", "rank", "list_id")]
    fused = lists.groupBy("query_id", "text").agg(
        F.sum(1.0 / (F.lit(c) + F.col("rank"))).alias("score"),
        F.min(F.struct("list_id", "rank")).alias("_seen"),
        F.min_by(F.struct(*rest), F.struct("list_id", "rank")).alias("_row"),
    )
    window = Window.partitionBy("query_id").orderBy(rounded(F.col("score")).desc(), F.col("_seen"))
    return (
        fused.withColumn("rank", F.row_number().over(window))
        .where(F.col("rank") <= limit)
        .select("query_id", "rank", "score", "text", *[F.col(f"_row.{f}").alias(f) for f in rest])
    )


def interleave_merge(lists: DataFrame, limit: int) -> DataFrame:
    """Round robin: every list's first row, then every second, first copy of a text kept.

    Rows keep their own scores; the order is the result.
    """
    first = Window.partitionBy("query_id", "text").orderBy("rank", "list_id")
    order = Window.partitionBy("query_id").orderBy(F.col("rank"), F.col("list_id"))
    return (
        lists.withColumn("_copy", F.row_number().over(first))
        .where(F.col("_copy") == 1)
        .withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") <= limit)
        .drop("_copy", "rank", "list_id")
        .withColumnRenamed("_place", "rank")
    )


def overlap_scorer(query: Column, text: Column) -> Column:
    """Share of the distinct query words found in the text (offline scorer)."""
    asked = F.array_distinct(tx.words(query))
    found = F.array_intersect(asked, tx.words(text))
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(F.size(found) / F.size(asked))


def rerank_pointwise(
    candidates: DataFrame,
    k: int,
    scorer: Callable[[Column, Column], Column] = overlap_scorer,
) -> DataFrame:
    """Score each ``(query, text)`` candidate again and keep the best ``k``.

    ``scorer`` is any function of the two columns, for a model a pandas UDF.
    Equal scores keep the incoming rank.
    """
    scored = candidates.withColumn("score", scorer(F.col("query"), F.col("text")).cast("double"))
    window = Window.partitionBy("query_id").orderBy(rounded(F.col("score")).desc(), F.col("rank"))
    return (
        scored.withColumn("_place", F.row_number().over(window))
        .where(F.col("_place") <= k)
        .drop("rank")
        .withColumnRenamed("_place", "rank")
    )


# What a rating model is asked.
RATING_PROMPT = "Query: %s\nPassage: %s\nHow far does the passage answer the query? One number, 0 (not at all) to 5 (fully):"


def rerank_prompt(candidates: DataFrame, out: str = "prompt") -> DataFrame:
    return candidates.withColumn(out, F.format_string(RATING_PROMPT, F.col("query"), F.col("text")))


def parse_rating(replies: DataFrame, column: str = "reply", out: str = "rating") -> DataFrame:
    return replies.withColumn(out, tx.first_number(F.col(column)))


def rating_scorer(model: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    """A scorer that asks ``model`` (prompt column to reply column) for a rating."""
    def score(query: Column, text: Column) -> Column:
        return tx.first_number(model(F.format_string(RATING_PROMPT, query, text)))

    return score


def decompose_parse(replies: DataFrame, max_subqueries: int = 4) -> DataFrame:
    """One row per search query: the question (``list_id`` 0), then its sub-queries.

    ``replies`` is (query_id, query, reply); an empty reply leaves the
    question alone.
    """
    return replies.select(
        "query_id",
        F.posexplode_outer(tx.sub_queries(F.col("reply"), F.col("query"), max_subqueries)).alias("list_id", "sub_query"),
    )


# What a model is asked that splits a question.
DECOMPOSE_PROMPT = (
    "Name up to %d searches, one on each line, that together find what this question needs. Each must make sense "
    "alone; repeat the question if it is enough.\n%s\n"
)


def decompose_prompt(queries: DataFrame, max_subqueries: int = 4, out: str = "prompt") -> DataFrame:
    return queries.withColumn(out, F.format_string(DECOMPOSE_PROMPT, F.lit(max_subqueries), F.col("query")))


def mmr_select(pool: DataFrame, k: int, diversity: float = 0.3) -> DataFrame:
    """Greedy maximal-marginal-relevance choice of ``k`` rows per query.

    ``pool`` has query_id, rank, score and embedding (may be NULL). A pool of
    at most ``k`` rows is returned in its order. One task call per query; the
    pool is the retrieved shortlist, never the corpus.
    """
    if "embedding" not in pool.columns:
        raise ValueError("diversification needs the stored vectors")
    pool_fields = pool.schema.fields
    schema = T.StructType([f for f in pool_fields if f.name != "rank"] + [T.StructField("rank", T.IntegerType())])

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank", kind="stable").reset_index(drop=True)
        n = len(group)
        order = list(range(n)) if n <= k else _greedy(group, k, diversity)
        out = group.iloc[order].drop(columns="rank")
        out["rank"] = np.arange(1, len(order) + 1, dtype=np.int32)
        return out[[f.name for f in schema.fields]]

    return pool.groupBy("query_id").applyInPandas(choose, schema)


def _greedy(group: pd.DataFrame, k: int, diversity: float) -> list[int]:
    score = group["score"].to_numpy(dtype=np.float64)
    span = score.max() - score.min()
    relevance = (score - score.min()) / (span if span else 1.0)
    known = [v for v in group["embedding"] if v is not None]
    dim = len(known[0]) if known else 1
    units = np.zeros((len(group), dim))
    has = np.zeros(len(group), dtype=bool)
    for i, v in enumerate(group["embedding"]):
        if v is not None:
            has[i] = True
            a = np.asarray(v, dtype=np.float64)
            length = np.sqrt(a @ a)
            units[i] = a / length if length else a
    # Redundancy stays 0 for rows without a vector, and while no chosen row has one.
    redundancy = np.full(len(group), -np.inf)
    free = np.ones(len(group), dtype=bool)
    chosen: list[int] = []
    while len(chosen) < k:
        penalty = np.where(np.isinf(redundancy), 0.0, redundancy)
        value = np.round((1.0 - diversity) * relevance - diversity * penalty, RANK_DIGITS)
        value[~free] = -np.inf
        best = int(np.argmax(value))
        chosen.append(best)
        free[best] = False
        if has[best]:
            similar = units @ units[best]
            redundancy[has] = np.maximum(redundancy[has], similar[has])
    return chosen


__all__ = [
    "rank_hits",
    "rrf_fuse",
    "interleave_merge",
    "rerank_pointwise",
    "rerank_prompt",
    "parse_rating",
    "rating_scorer",
    "overlap_scorer",
    "decompose_parse",
    "decompose_prompt",
    "mmr_select",
]
