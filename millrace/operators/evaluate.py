"""Preparing an evaluation corpus, measuring retrieval, summing up runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.plans.running import dense_index, running

# Fixed values of the published benchmark.
MIN_CHARS = 200
FILES_PER_DIR = 10_000
QUESTION_EVERY = 2000
MAX_QUESTIONS = 20
QUESTION_MIN_CHARS = 2000
STABLE_SECONDS = 180.0
IDLE_CORES = 30.0
PAGE_CHARS = 2000
QUERY_CHARS = 120


def corpus_prepare(articles: DataFrame) -> DataFrame:
    """``(article_id, title, text)`` to numbered corpus files.

    Texts below 200 characters are dropped; the rest get a dense ``idx`` in
    the order of ``article_id``, a file name, the payload and its size.
    """
    kept = articles.where(F.col("text").isNotNull() & (F.length("text") >= MIN_CHARS))
    # Only ids go through the numbering; texts join back to their number.
    numbers = dense_index(kept.select("article_id"), "article_id")
    name = F.format_string(
        "%04d/%04d-%s.txt",
        F.floor(F.col("idx") / FILES_PER_DIR),
        F.col("idx") % FILES_PER_DIR,
        tx.slug(F.col("title")),
    )
    payload = F.concat(F.col("title"), F.lit("\n\n"), F.col("text"))
    return (
        kept.join(numbers, "article_id")
        .withColumns({"file_name": name, "payload": payload})
        .withColumn("size_bytes", F.octet_length("payload").cast("bigint"))
    )


def corpus_cut_to_size(prepared: DataFrame, target_bytes: int) -> DataFrame:
    """Files whose predecessors together are smaller than ``target_bytes``."""
    before = running(
        prepared.select("idx", "size_bytes"), "idx", {"bytes_before": ("sum", "size_bytes")}, inclusive=False
    ).where(F.col("bytes_before") < target_bytes)
    return prepared.join(before.select("idx", "bytes_before"), "idx")


def first_sentence(articles: DataFrame, column: str = "text", out: str = "first_sentence") -> DataFrame:
    return articles.withColumn(out, tx.first_sentence(F.col(column)))


def question_sample(
    prepared: DataFrame,
    every: int = QUESTION_EVERY,
    cap: int = MAX_QUESTIONS,
    min_chars: int = QUESTION_MIN_CHARS,
) -> DataFrame:
    """Questions from every ``every``-th long article, the first ``cap``."""
    chosen = prepared.where((F.col("idx") % every == 0) & (F.length("text") >= min_chars))
    return (
        chosen.orderBy("idx")
        .limit(cap)
        .select(
            F.col("idx").alias("query_id"),
            F.concat(F.col("title"), F.lit(": "), tx.first_sentence(F.col("text"))).alias("query"),
            F.col("file_name").alias("expected_file"),
        )
    )


def _judged(results: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per question: was the expected file among the returned paths?"""
    joined = questions.join(results.select("query_id", "rank", "path"), "query_id", "left")
    hit = F.coalesce(F.endswith(F.col("path"), F.concat(F.lit("/"), F.col("expected_file"))), F.lit(False))
    return joined.groupBy("query_id", "query", "expected_file").agg(
        F.max(hit).alias("hit"),
        F.array_sort(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("rank", "path")))).alias("got"),
    )


def retrieval_accuracy(results: DataFrame, questions: DataFrame) -> DataFrame:
    """One row ``(hits, total, accuracy)`` over ``results`` (query_id, rank, path)."""
    hits = F.coalesce(F.sum(F.col("hit").cast("bigint")), F.lit(0))
    return (
        _judged(results, questions)
        .agg(hits.alias("hits"), F.count(F.lit(1)).alias("total"))
        .withColumn("accuracy", F.concat_ws("/", "hits", "total"))
    )


def accuracy_misses(results: DataFrame, questions: DataFrame) -> DataFrame:
    """Missed questions with the folder and name of what came back, best first."""
    tail = F.transform("got", lambda g: F.regexp_extract(g["path"], r"[^/]*/[^/]*$", 0))
    return (
        _judged(results, questions)
        .where(~F.col("hit"))
        .select(
            "query_id",
            F.col("expected_file").alias("expected"),
            F.substring("query", 1, QUERY_CHARS).alias("query"),
            F.array_join(tail, " ").alias("got"),
        )
    )


def run_summary(samples: DataFrame, corpus: DataFrame) -> DataFrame:
    """Figures per run from its samples and the corpus file sizes.

    ``samples``: run_id, elapsed_s, rss_mb, pss_mb, cpu_s, chunks, store_mb.
    The run took until its chunk counter last grew, which is the first time
    the counter had its highest value.
    """
    mb = 1024.0 * 1024.0
    size = corpus.agg(
        F.struct(F.sum("size_bytes").alias("bytes"), F.count(F.lit(1)).alias("files")).alias("s")
    ).scalar()
    runs = samples.groupBy("run_id").agg(
        F.max(F.struct("chunks", (-F.col("elapsed_s")).alias("neg"))).alias("_last"),
        F.max("rss_mb").alias("peak_rss_mb"),
        F.max("pss_mb").alias("peak_pss_mb"),
        F.max("cpu_s").alias("cpu_s"),
        F.max("store_mb").alias("store_mb"),
    )
    seconds = F.nullif(-F.col("_last.neg"), F.lit(0.0))
    corpus_mb = size["bytes"] / mb
    return runs.select(
        "run_id",
        size["files"].alias("documents"),
        F.round(corpus_mb, 1).alias("corpus_mb"),
        F.col("_last.chunks").alias("chunks"),
        F.round(seconds, 1).alias("indexing_seconds"),
        F.round(corpus_mb / (seconds / 60.0), 4).alias("throughput_mb_per_min"),
        F.round("peak_rss_mb", 1).alias("peak_rss_mb"),
        F.round("peak_pss_mb", 1).alias("peak_pss_mb"),
        F.round(F.col("cpu_s") / seconds, 4).alias("avg_parallelism"),
        F.round(F.col("store_mb") / corpus_mb, 2).alias("store_mb_per_corpus_mb"),
        F.floor(size["bytes"] / F.lit(PAGE_CHARS)).cast("bigint").alias("approx_text_pages"),
    )


def completion_detect(
    samples: DataFrame, documents: int | Column, stable_s: float = STABLE_SECONDS, idle_cores: float = IDLE_CORES
) -> DataFrame:
    """When each run was done: run_id, done_at_s, duration_s (NULL if never).

    Done is the first sample with at least ``documents`` chunks, no growth
    and no busy interval for ``stable_s``; the duration ends at the last
    growth. ``samples``: run_id, seq (unique BIGINT), elapsed_s, chunks,
    cpu_s (cumulative). Nothing is windowed over a whole run: running values
    go by blocks, so a long run is spread like any other.
    """
    s = samples.select(
        "run_id", "seq", "elapsed_s", "chunks", F.struct("seq", "elapsed_s", "cpu_s").alias("_row"), "cpu_s"
    )
    s = running(
        s, "seq", {"_prev": ("max", "_row"), "_before": ("max", "chunks")}, by=("run_id",), inclusive=False
    )
    span = F.col("elapsed_s") - F.col("_prev.elapsed_s")
    rate = F.when(span > 0, (F.col("cpu_s") - F.col("_prev.cpu_s")) / span)
    grew = F.col("chunks") > F.coalesce(F.col("_before"), F.lit(0))
    s = s.withColumns(
        {
            "_busy": F.when(rate >= idle_cores, F.col("elapsed_s")),
            "_grew": F.when(grew, F.col("elapsed_s")),
        }
    ).select("run_id", "seq", "elapsed_s", "chunks", "_busy", "_grew")
    s = running(
        s,
        "seq",
        {"_count": ("max", "chunks"), "_change": ("max", "_grew"), "_last_busy": ("max", "_busy")},
        by=("run_id",),
    )
    change = F.coalesce(F.col("_change"), F.lit(0.0))
    done = (
        (F.col("_count") >= documents)
        & (F.col("elapsed_s") - change >= stable_s)
        & (F.col("elapsed_s") - F.coalesce(F.col("_last_busy"), F.lit(0.0)) >= stable_s)
    )
    first = F.min(F.when(done, F.struct(F.col("seq"), F.col("elapsed_s").alias("at"), change.alias("took"))))
    return (
        s.groupBy("run_id")
        .agg(first.alias("_d"))
        .select("run_id", F.col("_d.at").alias("done_at_s"), F.col("_d.took").alias("duration_s"))
    )
