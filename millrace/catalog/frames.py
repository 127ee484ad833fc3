"""The given tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.chunk import build_chunks
from millrace.operators.embed import embed_mock
from millrace.operators.keyword import KeywordIndex, bm25_index
from millrace.session import written
from millrace.sources.tables import table_source

META = ["path", "mtime", "length"]
FIRST_MTIME = 1000


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str], spread_by: str | None = None) -> DataFrame:
    return table_source(spark, f"{sf_dir}/{name}.parquet", columns, spread_by)


def _located(docs: DataFrame) -> DataFrame:
    path = F.concat(F.lit("/docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.withColumns({"path": path, "doc_key": path, "length": F.octet_length("text").cast("bigint")})


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The corpus as parsed documents."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "source", *more], "doc_id")
    return _located(docs).withColumn("mtime", F.lit(FIRST_MTIME) + F.col("doc_id"))


def before_and_after(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the corpus, told apart by ``labels``.

    Before: the labelled documents. After: all but the toxic ones, where those
    of low quality have been revised (new text and modification time).
    """
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "source"], "doc_id")
    labels = table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    both = docs.join(labels, "doc_id", "left").withColumn("source_id", F.lit("fs"))
    old = _located(both.where(F.col("quality").isNotNull())).withColumn("mtime", F.lit(FIRST_MTIME).cast("bigint"))
    revised = F.coalesce(F.col("quality"), F.lit(1)) == 0
    new = both.where(F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    new = new.withColumn("text", F.when(revised, F.concat("text", F.lit("\n(revised)"))).otherwise(F.col("text")))
    new = _located(new).withColumn("mtime", (F.lit(FIRST_MTIME) + F.when(revised, 1).otherwise(0)).cast("bigint"))
    return old, new


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_chunks(documents(spark, sf_dir), META)


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk store of the corpus with offline vectors, written once."""
    return written(embed_mock(chunks(spark, sf_dir)), "store")


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(chunks(spark, sf_dir), "chunks")


def stored_index(rows: DataFrame) -> KeywordIndex:
    """The index over postings written once, as a running system has them."""
    return bm25_index(rows).kept()


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark", ["item_id", "text"])
    return items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"], "vec_id")


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "events", list(columns), "event_id")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as measurements of indexing runs, one run per event type."""
    e = events(spark, sf_dir, "event_id", "ts", "event_type", "value")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.timestamp_diff("MICROSECOND", start, F.col("ts")) / 1e6
    return e.select(
        F.col("event_type").alias("run_id"),
        F.col("event_id").alias("seq"),
        seconds.alias("elapsed_s"),
        (F.col("value") * 10).alias("rss_mb"),
        (F.col("value") * 8).alias("pss_mb"),
        (seconds * 20 + F.col("value") * 100).alias("cpu_s"),
        (F.col("event_id") - F.col("event_id") % 97).alias("chunks"),
        (F.col("event_id") * 0.5).alias("store_mb"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"], "doc_id")
    title = F.regexp_extract("text", r"^[^\n]*", 0)
    return docs.select(F.col("doc_id").alias("article_id"), title.alias("title"), "text")

