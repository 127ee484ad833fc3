"""Streaming jobs run to the end of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import frames, query
from millrace.catalog import sql as q
from millrace.operators import chunk
from millrace.operators.store import ChunkStore
from millrace.session import new_dir, written
from millrace.streaming import counters, index, retract


def _stream(spark, sf_dir, name):
    """A given table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


_FEED = (
    "feed AS (SELECT user_id, event_id, event_type, 'user ' || user_id || ' ' || event_type || ' ' || props AS text FROM events "
    "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)"
)
_LIVE = [
    _FEED,
    "live AS (SELECT user_id::VARCHAR AS doc_key, text, '/users/' || user_id AS path, event_id AS mtime, strlen(text)::BIGINT AS length FROM feed WHERE event_type <> 'error')",
]


def _feed(spark, sf_dir):
    e = _stream(spark, sf_dir, "events")
    text = F.concat_ws(" ", F.lit("user"), F.col("user_id").cast("string"), "event_type", "props")
    return e.select(
        F.col("user_id").cast("string").alias("doc_key"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
        text.alias("text"),
        F.concat(F.lit("/users/"), F.col("user_id").cast("string")).alias("path"),
        F.col("event_id").alias("mtime"),
        F.octet_length(text).cast("bigint").alias("length"),
    )


@query(sql=q.build("SELECT chunk_id, doc_key, text FROM live_chunks", _LIVE, q.chunk_ctes("live_chunks", "live")))
def stream_index(spark, sf_dir):
    store = ChunkStore(spark, new_dir(spark, "index"))
    job = index.stream_index(_feed(spark, sf_dir), store, new_dir(spark, "progress"), frames.META, static=True)
    job.awaitTermination()
    return store.read().select("chunk_id", "doc_key", "text")


@query(
    sql=q.build("SELECT doc_key, sha256('{}' || chr(0) || text) AS chunk_id, 1::BIGINT AS net FROM live", _LIVE)
)
def stream_retract(spark, sf_dir):
    feed = _feed(spark, sf_dir)
    ids = F.array(chunk.chunk_id(F.lit("{}"), F.col("text")))
    changes = retract.stream_retract(feed.select("doc_key", "seq", "op", ids.alias("chunk_ids")))
    out = new_dir(spark, "changes")
    job = (
        changes.writeStream.option("checkpointLocation", new_dir(spark, "progress"))
        .trigger(availableNow=True)
        .start(out, format="parquet", outputMode="append")
    )
    job.awaitTermination()
    net = spark.read.schema(retract.OUT).parquet(out).groupBy("doc_key", "chunk_id").agg(F.sum("diff").alias("net"))
    return net.where(F.col("net") != 0)


@query(
    sql=q.build(
        "SELECT 'chunks' AS stage, count(*) AS rows, max(mtime)::BIGINT AS newest FROM chunks JOIN docs USING (doc_key)", q.CHUNKS
    )
)
def stage_counters(spark, sf_dir):
    rows = frames.chunks(spark, sf_dir)
    mtime = F.get_json_object("metadata_json", "$.mtime").cast("bigint")
    counted, watch = counters.stage_counters(rows.withColumn("mtime", mtime), "chunks", "mtime")
    written(counted, "counted")
    seen = watch.get
    return spark.range(1).select(
        F.lit("chunks").alias("stage"), F.lit(seen["rows"]).alias("rows"), F.lit(seen["newest"]).alias("newest")
    )
