"""Keeping the store in step with its sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.chunk import build_chunks
from millrace.operators.embed import embed_mock, embed_prefix
from millrace.operators.parse import parse_documents, parser_route
from millrace.operators.store import ChunkStore, changelog_latest, snapshot_diff
from millrace.session import written
from millrace.sources.files import fetch_changed


def _mock(df: DataFrame) -> DataFrame:
    return embed_mock(df, column="embed_input")


@dataclass
class IndexOptions:
    """Settings of an indexing job."""

    rules: list[dict] = field(default_factory=list)
    env: dict[str, bool] = field(default_factory=dict)
    custom_parsers: dict[str, Callable] = field(default_factory=dict)
    splitter: str = "token_count"
    chunk_size: int | None = 512
    chunk_overlap: int = 50
    document_prefix: str = ""
    # Adds ``embedding`` for the column ``embed_input``.
    embed: Callable[[DataFrame], DataFrame] = _mock
    # Called with each committed batch's chunks and removed keys, e.g. to copy
    # them to another store in the shape of ``sink_shape``.
    on_batch: Callable[[int, DataFrame, DataFrame], None] | None = None
    # Called with the objects of a batch that could not be read or parsed:
    # (source_id, path, parser, reason).
    on_errors: Callable[[int, DataFrame], None] | None = None
    # Versions of changes after which the store is tidied; None leaves it to the user.
    tidy_every: int | None = 64


def chunk_rows(docs: DataFrame, meta_columns: list[str], opts: IndexOptions) -> DataFrame:
    """Documents ``(doc_key, text, …)`` to embedded chunk rows."""
    chunks = build_chunks(docs, meta_columns, opts.splitter, opts.chunk_size, opts.chunk_overlap)
    return opts.embed(embed_prefix(chunks, opts.document_prefix)).drop("embed_input")


def index_once(listing: DataFrame, store: ChunkStore, batch_id: int, opts: IndexOptions, job: str = "") -> bool:
    """Bring the store in step with one listing of the sources.

    Only objects that were added or changed since the last commit are read,
    parsed and embedded; the chunks of changed and of vanished objects go.
    Returns whether anything was committed.
    """
    # Written once, so that every branch below sees the same listing.
    changes = snapshot_diff(store.manifest(), listing, carry=("name", "suffix"))
    changes = written(changes.where(F.col("change") != "unchanged"), "changes")
    if changes.isEmpty():
        return False
    key = F.concat_ws(":", "source_id", "path")
    fresh = changes.where(F.col("change").isin("added", "modified"))
    # Spread by object: the listing of one folder must not be one task's work.
    fresh = fresh.repartition(F.col("source_id"), F.col("path"))
    docs = parse_documents(fetch_changed(parser_route(fresh, opts.rules, opts.env)), opts.custom_parsers)
    docs = written(docs.drop("content").withColumn("doc_key", key), "parsed")
    # What could not be read or parsed keeps its old chunks, stays out of the
    # manifest, and so is tried again with the next listing.
    errors = docs.where(F.col("parse_error").isNotNull())
    errors = errors.select("source_id", "path", "parser", F.col("parse_error").alias("reason"))
    if opts.on_errors:
        opts.on_errors(batch_id, errors)
    changes = changes.join(errors.select("source_id", "path"), ["source_id", "path"], "left_anti")
    fresh = changes.where(F.col("change").isin("added", "modified"))
    inserts = chunk_rows(docs.where(F.col("parse_error").isNull()), ["path", "mtime", "length"], opts)
    removed = changes.where(F.col("change").isin("deleted", "modified")).select(key.alias("doc_key"))
    op = F.when(F.col("change") == "deleted", "delete").otherwise("upsert")
    if changes.isEmpty():
        return False
    committed = store.apply(batch_id, removed, inserts, changes.withColumn("op", op), job)
    if committed:
        if opts.on_batch:
            opts.on_batch(batch_id, store.read().join(fresh.select(key.alias("doc_key")), "doc_key", "left_semi"), removed)
        if opts.tidy_every:
            store.tidy(opts.tidy_every)
    return committed


def poll_source(
    spark: SparkSession,
    list_sources: Callable[[], DataFrame],
    store: ChunkStore,
    checkpoint: str,
    opts: IndexOptions | None = None,
    refresh_interval: str = "30 seconds",
) -> StreamingQuery:
    """List the sources again at every trigger and index what changed.

    Spark's own file stream sees neither edits nor deletions, so the trigger
    is a clock and the difference of two listings is the change feed.
    """
    opts = opts or IndexOptions()
    store.create()
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (
        clock.writeStream.option("checkpointLocation", checkpoint)
        .trigger(processingTime=refresh_interval)
        .foreachBatch(lambda _, batch_id: index_once(list_sources(), store, batch_id, opts, checkpoint))
        .start()
    )


def stream_index(
    feed: DataFrame,
    store: ChunkStore,
    checkpoint: str,
    meta_columns: list[str],
    opts: IndexOptions | None = None,
    static: bool = False,
    interval: str = "5 seconds",
) -> StreamingQuery:
    """Continuous job from a change feed ``(doc_key, seq, op, text, …)`` to the store.

    A micro-batch is first collapsed to the last row per document, then
    replaces those documents' chunks. Replayed batches are skipped by id.
    ``static`` reads what is there and stops; backpressure is the reader's
    ``maxFilesPerTrigger`` / ``maxBytesPerTrigger``.
    """
    opts = opts or IndexOptions()
    store.create()

    def run(batch: DataFrame, batch_id: int) -> None:
        inserts = chunk_rows(changelog_latest(batch, ["doc_key"], "seq"), meta_columns, opts)
        removed = batch.select("doc_key").distinct()
        if store.apply(batch_id, removed, inserts, job=checkpoint):
            if opts.on_batch:
                opts.on_batch(batch_id, store.read().join(removed, "doc_key", "left_semi"), removed)
            if opts.tidy_every:
                store.tidy(opts.tidy_every)

    writer = feed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    trigger = {"availableNow": True} if static else {"processingTime": interval}
    return writer.trigger(**trigger).start()
