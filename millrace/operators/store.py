"""The chunk store: an exact replica of the current chunks, versioned on files.

The functions are plain ``DataFrame -> DataFrame``. ``ChunkStore`` keeps
their result on shared storage: a batch appends its new chunks and the keys of
removed documents under a new version, so the cost of a write follows the size
of the change and never the size of the store. Readers take the versions
listed in the commit log and drop chunks older than their document's latest
removal; ``compact`` folds all versions into one.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.skew import spread_join

STORE_SCHEMA = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("doc_key", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("metadata_json", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)


MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("op", T.StringType()),
    ]
)


class IndexNotReady(RuntimeError):
    """The store has no committed version yet."""


# --- pure functions -------------------------------------------------------

MANIFEST_KEY = ["source_id", "path"]
MANIFEST_STATE = ["length", "mtime"]


def snapshot_diff(old: DataFrame, new: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Compare the last manifest with a new listing: one row per object.

    ``change`` is added, modified, deleted or unchanged; ``carry`` names more
    columns of the listing to keep. Both sides are hashed on the full object
    key, which is unique, so no source can be hot.
    """
    left = old.select(*MANIFEST_KEY, F.struct(*MANIFEST_STATE).alias("old_state"))
    right = new.select(*MANIFEST_KEY, F.struct(*MANIFEST_STATE).alias("new_state"), *carry)
    change = (
        F.when(F.col("old_state").isNull(), "added")
        .when(F.col("new_state").isNull(), "deleted")
        .when(F.col("old_state") == F.col("new_state"), "unchanged")
        .otherwise("modified")
    )
    return left.join(right, MANIFEST_KEY, "full_outer").select(
        *MANIFEST_KEY,
        change.alias("change"),
        F.col("new_state.length").alias("length"),
        F.col("new_state.mtime").alias("mtime"),
        *carry,
    )


def retract_chunks(store: DataFrame, changed_docs: DataFrame) -> DataFrame:
    """Stored chunks of removed or edited documents, found without re-reading them."""
    return spread_join(store, changed_docs.select("doc_key"), "doc_key", "chunk_id", "left_semi")


def snapshot_upsert(store: DataFrame, deletes: DataFrame, inserts: DataFrame) -> DataFrame:
    """The store without the chunks of ``deletes``, with ``inserts`` put in.

    An inserted chunk replaces a stored one of the same id.
    """
    kept = spread_join(store, deletes.select("doc_key"), "doc_key", "chunk_id", "left_anti")
    kept = kept.join(inserts.select("chunk_id"), "chunk_id", "left_anti")
    return kept.select(*store.columns).unionByName(inserts.select(*store.columns))


def last_per_key(feed: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the highest ``seq`` of every key.

    A ``max_by`` aggregate, combined in each task before the shuffle, so a key
    with a third of all rows costs no more than any other.
    """
    rest = [c for c in feed.columns if c not in keys]
    last = feed.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def changelog_latest(
    feed: DataFrame, keys: list[str], seq: str, op: str = "op", delete: str = "delete"
) -> DataFrame:
    """Live rows of an ordered feed of upserts and deletes."""
    return last_per_key(feed, keys, seq).where(F.col(op) != delete)


# Which backends take native JSON metadata, keep the chunk key,
# and how they name the document, metadata and vector fields.
SINKS = {
    "duckdb": ("chunk_id", "text", "metadata", "embedding", "json_string"),
    "pgvector": ("chunk_id", "text", "metadata", "embedding", "native"),
    "milvus": ("chunk_id", "text", "metadata", "embedding", "native"),
    "qdrant": (None, "text", "metadata", "embedding", "native"),
    "chroma": ("chunk_id", "document", "metadata", "embedding", "json_string"),
    "weaviate": ("chunk_id", "text", "metadata", "vector", "json_string"),
    "pinecone": ("chunk_id", "text", "metadata", "vector", "json_string"),
    "mongodb": (None, "text", "metadata", "embedding", "native"),
}


def sink_shape(chunks: DataFrame, backend: str) -> DataFrame:
    """Exactly the columns a backend stores, under its names.

    Native metadata is a MAP parsed from the JSON string, the other backends
    take the string itself.
    """
    key, document, metadata, vector, form = SINKS[backend]
    meta = F.col("metadata_json")
    if form == "native":
        meta = F.from_json(meta, "map<string,string>")
    columns: list[Column] = [F.col("chunk_id").alias(key)] if key else []
    return chunks.select(*columns, F.col("text").alias(document), meta.alias(metadata), F.col("embedding").alias(vector))


FINGERPRINT_SECTIONS = ("splitter", "parser", "embedder", "libraries")
EMBEDDER_SETTINGS = ("type", "model", "truncate_dim")
CREDENTIAL = re.compile("key|token|secret|passw|credential|auth", re.I)


def fingerprint(settings: dict[str, dict]) -> dict[str, str]:
    """Canonical JSON per settings section.

    Of an embedder only what changes its vectors counts; elsewhere names that
    may hold credentials are left out.
    """
    import json

    def clean(value):
        if isinstance(value, dict):
            return {k: clean(v) for k, v in value.items() if not CREDENTIAL.search(k)}
        if isinstance(value, list):
            return [clean(v) for v in value]
        return value

    given = dict(settings)
    given["embedder"] = {k: v for k, v in given.get("embedder", {}).items() if k in EMBEDDER_SETTINGS}
    return {s: json.dumps(clean(given.get(s, {})), sort_keys=True) for s in FINGERPRINT_SECTIONS}


def with_fingerprint(chunks: DataFrame, settings: dict[str, dict]) -> DataFrame:
    return chunks.withColumns({f"fp_{s}": F.lit(v) for s, v in fingerprint(settings).items()})


def fingerprint_drift(store: DataFrame, current: dict[str, str]) -> DataFrame:
    """Chunks and documents built under other settings, per section.

    Counted in two steps, first per document, so that neither a large
    document nor a common setting gathers in one task.
    """
    sections = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(s).alias("section"),
                    F.col(f"fp_{s}").alias("stored"),
                    F.lit(current[s]).alias("current"),
                )
                for s in FINGERPRINT_SECTIONS
            ]
        )
    ).alias("f")
    per_doc = (
        store.select("doc_key", sections)
        .select("doc_key", "f.*")
        .where(~F.col("stored").eqNullSafe(F.col("current")))
        .groupBy("section", "stored", "current", "doc_key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_doc.groupBy("section", "stored", "current").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_chunks")
    )


def check_fingerprint(store: DataFrame, current: dict[str, str], accept: bool = False) -> None:
    """Refuse to index on top of chunks built under other settings."""
    if accept:
        return
    drift = fingerprint_drift(store, current).select("section").distinct()
    sections = sorted(r["section"] for r in drift.collect())
    if sections:
        raise RuntimeError(
            f"indexed under other settings: {', '.join(sections)}; re-index or pass accept=True"
        )


def index_stats(store: DataFrame, approximate: bool = False) -> DataFrame:
    """Chunk count, distinct source paths and the latest ``seen_at``."""
    path = F.get_json_object("metadata_json", "$.path")
    seen = F.max(F.get_json_object("metadata_json", "$.seen_at").try_cast("bigint"))
    chunks = F.count(F.lit(1))
    if approximate:
        return store.agg(
            chunks.alias("chunks"), F.approx_count_distinct(path).alias("documents"), seen.alias("last_indexed_at")
        )
    # Distinct paths by a grouped count: one small row per path and task.
    per_path = store.groupBy(path.alias("path")).agg(chunks.alias("n"), seen.alias("seen"))
    return per_path.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"),
        F.count("path").alias("documents"),
        F.max("seen").alias("last_indexed_at"),
    )


def is_ready(store: DataFrame, sources: list[DataFrame]) -> bool:
    """A store with chunks is ready; an empty one only if no source has a file."""
    return not store.isEmpty() or all(s.isEmpty() for s in sources)


def restart_equivalence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows ``(side, n)`` of chunks held by one store only; (0, 0) means equal."""
    def prints(df: DataFrame) -> DataFrame:
        vector = F.array_join(F.col("embedding").cast("array<string>"), ",")
        return df.select("chunk_id", "doc_key", F.sha2(F.concat_ws("\x01", "text", vector), 256).alias("body"))

    a, b = prints(a), prints(b)
    only_a = a.exceptAll(b).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("first"))
    only_b = b.exceptAll(a).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("second"))
    return only_a.unionByName(only_b).select("side", "n")


# --- the store on files ---------------------------------------------------


class ChunkStore:
    """A chunk table on shared storage with one writer and any number of readers.

    Layout below ``root``: ``chunks/ver=N`` (new chunks), ``removed/ver=N``
    (keys of removed or replaced documents), ``manifest/ver=N`` (changes of the
    source listing), ``log/gen=G`` (one row per commit). Files are never
    changed; a version counts only once its log row exists, so a crashed batch
    leaves the old state and is simply run again.

    A reader sees one base version and the changes after it. ``merge`` folds
    the changes into one, at a cost that follows the changes; ``compact`` folds
    them into a new base, which rewrites the store.
    """

    LOG = "version BIGINT, batch_id BIGINT, kind STRING, n_chunks BIGINT, job STRING"
    # Log rows in files of their own before the log is written as one file.
    ROLL = 256

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType = STORE_SCHEMA):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._gen = 0

    def create(self) -> "ChunkStore":
        """Make an empty store that can be queried; does nothing if there is one."""
        if not self.exists():
            self._commit([], 0, -1, "apply", 0)
        return self

    def exists(self) -> bool:
        return bool(self._log())

    # --- the log: small rows, read on the driver

    def _log_rows(self, gen: int) -> list:
        try:
            rows = self.spark.read.schema(self.LOG).parquet(f"{self.root}/log/gen={gen}").collect()
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" in str(exc):
                return []
            raise
        return sorted(rows, key=lambda r: r["version"])

    def _log(self) -> list:
        """Rows of the newest generation; generations follow each other without a gap."""
        step, rows = 1, self._log_rows(self._gen)
        while rows and (later := self._log_rows(self._gen + step)):
            self._gen, rows, step = self._gen + step, later, step * 2
        while step > 1:
            step //= 2
            if later := self._log_rows(self._gen + step):
                self._gen, rows = self._gen + step, later
        return rows

    def _write_log(self, gen: int, rows: list) -> None:
        # One file: it appears whole or not at all.
        self.spark.createDataFrame(rows, self.LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log/gen={gen}")

    def _commit(self, log: list, version: int, batch_id: int, kind: str, n_chunks: int, job: str = "") -> None:
        row = (version, batch_id, kind, n_chunks, job)
        self._write_log(self._gen, [row])
        if log and len(log) % self.ROLL == 0:
            self._write_log(self._gen + 1, [*map(tuple, log), row])

    def _live(self) -> list:
        """Log rows of the base version (first) and of the changes after it."""
        log = self._log()
        if not log:
            raise IndexNotReady(f"no committed version in {self.root}")
        base = max((r["version"] for r in log if r["kind"] == "compact"), default=log[0]["version"])
        merged = max((r["version"] for r in log if r["kind"] == "merge" and r["version"] > base), default=base)
        return [r for r in log if r["version"] == base or r["version"] >= max(merged, base)]

    # --- reading

    def _versions(self, folder: str, schema: T.StructType, versions: list[int]) -> DataFrame | None:
        paths = [f"{self.root}/{folder}/ver={v}" for v in versions if v > 0]
        if not paths:
            return None
        full = T.StructType(schema.fields + [T.StructField("ver", T.LongType())])
        return self.spark.read.schema(full).option("basePath", f"{self.root}/{folder}").parquet(*paths)

    def _alive(self, versions: list[int]) -> DataFrame:
        """Chunks of these versions that no later one of them removed."""
        rows = self._versions("chunks", self.schema, versions)
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        removed = self._versions("removed", T.StructType([self.schema["doc_key"]]), versions[1:])
        if removed is None:
            return rows.drop("ver")
        last = removed.groupBy("doc_key").agg(F.max("ver").alias("_gone"))
        alive = F.col("_gone").isNull() | (F.col("ver") >= F.col("_gone"))
        return spread_join(rows, last, "doc_key", "chunk_id", "left").where(alive).select(*self.schema.names)

    def read(self) -> DataFrame:
        """The current chunks. Later commits do not change a frame already read."""
        return self._alive([r["version"] for r in self._live()])

    def _listed(self, versions: list[int]) -> DataFrame:
        rows = self._versions("manifest", MANIFEST_SCHEMA, versions)
        if rows is None:
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return last_per_key(rows, MANIFEST_KEY, "ver").select(*MANIFEST_SCHEMA.names)

    def manifest(self) -> DataFrame:
        """The source objects that the current chunks were made from."""
        listed = self._listed([r["version"] for r in self._live()])
        return listed.where(F.col("op") != "delete").drop("op")

    # --- writing

    def _write(
        self,
        log: list,
        batch_id: int,
        kind: str,
        chunks: DataFrame,
        removed: DataFrame,
        manifest: DataFrame,
        job: str = "",
    ) -> None:
        version = log[-1]["version"] + 1
        path = f"{self.root}/chunks/ver={version}"
        chunks.select(*self.schema.names).write.mode("overwrite").parquet(path)
        removed.select("doc_key").distinct().write.mode("overwrite").parquet(f"{self.root}/removed/ver={version}")
        manifest.select(*MANIFEST_SCHEMA.names).write.mode("overwrite").parquet(f"{self.root}/manifest/ver={version}")
        # A count of whole files is answered from their footers.
        self._commit(log, version, batch_id, kind, self.spark.read.schema(self.schema).parquet(path).count(), job)

    def apply(
        self,
        batch_id: int,
        removed: DataFrame,
        inserts: DataFrame,
        manifest: DataFrame | None = None,
        job: str = "",
    ) -> bool:
        """Commit one batch; returns False if ``job`` committed ``batch_id`` before.

        Batches are numbered within their job: a stream is named by its
        checkpoint, so two streams, or one with a new checkpoint, never meet.

        ``removed`` holds the keys of deleted and of edited documents,
        ``inserts`` all chunks of new and edited ones, ``manifest`` the changed
        source objects with ``op`` upsert or delete.
        """
        if batch_id < 0:
            raise ValueError("batch ids start at 0")
        log = self._log() or self.create()._log()
        if any(r["batch_id"] == batch_id and (r["job"] or "") == job for r in log):
            return False
        if manifest is None:
            manifest = self.spark.createDataFrame([], MANIFEST_SCHEMA)
        self._write(log, batch_id, "apply", inserts, removed, manifest, job)
        return True

    def merge(self) -> None:
        """Fold all changes since the base into one version, leaving the base alone."""
        changes = [r["version"] for r in self._live()[1:]]
        if len(changes) > 1:
            gone = self._versions("removed", T.StructType([self.schema["doc_key"]]), changes)
            self._write(self._log(), -1, "merge", self._alive(changes), gone, self._listed(changes))

    def compact(self) -> None:
        """Write the current chunks as the new base."""
        none = self.spark.createDataFrame([], T.StructType([self.schema["doc_key"]]))
        self._write(self._log(), -1, "compact", self.read(), none, self.manifest().withColumn("op", F.lit("upsert")))

    def tidy(self, max_changes: int = 64, share: float = 0.5) -> None:
        """Merge once there are ``max_changes`` versions of changes; compact
        instead when the changes hold more than ``share`` of the base's chunks."""
        base, *changes = self._live()
        if len(changes) >= max_changes:
            if sum(r["n_chunks"] for r in changes) > share * base["n_chunks"]:
                self.compact()
            else:
                self.merge()
