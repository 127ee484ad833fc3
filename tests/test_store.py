import os
import time

import pytest
from pyspark.sql import functions as F

from conftest import make_queries, rows
from millrace.operators import store as st
from millrace.operators.keyword import bm25_index
from millrace.operators.retrieve import RetrieveOptions, retrieve
from millrace.operators.store import ChunkStore, IndexNotReady
from millrace.sources import files
from millrace.streaming import counters, index, retract

A = "first leaflet on kettles and the streaming engine"
B = "second note on lanterns and the framework"


class Folder:
    """A source folder whose files can be written and removed."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, path
        path.mkdir()

    def write(self, name, text):
        target = self.path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)

    def remove(self, name):
        os.remove(self.path / name)

    def listing(self, **kw):
        return files.source_listing(self.spark, str(self.path), **kw)


@pytest.fixture
def folder(spark, tmp_path):
    return Folder(spark, tmp_path / "src")


@pytest.fixture
def kept(spark, tmp_path):
    return ChunkStore(spark, str(tmp_path / "store")).create()


def run(folder, kept, batch, **kw):
    return index.index_once(folder.listing(), kept, batch, index.IndexOptions(**kw))


def names(kept):
    return sorted({r["doc_key"].rsplit("/", 1)[1] for r in kept.read().select("doc_key").collect()})


# --- listing --------------------------------------------------------------


def test_listing_never_reads_contents(spark, folder):
    folder.write("a.txt", A)
    folder.write("sub/b.md", B)
    listing = folder.listing()
    assert rows(listing, "name", "suffix", "length") == [("a.txt", ".txt", len(A)), ("b.md", ".md", len(B))]
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    assert rows(folder.listing(glob=["*.md", "*.x"]), "name") == [("b.md",)]
    assert rows(folder.listing(max_bytes=len(B)), "name") == [("b.md",)]
    assert rows(folder.listing(recursive=False), "name") == [("a.txt",)]


def test_fetch_survives_a_vanished_file(spark, folder):
    folder.write("a.txt", A)
    folder.write("b.txt", B)
    listing = folder.listing()
    listing = spark.createDataFrame(listing.collect(), listing.schema)
    folder.remove("b.txt")
    fetched = files.fetch_changed(listing)
    out = {r["name"]: r["content"] for r in fetched.collect()}
    assert bytes(out["a.txt"]) == A.encode() and out["b.txt"] is None
    assert [r["path"].rsplit("/", 1)[1] for r in files.fetch_errors(fetched).collect()] == ["b.txt"]


def test_fetch_holds_an_object_once(tmp_path):
    """The bytes reach the batch without a copy; packed objects are still unpacked."""
    import gzip
    import tracemalloc

    import pyarrow as pa

    size = 8 << 20
    (tmp_path / "big.bin").write_bytes(b"x" * size)
    (tmp_path / "packed.gz").write_bytes(gzip.compress(b"inside"))
    paths = pa.array([str(tmp_path / n) for n in ("big.bin", "packed.gz", "none.bin")])
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("fetch_error", pa.string())])
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    read = files._read_objects([pa.RecordBatch.from_arrays([paths], names=["path"])], schema)
    first = next(read)
    assert tracemalloc.get_traced_memory()[1] < size / 4 and pa.total_allocated_bytes() - before < 1.5 * size
    tracemalloc.stop()
    assert len(first.column(1)[0].as_buffer()) == size
    rest = [x.to_pylist()[0] for x in read]
    assert rest[0]["content"] == b"inside" and rest[1]["content"] is None and "none.bin" in rest[1]["fetch_error"]


# --- incremental index ----------------------------------------------------


def test_add_modify_delete(spark, folder, kept):
    folder.write("a.txt", A)
    folder.write("b.txt", B)
    assert run(folder, kept, 1)
    assert names(kept) == ["a.txt", "b.txt"]
    old = {r["chunk_id"] for r in kept.read().where("doc_key LIKE '%/a.txt'").collect()}
    assert not run(folder, kept, 2)  # nothing changed, nothing committed

    folder.remove("b.txt")
    folder.write("c.txt", "third page on bridges and incremental computation")
    folder.write("a.txt", A + " revised")
    assert run(folder, kept, 3)
    assert names(kept) == ["a.txt", "c.txt"]
    new = {r["chunk_id"] for r in kept.read().where("doc_key LIKE '%/a.txt'").collect()}
    assert new and not (new & old)


def test_exact_text_ranks_first_and_deleted_is_gone(spark, folder, kept):
    folder.write("a.txt", A)
    folder.write("b.txt", B)
    run(folder, kept, 1)
    asked = make_queries(spark, [A])
    for hybrid in (False, True):
        rows_ = kept.read()
        best = retrieve(rows_, bm25_index(rows_), asked, RetrieveOptions(k=2, hybrid=hybrid)).orderBy("rank").head()
        assert best["text"] == A
    folder.remove("b.txt")
    run(folder, kept, 2)
    assert [r["text"] for r in kept.read().collect()] == [A]


def test_incremental_equals_rebuild(spark, folder, kept, tmp_path):
    for i in range(12):
        folder.write(f"{i}.txt", f"document {i} " * 40)
    run(folder, kept, 1)
    for i in (1, 4):
        folder.remove(f"{i}.txt")
    for i in (2, 20):
        folder.write(f"{i}.txt", f"changed {i}")
    run(folder, kept, 2)
    other = ChunkStore(spark, str(tmp_path / "other")).create()
    run(folder, other, 1)
    same = [("first", 0), ("second", 0)]
    assert rows(st.restart_equivalence(kept.read(), other.read())) == same
    before = kept.read()
    kept.compact()
    assert rows(st.restart_equivalence(kept.read(), other.read())) == same
    # A frame read before the compaction still holds.
    assert rows(st.restart_equivalence(before, other.read())) == same
    folder.write("2.txt", "changed again")
    run(folder, kept, 3)
    assert kept.read().where("text = 'changed again'").count() == 1
    assert rows(kept.manifest(), "path") == rows(folder.listing(), "path")


def chunks_of(spark, *pairs):
    data = [(f"id-{d}-{t}", d, 0, t, "{}", [1.0]) for d, t in pairs]
    return spark.createDataFrame(data, st.STORE_SCHEMA)


def test_many_versions_are_tidied(spark, folder, kept):
    for i in range(5):
        folder.write("a.txt", f"version {i}")
        run(folder, kept, i, tidy_every=2)
    assert [r["text"] for r in kept.read().collect()] == ["version 4"]
    assert len(kept._live()) <= 3


def test_merge_keeps_the_base_and_folds_the_changes(spark, kept, tmp_path, monkeypatch):
    monkeypatch.setattr(ChunkStore, "ROLL", 2)  # a new log generation every other commit
    key = lambda *ks: spark.createDataFrame([(k,) for k in ks], "doc_key string")

    def apply(batch, gone, *pairs):
        assert kept.apply(batch, key(*gone), chunks_of(spark, *pairs))

    apply(0, ["a", "b", "c", "d"], ("a", "1"), ("b", "1"), ("c", "1"), ("d", "1"))
    kept.compact()
    base = kept._live()[0]["version"]
    apply(1, ["a"], ("a", "2"), ("e", "2"))
    apply(2, ["b", "e"], ("e", "3"))
    want = [("a", "2"), ("c", "1"), ("d", "1"), ("e", "3")]
    assert rows(kept.read(), "doc_key", "text") == want
    kept.merge()
    live = kept._live()
    assert [r["kind"] for r in live] == ["compact", "merge"] and live[0]["version"] == base
    assert rows(kept.read(), "doc_key", "text") == want
    apply(3, ["a", "c"], ("c", "4"))
    want = [("c", "4"), ("d", "1"), ("e", "3")]
    assert rows(kept.read(), "doc_key", "text") == want
    kept.tidy(max_changes=2, share=0.9)
    assert [r["kind"] for r in kept._live()] == ["compact", "merge"]
    kept.tidy(max_changes=1, share=0.1)
    assert [r["kind"] for r in kept._live()] == ["compact"]
    assert rows(kept.read(), "doc_key", "text") == want
    # A reader that starts later finds the newest log generation; ids stay known.
    later = ChunkStore(spark, kept.root)
    assert rows(later.read(), "doc_key", "text") == want and later._gen >= 3
    assert not later.apply(2, key("d"), chunks_of(spark))


def test_replayed_batch_is_skipped_and_crash_leaves_old_state(spark, kept):
    keys = spark.createDataFrame([("d1",)], "doc_key string")
    assert kept.apply(7, keys, chunks_of(spark, ("d1", "x")))
    assert not kept.apply(7, keys, chunks_of(spark, ("d1", "y")))
    assert [r["text"] for r in kept.read().collect()] == ["x"]
    # A batch that died before its log row: its files are there but do not count.
    chunks_of(spark, ("d1", "z")).write.parquet(f"{kept.root}/chunks/ver=2")
    assert [r["text"] for r in kept.read().collect()] == ["x"]
    assert kept.apply(8, keys, chunks_of(spark, ("d1", "w")))
    assert [r["text"] for r in kept.read().collect()] == ["w"]


def test_missing_and_empty_stores(spark, tmp_path, folder):
    absent = ChunkStore(spark, str(tmp_path / "absent"))
    assert not absent.exists()
    with pytest.raises(IndexNotReady):
        absent.read()
    empty = absent.create().create()
    assert empty.exists() and empty.read().count() == 0 and empty.read().schema == st.STORE_SCHEMA
    asked = make_queries(spark, ["anything"])
    assert retrieve(empty.read(), bm25_index(empty.read()), asked, RetrieveOptions(k=3)).count() == 0
    # An empty store is fine only while the sources hold nothing.
    assert st.is_ready(empty.read(), [folder.listing()])
    folder.write("late.txt", "late words")
    assert not st.is_ready(empty.read(), [folder.listing()])
    run(folder, empty, 1)
    assert st.is_ready(empty.read(), [folder.listing()])


# --- pure functions -------------------------------------------------------


def test_upsert_replaces_same_id(spark):
    store = chunks_of(spark, ("a", "1"), ("b", "2"))
    gone = spark.createDataFrame([("b",)], "doc_key string")
    out = st.snapshot_upsert(store, gone, chunks_of(spark, ("a", "1"), ("c", "3")))
    assert rows(out, "doc_key", "text") == [("a", "1"), ("c", "3")]
    assert rows(st.retract_chunks(store, gone), "doc_key") == [("b",)]


def test_changelog_with_a_hot_key(spark):
    data = [("hot", i, "upsert", f"v{i}") for i in range(500)] + [("gone", 1, "upsert", "x"), ("gone", 2, "delete", None)]
    feed = spark.createDataFrame(data, "key string, seq long, op string, body string").repartition(7)
    assert rows(st.changelog_latest(feed, ["key"], "seq"), "key", "body") == [("hot", "v499")]


@pytest.mark.parametrize("backend", st.SINKS)
def test_sink_columns(spark, docs5, backend):
    out = st.sink_shape(docs5, backend)
    assert ("chunk_id" in out.columns) == (backend not in ("qdrant", "mongodb"))
    meta = out.head()["metadata"]
    assert meta["path"].startswith("/docs/") if isinstance(meta, dict) else '"path"' in meta


def test_fingerprint(spark, docs5):
    base = {"splitter": {"chunk_size": 512}, "embedder": {"model": "small", "api_key": "s3cret"}}
    old = st.with_fingerprint(docs5, base)
    assert "s3cret" not in str(st.fingerprint(base))
    st.check_fingerprint(old, st.fingerprint(base))
    changed = st.fingerprint({**base, "splitter": {"chunk_size": 256}})
    with pytest.raises(RuntimeError, match="splitter"):
        st.check_fingerprint(old, changed)
    st.check_fingerprint(old, changed, accept=True)
    model = st.fingerprint({**base, "embedder": {"model": "large"}})
    assert rows(st.fingerprint_drift(old, model), "section", "n_documents", "n_chunks") == [("embedder", 5, 5)]


def test_stats(spark, docs5):
    got = st.index_stats(docs5).head()
    assert (got["chunks"], got["documents"], got["last_indexed_at"]) == (5, 5, None)
    seen = docs5.withColumn("metadata_json", F.concat(F.lit('{"path":"p","seen_at":'), F.substring("chunk_id", 2, 1), F.lit("}")))
    got = st.index_stats(seen).head()
    assert (got["chunks"], got["documents"], got["last_indexed_at"]) == (5, 1, 4)
    assert st.index_stats(seen, approximate=True).head()["documents"] == 1
    assert st.index_stats(docs5.limit(0)).head()["chunks"] == 0


# --- streams --------------------------------------------------------------

FEED = "doc_key string, seq long, op string, text string"


def drop(spark, path, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)


def test_stream_index_over_restarts(spark, tmp_path, kept):
    source, progress = str(tmp_path / "feed"), str(tmp_path / "progress")
    seen = []
    opts = index.IndexOptions(on_batch=lambda b, new, gone: seen.append((new.count(), gone.count())))

    def step(data):
        drop(spark, source, data, FEED)
        feed = spark.readStream.schema(FEED).parquet(source)
        index.stream_index(feed, kept, progress, ["doc_key"], opts, static=True).awaitTermination()
        return rows(kept.read(), "doc_key", "text")

    assert step([("a", 1, "upsert", "one"), ("b", 2, "upsert", "two"), ("a", 3, "upsert", "three")]) == [("a", "three"), ("b", "two")]
    assert step([("b", 4, "delete", None), ("c", 5, "upsert", "")]) == [("a", "three")]
    assert step([("a", 6, "delete", None), ("a", 7, "upsert", "four")]) == [("a", "four")]
    assert seen == [(2, 2), (0, 2), (1, 1)]


def test_stream_retract_over_restarts(spark, tmp_path):
    source, progress, out = (str(tmp_path / n) for n in ("feed", "progress", "out"))
    schema = "doc_key string, seq long, op string, chunk_ids array<string>"

    def step(data):
        drop(spark, source, data, schema)
        feed = spark.readStream.schema(schema).parquet(source)
        job = retract.stream_retract(feed).writeStream.option("checkpointLocation", progress).trigger(availableNow=True)
        job.start(out, format="parquet", outputMode="append").awaitTermination()
        net = spark.read.schema(retract.OUT).parquet(out).groupBy("doc_key", "chunk_id").agg(F.sum("diff").alias("n"))
        assert net.where("n NOT IN (0, 1)").count() == 0
        return rows(net.where("n = 1"), "doc_key", "chunk_id")

    assert step([("a", 1, "upsert", ["x", "y"]), ("b", 2, "upsert", ["z"]), ("b", 3, "upsert", ["w"])]) == [("a", "x"), ("a", "y"), ("b", "w")]
    assert step([("a", 4, "upsert", ["y", "v"])]) == [("a", "v"), ("a", "y"), ("b", "w")]
    assert step([("a", 5, "delete", None), ("b", 1, "upsert", ["stale"])]) == [("b", "w")]


def test_polling_sees_late_edited_and_removed_files(spark, tmp_path, folder, kept):
    job = index.poll_source(spark, folder.listing, kept, str(tmp_path / "progress"), refresh_interval="1 second")

    def wait_for(want):
        end = time.time() + 60
        while time.time() < end:
            assert job.exception() is None
            if sorted(r["text"] for r in kept.read().select("text").collect()) == want:
                return
            time.sleep(0.5)
        raise AssertionError(f"never saw {want}")

    try:
        wait_for([])
        folder.write("late.txt", "late words")
        wait_for(["late words"])
        folder.write("late.txt", "edited words!")
        wait_for(["edited words!"])
        folder.remove("late.txt")
        wait_for([])
    finally:
        job.stop()


def test_counters(spark, tmp_path):
    df, watch = counters.stage_counters(spark.range(10).withColumn("seen", F.lit(5)), "rows", "seen")
    df.write.format("noop").mode("overwrite").save()
    assert watch.get["rows"] == 10 and watch.get["newest"] == 5 and watch.get["lag_seconds"] > 0

    log = counters.ProgressLog()
    spark.streams.addListener(log)
    try:
        source = str(tmp_path / "in")
        drop(spark, source, [(1,), (2,)], "x long")
        stream = counters.stream_counters(spark.readStream.schema("x long").parquet(source), "in")
        job = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start()
        job.awaitTermination()
        end = time.time() + 20
        while time.time() < end and not any(b["observed"].get("in", {}).get("rows") == 2 for b in log.batches):
            time.sleep(0.2)
        assert any(b["observed"]["in"]["rows"] == 2 for b in log.batches if "in" in b["observed"])
    finally:
        spark.streams.removeListener(log)


def test_odd_names_are_read_and_failures_retried(spark, folder, kept):
    texts = {n: f"text of {n}" for n in ("a b.txt", "a%20b.txt", "é.txt", "c#d.txt", "e?f.txt")}
    for name, text in texts.items():
        folder.write(name, text)
    folder.write("p.pdf", "no parser")
    seen = []
    assert run(folder, kept, 1, on_errors=lambda _, e: seen.extend(e.collect()))
    got = {r["doc_key"].rsplit("/", 1)[1]: r["text"] for r in kept.read().collect()}
    assert got == texts
    assert [(r["path"].rsplit("/", 1)[1], r["reason"][:11]) for r in seen] == [("p.pdf", "no function")]
    # Only the failed object is tried again.
    seen.clear()
    assert not run(folder, kept, 2, on_errors=lambda _, e: seen.extend(e.collect()))
    assert len(seen) == 1


def test_two_jobs_number_their_batches_alike(spark, kept):
    key = lambda k: spark.createDataFrame([(k,)], "doc_key string")
    assert kept.apply(1, key("a"), chunks_of(spark, ("a", "x")), job="one")
    assert kept.apply(1, key("b"), chunks_of(spark, ("b", "y")), job="two")
    assert not kept.apply(1, key("b"), chunks_of(spark, ("b", "z")), job="two")
    assert rows(kept.read(), "doc_key", "text") == [("a", "x"), ("b", "y")]
