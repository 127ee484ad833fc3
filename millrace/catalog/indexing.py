"""Chunking, embedding and keeping the store."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from millrace.catalog import frames, query
from millrace.catalog import sql as q
from millrace.functions import vectors as vx
from millrace.operators import chunk, embed
from millrace.operators import store as st
from millrace.operators.keyword import bm25_refresh as refresh
from millrace.session import new_dir, written

# --- chunking -------------------------------------------------------------


@query(
    sql="SELECT doc_id, len(c) AS n_chunks, md5(array_to_string(c, chr(30))) AS chunks_md5, "
    f"length(array_to_string(c, '')) AS n_chars FROM (SELECT doc_id, {q.token_chunks('text', 64)} AS c FROM documents)"
)
def chunk_token_count(spark, sf_dir):
    docs = frames.table(spark, sf_dir, "documents", ["doc_id", "text"], "doc_id")
    c = chunk.chunk_token_count(docs, 64)
    return c.select(
        "doc_id",
        F.size("chunks").alias("n_chunks"),
        F.md5(F.array_join("chunks", "\x1e")).alias("chunks_md5"),
        F.length(F.array_join("chunks", "")).alias("n_chars"),
    )


@query(
    sql=q.build(
        "SELECT doc_id, len(m) AS n_chunks, md5(array_to_string(m, chr(30))) AS chunks_md5 "
        f"FROM (SELECT doc_id, {q.tail_merged('c')} AS m FROM cut)",
        f"cut AS (SELECT doc_id, {q.token_chunks('text', 32)} AS c FROM documents)",
    )
)
def chunk_tail_merge(spark, sf_dir):
    docs = frames.table(spark, sf_dir, "documents", ["doc_id", "text"], "doc_id")
    c = chunk.chunk_tail_merge(chunk.chunk_token_count(docs, 32))
    return c.select("doc_id", F.size("chunks").alias("n_chunks"), F.md5(F.array_join("chunks", "\x1e")).alias("chunks_md5"))


@query()
def chunk_recursive(spark, sf_dir):
    docs = frames.table(spark, sf_dir, "documents", ["doc_id", "text"], "doc_id")
    c = chunk.chunk_recursive(docs, 512, 50)
    return c.select("doc_id", F.posexplode("chunks").alias("pos", "text"))


@query(sql=q.build("SELECT doc_key, pos, md5(text) AS text_md5, metadata_json FROM chunks", q.CHUNKS))
def chunk_explode(spark, sf_dir):
    c = frames.chunks(spark, sf_dir)
    return c.select("doc_key", "pos", F.md5("text").alias("text_md5"), "metadata_json")


@query(
    sql=q.build(
        "SELECT doc_id, json_object('lang', lang, 'length', length::VARCHAR, 'path', path, 'source', source)::VARCHAR AS metadata_json FROM docs",
        q.DOCS,
    )
)
def metadata_json(spark, sf_dir):
    docs = frames.documents(spark, sf_dir, "lang")
    return chunk.metadata_json(docs, ["source", "path", "length", "lang"]).select("doc_id", "metadata_json")


@query(sql=q.build("SELECT chunk_id, doc_key, pos FROM chunks", q.CHUNKS))
def chunk_id(spark, sf_dir):
    return frames.chunks(spark, sf_dir).select("chunk_id", "doc_key", "pos")


# --- embedding ------------------------------------------------------------

_BYTES = "array_to_string(list_transform({v}, lambda x: round(x * 255)::INT), ',')"


def _as_bytes(column: str):
    """A vector as a comparable string of its bytes."""
    return F.array_join(F.transform(column, lambda x: F.round(x * 255).cast("int").cast("string")), ",")


@query(
    sql=q.build(f"SELECT chunk_id, len(embedding) AS dim, {_BYTES.format(v='embedding')} AS vector FROM store", q.STORE)
)
def embed_mock(spark, sf_dir):
    e = embed.embed_mock(frames.chunks(spark, sf_dir))
    return e.select("chunk_id", F.size("embedding").alias("dim"), _as_bytes("embedding").alias("vector"))


def hash_model():
    """The offline embedding as a batched Python model."""
    def encode(texts: list[str]) -> np.ndarray:
        digests = [np.frombuffer(hashlib.sha256(t.encode()).digest(), dtype=np.uint8) for t in texts]
        return np.tile(np.stack(digests) / 255.0, (1, vx.MOCK_DIM // 32))

    return encode


@query(
    sql=q.build(f"SELECT chunk_id, {_BYTES.format(v='embedding')} AS vector FROM store", q.STORE)
)
def embed_batch(spark, sf_dir):
    e = embed.embed_batch(frames.chunks(spark, sf_dir), hash_model, batch_size=64)
    return e.select("chunk_id", _as_bytes("embedding").alias("vector"))


@query(
    sql=q.build(
        f"SELECT chunk_id, text_md5, {_BYTES.format(v=q.vector_of('h'))} AS vector FROM "
        "(SELECT chunk_id, md5(text) AS text_md5, sha256('passage: ' || text) AS h FROM chunks)",
        q.CHUNKS,
    )
)
def embed_prefix(spark, sf_dir):
    e = embed.embed_mock(embed.embed_prefix(frames.chunks(spark, sf_dir), "passage: "), column="embed_input")
    return e.select("chunk_id", F.md5("text").alias("text_md5"), _as_bytes("embedding").alias("vector"))


# Every 16-bit word hash picks one of the given vectors as the word's vector.
@query(
    sql=q.build(
        "SELECT doc_id, round(list_extract(e, 1)::DOUBLE, 6) AS first, round(list_extract(e, 64)::DOUBLE, 6) AS last, "
        "round(list_sum(list_transform(e, lambda x, i: x::DOUBLE * i)), 3) AS weighted FROM means",
        f"tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({q.words('text')}) AS term FROM documents) GROUP BY ALL)",
        "lookup AS (SELECT term, embedding AS vec FROM (SELECT DISTINCT term, ('0x' || substr(md5(term), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id FROM tf) JOIN embeddings USING (vec_id))",
        "dims AS (SELECT doc_id, i, (sum(tf * vec[i]::DOUBLE) / sum(tf))::FLOAT AS x FROM tf JOIN lookup USING (term) CROSS JOIN range(1, 65) r(i) GROUP BY doc_id, i)",
        "means AS (SELECT doc_id, list(x ORDER BY i) AS e FROM dims GROUP BY doc_id)",
    )
)
def embed_static(spark, sf_dir):
    from millrace.functions import text as tx

    docs = frames.table(spark, sf_dir, "documents", ["doc_id", "text"], "doc_id")
    known = frames.vectors(spark, sf_dir).select("vec_id", F.col("embedding").alias("vec"))
    n = known.agg(F.count(F.lit(1)).alias("n")).scalar()
    terms = docs.select(F.explode_outer(tx.words(F.col("text"))).alias("term")).distinct().where("term IS NOT NULL")
    vec_id = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("bigint") % n
    lookup = written(terms.withColumn("vec_id", vec_id).join(known, "vec_id").select("term", "vec"), "lookup")
    # The mean of no tokens is no vector to SQL: texts without a word are left out here.
    e = embed.embed_static(docs, lookup, 64, key="doc_id").where("n_known > 0")
    weighted = F.aggregate(
        F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x
    )
    return e.select(
        "doc_id",
        F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"),
        F.round(F.get("embedding", F.lit(63)).cast("double"), 6).alias("last"),
        F.round(weighted, 3).alias("weighted"),
    )


@query(
    sql=q.build(f"SELECT chunk_id, {_BYTES.format(v='embedding')} AS vector FROM store", q.STORE)
)
def embed_dedup_cache(spark, sf_dir):
    rows = frames.stored_chunks(spark, sf_dir)
    # The cache holds the texts of the benchmark items and of labelled documents.
    old, _ = frames.before_and_after(spark, sf_dir)
    seen = chunk.build_chunks(old, frames.META).select("text").distinct()
    cache = embed.embed_mock(seen).select(F.sha2("text", 256).alias("text_key"), F.lit("mock").alias("model"), "embedding")
    out, _ = embed.embed_dedup_cache(rows, written(cache, "cache"), embed.embed_mock, "mock")
    return out.select("chunk_id", _as_bytes("embedding").alias("vector"))


@query(
    sql="SELECT vec_id, len(e) AS dim, round(list_sum(list_transform(e, lambda x: x::DOUBLE)), 6) AS total "
    "FROM (SELECT vec_id, embedding[1:16] AS e FROM embeddings)"
)
def truncate_dim(spark, sf_dir):
    e = embed.truncate_dim(frames.vectors(spark, sf_dir), 16)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return e.select("vec_id", F.size("embedding").alias("dim"), F.round(total, 6).alias("total"))


@query(
    sql="SELECT dim, count(*) AS n, dim = 64 AS accepted FROM (SELECT CASE WHEN label % 2 = 0 THEN 64 ELSE 48 END AS dim FROM embeddings) GROUP BY dim"
)
def embedding_dimension(spark, sf_dir):
    v = frames.vectors(spark, sf_dir)
    mixed = v.withColumn(
        "embedding", F.when(F.col("label") % 2 == 0, F.col("embedding")).otherwise(vx.first_dims(F.col("embedding"), 48))
    )
    return embed.embedding_dimension(mixed, 64)


# --- index maintenance ----------------------------------------------------


@query(sql=q.build("SELECT path, change, length, mtime FROM diff", q.DIFF))
def snapshot_diff(spark, sf_dir):
    old, new = frames.before_and_after(spark, sf_dir)
    return st.snapshot_diff(old, new).select("path", "change", "length", "mtime")


def _changed(old, new):
    diff = st.snapshot_diff(old, new).withColumn("doc_key", F.col("path"))
    gone = diff.where(F.col("change").isin("deleted", "modified")).select("doc_key")
    fresh = new.join(diff.where(F.col("change").isin("added", "modified")).select("doc_key"), "doc_key", "left_semi")
    return gone, fresh


@query(
    sql=q.build(
        "SELECT chunk_id, doc_key FROM old_chunks WHERE doc_key IN (SELECT path FROM diff WHERE change IN ('deleted', 'modified'))",
        q.DIFF,
        q.chunk_ctes("old_chunks", "old_docs"),
    )
)
def retract_chunks(spark, sf_dir):
    old, new = frames.before_and_after(spark, sf_dir)
    gone, _ = _changed(old, new)
    return st.retract_chunks(chunk.build_chunks(old, frames.META), gone).select("chunk_id", "doc_key")


@query(sql=q.build("SELECT chunk_id, doc_key, pos FROM new_chunks", q.BEFORE_AFTER, q.chunk_ctes("new_chunks", "new_docs")))
def snapshot_upsert(spark, sf_dir):
    old, new = frames.before_and_after(spark, sf_dir)
    gone, fresh = _changed(old, new)
    after = st.snapshot_upsert(chunk.build_chunks(old, frames.META), gone, chunk.build_chunks(fresh, frames.META))
    return after.select("chunk_id", "doc_key", "pos")


def _stored(spark, sf_dir):
    """The second state of the corpus, reached through two commits of a store."""
    old, new = frames.before_and_after(spark, sf_dir)
    gone, fresh = _changed(old, new)
    kept = st.ChunkStore(spark, new_dir(spark, "index")).create()
    build = lambda docs: embed.embed_mock(chunk.build_chunks(docs, frames.META))
    kept.apply(1, old.select("doc_key"), build(old))
    kept.apply(2, gone, build(fresh))
    return kept, build(new)


@query(
    "chunk_store",
    sql=q.build(
        f"SELECT chunk_id, doc_key, pos, {_BYTES.format(v=q.vector_of('h'))} AS vector FROM (SELECT *, sha256(text) AS h FROM new_chunks)",
        q.BEFORE_AFTER,
        q.chunk_ctes("new_chunks", "new_docs"),
    ),
)
def chunk_store(spark, sf_dir):
    kept, _ = _stored(spark, sf_dir)
    kept.compact()
    return kept.read().select("chunk_id", "doc_key", "pos", _as_bytes("embedding").alias("vector"))


@query(sql="SELECT 'first' AS side, 0::BIGINT AS n UNION ALL SELECT 'second', 0::BIGINT")
def restart_equivalence(spark, sf_dir):
    kept, rebuilt = _stored(spark, sf_dir)
    return st.restart_equivalence(kept.read(), rebuilt)


@query(
    sql="SELECT user_id, event_id, event_type, value FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'"
)
def changelog_latest(spark, sf_dir):
    feed = frames.events(spark, sf_dir, "event_id", "user_id", "event_type", "value")
    live = st.changelog_latest(feed, ["user_id"], "event_id", op="event_type", delete="error")
    return live.select("user_id", "event_id", "event_type", "value")


def _sink_rows(backend: str) -> str:
    keyed = backend not in ("qdrant", "mongodb")
    native = backend in ("pgvector", "milvus", "qdrant", "mongodb")
    document = "document" if backend == "chroma" else "text"
    vector = "vector" if backend in ("weaviate", "pinecone") else "embedding"
    columns = [*(["chunk_id"] if keyed else []), document, "metadata", vector]
    meta = "json_extract_string(metadata_json, '$.path')" if native else "metadata_json"
    return (
        f"SELECT '{backend}' AS backend, '{','.join(columns)}' AS columns, "
        f"{'chunk_id' if keyed else 'NULL::VARCHAR'} AS record_key, md5(text) AS text_md5, "
        f"{meta} AS metadata, {str(native).lower()} AS native_metadata FROM chunks"
    )


@query(sql=q.build(" UNION ALL ".join(_sink_rows(b) for b in st.SINKS), q.CHUNKS))
def sink_shape(spark, sf_dir):
    rows = embed.embed_mock(frames.chunks(spark, sf_dir))
    out = None
    for backend in st.SINKS:
        shaped = st.sink_shape(rows, backend)
        native = shaped.schema["metadata"].dataType.typeName() == "map"
        document = "document" if "document" in shaped.columns else "text"
        part = shaped.select(
            F.lit(backend).alias("backend"),
            F.lit(",".join(shaped.columns)).alias("columns"),
            (F.col("chunk_id") if "chunk_id" in shaped.columns else F.lit(None).cast("string")).alias("record_key"),
            F.md5(document).alias("text_md5"),
            (F.col("metadata")["path"] if native else F.col("metadata")).alias("metadata"),
            F.lit(native).alias("native_metadata"),
        )
        out = part if out is None else out.unionByName(part)
    return out


_NOW = {
    "splitter": {"type": "token_count", "chunk_size": 512},
    "parser": {"rules": [{"match": "*.pdf", "type": "docling", "api_key": "secret"}]},
    "embedder": {"type": "sentence_transformer", "model": "large"},
    "libraries": {"splitters": "2"},
}
_OLD_SPLITTER = {**_NOW, "splitter": {"type": "token_count", "chunk_size": 256}}
_OLD_MODEL = {**_NOW, "embedder": {"type": "sentence_transformer", "model": "small"}, "libraries": {"splitters": "1"}}


def _drift_sql(section: str, lang: str, old: dict) -> str:
    return (
        f"SELECT '{section}' AS section, '{st.fingerprint(old)[section]}' AS stored, '{st.fingerprint(_NOW)[section]}' AS current, "
        f"count(DISTINCT doc_key) AS n_documents, count(*) AS n_chunks FROM chunks JOIN docs USING (doc_key) WHERE lang = '{lang}' HAVING count(*) > 0"
    )


@query(
    sql=q.build(
        " UNION ALL ".join(
            [
                _drift_sql("splitter", "de", _OLD_SPLITTER),
                _drift_sql("embedder", "fr", _OLD_MODEL),
                _drift_sql("libraries", "fr", _OLD_MODEL),
            ]
        ),
        q.CHUNKS,
    )
)
def fingerprint_drift(spark, sf_dir):
    docs = frames.documents(spark, sf_dir, "lang")
    # German texts were indexed with smaller chunks, French ones with another model.
    states = {"de": _OLD_SPLITTER, "fr": _OLD_MODEL}
    rows = None
    for settings, part in [
        *((s, docs.where(F.col("lang") == lang)) for lang, s in states.items()),
        (_NOW, docs.where(~F.col("lang").isin(*states))),
    ]:
        built = st.with_fingerprint(chunk.build_chunks(part, frames.META), settings)
        rows = built if rows is None else rows.unionByName(built)
    return st.fingerprint_drift(rows, st.fingerprint(_NOW))


@query(
    sql=q.build(
        "SELECT count(*) AS chunks, count(DISTINCT doc_key) AS documents, max(CASE WHEN doc_id % 7 <> 0 THEN 1700000000 + doc_id END)::BIGINT AS last_indexed_at FROM chunks JOIN docs USING (doc_key)",
        q.CHUNKS,
    )
)
def index_stats(spark, sf_dir):
    docs = frames.documents(spark, sf_dir)
    # Some documents carry a time that is not a number.
    seen = F.when(F.col("doc_id") % 7 == 0, F.lit("unknown")).otherwise((F.col("doc_id") + 1700000000).cast("string"))
    rows = chunk.build_chunks(docs.withColumn("seen_at", seen), [*frames.META, "seen_at"])
    return st.index_stats(rows)


@query(
    sql=q.build(
        "SELECT term, df, round(idf, 6) AS idf FROM k_idf",
        q.BEFORE_AFTER,
        q.chunk_ctes("new_chunks", "new_docs"),
        q.keyword_ctes("new_chunks", "k_"),
    )
)
def bm25_refresh(spark, sf_dir):
    old, new = frames.before_and_after(spark, sf_dir)
    gone, fresh = _changed(old, new)
    before = written(chunk.build_chunks(old, frames.META), "chunks")
    deletes = st.retract_chunks(before, gone).select("chunk_id")
    after = refresh(frames.stored_index(before), deletes, chunk.build_chunks(fresh, frames.META))
    return after.term_stats.select("term", "df", F.round("idf", 6).alias("idf"))
