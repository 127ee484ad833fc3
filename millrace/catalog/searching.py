"""Search, fusion and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import frames, query
from millrace.catalog import sql as q
from millrace.operators import keyword, rank, vector
from millrace.operators import retrieve as rt

_SHOWN = ["query_id", "rank", "chunk_id"]
_SHOW_SQL = "SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM"


def _shown(df):
    return df.select(*_SHOWN, F.round("score", 6).alias("score"))


def _asked(spark, sf_dir):
    return rt.mock_queries(frames.questions(spark, sf_dir))


# --- vectors --------------------------------------------------------------


@query(
    sql=q.build(f"{_SHOW_SQL} near", q.STORE, q.VECTOR_QUESTIONS, q.vector_hits("near", "q_vec", "store", 5))
)
def vector_topk(spark, sf_dir):
    return _shown(vector.vector_topk(frames.store(spark, sf_dir), _asked(spark, sf_dir), 5))


_NEIGHBOURS = q.vector_hits("near", "embeddings", "embeddings", 20, qid="vec_id", sid="vec_id")
_NEIGHBOUR_SQL = "SELECT query_id, rank, vec_id, round(score, 6) AS score FROM near"


def _neighbours(spark, sf_dir, k):
    v = frames.vectors(spark, sf_dir)
    asked = v.select(F.col("vec_id").alias("query_id"), "embedding")
    return v, asked, vector.vector_topk(v, asked, k, carry=("embedding",), id_col="vec_id")


@query(sql=q.build(f"{_NEIGHBOUR_SQL} WHERE rank <= 5", _NEIGHBOURS))
def vector_topk_neighbours(spark, sf_dir):
    _, _, near = _neighbours(spark, sf_dir, 5)
    return near.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query()
def ann_topk(spark, sf_dir):
    v, asked, _ = _neighbours(spark, sf_dir, 5)
    near = vector.ann_topk(v, asked, 5, n_cells=16, n_probe=6, carry=(), id_col="vec_id")
    return near.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query(sql=q.build(f"{_NEIGHBOUR_SQL} WHERE rank <= 5", _NEIGHBOURS))
def ann_topk_all_cells(spark, sf_dir):
    v, asked, _ = _neighbours(spark, sf_dir, 5)
    near = vector.ann_topk(v, asked, 5, n_cells=8, n_probe=8, carry=(), id_col="vec_id")
    return near.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


_BACKENDS = list(vector.BACKEND_SCORES)
_BACKEND_LIST = "[" + ", ".join(f"'{b}'" for b in _BACKENDS) + "]"


@query(
    sql="SELECT event_id, backend, round(CASE WHEN raw IS NULL THEN 0.0::DOUBLE WHEN backend IN ('pgvector', 'chroma', 'weaviate') THEN 1.0::DOUBLE - raw "
    "WHEN backend = 'mongodb' THEN 2.0::DOUBLE * raw - 1.0::DOUBLE ELSE raw END, 6) AS score FROM "
    f"(SELECT event_id, {_BACKEND_LIST}[event_id % 8 + 1] AS backend, CASE WHEN event_type <> 'error' THEN value / 100.0::DOUBLE END AS raw FROM events)"
)
def score_normalize(spark, sf_dir):
    e = frames.events(spark, sf_dir, "event_id", "event_type", "value")
    names = F.array(*[F.lit(b) for b in _BACKENDS])
    raw = F.when(F.col("event_type") != "error", F.col("value") / 100.0)
    hits = e.select("event_id", F.get(names, (F.col("event_id") % 8).cast("int")).alias("backend"), raw.alias("raw"))
    return vector.score_normalize(hits).select("event_id", "backend", F.round("score", 6).alias("score"))


# --- words ----------------------------------------------------------------


@query(
    sql=f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {q.words('text')} AS t FROM documents)"
)
def tokenize(spark, sf_dir):
    docs = frames.table(spark, sf_dir, "documents", ["doc_id", "text"], "doc_id")
    t = keyword.tokenize(docs)
    return t.select("doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query(
    sql=q.build(
        "SELECT t.term, s.df, round(s.idf, 6) AS idf, sum(t.tf)::BIGINT AS tf, sum(d.dl)::BIGINT AS dl FROM tf t JOIN idf s USING (term) JOIN dl d USING (chunk_id) GROUP BY ALL",
        q.CHUNKS,
        q.keyword_ctes("chunks"),
    )
)
def bm25_index(spark, sf_dir):
    index = frames.stored_index(frames.chunks(spark, sf_dir))
    sums = index.postings.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("dl").alias("dl"))
    return sums.join(index.term_stats, "term").select("term", "df", F.round("idf", 6).alias("idf"), "tf", "dl")


_WORDS = [*q.CHUNKS, q.QUESTIONS, *q.keyword_ctes("chunks")]


def _keyword(spark, sf_dir, k):
    rows = frames.stored_chunks(spark, sf_dir)
    asked = frames.questions(spark, sf_dir)
    hits = keyword.bm25_search(frames.stored_index(rows), asked, k)
    return rows, asked, keyword.with_chunks(hits, rows, ("text", "metadata_json"), few_hits=True)


@query(sql=q.build(f"{_SHOW_SQL} bm", _WORDS, q.keyword_hits("bm", "questions", 5)))
def bm25_search(spark, sf_dir):
    rows = frames.chunks(spark, sf_dir)
    asked = frames.questions(spark, sf_dir)
    return _shown(keyword.bm25_search(frames.stored_index(rows), asked, 5))


# --- fusion ---------------------------------------------------------------


def _legs_sql(k):
    return [
        *q.STORE,
        *q.VECTOR_QUESTIONS,
        *q.keyword_ctes("chunks"),
        q.vector_hits("near", "q_vec", "store", k),
        q.keyword_hits("bm", "questions", k),
        "legs AS MATERIALIZED (SELECT query_id, list_id, rank, score, chunk_id, text FROM (SELECT query_id, 0 AS list_id, rank, score, chunk_id FROM near "
        "UNION ALL SELECT query_id, 1, rank, score, chunk_id FROM bm) JOIN chunks USING (chunk_id))",
    ]


def _legs(spark, sf_dir, k):
    store = frames.store(spark, sf_dir)
    near = vector.vector_topk(store, _asked(spark, sf_dir), k, carry=("text",))
    asked = frames.questions(spark, sf_dir)
    hits = keyword.bm25_search(frames.stored_index(store), asked, k)
    words = keyword.with_chunks(hits, store, ("text",), few_hits=True)
    columns = ["query_id", "rank", "score", "chunk_id", "text"]
    return (
        near.select(*columns)
        .withColumn("list_id", F.lit(0))
        .unionByName(words.select(*columns).withColumn("list_id", F.lit(1)))
    )


@query(sql=q.build(f"{_SHOW_SQL} fused", _legs_sql(10), q.fused("fused", "legs", 10)))
def rrf_fuse(spark, sf_dir):
    return _shown(rank.rrf_fuse(_legs(spark, sf_dir, 10), 10))


@query(
    sql=q.build(
        "SELECT query_id, place AS rank, chunk_id, round(score, 6) AS score FROM merged",
        _legs_sql(10),
        q.interleaved("merged", "legs", 8),
    )
)
def interleave_merge(spark, sf_dir):
    return _shown(rank.interleave_merge(_legs(spark, sf_dir, 10), 8))


_HYBRID = (
    "hybrid AS MATERIALIZED (SELECT query_id, rank, chunk_id, score FROM fused UNION ALL "
    "SELECT query_id, rank, chunk_id, score FROM near WHERE query_id NOT IN (SELECT query_id FROM bm))"
)


@query(
    sql=q.build(
        f"{_SHOW_SQL} hybrid",
        _legs_sql(5),
        "worded AS (SELECT * FROM legs WHERE query_id IN (SELECT query_id FROM bm))",
        q.fused("fused", "worded", 5),
        _HYBRID,
    )
)
def hybrid_search(spark, sf_dir):
    store = frames.store(spark, sf_dir)
    asked = _asked(spark, sf_dir)
    return _shown(rt.hybrid_search(store, frames.stored_index(store), asked, 5))


# --- rescoring and diversity ----------------------------------------------


@query(
    sql=q.build(
        "SELECT query_id, place AS rank, chunk_id, round(score, 6) AS score FROM again",
        _WORDS,
        q.keyword_hits("bm", "questions", 30),
        f"scored AS (SELECT query_id, chunk_id, rank, {q.overlap('query', 'text')} AS score FROM bm JOIN chunks USING (chunk_id) JOIN questions USING (query_id))",
        "again AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rank) AS place FROM scored QUALIFY place <= 5)",
    )
)
def rerank_pointwise(spark, sf_dir):
    _, asked, hits = _keyword(spark, sf_dir, 30)
    return _shown(rank.rerank_pointwise(hits.join(asked, "query_id"), 5))


@query(
    sql=q.build(
        "SELECT query_id, chunk_id, md5('{}' || query || '{}' || text || '{}') AS prompt_md5 ".format(*rank.RATING_PROMPT.split("%s"))
        + "FROM bm JOIN chunks USING (chunk_id) JOIN questions USING (query_id)",
        _WORDS,
        q.keyword_hits("bm", "questions", 5),
    )
)
def rerank_prompt(spark, sf_dir):
    _, asked, hits = _keyword(spark, sf_dir, 5)
    prompts = rank.rerank_prompt(hits.join(asked, "query_id"))
    return prompts.select("query_id", "chunk_id", F.md5("prompt").alias("prompt_md5"))


@query(
    sql="SELECT event_id, CASE event_type WHEN 'error' THEN 0.0::DOUBLE WHEN 'view' THEN (event_id % 6)::DOUBLE ELSE round(value, 2)::DECIMAL(12, 2)::DOUBLE END AS rating FROM events"
)
def parse_rating(spark, sf_dir):
    e = frames.events(spark, sf_dir, "event_id", "event_type", "value")
    number = F.round("value", 2).cast("decimal(12,2)").cast("string")
    reply = (
        F.when(F.col("event_type") == "error", F.lit("no idea"))
        .when(F.col("event_type") == "view", (F.col("event_id") % 6).cast("string"))
        .otherwise(F.concat(F.lit("Score: "), number, F.lit("/5, or 3.")))
    )
    return rank.parse_rating(e.select("event_id", reply.alias("reply"))).select("event_id", "rating")


_REPLIES = (
    "replies AS (SELECT u.conv_id * 1000 + u.turn AS query_id, u.text AS query, "
    "'1. ' || replace(a.text, chr(10), chr(10) || '- 2) ') || chr(10) || ' ' || lower(u.text) || ' ' || chr(10) || '*' AS reply "
    "FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"
)


@query(
    sql=q.build("SELECT query_id, list_id, sub_query FROM subs", _REPLIES, q.sub_query_ctes("subs", "replies"))
)
def decompose_parse(spark, sf_dir):
    talks = frames.table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    user = talks.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    answers = talks.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("said")
    )
    # The answer as a numbered and dashed list that also repeats the question.
    reply = F.concat(
        F.lit("1. "), F.replace("said", F.lit("\n"), F.lit("\n- 2) ")), F.lit("\n "), F.lower("query"), F.lit(" \n*")
    )
    replies = user.join(answers, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "query", reply.alias("reply")
    )
    return rank.decompose_parse(replies, 4)


@query(
    sql=q.build(
        "SELECT query_id, place AS rank, vec_id, round(score, 6) AS score FROM mmr",
        _NEIGHBOURS,
        "pool AS (SELECT n.query_id, n.rank, n.vec_id, n.score, e.embedding FROM near n JOIN embeddings e USING (vec_id))",
        q.mmr3_ctes("mmr", "pool"),
    )
)
def mmr_select(spark, sf_dir):
    _, _, near = _neighbours(spark, sf_dir, 20)
    return rank.mmr_select(near, 3).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


# --- the whole path -------------------------------------------------------

_SUBS = q.sub_query_ctes("subs", "asked", 4)
_RETRIEVE = [
    *q.STORE,
    *q.keyword_ctes("chunks"),
    "asked AS (SELECT item_id AS query_id, text AS query, text AS reply FROM benchmark)",
    *_SUBS,
    f"q_vec AS MATERIALIZED (SELECT query_id AS qid, list_id, query, {q.vector_of('h')} AS embedding, (query_id, list_id) AS query_id FROM "
    "(SELECT query_id, list_id, sub_query AS query, sha256('query: ' || sub_query) AS h FROM subs))",
    q.vector_hits("near", "q_vec", "store", 30),
    q.keyword_hits("bm", "q_vec", 30),
    "legs AS MATERIALIZED (SELECT query_id, list_id, rank, score, chunk_id, text FROM (SELECT query_id, 0 AS list_id, rank, score, chunk_id FROM near WHERE query_id IN (SELECT query_id FROM bm) "
    "UNION ALL SELECT query_id, 1, rank, score, chunk_id FROM bm) JOIN chunks USING (chunk_id))",
    q.fused("fused", "legs", 30),
    "hybrid AS MATERIALIZED (SELECT query_id, rank, chunk_id, score FROM fused UNION ALL "
    "SELECT query_id, rank, chunk_id, score FROM near WHERE query_id NOT IN (SELECT query_id FROM bm))",
    "lists AS MATERIALIZED (SELECT v.qid AS query_id, v.list_id, h.rank, h.chunk_id, h.score, c.text FROM hybrid h JOIN q_vec v USING (query_id) JOIN chunks c USING (chunk_id))",
    q.interleaved("many", "(SELECT * FROM lists WHERE query_id IN (SELECT query_id FROM subs WHERE list_id > 0))", 30),
    "merged AS MATERIALIZED (SELECT query_id, place AS rank, chunk_id, text FROM many UNION ALL SELECT query_id, rank, chunk_id, text FROM lists WHERE query_id NOT IN (SELECT query_id FROM subs WHERE list_id > 0))",
    f"scored AS MATERIALIZED (SELECT query_id, chunk_id, rank, {q.overlap('query', 'text')} AS score FROM merged JOIN asked USING (query_id))",
    "pool AS MATERIALIZED (SELECT query_id, chunk_id, score, place AS rank, embedding FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rank) AS place FROM scored QUALIFY place <= 20) JOIN store USING (chunk_id))",
    *q.mmr3_ctes("mmr", "pool"),
]


@query(
    sql=q.build(
        "SELECT query_id, place AS rank, chunk_id, round(score, 6) AS score FROM mmr", _RETRIEVE
    )
)
def retrieve(spark, sf_dir):
    store = frames.store(spark, sf_dir)
    asked = frames.questions(spark, sf_dir).withColumn("reply", F.col("query"))
    opts = rt.RetrieveOptions(k=3, query_prefix="query: ", decompose=True, rerank=True, mmr=True)
    # The words of the sub-queries come from the replies.
    words = asked.withColumn("query", F.concat_ws(" ", "query", "reply"))
    return _shown(rt.retrieve(store, frames.stored_index(store), asked, opts))
