"""SQL building blocks for the counterparts of the queries."""

from __future__ import annotations

BLANK = r"[ \t\n\r\f]"
NON_BLANK = r"[^ \t\n\r\f]"
WORD = r"[\p{L}\p{N}_]+"


def words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{WORD}')"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def rstrip(text: str) -> str:
    return f"regexp_replace({text}, '{BLANK}+$', '')"


def token_chunks(text: str, size: int = 512) -> str:
    tokens = f"regexp_extract_all({text}, '{NON_BLANK}+{BLANK}*')"
    return f"(SELECT list_transform(range(0, len(t), {size}), lambda i: array_to_string(t[i + 1:i + {size}], '')) FROM (SELECT {tokens} AS t))"


def tail_merged(c: str) -> str:
    return (
        f"CASE WHEN len({c}) >= 2 AND length({c}[-1]) < 100 THEN list_concat({c}[1:len({c}) - 2], "
        f"[{rstrip(c + '[-2]')} || chr(10) || {c}[-1]]) ELSE {c} END"
    )


def vector_of(digest: str, dim: int = 384) -> str:
    """Offline vector of a text, from its SHA-256 hex digest column."""
    return (
        f"list_transform(range(0, {dim}), lambda i: "
        f"(('0x' || substr({digest}, ((i % 32) * 2 + 1)::INT, 2))::INT / 255.0::DOUBLE)::FLOAT)"
    )


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


def chunk_ctes(name: str, docs: str) -> list[str]:
    """CTE ``name`` of chunk rows from a CTE of documents (doc_key, text, path, mtime, length)."""
    meta = "json_object('length', length::VARCHAR, 'mtime', mtime::VARCHAR, 'path', path)::VARCHAR"
    return [
        f"{name}_1 AS (SELECT doc_key, {meta} AS metadata_json, {token_chunks('text')} AS c FROM {docs})",
        f"{name}_2 AS (SELECT doc_key, metadata_json, {tail_merged('c')} AS c FROM {name}_1)",
        f"{name}_3 AS (SELECT doc_key, metadata_json, list_filter(c, lambda x, i: list_position(c, x) = i) AS c FROM {name}_2)",
        f"{name} AS MATERIALIZED (SELECT sha256(metadata_json || chr(0) || text) AS chunk_id, doc_key, pos, text, metadata_json "
        f"FROM (SELECT doc_key, metadata_json, unnest(c) AS text, generate_subscripts(c, 1) - 1 AS pos FROM {name}_3))",
    ]


def located(source: str, text: str, mtime: str, extra: str = "") -> str:
    return (
        f"SELECT doc_id, {text} AS text, source, '/docs/' || source || '/' || doc_id || '.txt' AS path, "
        f"'/docs/' || source || '/' || doc_id || '.txt' AS doc_key, strlen({text})::BIGINT AS length, "
        f"({mtime})::BIGINT AS mtime{extra} FROM {source}"
    )


DOCS = f"docs AS ({located('documents', 'text', '1000 + doc_id', ', lang, n_chars')})"
CHUNKS = [DOCS, *chunk_ctes("chunks", "docs")]
STORE = [
    *CHUNKS,
    f"store AS MATERIALIZED (SELECT *, {vector_of('h')} AS embedding FROM (SELECT *, sha256(text) AS h FROM chunks))",
]

_BOTH = (
    "both_docs AS (SELECT d.doc_id, d.text, d.source, l.quality, l.toxic "
    "FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"
)
_REVISED = "CASE WHEN quality = 0 THEN text || chr(10) || '(revised)' ELSE text END"
BEFORE_AFTER = [
    _BOTH,
    f"old_docs AS ({located('both_docs', 'text', '1000')} WHERE quality IS NOT NULL)",
    f"new_docs AS ({located('both_docs', _REVISED, '1000 + CASE WHEN quality = 0 THEN 1 ELSE 0 END')} "
    "WHERE coalesce(toxic, 0) = 0)",
]
DIFF = [
    *BEFORE_AFTER,
    "diff AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' "
    "WHEN n.path IS NULL THEN 'deleted' WHEN o.length = n.length AND o.mtime = n.mtime THEN 'unchanged' "
    "ELSE 'modified' END AS change, n.length, n.mtime FROM old_docs o FULL JOIN new_docs n ON o.path = n.path)",
]

QUESTIONS = "questions AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
VECTOR_QUESTIONS = [
    QUESTIONS,
    f"q_vec AS MATERIALIZED (SELECT *, {vector_of('h')} AS embedding FROM (SELECT *, sha256(query) AS h FROM questions))",
]


def vector_hits(name: str, queries: str, store: str, k: int, qid: str = "query_id", sid: str = "chunk_id") -> str:
    """CTE of the cosine top k of CTE ``queries`` over CTE ``store``."""
    return (
        f"{name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {sid}) AS rank "
        f"FROM (SELECT q.{qid} AS query_id, s.{sid}, {cosine('q.embedding', 's.embedding')} AS score "
        f"FROM {queries} q CROSS JOIN {store} s) QUALIFY rank <= {k})"
    )


def keyword_ctes(chunks: str, prefix: str = "") -> list[str]:
    p = prefix
    return [
        f"{p}tf AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({words('text')}) AS term FROM {chunks}) GROUP BY ALL)",
        f"{p}dl AS MATERIALIZED (SELECT chunk_id, len({words('text')}) AS dl FROM {chunks})",
        f"{p}tot AS MATERIALIZED (SELECT count(*) AS n, avg(dl) AS avgdl FROM {p}dl)",
        f"{p}idf AS MATERIALIZED (SELECT term, df, ln(1.0 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf "
        f"FROM (SELECT term, count(*) AS df FROM {p}tf GROUP BY term) CROSS JOIN {p}tot)",
    ]


def keyword_hits(name: str, queries: str, k: int, prefix: str = "", qid: str = "query_id") -> str:
    """CTE of the BM25 top k of CTE ``queries`` over the keyword CTEs."""
    p = prefix
    return (
        f"{name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM ("
        f"SELECT query_id, chunk_id, sum(mult * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score "
        f"FROM (SELECT query_id, term, count(*) AS mult FROM (SELECT {qid} AS query_id, unnest({words('query')}) AS term FROM {queries}) GROUP BY ALL) "
        f"JOIN {p}idf USING (term) JOIN {p}tf USING (term) JOIN {p}dl USING (chunk_id) CROSS JOIN {p}tot "
        f"GROUP BY query_id, chunk_id) WHERE score > 0 QUALIFY rank <= {k})"
    )


def fused(name: str, lists: str, limit: int) -> str:
    """CTE of the reciprocal-rank fusion of CTE ``lists`` (query_id, list_id, rank, text, chunk_id, score)."""
    return (
        f"{name} AS MATERIALIZED (SELECT query_id, text, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seen) AS rank FROM ("
        f"SELECT query_id, text, sum(1.0::DOUBLE / (60 + rank)) AS score, min((list_id, rank)) AS seen, arg_min(chunk_id, (list_id, rank)) AS chunk_id "
        f"FROM {lists} GROUP BY query_id, text) QUALIFY rank <= {limit})"
    )


def interleaved(name: str, lists: str, limit: int) -> str:
    return (
        f"{name} AS MATERIALIZED (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY rank, list_id) AS place FROM ("
        f"SELECT * FROM {lists} QUALIFY row_number() OVER (PARTITION BY query_id, text ORDER BY rank, list_id) = 1) QUALIFY place <= {limit})"
    )


def overlap(query: str, text: str) -> str:
    q = f"list_distinct({words(query)})"
    return f"CASE WHEN len({q}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({q}, {words(text)}))::DOUBLE / len({q}) END"


def sub_query_ctes(name: str, replies: str, limit: int = 4) -> list[str]:
    """CTE (query_id, list_id, sub_query) from CTE ``replies`` (query_id, query, reply)."""
    brk = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
    dashes = f"regexp_replace({strip('x')}, '^[-*]+|[-*]+$', '', 'g')"
    clean = strip(f"regexp_replace({dashes}, '^[0-9.) ]+', '')")
    return [
        f"{name}_1 AS (SELECT query_id, query, list_transform(string_split_regex(reply, '{brk}'), lambda x: {clean}) AS l FROM {replies})",
        f"{name}_2 AS (SELECT query_id, list_concat([query], list_filter(l, lambda x: x <> '' AND lower(x) <> lower({strip('query')}))[1:{limit}]) AS l FROM {name}_1)",
        f"{name} AS MATERIALIZED (SELECT query_id, generate_subscripts(l, 1) - 1 AS list_id, unnest(l) AS sub_query FROM {name}_2)",
    ]


def mmr3_ctes(name: str, pool: str, diversity: float = 0.3) -> list[str]:
    """CTE of the greedy choice of three from CTE ``pool`` (query_id, rank, score, embedding, id)."""
    a, b = 1.0 - diversity, diversity
    def pick(step: int, source: str, value: str) -> str:
        return (
            f"{name}_{step} AS MATERIALIZED (SELECT * FROM (SELECT r.*, {value} AS v FROM {source}) "
            "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(v, 9) DESC, rank) = 1)"
        )

    p = name
    first = f"{p}_r r JOIN {p}_1 x ON r.query_id = x.query_id AND r.rank <> x.rank"
    second = f"{first} JOIN {p}_2 y ON r.query_id = y.query_id AND r.rank <> y.rank"
    to_x, to_y = cosine("r.embedding", "x.embedding"), cosine("r.embedding", "y.embedding")
    return [
        f"{p}_r AS MATERIALIZED (SELECT *, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0.0) AS rel FROM {pool} WINDOW w AS (PARTITION BY query_id))",
        pick(1, f"{p}_r r", f"{a}::DOUBLE * r.rel"),
        pick(2, first, f"{a}::DOUBLE * r.rel - {b}::DOUBLE * {to_x}"),
        pick(3, second, f"{a}::DOUBLE * r.rel - {b}::DOUBLE * greatest({to_x}, {to_y})"),
        f"{p} AS (SELECT *, 1 AS place FROM {p}_1 UNION ALL SELECT *, 2 AS place FROM {p}_2 UNION ALL SELECT *, 3 AS place FROM {p}_3)",
    ]


def build(body: str, *ctes: str | list[str]) -> str:
    flat: list[str] = []
    for part in ctes:
        for cte in [part] if isinstance(part, str) else part:
            if cte not in flat:
                flat.append(cte)
    return f"WITH {', '.join(flat)} {body}" if flat else body
