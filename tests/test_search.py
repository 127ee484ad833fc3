import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark import Broadcast, SparkContext
from pyspark.sql import functions as F

from conftest import make_queries, make_store, rows
from millrace.functions import vectors as vx
from millrace.operators import keyword, vector
from millrace.operators import retrieve as rt

WORDS = re.compile(r"\w+")


# --- vectors --------------------------------------------------------------


def brute_topk(stored, queries, k):
    """(query, rank, id) by plain cosine, ties to the smaller id."""
    def cos(a, b):
        a, b = np.asarray(a, float), np.asarray(b, float)
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(a @ b / n) if n else 0.0

    out = []
    for qid, qv in queries:
        scored = sorted((-round(cos(v, qv), 9), i) for i, v in stored if v is not None)
        out += [(qid, r, i) for r, (_, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def random_vectors():
    rng = np.random.default_rng(3)
    base = [(f"v{i:03d}", [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(150)]
    # A third of the rows are copies of one vector; some are zero or missing.
    copies = [(f"copy{i:03d}", base[0][1]) for i in range(75)]
    return base + copies + [("zero", [0.0] * 6), ("none", None)]


@pytest.fixture(scope="module")
def random_queries():
    rng = np.random.default_rng(4)
    return [(i, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(40)] + [(99, [0.0] * 6)]


def frames_of(spark, stored, queries):
    store = spark.createDataFrame(stored, "chunk_id string, embedding array<float>").repartition(5)
    asked = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    return store, asked


@pytest.mark.parametrize("blocks", [False, True])
def test_exact_search_matches_brute_force(spark, monkeypatch, random_vectors, random_queries, blocks):
    if blocks:  # more queries than one matrix may hold
        monkeypatch.setattr(vector, "MAX_QUERY_VALUES", 6)
        monkeypatch.setattr(vector, "TILE_ROWS", 17)
        monkeypatch.setattr(vector, "TILE_QUERIES", 7)
    store, asked = frames_of(spark, random_vectors, random_queries)
    near = vector.vector_topk(store, asked, 4, carry=())
    assert rows(near, "query_id", "rank", "chunk_id", order=lambda t: t) == brute_topk(random_vectors, random_queries, 4)


@pytest.mark.parametrize("blocks", [False, True])
def test_probing_all_cells_is_exact(spark, monkeypatch, random_vectors, random_queries, blocks):
    if blocks:
        monkeypatch.setattr(vector, "MAX_QUERY_VALUES", 6)
        monkeypatch.setattr(vector, "TILE_ROWS", 17)
        monkeypatch.setattr(vector, "TILE_QUERIES", 7)
    store, asked = frames_of(spark, random_vectors, random_queries)
    near = vector.ann_topk(store, asked, 4, n_cells=5, n_probe=5, carry=())
    assert rows(near, "query_id", "rank", "chunk_id", order=lambda t: t) == brute_topk(random_vectors, random_queries, 4)


def test_query_blocks_go_one_after_the_other(spark, monkeypatch, random_vectors, random_queries):
    """One block of queries is held at a time, also where one id (or none) has more rows than a block."""
    twice = [("v001", random_vectors[1][1]), (None, random_vectors[2][1])]
    same = [(i, [float(v % 5), 1.0, 0.0, 0.0, 2.0, -1.0]) for i in (7, None) for v in range(11)]
    store, asked = frames_of(spark, random_vectors + twice, random_queries + same)
    store = store.withColumn("text", F.concat(F.lit("text of "), "chunk_id"))
    live, most = set(), []
    send, drop = SparkContext.broadcast, Broadcast.destroy

    def sent(context, value):
        out = send(context, value)
        live.add(id(out))
        most.append((len(live), len(value[0])))
        return out

    def dropped(self, *a):
        live.discard(id(self))
        return drop(self, *a)

    got = {}
    for limit in (1000, 8):
        monkeypatch.setattr(vector, "MAX_QUERY_VALUES", 6 * limit)
        with monkeypatch.context() as spied:
            spied.setattr(SparkContext, "broadcast", sent)
            spied.setattr(Broadcast, "destroy", dropped)
            most.clear()
            live.clear()
            near = vector.vector_topk(store, asked, 4, carry=("text",))
        if limit == 8:
            assert len(most) >= len(random_queries + same) / 8
            assert all(held == 1 and n <= 8 for held, n in most) and not live
            plan = near._jdf.queryExecution().toString()
            assert "MapInArrow" not in plan and "Union" not in plan
        got[limit] = rows(near, "query_id", "rank", "chunk_id", "text"), near.columns
    assert got[8] == got[1000]


def test_approximate_recall(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = v.select(F.col("vec_id").alias("query_id"), "embedding")
    exact = vector.vector_topk(v, asked, 5, carry=(), id_col="vec_id")
    found = vector.ann_topk(v, asked, 5, n_cells=8, n_probe=4, carry=(), id_col="vec_id")
    assert vector.recall(found, exact, "vec_id").head()["recall"] > 0.7


def test_scan_reads_no_text_and_tiles_prune_exactly(spark, monkeypatch, tmp_path, random_vectors, random_queries):
    monkeypatch.setattr(vector, "TILE_ROWS", 3)
    monkeypatch.setattr(vector, "TILE_QUERIES", 2)
    texts = [(c, e, f"text of {c}") for c, e in random_vectors]
    spark.createDataFrame(texts, "chunk_id string, embedding array<float>, text string").repartition(4).write.parquet(str(tmp_path / "s"))
    store = spark.read.parquet(str(tmp_path / "s"))
    asked = spark.createDataFrame(random_queries, "query_id long, embedding array<float>")
    near = vector.vector_topk(store, asked, 4, carry=("text",))
    got = rows(near, "query_id", "rank", "chunk_id", order=lambda t: t)
    assert got == brute_topk(random_vectors, random_queries, 4)
    assert all(r["text"] == f"text of {r['chunk_id']}" for r in near.collect())
    plan = near._jdf.queryExecution().executedPlan().toString()
    reads = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    # The scoring scan reads ids and vectors; text is read once more, by the join to the hits.
    assert any("embedding" in r and "text" not in r for r in reads), reads


def test_result_does_not_depend_on_partitions(spark, random_vectors, random_queries):
    store, asked = frames_of(spark, random_vectors, random_queries)
    a = rows(vector.vector_topk(store.repartition(1), asked, 3, carry=()))
    b = rows(vector.vector_topk(store.repartition(9), asked, 3, carry=()))
    assert a == b


def test_same_text_ranks_first_with_score_one(spark, docs5):
    asked = rt.mock_queries(make_queries(spark, ["third page on bridges"]))
    hits = vector.vector_topk(docs5, asked, 3).orderBy("rank").collect()
    assert hits[0]["text"] == "third page on bridges" and hits[0]["score"] == pytest.approx(1.0)
    assert [h["score"] for h in hits] == sorted((h["score"] for h in hits), reverse=True)


def test_mixed_dimensions_are_refused(spark):
    store = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "chunk_id string, embedding array<float>").coalesce(1)
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception, match="different dimensions|dimension"):
        vector.vector_topk(store, asked, 1, carry=()).collect()


def test_cosine_expression(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vx.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(math.sqrt(0.5)), 0.0]


# --- words ----------------------------------------------------------------


def brute_bm25(docs, query, k):
    tokens = {i: WORDS.findall(t.lower()) for i, t in docs}
    n = len(docs)
    avg = sum(map(len, tokens.values())) / n
    df = Counter(t for ts in tokens.values() for t in set(ts))
    scored = []
    for i, ts in tokens.items():
        tf, score = Counter(ts), 0.0
        for t in WORDS.findall(query.lower()):
            if tf[t]:
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                score += idf * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ts) / avg))
        if score > 0:
            scored.append((-round(score, 9), i))
    return [(r, i) for r, (_, i) in enumerate(sorted(scored)[:k], 1)]


@pytest.fixture(scope="module")
def worded():
    rng = random.Random(8)
    vocabulary = ["the"] * 12 + ["über", "naïve", "w_1", "cat", "dog", "bird", "fish", "42"]
    docs = [(f"d{i:03d}", " ".join(rng.choices(vocabulary, k=rng.randint(1, 30)))) for i in range(120)]
    # A third of the rows are copies of one text; some have no word at all.
    docs += [(f"x{i:03d}", "The cat, the CAT!") for i in range(60)] + [("empty", ""), ("dots", "... !")]
    queries = ["the cat", "cat cat dog", "Über naïve", "unknown", "", "bird the the fish 42 w_1"]
    return docs, queries


@pytest.mark.parametrize("mode", ["plan", "kept", "saved", "shuffled", "steps"])
def test_bm25_matches_brute_force(spark, monkeypatch, tmp_path, worded, mode):
    docs, queries = worded
    chunks = spark.createDataFrame(docs, "chunk_id string, text string").repartition(4)
    asked = make_queries(spark, queries)
    if mode == "shuffled":  # more query words than may be broadcast
        monkeypatch.setattr(keyword, "MAX_BROADCAST_TERMS", 2)
    if mode == "steps":  # one chunk per step of the task
        monkeypatch.setattr(keyword, "MAX_PAIRS", 1)
    index = keyword.bm25_index(chunks)
    if mode == "kept":
        index = index.kept()
    if mode == "saved":
        index = index.save(str(tmp_path / "index"))
    got = rows(keyword.bm25_search(index, asked, 5), "query_id", "rank", "chunk_id", order=lambda t: t)
    want = [(q, r, i) for q, text in enumerate(queries) for r, i in brute_bm25(docs, text, 5)]
    assert got == sorted(want)


def test_bm25_tasks_send_no_pairs(spark, worded):
    """A stop word asked by every query: each task sends about k rows per query, not one per chunk."""
    docs, _ = worded
    chunks = spark.createDataFrame(docs, "chunk_id string, text string").repartition(4)
    asked = make_queries(spark, [f"the q{i}" for i in range(30)])
    index = keyword.bm25_index(chunks)
    terms = keyword.query_terms(index, asked)
    weights = terms.select("query_id", "term", (F.col("mult") * F.col("idf")).alias("w")).toArrow()
    postings = index.postings.where("term IS NOT NULL").sortWithinPartitions("chunk_id")
    sent = keyword._score_chunks(postings, weights, asked, 3, 10.0)
    tasks = postings.rdd.getNumPartitions()
    # Copies of one text tie, and ties at the boundary stay; still far fewer than 30 x 150 chunks with "the".
    assert sent.count() < 30 * tasks * 80


def test_bm25_bucketed_tables_need_no_shuffle_by_chunk(spark, worded):
    docs, queries = worded
    chunks = spark.createDataFrame(docs, "chunk_id string, text string")
    asked = make_queries(spark, queries)
    index = keyword.bm25_index(chunks).save_tables("bm25test", 4)
    try:
        hits = keyword.bm25_search(index, asked, 5)
        got = rows(hits, "query_id", "rank", "chunk_id", order=lambda t: t)
        want = [(q, r, i) for q, text in enumerate(queries) for r, i in brute_bm25(docs, text, 5)]
        assert got == sorted(want)
        plan = hits._jdf.queryExecution().toString()
        assert "hashpartitioning(query_id#" in plan
        assert "hashpartitioning(chunk_id#" not in plan.split("== Physical Plan ==")[1]
    finally:
        for t in ("postings", "term_stats", "totals"):
            spark.sql(f"DROP TABLE IF EXISTS bm25test_{t}")


def test_postings_need_no_table_of_all_terms(spark):
    """Counted in steps of whole texts; rows of one chunk id with as many words still count as one."""
    import pyarrow as pa

    data = [("a", "x y x"), ("a", "x z z"), ("a", "x"), ("b", ""), ("b", ""), (None, "q q r"), (None, "q"), (None, "q q r"), ("c", None)]
    index = keyword.bm25_index(spark.createDataFrame(data, "chunk_id string, text string").repartition(3))
    got = {(r["chunk_id"], r["dl"], r["term"]): r["tf"] for r in index.postings.collect()}
    a = {("a", 3, "x"): 3, ("a", 3, "y"): 1, ("a", 3, "z"): 2, ("a", 1, "x"): 1}
    b = {("b", 0, None): 2, (None, 3, "q"): 4, (None, 3, "r"): 2, (None, 1, "q"): 1}
    assert {k: v for k, v in got.items() if k[0] != "c"} == a | b and len(got) == 9
    assert "HashAggregate" not in index.postings._jdf.queryExecution().executedPlan().toString()

    words = ["w%d" % (i % 7) for i in range(40)]
    columns = [pa.array(["a"] * 20 + ["b"]), pa.array([2] * 21, pa.int32()), pa.array([words[2 * (i % 20) : 2 * (i % 20) + 2] for i in range(21)])]
    schema = pa.schema([("chunk_id", pa.string()), ("dl", pa.int32()), ("term", pa.string()), ("tf", pa.int64())])
    batches = pa.table(columns, names=["chunk_id", "dl", "tokens"]).to_batches(max_chunksize=3)
    out = [r for x in keyword._count_terms(batches, schema) for r in x.to_pylist()]
    assert {(r["chunk_id"], r["term"]): r["tf"] for r in out} == {("a", w): words.count(w) for w in words} | {("b", "w0"): 1, ("b", "w1"): 1}
    assert len(out) == 9


def test_bm25_sorts_packed_postings_and_counts_asked_words(spark, monkeypatch):
    """A sort or shuffle of a search holds no row per posting, and the other words' chunks are not counted."""
    docs = [(f"d{i:02d}", " ".join(f"w{j}" for j in range(i % 7, 30))) for i in range(40)]
    chunks = spark.createDataFrame([*docs, (None, "w9 w9"), ("null", None)], "chunk_id string, text string").repartition(3)
    index = keyword.bm25_index(chunks).kept()
    asked = make_queries(spark, ["w1 w9 w9 w20", "w0 w29"])
    taken, packed = [], keyword._packed
    monkeypatch.setattr(keyword, "_packed", lambda *a: taken.append(packed(*a)) or taken[-1])
    counted, with_idf = [], keyword._with_idf
    monkeypatch.setattr(keyword, "_with_idf", lambda *a: counted.append(a[0]) or with_idf(*a))
    hits = keyword.bm25_search(index, asked, 50).collect()
    assert {r["chunk_id"] for r in hits} == {None, *(i for i, _ in docs)}
    assert 2 * taken[0].count() < sum(len(r["terms"]) for r in taken[0].collect())
    plan = counted[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [term") < plan.index("LeftSemi")

    # A chunk in many rows, in steps, gives the same.
    monkeypatch.setattr(keyword, "PACK", 2)
    monkeypatch.setattr(keyword, "MAX_PAIRS", 3)
    again = keyword.bm25_search(index, asked, 50).collect()
    near = lambda found: sorted((r["query_id"], r["rank"], str(r["chunk_id"]), round(r["score"], 9)) for r in found)
    assert near(again) == near(hits)


def test_search_ranks_only_scores_that_reach_the_best(monkeypatch):
    """Once every query of a tile has its k rows, no tile of scores is rounded or partitioned; ties stay."""
    rng = np.random.default_rng(3)
    asked, stored = np.round(rng.normal(size=(9, 4)), 1), np.round(rng.normal(size=(400, 4)), 1)
    stored[200:] = stored[:200]
    monkeypatch.setattr(vector, "TILE_ROWS", 50)
    calls, whole = [], np.partition
    monkeypatch.setattr(np, "partition", lambda *a, **b: calls.append(1) or whole(*a, **b))
    found = [x for q, r, s in vector._Pruner(9, 3).scan(asked, np.arange(9), stored) for x in zip(q, r, s, strict=True)]
    assert len(calls) == 1
    for i in range(9):
        exact = np.rint(stored @ asked[i] * 1e9)
        least = np.sort(exact)[-3]
        got = {int(r) for q, r, _ in found if q == i}
        assert got >= set(np.flatnonzero(exact >= least).tolist())


def test_refresh_equals_rebuild(spark, worded):
    docs, _ = worded
    before = spark.createDataFrame(docs, "chunk_id string, text string")
    gone = before.where("chunk_id < 'd020' OR chunk_id = 'empty'").select("chunk_id")
    new = spark.createDataFrame([("d001", "a new bird"), ("n1", "another cat"), ("n2", "")], "chunk_id string, text string")
    fresh = keyword.bm25_refresh(keyword.bm25_index(before), gone, new)
    after = before.join(gone, "chunk_id", "left_anti").unionByName(new)
    whole = keyword.bm25_index(after)
    for name in ("postings", "term_stats", "totals"):
        assert rows(getattr(fresh, name)) == rows(getattr(whole, name).select(*getattr(fresh, name).columns))


def test_refresh_tokenises_the_new_chunks_once(spark, worded):
    docs, _ = worded
    index = keyword.bm25_index(spark.createDataFrame(docs, "chunk_id string, text string")).kept()
    new = spark.createDataFrame([("n1", "another cat")], "chunk_id string, text string")
    fresh = keyword.bm25_refresh(index, new.select("chunk_id"), new)
    for name in ("postings", "term_stats", "totals"):
        assert "regexp_extract_all" not in getattr(fresh, name)._jdf.queryExecution().optimizedPlan().toString()


# --- hybrid and the whole path --------------------------------------------


@pytest.fixture
def hybrid3(spark):
    return spark.createDataFrame(
        [
            ("c0", "kettles steam slowly", "{}", [1.0, 0.0]),
            ("c1", "lanterns glow outside", "{}", [0.0, 1.0]),
            ("c2", "gamma Monte Verano 1911 viaduct", "{}", [0.5, 0.5]),
        ],
        "chunk_id string, text string, metadata_json string, embedding array<float>",
    )


def hybrid_texts(spark, store, query, embedding, k, **kw):
    asked = spark.createDataFrame([(1, query, embedding)], "query_id long, query string, embedding array<float>")
    index = keyword.bm25_index(store)
    out = rt.hybrid_search(store, index if kw.pop("on", True) else None, asked, k, **kw)
    return [r["chunk_id"] for r in out.orderBy("rank").collect()]


def test_hybrid_lets_a_keyword_hit_in(spark, hybrid3):
    assert "c2" in hybrid_texts(spark, hybrid3, "Monte Verano", [1.0, -0.5], 2)


def test_hybrid_off_is_vector_only(spark, hybrid3):
    plain = hybrid_texts(spark, hybrid3, "Monte Verano", [1.0, -0.5], 2, on=False)
    assert plain == ["c0", "c2"]


def test_hybrid_without_keyword_hits_keeps_the_cosine(spark, hybrid3):
    asked = spark.createDataFrame([(1, "nothing known", [1.0, 0.0])], "query_id long, query string, embedding array<float>")
    best = rt.hybrid_search(hybrid3, keyword.bm25_index(hybrid3), asked, 2).where("rank = 1").head()
    assert best["chunk_id"] == "c0" and best["score"] == pytest.approx(1.0)


def test_viaduct_is_found_by_its_words(spark):
    store = make_store(
        spark,
        [
            "first leaflet on kettles",
            "second note on lanterns",
            "third page on bridges",
            "fourth card on violins",
            "fifth sheet on orchards",
            "the viaduct of Monte Verano was opened in 1911",
        ],
    )
    asked = make_queries(spark, ["when was Monte Verano opened"])
    out = rt.retrieve(store, keyword.bm25_index(store), asked, rt.RetrieveOptions(k=3))
    assert any("Verano" in r["text"] for r in out.collect())


def test_all_sub_queries_surface(spark, docs5):
    asked = make_queries(spark, ["first leaflet on kettles"]).withColumn(
        "reply", F.lit("second note on lanterns\nthird page on bridges")
    )
    opts = rt.RetrieveOptions(k=3, hybrid=False, decompose=True)
    out = rt.retrieve(docs5, None, asked, opts).orderBy("rank").collect()
    assert [r["text"] for r in out] == ["first leaflet on kettles", "second note on lanterns", "third page on bridges"]


def test_empty_reply_falls_back_to_the_question(spark, docs5):
    asked = make_queries(spark, ["fourth card on violins"])
    plain = rt.retrieve(docs5, None, asked, rt.RetrieveOptions(k=2, hybrid=False))
    split = rt.retrieve(docs5, None, asked.withColumn("reply", F.lit("")), rt.RetrieveOptions(k=2, hybrid=False, decompose=True))
    assert rows(plain) == rows(split)


def test_reranker_sees_the_shortlist(spark, docs5):
    asked = make_queries(spark, ["first leaflet on kettles"])
    opts = rt.RetrieveOptions(k=1, hybrid=False, rerank=True, rerank_candidates=5, scorer=lambda q, t: t.contains("orchards").cast("int"))
    out = rt.retrieve(docs5, None, asked, opts).collect()
    assert [r["text"] for r in out] == ["fifth sheet on orchards"] and "embedding" not in out[0].asDict()


def test_option_checks(spark, docs5):
    for bad in ({"k": 0}, {"diversity": 1.5}, {"max_subqueries": 1}):
        with pytest.raises(ValueError):
            rt.RetrieveOptions(**bad)
    asked = make_queries(spark, ["x"])
    with pytest.raises(ValueError):
        rt.retrieve(docs5, None, asked, rt.RetrieveOptions(decompose=True))
    with pytest.raises(ValueError):
        rt.retrieve(docs5.drop("embedding"), None, asked, rt.RetrieveOptions(mmr=True))


@pytest.mark.parametrize(
    "backend,raw,want",
    [("pgvector", 0.25, 0.75), ("mongodb", 0.75, 0.5), ("duckdb", 0.3, 0.3), ("weaviate", None, 0.0)],
)
def test_score_forms(spark, backend, raw, want):
    df = spark.createDataFrame([(backend, raw)], "backend string, raw double")
    assert vector.score_normalize(df).head()["score"] == pytest.approx(want)
