"""Running values, skewed joins, and the plans Spark makes."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import make_queries, rows
from millrace.catalog import frames
from millrace.operators import evaluate as ev
from millrace.operators import keyword, store, vector
from millrace.plans.running import dense_index, running
from millrace.plans.skew import at_most, hot_keys, salted_join, spread_join


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("bits,key_bits", [(20, 40), (3, 12), (2, 12), (12, 12)])
def test_running_values(spark, inclusive, bits, key_bits):
    rng = random.Random(bits)
    data = [(rng.choice("ab"), k, rng.randint(-5, 5), rng.choice([None, k])) for k in rng.sample(range(4000), 200)]
    df = spark.createDataFrame(data, "g string, k long, v long, m long").repartition(6)
    out = running(df, "k", {"s": ("sum", "v"), "t": ("max", "m")}, by=("g",), inclusive=inclusive, bits=bits, key_bits=key_bits)
    want = []
    for g in "ab":
        s, t = 0, None
        for row in sorted((r for r in data if r[0] == g), key=lambda r: r[1]):
            before = (s, t)
            s += row[2]
            t = row[3] if t is None else t if row[3] is None else max(t, row[3])
            want.append((g, row[1], *((s, t) if inclusive else before)))
    key = lambda r: (r[0], r[1])
    assert rows(out, "g", "k", "s", "t", order=key) == sorted(want, key=key)


def test_dense_index(spark):
    ids = random.Random(1).sample(range(10**6), 300)
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = rows(dense_index(df, "id", bits=6, key_bits=20), "idx", "id", order=lambda t: t)
    assert got == list(enumerate(sorted(ids)))


def test_joins_with_a_hot_key(spark):
    data = [("hot" if i % 3 == 0 else f"k{i}", i) for i in range(900)] + [(None, -1)]
    big = spark.createDataFrame(data, "key string, id long").repartition(5)
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("other", 3)], "key string, v long")
    assert rows(hot_keys(big, "key", 0.1), "key") == [("hot",)]
    for how in ("inner", "left"):
        want = rows(big.join(small, "key", how), "id", "v")
        assert rows(salted_join(big, small, "key", "id", how, salts=7, share=0.1), "id", "v") == want
        assert rows(spread_join(big, small, "key", "id", how), "id", "v") == want
    for how in ("left_semi", "left_anti"):
        assert rows(spread_join(big, small.select("key"), "key", "id", how)) == rows(big.join(small, "key", how).select("id", "key").select(*big.columns))


def test_at_most(spark):
    assert at_most(spark.range(5), 5) and not at_most(spark.range(6), 5)


# --- plans ----------------------------------------------------------------


def test_top_k_is_pruned_before_the_shuffle(spark, sf_dir):
    v = frames.vectors(spark, sf_dir)
    asked = v.select(F.col("vec_id").alias("query_id"), "embedding")
    text = plan(vector.vector_topk(v, asked, 5, carry=(), id_col="vec_id"))
    assert text.count("WindowGroupLimit") == 2
    # The stored vectors themselves are not shuffled by the search.
    assert text.count("Exchange hashpartitioning(query_id") == 1
    assert "label" not in text.split("ReadSchema")[-1]


def test_search_over_an_index_in_plan_shuffles_texts_once(spark, sf_dir):
    chunks = frames.chunks(spark, sf_dir).select("chunk_id", "text")
    asked = make_queries(spark, ["the of and"])
    hits = keyword.bm25_search(keyword.bm25_index(chunks), asked, 5)
    scoring = plan(hits).split("Subquery")[0]
    assert "SortMergeJoin" not in scoring


def test_stats_and_chunks_read_only_their_columns(spark, sf_dir):
    assert "lang" not in plan(frames.chunks(spark, sf_dir)).split("ReadSchema")[-1]
    sizes = plan(ev.corpus_prepare(frames.articles(spark, sf_dir)).select("idx"))
    assert "Window" in sizes


def test_chunking_needs_no_shuffle(spark, sf_dir, tmp_path):
    many = str(tmp_path / "many")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(16).write.parquet(many)
    from millrace.operators.chunk import build_chunks
    from millrace.sources.tables import table_source

    rows_ = table_source(spark, many, ["doc_id", "text"], "doc_id").withColumn("doc_key", F.col("doc_id").cast("string"))
    assert "Exchange" not in plan(build_chunks(rows_, ["doc_id"]))


def test_snapshot_functions_do_not_window(spark):
    feed = spark.createDataFrame([("a", 1, "upsert", "x")], "key string, seq long, op string, body string")
    text = plan(store.changelog_latest(feed, ["key"], "seq"))
    assert "Window" not in text and "partial_max_by" in text


# --- evaluation -----------------------------------------------------------


def test_completion(spark):
    data = []
    for run, last_growth, busy_until in (("quiet", 30, 0), ("busy", 30, 300), ("short", 30, 0), ("never", 600, 0)):
        cpu = 0.0
        for i in range(0, 60):
            t = i * 10.0
            cpu += 500.0 if t <= busy_until else 50.0
            chunks = min(t, last_growth) if run != "short" else min(t, last_growth) / 10
            data.append((run, i, t, int(chunks), cpu))
    samples = spark.createDataFrame(data, "run_id string, seq long, elapsed_s double, chunks long, cpu_s double").repartition(4)
    got = {r["run_id"]: (r["done_at_s"], r["duration_s"]) for r in ev.completion_detect(samples, 20).collect()}
    assert got == {"quiet": (210.0, 30.0), "busy": (480.0, 30.0), "short": (None, None), "never": (None, None)}


def test_accuracy_and_misses(spark):
    questions = spark.createDataFrame(
        [(1, "q1", "0000/0001-a.txt"), (2, "q2 " + "x" * 200, "0000/0002-b.txt"), (3, "q3", "0000/0003-c.txt")],
        "query_id long, query string, expected_file string",
    )
    results = spark.createDataFrame(
        [(1, 1, "/d/0000/0009-z.txt"), (1, 2, "/d/0000/0001-a.txt"), (2, 2, "/d/1/x.txt"), (2, 1, "/d/0/10000/0002-b.txt")],
        "query_id long, rank int, path string",
    )
    assert rows(ev.retrieval_accuracy(results, questions)) == [(1, 3, "1/3")]
    misses = rows(ev.accuracy_misses(results, questions), "query_id", "got")
    assert misses == [(2, "10000/0002-b.txt 1/x.txt"), (3, "")]
    assert all(len(r["query"]) <= 120 for r in ev.accuracy_misses(results, questions).collect())


def test_corpus_cut(spark):
    texts = [(i, f"t{i}", "x" * (150 if i == 2 else 300)) for i in range(6)]
    prepared = ev.corpus_prepare(spark.createDataFrame(texts, "article_id long, title string, text string"))
    assert rows(prepared, "idx", "article_id", "file_name", order=lambda t: t)[2] == (2, 3, "0000/0002-t3.txt")
    size = 304  # title, blank line, text
    kept = rows(ev.corpus_cut_to_size(prepared, 2 * size + 1), "idx", order=lambda t: t)
    assert kept == [(0,), (1,), (2,)]
    assert rows(ev.corpus_cut_to_size(prepared, 2 * size), "idx", order=lambda t: t) == [(0,), (1,)]
