import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import make_queries, rows
from millrace.operators import rank

LISTS = "query_id long, list_id int, rank int, text string, score double"
POOL = "query_id long, rank int, text string, score double, embedding array<double>"


def lists(spark, *ranked):
    data = [(1, i, r, t, s) for i, one in enumerate(ranked) for r, (t, s) in enumerate(one, 1)]
    return spark.createDataFrame(data, LISTS)


def in_order(df):
    return [r["text"] for r in sorted(df.collect(), key=lambda r: r["rank"])]


def test_rrf_rewards_presence_in_two_lists(spark):
    df = lists(spark, [("x", 0.9), ("y", 0.8)], [("z", 0.7), ("y", 0.1)])
    out = rank.rrf_fuse(df, 3)
    assert in_order(out) == ["y", "x", "z"]
    best = out.where("text = 'y'").head()
    assert best["score"] == pytest.approx(1 / 62 + 1 / 62)


def test_rrf_adds_repeats_inside_one_list_and_keeps_first_row(spark):
    df = lists(spark, [("a", 0.9), ("b", 0.8), ("b", 0.7)], [("c", 0.5)]).withColumn(
        "chunk_id", F.concat_ws("-", "text", "list_id", "rank")
    )
    out = {r["text"]: r for r in rank.rrf_fuse(df, 10).collect()}
    assert out["b"]["score"] == pytest.approx(1 / 62 + 1 / 63)
    assert out["b"]["rank"] == 1 and out["b"]["chunk_id"] == "b-0-2"
    # Equal sums keep the order in which the texts were first seen.
    assert out["a"]["rank"] == 2 and out["c"]["rank"] == 3


def test_interleave_gives_every_list_its_best(spark):
    df = lists(spark, [("a1", 0.9), ("shared", 0.8)], [("b1", 0.2), ("shared", 0.1)])
    out = rank.interleave_merge(df, 3)
    assert in_order(out) == ["a1", "b1", "shared"]
    assert out.where("text = 'shared'").head()["score"] == 0.8


def test_interleave_limit_and_uneven_lists(spark):
    df = lists(spark, [("a", 1.0)], [("b", 0.5), ("c", 0.4), ("a", 0.3), ("d", 0.2)])
    assert in_order(rank.interleave_merge(df, 3)) == ["a", "b", "c"]
    assert in_order(rank.interleave_merge(df, 9)) == ["a", "b", "c", "d"]


def mmr_pool(spark):
    return spark.createDataFrame(
        [(1, 1, "a", 1.0, [1.0, 0.0]), (1, 2, "a-dup", 0.99, [1.0, 0.001]), (1, 3, "b", 0.5, [0.0, 1.0])], POOL
    )


@pytest.mark.parametrize("diversity,want", [(0.5, ["a", "b"]), (0.0, ["a", "a-dup"])])
def test_mmr_fixture(spark, diversity, want):
    assert in_order(rank.mmr_select(mmr_pool(spark), 2, diversity)) == want


def test_mmr_small_pool_is_unchanged(spark):
    assert in_order(rank.mmr_select(mmr_pool(spark), 3, 1.0)) == ["a", "a-dup", "b"]


def greedy(pool, k, lam):
    """Plain greedy choice, written out for the comparison."""
    scores = [p[1] for p in pool]
    lo, span = min(scores), (max(scores) - min(scores)) or 1.0

    def cos(x, y):
        n = math.sqrt(sum(v * v for v in x)) * math.sqrt(sum(v * v for v in y))
        return sum(a * b for a, b in zip(x, y)) / n if n else 0.0

    chosen = []
    while len(chosen) < k:
        best, top = None, None
        for i, (_, s, e) in enumerate(pool):
            if i in chosen:
                continue
            sims = [cos(e, pool[j][2]) for j in chosen if e is not None and pool[j][2] is not None]
            v = round((1 - lam) * (s - lo) / span - lam * (max(sims) if sims else 0.0), 9)
            if top is None or v > top:
                best, top = i, v
        chosen.append(best)
    return [pool[i][0] for i in chosen]


def test_mmr_matches_plain_greedy(spark):
    rng = random.Random(5)
    data, want = [], {}
    for q in range(20):
        pool = []
        for r in range(1, rng.randint(4, 12)):
            vector = None if rng.random() < 0.2 else [rng.choice([0.0, 0.5, -1.0, rng.random()]) for _ in range(3)]
            pool.append((f"{q}-{r}", round(rng.random(), 2), vector))
            data.append((q, r, *pool[-1]))
        want[q] = greedy(pool, 3, 0.6) if len(pool) > 3 else [p[0] for p in pool]
    out = rank.mmr_select(spark.createDataFrame(data, POOL), 3, 0.6)
    for q, texts in want.items():
        assert in_order(out.where(F.col("query_id") == q)) == texts


def test_mmr_needs_vectors(spark):
    with pytest.raises(ValueError):
        rank.mmr_select(mmr_pool(spark).drop("embedding"), 2)


def test_rerank_by_rating(spark):
    cands = spark.createDataFrame(
        [(1, "q", 1, "rated-1 low", 0.9), (1, "q", 2, "rated-5 high", 0.1), (1, "q", 3, "rated-3 mid", 0.5)],
        "query_id long, query string, rank int, text string, score double",
    )
    model = lambda prompt: F.regexp_extract(prompt, r"rated-(\d)", 1)
    out = rank.rerank_pointwise(cands, 2, rank.rating_scorer(model))
    # The rating is the first number of the model's reply.
    assert in_order(out) == ["rated-5 high", "rated-3 mid"]
    assert rows(out, "rank", "score") == [(1, 5.0), (2, 3.0)]


def test_rerank_ties_keep_incoming_order(spark):
    cands = spark.createDataFrame(
        [(1, "no such words", r, f"t{r}", 1.0) for r in (3, 1, 2)],
        "query_id long, query string, rank int, text string, score double",
    )
    assert in_order(rank.rerank_pointwise(cands, 3)) == ["t1", "t2", "t3"]


@pytest.mark.parametrize("reply,want", [("4", 4.0), ("Score: 3.5/5", 3.5), ("no idea", 0.0), ("7 of 5", 7.0)])
def test_parse_rating(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "reply string")
    assert rank.parse_rating(df).head()["rating"] == want


def test_decompose_lines(spark):
    reply = "1. first fact\n- second fact *\n\n  WHAT is it?  \n15th lady\n3) fourth\nfifth"
    df = spark.createDataFrame([(1, "What is it?", reply), (2, "alone", ""), (3, "none", None)], "query_id long, query string, reply string")
    out = rows(rank.decompose_parse(df, 4), "query_id", "list_id", "sub_query")
    assert out == [
        (1, 0, "What is it?"),
        (1, 1, "first fact"),
        (1, 2, "second fact"),
        (1, 3, "th lady"),
        (1, 4, "fourth"),
        (2, 0, "alone"),
        (3, 0, "none"),
    ]


def test_prompts_mention_their_input(spark):
    q = make_queries(spark, ["where?"]).withColumn("text", F.lit("here"))
    prompt = rank.rerank_prompt(q).head()["prompt"]
    assert "Query: where?\nPassage: here\n" in prompt
    assert rank.decompose_prompt(q, 3).head()["prompt"].endswith("\nwhere?\n")
