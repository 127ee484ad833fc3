import fnmatch
import hashlib
import json
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from millrace.functions import text as tx
from millrace.functions import vectors as vx
from millrace.operators import chunk, embed, parse


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"))).head()[0]


# --- text functions -------------------------------------------------------


@given(
    pattern=st.text(alphabet="ab.*?[]!-x", max_size=8),
    name=st.text(alphabet="ab.-x]", max_size=6),
)
@settings(max_examples=400, deadline=None)
def test_glob_like_fnmatch(pattern, name):
    try:
        want = fnmatch.fnmatchcase(name, pattern)
        got = re.search(tx.glob_regex(pattern), name) is not None
    except re.error:
        return  # an impossible range such as [b-a]
    assert got == want


def test_words_of_four_languages(spark):
    text = "Über l'été: naïve_1 niño 42x"
    assert one(spark, text, tx.words) == re.findall(r"\w+", text.lower())


@pytest.mark.parametrize(
    "html,want",
    [
        ("<p>a</p><p>b &amp; c</p>", "a\nb & c"),
        ('x<script>var t="</p>";</script>y<!-- <p>z -->', "xy"),
        ("<ul><li>one<li>two</ul>  <b>th</b>ree", "one\ntwo\nthree"),
        ("&amp;lt; &quot;q&quot;", '&lt; "q"'),
    ],
)
def test_html_text(spark, html, want):
    assert one(spark, html, tx.html_text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("One. Two.", "One."),
        ("No mark here", "No mark here"),
        ("a" * 600, "a" * 200),
        ("Line\nbreak! Then", "Line break!"),
        ("3.14 is pi. So", "3.14 is pi."),
        ("", ""),
    ],
)
def test_first_sentence(spark, text, want):
    assert one(spark, text, tx.first_sentence) == want


@pytest.mark.parametrize("title,want", [("Hello, World!", "Hello-World"), ("***", "article"), ("x" * 100, "x" * 80)])
def test_slug(spark, title, want):
    assert one(spark, title, tx.slug) == want


@pytest.mark.parametrize("path,want", [("/a/b.TXT", ".txt"), ("/a.b/c", ""), ("/a/.hidden", ""), ("x.tar.gz", ".gz")])
def test_suffix(spark, path, want):
    assert one(spark, path, tx.suffix) == want


def test_mock_vector_formula(spark):
    text = "naïve text"
    digest = hashlib.sha256(text.encode()).digest()
    got = one(spark, text, vx.mock_vector)
    assert got == pytest.approx([digest[i % 32] / 255 for i in range(384)], abs=1e-7)


# --- chunks ---------------------------------------------------------------


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_token_chunks_rebuild_the_text(spark):
    texts = ["  lead and trail \n", "one", "", " \n ", "a b\n\nc d e f g", "é ü ñ " * 50]
    out = {r["doc_id"]: r["chunks"] for r in chunk.chunk_token_count(docs(spark, *texts), 3).collect()}
    for i, text in enumerate(texts):
        assert "".join(out[i]) == text.lstrip(" \n\t\r\f")
        assert all(len(c.split()) <= 3 for c in out[i])


def test_whole_text_is_one_chunk_without_a_size(spark):
    out = rows(chunk.chunk_token_count(docs(spark, "a b c", ""), None), "doc_id", "chunks")
    assert out == [(0, ["a b c"]), (1, [])]


def test_short_tail_is_folded(spark):
    long, short = "x" * 150, "y" * 20
    df = spark.createDataFrame(
        [(0, [long + " \n", short]), (1, [short]), (2, [long, long]), (3, [long, long, short]), (4, [])],
        "doc_id long, chunks array<string>",
    )
    out = {r["doc_id"]: r["chunks"] for r in chunk.chunk_tail_merge(df).collect()}
    assert out == {0: [f"{long}\n{short}"], 1: [short], 2: [long, long], 3: [long, f"{long}\n{short}"], 4: []}


@given(st.text(alphabet="ab \n", max_size=400))
@settings(max_examples=200, deadline=None)
def test_recursive_cuts(text):
    size, overlap = 30, 8
    pieces = chunk._recursive_cuts(text, size, overlap) if text else []
    assert all(0 < len(p) <= size for p in pieces)
    at = 0
    for piece in pieces:  # pieces cover the text in order, overlapping at most so much
        start = text.find(piece, max(0, at - overlap))
        assert 0 <= start <= at
        at = start + len(piece)
    assert at == len(text)


def test_recursive_rejects_large_overlap(spark):
    with pytest.raises(ValueError):
        chunk.chunk_recursive(docs(spark, "a"), 10, 5)


def test_metadata_json_is_canonical(spark):
    df = spark.createDataFrame([("b", 'q"x', 3)], "z string, a string, m int")
    got = chunk.metadata_json(df, ["z", "a", "m"]).head()["metadata_json"]
    assert list(json.loads(got).items()) == [("a", 'q"x'), ("m", "3"), ("z", "b")]


def test_chunk_ids_and_repeats(spark):
    df = spark.createDataFrame([("k", "p", "same same same same ")], "doc_key string, path string, text string")
    out = chunk.build_chunks(df.union(df.withColumn("text", F.lit(""))), ["path"], size=1).collect()
    # Equal chunks of one document are one row; the short tail was folded.
    assert [(r["pos"], r["text"]) for r in out] == [(0, "same "), (1, "same\nsame ")]
    want = hashlib.sha256(b'{"path":"p"}\x00' + out[0]["text"].encode()).hexdigest()
    assert out[0]["chunk_id"] == want


def test_unknown_splitter(spark):
    with pytest.raises(ValueError):
        chunk.build_chunks(docs(spark, "a").withColumn("doc_key", F.lit("k")), ["doc_id"], splitter="x")


# --- routing and parsing --------------------------------------------------


def routes(spark, names, rules=None, env=None):
    df = spark.createDataFrame([(n, "." + n.rsplit(".", 1)[1] if "." in n else "") for n in names], "name string, suffix string")
    return {r["name"]: (r["parser"], r["skip_reason"] is not None) for r in parse.parser_route(df, rules, env).collect()}


NAMES = ["a.pdf", "scan.png", "a.txt", "a.docx", "a.mp3", "a.mp4", "call.wav", "demo.mp4", "README"]


def test_default_routes_without_keys(spark):
    got = routes(spark, NAMES)
    assert got["a.pdf"] == ("pypdf", False) and got["a.txt"] == ("utf8", False) and got["README"] == ("utf8", False)
    assert got["a.docx"] == ("unstructured", False)
    assert {got[n] for n in ("scan.png", "a.mp3", "a.mp4", "call.wav")} == {("skip", True)}


def test_default_routes_with_everything(spark):
    env = {"docling": True, "paddleocr": True, "openai_key": True, "twelvelabs_key": True}
    got = routes(spark, NAMES, env=env)
    assert [got[n][0] for n in ("a.pdf", "scan.png", "call.wav", "demo.mp4")] == ["docling", "paddle_ocr", "whisper", "twelvelabs_video"]


def test_first_matching_rule_wins(spark):
    rules = [{"match": ["call*", "x.mp3"], "type": "whisper"}, {"match": ["*.wav"], "type": "skip"}]
    assert routes(spark, ["call.wav", "b.wav"], rules) == {"call.wav": ("whisper", False), "b.wav": ("skip", True)}
    nameless = spark.createDataFrame([("", ".mp3"), (None, ".mp3")], "name string, suffix string")
    assert {r["parser"] for r in parse.parser_route(nameless, rules).collect()} == {"whisper"}


def test_parse_documents(spark):
    df = spark.createDataFrame(
        [("a.txt", ".txt", b"caf\xc3\xa9 \xff"), ("b.html", ".html", b"<p>x</p>"), ("c.mp4", ".mp4", b"1"), ("d.txt", ".txt", None), ("e.pdf", ".pdf", b"PDF")],
        "name string, suffix string, content binary",
    )
    own = {"pypdf": lambda c: F.concat(F.lit("pdf:"), c.cast("string"))}
    out = {r["name"]: r["text"] for r in parse.parse_documents(parse.parser_route(df), own).collect()}
    assert out == {"a.txt": "café �", "b.html": "x", "c.mp4": "", "d.txt": "", "e.pdf": "pdf:PDF"}


def test_eviction_keeps_the_newest_within_budget(spark):
    data = [(i, t, s) for i, (t, s) in enumerate([(5, 10), (9, 20), (9, 30), (1, 5), (7, 40)])]
    cache = spark.createDataFrame(data, "entry_id long, last_used long, size_bytes long")
    kept = lambda budget: [r[0] for r in rows(parse.cache_evict_lru(cache, budget), "entry_id")]
    assert kept(1000) == [0, 1, 2, 3, 4]
    assert kept(60) == [1, 2]
    assert kept(19) == []
    assert kept(104) == [0, 1, 2, 4]


# --- embedding ------------------------------------------------------------


def test_dedup_embeds_each_text_once(spark):
    texts = ["hot"] * 300 + [f"t{i}" for i in range(20)] + ["cached"] * 5
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string").repartition(6)
    cache = spark.createDataFrame([(hashlib.sha256(b"cached").hexdigest(), "m", [7.0])], "text_key string, model string, embedding array<float>")
    calls = spark.sparkContext.accumulator(0)

    def model(df):
        @F.udf("array<float>")
        def length(t):
            calls.add(1)
            return [float(len(t))]

        return df.withColumn("embedding", length("text"))

    out, fresh = embed.embed_dedup_cache(chunks, cache, model, "m")
    got = rows(out, "chunk_id", "text", "embedding")
    assert len(got) == len(texts)
    assert all(e == ([7.0] if t == "cached" else [float(len(t))]) for _, t, e in got)
    assert fresh.count() == 21 and calls.value == 21


def test_batches_and_retries(spark):
    import numpy as np

    def factory():
        state = {"calls": 0}

        def model(texts):
            state["calls"] += 1
            if state["calls"] == 1:
                raise OSError("busy")
            assert len(texts) <= 4
            return np.array([[len(t), 1.0] for t in texts])

        return model

    df = docs(spark, *["x" * i for i in range(1, 11)]).coalesce(1)
    out = rows(embed.embed_batch(df, factory, batch_size=4, retries=1), "text", "embedding")
    assert all(e == [float(len(t)), 1.0] for t, e in out) and len(out) == 10
    assert embed.probe_dimension(lambda: lambda t: np.zeros((len(t), 5))) == 5


@pytest.mark.parametrize("limit", [10_000, 1])
def test_static_means(spark, monkeypatch, limit):
    monkeypatch.setattr(embed, "MAX_LOOKUP_VALUES", limit)
    lookup = spark.createDataFrame([("cat", [1.0, 0.0]), ("dog", [0.0, 2.0])], "term string, vec array<float>")
    df = spark.createDataFrame([("a", "Cat cat dog bird"), ("b", "bird"), ("c", "dog")], "chunk_id string, text string")
    out = rows(embed.embed_static(df, lookup, 2), "chunk_id", "embedding", "n_known")
    assert [(k, n) for k, _, n in out] == [("a", 3), ("b", 0), ("c", 1)]
    assert out[0][1] == pytest.approx([2 / 3, 2 / 3]) and out[1][1] == [0.0, 0.0] and out[2][1] == [0.0, 2.0]


@pytest.mark.parametrize("limit", [10**9, 1])
def test_static_means_against_brute_force(spark, monkeypatch, limit):
    """256 dimensions, long texts across blocks, nulls, repeated keys: both paths equal a plain mean."""
    monkeypatch.setattr(embed, "MAX_LOOKUP_VALUES", limit)
    monkeypatch.setattr(embed, "BLOCK_TOKENS", 7)
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(50)]
    vecs = rng.normal(size=(50, 256)).astype(np.float32)
    lookup = spark.createDataFrame([(t, v.tolist()) for t, v in zip(vocab, vecs)], "term string, vec array<float>")
    texts = [" ".join(rng.choice(vocab + ["unknown"], int(rng.integers(0, 40)))) for _ in range(30)]
    texts += [None, "", "W3 w3 w3", "w1 " * 5000]
    data = [(i % 31, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "chunk_id long, text string").repartition(3)
    got = sorted((r["chunk_id"], r["n_known"], tuple(r["embedding"])) for r in embed.embed_static(df, lookup, 256).collect())
    want = []
    for k, t in data:
        ids = [vocab.index(w) for w in (t or "").lower().split() if w in vocab]
        mean = vecs[ids].astype(np.float64).mean(axis=0) if ids else np.zeros(256)
        want.append((k, len(ids), tuple(mean.astype(np.float32))))
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want)):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-5)


def test_static_means_of_many_words_send_no_sums(spark, monkeypatch):
    """Beyond the bound, words and texts meet block by block: the vectors of a text are summed in one task."""
    monkeypatch.setattr(embed, "MAX_LOOKUP_VALUES", 1)
    monkeypatch.setattr(embed, "LEAST_CHARS", 5)
    lookup = spark.createDataFrame([(f"w{i}", [float(i), 1.0]) for i in range(40)], "term string, vec array<float>")
    data = [(i, f"w{i} w{i + 1} nothing") for i in range(30)] + [(7, "w0"), (None, "w1 w1"), (99, None)]
    out = embed.embed_static(spark.createDataFrame(data, "chunk_id long, text string").repartition(3), lookup, 2)
    got = rows(out, "chunk_id", "n_known", "embedding")
    want = [(i, 2, [i + 0.5, 1.0]) for i in range(30)] + [(7, 1, [0.0, 1.0]), (None, 2, [1.0, 1.0]), (99, 0, [0.0, 0.0])]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert "sum(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_static_embedding_is_narrow(spark):
    lookup = spark.createDataFrame([("cat", [1.0, 0.0])], "term string, vec array<float>")
    df = spark.createDataFrame([("a", "cat")], "chunk_id string, text string")
    plan = embed.embed_static(df, lookup, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
