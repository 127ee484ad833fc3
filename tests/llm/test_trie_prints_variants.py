"""Prefix trie, document fingerprints and spelling variants against brute-force versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from conftest import SMALL, rows
from millrace.llm import fingerprints, prefix_trie, queries, variants

CONVS = "conv_id long, turn long, role string, text string, depth string"


def _key(t):
    return tuple((x is None, x) for x in t)


def trie_brute(data):
    """The trie of the rebuilt conversations from Python dictionaries."""
    by = {}
    for c, turn, role, text in data:
        if c is not None:
            by.setdefault(c, []).append((turn, role or "", text or ""))
    order = lambda z: (z[0] is not None, z[0] if z[0] is not None else 0, z[1], z[2])
    own = {c: [(r, x) for _, r, x in sorted(v, key=order)] for c, v in by.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        rebuilt[c] = own.get(base, [])[:h] + own[c][h:]
    nodes, kids = {}, {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    out = []
    for k, members in nodes.items():
        leaves = saved = 0
        stack = [k]
        while stack:
            x = stack.pop()
            leaves += not kids.get(x)
            saved += (len(nodes[x]) - 1) * (len(x[-1][1].encode()) if x else 0)
            stack.extend(kids.get(x, []))
        ends = sorted(c for c in members if len(rebuilt[c]) == len(k))
        parent = min(nodes[k[:-1]]) if k else None
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(members), len(k), parent, len(members), len(kids.get(k, [])), leaves, saved, digest))
    return sorted(out, key=_key)


TRIE_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def test_trie_same_as_brute_force_on_given_table(spark):
    given = spark.read.parquet(f"{SMALL}/conversations.parquet")
    got = rows(queries.op11_prefix_trie(spark, SMALL), *TRIE_COLUMNS, order=_key)
    want = trie_brute([tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()])
    assert got == want


def test_trie_edges(spark):
    data = [
        (0, 0, "user", "hi"), (0, 1, "assistant", None), (0, None, None, "first"),
        (1, 0, "user", "hi"), (1, 0, "user", "hi"),  # a repeated row is a turn of its own
        (2, 5, "user", "é" * 50_000),  # a long text: its UTF-8 bytes count
        (3, 0, "user", "x"), (5, 0, "user", "hi"), (5, 1, "user", "hi"), (7, 0, "assistant", ""),
        (None, 0, "user", "no conversation"),  # dropped
        (12, 0, None, None), (13, 0, "user", "hi"), (-4, 1, "user", "minus"), (-9, 2, "user", "hi"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in data], CONVS)
    got = rows(prefix_trie.prefix_trie(df), *TRIE_COLUMNS, order=_key)
    assert got == trie_brute(data)
    root = [r for r in got if r[1] == 0]
    assert len(root) == 1 and root[0][3] == len({r[0] for r in data if r[0] is not None})


def test_trie_empty_and_copies(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVS)).count() == 0
    copies = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for c in range(0, 200, 5) for t in range(6)]
    got = rows(prefix_trie.prefix_trie(spark.createDataFrame([(*r, None) for r in copies], CONVS)), *TRIE_COLUMNS, order=_key)
    assert got == trie_brute(copies)
    assert max(r[3] for r in got if r[1] == 6) == 40


def variants_brute(docs):
    count = Counter()
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(upper)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            if len(low) >= 5:
                count[low] += 1
    words = {w: n for w, n in count.items() if n >= 3}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)

    def dist1(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) > len(b):
            a, b = b, a
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w, n in words.items():
        near = [u for size in (len(w) - 1, len(w), len(w) + 1) for u in by_length.get(size, []) if u != w and dist1(w, u)]
        best = min(near, key=lambda u: (-words[u], u)) if near else None
        form[w] = best if best and words[best] >= 2 * n else None
        out[w] = [form[w], None, n, len(near), words[form[w]] if form[w] else None]
    for w in out:
        r = w
        while form[r]:
            r = form[r]
        out[w][1] = r
    return sorted((w, *v) for w, v in out.items())


def test_variants_same_as_brute_force(spark):
    given = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    got = rows(queries.op13_variants(spark, SMALL), "word", "form", "root", "n", "n_near", "form_n", order=None)
    assert sorted(got) == variants_brute([tuple(r) for r in given.collect()])


def test_variants_edges(spark):
    texts = (
        ["colour " * 9, "color " * 3, "Colours colors", "kolor kolour colouur"]
        + ["aaaaab " * 4, "aaaab " * 3, "aaaaaab " * 3, "baaaaa " * 3, "straße strasse STRAßE " * 3]
        + [None, "", "x" * 300_000 + " " + "y" * 300_000, "ÀÉÎÕÜ àéîõü " * 3, "word×word " * 3]
    )
    data = [(i % 5 if i % 7 else None, t) for i, t in enumerate(texts)] + [(1, "colour " * 9)]
    df = spark.createDataFrame([(*r, "clash") for r in data], "doc_id long, text string, form string")
    got = rows(variants.spelling_variants(variants.word_counts(df)), "word", "form", "root", "n", "n_near", "form_n", order=None)
    assert sorted(got) == variants_brute(data)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert variants.spelling_variants(variants.word_counts(empty)).count() == 0


def test_variant_chain_reaches_root(spark):
    words = spark.createDataFrame([("abcdef", 1), ("abcdeg", 3), ("abcdxg", 7), ("abcyxg", 20), ("abcyxg", 1)], "word string, n long")
    got = {r["word"]: (r["form"], r["root"], r["n"]) for r in variants.spelling_variants(words).collect()}
    assert got["abcdef"] == ("abcdeg", "abcyxg", 1)
    assert got["abcyxg"] == (None, "abcyxg", 21)


def fingerprint_brute(data):
    ranks = np.array(_ranks(data), dtype=np.int64)
    ordered = sorted(((d, t or "") for d, t in data), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    fps = [fingerprints.digest(t, ranks) for _, t in ordered]
    out = []
    for i, (d, t) in enumerate(ordered):
        j = (i + 1) % len(ordered)
        changed = fingerprints.edited(t, ordered[j][1])
        efp = fingerprints.digest(changed, ranks)
        sha = hashlib.sha256(changed.encode()).hexdigest()
        out.append((d, len(t), sha, fps[i], efp, fingerprints.likeness(fps[i], efp), fingerprints.likeness(fps[i], fps[j])))
    return sorted(out, key=_key)


def _ranks(data):
    total = np.zeros(fingerprints.LEVELS + 1, dtype=np.int64)
    for _, t in data:
        total += np.bincount(fingerprints.entropy_levels((t or "").encode()), minlength=fingerprints.LEVELS + 1)
    usable = sorted((int(total[level]), level) for level in range(fingerprints.LEAST_LEVEL, fingerprints.LEVELS + 1))
    ranks = [1 << 40] * (fingerprints.LEVELS + 1)
    for rank, (_, level) in enumerate(usable):
        ranks[level] = rank
    return ranks


PRINT_COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_fingerprints_same_as_direct_walk(spark, parts):
    rng = np.random.default_rng(7)
    words = ["lantern", "kettle", "orchard", "violin", "bridge", "ß", "é", "42", "the", "of"]
    text = lambda k: " ".join(rng.choice(words, k))
    data = [(i, text(int(rng.integers(0, 400)))) for i in range(40)]
    data += [(3, data[3][1]), (None, text(50)), (41, None), (42, ""), (43, "short"), (44, "ab" * 100_000), (45, text(30_000))]
    df = spark.createDataFrame([(*r, 0.5) for r in data], "doc_id long, text string, near_next double").repartition(parts)
    got = rows(fingerprints.fingerprint_documents(df), *PRINT_COLUMNS, order=_key)
    assert got == fingerprint_brute(data)


def test_fingerprint_properties(spark):
    ranks = np.array(_ranks([(0, "some text " * 200)]), dtype=np.int64)
    rng = np.random.default_rng(3)
    text = " ".join(f"word{i}" for i in rng.integers(0, 10**6, 3000))
    a = fingerprints.digest(text, ranks)
    assert a == fingerprints.digest(text, ranks) and a
    assert fingerprints.likeness(a, a) == 1.0
    assert fingerprints.likeness("", "") == 1.0 and fingerprints.likeness(a, "") == 0.0
    half = fingerprints.digest(text[: len(text) // 2], ranks)
    assert fingerprints.likeness(half, a) > 0.9
    fresh = " ".join(f"term{i}" for i in rng.integers(0, 10**6, 3000))
    other = fingerprints.digest(fresh, ranks)
    assert fingerprints.likeness(a, other) < 0.2
    changed = fingerprints.digest(fingerprints.edited(text, fresh), ranks)
    assert 0.5 < fingerprints.likeness(a, changed) < 0.95
    # The digest with fewer filters is the query: a text whose end became one repeated letter is nearly contained.
    assert fingerprints.likeness(a, fingerprints.digest(fingerprints.edited(text, "x" * 10_000), ranks)) > 0.95
    assert spark.createDataFrame([], "doc_id long, text string").transform(fingerprints.fingerprint_documents).count() == 0


def test_entropy_levels_are_exact():
    data = bytes(np.random.default_rng(1).integers(0, 40, 3000, dtype=np.uint8))
    levels = fingerprints.entropy_levels(data)
    for i in (0, 1, 500, len(data) - 64):
        counts = np.bincount(np.frombuffer(data[i : i + 64], dtype=np.uint8))
        s = sum(int(fingerprints._C_LOG_C[c]) for c in counts)
        assert levels[i] == (1000 * (fingerprints._FULL - s)) // fingerprints._FULL
