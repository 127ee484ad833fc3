"""Spelling variants: words one edit apart, found by joining pairs of trie-node numbers.

Every word of the vocabulary is cut at each of its places into a prefix and a suffix. A prefix is a node of
the forward trie of all words and a suffix a node of the trie of reversed words; each node gets a number
(a 62-bit polynomial hash of the node's string, two prime moduli packed into one long, so that the number
of a node follows from its string alone and no trie is held anywhere). A word ``w`` of length ``L`` gives

* ``L + 1`` *split* pairs ``(prefix node of w[:i], suffix node of w[i:])``, which name ``w`` alone, and
* ``L`` *skip* pairs ``(prefix node of w[:i], suffix node of w[i+1:])``, the pair of ``w`` with place ``i`` left out.

A skip pair of ``w`` equal to a split pair of ``u`` means ``u`` is ``w`` with one code point deleted (and ``w`` is
``u`` with one inserted); two words with an equal skip pair differ in one replaced code point. The joins are
equi-joins on two longs, so a word meets only its true neighbours; deletions are confirmed by an exact
Levenshtein test, and a skip pair is counted for deletions only at the first place of a run of equal code
points, so each neighbour is found once. Words that share a skip pair are not paired: each group gives
its size and its best two members (an aggregate), which is all that counts and forms need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import ascii_lower, numbered
from millrace.session import ship, written

# Fixed by the operator's definition: letters of a run, least length and count of a word, the deletion rule.
LETTERS = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT = 5, 3
DROP_EVERY = 97
# Moduli and bases of the node numbers (both moduli prime, below 2**31).
MODULI = (2147483647, 2147483629)
BASES = (1000003, 916132831)


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``word, n``: distinct words of all texts and how often they occur, under the deletion rule.

    Runs of :data:`LETTERS` are taken from whole texts; A-Z alone is lower-cased. With ``h`` the unsigned
    CRC-32 of the UTF-8 text ``<doc_id>:<run>``, a run whose ``h`` is divisible by 97 loses its code point
    ``h % length``. Words are the results of at least 5 code points that occur at least 3 times overall.
    Null texts have no runs; a null ``doc_id`` is written as the empty string. Repeated rows count again.
    """
    runs = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_d"),
        F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(LETTERS), F.lit(0))).alias("_run"),
    )
    low = ascii_lower(F.col("_run"))
    h = F.crc32(F.concat(F.col("_d"), F.lit(":"), low))
    at = h % F.length(low)
    cut = F.concat(F.substring(low, F.lit(1), at.cast("int")), F.substring(low, (at + 2).cast("int"), F.length(low)))
    words = runs.select(F.when(h % DROP_EVERY == 0, cut).otherwise(low).alias("word"))
    counted = words.where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)


PLACES = T.StructType(
    [
        T.StructField("wid", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("i", T.LongType()),
        T.StructField("pre", T.LongType()),
        T.StructField("suf", T.LongType()),
        T.StructField("skip_suf", T.LongType()),
        T.StructField("first", T.BooleanType()),
    ]
)
# Place rows that one Arrow batch of the numbering holds at most.
BATCH_PLACES = 1 << 16


def trie_places(vocab: DataFrame) -> DataFrame:
    """One row per place ``i`` (0 .. length) of every word of ``vocab`` (``wid, n, word``).

    ``pre`` and ``suf`` number the trie nodes of ``word[:i]`` and ``word[i:]``; ``skip_suf`` that of
    ``word[i+1:]`` (null at the end); ``first`` says that place ``i`` starts a run of equal code points. Rows carry
    the word's number, never the word, so a long word costs rows in proportion to its length; batches are cut at
    ``BATCH_PLACES`` rows.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    (p1, p2), (b1, b2) = MODULI, BASES
    schema = to_arrow_schema(PLACES)

    def run(batches):
        out = {f.name: [] for f in PLACES.fields}

        def flush():
            batch = pa.RecordBatch.from_pydict(out, schema=schema)
            for column in out.values():
                column.clear()
            return batch

        for batch in batches:
            for wid, n, word in zip(*(c.to_pylist() for c in batch.columns)):
                codes = [ord(c) + 1 for c in word]
                size = len(codes)
                pre, suf = [0] * (size + 1), [0] * (size + 1)
                a = b = 0
                for i, c in enumerate(codes):
                    a, b = (a * b1 + c) % p1, (b * b2 + c) % p2
                    pre[i + 1] = (a << 31) | b
                a = b = 0
                for i in range(size - 1, -1, -1):
                    a, b = (a * b1 + codes[i]) % p1, (b * b2 + codes[i]) % p2
                    suf[i] = (a << 31) | b
                for i in range(size + 1):
                    out["wid"].append(wid)
                    out["n"].append(n)
                    out["size"].append(size)
                    out["i"].append(i)
                    out["pre"].append(pre[i])
                    out["suf"].append(suf[i])
                    out["skip_suf"].append(suf[i + 1] if i < size else None)
                    out["first"].append(i == 0 or (i < size and codes[i] != codes[i - 1]))
                    if len(out["wid"]) >= BATCH_PLACES:
                        yield flush()
        if out["wid"]:
            yield flush()

    ship(vocab.sparkSession)
    return vocab.select("wid", "n", "word").mapInArrow(run, PLACES)


def _best(n: Column, wid: Column) -> Column:
    """Orders so that ``min`` is the largest ``n``, then the smallest word (word numbers follow code-point order)."""
    return F.struct((-n).alias("neg_n"), wid.alias("wid"))


def spelling_variants(words: DataFrame) -> DataFrame:
    """Forms and roots of words given as ``word, n`` (distinct words and their counts).

    Returns ``word, form, root`` (strings) and ``n, n_near, form_n`` (longs). Two words are near when one
    inserted, deleted or replaced code point turns one into the other; ``n_near`` counts a word's near words.
    A word's ``form`` is its near word of largest ``n`` (ties: the smallest in code-point order) when that ``n``
    is at least twice the word's own, else null; ``form_n`` is its ``n``. ``root`` follows forms to the last one
    (the word itself when it has no form); as a form has at least twice the count, no chain is a loop.
    Rows with a null or empty word are dropped, repeated words are summed, other columns are not kept.
    An empty table gives no rows. Code points order words as Spark orders strings (UTF-8 bytes agree).

    Words are numbered once in code-point order (the vocabulary is written then), and everything after works on
    numbers: the joins of split and skip pairs, the groups of replacements, forms and roots.
    """
    summed = words.where(F.length("word") > 0).groupBy("word").agg(F.sum("n").cast("bigint").alias("n"))
    vocab = written(numbered(summed, ["word"], "wid", "variant-vocab"), "variant-vocab")
    places = written(trie_places(vocab), "variant-places")
    splits = places.select(
        F.col("wid").alias("short"), F.col("n").alias("short_n"), F.col("size").alias("short_size"),
        F.col("pre").alias("k1"), F.col("suf").alias("k2"),
    )
    skips = places.where(F.col("i") < F.col("size")).select(
        "wid", "n", "size", F.col("pre").alias("k1"), F.col("skip_suf").alias("k2"), "first"
    )

    # Deletions: a skip pair of the longer word is a split pair of the shorter one (at most one such word),
    # confirmed on the words themselves.
    deleted = skips.where("first").join(splits, ["k1", "k2"]).where(F.col("short_size") == F.col("size") - 1)
    spelled = vocab.select("wid", "word")
    deleted = (
        deleted.select("wid", "n", "short", "short_n")
        .join(spelled, "wid")
        .join(spelled.select(F.col("wid").alias("short"), F.col("word").alias("short_word")), "short")
        .where(F.levenshtein("word", "short_word", 1) == 1)
    )
    one = F.lit(1).cast("bigint").alias("count")
    by_deletion = deleted.select("wid", one, _best(F.col("short_n"), F.col("short")).alias("best")).unionByName(
        deleted.select(F.col("short").alias("wid"), one, _best(F.col("n"), F.col("wid")).alias("best"))
    )

    # Replacements: words with one skip pair in common; each group gives its size and best two members.
    groups = skips.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("group"), F.min(_best(F.col("n"), F.col("wid"))).alias("b1"))
    members = skips.join(groups.where("group > 1"), ["k1", "k2"])
    seconds = (
        members.where(F.col("wid") != F.col("b1.wid"))
        .groupBy("k1", "k2")
        .agg(F.min(_best(F.col("n"), F.col("wid"))).alias("b2"))
    )
    by_replacement = members.join(seconds, ["k1", "k2"]).select(
        "wid",
        (F.col("group") - 1).alias("count"),
        F.when(F.col("wid") == F.col("b1.wid"), F.col("b2")).otherwise(F.col("b1")).alias("best"),
    )

    near = by_deletion.unionByName(by_replacement).groupBy("wid").agg(F.sum("count").alias("n_near"), F.min("best").alias("best"))
    has_form = -F.col("best.neg_n") >= 2 * F.col("n")
    formed = written(
        vocab.join(near, "wid", "left").select(
            "wid",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(has_form, F.col("best.wid")).alias("form_wid"),
            F.when(has_form, -F.col("best.neg_n")).cast("bigint").alias("form_n"),
        ),
        "variant-forms",
    )
    roots = follow_forms(formed.select(F.col("wid").alias("word"), F.col("form_wid").alias("form")))
    named = formed.join(roots.withColumnRenamed("word", "wid"), "wid").join(spelled, "wid")
    named = named.join(spelled.select(F.col("wid").alias("form_wid"), F.col("word").alias("form")), "form_wid", "left")
    named = named.join(spelled.select(F.col("wid").alias("root"), F.col("word").alias("root_word")), "root")
    return named.select("word", "form", F.col("root_word").alias("root"), "n", "n_near", "form_n")


def follow_forms(links: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form`` (any type): forms followed to their end by pointer doubling, one written
    table per round.

    Each round replaces a word's pointer by its pointer's pointer, so a chain of length ``c`` ends after
    about log2(c) rounds; one count per round tells whether any pointer still moves.
    """
    step = written(links.select("word", F.coalesce("form", "word").alias("root")), "variant-roots")
    while True:
        ahead = step.alias("a").join(step.alias("b"), F.col("a.root") == F.col("b.word"))
        moved = ahead.select(F.col("a.word").alias("word"), F.col("b.root").alias("root"), (F.col("a.root") != F.col("b.root")).alias("moved"))
        moved = written(moved, "variant-roots")
        if moved.where("moved").limit(1).count() == 0:
            return moved.select("word", "root")
        step = moved.select("word", "root")
