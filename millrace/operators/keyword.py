"""BM25 over the chunk store as joins and grouped sums."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators.vector import rank_hits
from millrace.plans.skew import at_most
from millrace.session import written

# Okapi BM25 parameters.
K1 = 1.5
B = 0.75

# Query-term rows (about 100 bytes each) that may be broadcast.
MAX_BROADCAST_TERMS = 200_000
# Groups over which the chunks of one term are spread beyond that.
TERM_SALTS = 64


def tokenize(df: DataFrame, column: str = "text", out: str = "tokens") -> DataFrame:
    return df.withColumn(out, tx.words(F.col(column)))


@dataclass
class KeywordIndex:
    """The index as tables.

    ``postings`` (chunk_id, dl, term, tf) is laid out by chunk and not by
    term: a word that every chunk has is then spread over all tasks. Every
    chunk has at least one row; a NULL term stands for the words left out.
    ``term_stats`` is (term, df, idf), ``totals`` the one row (n, total_len,
    avgdl). ``by_chunk`` says that Spark knows the postings to be hashed by
    chunk, so that a chunk's score needs no further shuffle.
    """

    postings: DataFrame
    term_stats: DataFrame
    totals: DataFrame
    by_chunk: bool = False

    def kept(self) -> "KeywordIndex":
        """The same index over postings written once to the shared folder."""
        return _index(written(self.postings, "postings"), by_chunk=False)

    def save(self, root: str) -> "KeywordIndex":
        """Write the tables below ``root`` and return the index over the files."""
        spark = self.postings.sparkSession
        self.postings.write.mode("overwrite").parquet(f"{root}/postings")
        # The small tables follow from the postings as written.
        kept = _index(spark.read.parquet(f"{root}/postings"), by_chunk=False)
        kept.totals.write.mode("overwrite").parquet(f"{root}/totals")
        totals = spark.read.parquet(f"{root}/totals")
        _term_stats(kept.postings, totals).write.mode("overwrite").parquet(f"{root}/term_stats")
        return KeywordIndex.load(spark, root)

    @staticmethod
    def load(spark: SparkSession, root: str) -> "KeywordIndex":
        return KeywordIndex(*[spark.read.parquet(f"{root}/{n}") for n in ("postings", "term_stats", "totals")])

    def save_tables(self, prefix: str, buckets: int) -> "KeywordIndex":
        """Keep the postings as a table bucketed by chunk: searches then need
        no shuffle but the one of the top k."""
        spark = self.postings.sparkSession
        self.postings.write.mode("overwrite").bucketBy(buckets, "chunk_id").saveAsTable(f"{prefix}_postings")
        for name in ("term_stats", "totals"):
            getattr(self, name).write.mode("overwrite").saveAsTable(f"{prefix}_{name}")
        tables = [spark.table(f"{prefix}_{n}") for n in ("postings", "term_stats", "totals")]
        return KeywordIndex(*tables, by_chunk=True)


def _postings(chunks: DataFrame) -> DataFrame:
    """Term counts per chunk, complete within one shuffle of the texts.

    The texts are sorted by chunk within their task and their words counted step by step in Arrow, so a task
    holds no table of all its (chunk, term) pairs. Rows of one chunk id that have as many words count as one.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    from millrace.session import ship

    ship(chunks.sparkSession)
    # Tokens are made after the shuffle: texts are smaller than their tokens.
    texts = chunks.select("chunk_id", "text").repartition("chunk_id").sortWithinPartitions("chunk_id")
    tokens = tokenize(texts).select("chunk_id", F.size("tokens").alias("dl"), "tokens")
    fields = [T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]
    schema = T.StructType([*tokens.schema.fields[:2], *fields])
    arrow_schema = to_arrow_schema(schema)
    return tokens.mapInArrow(lambda batches: _count_terms(batches, arrow_schema), schema)


# Words of one step of a task that counts them; a text is never cut.
STEP_WORDS = 1 << 18
# Rows of a chunk that goes on over steps are merged once there are so many more of them, and twice as many.
MERGE_ROWS = 1 << 16


def _count_terms(batches, schema):
    """``(chunk_id, dl, term, tf)`` of ``(chunk_id, dl, tokens)`` sorted by chunk; no words are one NULL term.

    A step holds the words of whole texts, about ``STEP_WORDS`` at most, and the counts of the last chunk.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    keys = ["chunk_id", "dl", "term"]

    def summed(parts):
        table = pa.concat_tables(parts)
        if len(parts) > 1:
            table = table.group_by(keys, use_threads=False).aggregate([("tf", "sum")]).rename_columns(schema.names)
        return table.select(schema.names).cast(schema).combine_chunks()

    def steps():
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, before + STEP_WORDS, side="right")))
                yield batch.slice(at, stop - at)
                at = stop

    # Counts of the last chunk so far, which the next step may go on with.
    open_id, held, merged = None, [], 0
    for batch in steps():
        n = batch.num_rows
        ids = pc.dictionary_encode(batch.column(0), null_encoding="encode")
        words = batch.column(2)
        counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        empty = np.flatnonzero(counts == 0)
        row = np.concatenate([np.repeat(np.arange(n), counts), empty])
        flat = {
            "code": pa.array(ids.indices.to_numpy(zero_copy_only=False)[row], pa.int32()),
            "dl": batch.column(1).take(pa.array(row)),
            "term": pa.concat_arrays([words.flatten(), pa.nulls(len(empty), words.type.value_type)]),
        }
        found = pa.table(flat).group_by(["code", "dl", "term"], use_threads=False).aggregate([([], "count_all")])
        codes = found.column("code").combine_chunks()
        columns = [ids.dictionary.take(codes), found.column("dl"), found.column("term"), found.column("count_all")]
        found = pa.table(columns, names=schema.names).cast(schema)
        codes = codes.to_numpy()
        first, last = ids.indices[0].as_py(), ids.indices[n - 1].as_py()
        if held and batch.column(0)[0].as_py() != open_id:
            yield from summed(held).to_batches()
            held, merged = [], 0
        if held and first != last:
            yield from summed([*held, found.filter(pa.array(codes == first))]).to_batches()
            held, merged = [], 0
            keep = (codes != first) & (codes != last)
        else:
            keep = codes != last
        if keep.any():
            yield from found.filter(pa.array(keep)).combine_chunks().to_batches()
        held.append(found.filter(pa.array(codes == last)))
        open_id = batch.column(0)[n - 1].as_py()
        if (rows := sum(t.num_rows for t in held)) > 2 * merged + MERGE_ROWS:
            held = [summed(held)]
            merged = held[0].num_rows
    if held:
        yield from summed(held).to_batches()


def _doc_len(postings: DataFrame) -> DataFrame:
    return postings.groupBy("chunk_id").agg(F.max("dl").alias("dl"))


def _totals(doc_len: DataFrame) -> DataFrame:
    sums = doc_len.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("dl").cast("bigint")), F.lit(0)).alias("total_len")
    )
    return _with_avgdl(sums)


def _with_avgdl(sums: DataFrame) -> DataFrame:
    return sums.withColumn("avgdl", F.when(F.col("n") > 0, F.col("total_len") / F.col("n")).otherwise(F.lit(0.0)))


def _with_idf(freq: DataFrame, totals: DataFrame) -> DataFrame:
    n = totals.select("n").scalar()
    return freq.withColumn("idf", F.log(1.0 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def _freq(postings: DataFrame, sign: int = 1) -> DataFrame:
    return postings.where(F.col("term").isNotNull()).groupBy("term").agg((F.count(F.lit(1)) * sign).alias("df"))


def _term_stats(postings: DataFrame, totals: DataFrame) -> DataFrame:
    return _with_idf(_freq(postings), totals)


def _index(postings: DataFrame, by_chunk: bool) -> KeywordIndex:
    totals = _totals(_doc_len(postings))
    return KeywordIndex(postings, _term_stats(postings, totals), totals, by_chunk)


def bm25_index(chunks: DataFrame) -> KeywordIndex:
    """Index every word of ``(chunk_id, text)``."""
    return _index(_postings(chunks), by_chunk=True)


def bm25_refresh(index: KeywordIndex, deletes: DataFrame, inserts: DataFrame) -> KeywordIndex:
    """The index after removing chunks (by id) and adding chunks.

    Only the changed chunks are tokenised; document frequencies and totals
    move by differences. An edit that keeps the row count is therefore seen.
    """
    gone = deletes.select("chunk_id")
    old = index.postings.join(gone, "chunk_id", "left_semi")
    # Written once: counted by three branches below.
    new = written(_postings(inserts), "postings")
    postings = index.postings.join(gone, "chunk_id", "left_anti").unionByName(new)
    freq = (
        index.term_stats.select("term", "df")
        .unionByName(_freq(old, -1))
        .unionByName(_freq(new, 1))
        .groupBy("term")
        .agg(F.sum("df").alias("df"))
        .where(F.col("df") > 0)
    )

    def size(rows: DataFrame, sign: int) -> DataFrame:
        return _totals(_doc_len(rows)).select(
            (F.col("n") * sign).alias("n"), (F.col("total_len") * sign).alias("total_len")
        )

    sums = (
        index.totals.select("n", "total_len")
        .unionByName(size(old, -1))
        .unionByName(size(new, 1))
        .agg(F.sum("n").alias("n"), F.sum("total_len").alias("total_len"))
    )
    totals = _with_avgdl(sums)
    return KeywordIndex(postings, _with_idf(freq, totals), totals)


def query_terms(index: KeywordIndex, queries: DataFrame) -> DataFrame:
    """Known terms per query with their multiplicity: repeated words count again."""
    asked = (
        tokenize(queries, "query")
        .select("query_id", F.explode_outer("tokens").alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("mult"))
    )
    return asked.join(index.term_stats.select("term", "idf"), "term")


def bm25_search(index: KeywordIndex, queries: DataFrame, k: int) -> DataFrame:
    """Top ``k`` chunks per ``(query_id, query)``: query_id, rank, score, chunk_id.

    Every chunk that shares a word with the query is scored. While the query terms are few (checked against
    ``MAX_BROADCAST_TERMS``) they go to every task, and only their statistics are counted. Postings of asked words
    are packed (:func:`_packed`), lie by chunk (hashed once, unless Spark knows them hashed already) and sorted
    within their task, and each task scores chunk after chunk in Arrow (:func:`_score_chunks`): no (query, chunk)
    pair becomes a row, each query keeps its running ``k`` best, and only rows that can still rank leave the task.
    More query terms are joined on (term, salt).
    """
    postings = index.postings.where(F.col("term").isNotNull())
    avgdl = index.totals.select("avgdl").scalar()
    words = tokenize(queries, "query").select(F.explode_outer("tokens").alias("term"))
    if at_most(words, MAX_BROADCAST_TERMS):
        # Few: a semi join with them goes below the count of a term's chunks, but not below its idf.
        asked = F.broadcast(words.distinct())
        freq = index.term_stats.select("term", "df").join(asked, "term", "left_semi")
        terms = query_terms(replace(index, term_stats=_with_idf(freq, index.totals)), queries)
        weights = terms.select("query_id", "term", (F.col("mult") * F.col("idf")).alias("w")).toArrow()
        postings = postings.join(asked, "term", "left_semi")
        mean = index.totals.select("avgdl").head()
        mean = float(mean[0]) if mean and mean[0] else 1.0
        scored = _score_chunks(postings, weights, queries, k, mean, spread=not index.by_chunk)
        return rank_hits(scored, k)
    terms = query_terms(index, queries)
    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(TERM_SALTS)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(TERM_SALTS - 1)))
    matched = postings.withColumn("_salt", salt).join(terms.withColumn("_salt", copies), ["term", "_salt"])
    length = F.col("dl") / F.when(avgdl == 0.0, F.lit(1.0)).otherwise(avgdl)
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length))
    scored = matched.groupBy("query_id", "chunk_id").agg(F.sum(F.col("mult") * part).alias("score"))
    return rank_hits(scored.where(F.col("score") > 0.0), k)


# Pairs of (posting, query) that one step of a task expands at most; a chunk is never cut.
MAX_PAIRS = 1 << 20
# Postings that one packed row holds at most.
PACK = 1 << 12


def _packed(postings: DataFrame, shared) -> DataFrame:
    """Neighbouring postings of one chunk as one row ``(chunk_id, dl, terms, tfs)``; terms are places in the vocabulary.

    A chunk may have several rows. A posting takes some 12 bytes of a sort or shuffle so, and not its chunk's id and
    its word. Terms outside the vocabulary are left out.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql import types as T

    def run(batches):
        vocab = shared.value[0]
        for batch in batches:
            t = pc.index_in(batch.column(1), value_set=vocab)
            known = pc.is_valid(t)
            t, batch = t.filter(known), batch.filter(known)
            n = batch.num_rows
            if not n:
                continue
            ids = pc.dictionary_encode(batch.column(0), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            dl = batch.column(3).to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (dl[1:] != dl[:-1])])
            place = np.arange(n) - np.repeat(heads, np.diff(np.r_[heads, n]))
            heads = np.flatnonzero(place % PACK == 0)
            ends = pa.array(np.r_[heads, n].astype(np.int32))
            first = batch.take(pa.array(heads))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (t, batch.column(2))]
            yield pa.RecordBatch.from_arrays([first.column(0), first.column(3), *lists], names=["chunk_id", "dl", "terms", "tfs"])

    postings = postings.select("chunk_id", "term", F.col("tf").cast("bigint").alias("tf"), F.col("dl").cast("int").alias("dl"))
    lists = [T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))]
    schema = T.StructType([postings.schema["chunk_id"], T.StructField("dl", T.IntegerType()), *lists])
    return postings.mapInArrow(run, schema)


def _score_chunks(
    postings: DataFrame, weights, queries: DataFrame, k: int, avgdl: float, spread: bool = False
) -> DataFrame:
    """Per task, document at a time: the rows ``(query_id, chunk_id, score)`` that can still reach a top ``k``.

    All ``postings`` of a chunk lie in one task, or are brought there with ``spread``. Packed, they are sorted by
    chunk, so a chunk's rows are neighbours; the last chunk of an Arrow batch waits for the next batch. Each step
    expands the postings of whole chunks into (posting, query) pairs in memory, at most about ``MAX_PAIRS``, sums
    them per (chunk, query) and keeps, per query, the scores at or above both the step's ``k``-th best and the
    task's running ``k``-th best (ties stay for the ranking).
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    from millrace.session import ship

    spark = postings.sparkSession
    terms = weights.column("term").combine_chunks()
    vocab = pc.unique(terms)
    # Query ids may be structs (sub-queries), which Arrow cannot look up: numbered here, as the rows are bounded.
    asked = weights.column("query_id").combine_chunks()
    seen: dict = {}
    q_idx = np.array([seen.setdefault(_hashable(x), len(seen)) for x in asked.to_pylist()], dtype=np.int64)
    firsts = np.unique(q_idx, return_index=True)[1] if len(q_idx) else np.zeros(0, dtype=np.int64)
    query_ids = asked.take(pa.array(firsts, pa.int64()))
    t_idx = pc.index_in(terms, value_set=vocab).to_numpy(zero_copy_only=False)
    order = np.argsort(t_idx, kind="stable")
    starts = np.searchsorted(t_idx[order], np.arange(len(vocab) + 1))
    by_term = (starts, q_idx[order], weights.column("w").to_numpy()[order].astype(np.float64))
    shared = spark.sparkContext.broadcast((vocab, query_ids, by_term))
    ship(spark)
    schema = T.StructType(
        [queries.schema["query_id"], T.StructField("chunk_id", postings.schema["chunk_id"].dataType), T.StructField("score", T.DoubleType())]
    )
    arrow_schema = to_arrow_schema(schema)
    digits = 10.0**9

    def run(batches):
        vocab, query_ids, (starts, q_of, w_of) = shared.value
        n_q = len(query_ids)
        best = np.full((n_q, k), -np.inf)

        def step(ids, codes, t, tf, dl):
            """Scores of whole chunks; rows that can still rank, and the running k best moved on."""
            counts = starts[t + 1] - starts[t]
            rep = np.repeat(np.arange(len(t)), counts)
            at = np.arange(len(rep)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts[t], counts)
            q, w = q_of[at], w_of[at]
            part = w * tf[rep] * (K1 + 1) / (tf[rep] + K1 * (1 - B + B * dl[rep] / avgdl))
            pair, inverse = np.unique(codes[rep] * n_q + q, return_inverse=True)
            score = np.bincount(inverse, weights=part, minlength=len(pair))
            chunk_of, q_pair = pair // n_q, pair % n_q
            ranked = np.rint(score * digits)
            by = np.lexsort((-ranked, q_pair))
            q_sorted = q_pair[by]
            place = np.arange(len(by)) - np.searchsorted(q_sorted, q_sorted, side="left")
            top, top_place = by[place < k], place[place < k]
            step_best = np.full((n_q, k), -np.inf)
            step_best[q_pair[top], k - 1 - top_place] = ranked[top]
            cut = np.maximum(step_best[:, 0], best[:, 0])
            keep = np.flatnonzero((ranked >= cut[q_pair]) & (score > 0.0))
            both = np.concatenate([best, step_best], axis=1)
            both.sort(axis=1)
            best[:, :] = both[:, -k:]
            if len(keep):
                columns = [query_ids.take(pa.array(q_pair[keep])), ids.take(pa.array(chunk_of[keep])), pa.array(score[keep], pa.float64())]
                return pa.RecordBatch.from_arrays(columns, schema=arrow_schema)
            return None

        def whole_chunks(table):
            """Postings of ``table`` in groups of whole chunks of at most about ``MAX_PAIRS`` pairs."""
            if not table.num_rows:
                return
            encoded = pc.dictionary_encode(table.column("chunk_id").combine_chunks(), null_encoding="encode")
            ids, codes = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False)
            dl = table.column("dl").to_numpy().astype(np.float64)
            lists = table.column("terms").combine_chunks()
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            ends = np.r_[0, np.cumsum(sizes)]  # postings ahead of each row
            t = lists.flatten().to_numpy(zero_copy_only=False)
            tf = table.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            pairs = np.cumsum(np.diff(starts)[t])
            before = np.r_[0, pairs][ends[heads]]  # pairs ahead of each chunk
            at = 0
            while at < len(heads):
                # The chunks that fit after this one; always at least one.
                stop = max(at + 1, int(np.searchsorted(before, before[at] + MAX_PAIRS, side="right")) - 1)
                lo, hi = heads[at], heads[stop] if stop < len(heads) else table.num_rows
                row, some = np.repeat(np.arange(lo, hi), sizes[lo:hi]), slice(ends[lo], ends[hi])
                out = step(ids, codes[row], t[some], tf[some].astype(np.float64), dl[row])
                if out is not None:
                    yield out
                at = stop

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            n = table.num_rows
            if n == 0:
                continue
            chunk_col = table.column("chunk_id").combine_chunks()
            last = chunk_col[n - 1]
            same = pc.is_null(chunk_col) if not last.is_valid else pc.fill_null(pc.equal(chunk_col, last), False)
            same = same.to_numpy(zero_copy_only=False)
            cut_at = int(np.argmax(same))
            held = table.slice(cut_at)
            yield from whole_chunks(table.slice(0, cut_at))
        if held is not None:
            yield from whole_chunks(held)

    packed = _packed(postings, shared)
    packed = packed.repartition("chunk_id") if spread else packed
    return packed.sortWithinPartitions("chunk_id").mapInArrow(run, schema)


def _hashable(value):
    return tuple(sorted(value.items())) if isinstance(value, dict) else value


def with_chunks(hits: DataFrame, store: DataFrame, columns: tuple[str, ...], few_hits: bool) -> DataFrame:
    """Add stored columns to hits; a bounded set of hits goes to the store's rows."""
    side = F.broadcast(hits) if few_hits else hits
    return store.select("chunk_id", *columns).join(side, "chunk_id")
