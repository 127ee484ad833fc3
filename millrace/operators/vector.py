"""Nearest neighbours of a table of query vectors in a table of stored vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.plans.skew import at_most, salted_join
from millrace.session import new_dir, shuffles_removed, written

# Query tables up to this many values (rows x dimensions) are sent to every
# task as one matrix: 4 million doubles are 32 MB. Larger ones go block by block.
MAX_QUERY_VALUES = 4_000_000
# Store rows and queries of one tile of scores (8 MB of doubles).
TILE_ROWS, TILE_QUERIES = 2048, 512

# Scores are ranked after rounding, so equal texts rank by id whatever the
# order their products were summed in.
RANK_DIGITS = 9


def rounded(score: Column) -> Column:
    """Ranking key of a score; unlike ``round`` it needs no decimal arithmetic."""
    return F.rint(score * F.lit(10.0**RANK_DIGITS))


def rank_hits(
    scored: DataFrame, k: int, score: Column | None = None, ties: str = "chunk_id", by: str = "query_id"
) -> DataFrame:
    """Top ``k`` rows per query as ``rank`` 1…k; ties go to the smaller id.

    Spark prunes each task's rows to ``k`` per query before the shuffle.
    """
    value = rounded(F.col("score") if score is None else score)
    window = Window.partitionBy(by).orderBy(value.desc_nulls_last(), F.col(ties))
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _matrix(column) -> np.ndarray:
    """A list array as a dense matrix of unit-length rows (zero stays zero)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n == 0:
        return flat.reshape(0, 0)
    if flat.size % n:
        raise ValueError("vectors of different dimensions in one column")
    m = flat.reshape(n, -1)
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    np.divide(m, length, out=m, where=length > 0)
    return m


class _Pruner:
    """Per query, the ``k`` best rounded scores a task has seen; rows below them can never rank.

    Scores are taken in tiles of ``TILE_QUERIES x TILE_ROWS``, so a task holds one tile of scores whatever the
    sizes of store and queries. Of a tile, a query keeps the rows at or above both its ``k``-th best rounded score
    in the tile and its ``k``-th best so far; everything dropped has ``k`` rows strictly better, so ties at the
    boundary stay and the final ranking (``rank_hits``) decides them by id. Once all queries of a tile have ``k``
    rows, only the scores that reach those are rounded and ranked.
    """

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.best = np.full((n_queries, k), -np.inf)

    def scan(self, queries: np.ndarray, asked: np.ndarray, vectors: np.ndarray):
        """``(query rows, store rows, scores)`` of the candidates, tile by tile."""
        digits = 10.0**RANK_DIGITS
        for q0 in range(0, len(asked), TILE_QUERIES):
            qs = asked[q0 : q0 + TILE_QUERIES]
            block = queries[qs]
            for r0 in range(0, len(vectors), TILE_ROWS):
                scores = block @ vectors[r0 : r0 + TILE_ROWS].T
                cut = self.best[qs, 0]
                if np.isfinite(cut).all():
                    # A unit below the cut, which rounding cannot make up for.
                    qi, ri = np.nonzero(scores >= ((cut - 1) / digits)[:, None])
                    qi, ri = self._improve(qs, qi, ri, np.rint(scores[qi, ri] * digits))
                else:
                    ranked = np.rint(scores * digits)
                    width = ranked.shape[1]
                    k = min(self.k, width)
                    top = np.partition(ranked, width - k, axis=1)[:, width - k :]
                    cut = np.maximum(top.min(axis=1), cut)
                    qi, ri = np.nonzero(ranked >= cut[:, None])
                    merged = np.concatenate([self.best[qs], top], axis=1)
                    merged.sort(axis=1)
                    self.best[qs] = merged[:, -self.k :]
                yield qs[qi], r0 + ri, scores[qi, ri]

    def _improve(self, qs: np.ndarray, qi: np.ndarray, ri: np.ndarray, ranked: np.ndarray):
        """Move the best on by these scores; the rows that still reach them."""
        by = np.lexsort((-ranked, qi))
        qi, ri, ranked = qi[by], ri[by], ranked[by]
        met, first, row = np.unique(qi, return_index=True, return_inverse=True)
        place = np.arange(len(qi)) - first[row]
        top = place < self.k
        merged = np.full((len(met), 2 * self.k), -np.inf)
        merged[:, : self.k] = self.best[qs[met]]
        merged[row[top], self.k + place[top]] = ranked[top]
        merged.sort(axis=1)
        self.best[qs[met]] = merged[:, -self.k :]
        keep = ranked >= merged[row, self.k]
        return qi[keep], ri[keep]


def _hit_schema(store: DataFrame, queries: DataFrame, id_col: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField(id_col, store.schema[id_col].dataType),
        ]
    )


def _search(
    store: DataFrame, queries: DataFrame, k: int, carry: list[str], id_col: str, probes: bool
) -> DataFrame:
    """Candidates by a scan of ids and vectors alone, the exact top k per query, then the ``carry`` columns.

    With ``probes`` the store has a column ``cell`` and the queries an array ``cells``; a query then only meets
    rows of its cells. Query tables of at most ``MAX_QUERY_VALUES`` values are sent whole to the scan; larger
    ones are cut into blocks of that bound, one scan of the store each, one after the other (the store is never
    copied). The ``carry`` columns are joined to the ``k`` hits per query afterwards, so the scan reads no text;
    ``id_col`` must be a key of the store for that.
    """
    kept = [id_col, "embedding", *(["cell"] if probes else [])]
    scanned = store.where(F.col("embedding").isNotNull()).select(*kept)
    queries = queries.select("query_id", "embedding", *(["cells"] if probes else [])).where(F.col("embedding").isNotNull())

    head = queries.select(F.size("embedding").alias("d")).head()
    dim = max(1, head["d"] if head else 1)
    limit = max(1, MAX_QUERY_VALUES // dim)
    few = at_most(queries, limit)
    if few:
        hits = rank_hits(_scan(scanned, queries, k, id_col, probes)[0], k, ties=id_col)
    else:
        hits = _search_blocks(scanned, queries, k, id_col, probes, limit)
    carry = [c for c in carry if c != id_col]
    extra = store.select(id_col, *carry)
    if few:
        # At most k rows per query, whose number is bounded above.
        return extra.join(F.broadcast(hits), id_col)
    joined = salted_join(hits, extra, id_col, salt_by="query_id")
    return joined.select(id_col, *carry, *[c for c in hits.columns if c != id_col])


def _search_blocks(
    store: DataFrame, queries: DataFrame, k: int, id_col: str, probes: bool, limit: int
) -> DataFrame:
    """Hits of more than ``limit`` queries, block after block: each block's top k is written before the next is read.

    The queries are written once, in files of less than a block, so the driver and the tasks hold one block at a
    time and no plan holds two. Blocks are whole files, whatever the ids of their rows; the hits of an id that
    several rows share are ranked over all blocks at the end.
    """
    spark = store.sparkSession
    path, found = new_dir(spark, "queries"), new_dir(spark, "hits")
    queries.write.option("maxRecordsPerFile", max(1, limit // 4)).parquet(path)
    files = spark.read.schema(queries.schema).parquet(path).groupBy("_metadata.file_name").count().collect()
    blocks, free = [], 0
    for name, rows in sorted(files, key=lambda f: (-f[1], f[0])):
        if rows > free:
            blocks.append([])
            free = limit
        blocks[-1].append(f"{path}/{name}")
        free -= rows
    with shuffles_removed(spark):
        for block in blocks:
            scored, shared = _scan(store, spark.read.schema(queries.schema).parquet(*block), k, id_col, probes)
            rank_hits(scored, k, ties=id_col).drop("rank").write.mode("append").parquet(found)
            shared.destroy()
    hits = spark.read.schema(_hit_schema(store, queries, id_col)).parquet(found)
    return written(rank_hits(hits, k, ties=id_col), "hits")


def _scan(store: DataFrame, queries: DataFrame, k: int, id_col: str, probes: bool) -> tuple[DataFrame, Broadcast]:
    """Candidates, and the broadcast that they are read with.

    The store stays where it is; the matrix of the queries, whose size the caller bounds, goes to it.
    """
    spark = store.sparkSession
    table = queries.toArrow()
    query_ids = table.column("query_id").combine_chunks()
    lists: dict[int, list[int]] = {}
    if probes:
        for i, cells in enumerate(table.column("cells").to_pylist()):
            for cell in cells:
                lists.setdefault(cell, []).append(i)
        # Only probed cells are read; a store partitioned by cell skips the rest.
        store = store.where(F.col("cell").isin(sorted(lists)))
    shared = spark.sparkContext.broadcast((_matrix(table.column("embedding")), query_ids, lists))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, ids, by_cell = shared.value
        pruner = _Pruner(len(matrix), k)
        everyone = np.arange(len(matrix))
        for batch in batches:
            if batch.num_rows == 0 or len(matrix) == 0:
                continue
            if probes:
                cells = batch.column("cell").to_numpy(zero_copy_only=False)
                parts = [(np.flatnonzero(cells == c), np.asarray(by_cell[c])) for c in np.unique(cells)]
            else:
                parts = [(None, everyone)]
            for rows, asked in parts:
                part = batch if rows is None else batch.take(pa.array(rows))
                vectors = _matrix(part.column("embedding"))
                for q, r, s in pruner.scan(matrix, asked, vectors):
                    if len(r):
                        columns = [ids.take(pa.array(q)), pa.array(s, pa.float64()), part.column(id_col).take(pa.array(r))]
                        yield pa.RecordBatch.from_arrays(columns, schema=_arrow_schema)

    schema = _hit_schema(store, queries, id_col)
    _arrow_schema = to_arrow_schema(schema)
    return store.mapInArrow(scan, schema), shared


def vector_topk(
    store: DataFrame,
    queries: DataFrame,
    k: int,
    carry: tuple[str, ...] = ("text", "metadata_json"),
    id_col: str = "chunk_id",
) -> DataFrame:
    """Exact cosine top ``k`` of every query over all stored vectors.

    ``queries`` is ``(query_id, embedding)``; the result has ``query_id``,
    ``rank``, ``score``, the id and the ``carry`` columns of the store.
    """
    return _search(store, queries, k, list(dict.fromkeys([id_col, *carry])), id_col, probes=False)


# --- approximate search ---------------------------------------------------


def _unit(df: DataFrame) -> DataFrame:
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = F.transform("embedding", lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))
    return df.withColumn("_unit", array_to_vector(unit))


def train_cells(store: DataFrame, n_cells: int, seed: int = 7, max_iter: int = 8) -> KMeansModel:
    """Cell centres of the stored vectors, by distributed k-means."""
    data = _unit(store.where(F.col("embedding").isNotNull()).select("embedding"))
    return KMeans(k=n_cells, seed=seed, maxIter=max_iter, featuresCol="_unit", predictionCol="cell").fit(data)


def assign_cells(store: DataFrame, model: KMeansModel) -> DataFrame:
    """The store with each vector's cell; write it partitioned by ``cell`` to keep it."""
    return model.transform(_unit(store.where(F.col("embedding").isNotNull()))).drop("_unit")


def probe_cells(queries: DataFrame, model: KMeansModel, n_probe: int) -> DataFrame:
    """Queries with the ``n_probe`` nearest cells."""
    centres = np.stack(model.clusterCenters())
    near = min(n_probe, len(centres))

    @F.pandas_udf("array<int>")
    def cells(vectors):
        import pandas as pd

        m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
        lengths = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, lengths, out=np.zeros_like(m), where=lengths > 0)
        distance = (centres**2).sum(axis=1)[None, :] - 2 * m @ centres.T
        return pd.Series(list(np.argsort(distance, axis=1, kind="stable")[:, :near].astype(np.int32)))

    return queries.withColumn("cells", cells("embedding"))


def ann_topk(
    store: DataFrame,
    queries: DataFrame,
    k: int,
    n_cells: int = 16,
    n_probe: int = 4,
    model: KMeansModel | None = None,
    carry: tuple[str, ...] = ("text", "metadata_json"),
    id_col: str = "chunk_id",
) -> DataFrame:
    """Approximate top ``k``: exact scores, but only in each query's nearest cells.

    ``store`` may already have its ``cell`` column when a ``model`` is given.
    """
    if model is None:
        model = train_cells(store, n_cells)
    if "cell" not in store.columns:
        store = assign_cells(store, model)
    asked = probe_cells(queries, model, n_probe)
    return _search(store, asked, k, list(dict.fromkeys([id_col, *carry])), id_col, probes=True)


def recall(found: DataFrame, exact: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Share of the exact hits that the approximate search also found."""
    got = found.select("query_id", id_col).withColumn("_got", F.lit(1))
    return exact.join(got, ["query_id", id_col], "left").agg(
        F.avg(F.coalesce(F.col("_got"), F.lit(0))).alias("recall")
    )


# How each backend turns its stored distance or score into a
# cosine similarity.
BACKEND_SCORES = {
    "pgvector": "distance",
    "chroma": "distance",
    "weaviate": "distance",
    "mongodb": "half",
    "duckdb": "plain",
    "milvus": "plain",
    "qdrant": "plain",
    "pinecone": "plain",
}


def score_normalize(hits: DataFrame, backend: str = "backend", raw: str = "raw", out: str = "score") -> DataFrame:
    """Similarity in [-1, 1] from a backend's own number; NULL counts as 0.

    ``distance`` is one minus the similarity, ``half`` is (1 + similarity)/2.
    """
    kinds = {kind: [b for b, f in BACKEND_SCORES.items() if f == kind] for kind in ("distance", "half", "plain")}
    value = (
        F.when(F.col(backend).isin(kinds["distance"]), 1.0 - F.col(raw))
        .when(F.col(backend).isin(kinds["half"]), 2.0 * F.col(raw) - 1.0)
        .when(F.col(backend).isin(kinds["plain"]), F.col(raw))
    )
    return hits.withColumn(out, F.when(F.col(raw).isNull(), F.lit(0.0)).otherwise(value))
