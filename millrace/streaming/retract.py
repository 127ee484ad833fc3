"""Keyed state per document: an edit emits its old chunks with -1, its new with +1."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUT = T.StructType(
    [
        T.StructField("doc_key", T.StringType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("diff", T.IntegerType()),
    ]
)


class _Retractor(StatefulProcessor):
    """State: the last sequence number and the live chunk ids of the document."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("live", "seq BIGINT, chunk_ids ARRAY<STRING>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for batch in rows:  # only the newest row is kept
            row = batch.loc[batch["seq"].idxmax()]
            if last is None or row["seq"] > last["seq"]:
                last = row
        seen, old = -1, []
        if self.state.exists():
            seen, old = self.state.get()
        if last is None or last["seq"] <= seen:
            return
        new = [] if last["op"] == "delete" else list(last["chunk_ids"])
        old = list(old)
        self.state.update((int(last["seq"]), new))
        before, after = set(old), set(new)
        moves = [(c, -1) for c in old if c not in after] + [(c, 1) for c in new if c not in before]
        if moves:
            ids, diffs = zip(*moves)
            yield pd.DataFrame({"doc_key": key[0], "chunk_id": ids, "diff": pd.array(diffs, dtype="int32")})

    def close(self) -> None:
        pass


def _newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the newest row per document of each batch (combine before the shuffle)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        order = pc.sort_indices(batch, sort_keys=[("doc_key", "ascending"), ("seq", "descending")])
        ordered = batch.take(order)
        keys = ordered.column("doc_key")
        first = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)) if len(keys) > 1 else pa.array([], pa.bool_())
        yield ordered.filter(pa.concat_arrays([pa.array([True]), first]))


def stream_retract(feed: DataFrame) -> DataFrame:
    """``(doc_key, seq, op, chunk_ids)`` to chunk changes ``(doc_key, chunk_id, diff)``.

    Works on streams; the state survives restarts in the checkpoint. Rows
    older than the state are ignored.
    """
    feed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    slim = feed.select(F.col("doc_key").cast("string").alias("doc_key"), "seq", "op", "chunk_ids")
    newest = slim.mapInArrow(_newest, slim.schema)
    return newest.groupBy("doc_key").transformWithStateInPandas(
        statefulProcessor=_Retractor(), outputStructType=OUT, outputMode="Append", timeMode="None"
    )
