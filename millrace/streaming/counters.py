"""Row counters and freshness of batch and streaming jobs."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def stage_counters(df: DataFrame, name: str, seen_at: str | None = None) -> tuple[DataFrame, Observation]:
    """``df`` with a row counter that is filled as a side result of its action.

    With ``seen_at`` (epoch seconds) the newest value is kept too, from which
    the freshness lag follows.
    """
    watch = Observation(name)
    metrics = [F.count(F.lit(1)).alias("rows")]
    if seen_at:
        metrics.append(F.max(seen_at).alias("newest"))
        metrics.append((F.unix_seconds(F.max(F.current_timestamp())) - F.max(seen_at)).alias("lag_seconds"))
    return df.observe(watch, *metrics), watch


def stream_counters(df: DataFrame, name: str) -> DataFrame:
    """A streaming frame whose per-batch row count reaches ``ProgressLog``."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))


class ProgressLog(StreamingQueryListener):
    """Collects per-batch counters of streaming queries on the driver (numbers only)."""

    def __init__(self):
        self.batches, self._lock = [], threading.Lock()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        progress = event.progress
        row = {
            "batch_id": progress.batchId,
            "input_rows": progress.numInputRows,
            "duration_ms": progress.batchDuration,
            "observed": {k: v.asDict() for k, v in (progress.observedMetrics or {}).items()},
        }
        with self._lock:
            self.batches.append(row)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
