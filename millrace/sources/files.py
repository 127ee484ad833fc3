"""File sources: list objects as rows first, fetch bytes late."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.functions import text as tx

LISTING_COLUMNS = ["source_id", "path", "name", "suffix", "length", "mtime", "seen_at"]


def source_listing(
    spark: SparkSession,
    root: str | list[str],
    glob: str | list[str] | None = None,
    recursive: bool = True,
    source_id: str = "fs",
    max_bytes: int | None = None,
) -> DataFrame:
    """One row per object below ``root``; file contents are never read.

    ``glob`` (one pattern or several) is matched against the base name.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        # A file may vanish between the listing and its row.
        .option("ignoreMissingFiles", "true")
        .load(root)
        .select(
            F.lit(source_id).alias("source_id"),
            "path",
            tx.base_name(F.col("path")).alias("name"),
            tx.suffix(F.col("path")).alias("suffix"),
            "length",
            F.unix_micros("modificationTime").alias("mtime"),
            F.unix_seconds(F.current_timestamp()).alias("seen_at"),
        )
    )
    if glob:
        files = glob_filter(files, "name", glob)
    if max_bytes is not None:
        files = size_limit_filter(files, max_bytes)
    return files


def glob_filter(df: DataFrame, column: str, patterns: list[str] | str) -> DataFrame:
    """Rows whose ``column`` matches any shell pattern."""
    return df.where(tx.matches_any(F.col(column), patterns))


def size_limit_filter(df: DataFrame, max_bytes: int, column: str = "length") -> DataFrame:
    return df.where(F.col(column) <= F.lit(max_bytes))


def union_sources(*sources: DataFrame) -> DataFrame:
    """Concatenate sources by column name; each is numbered by ``source_no``."""
    out = None
    for number, df in enumerate(sources):
        df = df.withColumn("source_no", F.lit(number))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


# A cell of a row holds at most this many bytes.
MAX_CELL = (1 << 31) - 1024


def object_uri(path: str) -> str:
    """A listed path, which is not escaped, as a URI: blanks, ``%``, ``#`` and ``?`` are parts of names."""
    scheme, mark, rest = path.partition(":")
    if not mark or "/" in scheme:
        scheme, rest = "file", path
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    rest = rest if rest.startswith("//") else "//" + rest
    return f"{scheme}:{quote(rest, safe='/:@')}"


def _read_objects(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        named = [c for c in ("path", "length") if c in batch.schema.names]
        for i, row in enumerate(batch.select(named).to_pylist()):
            content, error = pa.nulls(1, pa.binary()), None
            try:
                if row.get("length") is not None and row["length"] > MAX_CELL:
                    raise ValueError(f"{row['length']} bytes are too many for one cell")
                system, path = fs.FileSystem.from_uri(object_uri(row["path"]))
                content = _cell(_whole(system, path))
            except Exception as exc:  # a vanished object must not stop the job
                error = f"{type(exc).__name__}: {exc}"
            # One object per output batch keeps a task's memory at one object.
            yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, content, pa.array([error], pa.string())], schema=schema)


def _whole(system, path: str) -> pa.Buffer:
    """An object's bytes in one buffer; a stream unpacks what is packed by its suffix."""
    try:
        pa.Codec.detect(path)
    except (TypeError, ValueError):  # no such suffix
        with system.open_input_file(path) as file:
            return file.read_buffer()
    with system.open_input_stream(path) as stream:
        return pa.py_buffer(stream.read())


def _cell(content: pa.Buffer) -> pa.Array:
    """One binary value on the bytes as they were read, without a copy."""
    if content.size > MAX_CELL:
        raise ValueError(f"{content.size} bytes are too many for one cell")
    offsets = pa.py_buffer(np.array([0, content.size], dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), 1, [None, offsets, content])


def fetch_changed(changed: DataFrame) -> DataFrame:
    """Read the bytes of the listed objects inside the tasks.

    Only listed rows are opened, contents are never shuffled, and a failed
    read leaves ``content`` NULL with the reason in ``fetch_error``.
    """
    schema = T.StructType(list(changed.schema.fields)).add("content", "binary").add("fetch_error", "string")
    arrow_schema = to_arrow_schema(schema)
    return changed.mapInArrow(lambda batches: _read_objects(batches, arrow_schema), schema)


def fetch_errors(fetched: DataFrame) -> DataFrame:
    """The rows whose bytes could not be read, for the error table."""
    return fetched.where(F.col("fetch_error").isNotNull()).select("source_id", "path", "fetch_error")
