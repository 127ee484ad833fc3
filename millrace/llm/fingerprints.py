"""Similarity digests of texts from improbable features, kept in chained Bloom filters.

A text's UTF-8 bytes are read in windows of :data:`WINDOW` bytes. Each window's byte entropy (a whole number
from 0 to 1000) is looked up in a ranking of all entropy values by how rarely they occur in the corpus, counted
over every window of every document. In each run of :data:`NEIGHBOURHOOD` neighbouring windows the rarest one
(leftmost on ties) wins, and a window that wins :data:`POPULAR` runs or more is a feature; windows of very low
entropy (long repeats) never are. Features are hashed into Bloom filters of :data:`FILTER_BITS` bits with
:data:`HASHES` bits each, :data:`PER_FILTER` features to a filter, filters chained in text order. Two digests
are compared filter by filter: the bits two filters share, less those that chance would give them, over the
most they could share; each filter of the shorter digest takes its best match, and the mean is the likeness.

Everything a feature depends on lies within a few hundred bytes of it, so an edit changes only the filters
near it, and equal texts have equal digests.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import ship, written

WINDOW, NEIGHBOURHOOD, POPULAR = 64, 64, 16
LEVELS, LEAST_LEVEL = 1000, 150
FILTER_BITS, HASHES, PER_FILTER = 2048, 5, 160
_SCALE = 1 << 16
_C_LOG_C = np.array([round(c * math.log2(c) * _SCALE) if c else 0 for c in range(WINDOW + 1)], dtype=np.int64)
_FULL = WINDOW * round(math.log2(WINDOW)) * _SCALE
_UNRANKED = 1 << 40
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.int64)


def entropy_levels(data: bytes) -> np.ndarray:
    """Entropy of every window of ``WINDOW`` bytes, as whole levels 0 .. 1000 (one per start; none if shorter).

    The sum of ``c log c`` over byte counts is carried from window to window in whole numbers, so a window has
    the same level wherever it stands.
    """
    x = np.frombuffer(data, dtype=np.uint8)
    n = len(x)
    m = n - WINDOW + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    first = int(_C_LOG_C[np.bincount(x[:WINDOW], minlength=256)].sum())
    if m == 1:
        sums = np.array([first], dtype=np.int64)
    else:
        # Positions grouped by byte (a radix sort) and ascending inside a group; the needles below come in
        # ascending order too, so each search is one pass.
        order = np.argsort(x, kind="stable")
        keys = x[order].astype(np.int64) * (n + 2 * WINDOW) + order
        rank = np.arange(n)
        ahead, behind = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        ahead[order] = np.searchsorted(keys, keys + WINDOW) - rank  # same byte in [p, p + WINDOW)
        behind[order] = rank - np.searchsorted(keys, keys - (WINDOW - 1))  # same byte in (p - WINDOW, p)
        leaving = ahead[: m - 1]
        coming = behind[WINDOW:]
        steps = _C_LOG_C[leaving - 1] - _C_LOG_C[leaving] + _C_LOG_C[coming + 1] - _C_LOG_C[coming]
        sums = np.concatenate([[first], first + np.cumsum(steps)])
    return np.clip((LEVELS * (_FULL - sums)) // _FULL, 0, LEVELS)


def level_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``level, n``: how many windows of all texts have each entropy level (one partial count per task)."""

    def run(batches):
        total = np.zeros(LEVELS + 1, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total += np.bincount(entropy_levels((t or "").encode()), minlength=LEVELS + 1)
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["level", "n"])

    ship(docs.sparkSession)
    counts = docs.select(F.col(text).cast("string")).mapInArrow(run, "level long, n long")
    return counts.groupBy("level").agg(F.sum("n").alias("n"))


def rarity_ranks(counts: DataFrame) -> list[int]:
    """Rank of each level, rarest first (ties: lower level); levels under ``LEAST_LEVEL`` are never features.

    The table has 1001 entries whatever the corpus, so it is collected and sent with the code.
    """
    seen = {r["level"]: r["n"] for r in counts.collect()}
    usable = sorted((seen.get(level, 0), level) for level in range(LEAST_LEVEL, LEVELS + 1))
    ranks = [_UNRANKED] * (LEVELS + 1)
    for rank, (_, level) in enumerate(usable):
        ranks[level] = rank
    return ranks


def _sliding_first_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of every run of ``width`` neighbours (van Herk / Gil-Werman: blocks, prefix and suffix minima)."""
    n = len(keys)
    pad = (-n) % width
    blocks = np.concatenate([keys, np.full(pad, np.iinfo(np.int64).max)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def features(data: bytes, ranks: np.ndarray) -> np.ndarray:
    """Starts of the feature windows, in text order."""
    levels = entropy_levels(data)
    m = len(levels)
    if m == 0:
        return np.zeros(0, dtype=np.int64)
    r = ranks[levels]
    if m < NEIGHBOURHOOD:
        best = int(np.argmin(r))
        return np.array([best] if r[best] < _UNRANKED else [], dtype=np.int64)
    # Rank above, place below: the least key is the rarest window, the leftmost of equals.
    keys = (np.minimum(r, LEVELS + 1) << 44) | np.arange(m, dtype=np.int64)
    winners = _sliding_first_min(keys, NEIGHBOURHOOD) & ((1 << 44) - 1)
    wins = np.bincount(winners, minlength=m)
    return np.nonzero((wins >= POPULAR) & (r < _UNRANKED))[0]


_MIX = np.random.default_rng(20240611).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)


_BIT = [1 << p for p in range(FILTER_BITS)]
_SHIFTS = np.array([11 * j for j in range(HASHES)], dtype=np.uint64)


def _feature_places(data: bytes, starts: np.ndarray) -> list[list[int]]:
    """The filter bits of each feature window: a random linear form of its bytes, mixed, cut in 11-bit parts."""
    if not len(starts):
        return []
    x = np.frombuffer(data, dtype=np.uint8)
    windows = x[starts[:, None] + np.arange(WINDOW)].astype(np.uint64)
    h = (windows * _MIX).sum(axis=1, dtype=np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return ((h[:, None] >> _SHIFTS) & np.uint64(FILTER_BITS - 1)).tolist()


def digest(text: str | None, ranks: np.ndarray) -> str:
    """The digest of a text: filters as ``<features, 2 hex><FILTER_BITS / 4 hex>``, comma-joined; empty if none.

    A feature whose bits are all set already (a repeat) is not counted again.
    """
    data = (text or "").encode()
    filters, bits, n = [], 0, 0
    for a, b, c, d, e in _feature_places(data, features(data, ranks)):
        mask = _BIT[a] | _BIT[b] | _BIT[c] | _BIT[d] | _BIT[e]
        if bits & mask == mask:
            continue
        bits |= mask
        n += 1
        if n == PER_FILTER:
            filters.append(f"{n:02x}{bits.to_bytes(FILTER_BITS // 8, 'little').hex()}")
            bits, n = 0, 0
    if n:
        filters.append(f"{n:02x}{bits.to_bytes(FILTER_BITS // 8, 'little').hex()}")
    return ",".join(filters)


def _filters(d: str) -> np.ndarray:
    return np.array([np.frombuffer(bytes.fromhex(f[2:]), dtype=np.uint8) for f in d.split(",")])


def likeness(a: str | None, b: str | None) -> float:
    """From 0 to 1: 1 for equal digests (two empty ones too), 0 when only one is empty.

    Filters of the digest with fewer filters (``a`` on ties) are each matched with the best filter of the other:
    ``(shared - expected) / (min(bits) - expected)``, clipped to 0 .. 1, ``expected`` the bits two random filters
    of these weights share; the mean over its filters is the likeness.
    """
    a, b = a or "", b or ""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    fa, fb = _filters(a), _filters(b)
    if len(fb) < len(fa):
        fa, fb = fb, fa
    wa, wb = _POPCOUNT[fa].sum(axis=1), _POPCOUNT[fb].sum(axis=1)
    shared = _POPCOUNT[fa[:, None, :] & fb[None, :, :]].sum(axis=2)
    expected = wa[:, None] * wb[None, :] / FILTER_BITS
    most = np.minimum(wa[:, None], wb[None, :])
    room = most - expected
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(room > 0, (shared - expected) / room, 0.0)
    return float(np.clip(score, 0.0, 1.0).max(axis=1).mean())


def edited(text: str, after: str) -> str:
    """The last ``len(text) // 4`` code points of ``text`` replaced by as many (or all) first ones of ``after``."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id, text, fp, nxt, nxt_fp, ranks):
    changed = edited(text, nxt)
    efp = digest(changed, ranks)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(),
        "fingerprint": fp,
        "edited_fingerprint": efp,
        "near_edited": likeness(fp, efp),
        "near_next": likeness(fp, nxt_fp),
    }


def fingerprint_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Digests of every text and of its edited text, and their likeness.

    The next document of a row is the row after it in ascending ``doc_id`` (nulls first; equal ids by text), the
    last row's next is the first. A text's edited text has its last ``n // 4`` code points replaced by the first
    as many (or all) of the next document's. Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next`` (likeness of the digest with the edited text's and with the next
    document's). Null texts are empty; texts under ``WINDOW`` bytes have empty digests; repeated rows are rows of
    their own (each other's next); other columns are not kept; an empty table gives no rows.

    One range-partitioned sort puts rows in order; each task walks its rows in order and finishes every row but
    its last, whose next is the first row of a later task. Those ends (two rows per task at most) are paired by a
    join on task numbers, so no text goes to the driver and the digests are taken once per text.
    """
    spark = docs.sparkSession
    ship(spark)
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ranks = np.array(rarity_ranks(level_counts(given)), dtype=np.int64)
    ordered = given.orderBy(F.col("doc_id").asc_nulls_first(), "text").select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def run(batches):
        prev, done, ends = None, [], []
        for batch in batches:
            for part, did, t in zip(*(c.to_pylist() for c in batch.columns)):
                fp = digest(t, ranks)
                if prev is None:
                    ends.append({"part": part, "side": "head", "doc_id": did, "text": t, "fingerprint": fp})
                else:
                    done.append(_row(prev[1], prev[2], prev[3], t, fp, ranks))
                    if len(done) >= 256:
                        yield _batch(done, [])
                        done = []
                prev = (part, did, t, fp)
        if prev is not None:
            ends.append({"part": prev[0], "side": "tail", "doc_id": prev[1], "text": prev[2], "fingerprint": prev[3]})
        yield _batch(done, ends)

    end_type = "struct<part:long, side:string, doc_id:long, text:string, fingerprint:string>"
    stepped = written(ordered.mapInArrow(run, f"{OUT}, end {end_type}"), "fingerprints")
    complete = stepped.where(F.col("end").isNull()).drop("end")
    ends = stepped.where(F.col("end").isNotNull()).select("end.*")
    heads = ends.where(F.col("side") == "head")
    tails = ends.where(F.col("side") == "tail")
    # Each tail meets the head of the next task that has rows, the last tail the first head. The table of task
    # numbers has two rows per task at most and no text.
    parts = ends.select("part", F.when(F.col("side") == "head", F.col("part")).alias("head_part"), "side")
    later = Window.orderBy("part", "side").rowsBetween(1, Window.unboundedFollowing)
    pairing = parts.select(
        "part", "side",
        F.coalesce(F.first("head_part", ignorenulls=True).over(later), F.min("head_part").over(Window.partitionBy())).alias("h_part"),
    ).where(F.col("side") == "tail").select("part", "h_part")
    paired = tails.join(pairing, "part").join(
        heads.select(F.col("part").alias("h_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fp")), "h_part"
    )

    def finish(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pylist([_row(r["doc_id"], r["text"], r["fingerprint"], r["next_text"], r["next_fp"], ranks) for r in rows], schema=_SCHEMA)

    last = paired.select("doc_id", "text", "fingerprint", "next_text", "next_fp").mapInArrow(finish, OUT)
    return complete.unionByName(last)


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)
_END = pa.struct([("part", pa.int64()), ("side", pa.string()), ("doc_id", pa.int64()), ("text", pa.string()), ("fingerprint", pa.string())])


def _batch(done: list[dict], ends: list[dict]) -> pa.RecordBatch:
    rows = [dict(r, end=None) for r in done] + [
        {**{f.name: None for f in _SCHEMA}, "end": e} for e in ends
    ]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([*_SCHEMA, ("end", _END)]))
