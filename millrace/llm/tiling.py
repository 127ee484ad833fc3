"""Benchmark decontamination by greedy string tiling with running Karp-Rabin."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import ship

TOKEN = re.compile(r"\w+")
LEAST = 5  # words of the shortest tile
COVERAGE = 0.5  # share of an item's words under tiles from which a document counts as contaminated
# Words of benchmark items that are held in a task at once: about 100 MB. A larger benchmark is met block by block.
BLOCK_WORDS = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)  # of the running hash; odd, so that powers never vanish


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits; punctuation and blanks don't count."""
    return TOKEN.findall((text or "").lower())


def running_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``length`` words, modulo 2^64."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    for k in range(length):
        out = out * BASE + mixed[k : k + n]
    return out


def greedy_tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (document start, item start, words): the longest match of unmarked words, marked, until none is left.

    Matches of equal length go by their start in the item, then in the document. Words below 0 match nothing.
    Window hashes are found anew for each length that is tried; a hash that agrees is confirmed word by word.
    """
    free_doc, free_item = doc >= 0, np.ones(len(item), bool)
    tiles: list[tuple[int, int, int]] = []

    def matches(length: int) -> Iterator[tuple[int, int]]:
        mine, theirs = running_hashes(item, length), running_hashes(doc, length)
        if not len(mine) or not len(theirs):
            return
        whole_item = np.convolve(free_item, np.ones(length, int), "valid") == length
        whole_doc = np.convolve(free_doc, np.ones(length, int), "valid") == length
        at_doc = np.flatnonzero(whole_doc)
        order = at_doc[np.argsort(theirs[at_doc], kind="stable")]
        hashes = theirs[order]
        for i in np.flatnonzero(whole_item):
            lo, hi = np.searchsorted(hashes, mine[i]), np.searchsorted(hashes, mine[i], "right")
            for j in order[lo:hi]:
                if np.array_equal(item[i : i + length], doc[j : j + length]):
                    yield int(i), int(j)

    def longest() -> int:
        """Longest length with a match of free words: any match holds matches of all shorter lengths."""
        low, high = least - 1, min(len(item), len(doc))
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if next(matches(middle), None) else (low, middle - 1)
        return low

    while (length := longest()) >= least:
        for i, j in list(matches(length)):
            if free_item[i : i + length].all() and free_doc[j : j + length].all():
                free_item[i : i + length] = False
                free_doc[j : j + length] = False
                tiles.append((j, i, length))
    return tiles


class _Block:
    """Benchmark items with the hashes of their seeds, as one task holds them."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int):
        self.vocabulary: dict[str, int] = {}
        self.items = []
        seeds: dict[int, list[tuple[np.ndarray, int]]] = {}
        for key, words in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64)
            length = min(least, len(ids))
            self.items.append((key, ids))
            if length:
                seeds.setdefault(length, []).append((np.unique(running_hashes(ids, length)), len(self.items) - 1))
        self.seeds = []
        for length, found in seeds.items():
            hashes = np.concatenate([h for h, _ in found])
            owners = np.concatenate([np.full(len(h), i) for h, i in found])
            order = np.argsort(hashes, kind="stable")
            self.seeds.append((length, hashes[order], owners[order]))

    def candidates(self, doc: np.ndarray) -> set[int]:
        """Items that share a seed with a document."""
        out: set[int] = set()
        for length, hashes, owners in self.seeds:
            n = len(doc) - length + 1
            if n <= 0:
                continue
            known = np.flatnonzero(np.convolve(doc >= 0, np.ones(length, int), "valid") == length)
            if not len(known):
                continue
            found = np.unique(running_hashes(doc, length)[known])
            lo, hi = np.searchsorted(hashes, found), np.searchsorted(hashes, found, "right")
            for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True):
                out.update(owners[a:b].tolist())
        return out


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Items in blocks of at most ``block_words`` words (one item at least); the driver holds one block."""
    held, size = [], 0
    for row in benchmark.toLocalIterator():
        words = tokens(row["text"])
        if held and size + len(words) > block_words:
            yield held
            held, size = [], 0
        held.append((row["item_id"], words))
        size += len(words)
    if held:
        yield held


def _matches(block: _Block, text: str | None, least: int, coverage: float) -> Iterator[tuple[int, int, int, int]]:
    """(item, its words, words covered, tiles) of the items of a block that a text holds."""
    words = tokens(text)
    doc = np.fromiter((block.vocabulary.get(w, -1) for w in words), np.int64, len(words))
    for i in sorted(block.candidates(doc)):
        key, item = block.items[i]
        tiles = greedy_tiles(doc, item, min(least, len(item)))
        covered = sum(t[2] for t in tiles)
        if covered >= coverage * len(item):
            yield key, len(item), covered, len(tiles)


def tile_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    least: int = LEAST,
    coverage: float = COVERAGE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Documents that hold a share of at least ``coverage`` of an item's words, in any order of its pieces.

    Takes ``doc_id, text`` and ``item_id, text``; returns ``doc_id, item_id, item_words, covered_words, coverage,
    n_tiles``, one row for each pair. A document meets the items with which it shares a run of ``least`` words, by
    the hash of the run; for each, the longest common runs are marked one after the other, none overlapping
    another in document or item. An item of fewer words is met as one run.

    Items are held in the tasks block by block, each block of bounded size, and documents are read once per block
    and stay where they are: no shuffle, and no key gathers rows. Null or wordless texts match nothing; repeated
    rows give repeated pairs; null ids pass through; other columns are ignored; an empty table gives no pairs.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = "doc_id long, item_id long, item_words int, covered_words int, coverage double, n_tiles int"
    names = [part.split()[0] for part in schema.split(", ")]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text"))

    def against(sent):
        def run(batches):
            block = _Block(sent.value, least)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for key, size, covered, tiles in _matches(block, text, least, coverage):
                        rows.append((doc_id, key, size, covered, covered / size, tiles))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        return run

    found = [docs.mapInArrow(against(spark.sparkContext.broadcast(block)), schema) for block in _blocks(items, block_words)]
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    least: int = LEAST,
    coverage: float = COVERAGE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` without the rows that ``tile_matches`` pairs with any item; all columns, and no row moves."""
    spark = docs.sparkSession
    ship(spark)
    at = docs.columns.index("text")

    def without(sent):
        def run(batches):
            block = _Block(sent.value, least)
            for batch in batches:
                clean = [next(_matches(block, t, least, coverage), None) is None for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text"))
    for block in _blocks(items, block_words):
        docs = docs.mapInArrow(without(spark.sparkContext.broadcast(block)), docs.schema)
    return docs
