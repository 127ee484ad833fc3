"""Language identification by rank-order profiles of letter n-grams."""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import with_text_columns
from millrace.session import ship

RANKS = 400  # n-grams in a profile
MAX_LANGUAGES = 2_000  # so a model has at most RANKS times as many rows, which bounds what the driver and tasks hold
UNKNOWN = "und"
PIECE = 1 << 20  # characters of a long text that are counted at once
HELD = 1 << 21  # distinct n-grams that a task holds before it passes them on
EDGE = 1  # stands for the edge of a word; no letter has this code point


@functools.cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _pieces(text: str):
    """A text in pieces that end at a blank where there is one."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE else max(text.rfind(" ", at, at + PIECE), at) + 1
        end = at + PIECE if end == at + 1 and len(text) - at > PIECE else end
        yield text[at:end]
        at = end


def _sum(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(codes, return_inverse=True)
    return found, np.bincount(where, counts, len(found)).astype(np.int64)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the one- to three-letter n-grams of all words; a word's edges count as a letter."""
    found = []
    for piece in _pieces((text or "").lower()):
        c = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letter = _is_letter()[c]
        if not letter.any():
            continue
        c = np.where(letter, c, EDGE)
        c = np.concatenate(([EDGE], c[letter | np.concatenate(([False], letter[:-1]))], [EDGE]))
        inner = c != EDGE
        pairs, triples = (c[:-1] << 21) | c[1:], (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
        codes = np.concatenate((c[inner], pairs[inner[:-1] | inner[1:]], triples[inner[1:-1]]))
        found.append(np.unique(codes, return_counts=True))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return found[0] if len(found) == 1 else _sum(*map(np.concatenate, zip(*found, strict=True)))


def _top(codes: np.ndarray, counts: np.ndarray, ranks: int) -> np.ndarray:
    """The most frequent codes, best first; equal counts by code."""
    return codes[np.lexsort((codes, -counts))[:ranks]]


def fit_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", ranks: int = RANKS) -> dict[str, list[int]]:
    """For each language the ``ranks`` most frequent n-grams of all its texts, best first.

    Rows with a null language are left out; null or letterless texts add nothing. Counts are summed in the tasks
    before the shuffle, so a language or text that owns most rows is a row per n-gram and task. The profiles, at
    most ``ranks`` rows for each of at most ``MAX_LANGUAGES`` languages, come to the driver.
    """

    def count(batches):
        held: dict[str, list] = {}
        size = 0

        def given():
            for name, parts in held.items():
                codes, counts = _sum(*map(np.concatenate, zip(*parts, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes)), pa.array(codes), pa.array(counts)], names=["lang", "gram", "n"])

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, counts = ngram_counts(value)
                if len(codes):
                    held.setdefault(name, []).append((codes, counts))
                    size += len(codes)
                if size > HELD:
                    held = {k: [_sum(*map(np.concatenate, zip(*v, strict=True)))] for k, v in held.items()}
                    size = sum(len(v[0][0]) for v in held.values())
                    if size > HELD / 2:
                        yield from given()
                        held, size = {}, 0
        yield from given()

    ship(labelled.sparkSession)
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null")
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= ranks).limit(ranks * MAX_LANGUAGES + 1).collect()
    profiles: dict[str, list] = {}
    for row in best:
        profiles.setdefault(row["lang"], []).append((row["rank"], row["gram"]))
    if len(profiles) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {name: [g for _, g in sorted(rows)] for name, rows in sorted(profiles.items())}


def identify(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", ranks: int = RANKS, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``.

    A text's ``ranks`` most frequent n-grams are compared with each profile: an n-gram counts as many places as it
    is out of place, ``ranks`` if the profile lacks it. The language of the least sum wins, the first by name on
    a tie. ``score`` is 1 less the sum's share of its maximum.

    Null, empty and letterless texts, and all texts where no language was learned, are ``und`` with score 0. Rows
    are judged one by one, whole; repeated rows, null ids and extra columns pass through.
    """
    names = sorted(profiles)
    sorted_codes, places = [], []
    for name in names:
        codes = np.array(profiles[name], np.int64)
        order = np.argsort(codes)
        sorted_codes.append(codes[order])
        places.append(order)

    def make():
        def one(value):
            top = _top(*ngram_counts(value), ranks)
            if not len(top) or not names:
                return UNKNOWN, 0.0
            at = np.arange(len(top))
            sums = []
            for codes, place in zip(sorted_codes, places, strict=True):
                i = np.minimum(np.searchsorted(codes, top), len(codes) - 1)
                sums.append(int(np.where(codes[i] == top, np.abs(place[i] - at), ranks).sum()))
            best = int(np.argmin(sums))
            return names[best], 1.0 - sums[best] / (ranks * len(top))

        return one

    added = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return with_text_columns(docs, text, make, added, keep_text)
