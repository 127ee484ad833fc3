"""Mixing by iterative proportional fitting: token weights raked to several marginals at once."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD
from millrace.session import written

OTHER = "(other)"  # the class of values that a marginal doesn't name, nulls included
MAX_CELLS = 200_000  # cells that the driver fits; more are fitted as a table
SMALL = 1_000  # classes of an axis whose factors are broadcast
ROUNDS, CLOSE = 200, 1e-9
PATIENCE = 10  # rounds without a better fit after which a table is not fitted on
HOT_SHARE, SALTS = 1 / 256, 64  # cells with a larger share of the rows than this are joined apart

Goal = Mapping[str, float] | float  # shares by class, or the power of its tokens that each class's share follows


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def register_of(text: Column) -> Column:
    """A topic for texts that come without one: how the whole text is written."""
    value = F.coalesce(text, F.lit(""))
    size = F.length(value)
    share = lambda chars: F.regexp_count(value, F.lit(chars)) / size
    return (
        F.when(size == 0, "empty")
        .when(share("[0-9]") >= 0.02, "figures")
        .when(share(r"[|#*$%&<>{}=]") >= 0.01, "markup")
        .when(share(r"\n") >= 0.01, "lines")
        .otherwise("prose")
    )


@dataclass(frozen=True)
class Raked:
    """Cells in order of ``axes``: tokens they have, factor each token gets, share each marginal reaches."""

    axes: tuple[str, ...]
    cells: list[tuple[str, ...]]
    tokens: np.ndarray
    factor: np.ndarray
    error: float  # largest gap between a share reached and its target


def rake(cells: Sequence[tuple[str, ...]], tokens: np.ndarray, axes: Sequence[str], targets: Mapping[str, Goal]) -> Raked:
    """Factors by which each marginal of the tokens has its target shares.

    One marginal after the other is scaled to its target, until all hold. Targets of classes without tokens are
    left out and the others scaled up; classes without a target keep a factor of 0. Where marginals contradict each
    other the last one fitted holds and ``error`` tells by how much the others miss.
    """
    tokens = np.asarray(tokens, float)
    factor = np.where(tokens > 0, 1.0, 0.0)
    fits = []
    for i, axis in enumerate(axes):
        names = sorted({c[i] for c in cells})
        place = {n: k for k, n in enumerate(names)}
        at = np.array([place[c[i]] for c in cells], int) if len(cells) else np.empty(0, int)
        have, wanted = np.bincount(at, tokens, len(names)), targets[axis]
        goal = np.array([max(wanted.get(n, 0.0), 0.0) for n in names]) if isinstance(wanted, Mapping) else have**wanted
        goal[have <= 0] = 0
        fits.append((at, goal / goal.sum() if goal.sum() > 0 else goal, len(names)))
    error = 0.0
    for _ in range(ROUNDS):
        for at, goal, n in fits:
            have = np.bincount(at, tokens * factor, n)
            factor = factor * np.divide(goal, have, out=np.zeros(n), where=have > 0)[at]
        total = (tokens * factor).sum()
        if total <= 0:
            break
        error = max(float(np.abs(np.bincount(at, tokens * factor, n) / total - goal).max(initial=0.0)) for at, goal, n in fits)
        if error < CLOSE:
            break
    return Raked(tuple(axes), list(cells), tokens, factor, error)


def rake_table(cells: DataFrame, targets: Sequence[Goal]) -> tuple[DataFrame, float]:
    """``rake`` for any number of cells: ``cells`` that have tokens with ``_factor``, and the error.

    ``cells`` have a column ``_class_i`` for each target and their tokens ``_n``. They are written once; a step
    sums them by the classes of one axis and writes the factors of that axis, which end the lineage.
    """
    spark, n = cells.sparkSession, len(targets)
    cells = written(cells.where("_n > 0"), "cells")
    factors, small = [], []
    for i, wanted in enumerate(targets):
        have = cells.groupBy(f"_class_{i}").agg(F.sum("_n").alias("_have"))
        if isinstance(wanted, Mapping):
            table = spark.createDataFrame([(k, max(float(v), 0.0)) for k, v in wanted.items()], f"_class_{i} string, _goal double")
            have = have.join(table, f"_class_{i}", "left")
        else:
            have = have.withColumn("_goal", F.pow("_have", F.lit(float(wanted))))
        have = written(have.select(f"_class_{i}", F.coalesce("_goal", F.lit(0.0)).alias("_goal")), "goals")
        total, count = have.agg(F.sum("_goal"), F.count(F.lit(1))).first()
        factors.append(have.select(f"_class_{i}", (F.col("_goal") / (total or 1.0)).alias("_goal"), F.lit(1.0).alias("_factor")))
        small.append(count <= SMALL)

    def scaled(axes: Iterable[int]) -> DataFrame:
        out = cells.withColumn("_factor", F.lit(1.0))
        for j in axes:
            table = factors[j].select(f"_class_{j}", F.col("_factor").alias("_f"))
            out = out.join(F.broadcast(table) if small[j] else table, f"_class_{j}")
            out = out.withColumn("_factor", F.col("_factor") * F.col("_f")).drop("_f")
        return out

    best, since = math.inf, 0
    for _ in range(ROUNDS):
        gap = 0.0
        for i in range(n):
            have = scaled(j for j in range(n) if j != i).groupBy(f"_class_{i}").agg(F.sum(F.col("_n") * F.col("_factor")).alias("_have"))
            step = factors[i].join(have, f"_class_{i}", "left").select(
                f"_class_{i}",
                "_goal",
                F.when(F.col("_have") > 0, F.col("_goal") / F.col("_have")).otherwise(0.0).alias("_factor"),
                F.abs(F.col("_factor") * F.coalesce("_have", F.lit(0.0)) - F.col("_goal")).alias("_gap"),
            )
            step = written(step, "factors")
            gap = max(gap, step.agg(F.max("_gap")).first()[0] or 0.0)
            factors[i] = step.drop("_gap")
        best, since = (gap, 0) if gap < best else (best, since + 1)
        if gap < CLOSE or since >= PATIENCE:
            break
    fitted = written(scaled(range(n)), "fitted")
    total = fitted.agg(F.sum(F.col("_n") * F.col("_factor"))).first()[0] or 0.0
    error = 0.0
    for i in range(n if total > 0 else 0):
        have = fitted.groupBy(f"_class_{i}").agg((F.sum(F.col("_n") * F.col("_factor")) / total).alias("_have"))
        error = max(error, have.join(factors[i], f"_class_{i}").agg(F.max(F.abs(F.col("_have") - F.col("_goal")))).first()[0] or 0.0)
    return fitted, error


def rates(raked: Raked, share: float, most: float = math.inf) -> np.ndarray:
    """Expected copies of a document of each cell, so that ``share`` of all tokens come out.

    One scale for all cells, which leaves the shares as they were fitted. A finite ``most`` bounds the copies of a
    document; where that binds, the other cells make up for it as far as they can and the shares are missed.
    """
    goal = share * raked.tokens.sum()
    if most == math.inf:
        fitted = (raked.tokens * raked.factor).sum()
        return raked.factor * (goal / fitted) if fitted > 0 else raked.factor
    low, high = 0.0, 1.0
    reached = lambda scale: float((raked.tokens * np.minimum(raked.factor * scale, most)).sum())
    if raked.factor.max(initial=0.0) <= 0:
        return raked.factor
    full = most / raked.factor[raked.factor > 0].min()
    high = full
    if reached(full) <= goal:
        return np.minimum(raked.factor * full, most)
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if reached(middle) < goal else (low, middle)
    return np.minimum(raked.factor * high, most)


def classes(docs: DataFrame, targets: Mapping[str, Goal]) -> dict[str, Column]:
    """The class of a row on each axis: its value if the target names it or names none, else ``OTHER``."""

    def of(axis: str, goal: Goal) -> Column:
        if not isinstance(goal, Mapping):
            return F.coalesce(F.col(axis).cast("string"), F.lit(OTHER))
        return F.when(F.col(axis).isin(*goal), F.col(axis)).otherwise(F.lit(OTHER)) if goal else F.lit(OTHER)

    return {axis: of(axis, goal) for axis, goal in targets.items()}


def mix(
    docs: DataFrame,
    targets: Mapping[str, Goal],
    share: float = 0.5,
    seed: int = 0,
    id_column: str = "doc_id",
    tokens: str = "n_tokens",
    cells_of: DataFrame | None = None,
) -> DataFrame:
    """``docs`` with ``weight`` (expected copies) and ``n_copies`` (0 and up), so that tokens follow all ``targets``.

    ``targets`` gives for each axis, a string column, the shares of its values; values that it doesn't name, and
    nulls, share the target of ``OTHER`` (none: they are left out). A number in place of shares is a power: each
    value, and nulls together as ``OTHER``, gets a share in proportion to its tokens to that power, however many
    values there are. Tokens are summed by cell before the shuffle; up to ``MAX_CELLS`` cells that have rows are
    fitted on the driver, more as a table. A document gets the whole copies of its weight, and one more with the
    probability of the rest, drawn by a hash of ``seed`` and its id: the draw depends on nothing else, so repeated
    rows fall alike. Null ids draw by a hash of null. No number of copies is too many: a rare class with a large
    target is repeated as often as that takes. Where targets contradict each other a warning gives the largest gap
    left. ``cells_of`` may give the same rows in a form that is cheaper to sum. Null or negative token counts are 0.
    All rows come back, an empty table as an empty one; no row moves unless the cells are too many to broadcast.
    """
    axes = tuple(targets)
    named = {f"_class_{i}": c for i, c in enumerate(classes(docs, targets).values())} or {"_class_0": F.lit(OTHER)}
    counted = (docs if cells_of is None else cells_of).select(*(c.alias(n) for n, c in named.items()), F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0)).cast("bigint").alias("_n"))
    summed = counted.groupBy(*named).agg(F.sum("_n").alias("_n"))
    cells = summed.limit(MAX_CELLS + 1).collect()
    hot = None
    if len(cells) <= MAX_CELLS or not axes:
        cells.sort(key=lambda r: tuple(r)[:-1])
        raked = rake([tuple(r)[:-1] for r in cells], np.array([r["_n"] for r in cells], float), axes, targets)
        error, schema = raked.error, ", ".join([*(f"{n} string" for n in named), "weight double"])
        rows = [(*c, float(w)) for c, w in zip(raked.cells, rates(raked, share), strict=True)]
        table = F.broadcast(docs.sparkSession.createDataFrame(rows, schema))
    else:
        del cells
        fitted, error = rake_table(summed, list(targets.values()))
        total, reached = fitted.agg(F.sum("_n"), F.sum(F.col("_n") * F.col("_factor"))).first()
        table = fitted.select(*named, (F.col("_factor") * (share * total / reached if reached else 0.0)).alias("weight"))
        # Rows of the cells that own a large share of them, 1 / HOT_SHARE at most, find their weight without moving.
        large = counted.groupBy(*named).count().where(F.col("count") > HOT_SHARE * counted.count()).drop("count")
        hot = written(large.join(table, list(named)).withColumnRenamed("weight", "_hot"), "hot")
    if error >= CLOSE:
        warnings.warn(f"targets contradict each other: a share misses its target by {error:.3g}", stacklevel=2)

    names = [c for c in docs.columns if c not in ("weight", "n_copies")]
    out = docs.select(*names).withColumns(named)
    if hot is None:
        out = out.join(table, list(named), "left")
    else:
        out = out.join(F.broadcast(hot), list(named), "left")
        salt = F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(id_column), F.lit(SALTS)).cast("int") + 1)
        out = out.withColumn("_salt", salt).join(table.withColumn("_salt", F.lit(0)), [*named, "_salt"], "left")
        out = out.withColumn("weight", F.coalesce("_hot", "weight"))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_column)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    weight = F.coalesce("weight", F.lit(0.0))
    copies = F.floor(weight) + F.when(draw < weight - F.floor(weight), 1).otherwise(0)
    return out.select(*names, weight.alias("weight"), copies.cast("bigint").alias("n_copies"))


# Production targets of languages and topics; sources are tempered by the root of their share.
LANGUAGES = {"en": 0.52, "de": 0.15, "fr": 0.15, "es": 0.15, OTHER: 0.03}
TOPICS = {"prose": 0.78, "lines": 0.1, "figures": 0.05, "markup": 0.05, OTHER: 0.02}
SOURCE_POWER, SHARE = 0.5, 0.6
TARGETS = {"source": SOURCE_POWER, "lang": LANGUAGES, "topic": TOPICS}


def features(docs: DataFrame) -> DataFrame:
    """What the production mix reads of each document."""
    return docs.select("doc_id", "source", "lang", register_of(F.col("text")).alias("topic"), token_count(F.col("text")).alias("n_tokens"))


def production_mix(docs: DataFrame) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, weight, n_copies`` of every document under the production targets."""
    rows = written(features(docs), "mix")
    return mix(rows, TARGETS, SHARE)


def sampled(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the production mix draws, whole, with ``topic, n_tokens, weight, n_copies``."""
    docs = docs.withColumns({"topic": register_of(F.col("text")), "n_tokens": token_count(F.col("text"))})
    # Measured once for the fit, and once more where the texts are read to be returned.
    rows = written(docs.select("doc_id", "source", "lang", "topic", "n_tokens"), "mix")
    return mix(docs, TARGETS, SHARE, cells_of=rows).where("n_copies > 0")
