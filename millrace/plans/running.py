"""Running sums and maxima over a long order without one big window.

Rows are cut into blocks of ``2**bits`` neighbouring keys. Each block is one
window group, so no task sees more than ``2**bits`` rows when the key is
unique; the block totals are run over in the same way, one level up.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 20


def _fold(op: str, a: Column, b: Column) -> Column:
    if op == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.greatest(a, b))


def running(
    df: DataFrame,
    key: str,
    aggs: dict[str, tuple[str, str]],
    by: tuple[str, ...] = (),
    inclusive: bool = True,
    bits: int = BLOCK_BITS,
    key_bits: int = 40,
) -> DataFrame:
    """Add running aggregates in the order of the non-negative BIGINT ``key``.

    ``aggs`` maps an output column to ``(op, input column)`` with op ``sum`` or
    ``max``; a ``max`` input may be any orderable column that ``greatest``
    takes. ``inclusive=False`` leaves the current row out (NULL / 0 at first).
    ``key_bits`` bounds the key range and so the number of levels.
    """
    frame_end = Window.currentRow if inclusive else -1
    if key_bits <= bits:
        # At most 2**bits distinct keys are left in each group of ``by``.
        window = Window.partitionBy(*(by or (F.lit(0),))).orderBy(key)
        window = window.rowsBetween(Window.unboundedPreceding, frame_end)
        return df.select("*", *[_over(op, src, window).alias(out) for out, (op, src) in aggs.items()])

    # Each level has its own block column: the level below is keyed by it.
    name = f"_block{key_bits}"
    block = F.shiftright(F.col(key), bits)
    totals = df.groupBy(*by, block.alias(name)).agg(
        *[getattr(F, op)(src).alias(f"_t_{out}") for out, (op, src) in aggs.items()]
    )
    offsets = running(
        totals,
        name,
        {f"_o_{out}": (op, f"_t_{out}") for out, (op, _) in aggs.items()},
        by,
        inclusive=False,
        bits=bits,
        key_bits=key_bits - bits,
    ).select(*by, name, *[f"_o_{out}" for out in aggs])
    window = Window.partitionBy(*by, name).orderBy(key).rowsBetween(Window.unboundedPreceding, frame_end)
    inner = df.withColumn(name, block).select(
        "*", *[_over(op, src, window).alias(f"_w_{out}") for out, (op, src) in aggs.items()]
    )
    # Nulls are keys and groups like any other; they sort first.
    named = (*by, name)
    offsets = offsets.select(*[F.col(c).alias(f"_k_{c}") for c in named], *[f"_o_{out}" for out in aggs])
    same = functools.reduce(lambda a, b: a & b, [inner[c].eqNullSafe(offsets[f"_k_{c}"]) for c in named])
    joined = inner.join(offsets, same)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[_fold(op, F.col(f"_o_{out}"), F.col(f"_w_{out}")).alias(out) for out, (op, _) in aggs.items()],
    )


def _over(op: str, src: str, window) -> Column:
    value = getattr(F, op)(src).over(window)
    return F.coalesce(value, F.lit(0)) if op == "sum" else value


def dense_index(df: DataFrame, key: str, out: str = "idx", **kw) -> DataFrame:
    """Positions 0, 1, 2, … in the order of the unique ``key``."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running(one, key, {out: ("sum", "_one")}, inclusive=False, **kw).drop("_one")
