"""Joins that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key counts as hot above this share of all rows, so at most 1/share keys
# can be hot: that is the size bound of the hot-key table.
HOT_SHARE = 1.0 / 256
HOT_SALTS = 64

# Groups per key where the short side of a join is copied without counting.
KEY_SALTS = 16


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys that own more than ``share`` of the rows (at most ``1/share`` rows).

    The count is a partial aggregate, so a hot key is already one row per
    task before the shuffle.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    return counts.where(F.col("_n") > total.scalar() * F.lit(share)).select(key)


def salted_join(
    big: DataFrame,
    unique: DataFrame,
    key: str,
    salt_by: str,
    how: str = "inner",
    salts: int = HOT_SALTS,
    share: float = HOT_SHARE,
) -> DataFrame:
    """Join many rows to a table with one row per ``key``.

    Rows of a hot key are spread over ``salts`` groups by a hash of
    ``salt_by``; only the (bounded) hot rows of ``unique`` are copied once per
    group. All other rows take the ordinary shuffle join.
    """
    hot = F.broadcast(hot_keys(big, key, share).withColumn("_hot", F.lit(True)))
    left = big.join(hot, key, "left").withColumn(
        "_salt",
        F.when(F.col("_hot"), F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")).otherwise(F.lit(0)),
    )
    right = unique.join(hot, key, "left").withColumn(
        "_salt",
        F.explode(
            F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        ),
    )
    return left.drop("_hot").join(right.drop("_hot"), [key, "_salt"], how).drop("_salt")


def spread_join(
    big: DataFrame, small: DataFrame, key: str, salt_by: str, how: str, salts: int = KEY_SALTS
) -> DataFrame:
    """Join a table that may hold very many rows per ``key`` to a short table.

    Every key of ``big`` is spread over ``salts`` groups without counting
    first; the rows of ``small`` (few and narrow) are copied to each.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows; reads at most one more."""
    return df.limit(rows + 1).count() <= rows
