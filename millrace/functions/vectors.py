"""Vector expressions on ARRAY<FLOAT> / ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOCK_DIM = 384


def mock_vector(text: Column, dim: int = MOCK_DIM) -> Column:
    """SHA-256 bytes of the text over 255, repeated up to ``dim`` values."""
    pairs = F.regexp_extract_all(F.sha2(text, 256), F.lit("(..)"), F.lit(1))
    unit = F.transform(pairs, lambda p: (F.conv(p, 16, 10).cast("double") / 255.0).cast("float"))
    return F.slice(F.flatten(F.array_repeat(unit, dim // 32 + 1)), 1, dim)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0.0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def first_dims(a: Column, dim: int) -> Column:
    return F.slice(a, 1, dim)
