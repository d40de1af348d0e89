"""Vector arithmetic on array columns: dot product, cosine, int8 quantization. All in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = 1e-12


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    """Sum of products; 0 for vectors of different lengths, or empty ones."""
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or the product of the norms is next to nothing."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size >= LEAST), dot(a, b) / size).otherwise(F.lit(0.0))


def quantized(v: Column) -> Column:
    """struct(q: array of -127..127, scale): values over a 127th of the largest magnitude, rounded away from zero at halves."""
    peak = F.coalesce(F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    scale = F.when(peak < LEAST, F.lit(1.0)).otherwise(peak / 127)
    level = lambda x: F.least(F.greatest(F.round(x.cast("double") / scale), F.lit(-127.0)), F.lit(127.0))
    return F.struct(F.transform(v, lambda x: F.when(peak < LEAST, F.lit(0)).otherwise(level(x)).cast("tinyint")).alias("q"), scale.alias("scale"))


def dequantized(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: x.cast("double") * scale)


def quantized_dot(q: Column, scale: Column, query: Column) -> Column:
    """The query stays in floating point."""
    return dot(q, query) * scale
