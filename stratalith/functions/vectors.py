"""Vector arithmetic on array columns, and the hashing encoder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def length(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Divided by its length, if that exceeds 1e-8."""
    n = length(v)
    return F.when(n > 1e-8, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def bucket(term: Column, dim: int) -> Column:
    """Place of a term in the hashed vector: its md5's first eight digits modulo ``dim``."""
    digits = next((m for m in range(1, 8) if 16**m % dim == 0), 8)  # the last ones decide where dim divides a power of 16
    text = F.md5(term)
    place = lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(text, i, 1)).cast("bigint") - 1
    value = sum((place(i) * F.lit(16 ** (8 - i)) for i in range(9 - digits, 8)), place(8))
    return (value % dim).cast("int")


def sign(term: Column) -> Column:
    """-1 where the ninth digit of the md5 is eight or more."""
    return F.when(F.substring(F.md5(term), 9, 1) >= "8", -1.0).otherwise(1.0)
