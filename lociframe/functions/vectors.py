"""Dense-vector expressions on ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import column


def doubles(v: Column | str) -> Column:
    return column(v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(column(a), column(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(total(F.zip_with(column(a), column(b), lambda x, y: (x - y) * (x - y))))


def subtract(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(column(a), column(b), lambda x, y: x - y)


def cosine(a: Column | str, b: Column | str, epsilon: float = 1e-12) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(epsilon))
