"""Vector expressions over ARRAY<FLOAT> columns, computed in double precision inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Column | str, b: Column | str) -> Column:
    squares = F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)


def subvector(v: Column | str, part: Column | int, width: int) -> Column:
    """The part-th run of ``width`` components, counted from 0."""
    start = part * width + 1
    return F.slice(_col(v), start if isinstance(start, Column) else F.lit(start), F.lit(width))


def sums(v: Column | str, dim: int, weight: Column | None = None) -> list[Column]:
    """One aggregate per component: vectors are summed without exploding them into rows."""
    w = weight if weight is not None else F.lit(1.0)
    return [F.sum(w * F.element_at(_col(v), i + 1).cast("double")).alias(f"_s{i}") for i in range(dim)]


def gathered(dim: int, over: Column | None = None) -> Column:
    """The array of the columns that ``sums`` made, each divided by ``over``."""
    return F.array(*(F.col(f"_s{i}") / over if over is not None else F.col(f"_s{i}") for i in range(dim)))
