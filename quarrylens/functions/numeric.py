"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Name = str | Column


def col(c: Name) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(over: Name, under: Name, default: float | None = 0.0) -> Column:
    """over / under, or the default where under is not above zero."""
    return F.when(col(under) > 0, col(over).cast("double") / col(under)).otherwise(F.lit(default))


def nonzero_ratio(over: Name, under: Name, default: float | None = 0.0) -> Column:
    """over / under, or the default where under is zero."""
    return F.when(col(under) != 0, col(over).cast("double") / col(under)).otherwise(F.lit(default))


def change_percent_signed(base: Name, now: Name) -> Column:
    """Change over the signed base; a base of zero gives 0."""
    return nonzero_ratio(100 * (col(now) - col(base)), base)


def change_percent_abs(base: Name, now: Name) -> Column:
    """Change over the absolute base; a base of zero gives 0 for no change and 100 otherwise."""
    b, n = col(base), col(now)
    return F.when(b == 0, F.when(n == 0, 0.0).otherwise(100.0)).otherwise((n - b) / F.abs(b) * 100)


def change_percent_start(base: Name, now: Name) -> Column:
    """Change over the absolute base; a base of zero gives 0."""
    b, n = col(base), col(now)
    return F.when(b == 0, 0.0).otherwise((n - b) / F.abs(b) * 100)


def none_if_zero(c: Name) -> Column:
    return F.nullif(col(c), F.lit(0.0))


def steps(value: Name, ladder: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first bound that value reaches; bounds from the highest down."""
    out = None
    for bound, label in ladder:
        hit = col(value) >= bound
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def up_to(value: Name, ladder: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first bound that value does not exceed; bounds from the lowest up."""
    out = None
    for bound, label in ladder:
        hit = col(value) <= bound
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def messages(*pairs: tuple[Column, Column | str]) -> Column:
    """An array of the texts whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in pairs)))
