"""Column helpers for statistics with explicit missing values.

Survey code treats a missing value as "unknown": an unknown condition gives an unknown result,
an unknown addend makes every later running total unknown, and membership tests never return
unknown. Spark's ``when``/``sum``/``avg`` skip NULLs instead, so the operators spell the
difference out with the helpers below. All of them are built-in expressions (whole-stage codegen).

Every helper that looks at neighbouring rows takes the *same* person window, so Catalyst places
them in one ``Window`` node after one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

__all__ = [
    "as_col", "known", "na_ifelse", "is_one_of", "na_any", "na_any_agg", "na_cumsum", "na_mean",
    "na_max", "person_window", "running", "preceding", "whole", "subset_lag", "subset_min",
    "subset_cumsum", "gap", "value_at", "first_year_where", "is_first_row", "to_number",
    "first_valid",
]


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(predicate: Column) -> Column:
    """Three-valued predicate to two-valued: unknown counts as FALSE."""
    return F.coalesce(predicate, F.lit(False))


def na_ifelse(condition: Column, yes, no) -> Column:
    """Choose by a three-valued condition; an unknown condition gives NULL, not ``no``."""
    return F.when(condition, yes).when(~condition, no)


def is_one_of(x: Column | str, values: Iterable) -> Column:
    """Membership test that is FALSE (never NULL) for a missing value."""
    return known(as_col(x).isin(*list(values)))


def na_any_agg(predicate: Column) -> Column:
    """Aggregate form of :func:`na_any`, for ``groupBy().agg``."""
    return (
        F.when(F.bool_or(predicate), F.lit(True))
        .when(F.count_if(predicate.isNull()) > 0, F.lit(None).cast("boolean"))
        .otherwise(F.lit(False))
    )


def na_any(predicate: Column, group: WindowSpec) -> Column:
    """TRUE if any row is TRUE, else NULL if any row is unknown, else FALSE."""
    return (
        F.when(F.bool_or(predicate).over(group), F.lit(True))
        .when(F.count_if(predicate.isNull()).over(group) > 0, F.lit(None).cast("boolean"))
        .otherwise(F.lit(False))
    )


def na_cumsum(x: Column, running_window: WindowSpec) -> Column:
    """Running sum that stays NULL from the first missing addend on."""
    missing = F.sum(x.isNull().cast("int")).over(running_window)
    return F.when(missing == 0, F.sum(x).over(running_window))


def na_mean(x: Column, group: WindowSpec) -> Column:
    """Group mean that is NULL when any member is missing."""
    return F.when(F.count_if(x.isNull()).over(group) == 0, F.avg(x).over(group))


def na_max(x: Column) -> Column:
    """Aggregate maximum that is NULL when any member is missing."""
    return F.when(F.count_if(x.isNull()) == 0, F.max(x))


def person_window(keys: str | Sequence[str] = "pid", order: str = "year") -> WindowSpec:
    """Rows of one person (or person and spell) in wave order."""
    names = [keys] if isinstance(keys, str) else list(keys)
    return Window.partitionBy(*names).orderBy(order)


def running(w: WindowSpec) -> WindowSpec:
    """First row to current row. A ROWS frame: the default RANGE frame merges ties."""
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def preceding(w: WindowSpec) -> WindowSpec:
    """All rows before the current one."""
    return w.rowsBetween(Window.unboundedPreceding, -1)


def whole(w: WindowSpec) -> WindowSpec:
    """All rows of the group, keeping the sort of ``w`` so no second sort is planned."""
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def subset_lag(x: Column | str, member: Column, w: WindowSpec) -> Column:
    """Previous value of ``x`` among the rows where ``member`` holds.

    Rows outside the subset are skipped rather than filtered out, so neither a self-join nor a
    second sort is needed. The value is boxed in a struct: a NULL inside the subset is a
    legitimate previous value and must not be skipped. Rows outside the subset see the last
    member as well; callers guard with ``member`` where that matters.
    """
    boxed = F.when(known(member), F.struct(as_col(x).alias("v")))
    return F.last(boxed, ignorenulls=True).over(preceding(w))["v"]


def subset_min(x: Column | str, member: Column, w: WindowSpec) -> Column:
    """Group minimum over the rows where ``member`` holds; NULL if there are none."""
    return F.min(F.when(known(member), as_col(x))).over(whole(w))


def subset_cumsum(x: Column, member: Column, w: WindowSpec) -> Column:
    """:func:`na_cumsum` over the rows where ``member`` holds."""
    inside = known(member)
    missing = F.sum((inside & x.isNull()).cast("int")).over(running(w))
    return F.when(missing == 0, F.sum(F.when(inside, x)).over(running(w)))


def gap(w: WindowSpec, year: str = "year") -> Column:
    """Years since the person's previous wave; NULL in the first one. Waves are irregular."""
    return F.col(year) - F.lag(year).over(w)


def value_at(x: Column | str, at: int, w: WindowSpec, year: str = "year") -> Column:
    """The person's value in wave ``at``, on every row; NULL if that wave is missing."""
    return F.max(F.when(F.col(year) == at, as_col(x))).over(whole(w))


def first_year_where(predicate: Column, w: WindowSpec, year: str = "year") -> Column:
    """First wave in which the predicate holds; NULL if it never does."""
    return subset_min(year, predicate, w)


def is_first_row(w: WindowSpec, year: str = "year") -> Column:
    """Whether the row is the first of its group."""
    return F.col(year) == F.min(year).over(whole(w))


INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def to_number(text: Column | str, kind: str = "double") -> Column:
    """Number, or NULL where the text is not numeric (plain casts throw under ANSI mode).

    The pattern is tested first: a failing ``try_cast`` raises and catches an exception per row,
    which dominates the scan of files with many blank fields.
    """
    pattern = DECIMAL_TEXT if kind in ("double", "float") else INTEGER_TEXT
    value = as_col(text)
    return F.when(value.rlike(pattern), value.try_cast(kind))


def first_valid(values: Sequence[Column | str], invalid=0) -> Column:
    """First value that is neither missing nor the ``invalid`` code."""
    return F.coalesce(*[F.nullif(as_col(v), F.lit(invalid)) for v in values])
