"""Rule-driven recodes: sentinel codes, eras, roles, units, deflation, dummies."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavespan.functions.na import as_col, first_valid, is_one_of, known, na_ifelse, to_number
from wavespan.operators.lookup import MOST_YEARS, bounded


@dataclass(frozen=True)
class Recode:
    """In years ``lo..hi`` (open where None) replace any of ``codes`` in ``column``.

    ``codes=None`` matches every value, so the whole column can be blanked for a wave.
    """

    column: str
    codes: tuple | None
    to: float | int | str | None = None
    lo: int | None = None
    hi: int | None = None


def in_years(year: str, lo: int | None, hi: int | None) -> Column:
    y = F.col(year)
    test = F.lit(True)
    if lo is not None:
        test = test & (y >= lo)
    if hi is not None:
        test = test & (y <= hi)
    return known(test)


def recode(df: DataFrame, rules: Sequence[Recode], year: str = "year") -> DataFrame:
    """Apply the rules in order; the rules of one column compile to one expression."""
    types = dict(df.dtypes)
    columns: dict[str, Column] = {}
    for rule in rules:
        current = columns.get(rule.column, F.col(rule.column))
        hit = in_years(year, rule.lo, rule.hi)
        if rule.codes is not None:
            hit = hit & is_one_of(current, rule.codes)
        target = F.lit(rule.to).cast(types[rule.column])
        columns[rule.column] = F.when(hit, target).otherwise(current)
    return df.withColumns(columns)


def scale_in_era(df: DataFrame, column: str, divide_by: float, lo: int, hi: int,
                 year: str = "year") -> DataFrame:
    """Unit conversion of a column in years ``lo..hi`` (for example months to years)."""
    x = F.col(column).cast("double")
    return df.withColumn(column, F.when(in_years(year, lo, hi), x / divide_by).otherwise(x))


def era_coalesce(df: DataFrame, choices: dict[str, tuple[str, str, int]], year: str = "year",
                 until: int | None = None, drop: bool = True) -> DataFrame:
    """Pick the source column by era: output -> (early column, late column, first late year).

    ``until`` closes the late era; the early column applies outside it.
    """
    columns = {
        out: F.when(in_years(year, since, until), F.col(late)).otherwise(F.col(early))
        for out, (early, late, since) in choices.items()
    }
    sources = {c for early, late, _ in choices.values() for c in (early, late)} - set(choices)
    result = df.withColumns(columns)
    return result.drop(*sources) if drop else result


def role_collapse(df: DataFrame, pairs: dict[str, tuple[str, str]], relation: str = "relation",
                  spouse_codes: Iterable[int] = (20, 22), drop: bool = True) -> DataFrame:
    """Collapse head and spouse columns to the person's own: output -> (head, spouse)."""
    spouse = is_one_of(relation, spouse_codes)
    columns = {out: F.when(spouse, F.col(s)).otherwise(F.col(h)) for out, (h, s) in pairs.items()}
    sources = {c for pair in pairs.values() for c in pair} - set(pairs)
    result = df.withColumns(columns)
    return result.drop(*sources) if drop else result


def role_blank(df: DataFrame, columns: Sequence[str], relation: str = "relation",
               blank_for: Iterable[int] = (20, 22)) -> DataFrame:
    """NULL the columns for persons in the given roles."""
    keep = ~is_one_of(relation, blank_for)
    return df.withColumns({c: F.when(keep, F.col(c)) for c in columns})


def drop_matching(df: DataFrame, pattern: str | None = None,
                  names: Sequence[str] = ()) -> DataFrame:
    """Drop columns by case-sensitive regular expression and by name (absent names are fine)."""
    matched = [c for c in df.columns if pattern and re.search(pattern, c)]
    return df.drop(*matched, *names)


def normalise_case(df: DataFrame, upper: bool = True) -> DataFrame:
    return df.toDF(*[c.upper() if upper else c.lower() for c in df.columns])


def person_id(df: DataFrame, household: str = "id1968", number: str = "pernum",
              out: str = "pid") -> DataFrame:
    """Person key from the original household id and the person number in it."""
    return df.withColumn(out, (F.col(household) * 1000 + F.col(number)).cast("long"))


def deflate(df: DataFrame, index: DataFrame, wage: str, out: str, base_year: int,
            year: str = "year", value: str = "value") -> DataFrame:
    """Wage in base-year prices; NULL where the index has no value for the year.

    The index has one row per year, at most ``MOST_YEARS``; it is broadcast with the base-year value
    beside each row, so the panel is never shuffled on the year.
    """
    prices = bounded(
        index.filter(F.col(year).isNotNull()).select(year, F.col(value).alias("__price")), MOST_YEARS,
        overall={"__base": F.max(F.when(F.col(year) == base_year, F.col("__price")))})
    return (
        df.join(prices, year, "left")
        .withColumn(out, F.col(wage) * (F.col("__base") / F.col("__price")))
        .drop("__base", "__price")
    )


def dummy(df: DataFrame, out: str, column: str, equals, negate: bool = False) -> DataFrame:
    """0/1 column from an equality test; missing stays missing."""
    hit = F.col(column) == equals
    return df.withColumn(out, na_ifelse(~hit if negate else hit, F.lit(1), F.lit(0)))


def flag_in(df: DataFrame, out: str, column: str, codes: Iterable) -> DataFrame:
    """0/1 column from a membership test; missing counts as 0."""
    return df.withColumn(out, is_one_of(column, codes).cast("int"))


def log_positive(df: DataFrame, column: str, out: str) -> DataFrame:
    """Keep rows with a positive value and add its natural logarithm."""
    return df.filter(F.col(column) > 0).withColumn(out, F.log(F.col(column)))


def numeric(df: DataFrame, columns: Sequence[str], kind: str = "double") -> DataFrame:
    """Numbers from text; NULL where the text is not numeric."""
    return df.withColumns({c: to_number(c, kind) for c in columns})


def pick_first_valid(df: DataFrame, out: str, columns: Sequence[str], invalid=0) -> DataFrame:
    """First of the columns that is neither missing nor ``invalid``."""
    return df.withColumn(out, first_valid([as_col(c) for c in columns], invalid))
