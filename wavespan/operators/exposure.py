"""Tenure and experience accumulated over irregularly spaced waves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavespan.functions.na import (as_col, gap, is_first_row, is_one_of, known, na_cumsum,
                                   na_ifelse, na_mean, person_window, running, subset_cumsum,
                                   subset_lag, subset_min, whole)
from wavespan.operators import INTENDED, check_semantics

# Waves in which employer tenure accrues, for the short and the long panel.
ACCRUAL_YEARS_SHORT = ((1969, 1978), (1982, 1993))
ACCRUAL_YEARS_LONG = ((1969, 1978), (1982, 2015))
TENURE_RESET_YEAR = 1981
WORK_EXPERIENCE_AFTER = 1973
RESTART_VALUE = 0.5


def _within(year: Column, eras: Sequence[tuple[int, int]]) -> Column:
    test = F.lit(False)
    for lo, hi in eras:
        test = test | year.between(lo, hi)
    return test


GAP, FIRST, SEGMENT, STAYS, STEP = "__gap", "__first", "__segment", "__stays_", "__step"
MEAN = "__mean_"


def person_columns(panel: DataFrame, code_spells: Sequence[str] = (), tenure: str = "tenure",
                   employed: str = "emp_status", pid: str = "pid", year: str = "year",
                   reset_year: int = TENURE_RESET_YEAR) -> DataFrame:
    """What the totals below need from neighbouring waves, in one pass over the person window.

    The totals then only look inside a spell, so everything that concerns one kind of spell
    shares one sort. Drop the helper columns with :func:`drop_person_columns`.
    """
    w = person_window(pid, year)
    reset = (F.col(year) == reset_year) & F.col(tenure).isNotNull()
    next_employed = is_one_of(F.lead(employed).over(w), [1])
    return panel.withColumns({
        GAP: gap(w, year),
        FIRST: is_first_row(w, year),
        SEGMENT: F.sum(reset.cast("int")).over(running(w)),
        **{STAYS + s: next_employed & is_one_of(F.col(s) - F.lead(s).over(w), [0])
           for s in code_spells},
    })


def drop_person_columns(panel: DataFrame) -> DataFrame:
    return panel.drop(*[c for c in panel.columns if c in (GAP, FIRST, SEGMENT, STEP)
                        or c.startswith((STAYS, MEAN))])


def tenure_total(panel: DataFrame, spell: str, out: str, tenure: str = "tenure",
                 employed: str = "emp_status", hours: str = "hours", pid: str = "pid",
                 year: str = "year", accrual: Sequence[tuple[int, int]] = ACCRUAL_YEARS_SHORT,
                 reset_year: int = TENURE_RESET_YEAR, min_hours: float = 800,
                 semantics: str = INTENDED) -> DataFrame:
    """The spell part of :func:`employer_tenure`; leaves helper columns behind."""
    literal = check_semantics(semantics)
    y, t = F.col(year), F.col(tenure)
    in_spell = person_window([pid, spell], year)
    first_report = subset_min(year, t.isNotNull(), in_spell)
    accrues = is_one_of(employed, [1]) & (F.col(hours) >= min_hours) & _within(y, accrual)
    step = (
        F.when(known(t.isNotNull() & ((y == reset_year) | (y == first_report))), t)
        .when(known(accrues), F.coalesce(F.col(GAP), F.lit(0)))
        .otherwise(F.lit(0)).cast("double")
    )
    df = panel.withColumn(STEP, step)
    upto = running(in_spell)
    if literal:
        return df.withColumn(out, F.sum(STEP).over(upto))
    # two running sums in the same window: before the reset wave, and from it on
    after = F.col(SEGMENT) > 0
    return df.withColumn(out, F.when(after, F.sum(F.when(after, F.col(STEP))).over(upto))
                         .otherwise(F.sum(F.when(~after, F.col(STEP))).over(upto)))


def employer_tenure(panel: DataFrame, spell: str = "emp_spell", out: str = "emp_tenure",
                    tenure: str = "tenure", employed: str = "emp_status", hours: str = "hours",
                    pid: str = "pid", year: str = "year",
                    accrual: Sequence[tuple[int, int]] = ACCRUAL_YEARS_SHORT,
                    reset_year: int = TENURE_RESET_YEAR, min_hours: float = 800,
                    semantics: str = INTENDED) -> DataFrame:
    """Years with the employer: reported at the start of the spell, then accrued wave by wave.

    In ``reset_year`` the reported value, where there is one, replaces what was accumulated. The
    literal reading merely adds it to the running sum.
    """
    df = person_columns(panel, (), tenure, employed, pid, year, reset_year)
    df = tenure_total(df, spell, out, tenure, employed, hours, pid, year, accrual, reset_year,
                      min_hours, semantics)
    return drop_person_columns(df)


def experience_total(panel: DataFrame, spell: str, out: str, tenure: str = "tenure",
                     hours: str = "hours", pid: str = "pid", year: str = "year",
                     min_hours: float = 800, restart: float = RESTART_VALUE) -> DataFrame:
    """The spell part of :func:`code_experience`; leaves helper columns behind."""
    first = F.col(FIRST)
    accrues = ~first & (F.col(hours) > min_hours) & F.col(STAYS + spell)
    step = na_ifelse(accrues, F.col(GAP), F.when(first, F.col(tenure)).otherwise(F.lit(0)))
    in_spell = person_window([pid, spell], year)
    opens = known(F.col(spell) > 1) & is_first_row(in_spell, year)
    df = panel.withColumn(STEP, F.when(opens, F.lit(restart)).otherwise(step.cast("double")))
    return df.withColumn(out, na_cumsum(F.col(STEP), running(in_spell)))


def code_experience(panel: DataFrame, spell: str, out: str, tenure: str = "tenure",
                    employed: str = "emp_status", hours: str = "hours", pid: str = "pid",
                    year: str = "year", min_hours: float = 800,
                    restart: float = RESTART_VALUE) -> DataFrame:
    """Years in the occupation or industry.

    Starts from the reported employer tenure in the person's first wave. A wave accrues the gap
    if hours exceed ``min_hours`` and the next wave is employed in the same spell; the last wave
    therefore never accrues. Every spell after the first restarts at ``restart``. Unknown hours
    in an otherwise accruing wave make the rest of the spell unknown.
    """
    df = person_columns(panel, [spell], tenure, employed, pid, year)
    df = experience_total(df, spell, out, tenure, hours, pid, year, min_hours, restart)
    return drop_person_columns(df)


def work_experience(panel: DataFrame, reported: str = "work_exp", out: str = "work_total",
                    employed: str = "emp_status", hours: str = "hours", pid: str = "pid",
                    year: str = "year", after: int = WORK_EXPERIENCE_AFTER,
                    min_hours: float = 800) -> DataFrame:
    """Years of work: seeded by the first report, then accrued in later waves.

    Waves up to ``after`` keep the seed as it is and stay out of the running sum. A wave with no
    report has no seed year either, so whether it accrues is unknown and the sum is NULL from
    there on, unless its employment or hours already rule accrual out.
    """
    w = person_window(pid, year)
    y, r = F.col(year), F.col(reported)
    late = y > after
    df = panel.withColumn("__seed_year", F.when(r.isNotNull(), subset_min(year, r.isNotNull(), w)))
    seed_year = F.col("__seed_year")
    since = y - subset_lag(year, late, w)
    accrues = is_one_of(employed, [1]) & (F.col(hours) >= min_hours) & (y > seed_year)
    seed = F.when(r.isNotNull() & (y == seed_year), r)
    step = F.coalesce(seed, na_ifelse(accrues, since, F.lit(0)))
    df = df.withColumn("__step", F.when(late, step).otherwise(seed).cast("double"))
    total = subset_cumsum(F.col("__step"), late, w)
    return (
        df.withColumn(out, F.when(late, total).otherwise(F.col("__step")))
        .drop("__seed_year", "__step")
    )


def on_job(panel: DataFrame, spell: str = "emp_spell", out: str = "on_job", pid: str = "pid",
           year: str = "year") -> DataFrame:
    """0 in the first wave of a spell, 1 afterwards."""
    w = person_window([pid, spell], year)
    return panel.withColumn(out, F.when(is_first_row(w, year), 0).otherwise(1))


def powers(panel: DataFrame, terms: dict[str, tuple[str, int, float]]) -> DataFrame:
    """Polynomial terms: output name -> (column, power, factor)."""
    return panel.withColumns({
        out: F.expr(f"{_power(f'double({c})', p)} * {float(factor)}D")
        for out, (c, p, factor) in terms.items()
    })


def _power(x: str, p: int) -> str:
    return " * ".join([x] * p)


def demean(panel: DataFrame, terms: dict[str, tuple[str, int, float]],
           by: Sequence[str] = ("pid", "emp_spell"), year: str = "year",
           keep_means: bool = False) -> DataFrame:
    """Deviation from the group mean: ``(x**p - mean(x)**p) * factor`` for each term.

    The mean itself is raised, not the powers averaged; one missing member makes the group NULL.
    """
    # the group's rows in wave order: the sort is that of the running totals of the same spell
    group = whole(person_window(list(by), year))
    means = {MEAN + c: na_mean(as_col(c).cast("double"), group)
             for c in dict.fromkeys(c for c, _, _ in terms.values())}
    df = panel.withColumns(means)
    df = df.withColumns({
        out: F.expr(f"({_power(f'double({c})', p)} - {_power(MEAN + c, p)}) * {float(factor)}D")
        for out, (c, p, factor) in terms.items()
    })
    return df if keep_means else df.drop(*means)
