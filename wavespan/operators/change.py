"""Employer, occupation and industry change detection.

Everything here is a chain of window expressions over one person window, so the whole module
needs a single exchange on the person key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavespan.functions.na import (gap, is_one_of, known, na_ifelse, person_window, preceding,
                                   subset_lag, whole)
from wavespan.operators import INTENDED, check_semantics


@dataclass(frozen=True)
class ChangeRules:
    """Years and thresholds of the change rules (fixed values of the survey design)."""

    entry_year: int = 1968            # bracket code 1 marks a new job
    second_year: int = 1969           # bracket code 2 after a flagged entry year
    bracket_end: int = 1975           # last wave with bracketed tenure
    months_year: int = 1976           # first wave with tenure in months
    months_limit: float = 15 / 12     # a first tenure below this is a new job
    general_from: int = 1976          # rule "tenure shorter than the gap between waves"
    tolerance_from: int = 1977        # rule "tenure off by more than the tolerance"
    last_year: int = 2017
    tolerance: float = 2.0            # years
    short_codes: tuple[int, ...] = (1, 2, 9)


DEFAULT_RULES = ChangeRules()


def wave_gap(panel: DataFrame, pid: str = "pid", year: str = "year", out: str = "gap") -> DataFrame:
    """Years between a person's consecutive waves."""
    return panel.withColumn(out, gap(person_window(pid, year), year))


def job_change(panel: DataFrame, tenure: str = "tenure", pid: str = "pid", year: str = "year",
               out: str = "change_t", out_tolerant: str = "change_24t", out_gap: str = "gap",
               out_first: str = "first_year", rules: ChangeRules = DEFAULT_RULES,
               semantics: str = INTENDED) -> DataFrame:
    """Flag waves in which a person works for a new employer.

    ``out`` holds the strict rule, ``out_tolerant`` the rule that compares tenure growth with the
    time elapsed, within a tolerance; the tolerant flag includes the strict one. Unknown counts
    as "no change". ``out_gap`` and ``out_first`` are the years since the previous wave and the
    person's first wave.

    The literal reading differs in two places: bracket code 2 flags every wave rather than the
    person's first one, and the tolerant rule takes the previous tenure from the eligible waves
    only while the gap comes from all waves.
    """
    literal = check_semantics(semantics)
    w = person_window(pid, year)
    y, t = F.col(year), F.col(tenure)

    # all neighbouring values the rules need, in one window pass
    df = panel.withColumns({
        out_gap: gap(w, year),
        "__before_year": F.lag(year).over(w),
        "__before": F.lag(tenure).over(w),
        out_first: F.min(year).over(whole(w)),
    })
    before, since = F.col("__before"), F.col(out_gap)

    def in_years(lo: int, hi: int) -> Column:
        return y.between(lo, hi)

    def apply(flag: Column, condition: Column) -> Column:
        return na_ifelse(condition, F.lit(True), flag)

    bracketed = in_years(rules.second_year, rules.bracket_end)
    entry = F.lit(True) if literal else y == F.col(out_first)
    entry_before = (F.col("__before_year") == rules.entry_year) & (before == 1)
    flag = "__flag"
    df = df.withColumn(flag, apply(
        (y == rules.entry_year) & (t == 1),
        (y == rules.second_year) & (t == 2) & entry_before))
    for condition in (
        bracketed & (t == 1),
        bracketed & (t == 2) & entry,
        in_years(rules.second_year + 1, rules.bracket_end) & (t == 2)
        & ~is_one_of(before, rules.short_codes),
        (y == rules.months_year) & ~is_one_of(t, [0]) & (t < rules.months_limit),
    ):
        # each rule sees the finished flag of the rules before it, and fires where it is FALSE
        df = df.withColumn(flag, apply(F.col(flag), ~F.col(flag) & condition))

    window_years = in_years(rules.general_from, rules.last_year)
    df = df.withColumn("__eligible", known(window_years & (t != 0) & (before != 0)))
    previous = subset_lag(tenure, F.col("__eligible"), w) if literal else before
    expected = previous + since
    off_track = (F.col("__eligible") & in_years(rules.tolerance_from, rules.last_year)
                 & ((t > expected + rules.tolerance) | (t < expected - rules.tolerance)))
    strict = known(F.col(flag)) | known(window_years & (t != 0) & (t < since))
    helpers = ["__before_year", "__before", flag, "__eligible", "__off"]
    return (
        df.withColumns({out: strict, "__off": known(off_track)})
        .withColumn(out_tolerant, F.col(out) | F.col("__off"))
        .drop(*helpers)
    )


def code_changes(panel: DataFrame, codes: dict[str, tuple[str, dict[str, str]]], pid: str = "pid",
                 year: str = "year", ungated_until: int = 1980,
                 zero_is_missing: bool = True) -> DataFrame:
    """:func:`code_change` for several codes in one window pass: output -> (code, gates)."""
    w = person_window(pid, year)
    values = {f"__code_{out}": F.nullif(F.col(code), F.lit(0)) if zero_is_missing else F.col(code)
              for out, (code, _) in codes.items()}
    df = panel.withColumns(values)
    df = df.withColumns({
        out: known(F.col(f"__code_{out}")
                   != F.last(f"__code_{out}", ignorenulls=True).over(preceding(w)))
        for out in codes})
    early = F.col(year) <= ungated_until
    gated = {name: F.when(early, F.col(out)).otherwise(known(F.col(out) & F.col(flag)))
             for out, (_, gates) in codes.items() for name, flag in gates.items()}
    return df.withColumns(gated).drop(*values)


def code_change(panel: DataFrame, code: str, gates: dict[str, str], pid: str = "pid",
                year: str = "year", out: str = "code_change", ungated_until: int = 1980,
                zero_is_missing: bool = True) -> DataFrame:
    """Flag waves whose occupation or industry code differs from the person's previous one.

    The previous code is the last non-missing one. ``out`` is the uncontrolled flag; ``gates``
    maps further output columns to job-change flags that must agree. Up to ``ungated_until`` the
    gated columns repeat the uncontrolled flag.
    """
    return code_changes(panel, {out: (code, gates)}, pid, year, ungated_until, zero_is_missing)
