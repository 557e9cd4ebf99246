"""Spells: numbering runs of waves between changes (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavespan.functions.na import (first_year_where, is_one_of, known, na_cumsum, person_window,
                                   running, whole)
from wavespan.operators import INTENDED, check_semantics


def running_spell(panel: DataFrame, flag: str, out: str = "spell", pid: str = "pid",
                  year: str = "year") -> DataFrame:
    """Spell number = running count of flagged waves."""
    w = running(person_window(pid, year))
    return panel.withColumn(out, F.sum(F.col(flag).cast("int")).over(w).cast("int"))


def invalidate_idle_spells(panel: DataFrame, spells: list[str], employed: str = "emp_status",
                           pid: str = "pid") -> DataFrame:
    """Set a spell number to NULL on all its rows when the person is never employed in it."""
    working = is_one_of(employed, [1])
    return panel.withColumns({
        s: F.when(F.bool_or(working).over(Window.partitionBy(pid, s)), F.col(s)) for s in spells
    })


def ever_employed(panel: DataFrame, employed: str = "emp_status", pid: str = "pid",
                  year: str = "year") -> DataFrame:
    """Keep the persons with at least one employed wave."""
    w = whole(person_window(pid, year))
    return (
        panel.withColumn("__ever", F.bool_or(is_one_of(employed, [1])).over(w))
        .filter("__ever").drop("__ever")
    )


def employer_spells(panel: DataFrame, change: str = "change_t", change_tolerant: str = "change_24t",
                    employed: str = "emp_status", pid: str = "pid", year: str = "year",
                    out: str = "emp_spell", out_tolerant: str = "emp_spell_24t",
                    late_era_from: int | None = None, semantics: str = INTENDED) -> DataFrame:
    """Number the spells with one employer.

    The first employed wave opens spell 1 and every later change opens the next one; persons
    never employed are dropped and spells without an employed wave become NULL. With
    ``late_era_from`` the first employed wave of the late era adds 2.

    The literal reading numbers the strict spells with the tolerant flag and leaves the tolerant
    spells without changes; there, a wave in the year just before ``late_era_from`` belongs to no
    era and leaves the number unknown from then on.
    """
    literal = check_semantics(semantics)
    w = person_window(pid, year)
    working = is_one_of(employed, [1])
    y = F.col(year)

    if late_era_from is None:
        eras = [(F.lit(True), 1)]
    else:
        eras = [(y < (late_era_from - 1 if literal else late_era_from), 1), (y >= late_era_from, 2)]
    # who never was employed has no first employed wave in any era
    first_jobs = {f"__job{i}": first_year_where(working & era, w, year)
                  for i, (era, _) in enumerate(eras)}
    df = panel.withColumns(first_jobs | {"__first_job": first_year_where(working, w, year)})
    df = df.filter(F.col("__first_job").isNotNull())

    opening, in_era = F.lit(None).cast("int"), F.lit(False)
    for i, (era, step) in enumerate(eras):
        opening = F.when(known(era & (y == F.col(f"__job{i}"))), F.lit(step)).otherwise(opening)
        in_era = in_era | era

    def steps(flag: str | None):
        later = F.lit(0) if flag is None else F.col(flag).cast("int")
        return F.coalesce(opening, F.when(in_era, later))

    df = df.withColumns({
        out: steps(change_tolerant if literal else change),
        out_tolerant: steps(None if literal else change_tolerant),
    }).drop(*first_jobs, "__first_job")
    df = df.withColumns({
        name: na_cumsum(F.col(name), running(w)).cast("int") for name in (out, out_tolerant)
    })
    return invalidate_idle_spells(df, [out, out_tolerant], employed, pid)


def code_spells(panel: DataFrame, changes: dict[str, tuple[str, str]],
                employed: str = "emp_status", pid: str = "pid", year: str = "year",
                late_era_from: int | None = None) -> DataFrame:
    """Number occupation or industry spells.

    ``changes`` maps an output column to (change flag, code column). Numbering starts at the
    first employed wave with a code; earlier waves are NULL. Changes from ``late_era_from`` on
    add 2, because those waves are two years apart.
    """
    w = person_window(pid, year)
    step = F.lit(1)
    if late_era_from is not None:
        step = F.when(F.col(year) >= late_era_from, F.lit(2)).otherwise(F.lit(1))
    steps = {}
    for out, (flag, code) in changes.items():
        start = first_year_where(is_one_of(employed, [1]) & F.col(code).isNotNull(), w, year)
        steps[out] = (
            F.when(known(F.col(year) == start), F.lit(1))
            .when(known(F.col(flag)), step)
            .otherwise(F.lit(0))
        )
    df = panel.withColumns(steps)
    return df.withColumns({
        out: F.nullif(F.sum(out).over(running(w)).cast("int"), F.lit(0)) for out in changes
    })


def spell_code(panel: DataFrame, code: str, spell: str, out: str, pid: str = "pid",
               year: str = "year", semantics: str = INTENDED) -> DataFrame:
    """Most frequent code of each spell on all its rows (ties: the smallest).

    The literal reading takes the least frequent code. Missing codes do not count. A spell has at
    most one row per wave, so a window under the person partitioning replaces a group-by and
    join back.
    """
    if not check_semantics(semantics):
        in_spell = whole(person_window([pid, spell], year))
        return panel.withColumn(out, F.mode(F.col(code), deterministic=True).over(in_spell))
    n = F.count(code).over(Window.partitionBy(pid, spell, code))
    rank = F.when(F.col(code).isNotNull(), F.struct(n.alias("n"), F.col(code).alias("code")))
    df = panel.withColumn("__rank", rank)
    return df.withColumn(
        out, F.min("__rank").over(Window.partitionBy(pid, spell))["code"]).drop("__rank")


def from_first_report(panel: DataFrame, reported: str = "tenure", pid: str = "pid",
                      year: str = "year") -> DataFrame:
    """Keep each person's waves from the first reported value on; drop persons with none."""
    w = person_window(pid, year)
    return (
        panel.withColumn("__start", first_year_where(F.col(reported).isNotNull(), w, year))
        .filter(F.col(year) >= F.col("__start")).drop("__start")
    )
