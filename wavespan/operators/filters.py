"""Row, person and design filters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wavespan.functions.na import is_one_of, known, na_any, person_window, whole
from wavespan.operators import INTENDED, check_semantics

# Original household ids of the survey's subsamples (exclusive bounds).
SUBSAMPLES = {
    "SRC": (None, 3000),
    "immigrant": (3000, 5000),
    "SEO": (5000, 7000),
    "latino": (7000, 9309),
}
HEAD_CODE_CHANGE = 1983   # head of household is code 1 before, code 10 from this year on
FIRST_WAVE = 1968         # has no sequence number


def in_subsample(name: str, household: str = "id1968") -> Column:
    lo, hi = SUBSAMPLES[name]
    test = F.col(household) < hi
    return test if lo is None else test & (F.col(household) > lo)


def subsample(df: DataFrame, name: str | None, household: str = "id1968") -> DataFrame:
    return df if name is None else df.filter(in_subsample(name, household))


def heads(df: DataFrame, which: str | None, year: str = "year", relation: str = "relation",
          sequence: str = "sequence") -> DataFrame:
    """``"any"``: heads with sequence 1 to 20; ``"current"``: sequence 1; None: everybody."""
    if which is None:
        return df
    code = F.when(F.col(year) < HEAD_CODE_CHANGE, 1).otherwise(10)
    place = F.col(sequence).between(1, 20) if which == "any" else F.col(sequence) == 1
    return df.filter((F.col(relation) == code) & ((F.col(year) == FIRST_WAVE) | place))


def demographics(df: DataFrame, age: tuple[int, int] = (18, 64), regions: Iterable[int] = (1, 2, 3, 4),
                 sex: Iterable[int] | None = (1,), race: Iterable[int] | None = None,
                 relations: Iterable[int] | None = (1, 10), columns: dict[str, str] | None = None
                 ) -> DataFrame:
    """Keep rows by sex, race, role, age range (inclusive) and region."""
    name = {k: k for k in ("age", "region", "sex", "race", "relation")} | (columns or {})
    test = F.col(name["age"]).between(*age) & F.col(name["region"]).isin(*regions)
    for column, codes in (("sex", sex), ("race", race), ("relation", relations)):
        if codes is not None:
            test = test & F.col(name[column]).isin(*codes)
    return df.filter(test)


def years(df: DataFrame, lo: int | None = None, hi: int | None = None,
          exclude: Sequence[int] = (), year: str = "year") -> DataFrame:
    """Wave window; prunes partitions when the panel is partitioned by year."""
    y = F.col(year)
    tests = ([y >= lo] if lo is not None else []) + ([y <= hi] if hi is not None else [])
    if exclude:
        tests.append(~y.isin(*exclude))
    return df.filter(reduce(Column.__and__, tests)) if tests else df


def person_flags(df: DataFrame, flags: dict[str, Column], pid: str = "pid",
                 year: str = "year") -> DataFrame:
    """Person-level "ever" flags with three values (see :func:`na_any`)."""
    group = whole(person_window(pid, year))
    return df.withColumns({out: na_any(p, group) for out, p in flags.items()})


def exclude_persons(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Drop every row of the persons with a TRUE flag; unknown flags stay."""
    return df.filter(reduce(Column.__and__, [~known(F.col(f)) for f in flags]))


def work_flags(df: DataFrame, hours: str = "hours", wage: str = "wage_real",
               low_wage: str = "low_wage", max_short: float = 500, short: str = "short_hours",
               no_income: str = "no_income", semantics: str = INTENDED) -> DataFrame:
    """Row flags for few hours and for no labour income.

    The literal reading of "no income" is TRUE whenever the person's low-wage flag is FALSE, and
    FALSE when it is unknown.
    """
    literal = check_semantics(semantics)
    w = F.col(wage)
    idle = known(~F.col(low_wage)) if literal else (w.isNull() | (w == 0))
    return df.withColumns({short: F.col(hours) <= max_short, no_income: idle})


def reliable_triples(df: DataFrame, employed: str = "emp_status", out: str = "reliable",
                     pid: str = "pid", order: str | Sequence[str] = "year") -> DataFrame:
    """Person flag: some wave is employed together with the waves before and after it.

    ``order`` may name the columns of another physical order than that of the waves.
    """
    names = [order] if isinstance(order, str) else list(order)
    w: WindowSpec = Window.partitionBy(pid).orderBy(*names)
    now = is_one_of(employed, [1])
    triple = F.col("__now") & F.lag("__now").over(w) & F.lead("__now").over(w)
    return (
        df.withColumn("__now", now)
        .withColumn("__triple", known(triple))
        .withColumn(out, F.bool_or("__triple").over(whole(w)))
        .drop("__now", "__triple")
    )


def left_censored(first: str = "first_year", spells: Sequence[str] = ("occ_spell", "ind_spell"),
                  after: int = 1980) -> Column:
    """Three-valued test: entered the panel late and still in the first of every spell kind."""
    return reduce(Column.__and__, [F.col(s) < 2 for s in spells], F.col(first) > after)


def drop_left_censored(df: DataFrame, **kwargs) -> DataFrame:
    """Keep the rows that are definitely not left-censored."""
    return df.filter(~left_censored(**kwargs))


def first_appearance(df: DataFrame, out: str = "first_year", pid: str = "pid",
                     year: str = "year") -> DataFrame:
    return df.withColumn(out, F.min(year).over(whole(person_window(pid, year))))


def design(df: DataFrame, balanced: Sequence[int] | int | None = None,
           min_waves: int | None = None, min_consecutive: int | None = None,
           waves: Sequence[int] | None = None, pid: str = "pid",
           year: str = "year") -> DataFrame:
    """Panel design: present in all waves, in at least k waves, or in k waves in a row.

    ``balanced`` is the number of waves or their list. ``min_consecutive`` counts neighbouring
    entries of ``waves`` (consecutive years if omitted).
    """
    w = person_window(pid, year)
    if balanced is not None:
        n = balanced if isinstance(balanced, int) else len(balanced)
        kept = df.withColumn("__n", F.count(F.lit(1)).over(whole(w))).filter(F.col("__n") == n)
        return kept.drop("__n")
    if min_waves is not None:
        kept = df.withColumn("__n", F.count(F.lit(1)).over(whole(w)))
        return kept.filter(F.col("__n") >= min_waves).drop("__n")
    if min_consecutive is not None:
        if waves is None:
            position = F.col(year)
        else:
            position = F.array_position(F.array(*[F.lit(v) for v in sorted(waves)]), F.col(year))
        # rows of one run share position - row number
        run = position - F.row_number().over(w)
        df = df.withColumn("__run", run)
        in_run = Window.partitionBy(pid, "__run")
        df = df.withColumn("__len", F.count(F.lit(1)).over(in_run))
        df = df.withColumn("__max", F.max("__len").over(Window.partitionBy(pid)))
        return df.filter(F.col("__max") >= min_consecutive).drop("__run", "__len", "__max")
    return df


def drop_non_response(df: DataFrame, first_variable: str) -> DataFrame:
    """Drop persons-waves whose first requested household variable is missing."""
    return df.dropna(subset=[first_variable])


def one_row_per_wave(df: DataFrame, order: Sequence[str], pid: str = "pid",
                     year: str = "year") -> DataFrame:
    """Keep the first row per (person, wave) by ``order``.

    Spark limits each group to its first row on the map side (``WindowGroupLimit``), so a person
    with very many raw rows never meets in one task, and columns nobody reads are pruned. Every
    later person window holds at most one row per wave.
    """
    w = Window.partitionBy(pid, year).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")
