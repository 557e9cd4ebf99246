"""Spells, tenure and experience on hand-computed histories."""

import pytest
from conftest import values
from pyspark.sql import functions as F

from wavespan.operators import exposure, spells

N = None


@pytest.fixture(scope="module")
def history(frame):
    # unemployed at entry, two changes, an idle spell; person 2 never employed; person 3 steady
    return frame("pid long, year int, emp_status int, change_t boolean, change_24t boolean", [
        (1, 1982, 2, False, False), (1, 1983, 1, True, True), (1, 1984, 1, False, False),
        (1, 1985, 1, True, True), (1, 1986, 2, False, True), (1, 1987, N, False, False),
        (2, 1982, 2, True, True), (2, 1983, N, False, False),
        (3, 1982, 1, False, False), (3, 1983, 1, False, False)])


def test_employer_spells_intended(history):
    out = spells.employer_spells(history)
    assert values(out, "emp_spell") == [N, 1, 1, 2, 2, 2, 1, 1]
    assert values(out, "emp_spell_24t") == [N, 1, 1, 2, N, N, 1, 1]


def test_employer_spells_literal_uses_tolerant_flag(history):
    out = spells.employer_spells(history, semantics="as_coded")
    assert values(out, "emp_spell") == [N, 1, 1, 2, N, N, 1, 1]
    assert values(out, "emp_spell_24t") == [N, 1, 1, 1, 1, 1, 1, 1]


def test_late_era_opens_with_two(frame):
    df = frame("pid long, year int, emp_status int, change_t boolean, change_24t boolean", [
        (1, 1996, 1, False, False), (1, 1997, 1, True, True), (1, 1999, 1, False, False),
        (1, 2001, 1, True, True), (2, 1999, 2, False, False), (2, 2001, 1, False, False)])
    out = spells.employer_spells(df, late_era_from=1999)
    assert values(out, "emp_spell") == [1, 2, 4, 5, N, 2]


def test_code_spells(frame):
    df = frame("pid long, year int, emp_status int, code int, changed boolean", [
        (1, 1990, 2, 7, True), (1, 1991, 1, N, False), (1, 1992, 1, 7, False), (1, 1993, 1, 8, True),
        (1, 1994, 1, 8, N), (2, 1990, 2, N, False), (2, 1991, 2, N, False)])
    out = spells.code_spells(df, {"s": ("changed", "code")})
    assert values(out, "s") == [1, 1, 2, 3, 3, N, N]


def test_code_spells_late_changes_add_two(frame):
    df = frame("pid long, year int, emp_status int, code int, changed boolean", [
        (1, 1997, 1, 7, False), (1, 1999, 1, 8, True), (1, 2001, 1, 9, True)])
    out = spells.code_spells(df, {"s": ("changed", "code")}, late_era_from=1999)
    assert values(out, "s") == [1, 3, 5]


def test_spell_code_most_and_least_frequent(frame):
    df = frame("pid long, year int, spell int, code int", [
        (1, 1, 1, 5), (1, 2, 1, 5), (1, 3, 1, 9), (1, 4, 1, N), (1, 5, 2, 8), (1, 6, 2, 3),
        (1, 7, N, 4), (1, 8, 3, N)])
    most = spells.spell_code(df, "code", "spell", "m")
    least = spells.spell_code(df, "code", "spell", "m", semantics="as_coded")
    assert values(most, "m") == [5, 5, 5, 5, 3, 3, 4, N]
    assert values(least, "m") == [9, 9, 9, 9, 3, 3, 4, N]


def test_from_first_report(frame):
    df = frame("pid long, year int, tenure double", [
        (1, 1, N), (1, 2, 3.0), (1, 3, N), (2, 1, N), (2, 2, N)])
    assert values(spells.from_first_report(df), "pid", "year") == [(1, 2), (1, 3)]


EXPOSURE = "pid long, year int, emp_status int, hours int, tenure double, spell int"


@pytest.fixture(scope="module")
def worked(frame):
    return frame(EXPOSURE, [
        (1, 1978, 1, 2000, 3.0, 1), (1, 1979, 1, 2000, N, 1), (1, 1980, 1, 2000, N, 1),
        (1, 1981, 1, 2000, 6.0, 1), (1, 1982, 1, 2000, 7.0, 1), (1, 1983, 1, 700, N, 1),
        (1, 1984, 2, 2000, N, 1), (1, 1985, 1, 2000, 0.5, 2), (1, 1988, 1, 800, 1.0, 2)])


def test_employer_tenure_restarts_in_reset_year(worked):
    out = exposure.employer_tenure(worked, "spell")
    # nothing accrues 1979-1981; 1981 restarts at the report; short hours and no job add nothing
    assert values(out, "emp_tenure") == [3.0, 3.0, 3.0, 6.0, 7.0, 7.0, 7.0, 0.5, 3.5]


def test_employer_tenure_literal_adds_the_reset(worked):
    out = exposure.employer_tenure(worked, "spell", semantics="as_coded")
    assert values(out, "emp_tenure") == [3.0, 3.0, 3.0, 9.0, 10.0, 10.0, 10.0, 0.5, 3.5]


def test_employer_tenure_unknown_spell_is_its_own_group(frame):
    df = frame(EXPOSURE, [(1, 1982, 1, 900, 2.0, N), (1, 1983, 1, 900, N, N), (1, 1984, 1, 900, 1.0, 1)])
    assert values(exposure.employer_tenure(df, "spell"), "emp_tenure") == [2.0, 3.0, 1.0]


def test_code_experience(worked):
    out = exposure.code_experience(worked, "spell", "x")
    # the last wave of a spell and of the person never accrue; 1983 has short hours; 1982 accrues
    assert values(out, "x") == [3.0, 4.0, 5.0, 6.0, 7.0, 7.0, 7.0, 0.5, 0.5]


def test_code_experience_unknown_hours_poison(frame):
    df = frame(EXPOSURE, [
        (1, 1990, 1, 2000, 2.0, 1), (1, 1991, 1, N, N, 1), (1, 1992, 1, 2000, N, 1),
        (1, 1993, 1, 2000, N, 1)])
    assert values(exposure.code_experience(df, "spell", "x"), "x") == [2.0, N, N, N]


def test_code_experience_threshold_is_strict(frame):
    rows = [(1, 1990, 1, 2000, 2.0, 1), (1, 1991, 1, 800, N, 1), (1, 1992, 1, 800, N, 1)]
    df = frame(EXPOSURE, rows)
    assert values(exposure.code_experience(df, "spell", "x"), "x") == [2.0, 2.0, 2.0]
    assert values(exposure.code_experience(df, "spell", "x", min_hours=799), "x") == [2.0, 3.0, 3.0]


def test_work_experience_needs_reports(frame):
    df = frame("pid long, year int, emp_status int, hours int, work_exp double", [
        (1, 1974, 1, 2000, 5.0), (1, 1975, 1, 2000, 6.0), (1, 1976, 2, 2000, N), (1, 1977, 1, 2000, N),
        (1, 1978, 1, 2000, 9.0),
        (2, 1972, 1, 2000, 4.0), (2, 1974, 1, 2000, 5.0), (2, 1976, 1, 2000, 6.0)])
    # person 1: seed, +1, no job adds 0, a wave without a report is unknown from there on
    # person 2: the seed wave is not in the sum, and the first summed wave has no predecessor in it
    assert values(exposure.work_experience(df), "work_total") == [5.0, 6.0, 6.0, N, N, 4.0, N, N]


def test_on_job(worked):
    assert values(exposure.on_job(worked, "spell"), "on_job") == [0, 1, 1, 1, 1, 1, 1, 0, 1]


def test_demean_raises_the_mean(frame):
    df = frame("pid long, year int, spell int, x double", [
        (1, 1, 1, 1.0), (1, 2, 1, 3.0), (1, 3, 2, 5.0), (2, 1, 1, 1.0), (2, 2, 1, N)])
    out = exposure.demean(df, {"d": ("x", 1, 1), "d2": ("x", 2, 100), "d3": ("x", 3, 100)},
                          by=["pid", "spell"])
    assert values(out, "d", "d2", "d3") == [
        (-1.0, -300.0, -700.0), (1.0, 500.0, 1900.0), (0.0, 0.0, 0.0), (N, N, N), (N, N, N)]


def test_powers(frame):
    df = frame("pid long, year int, x double", [(1, 1, 2.0), (1, 2, N)])
    out = exposure.powers(df, {"x2": ("x", 2, 100), "x3": ("x", 3, 1)})
    assert values(out, "x2", "x3") == [(400.0, 8.0), (N, N)]


def test_chain_keeps_one_exchange_on_the_person(frame, spark):
    df = frame("pid long, year int, emp_status int, hours int, tenure double", [
        (p, 1990 + y, 1 + (p + y) % 2, 900, float(1 + (p * y) % 5)) for p in range(5) for y in range(6)])
    from wavespan.operators import change
    out = spells.from_first_report(spells.employer_spells(change.job_change(df)))
    out = exposure.on_job(exposure.employer_tenure(out))
    out = exposure.demean(out, {"d": ("emp_tenure", 1, 1)})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Exchange") == 1
    assert out.filter(F.abs("d") > 1e3).count() == 0
