"""End-to-end career analyses: sample, spells, exposure, regressions, descriptive table.

Two presets exist. The short panel covers the yearly waves 1968-1993; the long one covers
1968-2015 with two-year waves at the end and occupation and industry codes of two census schemes.

Input columns (after assembly and role collapse): ``pid, year, relation, sex, race, region, age,
grades, emp_status, hours, wage, tenure, work_exp, modality, government, union_covered, married``
plus ``occ3, ind3`` (short) or ``occ3_early/_late, ind3_early/_late, modality_early/_late,
government_early/_late`` (long).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespan.functions.na import is_one_of, known, person_window, value_at
from wavespan.operators import (INTENDED, change, check_semantics, dims, exposure, filters, recode,
                                regress, spells)
from wavespan.operators.change import DEFAULT_RULES, ChangeRules
from wavespan.operators.describe import describe
from wavespan.operators.recode import Recode
from wavespan.session import cut_lineage

# Fixed values of the survey and of the two samples.
PRICE_BASE_YEAR = 1979
NO_WAGE = (99.99,)
NO_WAGE_YEARS = (1968, 1971)
EDUCATION_YEARS = (1985, 1975, 1968)
SELF_EMPLOYED = (2, 3)
GOVERNMENT = (1,)
FARM_ARMY_SHORT = (580, 590, *range(800, 825))
FARM_ARMY_LONG = (9840, 6005, 6020, 6040, 6050)
REGION_UNKNOWN = (0, 5, 6, 9)
MARRIED = (1, 2, 3)
WORK_EXPERIENCE_UNKNOWN = (0, 99)
MODEL_YEARS_SHORT = (1981, 1993)
MODEL_YEARS_LONG = (1981, 2015)
TABLE_YEARS_SHORT = (1981, 1992)
TENURE_RULES_BEFORE_UNITS = (
    Recode("tenure", None, lo=1978, hi=1978),
    Recode("tenure", (0,)),
    Recode("tenure", (999,), lo=1976, hi=1993),
)
TENURE_MONTHS = (1976, 1993)
TENURE_RULES_AFTER_UNITS = (Recode("tenure", (98, 99), lo=1994),)


@dataclass(frozen=True)
class Preset:
    """What differs between the two panels."""

    name: str
    late_era_from: int | None
    accrual: tuple[tuple[int, int], ...]
    occ_code: str          # code compared for occupation changes
    ind_code: str
    occ_present: str       # code that must be present to open a spell
    ind_present: str
    education: str
    model_years: tuple[int, int]
    table_years: tuple[int, int] | None
    hours_flags: bool      # short hours and no income are flags until the regressions


SHORT = Preset("short", None, exposure.ACCRUAL_YEARS_SHORT, "occ3", "ind3", "occ3", "ind3",
               "education", MODEL_YEARS_SHORT, TABLE_YEARS_SHORT, hours_flags=False)
LONG = Preset("long", 1999, exposure.ACCRUAL_YEARS_LONG, "occ_common", "ind_common", "occ3",
              "ind3", "grades", MODEL_YEARS_LONG, None, hours_flags=True)


# --- sample ----------------------------------------------------------------------------------

def real_wage(panel: DataFrame, index: DataFrame, base_year: int = PRICE_BASE_YEAR) -> DataFrame:
    """Blank the "no wage" code in its waves and deflate: adds ``wage_real``."""
    rules = [Recode("wage", NO_WAGE, to=0.0, lo=y, hi=y) for y in NO_WAGE_YEARS]
    return recode.deflate(recode.recode(panel, rules), index, "wage", "wage_real", base_year)


def clean_tenure(panel: DataFrame) -> DataFrame:
    """Sentinel codes to NULL and months to years; bracket codes before 1976 stay."""
    df = panel.withColumn("tenure", F.col("tenure").cast("double"))
    df = recode.recode(df, TENURE_RULES_BEFORE_UNITS)
    df = recode.scale_in_era(df, "tenure", 12.0, *TENURE_MONTHS)
    return recode.recode(df, TENURE_RULES_AFTER_UNITS)


def pick_education(panel: DataFrame, years: Sequence[int] = EDUCATION_YEARS) -> DataFrame:
    """Latest usable report of completed grades, on every row of the person."""
    w = person_window()
    df = panel.withColumns({f"__edu_{y}": value_at("grades", y, w) for y in years})
    df = recode.pick_first_valid(df, "education", [f"__edu_{y}" for y in years])
    return df.drop(*[f"__edu_{y}" for y in years])


def _ever_flags(low: float = 0.0, high: float = 1.0) -> dict:
    wage = F.col("wage_real")
    return {
        "ever_government": is_one_of("government", GOVERNMENT),
        "ever_self_employed": is_one_of("modality", SELF_EMPLOYED),
        "low_wage": (wage > low) & (wage < high),
    }


def select_sample_short(panel: DataFrame, index: DataFrame, semantics: str = INTENDED,
                        base_year: int = PRICE_BASE_YEAR, years: tuple[int, int] = (1968, 1993),
                        education_years: Sequence[int] = EDUCATION_YEARS) -> DataFrame:
    """White male heads aged 18-64 in the continental regions, never in government, own business,
    farming or the army, never at a real wage below 1; rows with over 500 hours and an income.

    The person flags look at the rows that survive the demographic filter.
    """
    df = pick_education(filters.years(panel, *years), education_years)
    df = filters.demographics(df, race=(1,))
    df = real_wage(df, index, base_year)
    flags = _ever_flags() | {"ever_farm_army": is_one_of("occ3", FARM_ARMY_SHORT)}
    df = filters.exclude_persons(filters.person_flags(df, flags), list(flags))
    df = filters.work_flags(df, semantics=semantics)
    return clean_tenure(
        df.filter(~known(F.col("short_hours")) & ~known(F.col("no_income"))))


def select_sample_long(panel: DataFrame, index: DataFrame, occupations: DataFrame,
                       industries: DataFrame, semantics: str = INTENDED,
                       base_year: int = PRICE_BASE_YEAR) -> DataFrame:
    """As the short sample, for all races and waves to 2015, with common occupation and industry
    codes; few hours and no income remain flags.

    ``occupations`` has ``code_1970, code_2000, code_common, one_digit, ord`` and ``industries``
    the same columns. A column ``code_detail`` of the occupations, if there is one, is not shown
    but tells which of their rows are repeated.
    """
    literal = check_semantics(semantics)
    detail = [c for c in occupations.columns if c == "code_detail"]
    df = recode.era_coalesce(panel, {
        "occ3": ("occ3_early", "occ3_late", 2003), "ind3": ("ind3_early", "ind3_late", 2003)},
        until=2017)
    df = real_wage(df, index, base_year)
    df = recode.flag_in(df, "married", "married", MARRIED)
    df = recode.recode(df, [Recode("region", REGION_UNKNOWN)])
    df = filters.demographics(filters.years(df, exclude=(2017,)))
    df = recode.era_coalesce(df, {
        "government": ("government_early", "government_late", 2003),
        "modality": ("modality_early", "modality_late", 2003)})
    flags = _ever_flags()
    df = filters.exclude_persons(filters.person_flags(df, flags), list(flags))
    df = clean_tenure(filters.work_flags(df, semantics=semantics))
    df = recode.recode(df, [Recode("occ3", (0,)), Recode("ind3", (0,))])
    df = dims.harmonise_codes(
        df, "occ3", [(1968, 2001, occupations, "code_1970"), (2003, 2015, occupations, "code_2000")],
        {"occ_common": "code_common", "occ_one_digit": "one_digit"}, distinct_on=detail)
    farm_army = {"ever_farm_army": is_one_of("occ3" if literal else "occ_common", FARM_ARMY_LONG)}
    df = filters.exclude_persons(filters.person_flags(df, farm_army), ["ever_farm_army"])
    return dims.harmonise_codes(
        df, "ind3", [(1968, 2001, industries, "code_1970"), (2003, 2015, industries, "code_2000")],
        {"ind_common": "code_common", "ind_one_digit": "one_digit"}, zero_is_missing=["ind_common"])


# --- careers ---------------------------------------------------------------------------------

def career_changes(panel: DataFrame, preset: Preset = SHORT, rules: ChangeRules = DEFAULT_RULES,
                   semantics: str = INTENDED) -> DataFrame:
    """Job, occupation and industry change flags."""
    literal = check_semantics(semantics)
    df = panel
    if not literal:   # code 0 is no code, neither for changes nor for opening a spell
        df = recode.recode(df, [Recode(c, (0,)) for c in ("occ3", "ind3")])
    df = change.job_change(df, rules=rules, semantics=semantics)
    gates = {"{}_change": "change_t", "{}_change_24t": "change_24t"}
    return change.code_changes(df, {
        f"{kind}_change_unc": (code, {name.format(kind): flag for name, flag in gates.items()})
        for kind, code in (("occ", preset.occ_code), ("ind", preset.ind_code))
    }, zero_is_missing=not literal)


def career_spells(panel: DataFrame, preset: Preset = SHORT, semantics: str = INTENDED
                  ) -> DataFrame:
    """Employer spells, the cut at the first tenure report, occupation and industry spells."""
    df = spells.employer_spells(panel, late_era_from=preset.late_era_from, semantics=semantics)
    df = spells.from_first_report(df)
    df = spells.code_spells(df, {
        "occ_spell": ("occ_change", preset.occ_present),
        "ind_spell": ("ind_change", preset.ind_present),
        "occ_spell_24t": ("occ_change_24t", preset.occ_present),
        "ind_spell_24t": ("ind_change_24t", preset.ind_present),
    }, late_era_from=preset.late_era_from)
    return df


def career_exposure(panel: DataFrame, preset: Preset = SHORT, semantics: str = INTENDED
                    ) -> DataFrame:
    """Modal codes, tenure and experience, polynomial terms and deviations from spell means.

    First everything that looks at neighbouring waves, then one kind of spell after the other, so
    that each kind needs one sort. Deviations and terms of higher powers carry the factor 100.
    """
    codes = {"occ": preset.occ_code, "ind": preset.ind_code}
    suffixes = ("", "_24t")
    df = recode.recode(panel, [Recode("work_exp", WORK_EXPERIENCE_UNKNOWN)])
    df = exposure.person_columns(df, [f"{k}_spell{s}" for k in codes for s in suffixes])
    df = exposure.work_experience(df)
    df = exposure.demean(df, {
        "instr_work": ("work_total", 1, 1), "instr_work2": ("work_total", 2, 1),
        "instr_work3_100": ("work_total", 3, 100)}, by=["pid"], keep_means=True)
    terms: dict[str, tuple[str, int, float]] = {
        "work2": ("work_exp", 2, 1), "work3_100": ("work_exp", 3, 100)}
    for s in suffixes:
        spell, x = f"emp_spell{s}", f"emp_tenure{s}"
        df = exposure.tenure_total(df, spell, x, accrual=preset.accrual, semantics=semantics)
        df = exposure.on_job(df, spell, f"on_job{s}")
        df = exposure.demean(df, {
            f"instr_emp{s}": (x, 1, 1), f"instr_emp2_100{s}": (x, 2, 100),
            f"instr_oj{s}": (f"on_job{s}", 1, 1)}, by=["pid", spell],
            keep_means=True)
        terms[f"emp2_100{s}"] = (x, 2, 100)
        for kind, code in codes.items():
            spell, x = f"{kind}_spell{s}", f"{kind}_exp{s}"
            df = exposure.experience_total(df, spell, x)
            df = exposure.demean(df, {
                f"instr_{kind}{s}": (x, 1, 1), f"instr_{kind}2_100{s}": (x, 2, 100),
                f"instr_{kind}3_100{s}": (x, 3, 100)}, by=["pid", spell], keep_means=True)
            df = spells.spell_code(df, code, spell, f"{kind}_mode{s}", semantics=semantics)
            terms[f"{kind}2_100{s}"] = (x, 2, 100)
            terms[f"{kind}3_100{s}"] = (x, 3, 100)
    return exposure.powers(exposure.drop_person_columns(df), terms)


def careers(sample: DataFrame, preset: Preset = SHORT, rules: ChangeRules = DEFAULT_RULES,
            semantics: str = INTENDED, cut: bool = False) -> DataFrame:
    """The whole per-person chain after one exchange on the person key.

    ``cut`` checkpoints the spells before exposure is accumulated. That bounds the plan and what
    a lost executor makes Spark recompute, at the price of one more write and exchange.
    """
    df = career_spells(career_changes(sample, preset, rules, semantics), preset, semantics)
    return career_exposure(cut_lineage(df) if cut else df, preset, semantics)


def attach_hierarchies(panel: DataFrame, occupations: DataFrame, industries: DataFrame,
                       semantics: str = INTENDED) -> DataFrame:
    """Two- and one-digit codes; the literal reading keeps unused codes, not unmatched rows.

    ``occupations`` and ``industries`` have key columns ``occ3`` and ``ind3``.
    """
    how = "right" if check_semantics(semantics) else "left"
    df = dims.join_codes(panel, occupations, "occ3", "occ3", how)
    return dims.join_codes(df, industries, "ind3", "ind3", how)


# --- results ---------------------------------------------------------------------------------

WAGE_FACTORS = ("year", "region")
MODELS_SHORT = {
    "levels_reported": (("grades", "work_exp", "occ_exp_24t", "ind_exp_24t", "emp_tenure_24t",
                         "on_job_24t"), False),
    "levels": (("grades", "work_total", "occ_exp", "ind_exp", "emp_tenure", "on_job", "married"),
               False),
    "instruments": (("grades", "instr_work", "instr_occ", "instr_ind", "instr_emp", "on_job",
                     "married"), False),
    "instruments_uncensored": (("grades", "instr_work", "instr_occ", "instr_ind", "instr_emp",
                                "on_job", "married"), True),
}
MODELS_LONG = {
    "levels_reported": MODELS_SHORT["levels_reported"],
    "levels": MODELS_SHORT["levels"],
    "instruments": (("grades", "instr_work", "instr_occ_24t", "instr_ind_24t", "on_job_24t",
                     "married"), False),
    "instruments_uncensored": (("grades", "instr_work", "instr_occ_24t", "instr_ind_24t",
                                "on_job_24t", "married"), True),
}


def wage_rows(panel: DataFrame, preset: Preset, model: str) -> DataFrame:
    """Rows and log wage of one wage model."""
    models = MODELS_LONG if preset.name == "long" else MODELS_SHORT
    levels = preset.name == "long" and model.startswith("levels")
    lo, hi = MODEL_YEARS_SHORT if levels else preset.model_years
    df = filters.years(panel, lo, hi)
    if preset.hours_flags:
        df = df.filter(~known(F.col("short_hours")) & ~known(F.col("no_income")))
    if models[model][1]:
        df = filters.drop_left_censored(df)
    return recode.log_positive(df, "wage_real", "log_wage")


def wage_regression(panel: DataFrame, preset: Preset = SHORT, model: str = "levels",
                    factors: Sequence[str] = WAGE_FACTORS) -> DataFrame:
    """Coefficients of one wage model with wave and region dummies."""
    models = MODELS_LONG if preset.name == "long" else MODELS_SHORT
    return regress.ols(wage_rows(panel, preset, model), "log_wage", models[model][0], factors)


def table_rows(panel: DataFrame, preset: Preset = SHORT, order: Sequence[str] = ("year",)
               ) -> DataFrame:
    """Rows of the descriptive table: persons with a reliable triple, no left-censored spells."""
    df = panel if preset.table_years is None else filters.years(panel, *preset.table_years)
    df = filters.reliable_triples(df, order=list(order)).filter("reliable")
    df = filters.drop_left_censored(df)
    df = recode.dummy(df, "union_member", "union_covered", 1)
    return recode.dummy(df, "is_married", "married", 0, negate=True)


def descriptive_table(panel: DataFrame, preset: Preset = SHORT,
                      order: Sequence[str] = ("year",)) -> DataFrame:
    """Count, mean and standard deviation of the main variables."""
    return describe(table_rows(panel, preset, order), [
        "age", preset.education, "is_married", "union_member", "work_exp", "emp_tenure",
        "occ_exp", "occ_exp_24t", "ind_exp", "ind_exp_24t"])
