"""The variable series of the career analyses and the panel built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from wavespan.operators import INTENDED, assemble, check_semantics, recode
from wavespan.operators.assemble import Request
from wavespan.sources import files
from wavespan.sources.keys import WAVES

FIRST, LAST = WAVES[0], WAVES[-1]
# Fixed values, in declared order: a household that did not respond is told by the first of these
# variables that a wave has. Series, first and last year, one raw variable of the head's and the
# spouse's series, from which a crosswalk finds those of all other waves. Later rows of a series
# take precedence.
SERIES = [
    ("occ3_early", 1968, 1980, "V197_A", "V243_A"),
    ("occ3_early", 1981, 2017, "V7712", "V7885"),
    ("ind3_early", 1968, 1980, "V197_B", "V243_B"),
    ("ind3_early", 1981, 2017, "V7713", "V7886"),
    ("modality_early", 1968, 2017, "V198", "V6592"),
    ("hours", 1968, 2017, "V47", "V53"),
    ("week_hours_all", 1968, 2017, "ER4093", "ER4104"),
    ("occ3_late", 1968, 2017, "ER21145", "ER21395"),
    ("occ3_job1", 1968, 2017, "ER21201", "ER21451"),
    ("occ3_job2", 1968, 2017, "ER21233", "ER21483"),
    ("occ3_job3", 1968, 2017, "ER21265", "ER21515"),
    ("ind3_late", 1968, 2017, "ER21146", "ER21396"),
    ("ind3_job1", 1968, 2017, "ER21202", "ER21452"),
    ("ind3_job2", 1968, 2017, "ER21234", "ER21484"),
    ("ind3_job3", 1968, 2017, "ER21266", "ER21516"),
    ("modality_late", 1968, 2017, "ER21147", "ER21397"),
    ("modality_job1", 1968, 2017, "ER21203", "ER21453"),
    ("modality_job2", 1968, 2017, "ER21235", "ER21485"),
    ("modality_job3", 1968, 2017, "ER21267", "ER21517"),
    ("week_hours_late", 1968, 2017, "ER21176", "ER21426"),
    ("week_hours_job1", 1968, 2017, "ER21208", "ER21458"),
    ("week_hours_job2", 1968, 2017, "ER21240", "ER21490"),
    ("week_hours_job3", 1968, 2017, "ER21272", "ER21522"),
    ("week_hours_main", 1968, 2017, "V225", "V245"),
    ("wage_main", 1968, 2017, "V1297", "V6616"),
    ("union_covered", 1968, 2017, "V4478", "V4861"),
    ("union_belongs", 1968, 2017, "V4479", "V4862"),
    ("union_member", 1968, 2017, "V294", None),
    ("government_early", 1968, 2017, "V3971", "V4845"),
    ("government_late", 1968, 2017, "ER21149", "ER21399"),
    ("grades_role", 1968, 2017, "V313", "V246"),
    ("emp_status", 1968, 1996, "ER2068", "V4841"),
    ("emp_status", 1997, 2017, "ER25104", "ER25362"),
    ("wage", 1968, 2017, "V337", "V338"),
    ("tenure", 1968, 1993, "V200", None),
    ("tenure", 1969, 1975, "V642", None),
    ("tenure", 1994, 2017, "ER2098", None),
    ("region", 1968, 2017, "ER6997E", None),
    ("race", 1968, 2017, "V181", None),
    ("work_exp", 1968, 2017, "V3620", "V3610"),
    ("work_exp_full_time", 1968, 2017, "V3621", "V3611"),
]
HOUSEHOLD_SERIES = ("region", "race")   # of the household, not of head or spouse
PERSON_SERIES = {"grades": "ER30010", "age": "ER30004", "married": "ER30005"}
SEX_VARIABLE = "ER32000"        # one variable for all waves
SPOUSE_CODES = (20, 22)
WORK_SPOUSE_CODES = (2, 20, 22)
HEAD_ONLY = ("tenure",)         # the head's value stands for every member
BLANKED_FOR_SPOUSES = ("union_member",)
NOT_COLLAPSED = ("grades_role",)    # declared, but the person's own grades are used
SHORT_NAMES = {"occ3": "occ3_early", "ind3": "ind3_early", "modality": "modality_early",
               "government": "government_early"}

Row = tuple[str, str, int, int, int]


def household_rows() -> list[Row]:
    rows = []
    for step, (series, first, last, *seeds) in enumerate(SERIES):
        for role, seed in zip(("head", "spouse"), seeds):
            if seed is not None:
                name = series if series in HOUSEHOLD_SERIES else f"{series}_{role}"
                rows.append((name, seed, first, last, step))
    return rows


def person_rows() -> list[Row]:
    return [(name, seed, FIRST, LAST, 0) for name, seed in PERSON_SERIES.items()]


def specification(spark: SparkSession, rows: Sequence[Row]) -> DataFrame:
    return spark.createDataFrame(list(rows), "name string, seed string, lo int, hi int, step int")


def household_specification(spark: SparkSession) -> DataFrame:
    return specification(spark, household_rows())


def person_specification(spark: SparkSession) -> DataFrame:
    return specification(spark, person_rows())


def _complete(request: Request, years: Sequence[int], names: Sequence[str]) -> dict:
    """Every series in every wave, in declared order; None where a wave lacks it."""
    return {y: {n: request.get(y, {}).get(n) for n in names} for y in years}


def declared_requests(crosswalk: DataFrame, years: Sequence[int] = tuple(WAVES)
                      ) -> tuple[dict, dict]:
    """Household and person requests of the declared series, resolved with a crosswalk."""
    spark = crosswalk.sparkSession
    results = []
    for rows in (household_rows(), person_rows()):
        found = assemble.spliced_series(specification(spark, rows), crosswalk)
        names = list(dict.fromkeys(r[0] for r in rows))
        results.append(_complete(assemble.request_from_long(found), years, names))
    family, person = results
    for names in person.values():
        names["sex"] = SEX_VARIABLE
    return family, person


def role_pairs(semantics: str = INTENDED) -> dict[str, tuple[str, str]]:
    """Series -> (head column, spouse column).

    The literal reading takes the spouse's first extra job for the industry and weekly hours of
    the second and third one.
    """
    literal = check_semantics(semantics)
    names = dict.fromkeys(r[0] for r in SERIES if r[4] is not None and r[0] not in NOT_COLLAPSED)
    pairs = {n: (f"{n}_head", f"{n}_spouse") for n in names}
    if literal:
        for stem in ("ind3", "week_hours"):
            for job in ("job2", "job3"):
                pairs[f"{stem}_{job}"] = (f"{stem}_{job}_head", f"{stem}_job1_spouse")
    return pairs


def collapse_roles(panel: DataFrame, semantics: str = INTENDED) -> DataFrame:
    """Each person's own values from the head and spouse columns, which are dropped."""
    pairs = role_pairs(semantics)
    work = {n: pairs.pop(n) for n in ("work_exp", "work_exp_full_time")}
    df = recode.role_collapse(panel, pairs, spouse_codes=SPOUSE_CODES, drop=False)
    df = recode.role_collapse(df, work, spouse_codes=WORK_SPOUSE_CODES, drop=False)
    df = df.withColumnsRenamed({f"{n}_head": n for n in (*HEAD_ONLY, *BLANKED_FOR_SPOUSES)})
    df = recode.role_blank(df, BLANKED_FOR_SPOUSES, blank_for=SPOUSE_CODES)
    return recode.drop_matching(df, r"_(head|spouse)$")


def short_columns(panel: DataFrame) -> DataFrame:
    """Column names of the short preset: the series of the early waves are the only ones."""
    return panel.withColumnsRenamed({early: name for name, early in SHORT_NAMES.items()})


def survey_panel(spark: SparkSession, root: str, crosswalk: DataFrame,
                 years: Sequence[int] = tuple(WAVES), semantics: str = INTENDED) -> DataFrame:
    """All members of all waves in a landing zone, with the declared series, roles collapsed."""
    family_request, person_request = declared_requests(crosswalk, years)
    panel = assemble.build_panel(
        _families(spark, root, years), files.person_index(spark, root), family_request, person_request,
        design="all")
    return collapse_roles(panel, semantics)


def _families(spark: SparkSession, root: str, years: Sequence[int]):
    """All waves as one scan, or each for itself where they share no types."""
    scan = files.family_scan(spark, root, years)
    return files.family_waves(spark, root, years) if scan is None else scan


def core_heads_panel(spark: SparkSession, root: str, family_list: DataFrame,
                     person_list: DataFrame, wealth_list: DataFrame | None = None) -> DataFrame:
    """Heads of the core sample, all waves, from long variable lists."""
    family_request = assemble.request_from_long(family_list)
    wealth_request = assemble.request_from_long(wealth_list) if wealth_list is not None else None
    years = list(family_request)
    return assemble.build_panel(
        _families(spark, root, years), files.person_index(spark, root), family_request,
        assemble.request_from_long(person_list),
        wealth=files.wealth_waves(spark, root, years) if wealth_request else None,
        wealth_request=wealth_request, sample="SRC", heads="any", design="all")
