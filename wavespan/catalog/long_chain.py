"""The long chain to its end: exposures, modal codes, instruments, wage models, table.

The survey's seven waves are moved to years of both code schemes, before and after waves became
two years apart, and its persons are made heads of the sample, so that enough rows are left for
every model. The models without left-censored persons of the short chain use the same persons.
"""

from itertools import chain

from pyspark.sql import functions as F

from wavespan.catalog.adapter import rounded, sql_rounded
from wavespan.catalog.models import (_START, EXPOSURES, INSTRUMENTS, PRESET, RULES, SQL_CAREERS,
                                     SQL_EXPOSURES, SQL_INSTRUMENTS, SQL_LONG_SPELLS, LATE_ERA, TERMS,
                                     _fit, dummies_sql, least_squares_sql)
from wavespan.catalog.registry import query
from wavespan.catalog.samples import SQL_LONG, long_codes, long_columns, price_index, survey
from wavespan.plans import presets

#: Wave of the survey to year of the long panel.
MOVED = {1995: 1989, 1996: 1991, 1997: 1993, 1998: 2001, 1999: 2003, 2000: 2005, 2001: 2007}
BASE = 1997
WAVES = tuple(MOVED.values())
SPELLS = [f"{k}_spell{s}" for k in ("emp", "occ", "ind") for s in ("", "_24t")]
KINDS = {"occ": "occ_common", "ind": "ind_common"}

WIDE = """survey as (
    select * replace (1 as sex, 1 as race, 1 as relation, (1 + pid % 4)::int as region)
    from plain_survey),
"""


def _wide(sql: str) -> str:
    """``sql`` with all persons as heads of the sample."""
    at = sql.index("prices as (")
    return sql[:at].replace("survey as (", "plain_survey as (") + WIDE + sql[at:]


def _long_sql() -> str:
    case = "case year " + " ".join(f"when {a} then {b}" for a, b in MOVED.items()) + " end"
    sample = _wide(SQL_LONG).replace("select * replace (year + 4 as year)",
                                     f"select * replace (({case})::int as year), year as asked")
    sample = sample.replace("i.year = p.year - 4", "i.year = p.asked").replace(
        "case when tenure in (98, 99) then null else tenure end",
        "case when year <= 1993 then tenure / 12 else tenure end")
    since = presets.LONG.late_era_from
    spells = SQL_LONG_SPELLS.replace(f">= {LATE_ERA}", f">= {since}").replace(f"< {LATE_ERA}", f"< {since}")
    totals = SQL_EXPOSURES[_START:]
    return f"""{sample},
{spells},
code_spells as (
    select * exclude (since, first_report, work_exp),
           case when work_exp in (0, 99) then null else work_exp end as work_exp
    from coded),
{totals}"""


SQL_HISTORY = _long_sql()
SQL_LONG_INSTRUMENTS = SQL_HISTORY + SQL_INSTRUMENTS[len(SQL_EXPOSURES):]


def wide_survey(spark, sf_dir):
    return survey(spark, sf_dir).withColumns({
        "sex": F.lit(1), "race": F.lit(1), "relation": F.lit(1),
        "region": (1 + F.col("pid") % 4).cast("int")})


def moved(column):
    years = F.create_map(*[F.lit(y) for y in chain.from_iterable(MOVED.items())])
    return F.element_at(years, F.col(column))


def history(spark, sf_dir):
    """Careers of the long preset over the moved waves."""
    panel = long_columns(wide_survey(spark, sf_dir)).withColumn("year", moved("year"))
    index = price_index(spark, sf_dir).withColumn("year", moved("year"))
    codes = long_codes(spark, sf_dir)
    sample = presets.select_sample_long(panel, index, codes, codes, base_year=MOVED[BASE])
    return presets.careers(sample, presets.LONG, RULES)


@query("careers_long_exposures", f"""
with {SQL_HISTORY}
select pid, year, {", ".join(SPELLS)}, on_job, on_job_24t,
       {", ".join(f"{sql_rounded(c)} as {c}" for c in EXPOSURES)},
       {", ".join(f"{sql_rounded(e, 3)} as {c}" for c, e in TERMS.items())}
from totals""")
def careers_long_exposures(spark, sf_dir):
    """All spells, tenures, experiences and polynomial terms of the long chain."""
    return history(spark, sf_dir).select(
        "pid", "year", *SPELLS, "on_job", "on_job_24t", *[rounded(c).alias(c) for c in EXPOSURES],
        *[rounded(c, 3).alias(c) for c in TERMS])


def _modal_sql(kind: str, suffix: str) -> str:
    spell, code = f"{kind}_spell{suffix}", KINDS[kind]
    return f"""
{kind}_modes{suffix} as (
    select pid, spell, code from (
        select pid, {spell} as spell, {code} as code,
               row_number() over (partition by pid, {spell} order by count(*) desc, {code}) as rn
        from totals where {code} is not null group by pid, {spell}, {code})
    where rn = 1)"""


MODES = [(k, s) for k in KINDS for s in ("", "_24t")]


@query("careers_long_modal_codes", f"""
with {SQL_HISTORY},
{",".join(_modal_sql(k, s) for k, s in MODES)}
select t.pid, t.year, {", ".join(f"{k}{s}.code as {k}_mode{s}" for k, s in MODES)}
from totals t
{" ".join(f'''left join {k}_modes{s} {k}{s} on {k}{s}.pid = t.pid
     and {k}{s}.spell is not distinct from t.{k}_spell{s}''' for k, s in MODES)}""")
def careers_long_modal_codes(spark, sf_dir):
    """The most frequent common code of every spell."""
    return history(spark, sf_dir).select("pid", "year", *[f"{k}_mode{s}" for k, s in MODES])


@query("careers_long_instruments", f"""
with {SQL_LONG_INSTRUMENTS}
select pid, year, {", ".join(f"{sql_rounded(c, 3)} as {c}" for c in INSTRUMENTS)}
from full_careers""")
def careers_long_instruments(spark, sf_dir):
    """All instrument columns of the long chain."""
    return history(spark, sf_dir).select(
        "pid", "year", *[rounded(c, 3).alias(c) for c in INSTRUMENTS])


UNCENSORED = "not (first_year > 1980 and occ_spell < 2 and ind_spell < 2)"
SQL_TABLE = {"age": "age", "grades": "grades", "is_married": "case when married = 0 then 0 else 1 end",
             "union_member": "union_covered", **{c: c for c in (
                 "work_exp", "emp_tenure", "occ_exp", "occ_exp_24t", "ind_exp", "ind_exp_24t")}}


@query("careers_long_table", f"""
with {SQL_HISTORY},
triples as (
    select *, coalesce(emp_status = 1 and lag(emp_status) over w = 1
                       and lead(emp_status) over w = 1, false) as triple
    from totals window w as (partition by pid order by year)),
chosen as (
    select * from (select *, bool_or(triple) over (partition by pid) as reliable from triples)
    where reliable and {UNCENSORED})
{" union all ".join(
    f"select '{name}' as variable, count({sql}) as n, {sql_rounded(f'avg({sql})', 5)} as mean, "
    f"{sql_rounded(f'stddev_samp({sql})', 5)} as sd from chosen" for name, sql in SQL_TABLE.items())}""")
def careers_long_table(spark, sf_dir):
    """Descriptive table of the long chain."""
    return presets.descriptive_table(history(spark, sf_dir), presets.LONG).select(
        "variable", "n", rounded("mean", 5).alias("mean"), rounded("sd", 5).alias("sd"))


def _model_sql(careers: str, chosen: str, terms, waves) -> str:
    """The model's coefficients; waves without a row have none, and the first with rows is the
    reference."""
    years = {f"year_{y}": f"(year = {y} and year > (select min(year) from chosen))::int" for y in waves}
    return f"""
select * from (
    with {careers},
    chosen as (select * from full_careers where {chosen}),
    {least_squares_sql("chosen", "ln(wage_real)", {
        "(Intercept)": "1", **{t: t for t in terms}, **years, **dummies_sql("region", range(1, 5))}, 4)})
where estimate is not null or not starts_with(term, 'year_')"""


def _long_model_sql(model: str) -> str:
    terms, uncensored = presets.MODELS_LONG[model]
    lo, hi = presets.MODEL_YEARS_SHORT if model.startswith("levels") else presets.LONG.model_years
    chosen = f"year between {lo} and {hi} and wage_real > 0 and not coalesce(short_hours, false) " \
             "and not coalesce(no_income, false)" + (f" and {UNCENSORED}" if uncensored else "")
    return _model_sql(SQL_LONG_INSTRUMENTS, chosen, terms, WAVES)


def _register_model(model: str) -> None:
    @query(f"wage_model_long_{model}", _long_model_sql(model))
    def wage_model(spark, sf_dir):
        return _fit(presets.wage_regression(history(spark, sf_dir), presets.LONG, model), 4)


for _model in presets.MODELS_LONG:
    _register_model(_model)


@query("wage_model_instruments_uncensored", _model_sql(
    _wide(SQL_INSTRUMENTS), UNCENSORED, presets.MODELS_SHORT["instruments_uncensored"][0],
    range(1995, 2002)))
def wage_model_instruments_uncensored(spark, sf_dir):
    """The short chain's model without left-censored persons."""
    sample = presets.select_sample_short(
        wide_survey(spark, sf_dir), price_index(spark, sf_dir), base_year=BASE, years=(1995, 2001),
        education_years=(2000, 1998, 1996))
    careers = presets.careers(sample, PRESET, RULES)
    return _fit(presets.wage_regression(careers, PRESET, "instruments_uncensored"), 4)
