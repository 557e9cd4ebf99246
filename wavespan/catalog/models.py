"""Regressions and the end-to-end career analyses."""

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from wavespan.catalog.adapter import (SQL_CODES_ON_SPELLS, SQL_PANEL, SQL_SPELLS,
                                      SQL_SPELLS_ON_CHANGES, panel, rounded, spelled_panel,
                                      sql_changes, sql_rounded, table)
from wavespan.catalog.registry import query
from wavespan.catalog.samples import SQL_LONG, SQL_SURVEY, long_sample, price_index, survey
from wavespan.operators import absorb, exposure, recode, regress
from wavespan.operators.change import ChangeRules
from wavespan.plans import presets
from wavespan.session import shared_folder
from wavespan.sources import files


def two_regressor_sql(source: str, y: str, a: str, b: str, by: str, digits: int = 6) -> str:
    """Least squares on two regressors with one absorbed factor, by Cramer's rule."""
    return f"""
complete as (select {by} as g, {y}::double as y, {a}::double as a, {b}::double as b from {source}
             where {y} is not null and {a} is not null and {b} is not null),
centred as (
    select g, y, y - avg(y) over (partition by g) as dy, a - avg(a) over (partition by g) as da,
           b - avg(b) over (partition by g) as db from complete),
sums as (
    select sum(dy * dy) as yy, sum(da * dy) as ay, sum(db * dy) as by_, sum(da * da) as aa,
           sum(db * db) as bb, sum(da * db) as ab, count(*) as n, count(distinct g) as k,
           var_pop(y) * count(*) as total from centred),
solved as (
    select *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) as beta_a,
           (by_ * aa - ay * ab) / (aa * bb - ab * ab) as beta_b, n - k - 2 as dof from sums),
scaled as (
    select *, yy - beta_a * ay - beta_b * by_ as rss,
           (yy - beta_a * ay - beta_b * by_) / dof as s2 from solved),
coefficients as (
    select '{a}' as term, beta_a as estimate, sqrt(s2 * bb / (aa * bb - ab * ab)) as std_error,
           n, dof, 1 - rss / total as r2 from scaled
    union all
    select '{b}', beta_b, sqrt(s2 * aa / (aa * bb - ab * ab)), n, dof, 1 - rss / total from scaled)
select term, {sql_rounded("estimate", digits)} as estimate,
       {sql_rounded("std_error", digits)} as std_error,
       {sql_rounded("estimate / std_error", 4)} as t_value, n, dof, {sql_rounded("r2")} as r2
from coefficients"""


def _shown(coefficients, digits=6):
    return coefficients.select(
        "term", rounded("estimate", digits).alias("estimate"),
        rounded("std_error", digits).alias("std_error"), rounded("t_value", 4).alias("t_value"),
        "n", "dof", rounded("r2").alias("r2"))


SQL_LINES = """
lines as (select year(l_shipdate)::int as year, ln(l_extendedprice) as log_price,
                 l_quantity as quantity, l_discount as discount
          from lineitem where l_extendedprice > 0)"""


def _lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("year"), "l_extendedprice", F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"))
    return recode.log_positive(lines, "l_extendedprice", "log_price")


@query("ols_within_year", f"""
with {SQL_LINES},
centred as (
    select year, log_price - avg(log_price) over (partition by year) as dy,
           quantity - avg(quantity) over (partition by year) as dx from lines)
select {sql_rounded("regr_slope(dy, dx)", 8)} as slope, count(*) as n,
       count(distinct year) as groups
from centred""")
def ols_within_year(spark, sf_dir):
    slope = regress.within_slope(_lines(spark, sf_dir), "log_price", "quantity", "year")
    return slope.select(rounded("slope", 8).alias("slope"), "n", "groups")


@query("ols_absorbed", f"""
with {SQL_LINES},{two_regressor_sql("lines", "log_price", "quantity", "discount", "year")}""")
def ols_absorbed(spark, sf_dir):
    return _shown(regress.within_ols(_lines(spark, sf_dir), "log_price", ["quantity", "discount"],
                                     "year"))


@query("ols_absorbed_collinear", f"""
with {SQL_LINES},
doubled as (select *, quantity * 2 + 1 as twice from lines),{two_regressor_sql("doubled", "log_price", "quantity", "discount", "year")}
union all
select 'twice', null, null, null, max(n), max(dof), {sql_rounded("max(1 - rss / total)")} from scaled""")
def ols_absorbed_collinear(spark, sf_dir):
    """A regressor that an earlier one explains has no coefficient."""
    lines = _lines(spark, sf_dir).withColumn("twice", F.col("quantity") * 2 + 1)
    return _shown(regress.within_ols(lines, "log_price", ["quantity", "twice", "discount"], "year"))


@query("ols_absorbed_pair", f"""
with lines as (select ln(l_extendedprice) as y, l_quantity::double as x, l_partkey as part,
                      (l_linestatus = 'O')::int::double as d from lineitem),
apart as (select y - avg(y) over p as y, x - avg(x) over p as x, d - avg(d) over p as d, part,
                 max(d) over p > min(d) over p as meets, y - avg(y) over () as from_mean
          from lines window p as (partition by part)),
s as (select count(*) as n, sum(x * x) as xx, sum(x * d) as xd, sum(d * d) as dd, sum(x * y) as xy,
             sum(d * y) as dy, sum(y * y) as yy, sum(from_mean * from_mean) as total,
             count(*) - count(distinct part) - (case when bool_or(meets) then 1 else 0 end) - 1 as dof
      from apart),
fit as (select *, xx * dd - xd * xd as det, (xy * dd - dy * xd) / (xx * dd - xd * xd) as b,
               (dy * xx - xy * xd) / (xx * dd - xd * xd) as g from s)
select 'quantity' as term, {sql_rounded("b", 8)} as estimate,
       {sql_rounded("sqrt((yy - b * xy - g * dy) / dof * dd / det)", 8)} as std_error, n, dof,
       {sql_rounded("1 - (yy - b * xy - g * dy) / total", 8)} as r2
from fit""")
def ols_absorbed_pair(spark, sf_dir):
    """Two factors taken out, one with as many levels as there are parts."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.log("l_extendedprice").alias("log_price"), F.col("l_quantity").alias("quantity"),
        "l_partkey", "l_linestatus")
    fit = absorb.absorbed_ols(lines, "log_price", ["quantity"], ["l_linestatus", "l_partkey"])
    return fit.select("term", rounded("estimate", 8).alias("estimate"),
                      rounded("std_error", 8).alias("std_error"), "n", "dof",
                      rounded("r2", 8).alias("r2"))


@query("ols_full", f"""
with {SQL_PANEL},
rows_ as (select *, ln(wage) as log_wage from panel where wage > 0),
{two_regressor_sql("rows_", "log_wage", "tenure", "age", "year")}""")
def ols_full(spark, sf_dir):
    """Slope rows of the regression with wave dummies."""
    df = recode.log_positive(panel(spark, sf_dir), "wage", "log_wage")
    fit = regress.ols(df, "log_wage", ["tenure", "age"], ["year"])
    return _shown(fit.filter(F.col("term").isin("tenure", "age")))


def least_squares_sql(source: str, y: str, terms: dict[str, str], digits: int = 6) -> str:
    """All coefficients of a regression, by successive orthogonalisation.

    ``terms`` maps names to SQL expressions (a constant among them). Each step removes the current
    regressor from the later ones and from the response; the coefficients follow backwards.
    """
    k = len(terms)
    names, expressions = list(terms), list(terms.values())
    ctes = [f"z0 as (select {y}::double as y, " + ", ".join(
        f"({e})::double as x{i}" for i, e in enumerate(expressions)) +
        f" from {source} where " + " and ".join(f"({e}) is not null" for e in (y, *expressions)) + ")"]
    loadings = []
    for j in range(k):
        later = [f"x{l}" for l in range(j + 1, k)]
        # a regressor without a rest of its own is aliased: it takes no part and has no coefficient
        own = f"sum(x{j} * x{j}) > 1e-9"
        ctes.append(f"g{j} as (select {own} as own, case when {own} then sum(x{j} * y) / "
                    f"sum(x{j} * x{j}) else 0 end as a" + "".join(
                        f", case when {own} then sum(x{j} * {c}) / sum(x{j} * x{j}) else 0 end as {c}"
                        for c in later) + f" from z{j})")
        ctes.append(f"z{j + 1} as (select z.y - g.a * z.x{j} as y" + "".join(
            f", z.{c} - g.{c} * z.x{j} as {c}" for c in later) + f" from z{j} z, g{j} g)")
        loadings.append(later)
    ctes.append(f"b{k} as (select 0 as rank)")
    for j in reversed(range(k)):
        rest = "".join(f" - g.{c} * p.beta{c[1:]}" for c in loadings[j])
        ctes.append(f"b{j} as (select p.* exclude (rank), p.rank + g.own::int as rank, "
                    f"case when g.own then g.a{rest} else 0 end as beta{j}, g.own as own{j} "
                    f"from b{j + 1} p, g{j} g)")
    ctes.append(f"fit as (select (select count(*) from z0) as n, 1 - (select sum(y * y) from z{k})"
                " / (select var_pop(y) * count(*) from z0) as r2)")
    rows = " union all ".join(f"select '{n}' as term, case when own{i} then beta{i} end as estimate, "
                              "rank from b0" for i, n in enumerate(names))
    return ",\n".join(ctes) + f"""
select term, {sql_rounded("estimate", digits)} as estimate, n, n - rank as dof,
       {sql_rounded("r2")} as r2
from ({rows}), fit"""


def dummies_sql(column: str, levels) -> dict[str, str]:
    """0/1 terms of a factor without its first level."""
    return {f"{column}_{v}": f"({column} = {v})::int" for v in list(levels)[1:]}


def _fit(coefficients, digits=6):
    return coefficients.select("term", rounded("estimate", digits).alias("estimate"), "n", "dof",
                               rounded("r2").alias("r2"))


@query("ols_dummies", f"""
with {SQL_PANEL},
{least_squares_sql("panel", "ln(wage)", {
    "(Intercept)": "1", **dummies_sql("year", range(1995, 2002)), **dummies_sql("region", range(5)),
    "tenure": "tenure", "age": "age", "hours": "hours"})}""")
def ols_dummies(spark, sf_dir):
    """All coefficients, with wave and region dummies and intercept."""
    df = recode.log_positive(panel(spark, sf_dir, region=True), "wage", "log_wage")
    return _fit(regress.ols(df, "log_wage", ["tenure", "age", "hours"], ["year", "region"]))


@query("gls_instruments", f"""
with {SQL_SPELLS},
deviations as (
    select *, case when count(*) filter (where tenure is null) over w = 0
                   then tenure - avg(tenure) over w end as instr_tenure,
           ln(wage) as log_wage, hours - avg(hours) over (partition by pid) as instr_hours
    from spells window w as (partition by pid, emp_spell)),
{two_regressor_sql("deviations", "log_wage", "instr_tenure", "instr_hours", "year")}""")
def gls_instruments(spark, sf_dir):
    df = recode.log_positive(spelled_panel(spark, sf_dir), "wage", "log_wage")
    df = exposure.demean(df, {"instr_tenure": ("tenure", 1, 1)})
    df = exposure.demean(df, {"instr_hours": ("hours", 1, 1)}, by=["pid"])
    fit = regress.ols(df, "log_wage", ["instr_tenure", "instr_hours"], ["year"])
    return _shown(fit.filter(F.col("term").startswith("instr_")))


@query("gls_all_terms", f"""
with {SQL_SPELLS},
deviations as (
    select *, case when count(*) filter (where tenure is null) over w = 0
                   then tenure - avg(tenure) over w end as instr_tenure,
           hours - avg(hours) over (partition by pid) as instr_hours
    from spells window w as (partition by pid, emp_spell)),
{least_squares_sql("deviations", "ln(wage)", {
    "(Intercept)": "1", "instr_tenure": "instr_tenure", "instr_hours": "instr_hours",
    **dummies_sql("year", range(1995, 2002))})}""")
def gls_all_terms(spark, sf_dir):
    """As ``gls_instruments``, with the intercept and the wave dummies."""
    df = recode.log_positive(spelled_panel(spark, sf_dir), "wage", "log_wage")
    df = exposure.demean(df, {"instr_tenure": ("tenure", 1, 1)})
    df = exposure.demean(df, {"instr_hours": ("hours", 1, 1)}, by=["pid"])
    return _fit(regress.ols(df, "log_wage", ["instr_tenure", "instr_hours"], ["year"]))


@query("ols_full_all_terms", f"""
with {SQL_PANEL},
{least_squares_sql("panel", "case when wage > 0 then ln(wage) end", {
    "(Intercept)": "1", "tenure": "tenure", "age": "age", **dummies_sql("year", range(1995, 2002))})}""")
def ols_full_all_terms(spark, sf_dir):
    df = recode.log_positive(panel(spark, sf_dir), "wage", "log_wage")
    return _fit(regress.ols(df, "log_wage", ["tenure", "age"], ["year"]))


# --- end to end ------------------------------------------------------------------------------

PRESET = replace(presets.SHORT, accrual=((1982, 2015),), model_years=(1995, 2001),
                 table_years=(1995, 2001))
RULES = ChangeRules(tolerance=1.0)

SQL_CAREERS = f"""{SQL_SURVEY},
picked as (
    select *, coalesce(nullif(max(case when year = 2000 then grades end) over (partition by pid), 0),
                       nullif(max(case when year = 1998 then grades end) over (partition by pid), 0),
                       nullif(max(case when year = 1996 then grades end) over (partition by pid), 0))
               as education
    from survey),
kept as (
    select p.*, wage * (select max(value) from prices where year = 1997) / value as wage_real
    from picked p left join prices i on i.year = p.year
    where sex = 1 and race = 1 and relation in (1, 10) and age between 18 and 64
      and region in (1, 2, 3, 4)),
flagged as (
    select *, bool_or(government = 1) over w as ever_government,
           bool_or(modality in (2, 3)) over w as ever_self_employed,
           bool_or(wage_real > 0 and wage_real < 1) over w as low_wage
    from kept window w as (partition by pid)),
sample as (
    select * replace (case when tenure in (98, 99) then null else tenure end as tenure,
                      case when work_exp in (0, 99) then null else work_exp end as work_exp)
    from flagged
    where not ever_government and not ever_self_employed and not coalesce(low_wage, false)
      and not coalesce(hours <= 500, false) and wage_real <> 0),
{sql_changes("sample", RULES.tolerance)},
{SQL_SPELLS_ON_CHANGES},
{SQL_CODES_ON_SPELLS},
spaced as (
    select *, year - lag(year) over w as since, year = min(year) over (partition by pid) as entry,
           coalesce(lead(emp_status) over w = 1 and lead(occ_spell) over w = occ_spell, false)
               as stays,
           coalesce(lead(emp_status) over w = 1 and lead(ind_spell) over w = ind_spell, false)
               as ind_stays
    from code_spells window w as (partition by pid order by year)),
stepped as (
    select *, case when tenure is not null
                        and year = min(case when tenure is not null then year end)
                                   over (partition by pid, emp_spell) then tenure
                   when emp_status = 1 and hours >= 800 then coalesce(since, 0) else 0 end as t_step,
           case when occ_spell > 1 and year = min(year) over (partition by pid, occ_spell) then 0.5
                when not entry and hours > 800 and stays then since
                when entry then tenure else 0 end::double as o_step,
           case when ind_spell > 1 and year = min(year) over (partition by pid, ind_spell) then 0.5
                when not entry and hours > 800 and ind_stays then since
                when entry then tenure else 0 end::double as i_step,
           case when work_exp is not null
                then min(case when work_exp is not null then year end) over (partition by pid) end
               as seed_year
    from spaced),
worked as (
    select *, case when work_exp is not null and year = seed_year then work_exp
                   else case when coalesce(emp_status = 1, false) and hours >= 800
                                  and year > seed_year then since
                             when not (coalesce(emp_status = 1, false) and hours >= 800
                                       and year > seed_year) then 0 end end as w_step
    from stepped),
exposed as (
    select *, sum(t_step) over (partition by pid, emp_spell order by year
                                rows unbounded preceding) as emp_tenure,
           case when sum((o_step is null)::int) over (partition by pid, occ_spell order by year
                                                      rows unbounded preceding) = 0
                then sum(o_step) over (partition by pid, occ_spell order by year
                                       rows unbounded preceding) end as occ_exp,
           case when sum((i_step is null)::int) over (partition by pid, ind_spell order by year
                                                      rows unbounded preceding) = 0
                then sum(i_step) over (partition by pid, ind_spell order by year
                                       rows unbounded preceding) end as ind_exp,
           case when sum((w_step is null)::int) over (partition by pid order by year
                                                      rows unbounded preceding) = 0
                then sum(w_step) over (partition by pid order by year
                                       rows unbounded preceding) end as work_total,
           case when year = min(year) over (partition by pid, emp_spell) then 0 else 1 end as on_job
    from worked)"""


def careers_sample(spark, sf_dir):
    return presets.select_sample_short(
        survey(spark, sf_dir), price_index(spark, sf_dir), base_year=1997, years=(1995, 2001),
        education_years=(2000, 1998, 1996))


def careers(spark, sf_dir):
    return presets.careers(careers_sample(spark, sf_dir), PRESET, RULES)


@query("careers_end_to_end", f"""
with {SQL_CAREERS}
select pid, year, emp_spell, emp_spell_24t, occ_spell, ind_spell_24t, on_job,
       {sql_rounded("emp_tenure")} as emp_tenure, {sql_rounded("occ_exp")} as occ_exp,
       {sql_rounded("work_total")} as work_total,
       {sql_rounded("emp_tenure - avg(emp_tenure) over (partition by pid, emp_spell)", 5)}
           as instr_emp
from exposed""")
def careers_end_to_end(spark, sf_dir):
    """Sample, changes, spells, exposure and instruments in one chain."""
    return careers(spark, sf_dir).select(
        "pid", "year", "emp_spell", "emp_spell_24t", "occ_spell", "ind_spell_24t", "on_job",
        rounded("emp_tenure").alias("emp_tenure"), rounded("occ_exp").alias("occ_exp"),
        rounded("work_total").alias("work_total"), rounded("instr_emp", 5).alias("instr_emp"))


SQL_TABLE_VARIABLES = {
    "age": "age", "education": "education", "is_married": "case when married = 0 then 0 else 1 end",
    "union_member": "union_covered", "work_exp": "work_exp", "emp_tenure": "emp_tenure",
    "occ_exp": "occ_exp"}


@query("careers_table", f"""
with {SQL_CAREERS},
triples as (
    select *, coalesce(emp_status = 1 and lag(emp_status) over w = 1
                       and lead(emp_status) over w = 1, false) as triple
    from exposed window w as (partition by pid order by year)),
chosen as (
    select * from (select *, bool_or(triple) over (partition by pid) as reliable from triples)
    where reliable and not (first_year > 1980 and occ_spell < 2 and ind_spell < 2))
{" union all ".join(
    f"select '{name}' as variable, count({sql}) as n, {sql_rounded(f'avg({sql})', 5)} as mean, "
    f"{sql_rounded(f'stddev_samp({sql})', 5)} as sd from chosen"
    for name, sql in SQL_TABLE_VARIABLES.items())}""")
def careers_table(spark, sf_dir):
    """Descriptive table of the analysis rows."""
    result = presets.descriptive_table(careers(spark, sf_dir), PRESET)
    return result.filter(F.col("variable").isin(*SQL_TABLE_VARIABLES)).select(
        "variable", "n", rounded("mean", 5).alias("mean"), rounded("sd", 5).alias("sd"))


@query("careers_wage_model", f"""
with {SQL_CAREERS},
instruments as (
    select *, emp_tenure - avg(emp_tenure) over (partition by pid, emp_spell) as instr_emp,
           occ_exp - avg(occ_exp) over (partition by pid, occ_spell) as instr_occ,
           ind_exp - avg(ind_exp) over (partition by pid, ind_spell) as instr_ind,
           case when count(*) filter (where work_total is null) over (partition by pid) = 0
                then work_total - avg(work_total) over (partition by pid) end as instr_work
    from exposed),
{least_squares_sql("instruments", "ln(wage_real)", {
    "(Intercept)": "1", "grades": "grades", "instr_work": "instr_work", "instr_occ": "instr_occ",
    "instr_ind": "instr_ind", "instr_emp": "instr_emp", "on_job": "on_job", "married": "married",
    **dummies_sql("year", range(1995, 2002)), **dummies_sql("region", range(1, 5))},
    4)}""")
def careers_wage_model(spark, sf_dir):
    """Wage model on demeaned exposure with wave and region dummies; NULL where aliased."""
    return _fit(presets.wage_regression(careers(spark, sf_dir), PRESET, "instruments"), 4)


# every exposure of both kinds of spells: the tolerant ones by the same statements
_START = SQL_CAREERS.index("spaced as (")
_TOLERANT = SQL_CAREERS[_START:]
for _name in ("emp_spell", "occ_spell", "ind_spell"):
    _TOLERANT = _TOLERANT.replace(_name, f"{_name}_24t")
for _name in ("spaced", "stepped", "worked", "exposed"):
    _TOLERANT = _TOLERANT.replace(_name, f"{_name}_24t")
_TOTALS = ("emp_tenure", "occ_exp", "ind_exp", "on_job")
SQL_EXPOSURES = f"""{SQL_CAREERS},
{_TOLERANT},
totals as (
    select e.*, {", ".join(f"t.{c} as {c}_24t" for c in _TOTALS)}
    from exposed e join exposed_24t t on t.pid = e.pid and t.year = e.year)"""


def _deviation_sql(out: str, x: str, power: int, factor: int, by: str) -> str:
    """Deviation from the spell's mean, NULL if one of its waves is unknown."""
    mean = f"avg({x}::double) over (partition by {by})"
    return (f"case when count(*) filter (where {x} is null) over (partition by {by}) = 0 then "
            f"({' * '.join([f'{x}::double'] * power)} - {' * '.join([mean] * power)}) * {factor} end "
            f"as {out}")


def _instruments() -> dict[str, tuple[str, int, int, str]]:
    found = {"instr_work": ("work_total", 1, 1, "pid"), "instr_work2": ("work_total", 2, 1, "pid"),
             "instr_work3_100": ("work_total", 3, 100, "pid")}
    for s in ("", "_24t"):
        by = f"pid, emp_spell{s}"
        found |= {f"instr_emp{s}": (f"emp_tenure{s}", 1, 1, by),
                  f"instr_emp2_100{s}": (f"emp_tenure{s}", 2, 100, by),
                  f"instr_oj{s}": (f"on_job{s}", 1, 1, by)}
        for kind in ("occ", "ind"):
            by = f"pid, {kind}_spell{s}"
            found |= {f"instr_{kind}{s}": (f"{kind}_exp{s}", 1, 1, by),
                      f"instr_{kind}2_100{s}": (f"{kind}_exp{s}", 2, 100, by),
                      f"instr_{kind}3_100{s}": (f"{kind}_exp{s}", 3, 100, by)}
    return found


INSTRUMENTS = _instruments()
TERMS = {"work2": "work_exp * work_exp", "work3_100": "work_exp * work_exp * work_exp * 100"}
for _s in ("", "_24t"):
    TERMS[f"emp2_100{_s}"] = f"emp_tenure{_s} * emp_tenure{_s} * 100"
    for _k in ("occ", "ind"):
        TERMS[f"{_k}2_100{_s}"] = f"{_k}_exp{_s} * {_k}_exp{_s} * 100"
        TERMS[f"{_k}3_100{_s}"] = f"{_k}_exp{_s} * {_k}_exp{_s} * {_k}_exp{_s} * 100"
EXPOSURES = [f"{c}{s}" for s in ("", "_24t") for c in _TOTALS[:3]] + ["work_total"]

SQL_INSTRUMENTS = f"""{SQL_EXPOSURES},
full_careers as (
    select *, {", ".join(_deviation_sql(out, *spec) for out, spec in INSTRUMENTS.items())}
    from totals)"""


@query("careers_exposures", f"""
with {SQL_EXPOSURES}
select pid, year, emp_spell, emp_spell_24t, occ_spell, occ_spell_24t, ind_spell, ind_spell_24t,
       on_job, on_job_24t, {", ".join(f"{sql_rounded(c)} as {c}" for c in EXPOSURES)},
       {", ".join(f"{sql_rounded(e, 3)} as {c}" for c, e in TERMS.items())}
from totals""")
def careers_exposures(spark, sf_dir):
    """All tenures, experiences and polynomial terms of the short chain."""
    return careers(spark, sf_dir).select(
        "pid", "year", "emp_spell", "emp_spell_24t", "occ_spell", "occ_spell_24t", "ind_spell",
        "ind_spell_24t", "on_job", "on_job_24t", *[rounded(c).alias(c) for c in EXPOSURES],
        *[rounded(c, 3).alias(c) for c in TERMS])


@query("careers_from_bucketed", f"""
with {SQL_EXPOSURES}
select pid, year, emp_spell, occ_spell_24t, {", ".join(f"{sql_rounded(c)} as {c}" for c in EXPOSURES)}
from totals""")
def careers_from_bucketed(spark, sf_dir):
    """The chain over a sample stored in buckets of persons: it shuffles nothing."""
    name = f"sample_{uuid.uuid4().hex}"
    files.write_bucketed(careers_sample(spark, sf_dir), name, 8,
                         f"{shared_folder(spark)}/wavespan/{name}")
    return presets.careers(spark.table(name), PRESET, RULES).select(
        "pid", "year", "emp_spell", "occ_spell_24t", *[rounded(c).alias(c) for c in EXPOSURES])


@query("careers_instruments", f"""
with {SQL_INSTRUMENTS}
select pid, year, {", ".join(f"{sql_rounded(c, 3)} as {c}" for c in INSTRUMENTS)}
from full_careers""")
def careers_instruments(spark, sf_dir):
    """All instrument columns of the short chain."""
    return careers(spark, sf_dir).select(
        "pid", "year", *[rounded(c, 3).alias(c) for c in INSTRUMENTS])


def _model_sql(model: str) -> str:
    terms, uncensored = presets.MODELS_SHORT[model]
    chosen = "full_careers"
    if uncensored:
        chosen = "(select * from full_careers where not (first_year > 1980 and occ_spell < 2 " \
                 "and ind_spell < 2))"
    return f"""
with {SQL_INSTRUMENTS},
{least_squares_sql(chosen, "ln(wage_real)", {
    "(Intercept)": "1", **{t: t for t in terms}, **dummies_sql("year", range(1995, 2002)),
    **dummies_sql("region", range(1, 5))}, 4)}"""


def _register_model(model: str) -> None:
    @query(f"wage_model_{model}", _model_sql(model))
    def wage_model(spark, sf_dir):
        return _fit(presets.wage_regression(careers(spark, sf_dir), PRESET, model), 4)


# without left-censored persons the small table leaves five rows, too few for a model
for _model in ("levels_reported", "levels", "instruments"):
    _register_model(_model)


@query("careers_hierarchies", f"""
with {SQL_CAREERS},
hierarchy as (select n_nationkey % 8 as key, min(n_name) as two, min(n_regionkey) as one
              from nation group by all),
coded as (select pid, year, nullif(occ3, 0) as occ3, nullif(ind3, 0) as ind3 from exposed)
select e.pid, e.year, e.occ3, e.ind3, o.two as occ2, o.one as occ1, i.two as ind2, i.one as ind1
from coded e left join hierarchy o on o.key = e.occ3 left join hierarchy i on i.key = e.ind3""")
def careers_hierarchies(spark, sf_dir):
    """Parent codes on the finished careers."""
    return _with_parents(spark, sf_dir, "intended")


@query("careers_hierarchies_ascoded", f"""
with {SQL_CAREERS},
hierarchy as (select n_nationkey % 8 as key, min(n_name) as two, min(n_regionkey) as one
              from nation group by all),
coded as (select pid, year, nullif(occ3, 0) as occ3, nullif(ind3, 0) as ind3 from exposed),
first_join as (select e.pid, e.year, o.key as occ3, e.ind3, o.two as occ2, o.one as occ1
               from coded e right join hierarchy o on o.key = e.occ3)
select f.pid, f.year, f.occ3, i.key as ind3, f.occ2, f.occ1, i.two as ind2, i.one as ind1
from first_join f right join hierarchy i on i.key = f.ind3""")
def careers_hierarchies_ascoded(spark, sf_dir):
    """The literal reading keeps every code and loses rows without one."""
    return _with_parents(spark, sf_dir, "as_coded")


def _with_parents(spark, sf_dir, semantics):
    nations = table(spark, sf_dir, "nation").groupBy(
        (F.col("n_nationkey") % 8).alias("key")).agg(
        F.min("n_name").alias("two"), F.min("n_regionkey").alias("one"))
    tables = [nations.toDF(f"{k}3", f"{k}2", f"{k}1") for k in ("occ", "ind")]
    panel_ = careers(spark, sf_dir).select("pid", "year", "occ3", "ind3")
    return presets.attach_hierarchies(panel_, *tables, semantics).select(
        "pid", "year", "occ3", "ind3", "occ2", "occ1", "ind2", "ind1")


LATE_ERA = 2003
LONG_PRESET = replace(presets.LONG, late_era_from=LATE_ERA)


#: From the long sample to its spells.
SQL_LONG_SPELLS = f"""{sql_changes("sample", RULES.tolerance)},
occ_rows as (
    select pid, year, occ_common <> lag(occ_common) over (partition by pid order by year) as differs
    from changes where occ_common is not null),
ind_rows as (
    select pid, year, ind_common <> lag(ind_common) over (partition by pid order by year) as differs
    from changes where ind_common is not null),
gated as (
    select c.*, coalesce(o.differs, false) and change_t as occ_emp,
           coalesce(o.differs, false) and change_24t as occ_24t,
           coalesce(i.differs, false) and change_t as ind_emp,
           coalesce(i.differs, false) and change_24t as ind_24t
    from changes c
    left join occ_rows o on o.pid = c.pid and o.year = c.year
    left join ind_rows i on i.pid = c.pid and i.year = c.year),
jobs as (
    select *, min(case when emp_status = 1 and year < {LATE_ERA} then year end)
                  over (partition by pid) as early_job,
           min(case when emp_status = 1 and year >= {LATE_ERA} then year end)
               over (partition by pid) as late_job
    from gated),
numbered as (
    select *, (sum(case when year = early_job then 1 when year = late_job then 2
                        else change_t::int end) over w)::int as n,
           (sum(case when year = early_job then 1 when year = late_job then 2
                     else change_24t::int end) over w)::int as n24
    from jobs where early_job is not null or late_job is not null
    window w as (partition by pid order by year rows unbounded preceding)),
employed as (
    select *, case when bool_or(coalesce(emp_status = 1, false)) over (partition by pid, n)
                   then n end as emp_spell,
           case when bool_or(coalesce(emp_status = 1, false)) over (partition by pid, n24)
                then n24 end as emp_spell_24t
    from numbered),
reported as (
    select * from (
        select *, min(case when tenure is not null then year end) over (partition by pid) as start
        from employed) where year >= start),
starts as (
    select *, min(case when emp_status = 1 and occ3 is not null then year end)
                  over (partition by pid) as occ_start,
           min(case when emp_status = 1 and ind3 is not null then year end)
               over (partition by pid) as ind_start,
           case when year >= {LATE_ERA} then 2 else 1 end as weight
    from reported),
coded as (
    select *, nullif((sum(case when year = occ_start then 1 when occ_emp then weight else 0 end)
                      over w)::int, 0) as occ_spell,
           nullif((sum(case when year = occ_start then 1 when occ_24t then weight else 0 end)
                   over w)::int, 0) as occ_spell_24t,
           nullif((sum(case when year = ind_start then 1 when ind_emp then weight else 0 end)
                   over w)::int, 0) as ind_spell,
           nullif((sum(case when year = ind_start then 1 when ind_24t then weight else 0 end)
                   over w)::int, 0) as ind_spell_24t,
           year - lag(year) over (partition by pid order by year) as since,
           min(case when tenure is not null then year end) over (partition by pid, emp_spell)
               as first_report
    from starts window w as (partition by pid order by year rows unbounded preceding))"""


@query("careers_long", f"""
with {SQL_LONG},
{SQL_LONG_SPELLS}
select pid, year, emp_spell, emp_spell_24t, occ_spell, occ_spell_24t, ind_spell_24t,
       {sql_rounded("""sum(case when tenure is not null and year = first_report then tenure
            when emp_status = 1 and hours >= 800 then coalesce(since, 0) else 0 end)
       over (partition by pid, emp_spell order by year rows unbounded preceding)""")} as emp_tenure
from coded""")
def careers_long(spark, sf_dir):
    """The long chain: common codes of two census schemes, late changes counted twice."""
    return presets.careers(long_sample(spark, sf_dir), LONG_PRESET, RULES).select(
        "pid", "year", "emp_spell", "emp_spell_24t", "occ_spell", "occ_spell_24t", "ind_spell_24t",
        rounded("emp_tenure").alias("emp_tenure"))
