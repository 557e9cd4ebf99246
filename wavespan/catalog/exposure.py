"""Tenure, experience and deviations from spell means."""

from pyspark.sql import functions as F

from wavespan.catalog.adapter import (SQL_CODES, SQL_PANEL, SQL_SPELLS, coded_panel, panel, rounded,
                                      spelled_panel, sql_rounded)
from wavespan.catalog.registry import query
from wavespan.operators import exposure

ACCRUAL = ((1995, 1996), (1999, 2001))
RESET = 1998

SQL_TENURE = f"""{SQL_SPELLS},
tenure_steps as (
    select *,
           case when tenure is not null
                     and (year = {RESET} or year = min(case when tenure is not null then year end)
                                                   over (partition by pid, emp_spell)) then tenure
                when emp_status = 1 and hours >= 800
                     and (year between 1995 and 1996 or year between 1999 and 2001)
                then coalesce(gap, 0) else 0 end as step,
           sum((year = {RESET} and tenure is not null)::int)
               over (partition by pid order by year rows unbounded preceding) as segment
    from spells),
tenures as (
    select *, sum(step) over (partition by pid, emp_spell, segment order by year
                              rows unbounded preceding) as emp_tenure
    from tenure_steps)"""


def tenure_panel(spark, sf_dir, semantics="intended"):
    return exposure.employer_tenure(spelled_panel(spark, sf_dir), accrual=ACCRUAL,
                                    reset_year=RESET, semantics=semantics)


@query("employer_tenure", f"""
with {SQL_TENURE}
select pid, year, {sql_rounded("emp_tenure")} as emp_tenure from tenures""")
def employer_tenure(spark, sf_dir):
    return tenure_panel(spark, sf_dir).select("pid", "year",
                                              rounded("emp_tenure").alias("emp_tenure"))


@query("employer_tenure_ascoded", f"""
with {SQL_TENURE}
select pid, year,
       {sql_rounded("sum(step) over (partition by pid, emp_spell order by year rows unbounded preceding)")}
           as emp_tenure
from tenure_steps""")
def employer_tenure_ascoded(spark, sf_dir):
    return tenure_panel(spark, sf_dir, "as_coded").select(
        "pid", "year", rounded("emp_tenure").alias("emp_tenure"))


@query("code_experience", f"""
with {SQL_CODES},
looked as (
    select *, year = min(year) over (partition by pid) as entry,
           year - lag(year) over w as since,
           coalesce(lead(emp_status) over w = 1 and lead(occ_spell) over w = occ_spell, false)
               as stays
    from code_spells window w as (partition by pid order by year)),
steps as (
    select *, case when occ_spell > 1 and year = min(year) over (partition by pid, occ_spell)
                   then 0.5 when not entry and hours > 800 and stays then since
                   when entry then tenure else 0 end::double as step
    from looked)
select pid, year,
       case when sum((step is null)::int) over w = 0 then {sql_rounded("sum(step) over w")} end
           as occ_exp
from steps window w as (partition by pid, occ_spell order by year rows unbounded preceding)""")
def code_experience(spark, sf_dir):
    return exposure.code_experience(coded_panel(spark, sf_dir), "occ_spell", "occ_exp").select(
        "pid", "year", rounded("occ_exp").alias("occ_exp"))


@query("work_experience", f"""
with {SQL_PANEL},
r as (select *, case when o_orderkey % 3 = 0 then nullif(o_orderkey % 30, 0) end as reported,
             year > 1996 as late from panel),
s as (select *, case when reported is not null
                     then min(case when reported is not null then year end)
                          over (partition by pid) end as seed_year,
             year - lag(year) over (partition by pid, late order by year) as since from r),
t as (select *, coalesce(emp_status = 1, false) and hours >= 800 and year > seed_year as accrues,
             case when year = seed_year then reported end as seed from s),
u as (select *, case when late then coalesce(seed, case when accrues then since
                                                        when not accrues then 0 end)
                     else seed end as step from t)
select pid, year,
       case when not late then step
            when sum((step is null)::int) over w = 0 then sum(step) over w end::double as work_total
from u window w as (partition by pid, late order by year rows unbounded preceding)""")
def work_experience(spark, sf_dir):
    key = F.col("o_orderkey")
    df = panel(spark, sf_dir, "o_orderkey").withColumn(
        "work_exp", F.when(key % 3 == 0, F.nullif(key % 30, F.lit(0))))
    return exposure.work_experience(df, after=1996).select("pid", "year", "work_total")


@query("on_job", f"""
with {SQL_SPELLS}
select pid, year,
       case when year = min(year) over (partition by pid, emp_spell) then 0 else 1 end as on_job
from spells""")
def on_job(spark, sf_dir):
    return exposure.on_job(spelled_panel(spark, sf_dir)).select("pid", "year", "on_job")


@query("spell_demean", f"""
with {SQL_SPELLS}
select pid, year,
       case when count(*) filter (where tenure is null) over w = 0
            then {sql_rounded("tenure - avg(tenure) over w")} end as tenure_dev,
       {sql_rounded("wage - avg(wage) over w")} as wage_dev
from spells window w as (partition by pid, emp_spell)""")
def spell_demean(spark, sf_dir):
    df = exposure.demean(spelled_panel(spark, sf_dir),
                         {"tenure_dev": ("tenure", 1, 1), "wage_dev": ("wage", 1, 1)})
    return df.select("pid", "year", rounded("tenure_dev").alias("tenure_dev"),
                     rounded("wage_dev").alias("wage_dev"))


@query("spell_demean_poly", f"""
with {SQL_TENURE}
select pid, year,
       {sql_rounded("emp_tenure * emp_tenure * 100", 4)} as emp2_100,
       {sql_rounded("emp_tenure - avg(emp_tenure) over w", 4)} as instr_emp,
       {sql_rounded("(emp_tenure * emp_tenure - (avg(emp_tenure) over w) * (avg(emp_tenure) over w)) * 100", 4)}
           as instr_emp2_100,
       {sql_rounded("(emp_tenure * emp_tenure * emp_tenure - (avg(emp_tenure) over w) * (avg(emp_tenure) over w) * (avg(emp_tenure) over w)) * 100", 4)}
           as instr_emp3_100
from tenures window w as (partition by pid, emp_spell)""")
def spell_demean_poly(spark, sf_dir):
    df = exposure.powers(tenure_panel(spark, sf_dir), {"emp2_100": ("emp_tenure", 2, 100)})
    df = exposure.demean(df, {"instr_emp": ("emp_tenure", 1, 1),
                              "instr_emp2_100": ("emp_tenure", 2, 100),
                              "instr_emp3_100": ("emp_tenure", 3, 100)})
    return df.select("pid", "year", *[rounded(c, 4).alias(c) for c in (
        "emp2_100", "instr_emp", "instr_emp2_100", "instr_emp3_100")])


@query("career_demean", f"""
with {SQL_PANEL}
select pid, year, {sql_rounded("wage - avg(wage) over w")} as instr_wage,
       {sql_rounded("wage * wage - (avg(wage) over w) * (avg(wage) over w)")} as instr_wage2
from panel window w as (partition by pid)""")
def career_demean(spark, sf_dir):
    df = exposure.demean(panel(spark, sf_dir), {"instr_wage": ("wage", 1, 1),
                                                "instr_wage2": ("wage", 2, 1)}, by=["pid"])
    return df.select("pid", "year", rounded("instr_wage").alias("instr_wage"),
                     rounded("instr_wage2").alias("instr_wage2"))
