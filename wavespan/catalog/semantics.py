"""Missing-value semantics and neighbouring-wave queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wavespan.catalog.adapter import SQL_PANEL, panel, rounded, sql_rounded
from wavespan.catalog.registry import query
from wavespan.functions import na
from wavespan.operators import change, recode


@query("flag_gap", f"""
with {SQL_PANEL}
select pid, year, year - lag(year) over (partition by pid order by year) as gap from panel""")
def flag_gap(spark, sf_dir):
    return change.wave_gap(panel(spark, sf_dir)).select("pid", "year", "gap")


@query("lag_lead_tenure", f"""
with {SQL_PANEL}
select pid, year, lag(tenure) over w as tenure_before, lead(tenure) over w as tenure_after,
       tenure - lag(tenure) over w as growth
from panel window w as (partition by pid order by year)""")
def lag_lead_tenure(spark, sf_dir):
    w = na.person_window()
    return panel(spark, sf_dir).select(
        "pid", "year", F.lag("tenure").over(w).alias("tenure_before"),
        F.lead("tenure").over(w).alias("tenure_after"),
        (F.col("tenure") - F.lag("tenure").over(w)).alias("growth"))


@query("lag_subset", f"""
with {SQL_PANEL},
marked as (select *, coalesce(emp_status = 1, false) as member from panel)
select pid, year, member,
       case when member then lag(tenure) over w end as tenure_before,
       case when member then min(year) over (partition by pid, member) end as first_member_year
from marked window w as (partition by pid, member order by year)""")
def lag_subset(spark, sf_dir):
    w = na.person_window()
    member = F.col("emp_status") == 1
    return panel(spark, sf_dir).select(
        "pid", "year", na.known(member).alias("member"),
        F.when(member, na.subset_lag("tenure", member, w)).alias("tenure_before"),
        F.when(member, na.subset_min("year", member, w)).alias("first_member_year"))


@query("na_cumsum", f"""
with {SQL_PANEL}
select pid, year,
       case when sum((tenure is null)::int) over w = 0
            then {sql_rounded("sum(tenure) over w")} end as total
from panel window w as (partition by pid order by year rows unbounded preceding)""")
def na_cumsum(spark, sf_dir):
    w = na.running(na.person_window())
    return panel(spark, sf_dir).select(
        "pid", "year", rounded(na.na_cumsum(F.col("tenure"), w)).alias("total"))


@query("na_any", f"""
with {SQL_PANEL}
select pid,
       case when bool_or(wage < 2) then true
            when count(*) filter (where (wage < 2) is null) > 0 then null else false end as low_wage,
       case when bool_or(emp_status = 2) then true
            when count(*) filter (where (emp_status = 2) is null) > 0 then null
            else false end as ever_idle,
       bool_or(coalesce(emp_status = 1, false)) as ever_employed
from panel group by pid""")
def na_any(spark, sf_dir):
    return panel(spark, sf_dir).groupBy("pid").agg(
        na.na_any_agg(F.col("wage") < 2).alias("low_wage"),
        na.na_any_agg(F.col("emp_status") == 2).alias("ever_idle"),
        F.bool_or(na.is_one_of("emp_status", [1])).alias("ever_employed"))


@query("na_ifelse", f"""
with {SQL_PANEL}
select pid, year,
       case when tenure < 1 then 1 when not (tenure < 1) then 0 end as is_new,
       coalesce(emp_status in (1), false) as employed
from panel""")
def na_ifelse(spark, sf_dir):
    return panel(spark, sf_dir).select(
        "pid", "year",
        na.na_ifelse(F.col("tenure") < 1, F.lit(1), F.lit(0)).alias("is_new"),
        na.is_one_of("emp_status", [1]).alias("employed"))


@query("na_mean", f"""
with {SQL_PANEL}
select pid, case when count(*) filter (where tenure is null) = 0
                 then {sql_rounded("avg(tenure)")} end as strict_mean,
       {sql_rounded("avg(tenure)")} as mean_of_known
from panel group by pid""")
def na_mean(spark, sf_dir):
    x, person = F.col("tenure"), Window.partitionBy("pid")
    return panel(spark, sf_dir).select("pid", na.na_mean(x, person).alias("strict"), F.avg(x).over(
        person).alias("known")).distinct().select(
        "pid", rounded("strict").alias("strict_mean"), rounded("known").alias("mean_of_known"))


@query("pick_year_value", f"""
with {SQL_PANEL},
picked as (
    select pid, year, max(case when year = 2000 then ind3 end) over (partition by pid) as v2000,
           max(case when year = 1998 then ind3 end) over (partition by pid) as v1998,
           max(case when year = 1996 then ind3 end) over (partition by pid) as v1996
    from panel)
select *, coalesce(nullif(v2000, 0), nullif(v1998, 0), nullif(v1996, 0)) as first_valid
from picked""")
def pick_year_value(spark, sf_dir):
    w = na.person_window()
    picked = panel(spark, sf_dir).select(
        "pid", "year", *[na.value_at("ind3", y, w).alias(f"v{y}") for y in (2000, 1998, 1996)])
    return recode.pick_first_valid(picked, "first_valid", ["v2000", "v1998", "v1996"])


@query("first_year_where", f"""
with {SQL_PANEL}
select pid, year,
       min(case when emp_status = 1 then year end) over (partition by pid) as first_job,
       min(case when tenure is not null then year end) over (partition by pid) as first_report,
       year = min(year) over (partition by pid) as is_entry
from panel""")
def first_year_where(spark, sf_dir):
    w = na.person_window()
    return panel(spark, sf_dir).select(
        "pid", "year",
        na.first_year_where(F.col("emp_status") == 1, w).alias("first_job"),
        na.first_year_where(F.col("tenure").isNotNull(), w).alias("first_report"),
        na.is_first_row(w).alias("is_entry"))
