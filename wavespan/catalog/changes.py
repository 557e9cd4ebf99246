"""Job and code changes."""

from pyspark.sql import functions as F

from wavespan.catalog.adapter import (RULES, SQL_CHANGES, SQL_PANEL, TOLERANCE, changed_panel,
                                      panel, with_code_changes)
from wavespan.catalog.registry import query
from wavespan.operators import change


@query("change_t", f"with {SQL_CHANGES} select pid, year, gap, change_t from changes")
def change_t(spark, sf_dir):
    return changed_panel(spark, sf_dir).select("pid", "year", "gap", "change_t")


@query("change_24t", f"with {SQL_CHANGES} select pid, year, change_t, change_24t from changes")
def change_24t(spark, sf_dir):
    return changed_panel(spark, sf_dir).select("pid", "year", "change_t", "change_24t")


@query("change_24t_ascoded", f"""
with {SQL_PANEL},
a as (select *, year - lag(year) over w as gap, lag(tenure) over w as lag_all
      from panel window w as (partition by pid order by year)),
b as (select *, tenure is not null and lag_all is not null as eligible from a),
e as (select *, lag(tenure) over (partition by pid, eligible order by year) as lag_sub from b)
select pid, year, coalesce(tenure < gap, false) as change_t,
       coalesce(tenure < gap, false)
       or (case when eligible then coalesce(tenure > lag_sub + gap + {TOLERANCE}
                                            or tenure < lag_sub + gap - {TOLERANCE}, false)
                else false end) as change_24t
from e""")
def change_24t_ascoded(spark, sf_dir):
    return change.job_change(panel(spark, sf_dir), rules=RULES, semantics="as_coded").select(
        "pid", "year", "change_t", "change_24t")


def _bracket_sql(first_only: str) -> str:
    # waves moved to 1968..1974, where tenure is a bracket code
    return f"""
with {SQL_PANEL},
p as (select pid, year - 27 as year, nullif(o_orderkey % 12, 0)::double as code,
             min(year - 27) over (partition by pid) as entry from panel),
a as (select *, year = 1968 and code = 1 as f0, lag(code) over w as code_before
      from p window w as (partition by pid order by year)),
b as (select *, case when (year = 1969 and code = 2 and f0_before) then true
                     when not (year = 1969 and code = 2 and f0_before) then f0 end as f1
      from (select *, lag(f0) over (partition by pid order by year) as f0_before from a)),
c as (select *, case when (year between 1969 and 1975 and not f1 and code = 1) then true
                     when not (year between 1969 and 1975 and not f1 and code = 1) then f1 end as f2
      from b),
d as (select *, case when (year between 1969 and 1975 and not f2 and code = 2 and {first_only})
                     then true
                     when not (year between 1969 and 1975 and not f2 and code = 2 and {first_only})
                     then f2 end as f3
      from c),
e as (select *, case when (year between 1970 and 1975 and not f3 and code = 2
                           and not coalesce(code_before in (1, 2, 9), false)) then true
                     when not (year between 1970 and 1975 and not f3 and code = 2
                               and not coalesce(code_before in (1, 2, 9), false)) then f3 end as f4
      from d)
select pid, year, coalesce(f4, false) as change_t from e"""


def _bracketed(spark, sf_dir, semantics):
    codes = panel(spark, sf_dir, "o_orderkey").select(
        "pid", (F.col("year") - 27).alias("year"),
        F.nullif(F.col("o_orderkey") % 12, F.lit(0)).cast("double").alias("tenure"))
    return change.job_change(codes, semantics=semantics).select("pid", "year", "change_t")


@query("change_t_bracketed", _bracket_sql("year = entry"))
def change_t_bracketed(spark, sf_dir):
    return _bracketed(spark, sf_dir, "intended")


@query("change_t_bracketed_ascoded", _bracket_sql("true"))
def change_t_bracketed_ascoded(spark, sf_dir):
    return _bracketed(spark, sf_dir, "as_coded")


@query("change_t_transition", f"""
with {SQL_PANEL},
p as (select pid, year - 22 as year, tenure, min(year - 22) over (partition by pid) as entry
      from panel),
a as (select *, year - lag(year) over w as gap, lag(tenure) over w as before,
             false as f0 from p window w as (partition by pid order by year)),
b as (select *, case when (year <= 1975 and not f0 and tenure = 1) then true
                     when not (year <= 1975 and not f0 and tenure = 1) then f0 end as f1 from a),
c as (select *, case when (year <= 1975 and not f1 and tenure = 2 and year = entry) then true
                     when not (year <= 1975 and not f1 and tenure = 2 and year = entry)
                     then f1 end as f2 from b),
d as (select *, case when (year <= 1975 and not f2 and tenure = 2
                           and not coalesce(before in (1, 2, 9), false)) then true
                     when not (year <= 1975 and not f2 and tenure = 2
                               and not coalesce(before in (1, 2, 9), false)) then f2 end as f3
      from c),
e as (select *, case when (year = 1976 and not f3 and tenure < 1.25) then true
                     when not (year = 1976 and not f3 and tenure < 1.25) then f3 end as f4
      from d)
select pid, year,
       coalesce(f4, false) or coalesce(year >= 1976 and tenure < gap, false) as change_t,
       coalesce(f4, false) or coalesce(year >= 1976 and tenure < gap, false)
       or coalesce(year >= 1977 and (tenure > before + gap + {TOLERANCE}
                                     or tenure < before + gap - {TOLERANCE}), false) as change_24t
from e""")
def change_t_transition(spark, sf_dir):
    moved = panel(spark, sf_dir).select("pid", (F.col("year") - 22).alias("year"), "tenure")
    return change.job_change(moved, rules=RULES).select("pid", "year", "change_t", "change_24t")


SQL_CODE_CHANGES = f"""{SQL_CHANGES},
occ as (select pid, year, occ3 <> lag(occ3) over (partition by pid order by year) as differs
        from changes where occ3 is not null),
ind as (select pid, year, ind3 <> lag(ind3) over (partition by pid order by year) as differs
        from changes where ind3 <> 0),
code_changes as (
    select c.*, coalesce(occ.differs, false) as occ_unc, coalesce(ind.differs, false) as ind_unc
    from changes c
    left join occ on occ.pid = c.pid and occ.year = c.year
    left join ind on ind.pid = c.pid and ind.year = c.year)"""


@query("code_change_unc", f"""
with {SQL_CODE_CHANGES} select pid, year, occ_unc, ind_unc from code_changes""")
def code_change_unc(spark, sf_dir):
    return with_code_changes(changed_panel(spark, sf_dir)).select(
        "pid", "year", "occ_unc", "ind_unc")


@query("code_change_ascoded", f"""
with {SQL_PANEL},
i as (select pid, year, ind3 <> lag(ind3) over (partition by pid order by year) as differs
      from panel)
select pid, year, coalesce(differs, false) as ind_unc from i""")
def code_change_ascoded(spark, sf_dir):
    """Code 0 counted as a code of its own."""
    return change.code_change(panel(spark, sf_dir), "ind3", {}, out="ind_unc",
                              zero_is_missing=False).select("pid", "year", "ind_unc")


@query("code_change_gated", f"""
with {SQL_CODE_CHANGES}
select pid, year,
       case when year <= 1997 then occ_unc else occ_unc and change_t end as occ_emp,
       case when year <= 1997 then occ_unc else occ_unc and change_24t end as occ_24t,
       case when year <= 1997 then ind_unc else ind_unc and change_t end as ind_emp,
       case when year <= 1997 then ind_unc else ind_unc and change_24t end as ind_24t
from code_changes""")
def code_change_gated(spark, sf_dir):
    """Gated by job changes from 1998 on; until 1997 the uncontrolled flag holds."""
    return with_code_changes(changed_panel(spark, sf_dir), ungated_until=1997).select(
        "pid", "year", "occ_emp", "occ_24t", "ind_emp", "ind_24t")
