"""Employer, occupation and industry spells."""

from wavespan.catalog.adapter import (SQL_CHANGES, SQL_CODES, SQL_SPELLS, changed_panel,
                                      coded_panel, panel, spelled_panel)
from wavespan.catalog.registry import query
from wavespan.operators import spells


@query("running_spell", f"""
with {SQL_CHANGES}
select pid, year, (sum(change_24t::int) over (partition by pid order by year
                                              rows unbounded preceding))::int as spell
from changes""")
def running_spell(spark, sf_dir):
    return spells.running_spell(changed_panel(spark, sf_dir), "change_24t").select(
        "pid", "year", "spell")


@query("ever_employed", f"""
with {SQL_SPELLS} select pid, year, emp_status from spells""")
def ever_employed(spark, sf_dir):
    return spells.ever_employed(panel(spark, sf_dir)).select("pid", "year", "emp_status")


@query("employer_spells", f"""
with {SQL_SPELLS} select pid, year, emp_spell, emp_spell_24t from spells""")
def employer_spells(spark, sf_dir):
    return spelled_panel(spark, sf_dir).select("pid", "year", "emp_spell", "emp_spell_24t")


@query("employer_spells_ascoded", f"""
with {SQL_SPELLS},
literal as (
    select pid, year, emp_status, c24 as c,
           (sum((year = first_job)::int) over (partition by pid order by year
                                               rows unbounded preceding))::int as d
    from spells)
select pid, year,
       case when bool_or(coalesce(emp_status = 1, false)) over (partition by pid, c)
            then c end as emp_spell,
       case when bool_or(coalesce(emp_status = 1, false)) over (partition by pid, d)
            then d end as emp_spell_24t
from literal""")
def employer_spells_ascoded(spark, sf_dir):
    return spells.employer_spells(changed_panel(spark, sf_dir), semantics="as_coded").select(
        "pid", "year", "emp_spell", "emp_spell_24t")


@query("employer_spells_late_era", f"""
with {SQL_SPELLS},
eras as (
    select *, min(case when emp_status = 1 and year < 1999 then year end)
                  over (partition by pid) as early_job,
           min(case when emp_status = 1 and year >= 1999 then year end)
               over (partition by pid) as late_job
    from spells),
steps as (
    select *, (sum(case when year = early_job then 1 when year = late_job then 2
                        else change_t::int end) over w)::int as e
    from eras window w as (partition by pid order by year rows unbounded preceding))
select pid, year, case when bool_or(coalesce(emp_status = 1, false)) over (partition by pid, e)
                       then e end as emp_spell
from steps""")
def employer_spells_late_era(spark, sf_dir):
    return spells.employer_spells(changed_panel(spark, sf_dir), late_era_from=1999).select(
        "pid", "year", "emp_spell")


@query("employer_spells_late_era_ascoded", f"""
with {SQL_SPELLS},
eras as (
    select *, min(case when emp_status = 1 and year < 1998 then year end)
                  over (partition by pid) as early_job,
           min(case when emp_status = 1 and year > 1998 then year end)
               over (partition by pid) as late_job
    from spells),
steps as (
    select *, case when year = 1998 then null when year = early_job then 1
                   when year = late_job then 2 else change_24t::int end as step
    from eras),
sums as (
    select *, case when sum((step is null)::int) over w = 0 then (sum(step) over w)::int end as e
    from steps window w as (partition by pid order by year rows unbounded preceding))
select pid, year, case when bool_or(coalesce(emp_status = 1, false)) over (partition by pid, e)
                       then e end as emp_spell
from sums""")
def employer_spells_late_era_ascoded(spark, sf_dir):
    """A 1998 wave belongs to neither era, so the numbering is unknown from there on."""
    return spells.employer_spells(changed_panel(spark, sf_dir), late_era_from=1999,
                                  semantics="as_coded").select("pid", "year", "emp_spell")


@query("spell_invalidate", f"""
with {SQL_CHANGES},
raw as (select *, (sum(change_t::int) over (partition by pid order by year
                                            rows unbounded preceding))::int as s from changes)
select pid, year, case when bool_or(coalesce(emp_status = 1, false)) over (partition by pid, s)
                       then s end as spell from raw""")
def spell_invalidate(spark, sf_dir):
    df = spells.running_spell(changed_panel(spark, sf_dir), "change_t")
    return spells.invalidate_idle_spells(df, ["spell"]).select("pid", "year", "spell")


@query("code_spells", f"""
with {SQL_CODES}
select pid, year, occ_spell, ind_spell, occ_spell_24t, ind_spell_24t from code_spells""")
def code_spells(spark, sf_dir):
    return coded_panel(spark, sf_dir).select(
        "pid", "year", "occ_spell", "ind_spell", "occ_spell_24t", "ind_spell_24t")


@query("code_spells_late_era", f"""
with {SQL_CODES}
select pid, year,
       nullif((sum(case when year = occ_start then 1 when occ_24t and year >= 1999 then 2
                        else occ_24t::int end) over w)::int, 0) as occ_spell_24t,
       nullif((sum(case when year = ind_start then 1 when ind_24t and year >= 1999 then 2
                        else ind_24t::int end) over w)::int, 0) as ind_spell_24t
from starts window w as (partition by pid order by year rows unbounded preceding)""")
def code_spells_late_era(spark, sf_dir):
    return coded_panel(spark, sf_dir, late_era_from=1999).select(
        "pid", "year", "occ_spell_24t", "ind_spell_24t")


def _modal_sql(direction: str) -> str:
    return f"""
with {SQL_CODES},
counts as (
    select pid, occ_spell_24t as spell, ind as code, count(*) as n
    from code_spells where ind is not null group by all),
best as (
    select * from (
        select *, row_number() over (partition by pid, spell order by n {direction}, code) as rn
        from counts) where rn = 1)
select s.pid, s.year, s.occ_spell_24t, b.code as spell_code
from code_spells s
left join best b on b.pid = s.pid and b.spell is not distinct from s.occ_spell_24t"""


@query("spell_modal_code", _modal_sql("desc"))
def spell_modal_code(spark, sf_dir):
    return spells.spell_code(coded_panel(spark, sf_dir), "ind", "occ_spell_24t", "spell_code"
                             ).select("pid", "year", "occ_spell_24t", "spell_code")


@query("spell_least_code", _modal_sql("asc"))
def spell_least_code(spark, sf_dir):
    return spells.spell_code(coded_panel(spark, sf_dir), "ind", "occ_spell_24t", "spell_code",
                             semantics="as_coded"
                             ).select("pid", "year", "occ_spell_24t", "spell_code")


@query("from_first_report", f"""
with {SQL_CODES} select pid, year, tenure from reported""")
def from_first_report(spark, sf_dir):
    return spells.from_first_report(spelled_panel(spark, sf_dir)).select("pid", "year", "tenure")
