"""Row, person and design filters."""

from pyspark.sql import functions as F

from wavespan.catalog.adapter import (SQL_CODES, SQL_PANEL, coded_panel, panel, rounded, sql_rounded,
                                      table)
from wavespan.catalog.registry import query
from wavespan.functions.na import is_one_of
from wavespan.operators import filters
from wavespan.plans import presets

SQL_SURVEY = f"""{SQL_PANEL},
survey as (
    select pid, year, relation, sex, (1 + pid % 3)::int as race, region, age,
           (o_orderkey % 17)::int as grades, emp_status, hours, wage,
           nullif(o_orderkey % 12, 0)::double as tenure, (o_orderkey % 31)::double as work_exp,
           occ3, ind3, (case when o_orderkey % 37 = 0 then 2 else 1 end)::int as modality,
           (case when o_orderkey % 41 = 0 then 1 else 5 end)::int as government,
           (o_orderkey % 2)::int as union_covered, (pid % 3)::int as married
    from panel),
prices as (select year(o_orderdate)::int as year, avg(o_totalprice) as value from orders group by 1)"""


def survey(spark, sf_dir):
    """The adapter panel with every column the career presets read."""
    key, pid = F.col("o_orderkey"), F.col("pid")
    return panel(spark, sf_dir, "o_orderkey", region=True).select(
        "pid", "year", "relation", "sex", (1 + pid % 3).cast("int").alias("race"), "region", "age",
        (key % 17).cast("int").alias("grades"), "emp_status", "hours", "wage",
        F.nullif(key % 12, F.lit(0)).cast("double").alias("tenure"),
        (key % 31).cast("double").alias("work_exp"), "occ3", "ind3",
        F.when(key % 37 == 0, 2).otherwise(1).alias("modality"),
        F.when(key % 41 == 0, 1).otherwise(5).alias("government"),
        (key % 2).cast("int").alias("union_covered"), (pid % 3).cast("int").alias("married"))


def price_index(spark, sf_dir):
    return (
        table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"))
        .agg(F.avg("o_totalprice").alias("value")))


def _sample_sql(no_income: str) -> str:
    return f"""
with {SQL_SURVEY},
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
           case when bool_or(wage_real > 0 and wage_real < 1) over w then true
                when count(*) filter (where (wage_real > 0 and wage_real < 1) is null) over w > 0
                then null else false end as low_wage
    from kept window w as (partition by pid))
select pid, year, education, {sql_rounded("wage_real", 5)} as wage_real,
       case when tenure in (98, 99) then null else tenure end as tenure
from flagged
where not ever_government and not ever_self_employed and not coalesce(low_wage, false)
  and not coalesce(hours <= 500, false) and not coalesce({no_income}, false)"""


def _sample(spark, sf_dir, semantics, wage=None):
    rows = survey(spark, sf_dir)
    return presets.select_sample_short(
        rows if wage is None else rows.withColumn("wage", wage), price_index(spark, sf_dir), semantics, base_year=1997,
        years=(1995, 2001), education_years=(2000, 1998, 1996)
    ).select("pid", "year", "education", rounded("wage_real", 5).alias("wage_real"), "tenure")


@query("select_sample", _sample_sql("wage_real is null or wage_real = 0"))
def select_sample(spark, sf_dir):
    return _sample(spark, sf_dir, "intended")


@query("select_sample_ascoded", _sample_sql("not low_wage"))
def select_sample_ascoded(spark, sf_dir):
    """Keeps only persons whose low-wage flag is unknown; every wage is known here, so none."""
    return _sample(spark, sf_dir, "as_coded")


BLANK_WAGE = "case when (pid + year) % 4 = 0 then null else wage end as wage"


@query("select_sample_ascoded_blank", _sample_sql("not low_wage").replace(
    "emp_status, hours, wage,", f"emp_status, hours, {BLANK_WAGE},"))
def select_sample_ascoded_blank(spark, sf_dir):
    """Some wages are unknown, and with them some persons' low-wage flags: those persons stay."""
    wage = F.when((F.col("pid") + F.col("year")) % 4 != 0, F.col("wage"))
    return _sample(spark, sf_dir, "as_coded", wage)


SQL_LONG = f"""{SQL_SURVEY},
p as (
    select * replace (year + 4 as year), occ3 as occ3_early, ind3 as occ3_late, ind3 as ind3_early,
           occ3 as ind3_late, modality as modality_early,
           case when pid % 29 = 0 then 3 else 1 end as modality_late,
           government as government_early, case when pid % 31 = 0 then 1 else 5 end as government_late
    from survey),
eras as (
    select p.* replace (case when p.year >= 2003 then occ3_late else occ3_early end as occ3,
                        case when p.year >= 2003 then ind3_late else ind3_early end as ind3,
                        case when p.year >= 2003 then modality_late else modality_early end as modality,
                        case when p.year >= 2003 then government_late else government_early end
                            as government,
                        coalesce(married in (1, 2, 3), false)::int as married),
           wage * (select max(value) from prices where year = 1997) / value as wage_real
    from p left join prices i on i.year = p.year - 4
    where sex = 1 and relation in (1, 10) and age between 18 and 64 and region in (1, 2, 3, 4)),
flags as (
    select * from (
        select *, bool_or(government = 1) over w as gov, bool_or(modality in (2, 3)) over w as own,
               bool_or(wage_real > 0 and wage_real < 1) over w as low
        from eras window w as (partition by pid))
    where not gov and not own and not coalesce(low, false)),
cw as (
    select (p_partkey % 8)::varchar as code_1970, (p_partkey % 5 + 1)::varchar as code_2000,
           case when p_partkey % 8 = 3 then 6005 else nullif(p_size, 50) end as code_common,
           p_brand as one_digit, p_partkey as ord from part),
a as (select code_1970 as code, code_common, one_digit, min(ord) as ord from cw group by all),
b as (select code_2000 as code, code_common, one_digit, min(ord) as ord from cw group by all),
early as (select code::int as code, code_common, one_digit from (
    select *, row_number() over (partition by code order by ord desc) as rn from a) where rn = 1),
late as (select code::int as code, code_common, one_digit from (
    select *, row_number() over (partition by code order by ord desc) as rn from b) where rn = 1),
occ as (
    select f.*, coalesce(e.code_common, l.code_common) as occ_common,
           coalesce(e.one_digit, l.one_digit) as occ_one_digit
    from flags f left join early e on e.code = nullif(f.occ3, 0) and f.year <= 2001
    left join late l on l.code = nullif(f.occ3, 0) and f.year >= 2003),
kept as (
    select * from (select *, bool_or(coalesce(occ_common in (9840, 6005, 6020, 6040, 6050), false))
                                 over (partition by pid) as farm from occ) where not farm),
sample as (
    select k.* replace (nullif(k.occ3, 0) as occ3, nullif(k.ind3, 0) as ind3,
                        case when tenure in (98, 99) then null else tenure end as tenure),
           nullif(coalesce(e.code_common, l.code_common), 0) as ind_common,
           hours <= 500 as short_hours, wage_real is null or wage_real = 0 as no_income
    from kept k left join early e on e.code = nullif(k.ind3, 0) and k.year <= 2001
    left join late l on l.code = nullif(k.ind3, 0) and k.year >= 2003)"""


def long_columns(df):
    """Both eras' columns of the long preset."""
    pid = F.col("pid")
    return df.withColumns({
        "occ3_early": F.col("occ3"), "occ3_late": F.col("ind3"), "ind3_early": F.col("ind3"),
        "ind3_late": F.col("occ3"), "modality_early": F.col("modality"),
        "modality_late": F.when(pid % 29 == 0, 3).otherwise(1),
        "government_early": F.col("government"),
        "government_late": F.when(pid % 31 == 0, 1).otherwise(5),
    }).drop("occ3", "ind3", "modality", "government")


def long_survey(spark, sf_dir):
    """The survey moved to 1999-2005, so that both code eras occur."""
    return long_columns(survey(spark, sf_dir).withColumn("year", F.col("year") + 4))


def long_codes(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        (key % 8).cast("string").alias("code_1970"), (key % 5 + 1).cast("string").alias("code_2000"),
        F.when(key % 8 == 3, 6005).otherwise(F.nullif(F.col("p_size"), F.lit(50)))
        .alias("code_common"), F.col("p_brand").alias("one_digit"), key.alias("ord"))


def long_sample(spark, sf_dir):
    codes = long_codes(spark, sf_dir)
    index = price_index(spark, sf_dir).withColumn("year", F.col("year") + 4)
    return presets.select_sample_long(long_survey(spark, sf_dir), index, codes, codes,
                                      base_year=2001)


@query("select_sample_long", f"""
with {SQL_LONG}
select pid, year, occ3, ind3, occ_common, occ_one_digit, ind_common, married,
       {sql_rounded("wage_real", 5)} as wage_real, tenure, short_hours, no_income
from sample""")
def select_sample_long(spark, sf_dir):
    return long_sample(spark, sf_dir).select(
        "pid", "year", "occ3", "ind3", "occ_common", "occ_one_digit", "ind_common", "married",
        rounded("wage_real", 5).alias("wage_real"), "tenure", "short_hours", "no_income")


@query("exclude_persons", f"""
with {SQL_PANEL}
select pid, year from (
    select *, bool_or(coalesce(ind3 = 0, false)) over w as ever_zero,
           bool_or(wage < 1) over w as low_wage
    from panel window w as (partition by pid))
where not ever_zero and not coalesce(low_wage, false)""")
def exclude_persons(spark, sf_dir):
    df = filters.person_flags(panel(spark, sf_dir), {
        "ever_zero": is_one_of("ind3", [0]), "low_wage": F.col("wage") < 1})
    return filters.exclude_persons(df, ["ever_zero", "low_wage"]).select("pid", "year")


@query("demographics", f"""
with {SQL_PANEL}
select pid, year, age, region from panel
where sex = 1 and relation in (1, 10) and age between 18 and 64 and region in (1, 2, 3, 4)
  and year between 1996 and 2000 and year <> 1999""")
def demographics(spark, sf_dir):
    df = filters.demographics(panel(spark, sf_dir, region=True))
    return filters.years(df, 1996, 2000, exclude=[1999]).select("pid", "year", "age", "region")


@query("work_flags", f"""
with {SQL_PANEL}
select pid, year, hours <= 500 as short_hours, tenure is null or tenure = 0 as no_income
from panel""")
def work_flags(spark, sf_dir):
    df = panel(spark, sf_dir).withColumn("low_wage", F.lit(False))
    return filters.work_flags(df, wage="tenure").select("pid", "year", "short_hours", "no_income")


@query("subsamples", """
select 'SRC' as sample, count(*) as n from orders where o_orderkey % 9400 < 3000
union all select 'immigrant', count(*) from orders
    where o_orderkey % 9400 > 3000 and o_orderkey % 9400 < 5000
union all select 'SEO', count(*) from orders
    where o_orderkey % 9400 > 5000 and o_orderkey % 9400 < 7000
union all select 'latino', count(*) from orders
    where o_orderkey % 9400 > 7000 and o_orderkey % 9400 < 9309""")
def subsamples(spark, sf_dir):
    people = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 9400).alias("id1968"))
    counts = people.agg(*[F.count_if(filters.in_subsample(s)).alias(s) for s in filters.SUBSAMPLES])
    return counts.unpivot([], list(filters.SUBSAMPLES), "sample", "n")


def _head_sql(place: str) -> str:
    return f"""
select o_orderkey, year(o_orderdate)::int - 15 as year from orders
where o_orderkey % 11 = case when year(o_orderdate) - 15 < 1983 then 1 else 10 end and {place}"""


def _members(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.year("o_orderdate") - 15).alias("year"), (key % 11).alias("relation"),
        F.floor(key / 11).cast("long").alias("household")).withColumn(
        "sequence", F.col("household") % 30)


@query("heads_only", _head_sql("floor(o_orderkey / 11) % 30 between 1 and 20"))
def heads_only(spark, sf_dir):
    return filters.heads(_members(spark, sf_dir), "any").select("o_orderkey", "year")


@query("current_heads_only", _head_sql("floor(o_orderkey / 11) % 30 = 1"))
def current_heads_only(spark, sf_dir):
    return filters.heads(_members(spark, sf_dir), "current").select("o_orderkey", "year")


@query("design_balanced", f"""
with {SQL_PANEL}
select pid, year from (select *, count(*) over (partition by pid) as n from panel) where n = 7""")
def design_balanced(spark, sf_dir):
    return filters.design(panel(spark, sf_dir), balanced=range(1995, 2002)).select("pid", "year")


@query("design_min_waves", f"""
with {SQL_PANEL}
select pid, year from (select *, count(*) over (partition by pid) as n from panel) where n >= 5""")
def design_min_waves(spark, sf_dir):
    return filters.design(panel(spark, sf_dir), min_waves=5).select("pid", "year")


@query("design_min_consecutive", f"""
with {SQL_PANEL},
runs as (select pid, year, year - row_number() over (partition by pid order by year) as run
         from panel),
lengths as (select *, count(*) over (partition by pid, run) as n from runs)
select pid, year from (select *, max(n) over (partition by pid) as longest from lengths)
where longest >= 4""")
def design_min_consecutive(spark, sf_dir):
    return filters.design(panel(spark, sf_dir), min_consecutive=4).select("pid", "year")


@query("reliable_triples", f"""
with {SQL_PANEL},
t as (select *, emp_status = 1 and lag(emp_status) over w = 1 and lead(emp_status) over w = 1
                as triple
      from panel window w as (partition by pid order by year))
select pid, year, bool_or(coalesce(triple, false)) over (partition by pid) as reliable from t""")
def reliable_triples(spark, sf_dir):
    return filters.reliable_triples(panel(spark, sf_dir)).select("pid", "year", "reliable")


@query("left_censor", f"""
with {SQL_CODES}
select pid, year, occ_spell, ind_spell from code_spells
where not (first_year > 1995 and occ_spell < 2 and ind_spell < 2)""")
def left_censor(spark, sf_dir):
    return filters.drop_left_censored(coded_panel(spark, sf_dir), after=1995).select(
        "pid", "year", "occ_spell", "ind_spell")


@query("first_appearance", f"""
with {SQL_PANEL} select pid, year, min(year) over (partition by pid) as first_year from panel""")
def first_appearance(spark, sf_dir):
    return filters.first_appearance(panel(spark, sf_dir)).select("pid", "year", "first_year")


@query("non_response", f"""
with {SQL_PANEL} select pid, year, tenure from panel where tenure is not null""")
def non_response(spark, sf_dir):
    return filters.drop_non_response(panel(spark, sf_dir), "tenure").select("pid", "year", "tenure")


@query("one_row_per_wave", f"""
with {SQL_PANEL} select pid, year, o_orderkey, o_orderdate, o_totalprice from panel""")
def one_row_per_wave(spark, sf_dir):
    return panel(spark, sf_dir, "o_orderkey", "o_orderdate", "o_totalprice").select(
        "pid", "year", "o_orderkey", "o_orderdate", "o_totalprice")
