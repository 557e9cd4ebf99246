"""Tables, shares and distributions."""

from pyspark.sql import functions as F

from wavespan.catalog.adapter import (SQL_CHANGES, SQL_CODES, SQL_PANEL, SQL_SPELLS, changed_panel,
                                      coded_panel, panel, rounded, spelled_panel, sql_rounded,
                                      table)
from wavespan.catalog.registry import query
from wavespan.operators import describe, recode


@query("change_share_by_year", f"""
with {SQL_SPELLS}
select year, {sql_rounded("sum(change_t::int)::double / count(*)")} as change_t,
       {sql_rounded("sum(change_24t::int)::double / count(*)")} as change_24t
from spells where emp_status = 1 group by year""")
def change_share_by_year(spark, sf_dir):
    """Flagship: share of the employed who changed employers, by wave."""
    shares = describe.share_by_year(spelled_panel(spark, sf_dir), ["change_t", "change_24t"])
    return shares.select("year", rounded("change_t").alias("change_t"),
                         rounded("change_24t").alias("change_24t")).orderBy("year")


@query("change_share_long", f"""
with {SQL_CODES},
shares as (
    select year, sum(occ_emp::int)::double / count(*) as occ_emp,
           sum(ind_emp::int)::double / count(*) as ind_emp,
           sum(ind_24t::int)::double / count(*) as ind_24t
    from code_spells where emp_status = 1 group by year)
select year, variable, {sql_rounded("value")} as value
from shares unpivot (value for variable in (occ_emp, ind_emp, ind_24t))""")
def change_share_long(spark, sf_dir):
    names = ["occ_emp", "ind_emp", "ind_24t"]
    shares = describe.share_by_year(coded_panel(spark, sf_dir), names)
    return describe.to_long(shares, ["year"], names).select(
        "year", "variable", rounded("value").alias("value"))


@query("tenure_by_year", f"""
with {SQL_PANEL}
select year, {sql_rounded("avg(tenure)")} as mean_value,
       {sql_rounded("quantile_cont(tenure, 0.5)")} as median_value, count(*) as n_rows
from panel group by year""")
def tenure_by_year(spark, sf_dir):
    return describe.level_by_year(panel(spark, sf_dir), "tenure").select(
        "year", rounded("mean_value").alias("mean_value"),
        rounded("median_value").alias("median_value"), "n_rows")


@query("wage_quantiles_by_year", f"""
with {SQL_PANEL}
select year, {", ".join(f"{sql_rounded(f'quantile_cont(wage, {p})')} as p{round(p * 100)}"
                        for p in (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99))}
from panel group by year""")
def wage_quantiles_by_year(spark, sf_dir):
    points = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
    names = [f"p{round(p * 100)}" for p in points]
    q = describe.exact_percentiles(panel(spark, sf_dir), "wage", points, names=names)
    return q.select("year", *[rounded(n).alias(n) for n in names])


@query("crosstab_flags", f"""
with {SQL_CHANGES}
select change_t, count(*) filter (where not change_24t) as change_24t_false,
       count(*) filter (where change_24t) as change_24t_true
from changes group by change_t""")
def crosstab_flags(spark, sf_dir):
    return describe.crosstab(changed_panel(spark, sf_dir), "change_t", "change_24t", [False, True])


@query("crosstab_codes", f"""
with {SQL_PANEL}
select occ3, ind3, count(*) as n from panel where occ3 is not null and ind3 is not null
group by occ3, ind3""")
def crosstab_codes(spark, sf_dir):
    """Levels of both variables as they come in the data."""
    return describe.crosstab_long(panel(spark, sf_dir), "occ3", "ind3")


SQL_TENURE_BY_CODE = f"""
with {SQL_PANEL}, coded as (select nullif(ind3, 0) as code, tenure from panel)"""


def _tenure_by_code(spark, sf_dir):
    return panel(spark, sf_dir).select(F.nullif("ind3", F.lit(0)).alias("code"), "tenure")


@query("tenure_by_code", f"""{SQL_TENURE_BY_CODE}
select code, {sql_rounded("avg(tenure)")} as mean_value,
       {sql_rounded("quantile_cont(tenure, 0.5)")} as median_value, count(*) as n_rows
from coded group by code""")
def tenure_by_code(spark, sf_dir):
    """A missing code is a group of its own."""
    return describe.level_by_year(_tenure_by_code(spark, sf_dir), "tenure", "code").select(
        "code", rounded("mean_value").alias("mean_value"),
        rounded("median_value").alias("median_value"), "n_rows")


@query("box_by_code", f"""{SQL_TENURE_BY_CODE},
q as (select code, quantile_cont(tenure, 0.25) as q1, quantile_cont(tenure, 0.5) as median,
             quantile_cont(tenure, 0.75) as q3 from coded where tenure is not null group by code),
r as (select q.*, tenure, tenure between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as near
      from coded c join q on q.code is not distinct from c.code where tenure is not null)
select code, {sql_rounded("q1")} as q1, {sql_rounded("median")} as median, {sql_rounded("q3")} as q3,
       min(tenure) filter (where near) as whisker_low,
       max(tenure) filter (where near) as whisker_high,
       count(*) filter (where not near) as outliers, count(*) as n
from r group by r.code, r.q1, r.median, r.q3""")
def box_by_code(spark, sf_dir):
    box = describe.box_by_year(_tenure_by_code(spark, sf_dir), "tenure", "code")
    return box.select("code", *[rounded(c).alias(c) for c in ("q1", "median", "q3")],
                      "whisker_low", "whisker_high", "outliers", "n")


@query("price_quantiles_by_ship_year", f"""
with lines as (select year(l_shipdate)::int as year, l_extendedprice::double as price from lineitem)
select year, {", ".join(f"{sql_rounded(f'quantile_cont(price, {p})')} as p{round(p * 100)}"
                        for p in (0.01, 0.25, 0.5, 0.75, 0.99))}
from lines group by year""")
def price_quantiles_by_ship_year(spark, sf_dir):
    """Every line of every order, large groups of nearly distinct values."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("year"), F.col("l_extendedprice").cast("double").alias("price"))
    points = [0.01, 0.25, 0.5, 0.75, 0.99]
    q = describe.exact_percentiles(lines, "price", points)
    return q.select("year", *[rounded(f"p{round(p * 100)}").alias(f"p{round(p * 100)}")
                              for p in points])


@query("spell_count_dist", f"""
with {SQL_SPELLS},
per_person as (select pid, case when count(*) = count(emp_spell) then max(emp_spell) end as most
               from spells group by pid)
select most as max_value, count(*) as persons from per_person where most is not null group by most""")
def spell_count_dist(spark, sf_dir):
    return describe.count_distribution(spelled_panel(spark, sf_dir), "emp_spell")


@query("count_of_counts", f"""
with {SQL_PANEL}
select n_rows, count(*) as persons from (select count(*) as n_rows from panel group by pid)
group by n_rows""")
def count_of_counts(spark, sf_dir):
    return describe.count_of_counts(panel(spark, sf_dir))


VARIABLES = ["age", "hours", "wage", "tenure", "emp_status"]


@query("descriptive_table", f"""
with {SQL_PANEL}
{" union all ".join(
    f"select '{v}' as variable, count({v}) as n, {sql_rounded(f'avg({v})')} as mean, "
    f"{sql_rounded(f'stddev_samp({v})')} as sd from panel" for v in VARIABLES)}""")
def descriptive_table(spark, sf_dir):
    return describe.describe(panel(spark, sf_dir), VARIABLES).select(
        "variable", "n", rounded("mean").alias("mean"), rounded("sd").alias("sd"))


@query("box_by_year", f"""
with {SQL_PANEL},
q as (select year, quantile_cont(tenure, 0.25) as q1, quantile_cont(tenure, 0.5) as median,
             quantile_cont(tenure, 0.75) as q3 from panel where tenure is not null group by year),
r as (select q.*, tenure, tenure between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as near
      from panel p join q on q.year = p.year where tenure is not null)
select year, {sql_rounded("q1")} as q1, {sql_rounded("median")} as median, {sql_rounded("q3")} as q3,
       min(tenure) filter (where near) as whisker_low,
       max(tenure) filter (where near) as whisker_high,
       count(*) filter (where not near) as outliers, count(*) as n
from r group by r.year, r.q1, r.median, r.q3""")
def box_by_year(spark, sf_dir):
    box = describe.box_by_year(panel(spark, sf_dir), "tenure")
    return box.select("year", *[rounded(c).alias(c) for c in ("q1", "median", "q3")],
                      "whisker_low", "whisker_high", "outliers", "n")


@query("boxes_by_year", f"""
with {SQL_PANEL},
long as (select year, variable, value from (
    select year, tenure, wage, hours::double as hours from panel)
    unpivot include nulls (value for variable in (tenure, wage, hours))),
q as (select year, variable, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median,
             quantile_cont(value, 0.75) as q3 from long where value is not null group by all),
r as (select q.*, value, value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as near
      from long p join q on q.year = p.year and q.variable = p.variable where value is not null)
select year, variable, {sql_rounded("q1")} as q1, {sql_rounded("median")} as median,
       {sql_rounded("q3")} as q3, min(value) filter (where near) as whisker_low,
       max(value) filter (where near) as whisker_high,
       count(*) filter (where not near) as outliers, count(*) as n
from r group by r.year, r.variable, r.q1, r.median, r.q3""")
def boxes_by_year(spark, sf_dir):
    """Boxes of several variables from the same passes."""
    box = describe.box_by_year(panel(spark, sf_dir), ["tenure", "wage", "hours"])
    return box.select("year", "variable", *[rounded(c).alias(c) for c in ("q1", "median", "q3")],
                      "whisker_low", "whisker_high", "outliers", "n")


@query("levels_by_year", f"""
with {SQL_PANEL}
select year, variable, {sql_rounded("avg(value)")} as mean_value,
       {sql_rounded("quantile_cont(value, 0.5)")} as median_value, count(*) as n_rows
from (select year, tenure, wage from panel)
unpivot include nulls (value for variable in (tenure, wage)) group by all""")
def levels_by_year(spark, sf_dir):
    """Mean and median of several variables from the same passes."""
    return describe.level_by_year(panel(spark, sf_dir), ["tenure", "wage"]).select(
        "year", "variable", rounded("mean_value").alias("mean_value"),
        rounded("median_value").alias("median_value"), "n_rows")


@query("hist_by_year", f"""
with {SQL_PANEL}
select year, case when wage < 5 then 0 when wage >= 45 then 11
                  else floor((wage - 5) * 10 / 40) + 1 end::bigint as bin, count(*) as n
from panel where wage is not null group by all""")
def hist_by_year(spark, sf_dir):
    return describe.histogram(panel(spark, sf_dir), "wage", 5, 45, 10)


@query("married_table", f"""
with {SQL_PANEL},
d as (select year, case when relation = 10 then 0 when relation <> 10 then 1 end as other
      from panel)
select year, {sql_rounded("avg(other)")} as mean, {sql_rounded("stddev_samp(other)")} as sd
from d group by year""")
def married_table(spark, sf_dir):
    df = recode.dummy(panel(spark, sf_dir), "other", "relation", 10, negate=True)
    return df.groupBy("year").agg(rounded(F.avg("other")).alias("mean"),
                                  rounded(F.stddev_samp("other")).alias("sd"))
