"""Recodes and derived columns."""

import uuid

from pyspark.sql import functions as F

from wavespan.catalog.adapter import SQL_PANEL, panel, rounded, sql_rounded, table
from wavespan.catalog.registry import query
from wavespan.operators import exposure, recode, rules
from wavespan.operators.recode import Recode
from wavespan.session import shared_folder


SQL_SENTINELS = f"""
with {SQL_PANEL}
select pid, year, case when year = 1998 then null when ind3 = 0 then null
                       when year <= 1997 and ind3 in (5, 6) then null else ind3 end as ind3,
       case when year >= 1999 and hours in (998, 999) then 0 else hours end as hours,
       case when tenure = 0.25 then null else tenure end as tenure
from panel"""


@query("recode_sentinels", SQL_SENTINELS)
def recode_sentinels(spark, sf_dir):
    return recode.recode(panel(spark, sf_dir), [
        Recode("ind3", None, lo=1998, hi=1998), Recode("ind3", (0,)),
        Recode("ind3", (5, 6), hi=1997), Recode("hours", (998, 999), to=0, lo=1999),
        Recode("tenure", (0.25,)),
    ]).select("pid", "year", "ind3", "hours", "tenure")


RULE_FILE = [
    (1, "ind3", "code", 1998, 1998, None, None), (2, "ind3", "code", None, None, "0", None),
    (3, "ind3", "code", None, 1997, "5", None), (4, "ind3", "code", None, 1997, "6", None),
    (5, "hours", "code", 1999, None, "998", "0"), (6, "hours", "code", 1999, None, "999", "0"),
    (7, "tenure", "code", None, None, "0.25", None)]
MORE_RULES = [
    (1, "code", "era", None, None, "ind3", None), (2, "code", "era", 1999, None, "occ3", None),
    (3, "measure", "role", None, None, "tenure", "wage"), (4, "hours", "unit", 1996, 1998, None, "12"),
    (5, "code", "code", None, 1999, "3", "2"), (6, "code", "code", 1998, None, "3", "4")]


def _rule_file(spark, rows):
    path = f"{shared_folder(spark)}/wavespan/{uuid.uuid4().hex}"
    spark.createDataFrame(rows, rules.SCHEMA).write.option("header", True).csv(path)
    return rules.read_rules(spark, path)


@query("recode_from_rules", SQL_SENTINELS)
def recode_from_rules(spark, sf_dir):
    """The sentinels again, from a rule file."""
    return rules.apply_rules(panel(spark, sf_dir), _rule_file(spark, RULE_FILE)).select(
        "pid", "year", "ind3", "hours", "tenure")


@query("eras_roles_units_from_rules", f"""
with {SQL_PANEL},
eras as (select *, case when year >= 1999 then occ3 else ind3 end as code from panel)
select pid, year, relation, case when code = 3 and year <= 1999 then 2
                                 when code = 3 then 4 else code end as code,
       case when relation in (20, 22) then wage else tenure end as measure,
       {sql_rounded("case when year between 1996 and 1998 then hours::double / 12 else hours end")}
           as hours
from eras""")
def eras_roles_units_from_rules(spark, sf_dir):
    """Eras, roles, units and codes from one rule file; of rules for one code the first counts."""
    df = rules.apply_rules(panel(spark, sf_dir), _rule_file(spark, MORE_RULES))
    return df.select("pid", "year", "relation", "code", "measure", rounded("hours").alias("hours"))


@query("era_coalesce", f"""
with {SQL_PANEL}
select pid, year, case when year >= 1999 then occ3 else ind3 end as code,
       case when year between 1998 and 2000 then hours else age end as picked
from panel""")
def era_coalesce(spark, sf_dir):
    df = recode.era_coalesce(panel(spark, sf_dir), {"code": ("ind3", "occ3", 1999)}, drop=False)
    return recode.era_coalesce(df, {"picked": ("age", "hours", 1998)}, until=2000).select(
        "pid", "year", "code", "picked")


@query("role_collapse", f"""
with {SQL_PANEL}
select pid, year, relation,
       case when relation in (20, 22) then ind3 else occ3 end as code,
       case when relation in (2, 20, 22) then wage else tenure end as measure,
       case when relation in (20, 22) then null else hours end as hours
from panel""")
def role_collapse(spark, sf_dir):
    df = recode.role_collapse(panel(spark, sf_dir), {"code": ("occ3", "ind3")})
    df = recode.role_collapse(df, {"measure": ("tenure", "wage")}, spouse_codes=(2, 20, 22))
    return recode.role_blank(df, ["hours"]).select(
        "pid", "year", "relation", "code", "measure", "hours")


@query("unit_convert", f"""
with {SQL_PANEL}
select pid, year,
       {sql_rounded("case when year between 1996 and 1998 then hours::double / 12 else hours end")}
           as hours
from panel""")
def unit_convert(spark, sf_dir):
    df = recode.scale_in_era(panel(spark, sf_dir), "hours", 12, 1996, 1998)
    return df.select("pid", "year", rounded("hours").alias("hours"))


@query("dummies", f"""
with {SQL_PANEL}
select pid, year, case when emp_status = 1 then 1 when emp_status <> 1 then 0 end as employed,
       case when occ3 = 1 then 0 when occ3 <> 1 then 1 end as not_first,
       (coalesce(ind3 in (1, 2, 3), false))::int as low_code
from panel""")
def dummies(spark, sf_dir):
    df = recode.dummy(panel(spark, sf_dir), "employed", "emp_status", 1)
    df = recode.dummy(df, "not_first", "occ3", 1, negate=True)
    return recode.flag_in(df, "low_code", "ind3", (1, 2, 3)).select(
        "pid", "year", "employed", "not_first", "low_code")


@query("polynomial_terms", f"""
with {SQL_PANEL}
select pid, year, {sql_rounded("tenure * tenure * 100", 4)} as tenure2_100,
       {sql_rounded("tenure * tenure * tenure * 100", 4)} as tenure3_100
from panel""")
def polynomial_terms(spark, sf_dir):
    df = exposure.powers(panel(spark, sf_dir), {"tenure2_100": ("tenure", 2, 100),
                                                "tenure3_100": ("tenure", 3, 100)})
    return df.select("pid", "year", rounded("tenure2_100", 4).alias("tenure2_100"),
                     rounded("tenure3_100", 4).alias("tenure3_100"))


@query("log_wage", f"""
with {SQL_PANEL}
select pid, year, {sql_rounded("ln(wage - 1)", 5)} as log_wage from panel where wage - 1 > 0""")
def log_wage(spark, sf_dir):
    df = panel(spark, sf_dir).withColumn("above", F.col("wage") - 1)
    return recode.log_positive(df, "above", "log_wage").select(
        "pid", "year", rounded("log_wage", 5).alias("log_wage"))


@query("text_to_number", """
select o_orderkey, try_cast(substr(o_orderpriority, 1, 1) as double) as leading,
       try_cast(o_orderpriority as double) as whole,
       try_cast(case when o_orderkey % 3 = 0 then o_orderstatus
                     else (o_orderkey % 100)::varchar end as double) as mixed
from orders""")
def text_to_number(spark, sf_dir):
    key = F.col("o_orderkey")
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("leading"),
        F.col("o_orderpriority").alias("whole"),
        F.when(key % 3 == 0, F.col("o_orderstatus"))
        .otherwise((key % 100).cast("string")).alias("mixed"))
    return recode.numeric(df, ["leading", "whole", "mixed"])


@query("person_key", """
select o_orderkey, (o_custkey * 1000 + o_orderkey % 1000)::bigint as pid from orders""")
def person_key(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("id1968"), (F.col("o_orderkey") % 1000).alias("pernum"))
    return recode.person_id(df).select("o_orderkey", "pid")


@query("drop_columns", f"""
with {SQL_PANEL}
select pid, year, relation, age as "relation.head" from panel""")
def drop_columns(spark, sf_dir):
    df = panel(spark, sf_dir).select(
        "pid", "year", "relation", F.col("age").alias("relation.head"),
        F.col("hours").alias("hours_Head"), F.col("wage").alias("wage_Spouse"), "sex")
    return recode.drop_matching(df, "Head|Spouse", ["sex", "never_there"])


@query("deflate_by_index", f"""
with {SQL_PANEL},
prices as (select year(o_orderdate)::int as year, avg(o_totalprice) as value from orders
           where year(o_orderdate) <> 2001 group by 1)
select p.pid, p.year,
       {sql_rounded("p.wage * (select max(value) from prices where year = 1997) / i.value", 5)}
           as wage_real
from panel p left join prices i on i.year = p.year""")
def deflate_by_index(spark, sf_dir):
    """Yearly average price as the index, base 1997; the index has no 2001 value."""
    index = (
        table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_totalprice")
        .filter(F.col("year") != 2001).groupBy("year").agg(F.avg("o_totalprice").alias("value")))
    df = recode.deflate(panel(spark, sf_dir), index, "wage", "wage_real", 1997)
    return df.select("pid", "year", rounded("wage_real", 5).alias("wage_real"))
