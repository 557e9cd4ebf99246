"""The driver's tables seen as a person x wave panel, in Spark and in SQL.

A customer is a person, an order year a wave, and the first order of the year the report.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavespan.operators import change, filters, spells
from wavespan.operators.change import ChangeRules

TOLERANCE = 0.5     # suits tenures of 0.25 to 2.75 years
RULES = ChangeRules(tolerance=TOLERANCE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without negative zero, for comparison with SQL."""
    r = F.round(F.col(c) if isinstance(c, str) else c, digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def sql_rounded(expression: str, digits: int = 6) -> str:
    return f"(case when round({expression}, {digits}) = 0 then 0.0::double " \
           f"else round({expression}, {digits}) end)"


def panel(spark: SparkSession, sf_dir: str, *extra: str, region: bool = False) -> DataFrame:
    """One row per customer and order year. ``extra`` names raw-order columns to keep.

    The status and priority codes are derived before the reduction, so that it carries numbers
    only and no strings.
    """
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    first = filters.one_row_per_wave(
        orders.select(
            F.col("o_custkey").alias("pid"), F.year("o_orderdate").alias("year"),
            "o_orderdate", "o_orderkey", "o_totalprice",
            F.when(F.col("o_orderstatus") == "F", 1)
            .when(F.col("o_orderstatus") == "O", 2).alias("emp_status"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("occ3")),
        ["o_orderdate", "o_orderkey"])
    derived = {
        "pid": F.col("pid"),
        "year": F.col("year"),
        "emp_status": F.col("emp_status"),
        "occ3": F.col("occ3"),
        "ind3": (key % 7).cast("int"),
        "tenure": F.nullif(key % 12, F.lit(0)) / F.lit(4.0),
        "hours": F.floor(F.col("o_totalprice") / 200).cast("int"),
        "wage": F.round("o_totalprice") / F.lit(10000.0),
        "relation": F.when(key % 5 == 0, 20).when(key % 5 == 1, 22).otherwise(10),
        "age": (18 + F.col("pid") % 50 + F.col("year") - 1995).cast("int"),
        "sex": (1 + F.col("pid") % 2).cast("int"),
    }
    result = first.select(*[c.alias(n) for n, c in derived.items()],
                          *[F.col(c) for c in extra])
    if not region:
        return result
    regions = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(F.col("c_custkey").alias("pid"), F.col("n_regionkey").alias("region"))
    )
    return result.join(regions, "pid", "left")


# --- the same steps in SQL -------------------------------------------------------------------

SQL_PANEL = """
first_orders as (
    select *, year(o_orderdate)::int as yr,
           row_number() over (partition by o_custkey, year(o_orderdate)
                              order by o_orderdate, o_orderkey) as rn
    from orders),
panel as (
    select o_custkey as pid, yr as year,
           case o_orderstatus when 'F' then 1 when 'O' then 2 end as emp_status,
           substr(o_orderpriority, 1, 1)::int as occ3,
           (o_orderkey % 7)::int as ind3,
           nullif(o_orderkey % 12, 0)::double / 4 as tenure,
           floor(o_totalprice / 200)::int as hours,
           round(o_totalprice)::double / 10000 as wage,
           case o_orderkey % 5 when 0 then 20 when 1 then 22 else 10 end as relation,
           (18 + o_custkey % 50 + yr - 1995)::int as age,
           (1 + o_custkey % 2)::int as sex,
           n_regionkey as region, o_orderkey, o_orderdate, o_totalprice
    from first_orders
    left join customer on c_custkey = o_custkey
    left join nation on n_nationkey = c_nationkey
    where rn = 1)"""



def sql_changes(source: str, tolerance: float) -> str:
    return f"""
gaps as (
    select *, year - lag(year) over w as gap, lag(tenure) over w as tenure_before,
           min(year) over (partition by pid) as first_year
    from {source} window w as (partition by pid order by year)),
changes as (
    select *, coalesce(tenure < gap, false) as change_t,
           coalesce(tenure < gap, false)
           or coalesce(tenure > tenure_before + gap + {tolerance}
                       or tenure < tenure_before + gap - {tolerance}, false) as change_24t
    from gaps)"""


SQL_SPELLS_ON_CHANGES = """
working as (
    select * from (
        select *, bool_or(coalesce(emp_status = 1, false)) over (partition by pid) as ever,
               min(case when emp_status = 1 then year end) over (partition by pid) as first_job
        from changes) where ever),
counted as (
    select *,
           (sum(case when year = first_job then 1 else change_t::int end) over w)::int as c,
           (sum(case when year = first_job then 1 else change_24t::int end) over w)::int as c24
    from working window w as (partition by pid order by year rows unbounded preceding)),
spells as (
    select *,
           case when bool_or(coalesce(emp_status = 1, false)) over (partition by pid, c)
                then c end as emp_spell,
           case when bool_or(coalesce(emp_status = 1, false)) over (partition by pid, c24)
                then c24 end as emp_spell_24t
    from counted)"""

SQL_CODES_ON_SPELLS = """
reported as (
    select * from (
        select *, min(case when tenure is not null then year end) over (partition by pid) as start
        from spells) where year >= start),
occ_rows as (
    select pid, year, occ3 <> lag(occ3) over (partition by pid order by year) as differs
    from changes where occ3 is not null),
ind_rows as (
    select pid, year, ind3 <> lag(ind3) over (partition by pid order by year) as differs
    from changes where ind3 <> 0),
gated as (
    select r.*, nullif(r.ind3, 0) as ind,
           coalesce(o.differs, false) and change_t as occ_emp,
           coalesce(i.differs, false) and change_t as ind_emp,
           coalesce(o.differs, false) and change_24t as occ_24t,
           coalesce(i.differs, false) and change_24t as ind_24t
    from reported r
    left join occ_rows o on o.pid = r.pid and o.year = r.year
    left join ind_rows i on i.pid = r.pid and i.year = r.year),
starts as (
    select *,
           min(case when emp_status = 1 and occ3 is not null then year end)
               over (partition by pid) as occ_start,
           min(case when emp_status = 1 and ind is not null then year end)
               over (partition by pid) as ind_start
    from gated),
code_spells as (
    select *,
           nullif((sum(case when year = occ_start then 1 else occ_emp::int end) over w)::int, 0)
               as occ_spell,
           nullif((sum(case when year = ind_start then 1 else ind_emp::int end) over w)::int, 0)
               as ind_spell,
           nullif((sum(case when year = occ_start then 1 else occ_24t::int end) over w)::int, 0)
               as occ_spell_24t,
           nullif((sum(case when year = ind_start then 1 else ind_24t::int end) over w)::int, 0)
               as ind_spell_24t
    from starts window w as (partition by pid order by year rows unbounded preceding))"""

SQL_CHANGES = f"{SQL_PANEL},{sql_changes('panel', TOLERANCE)}"
SQL_SPELLS = f"{SQL_CHANGES},{SQL_SPELLS_ON_CHANGES}"
SQL_CODES = f"{SQL_SPELLS},{SQL_CODES_ON_SPELLS}"


def changed_panel(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return change.job_change(panel(spark, sf_dir, *extra), rules=RULES)


def spelled_panel(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return spells.employer_spells(changed_panel(spark, sf_dir, *extra))


CODE_GATES = {"{}_emp": "change_t", "{}_24t": "change_24t"}


def with_code_changes(df: DataFrame, codes: Sequence[str] = ("occ", "ind"),
                      ungated_until: int = 1980) -> DataFrame:
    df = df.withColumn("ind", F.nullif(F.col("ind3"), F.lit(0))).withColumn("occ", F.col("occ3"))
    return change.code_changes(df, {
        f"{code}_unc": (code, {k.format(code): v for k, v in CODE_GATES.items()}) for code in codes
    }, ungated_until=ungated_until)


def coded_panel(spark: SparkSession, sf_dir: str, *extra: str,
                late_era_from: int | None = None) -> DataFrame:
    """Employer, occupation and industry spells from the first tenure report on."""
    df = with_code_changes(changed_panel(spark, sf_dir, *extra))
    df = spells.from_first_report(spells.employer_spells(df))
    return spells.code_spells(df, {
        "occ_spell": ("occ_emp", "occ"), "ind_spell": ("ind_emp", "ind"),
        "occ_spell_24t": ("occ_24t", "occ"), "ind_spell_24t": ("ind_24t", "ind"),
    }, late_era_from=late_era_from)
