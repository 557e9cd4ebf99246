"""From files to tables: the driver's tables land in a folder of the job and are read back."""

import uuid

from pyspark.sql import functions as F

from wavespan.catalog.adapter import rounded, sql_rounded, table
from wavespan.catalog.assembly import (PANEL_COLUMNS, SQL_COLUMNS, SQL_MEMBERS, WEALTH_REQUEST,
                                       FAMILY_REQUEST, INDEX_REQUEST, family_waves, person_index,
                                       wealth_waves)
from wavespan.catalog.registry import query
from wavespan.operators import assemble
from wavespan.plans import series
from wavespan.sources import files
from wavespan.session import shared_folder


def job_folder(spark):
    return f"{shared_folder(spark)}/wavespan/{uuid.uuid4().hex}"


def landing_zone(spark, sf_dir):
    """Households, persons and supplements as a survey would land them."""
    root = job_folder(spark)
    for year, wave in family_waves(spark, sf_dir).items():
        wave.write.parquet(f"{root}/fam/year={year}")
    for year, wave in wealth_waves(spark, sf_dir).items():
        wave.write.parquet(f"{root}/wealth/year={year}")
    person_index(spark, sf_dir).limit(0).write.parquet(f"{root}/ind1")   # an earlier release
    person_index(spark, sf_dir).write.parquet(f"{root}/ind2")
    return root


def as_csv(spark, df):
    path = job_folder(spark)
    df.write.option("header", True).csv(path)   # one file a task, in the order of their names
    return path


@query("landed_panel", f"""
with {SQL_MEMBERS}
select {SQL_COLUMNS}, s_acctbal as assets
from assembled left join supplier on s_suppkey = interview and year = 1994""")
def landed_panel(spark, sf_dir):
    root, years = landing_zone(spark, sf_dir), list(FAMILY_REQUEST)
    return assemble.build_panel(
        files.family_scan(spark, root, years), files.person_index(spark, root), FAMILY_REQUEST,
        INDEX_REQUEST, wealth=files.wealth_waves(spark, root, years),
        wealth_request=WEALTH_REQUEST, design="all").select(*PANEL_COLUMNS, "assets")


def _long_list(spark, request, rename=None):
    rows = [(y, (rename or {}).get(n, n), v) for y, names in request.items()
            for n, v in names.items()]
    return spark.createDataFrame(rows, "year int, name string, variable string")


@query("landed_core_heads", f"""
with {SQL_MEMBERS}
select {SQL_COLUMNS.replace("area", "area as zone")}, s_acctbal as assets
from assembled left join supplier on s_suppkey = interview and year = 1994
where relation = 10 and sequence between 1 and 20 and id1968 < 3000""")
def landed_core_heads(spark, sf_dir):
    """The core heads preset from a landing zone and variable lists that landed as CSV."""
    root = landing_zone(spark, sf_dir)
    lists = [files.variable_list(spark, as_csv(spark, _long_list(spark, r, {"area": "zone"})))
             for r in (FAMILY_REQUEST, INDEX_REQUEST, WEALTH_REQUEST)]
    panel = series.core_heads_panel(spark, root, *lists)
    return panel.select(*["zone" if c == "area" else c for c in PANEL_COLUMNS], "assets")


@query("landed_hierarchy", """
select n_nationkey as code, n_name as two_digit,
       case when n_regionkey = 0 then null else n_regionkey::varchar end as one_digit from nation""")
def landed_hierarchy(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("OCC_3D"), F.col("n_name").alias("OCC_2D"),
        F.nullif("n_regionkey", F.lit(0)).alias("OCC_1D"))
    path = as_csv(spark, nations)
    return files.code_hierarchy(spark, path, "code", "two_digit", "one_digit")


@query("landed_prices", f"""
select year(o_orderdate)::int as year, {sql_rounded("avg(o_totalprice)", 4)} as value
from orders group by all""")
def landed_prices(spark, sf_dir):
    prices = table(spark, sf_dir, "orders").groupBy(
        F.make_date(F.year("o_orderdate"), F.lit(1), F.lit(1)).alias("DATE")).agg(
        F.avg("o_totalprice").alias("value"))
    return files.price_index(spark, as_csv(spark, prices)).select(
        "year", rounded("value", 4).alias("value"))


@query("landed_census_crosswalk", """
select p_brand as code, p_size::varchar as common,
       row_number() over (order by p_partkey desc) - 1 as ord from part""")
def landed_census_crosswalk(spark, sf_dir):
    """Rows keep the order they have in the files, one for each range of the sort."""
    parts = table(spark, sf_dir, "part").orderBy(F.desc("p_partkey")).select(
        F.col("p_brand").alias("1970"), F.col("p_size").alias("ACS 2010-"), "p_name")
    return files.census_crosswalk(spark, as_csv(spark, parts), {"1970": "code", "ACS 2010-": "common"})


@query("landed_variable_crosswalk", """
select n_name as concept, 'V' || n_nationkey as "Y1968",
       case when n_nationkey % 3 = 0 then null else 'V' || (n_nationkey + 100) end as "Y1969",
       row_number() over (order by n_nationkey) - 1 as ord from nation""")
def landed_variable_crosswalk(spark, sf_dir):
    k = F.col("n_nationkey")
    nations = table(spark, sf_dir, "nation").orderBy(k).select(
        F.col("n_name").alias("concept"), F.concat(F.lit("V"), k).alias("Y1968"),
        F.when(k % 3 != 0, F.concat(F.lit("V"), k + 100)).alias("Y1969"))
    return files.crosswalk(spark, as_csv(spark, nations))


@query("panel_written_and_read", f"""
with {SQL_MEMBERS} select {SQL_COLUMNS} from assembled where year in (1994, 1996)""")
def panel_written_and_read(spark, sf_dir):
    """Written by year and read back with a list of years."""
    panel = assemble.build_panel(family_waves(spark, sf_dir), person_index(spark, sf_dir),
                                 FAMILY_REQUEST, INDEX_REQUEST, design="all")
    path = job_folder(spark)
    files.write_panel(panel, path)
    return files.read_panel(spark, path, [1994, 1996]).select(*PANEL_COLUMNS)


@query("table_written_and_read", """
select o_orderstatus as status, count(*)::varchar as n from orders group by all""")
def table_written_and_read(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n"))
    path = job_folder(spark)
    files.write_table(counts, path)
    return spark.read.option("header", True).csv(path)
