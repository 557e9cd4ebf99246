"""Code tables: crosswalks, hierarchies, unmatched codes."""

from pyspark.sql import functions as F

from wavespan.catalog.adapter import SQL_PANEL, panel, table
from wavespan.catalog.registry import query
from wavespan.operators import dims

# parts as a crosswalk with repeated keys, one non-numeric key and missing labels
SQL_CROSSWALK = """
crosswalk as (
    select case when p_partkey % 10 = 9 then 'n/a' else (p_partkey % 8)::varchar end as code_a,
           (p_partkey % 5 + 1)::varchar as code_b,
           nullif(p_size, 50) as code_common, p_brand as one_digit, p_partkey as ord,
           p_type as code_detail
    from part)"""


def crosswalk(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.when(key % 10 == 9, "n/a").otherwise((key % 8).cast("string")).alias("code_a"),
        (key % 5 + 1).cast("string").alias("code_b"),
        F.nullif(F.col("p_size"), F.lit(50)).alias("code_common"),
        F.col("p_brand").alias("one_digit"), key.alias("ord"), F.col("p_type").alias("code_detail"))


def _last_sql(key: str) -> str:
    return f"""
    select try_cast(code as double) as code, code_common, one_digit from (
        select *, row_number() over (partition by code order by ord desc) as rn from (
            select {key} as code, code_common, one_digit, min(ord) as ord
            from crosswalk group by all)) where rn = 1"""


@query("crosswalk_last_match", f"""
with {SQL_CROSSWALK}
select code::varchar as code, code_common, one_digit from (
    select *, row_number() over (partition by code order by ord desc) as rn from (
        select code_a as code, code_common, one_digit, min(ord) as ord
        from crosswalk group by all)) where rn = 1""")
def crosswalk_last_match(spark, sf_dir):
    table_ = crosswalk(spark, sf_dir).withColumnRenamed("code_a", "code")
    return dims.last_match(table_, ["code"], ["code_common", "one_digit"])


@query("crosswalk_last_match_detail", f"""
with {SQL_CROSSWALK},
narrow as (select code_a as code, case when ord % 3 = 0 then 1 else 2 end as code_common,
                  case when ord % 3 = 0 then 1 else 2 end as one_digit, code_detail, ord
           from crosswalk),
firsts as (select *, row_number() over (partition by code, code_common, one_digit, code_detail
                                        order by ord) as nth from narrow)
select code, code_common, one_digit from (
    select *, row_number() over (partition by code order by ord desc) as rn
    from firsts where nth = 1) where rn = 1""")
def crosswalk_last_match_detail(spark, sf_dir):
    """Few values and a finer code that is not shown: it decides which row counts as the last."""
    few = F.when(F.col("ord") % 3 == 0, 1).otherwise(2)
    table_ = crosswalk(spark, sf_dir).withColumnRenamed("code_a", "code")
    table_ = table_.withColumns({"code_common": few, "one_digit": few})
    return dims.last_match(table_, ["code"], ["code_common", "one_digit"],
                           distinct_on=["code_detail"])


SQL_HARMONISED = f"""{SQL_PANEL},{SQL_CROSSWALK},
early as ({_last_sql("code_a")}),
late as ({_last_sql("code_b")}),
harmonised as (
    select p.pid, p.year, p.ind3,
           nullif(case when p.year <= 1997 then e.code_common
                       when p.year >= 1999 then l.code_common end, 0) as code_common,
           case when p.year <= 1997 then e.one_digit
                when p.year >= 1999 then l.one_digit end as one_digit
    from panel p
    left join early e on e.code = p.ind3
    left join late l on l.code = p.ind3)"""


def _harmonised(spark, sf_dir):
    codes = crosswalk(spark, sf_dir)
    return dims.harmonise_codes(
        panel(spark, sf_dir), "ind3", [(1995, 1997, codes, "code_a"), (1999, 2001, codes, "code_b")],
        {"code_common": "code_common", "one_digit": "one_digit"}, zero_is_missing=["code_common"])


@query("harmonise_codes", f"""
with {SQL_HARMONISED} select pid, year, ind3, code_common, one_digit from harmonised""")
def harmonise_codes(spark, sf_dir):
    return _harmonised(spark, sf_dir).select("pid", "year", "ind3", "code_common", "one_digit")


@query("unmatched_codes", f"""
with {SQL_HARMONISED}
select distinct ind3 from harmonised
where year between 1999 and 2001 and code_common is null and ind3 is not null order by 1""")
def unmatched_codes(spark, sf_dir):
    return dims.unmatched_codes(_harmonised(spark, sf_dir), "ind3", "code_common", lo=1999, hi=2001)


# nations as a code hierarchy; the panel uses some of its codes, and some it lacks
SQL_HIERARCHY = f"""{SQL_PANEL},
coded as (select pid, year, nullif(ind3, 0) * 5 as code from panel),
hierarchy as (select n_nationkey as key, n_name as two_digit, n_regionkey as one_digit from nation)"""


def _coded(spark, sf_dir):
    return panel(spark, sf_dir).select(
        "pid", "year", (F.nullif(F.col("ind3"), F.lit(0)) * 5).alias("code"))


def _hierarchy(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("key"), F.col("n_name").alias("two_digit"),
        F.col("n_regionkey").alias("one_digit"))


@query("code_left_join", f"""
with {SQL_HIERARCHY}
select pid, year, code, two_digit, one_digit from coded left join hierarchy on key = code""")
def code_left_join(spark, sf_dir):
    return dims.join_codes(_coded(spark, sf_dir), _hierarchy(spark, sf_dir), "code", "key").select(
        "pid", "year", "code", "two_digit", "one_digit")


@query("code_right_join", f"""
with {SQL_HIERARCHY}
select pid, year, key as code, two_digit, one_digit from coded right join hierarchy on key = code""")
def code_right_join(spark, sf_dir):
    return dims.join_codes(_coded(spark, sf_dir), _hierarchy(spark, sf_dir), "code", "key",
                           how="right").select("pid", "year", "code", "two_digit", "one_digit")


@query("code_difference", f"""
with {SQL_HIERARCHY}
select distinct code from coded where code is not null and code not in (select key from hierarchy)
order by 1""")
def code_difference(spark, sf_dir):
    return dims.code_difference(_coded(spark, sf_dir), _hierarchy(spark, sf_dir), "code", "key")
