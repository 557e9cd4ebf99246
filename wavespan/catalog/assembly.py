"""Panel assembly from waves, variable crosswalks, fixed-width text.

Customers are households, orders are persons of the cross-wave index, suppliers carry the wealth
supplement; raw variable names differ by wave as they do in the survey.
"""

import uuid

from pyspark.sql import functions as F

from wavespan.catalog.adapter import rounded, sql_rounded, table
from wavespan.catalog.registry import query
from wavespan.operators import assemble
from wavespan.sources import fixed_width
from wavespan.sources.fixed_width import Field
from wavespan.session import shared_folder

FAMILY_REQUEST = {
    1994: {"money": "ER2100", "area": "ER2101"},
    1995: {"money": "ER5100", "area": None},
    1996: {"money": "ER7100", "area": "ER7101"},
}
INDEX_REQUEST = {1994: {"weight": "ER33190"}, 1995: {"weight": None}, 1996: {"weight": "ER33390"}}
WEALTH_REQUEST = {1994: {"assets": "S317"}}
FAMILY_KEYS = {1994: "ER2002", 1995: "ER5002", 1996: "ER7002"}


def family_waves(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    money, area = F.col("c_acctbal"), F.col("c_nationkey").cast("double")
    answered = F.when(money >= 0, money)      # a household in debt gives no answer
    return {
        1994: customers.select(F.col("c_custkey").alias("ER2002"), answered.alias("ER2100"),
                               area.alias("ER2101")),
        1995: customers.select(F.col("c_custkey").alias("er5002"), money.alias("er5100")),
        1996: customers.select(F.col("c_custkey").alias("ER7002"), answered.alias("ER7100"),
                               area.alias("ER7101")),
    }


def person_index(spark, sf_dir):
    key, household = F.col("o_orderkey"), F.col("o_custkey")
    wave = {
        "ER33101": F.when(key % 4 != 0, household).otherwise(0),
        "ER33201": F.when(key % 5 != 0, household).otherwise(0),
        "ER33301": F.when(key % 3 != 0, household).otherwise(0),
    }
    columns = [(key % 9308 + 1).alias("ER30001"), (F.floor(key / 9308) + 1).alias("ER30002")]
    for i, (interview, value) in enumerate(wave.items()):
        stem = interview[:5]
        columns += [value.alias(interview), ((key + i) % 25).alias(f"{stem}02"),
                    F.when((key + i) % 2 == 0, 10).otherwise(20).alias(f"{stem}03"),
                    (key % 100 / 4).alias(f"{stem}90")]
    return table(spark, sf_dir, "orders").select(*columns)


def wealth_waves(spark, sf_dir):
    return {1994: table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("S301"), F.col("s_acctbal").alias("S317"))}


SQL_MEMBERS = """
people as (select o_orderkey as k, o_custkey as h, o_orderkey % 9308 + 1 as id1968,
                  floor(o_orderkey / 9308)::bigint + 1 as pernum from orders),
members as (
    select 1994 as year, case when k % 4 <> 0 then h else 0 end as interview, k % 25 as sequence,
           case when k % 2 = 0 then 10 else 20 end as relation, (k % 100)::double / 4 as weight,
           id1968, pernum from people
    union all
    select 1995, case when k % 5 <> 0 then h else 0 end, (k + 1) % 25,
           case when (k + 1) % 2 = 0 then 10 else 20 end, null, id1968, pernum from people
    union all
    select 1996, case when k % 3 <> 0 then h else 0 end, (k + 2) % 25,
           case when (k + 2) % 2 = 0 then 10 else 20 end, (k % 100)::double / 4, id1968, pernum
    from people),
households as (
    select 1994 as year, c_custkey as interview, c_acctbal as money, c_nationkey::double as area
    from customer where c_acctbal >= 0
    union all select 1995, c_custkey, c_acctbal, null from customer
    union all select 1996, c_custkey, c_acctbal, c_nationkey::double from customer
    where c_acctbal >= 0),
assembled as (
    select m.year, m.interview, f.money, f.area, m.id1968, m.pernum, m.sequence, m.relation,
           m.weight, m.id1968 * 1000 + m.pernum as pid
    from members m join households f on f.year = m.year and f.interview = m.interview
    where m.interview <> 0)"""

PANEL_COLUMNS = ["year", "interview", "money", "area", "id1968", "pernum", "sequence", "relation",
                 "weight", "pid"]
SQL_COLUMNS = "year::int as year, interview, money, area, id1968, pernum, " \
              "sequence::int as sequence, relation::int as relation, weight, pid"


def _assembled(spark, sf_dir, **options):
    return assemble.build_panel(family_waves(spark, sf_dir), person_index(spark, sf_dir),
                                FAMILY_REQUEST, INDEX_REQUEST, **options)


@query("household_join", f"with {SQL_MEMBERS} select {SQL_COLUMNS} from assembled")
def household_join(spark, sf_dir):
    return _assembled(spark, sf_dir, design="all").select(*PANEL_COLUMNS)


@query("build_panel_balanced", f"""
with {SQL_MEMBERS}
select {SQL_COLUMNS} from (select *, count(*) over (partition by pid) as n from assembled)
where n = 3""")
def build_panel_balanced(spark, sf_dir):
    return _assembled(spark, sf_dir).select(*PANEL_COLUMNS)


@query("build_panel_heads", f"""
with {SQL_MEMBERS}
select {SQL_COLUMNS} from assembled
where relation = 10 and sequence between 1 and 20 and id1968 < 3000""")
def build_panel_heads(spark, sf_dir):
    return _assembled(spark, sf_dir, heads="any", sample="SRC", design="all").select(*PANEL_COLUMNS)


@query("build_panel_current_heads", f"""
with {SQL_MEMBERS}
select {SQL_COLUMNS} from (
    select *, count(*) over (partition by pid) as n from assembled
    where relation = 10 and sequence = 1)
where n >= 1""")
def build_panel_current_heads(spark, sf_dir):
    return _assembled(spark, sf_dir, heads="current", design=1).select(*PANEL_COLUMNS)


@query("build_panel_min_waves", f"""
with {SQL_MEMBERS}
select {SQL_COLUMNS} from (select *, count(*) over (partition by pid) as n from assembled)
where n >= 2""")
def build_panel_min_waves(spark, sf_dir):
    return _assembled(spark, sf_dir, design=2).select(*PANEL_COLUMNS)


@query("wealth_left_join", f"""
with {SQL_MEMBERS}
select {SQL_COLUMNS}, s_acctbal as assets
from assembled left join supplier on s_suppkey = interview and year = 1994""")
def wealth_left_join(spark, sf_dir):
    return _assembled(spark, sf_dir, wealth=wealth_waves(spark, sf_dir),
                      wealth_request=WEALTH_REQUEST, design="all").select(*PANEL_COLUMNS, "assets")


@query("union_waves", """
select o_custkey as pid, year(o_orderdate)::int as year,
       case when year(o_orderdate) % 2 = 1 then o_totalprice end as income,
       case when year(o_orderdate) % 2 = 0 then o_orderstatus end as status
from orders""")
def union_waves(spark, sf_dir):
    """One frame per wave; odd years carry an income, even years a status."""
    orders = table(spark, sf_dir, "orders")

    def wave(y):
        value = ("o_totalprice", "income") if y % 2 else ("o_orderstatus", "status")
        # a range of dates, which a scan can hold against its row groups
        dates = F.col("o_orderdate").between(F.lit(f"{y}-01-01").cast("date"),
                                             F.lit(f"{y}-12-31").cast("date"))
        return orders.filter(dates).select(
            F.col("o_custkey").alias("pid"), F.lit(y).alias("year"), F.col(value[0]).alias(value[1]))

    return assemble.union_waves([wave(y) for y in range(1995, 2002)])


@query("pivot_varlist", """
with long as (
    select year(o_orderdate)::int as year, 'v' || substr(o_orderpriority, 1, 1) as name,
           'V' || min(o_orderkey) as variable
    from orders group by all)
select year, max(variable) filter (where name = 'v1') as v1,
       max(variable) filter (where name = 'v2') as v2,
       max(variable) filter (where name = 'v3') as v3,
       max(variable) filter (where name = 'v4') as v4,
       max(variable) filter (where name = 'v5') as v5
from long group by year""")
def pivot_varlist(spark, sf_dir):
    long = (
        table(spark, sf_dir, "orders")
        .groupBy(F.year("o_orderdate").alias("year"),
                 F.concat(F.lit("v"), F.substring("o_orderpriority", 1, 1)).alias("name"))
        .agg(F.concat(F.lit("V"), F.min("o_orderkey").cast("string")).alias("variable")))
    return assemble.pivot_request(long, [f"v{i}" for i in range(1, 6)])


YEARS = (1994, 1995, 1996, 1997)
SQL_CROSSWALK = "crosswalk as (select p_partkey as ord, 'V' || (p_partkey + 3) * 5 as LABEL, " + \
    ", ".join(f"case when p_partkey % 7 <> {i} then 'V' || (p_partkey * 5 + {i}) end as Y{y}"
              for i, y in enumerate(YEARS)) + " from part)"
SQL_LOOKUP = f"""{SQL_CROSSWALK},
entries as (
    select ord, 0 as pos, LABEL as name from crosswalk
    {" ".join(f"union all select ord, {i + 1}, Y{y} from crosswalk" for i, y in enumerate(YEARS))}),
concepts as (
    select name, ord from (
        select *, row_number() over (partition by name order by pos, ord) as rn
        from entries where name is not null) where rn = 1),
by_year as ({" union all ".join(
    f"select ord, {y} as year, Y{y} as variable from crosswalk" for y in YEARS)})"""


def crosswalk(spark, sf_dir):
    key = F.col("p_partkey")
    name = F.lit("V")
    return table(spark, sf_dir, "part").select(
        key.alias("ord"), F.concat(name, ((key + 3) * 5).cast("string")).alias("LABEL"),
        *[F.when(key % 7 != i, F.concat(name, (key * 5 + i).cast("string"))).alias(f"Y{y}")
          for i, y in enumerate(YEARS)])


@query("variable_names", f"""
with {SQL_LOOKUP},
wanted as (select 'V' || s_suppkey * 11 as name from supplier)
select w.name, b.year, b.variable from wanted w
join concepts c on c.name = w.name join by_year b on b.ord = c.ord
where b.year in (1995, 1996)""")
def variable_names(spark, sf_dir):
    wanted = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("V"), (F.col("s_suppkey") * 11).cast("string")).alias("name"))
    return assemble.variable_names(wanted, crosswalk(spark, sf_dir), [1995, 1996, 2050])


@query("spliced_series", f"""
with {SQL_LOOKUP},
spec as (
    select 'series' || s_suppkey as name, 'V' || (s_suppkey * 5) as seed, 1990 as lo, 2000 as hi,
           1 as step from supplier
    union all
    select 'series' || s_suppkey, 'V' || (s_suppkey * 5 + 7), 1996, 1997, 2 from supplier)
select name, year, variable from (
    select s.name, b.year, b.variable,
           row_number() over (partition by s.name, b.year order by step desc) as rn
    from spec s join concepts c on c.name = s.seed
    join by_year b on b.ord = c.ord and b.year between lo and hi) where rn = 1""")
def spliced_series(spark, sf_dir):
    key = F.col("s_suppkey")
    series = F.concat(F.lit("series"), key.cast("string")).alias("name")

    def part(shift, lo, hi, step):
        seed = F.concat(F.lit("V"), (key * 5 + shift).cast("string")).alias("seed")
        return table(spark, sf_dir, "supplier").select(
            series, seed, F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(step).alias("step"))

    spec = part(0, 1990, 2000, 1).unionByName(part(7, 1996, 1997, 2))
    return assemble.spliced_series(spec, crosswalk(spark, sf_dir))


LAYOUT = [
    Field("o_orderkey", 1, 12), Field("o_custkey", 15, 10), Field("o_orderstatus", 26, 2, "string"),
    Field("o_totalprice", 28, 14, "double", decimals=2), Field("filler", 42, 4, "int"),
]


@query("fixed_width_ingest", """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, null::int as filler from orders""")
def fixed_width_ingest(spark, sf_dir):
    """Orders written as fixed-width lines and cut back into columns; the filler is not numeric."""
    orders = table(spark, sf_dir, "orders").withColumn("filler", F.lit("n/a"))
    lines = fixed_width.format_fixed_width(orders, LAYOUT)
    return fixed_width.parse_fixed_width(lines, LAYOUT)


FILE_LAYOUT = [Field("c_custkey", 1, 10), Field("name", 11, 24, "string"),
               Field("c_acctbal", 35, 12, "double", decimals=2), Field("area", 48, 14, "string")]


@query("fixed_width_files", """
select c_custkey, translate(c_name, 'uo', 'üö') as name, c_acctbal, n_name || 'é€' as area,
       charset
from customer join nation on n_nationkey = c_nationkey,
     (values ('ISO-8859-15'), ('UTF-8'), ('UTF-8 by bytes')) as charsets(charset)""")
def fixed_width_files(spark, sf_dir):
    """Names with accents from files of one byte per character, and from UTF-8 laid out by
    characters and by bytes."""
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.concat("n_name", F.lit("é€")).alias("area"))
    customers = table(spark, sf_dir, "customer").join(nations, "c_nationkey").select(
        "c_custkey", F.translate("c_name", "uo", "üö").alias("name"), "c_acctbal", "area")
    found = None
    for label, charset, unit in (("ISO-8859-15", "ISO-8859-15", "byte"), ("UTF-8", "UTF-8", "char"),
                                 ("UTF-8 by bytes", "UTF-8", "byte")):
        path = f"{shared_folder(spark)}/wavespan/{uuid.uuid4().hex}"
        fixed_width.write_fixed_width(customers, path, FILE_LAYOUT, charset, unit)
        read = fixed_width.read_fixed_width(spark, path, FILE_LAYOUT, charset, unit).withColumn(
            "charset", F.lit(label))
        found = read if found is None else found.unionByName(read)
    return found


SQL_ANSWERS = """
answers as (
    select 1994 as year, c_custkey as k, case when c_custkey % 3 = 0 then 'A' || c_custkey
           else ' ' || c_custkey || ' ' end as raw, c_nationkey::bigint * 9007199254740993 as big
    from customer
    union all
    select 1996, c_custkey, case when c_custkey % 5 = 0 then null else c_custkey::varchar end,
           c_nationkey::bigint * 9007199254740993 from customer)"""


@query("text_variables", f"""
with {SQL_ANSWERS}
select year, k as interview, try_cast(trim(raw) as double) as answer, big
from answers where try_cast(trim(raw) as double) is not null""")
def text_variables(spark, sf_dir):
    """Raw text that is no number is missing; whole numbers keep all digits; the first variable of
    the request tells who did not respond."""
    customers = table(spark, sf_dir, "customer")
    k, big = F.col("c_custkey"), F.col("c_nationkey").cast("long") * 9007199254740993
    early = F.when(k % 3 == 0, F.concat(F.lit("A"), k)).otherwise(
        F.concat(F.lit(" "), k, F.lit(" ")))
    waves = {1994: customers.select(k.alias("ER2002"), early.alias("ER1"), big.alias("ER2")),
             1996: customers.select(k.alias("ER7002"), F.when(k % 5 != 0, k.cast("string")).alias(
                 "ER1"), big.alias("ER2"))}
    request = {y: {"answer": "ER1", "big": "ER2"} for y in waves}
    return assemble.household_waves(waves, request, types={"answer": "double"})


@query("first_variable_absent", """
select 1994 as year, c_custkey as interview, c_acctbal as money, c_nationkey as area
from customer where c_acctbal >= 0
union all select 1995, c_custkey, null, c_nationkey from customer where c_nationkey < 20""")
def first_variable_absent(spark, sf_dir):
    """Where a wave lacks the first variable, the next one tells who did not respond."""
    customers = table(spark, sf_dir, "customer")
    area = F.col("c_nationkey")
    waves = {1994: customers.select(F.col("c_custkey").alias("ER2002"), F.when(
                 F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("ER1"), area.alias("ER2")),
             1995: customers.select(F.col("c_custkey").alias("ER5002"),
                                    F.when(area < 20, area).alias("ER2"))}
    return assemble.household_waves(waves, {1994: {"money": "ER1", "area": "ER2"},
                                            1995: {"money": None, "area": "ER2"}})
