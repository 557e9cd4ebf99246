"""The same operators on a second panel: users by day, from the event stream's table."""

from pyspark.sql import functions as F

from wavespan.catalog.adapter import rounded, sql_rounded, table
from wavespan.catalog.registry import query
from wavespan.operators import change, describe, exposure, filters, spells

PERSON = {"pid": "user_id", "year": "day"}

SQL_DAYS = """
days as (
    select user_id, day, event_type, value from (
        select user_id, datediff('day', date '2024-01-01', ts::date)::int as day, event_type, value,
               row_number() over (partition by user_id, ts::date order by ts, event_id) as rn
        from events) where rn = 1),
changed as (
    select *, day - lag(day) over w as gap,
           coalesce(event_type <> lag(event_type) over w, false) as type_changed
    from days window w as (partition by user_id order by day)),
numbered as (
    select *, (sum(type_changed::int) over (partition by user_id order by day
                                            rows unbounded preceding))::int as spell
    from changed)"""


def days(spark, sf_dir):
    """The first event of each user and day."""
    events = table(spark, sf_dir, "events").select(
        "user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day"), "ts",
        "event_id", "event_type", "value")
    first = filters.one_row_per_wave(events, ["ts", "event_id"], **PERSON)
    return first.select("user_id", "day", "event_type", "value")


def numbered(spark, sf_dir):
    df = change.wave_gap(days(spark, sf_dir), **PERSON)
    df = change.code_change(df, "event_type", {}, out="type_changed", zero_is_missing=False, **PERSON)
    return spells.running_spell(df, "type_changed", **PERSON)


@query("events_spells", f"""
with {SQL_DAYS} select user_id, day, gap, type_changed, spell from numbered""")
def events_spells(spark, sf_dir):
    return numbered(spark, sf_dir).select("user_id", "day", "gap", "type_changed", "spell")


@query("events_spell_demean", f"""
with {SQL_DAYS}
select user_id, day,
       case when count(*) filter (where value is null) over w = 0
            then {sql_rounded("value - avg(value) over w", 4)} end as value_dev,
       case when day = min(day) over w then 0 else 1 end as continued
from numbered window w as (partition by user_id, spell)""")
def events_spell_demean(spark, sf_dir):
    df = exposure.on_job(numbered(spark, sf_dir), "spell", "continued", **PERSON)
    df = exposure.demean(df, {"value_dev": ("value", 1, 1)}, by=["user_id", "spell"], year="day")
    return df.select("user_id", "day", rounded("value_dev", 4).alias("value_dev"), "continued")


@query("events_share_by_day", f"""
with {SQL_DAYS}
select day, {sql_rounded("sum(type_changed::int)::double / count(*)")} as type_changed
from numbered group by day""")
def events_share_by_day(spark, sf_dir):
    shares = describe.share_by_year(numbered(spark, sf_dir), ["type_changed"], employed=None, year="day")
    return shares.select("day", rounded("type_changed").alias("type_changed"))


@query("events_value_box", f"""
with {SQL_DAYS},
q as (select event_type, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median,
             quantile_cont(value, 0.75) as q3 from days where value is not null group by event_type),
r as (select q.*, value, value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as near
      from days d join q on q.event_type = d.event_type where value is not null)
select event_type, {sql_rounded("q1", 4)} as q1, {sql_rounded("median", 4)} as median,
       {sql_rounded("q3", 4)} as q3, count(*) filter (where not near) as outliers, count(*) as n
from r group by r.event_type, r.q1, r.median, r.q3""")
def events_value_box(spark, sf_dir):
    box = describe.box_by_year(days(spark, sf_dir), "value", year="event_type")
    return box.select("event_type", *[rounded(c, 4).alias(c) for c in ("q1", "median", "q3")],
                      "outliers", "n")


@query("events_design", f"""
with {SQL_DAYS}
select user_id, day from (select *, count(*) over (partition by user_id) as n from days)
where n >= 3""")
def events_design(spark, sf_dir):
    return filters.design(days(spark, sf_dir), min_waves=3, **PERSON).select("user_id", "day")
