"""Joins with small code tables: harmonisation, hierarchies, unmatched codes.

Code tables read from files carry no hint: Spark broadcasts them by their measured size. Tables
derived here are broadcast within a stated number of rows that the query itself tests; without one
they fall back to a sort-merge join with skew handling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavespan.functions.na import to_number
from wavespan.operators.lookup import MOST_CODES, bounded


def last_match(table: DataFrame, keys: Sequence[str], values: Sequence[str],
               order: str = "ord", distinct_on: Sequence[str] = ()) -> DataFrame:
    """One row per key: the last row in file order after duplicates are removed.

    Rows equal in ``keys``, ``values`` and the columns ``distinct_on`` are duplicates, and the
    first of them stays. A column that is not shown can thus keep a later row apart, which then
    wins. A NULL in the winning row stays NULL.
    """
    picked = list(dict.fromkeys([*keys, *values, *distinct_on]))
    distinct = table.filter(_all_present(keys)).groupBy(*picked).agg(F.min(order).alias("__ord"))
    best = F.max_by(F.struct(*values), F.col("__ord")).alias("__best")
    return distinct.groupBy(*keys).agg(best).select(
        *keys, *[F.col(f"__best.{v}").alias(v) for v in values])


def _all_present(keys: Sequence[str]) -> Column:
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).isNotNull()
    return test


def harmonise_codes(panel: DataFrame, code: str, eras: Sequence[tuple[int, int, DataFrame, str]],
                    outputs: dict[str, str], year: str = "year", order: str = "ord",
                    zero_is_missing: Sequence[str] = (), distinct_on: Sequence[str] = (),
                    most_codes: int | None = MOST_CODES) -> DataFrame:
    """Map codes of several classification eras to common ones.

    ``eras`` lists (first year, last year, crosswalk, key column); ``outputs`` maps output column
    to crosswalk column. Of repeated codes ``last_match`` takes one; ``distinct_on`` names further
    crosswalk columns by which it tells duplicates. Years outside every era and codes without a
    match give NULL. The eras are stacked into one dimension keyed by (era, code), so the panel is
    joined once. More than ``most_codes`` codes raise; None joins any number by sort-merge.
    """
    values = list(outputs.values())
    stacked = None
    era = F.lit(None).cast("int")
    for i, (lo, hi, table, key) in enumerate(eras):
        part = last_match(
            table.select(to_number(key).alias("__code"), F.col(key).alias("__text"),
                         *dict.fromkeys([*values, *distinct_on]), order),
            ["__code"], values, order, ["__text", *distinct_on]).withColumn("__era", F.lit(i))
        stacked = part if stacked is None else stacked.unionByName(part)
        era = F.when(F.col(year).between(lo, hi), F.lit(i)).otherwise(era)
    renamed = bounded(stacked.select(
        "__era", "__code", *[F.col(v).alias(out) for out, v in outputs.items()]), most_codes)
    keyed = panel.withColumns({"__era": era, "__code": F.col(code).cast("double")})
    joined = keyed.join(renamed, ["__era", "__code"], "left").drop("__era", "__code")
    return joined.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in zero_is_missing})


def unmatched_codes(panel: DataFrame, code: str, mapped: str, year: str = "year",
                    lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Distinct, sorted codes that no crosswalk row matched, within an era."""
    inside = F.lit(True)
    if lo is not None:
        inside = inside & (F.col(year) >= lo)
    if hi is not None:
        inside = inside & (F.col(year) <= hi)
    return (
        panel.filter(inside & F.col(code).isNotNull() & F.col(mapped).isNull())
        .select(code).distinct().orderBy(code)
    )


def join_codes(panel: DataFrame, codes: DataFrame, panel_code: str, code: str,
               how: str = "left") -> DataFrame:
    """Attach a code hierarchy; the panel's code column stays, the table's key goes.

    ``how="left"`` keeps every panel row. ``how="right"`` keeps every code instead: panel rows
    without a code go and unused codes appear once with NULL panel columns. A plain right outer
    join would shuffle the panel on a few hundred codes, with no way to split a hot one, so the
    right join is an inner join (code table broadcast by size) plus the codes nobody uses; those
    come from the distinct codes in use, which pre-aggregate before the shuffle.
    """
    table = codes.withColumnRenamed(code, panel_code)
    if how == "left":
        return panel.join(table, panel_code, "left")
    if how != "right":
        raise ValueError("how must be 'left' or 'right'")
    matched = panel.join(table, panel_code, "inner")
    used = panel.filter(F.col(panel_code).isNotNull()).select(panel_code).distinct()
    unused = table.join(used, panel_code, "left_anti")
    return matched.unionByName(unused, allowMissingColumns=True)


def code_difference(panel: DataFrame, codes: DataFrame, panel_code: str,
                    code: str) -> DataFrame:
    """Distinct panel codes absent from the hierarchy."""
    keys = codes.select(F.col(code).alias(panel_code)).distinct()
    return (
        panel.filter(F.col(panel_code).isNotNull()).select(panel_code).distinct()
        .join(keys, panel_code, "left_anti").orderBy(panel_code)
    )

