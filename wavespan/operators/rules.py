"""Recodes driven by a table of rules, and a report of rules that touch each other.

Rule rows: ``ord`` (order of application), ``column``, ``kind``, ``lo``, ``hi`` (years, open where
NULL), ``source`` and ``target``, as text.

=======  =======================================  =============================================
kind     source                                   target
=======  =======================================  =============================================
code     the code to replace, NULL for any value  the value that replaces it, NULL for missing
unit     (none)                                   the number to divide by
era      the column to take in these years        (none)
role     the head's column                        the spouse's column
=======  =======================================  =============================================
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavespan.operators import recode
from wavespan.operators.recode import Recode

KINDS = ("code", "unit", "era", "role")
SCHEMA = "ord int, column string, kind string, lo int, hi int, source string, target string"
MOST_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    ord: int
    column: str
    kind: str
    lo: int | None
    hi: int | None
    source: str | None
    target: str | None


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(SCHEMA).csv(path)


def rules(table: DataFrame) -> list[Rule]:
    """The rules in their order. They are metadata; more than ``MOST_RULES`` raise, as do rules of an
    unknown kind, without a column or out of any order (``ord`` missing or repeated)."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = table.select(*names).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = [Rule(*r) for r in rows]
    for r in found:
        if r.kind not in KINDS or r.column is None or r.ord is None:
            raise ValueError(f"not a rule: {r}")
        if (r.kind == "era" and r.source is None) or (r.kind == "unit" and not float(r.target or 0)):
            raise ValueError(f"incomplete rule: {r}")
        if r.kind == "role" and None in (r.source, r.target):
            raise ValueError(f"incomplete rule: {r}")
    if len({r.ord for r in found}) < len(found):
        raise ValueError("rules need an order: ord is repeated")
    return sorted(found, key=lambda r: r.ord)


def _typed(text: str | None, kind: str):
    if text is None or kind == "string":
        return text
    number = float(text)
    return int(number) if number.is_integer() else number


def apply_rules(df: DataFrame, table: DataFrame | Sequence[Rule], year: str = "year",
                relation: str = "relation", spouse_codes: Iterable[int] = (20, 22),
                drop: bool = True) -> DataFrame:
    """Apply the rules in order. Neighbours of one kind compile to one projection.

    Rules ``era`` of one column make up its value: in the years of several the last one counts, and
    outside all of them it is NULL. ``drop`` removes the columns that eras and roles were taken from.
    """
    found = rules(table) if isinstance(table, DataFrame) else list(table)
    sources: list[str] = []
    for kind, group in itertools.groupby(found, key=lambda r: r.kind):
        group = list(group)
        if kind == "code":
            types = dict(df.dtypes)
            df = recode.recode(df, [
                Recode(r.column, None if r.source is None else (_typed(r.source, types[r.column]),),
                       _typed(r.target, types[r.column]), r.lo, r.hi) for r in group], year)
        elif kind == "unit":
            for r in group:
                df = recode.scale_in_era(df, r.column, float(r.target), r.lo, r.hi, year)
        elif kind == "role":
            df = recode.role_collapse(df, {r.column: (r.source, r.target) for r in group}, relation,
                                      spouse_codes, drop=False)
            sources += [c for r in group for c in (r.source, r.target)]
        else:
            values = {}
            for r in group:
                values[r.column] = F.when(recode.in_years(year, r.lo, r.hi), F.col(r.source)).otherwise(
                    values.get(r.column, F.lit(None)))
            df = df.withColumns(values)
            sources += [r.source for r in group]
    return df.drop(*(set(sources) - {r.column for r in found})) if drop else df


def rule_conflicts(table: DataFrame) -> DataFrame:
    """Pairs of rules of one column and kind whose years overlap: column, kind, first, second (their
    ``ord``), lo, hi (the common years, NULL where open) and what they are to each other.

    ``conflict``: the same code, column or role, other results; the later rule has nothing left to
    replace (codes) or wins (eras). ``repeated``: the same rule again. ``shadowed``: the first rule
    replaces any value, so that the second meets none of its codes. ``chained``: the second replaces
    the value that the first one gives.
    """
    first = table.select([F.col(c).alias(f"a_{c}") for c in table.columns])
    second = table.select([F.col(c).alias(f"b_{c}") for c in table.columns])
    lo, hi = F.greatest("a_lo", "b_lo"), F.least("a_hi", "b_hi")
    pairs = first.join(second, (F.col("a_column") == F.col("b_column")) & (
        F.col("a_kind") == F.col("b_kind")) & (F.col("a_ord") < F.col("b_ord")))
    together = pairs.filter(lo.isNull() | hi.isNull() | (lo <= hi))
    is_code, is_unit = F.col("a_kind") == "code", F.col("a_kind") == "unit"
    same_source = F.col("a_source").eqNullSafe(F.col("b_source"))
    same_target = F.col("a_target").eqNullSafe(F.col("b_target"))
    relation = (
        F.when(same_source & same_target, "repeated")
        .when(is_code & same_source, "conflict")
        .when(is_code & F.col("a_target").isNotNull() & (F.col("a_target") == F.col("b_source")), "chained")
        .when(is_code & F.col("a_source").isNull(), "shadowed")
        .when(is_code & F.col("b_source").isNull(), None)
        .when(~is_code, "conflict"))
    # dividing twice is no conflict of sources: the units have none
    return together.withColumn("relation", F.when(is_unit & ~same_target, "conflict").otherwise(relation)
                               ).filter(F.col("relation").isNotNull()).select(
        F.col("a_column").alias("column"), F.col("a_kind").alias("kind"), F.col("a_ord").alias("first"),
        F.col("b_ord").alias("second"), lo.alias("lo"), hi.alias("hi"), "relation")
