"""Descriptive tables, shares, distributions and exact quantiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavespan.functions.na import is_one_of, na_max
from wavespan.session import stored


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: non-missing count, mean and sample standard deviation, in one pass."""
    stats = df.agg(*[
        F.struct(
            F.lit(c).alias("variable"),
            F.count(c).alias("n"),
            F.avg(F.col(c).cast("double")).alias("mean"),
            F.stddev_samp(F.col(c).cast("double")).alias("sd"),
        ).alias(f"__{i}") for i, c in enumerate(columns)
    ])
    return stats.select(F.inline(F.array(*[f"__{i}" for i in range(len(columns))])))


def share_by_year(df: DataFrame, flags: Sequence[str], employed: str | None = "emp_status",
                  year: str = "year") -> DataFrame:
    """Share of rows with each flag by wave, among the employed."""
    rows = df if employed is None else df.filter(is_one_of(employed, [1]))
    return rows.groupBy(year).agg(*[
        (F.sum(F.col(f).cast("int")) / F.count(F.lit(1))).alias(f) for f in flags
    ])


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable",
            value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def crosstab_long(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Two-way frequency table without missing values: a row for each pair of levels met."""
    return df.dropna(subset=[rows, columns]).groupBy(rows, columns).agg(
        F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence) -> DataFrame:
    """``crosstab_long`` with a column for each of ``values``, the levels of ``columns``.

    A level that is not listed raises when the table is computed.
    """
    counts = crosstab_long(df, rows, columns)
    stray = F.raise_error(F.concat(F.lit(f"{columns} has a level that is not listed: "),
                                   F.col(columns).cast("string")))
    n = F.when(F.col(columns).isin(list(values)), F.col("n")).otherwise(stray)
    return counts.withColumn("n", n).groupBy(rows).agg(*[
        F.coalesce(F.sum(F.when(F.col(columns) == v, F.col("n"))), F.lit(0)).alias(
            f"{columns}_{str(v).lower()}") for v in values])


def count_distribution(df: DataFrame, value: str, pid: str = "pid", out: str = "max_value"
                       ) -> DataFrame:
    """How many persons reach each maximum of ``value``; persons with a missing one are left out."""
    per_person = df.groupBy(pid).agg(na_max(F.col(value)).alias(out))
    return per_person.dropna(subset=[out]).groupBy(out).agg(F.count(F.lit(1)).alias("persons"))


def count_of_counts(df: DataFrame, pid: str = "pid") -> DataFrame:
    """How many persons have 1, 2, 3 ... rows."""
    per_person = df.groupBy(pid).agg(F.count(F.lit(1)).alias("n_rows"))
    return per_person.groupBy("n_rows").agg(F.count(F.lit(1)).alias("persons"))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int,
              by: Sequence[str] = ("year",)) -> DataFrame:
    """Counts per group and equal-width bin over [lo, hi); outside values get bins 0 and bins+1."""
    b = F.width_bucket(F.col(value).cast("double"), F.lit(float(lo)), F.lit(float(hi)), F.lit(bins))
    return (
        df.filter(F.col(value).isNotNull()).withColumn("bin", b)
        .groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    )


#: Cells of a pass for a group: one for each value of so many bits.
CELL_BITS = 16


def _keyed(df: DataFrame, values: Sequence[str], by: Sequence[str], named: bool) -> DataFrame:
    """Group columns, the value and a whole number in the order of the values, NULL with them; with
    ``named`` a row for each of ``values`` and its name, ``variable``.

    The bits of a double, read as a number, ascend with it if it is positive and descend if not.
    """
    x = [F.col(v).cast("double") + 0.0 for v in values]     # one zero
    if named:
        rows = df.select(*by, F.inline(F.array(*[
            F.struct(F.lit(v).alias("variable"), c.alias("__x")) for v, c in zip(values, x)])))
        by = [*by, "variable"]
    else:
        rows = df.select(*by, x[0].alias("__x"))
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.col("__x")).cast("long")
    rows = rows.select(*by, "__x", F.when(F.col("__x").isNotNull(), bits).alias("__bits"))
    key = F.when(F.col("__bits") < 0, F.col("__bits").bitwiseXOR(F.lit((1 << 63) - 1)))
    return rows.select(*by, "__x", F.coalesce(key, "__bits").alias("__key"))


def _from_key(key: Column) -> Column:
    bits = F.when(key < 0, key.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(key)
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def _same(columns: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in columns])


def _beside(df: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Join on ``columns``, in which NULL equals NULL."""
    right = right.withColumnsRenamed({c: f"__r_{c}" for c in columns})
    return df.join(right, _same(columns)).drop(*[f"__r_{c}" for c in columns])


def _shift() -> Column:
    """Bits by which keys from ``__low`` to ``__high`` are cut, so that few enough prefixes are left."""
    differ = F.col("__low").bitwiseXOR(F.col("__high"))
    return F.greatest(F.length(F.bin(differ)) - F.lit(CELL_BITS), F.lit(0)).alias("__shift")


def _quantiles(rows: DataFrame, points: Sequence[float], by: Sequence[str], names: Sequence[str]
               ) -> DataFrame:
    """Quantiles of stored rows of ``_keyed``."""
    known = rows.filter(F.col("__key").isNotNull())
    span = ["__low", "__high"]
    ranks = []
    for p in points:
        k = F.floor((F.col("__size") - 1) * F.lit(p))
        ranks += [k, F.least(k + 1, F.col("__size") - 1)]
    kept = [*by, "__size", "__slot", "__rank", *span]
    targets = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__size"), F.min("__key").alias("__low"), F.max("__key").alias("__high")
    ).select(*by, "__size", F.posexplode(F.array(*ranks)).alias("__slot", "__rank"), *span)
    done = []
    while True:
        # at most 65,536 cells for a group and range of keys, combined where the rows lie
        ranges = targets.select(*by, *span).distinct().select(*by, *span, _shift())
        right = ranges.withColumnsRenamed({c: f"__r_{c}" for c in by})
        inside = known.join(right, _same(by) & F.col("__key").between(F.col("__low"), F.col("__high"))) \
            .select(*by, *span, "__key", F.expr("shiftright(__key, __shift)").alias("__part"))
        cells = inside.groupBy(*by, *span, "__part").agg(
            F.count(F.lit(1)).alias("__n"), F.min("__key").alias("__least"),
            F.max("__key").alias("__most"))
        upto = Window.partitionBy(*by, *span).orderBy("__part").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        found = _beside(cells.withColumn("__upto", F.sum("__n").over(upto)), targets, [*by, *span])
        targets = stored(found.filter(
            (F.col("__upto") > F.col("__rank")) & (F.col("__upto") - F.col("__n") <= F.col("__rank"))
        ).select(*by, "__size", "__slot",
                 (F.col("__rank") - F.col("__upto") + F.col("__n")).alias("__rank"),
                 F.col("__least").alias("__low"), F.col("__most").alias("__high")).select(*kept))
        done.append(targets.filter("__low = __high"))
        if not targets.filter("__low <> __high").limit(1).count():
            break
        targets = targets.filter("__low <> __high")
    at = reduce(DataFrame.unionByName, done).groupBy(*by, "__size").agg(*[
        F.max(F.when(F.col("__slot") == i, F.col("__low"))).alias(f"__{i}")
        for i in range(2 * len(points))])
    interpolated = []
    for i, (p, name) in enumerate(zip(points, names)):
        h = (F.col("__size") - 1) * F.lit(p)
        part = h - F.floor(h)
        a, b = _from_key(F.col(f"__{2 * i}")), _from_key(F.col(f"__{2 * i + 1}"))
        interpolated.append(F.when(part == 0, a).otherwise(a + (b - a) * part).alias(name))
    return at.select(*by, *interpolated)


def _listed(value: str | Sequence[str], by: Sequence[str]) -> tuple[list[str], list[str], bool]:
    """The values, the columns that tell groups apart, and whether the variable is one of them."""
    if isinstance(value, str):
        return [value], list(by), False
    return list(value), [*by, "variable"], True


def exact_percentiles(df: DataFrame, value: str | Sequence[str], points: Sequence[float],
                      by: Sequence[str] = ("year",), names: Sequence[str] | None = None
                      ) -> DataFrame:
    """Exact quantiles (linear interpolation) per group, for groups of any size.

    Several values share every pass; the result then has a row for each, named in ``variable``.
    The input is evaluated once and kept as (group, value) rows. A pass counts a group's rows by the
    leading bits in which its least and greatest order-preserving keys differ, and narrows every
    wanted rank to one prefix; counts combine where the rows lie, so no task meets more than 65,536
    of them for a group and range. Passes end when each prefix holds one value: after one where a
    group's values differ in their leading 16 bits, after four at most. NULL is a group like any
    other; groups without a value have no row.
    """
    points = [float(p) for p in points]
    names = list(names) if names is not None else [f"p{round(p * 100)}" for p in points]
    values, groups, named = _listed(value, by)
    return _quantiles(stored(_keyed(df, values, list(by), named)), points, groups, names)


def level_by_year(df: DataFrame, value: str | Sequence[str], year: str = "year") -> DataFrame:
    """Mean and median of the non-missing values and the number of rows, by wave; of several values
    with a row for each, ``variable``."""
    values, groups, named = _listed(value, [year])
    rows = stored(_keyed(df, values, [year], named))
    plain = rows.groupBy(*groups).agg(F.avg("__x").alias("mean_value"),
                                      F.count(F.lit(1)).alias("n_rows"))
    medians = _quantiles(rows, [0.5], groups, ["median_value"]).withColumnsRenamed(
        {c: f"__r_{c}" for c in groups})
    return plain.join(medians, _same(groups), "left").drop(*[f"__r_{c}" for c in groups])


def box_by_year(df: DataFrame, value: str | Sequence[str], year: str = "year", reach: float = 1.5
                ) -> DataFrame:
    """Box statistics by wave: quartiles, whiskers within ``reach`` box lengths, outliers; of several
    values with a row for each, ``variable``."""
    values, groups, named = _listed(value, [year])
    rows = stored(_keyed(df, values, [year], named))
    quartiles = _quantiles(rows, [0.25, 0.5, 0.75], groups, ["q1", "median", "q3"])
    x = F.col("__x")
    span = (F.col("q3") - F.col("q1")) * F.lit(float(reach))
    near = (x >= F.col("q1") - span) & (x <= F.col("q3") + span)
    return (
        _beside(rows.filter(x.isNotNull()), quartiles, groups)
        .groupBy(*groups, "q1", "median", "q3")
        .agg(F.min(F.when(near, x)).alias("whisker_low"), F.max(F.when(near, x)).alias("whisker_high"),
             F.count_if(~near).alias("outliers"), F.count(F.lit(1)).alias("n"))
    )
