"""Small tables joined to a panel within the panel's own query.

Spark guesses the size of a derived table (an aggregate, say) from that of its input, and would
shuffle the panel on a few keys. The bound is therefore stated and tested while the query runs: a
table beyond it raises, and no job runs while the query is built.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_YEARS = 10_000
MOST_CODES = 100_000


def bounded(table: DataFrame, most: int | None = MOST_CODES,
            overall: Mapping[str, Column] | None = None) -> DataFrame:
    """The table, to be broadcast if it has at most ``most`` rows; more raise. With None it is joined
    as Spark sees fit. ``overall`` adds aggregates over the whole table to its rows, in the same pass.
    """
    everything = Window.partitionBy()
    columns = {name: c.over(everything) for name, c in (overall or {}).items()}
    if most is None:
        return table.withColumns(columns)
    limited = table.limit(most + 1).withColumns(
        {**columns, "__n": F.count(F.lit(1)).over(everything)})
    fits = F.when(F.col("__n") <= most, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"a lookup table has more than {most} rows")).cast("boolean"))
    return F.broadcast(limited.filter(fits).drop("__n"))
