"""Synthetic two-wave panel for tests: households, persons, attrition, carried-forward values.

Draws are a hash of (seed, stream, person), so they do not depend on partitioning, survive task
retries and can be recomputed in SQL. Interview numbers follow the person number, which keeps
them unique without a global sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Household id ranges of the four subsamples (inclusive) and raw variable names.
SUBSAMPLE_RANGES = {1: (1, 2999), 2: (3001, 4999), 3: (5001, 6999), 4: (7001, 9308)}
FIRST_INTERVIEW, SECOND_INTERVIEW = "ER30463", "ER30498"


def uniform(stream: str, seed: int, person: Column | str = "person") -> Column:
    """Deterministic draw in (0, 1), 32 bits wide."""
    key = F.col(person) if isinstance(person, str) else person
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), key.cast("string"))
    word = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")
    return (word + F.lit(0.5)) / F.lit(2.0 ** 32)


def _normal(stream: str, seed: int) -> Column:
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(stream + "a", seed)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(stream + "b", seed))


def _between(stream: str, seed: int, lo, hi) -> Column:
    low = F.lit(lo) if not isinstance(lo, Column) else lo
    high = F.lit(hi) if not isinstance(hi, Column) else hi
    return (low + F.floor(uniform(stream, seed) * (high - low + F.lit(1)))).cast("int")


def synthetic_persons(persons: DataFrame, seed: int = 1, attrition: float = 0.0) -> DataFrame:
    """Person index with one row per row of ``persons`` (a ``person`` number from 0)."""
    person = F.col("person")
    group = F.pmod(person, F.lit(4)).cast("int") + 1
    low = F.element_at(F.array(*[F.lit(r[0]) for r in SUBSAMPLE_RANGES.values()]), group)
    high = F.element_at(F.array(*[F.lit(r[1]) for r in SUBSAMPLE_RANGES.values()]), group)
    # one person of every pair is absent from the first wave: exactly half, without ranking
    which = F.when(uniform("absent", seed, F.floor(person / 2)) < 0.5, 0).otherwise(1)
    absent = F.pmod(person, F.lit(2)) == which
    lost = ~absent & (uniform("lost", seed) < attrition)

    def role(stream: str) -> Column:
        return F.when(uniform(stream, seed) < 0.5, 10).otherwise(20)

    def place(stream: str) -> Column:
        return F.when(uniform(stream, seed) < 0.75, 1).otherwise(20)

    return persons.select(
        person.cast("long").alias("person"), group.alias("smpls"),
        _between("household", seed, low, high).alias("ER30001"),
        (person + 1).cast("long").alias("ER30002"),
        F.when(absent, 0).otherwise(person + 1).cast("long").alias(FIRST_INTERVIEW),
        F.when(lost, 0).otherwise(person + 1).cast("long").alias(SECOND_INTERVIEW),
        place("place1").alias("ER30464"), place("place2").alias("ER30499"),
        role("role1").alias("ER30465"), role("role2").alias("ER30500"),
        uniform("weight1", seed).alias("ER30497"), uniform("weight2", seed).alias("ER30534"),
    )


def synthetic_panel(persons: DataFrame, seed: int = 1, attrition: float = 0.0
                    ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, first household wave, second household wave).

    Exactly half of the persons are absent from the first wave and a share ``attrition`` of the others
    from the second. Persons in both waves keep their income plus about 500 and get one year
    older: the second wave carries the first one forward by joining on the person.
    """
    index = synthetic_persons(persons, seed, attrition)
    first = index.filter(F.col(FIRST_INTERVIEW) > 0).select(
        F.col(FIRST_INTERVIEW).alias("V11102"),
        F.exp(F.lit(10.0) + _normal("money1", seed)).alias("Money85"),
        _between("age1", seed, 20, 80).alias("age85"), "person")
    second = index.filter(F.col(SECOND_INTERVIEW) > 0).join(
        first.select("person", "Money85", "age85"), "person", "left").select(
        F.col(SECOND_INTERVIEW).alias("V12502"),
        F.coalesce(F.col("Money85") + F.lit(500.0) + F.lit(30.0) * _normal("raise", seed),
                   F.exp(F.lit(10.0) + _normal("money2", seed))).alias("Money86"),
        F.coalesce(F.col("age85") + 1, _between("age2", seed, 20, 80)).alias("age86"))
    return index.drop("person"), first.drop("person"), second


def person_numbers(spark: SparkSession, n: int) -> DataFrame:
    """``2 n`` persons, of whom ``n`` are in the first wave."""
    return spark.range(2 * n).withColumnRenamed("id", "person")
